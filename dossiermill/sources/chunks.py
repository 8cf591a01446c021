"""Reassembly of Base64 texts that were stored in ordered parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..plans.staging import stage
from ..plans.stretches import counted, laid_out

#: characters of Base64 that fit in one value, with room for its row
_VALUE = (1 << 31) - (1 << 16)


def reassemble_chunks(
    parts: DataFrame,
    keys: list[str],
    ord_col: str,
    chunk_col: str,
    max_parts: int | None = rules.MAX_CHUNKS,
    max_part_chars: int | None = 450 * 1024,
    max_total_chars: int | None = 2 * 1024 * 1024,
) -> DataFrame:
    """``keys, n_parts, status, content``; parts are joined before they are decoded.

    Counts and sizes are taken first, with a combinable aggregate. Only keys that
    keep the limits have their parts brought together, so no task ever holds more
    than ``max_total_chars`` of one key; the others are reported by their status.
    A limit of None is none, but for the 2 GiB that one value can hold.
    """
    max_parts, max_part_chars = max_parts or (1 << 63) - 1, max_part_chars or _VALUE
    max_total_chars = max_total_chars or _VALUE
    text = F.regexp_replace(F.col(chunk_col), r"\s+", "")
    sized = parts.select(*keys, F.col(ord_col).alias("_ord"), text.alias("_chunk"))
    facts = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.sum(F.length("_chunk")).alias("_total"),
        F.max(F.length("_chunk")).alias("_largest"),
        F.min(F.length("_chunk")).alias("_least"),
    )
    repeated = sized.groupBy(*keys, "_ord").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).distinct()
    status = (
        F.when(F.col("n_parts") > max_parts, "too_many_parts")
        .when(F.col("_twice"), "duplicate_part")
        .when((F.col("_largest") > max_part_chars) | (F.col("_total") > max_total_chars), "too_large")
        .when(F.col("_least") == 0, "empty")
    )
    checked = facts.join(repeated.withColumn("_twice", F.lit(True)), keys, "left").select(
        *keys, "n_parts", status.alias("_status")
    )
    joined = (
        sized.join(checked.where("_status is null").select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_ord", "_chunk"))).alias("_parts"))
        .select(*keys, F.array_join(F.transform("_parts", lambda p: p["_chunk"]), "").alias("_text"))
    )
    strict = F.col("_text").rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length("_text") % 4 == 0)
    content = F.when(strict, F.try_to_binary("_text", F.lit("base64")))
    return checked.join(joined, keys, "left").select(
        *keys,
        "n_parts",
        F.coalesce(F.col("_status"), F.when(content.isNull(), "invalid").otherwise("ok")).alias("status"),
        content.alias("content"),
    )


def reassembled_blocks(parts: DataFrame, keys: list[str], ord_col: str, chunk_col: str, block_chars: int = 1 << 20) -> DataFrame:
    """``keys, block_no, content, status``: texts of any length as ordered rows of decoded bytes.

    Only the lengths of parts are laid out in order: their running sum says where each part
    begins. Parts then take their place by an equi-join, are cut at the borders of blocks of
    ``block_chars`` characters by themselves, be they shorter than four characters or longer
    than a block, and the pieces of a block are joined and decoded on their own. So texts
    are shuffled twice and written nowhere, no value is longer than a block, and a text with
    most of the parts is spread over its blocks. A text is ``ok`` if all its blocks are; a
    part whose position repeats makes it ``duplicate_part``, without content. ``parts`` is
    read several times. Texts without a key are left out.
    """
    if block_chars % 4:
        raise ValueError("blocks are cut between groups of four characters")
    text = F.regexp_replace(F.col(chunk_col), r"\s+", "")
    sized = parts.select(*keys, F.col(ord_col).alias("_ord"), text.alias("_chunk")).dropna(subset=keys)
    log = laid_out(sized.select(*keys, "_ord", F.length("_chunk").cast("bigint").alias("_size")), keys, ["_ord"])
    repeated = log.rows.groupBy(*keys, "_ord").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys).distinct()
    facts = stage(
        log.rows.groupBy(*keys).agg(F.sum("_size").alias("_total")).where("_total > 0")
        .join(repeated.withColumn("_twice", F.lit(True)), keys, "left"),
        "text-facts",
    )
    # texts in which no position repeats: a part is known by its position
    known = facts.where("_twice is null").select(*keys, "_total")
    placed = counted(log, {"_end": F.col("_size")}).where("_size > 0").join(known, keys).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_ord").alias("_at_ord"), (F.col("_end") - F.col("_size")).alias("_start"), "_end", "_total"
    )
    here = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
    found = sized.join(placed, [*here, F.col("_ord").eqNullSafe(F.col("_at_ord"))])
    first, last = F.floor(F.col("_start") / block_chars), F.floor((F.col("_end") - 1) / block_chars)
    cut = found.withColumn("block_no", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.lit(0), F.col("block_no") * block_chars - F.col("_start"))
    end = F.least(F.col("_end"), (F.col("block_no") + 1) * block_chars) - F.col("_start")
    pieces = cut.select(*keys, "block_no", "_start", "_total", F.substring(F.col("_chunk"), (begin + 1).cast("int"), (end - begin).cast("int")).alias("_piece"))
    blocks = pieces.groupBy(*keys, "block_no").agg(F.max("_total").alias("_total"), F.array_sort(F.collect_list(F.struct("_start", "_piece"))).alias("_pieces")).select(
        *keys, "block_no", "_total", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("_text")
    )

    def final(total: str) -> Column:
        return F.floor((F.col(total) - 1) / block_chars)

    # padding stands at the end of the text only
    strict = F.col("_text").rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length("_text") % 4 == 0) & ((F.col("block_no") == final("_total")) | ~F.contains("_text", F.lit("=")))
    content = F.when(strict, F.try_to_binary("_text", F.lit("base64")))
    decoded = blocks.select(*keys, "block_no", content.alias("content")).withColumn("status", F.when(F.col("content").isNull(), "invalid").otherwise("ok"))
    twice = facts.where("_twice").select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), final("_total"))).alias("block_no"), F.lit(None).cast("binary").alias("content"), F.lit("duplicate_part").alias("status")
    )
    return decoded.unionByName(twice)


def chained_digest(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_blocks, n_bytes, digest, status``: one digest a text, from its blocks' digests in order.

    The digest is that of the blocks' SHA-256 values joined; 32 bytes a block, so a text
    of terabytes stays a small value. The worst status of a text's blocks is its own.
    """
    return blocks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_blocks"),
        F.sum(F.length("content").cast("bigint")).alias("n_bytes"),
        F.array_sort(F.collect_list(F.struct("block_no", F.sha2("content", 256).alias("d")))).alias("_d"),
        F.max(F.when(F.col("status") != "ok", F.col("status"))).alias("_bad"),
    ).select(
        *keys, "n_blocks", "n_bytes",
        F.when(F.col("_bad").isNull(), F.sha2(F.array_join(F.transform("_d", lambda x: x["d"]), ""), 256)).alias("digest"),
        F.coalesce("_bad", F.lit("ok")).alias("status"),
    )
