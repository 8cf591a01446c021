"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. A document's expected copies are its source's
ratio of target to size, scaled by its propensity. The whole part of them is taken
for certain. The rest is an inclusion probability p, and documents are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), with u drawn from
the document's id (Rosen's Pareto sampling). The head of this order is taken once
more, up to the size that the certain copies leave open; behind all documents stand
their further copies, up to the most there may be, in the same order. Documents that
are longer than what is open have no draw. What stands behind the first document that
does not fit is drawn again towards a gap of more than ``TOLERANCE`` of the target, which
short documents fill, ``ROUNDS`` times in all; smaller gaps are left, so that inclusion
keeps its odds (with ``fill`` all are drawn until nothing fits). One more document a
source, the nearest to the gap, closes it.

Defined cases: a null text has no words; documents without words are never taken;
null sources are one source, the last; repeated rows are documents of their own
with equal draws, so which of two equal rows is taken does not show; a null id
draws like an empty one; an empty table gives an empty result; other columns are
not looked at and not returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import count_words, hash_unit, running

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
ROUNDS = 3
TOLERANCE = 0.002


def length_propensity(size: Column) -> Column:
    """A document with ten times the words is likelier by one part in five or less."""
    return F.lit(4) + F.length(size.cast("string"))


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares by weight, none above ``max_copies`` sizes.

    Weights repeat over the sources by code point, null last. In the order of
    weight over size, a source is capped if its share of what the capped ones
    before it leave is above its cap; all windows run over one row per source.
    """
    ranked = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    weighed = sources.withColumn("_w", F.element_at(cycle, ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    by_need = W.orderBy((F.col("_w") / F.nullif(F.col("source_size"), F.lit(0))).desc_nulls_first(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(W.unboundedPreceding, -1)
    cap = F.lit(max_copies) * F.col("source_size")
    return (
        weighed.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("_left_w", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_capped", F.col("_w") * F.col("_left") >= cap * F.col("_left_w"))
        .withColumn("_open", F.sum("source_size").over(every) - F.sum(F.when(F.col("_capped"), cap).otherwise(0)).over(every))
        .withColumn("_open_w", F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("_capped"), cap.cast("double")).otherwise((F.col("_w") * F.col("_open")).cast("double") / F.col("_open_w")),
        )
        .drop("_w", "_left", "_left_w", "_capped", "_open", "_open_w")
    )


def mix(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, propensity=length_propensity, fill: bool = False, rounds: int = ROUNDS
) -> DataFrame:
    """Copies per row of ``sized`` (doc_id, source, size): adds source_size, target, copies.

    The rows of a hot source are dealt out in stretches of their order. Tables of one
    row per source are written, so that their joins leave those rows where they are.
    """
    narrow = stage(
        sized.select(
            F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("_key"),
            "doc_id", "source", "size", propensity(F.col("size")).cast("bigint").alias("_p"), F.monotonically_increasing_id().alias("_id"),
        ),
        "mix-sizes",
    )
    sources = narrow.groupBy("_key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.sum(F.col("_p") * F.col("size")).alias("_p_size"),
        F.count(F.lit(1)).alias("_rows"),
    )
    targets = stage(source_targets(sources, weights, max_copies), "mix-targets").drop("source")

    expected = F.when(F.col("_p_size") > 0, F.col("target") * F.col("_p") / F.col("_p_size")).otherwise(F.lit(0.0))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.greatest(F.lit(0.01), F.least(F.lit(0.99), ratio - F.floor(ratio)))
    drawn = (
        narrow.join(targets, "_key")
        .withColumn("_e", expected)
        .withColumn("_sure", F.least(F.lit(max_copies), F.floor("_e")).cast("bigint"))
        .withColumn("_incl", F.when(F.col("_sure") < max_copies, F.col("_e") - F.col("_sure")).otherwise(F.lit(0.0)))
        .withColumn("_u", hash_unit(F.col("doc_id"), F.lit("mix")))
        .withColumn("_odds", (F.col("_u") / (1 - F.col("_u"))) * (mean / (1 - mean)))
        # x / (1 + x) of the rank, scaled to spread evenly; a row that cannot be drawn stands last
        .withColumn(
            "_place",
            F.when(F.col("_incl") > 0, F.col("_odds") / (F.col("_odds") + F.col("_incl") / (1 - F.col("_incl")))).otherwise(F.lit(1.0)),
        )
    )
    rest = F.greatest(F.lit(0.0), F.first("target") - F.sum(F.col("_sure") * F.col("size")))
    gap = stage(drawn.groupBy("_key").agg(rest.alias("_gap"), (F.lit(TOLERANCE) * F.first("target")).alias("_tolerance")), "mix-gaps")
    # a row for every further copy there may be; what is longer than the open rest stays out
    layers = F.explode(F.sequence(F.lit(1).cast("bigint"), max_copies - F.col("_sure")))
    could = drawn.where((F.col("_sure") < max_copies) & (F.col("size") > 0)).join(gap, "_key").where(F.col("size") <= 2 * F.col("_gap"))
    left = stage(could.select("_key", "_id", "doc_id", "size", "_place", layers.alias("_layer")), "mix-order")
    taken: list[DataFrame] = []
    order = ["_layer", "_place", "doc_id", "size", "_id"]
    while fill or len(taken) < rounds:
        wide = F.lit(True) if fill or not taken else F.col("_gap") > F.col("_tolerance")
        fitting = left.join(gap, "_key").where((F.col("size") <= F.col("_gap")) & wide)
        rows = stage(fitting.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")), "mix-rows")
        if rows.isEmpty():
            break
        at = (F.col("_layer") - 1 + F.col("_place")) / max_copies
        ahead = running(fitting.join(rows, "_key").withColumn("_at", at), "_key", "_rows", "_at", order, F.col("size"))
        more = stage(ahead.where(F.col("_before") + F.col("size") <= F.col("_gap")).select("_key", "_id", "_layer", "size"), "mix-more")
        taken.append(more)
        sums = more.groupBy("_key").agg(F.sum("size").alias("_sum"))
        gap = stage(gap.join(sums, "_key", "left").select("_key", (F.col("_gap") - F.coalesce("_sum", F.lit(0))).alias("_gap"), "_tolerance"), "mix-gaps")
        left = left.join(more.select("_id", "_layer"), ["_id", "_layer"], "left_anti")
        if fill:
            left = stage(left, "mix-left")
    off = F.abs(F.col("size") - F.col("_gap"))
    near = left.join(gap, "_key").where(off < F.col("_gap"))
    last = near.groupBy("_key").agg(F.min(F.struct(off.alias("_off"), *order)).alias("_last")).select("_last._id")
    extra = last
    for more in taken:
        extra = extra.unionAll(more.select("_id"))
    extra = stage(extra.groupBy("_id").agg(F.count(F.lit(1)).alias("_extra")), "mix-taken")
    return drawn.join(extra, "_id", "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_sure") + F.coalesce("_extra", F.lit(0))).alias("copies")
    )


def sized_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"))


def _same(key: Column, source: Column, size: Column) -> Column:
    parts = [F.coalesce(key.cast("string"), F.lit("")), F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)), size.cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def repeat(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with every document as often as the mix takes it, and all its columns.

    Documents are known by id, source and size; rows that share all three, which have
    equal draws, each get the larger of their counts.
    """
    mixed = mix(sized_documents(docs, key, text, source), weights, max_copies, fill=True).where("copies > 0")
    taken = stage(
        mixed.groupBy(_same(F.col("doc_id"), F.col("source"), F.col("size")).alias("own")).agg(F.max("copies").cast("int").alias("copies")), "mix-taken"
    )
    rows = docs.select(F.struct("*").alias("row"), _same(F.col(key), F.col(source), count_words(F.col(text))).alias("own"))
    return rows.join(taken, "own").select(F.explode(F.sequence(F.lit(1), F.col("copies"))), "row").select("row.*")
