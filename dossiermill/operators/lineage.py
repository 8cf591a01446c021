"""Fingerprints, digests and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_sha256, json_array, json_text
from ..functions.text import clean_text, marker_pattern
from ..plans.literals import replace_all
from ..plans.ordered import ordinal
from .segments import residual_markers

JOB = "job_id"
# The roles a fingerprint covers, in order.
COMMON_ROLES = ["ghe", "psychosocial_raw", "ergo_raw", "cnpj_card"]
MODE_ROLES = {
    "integrated": ["technical_integrated"],
    "separate": ["psychosocial_analysis", "ergonomic_analysis"],
}


def job_fingerprint(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """SHA-256 of the canonical JSON of mode and (role, hash) pairs: ``job_id, fingerprint``.

    NULL for a job that lacks one of the files. A job has one file per role, so the
    hashes are a fixed set of columns; nothing is collected.
    """
    roles = [*COMMON_ROLES, *[r for rs in MODE_ROLES.values() for r in rs]]
    wide = artifacts.groupBy(JOB).agg(
        *[F.min(F.when(F.col("role") == r, F.col("sha256"))).alias(f"_{r}") for r in roles]
    )
    text = F.lit(None).cast("string")
    for mode, own in MODE_ROLES.items():
        listed = [
            F.concat(F.lit('{"role":"' + r + '","sha256":"'), F.col(f"_{r}"), F.lit('"}')) for r in [*COMMON_ROLES, *own]
        ]
        body: list[Column] = []
        for i, entry in enumerate(listed):
            body += [F.lit(","), entry] if i else [entry]
        whole = F.concat(F.lit('{"analysis_mode":"' + mode + '","sources":['), *body, F.lit("]}"))
        text = F.when(F.col("analysis_mode") == mode, whole).otherwise(text)
    return jobs.select(JOB, "analysis_mode").join(wide, JOB, "left").select(JOB, F.sha2(text, 256).alias("fingerprint"))


def fingerprint_gate(fingerprints: DataFrame, profiles: DataFrame) -> DataFrame:
    """Whether a stored exception profile belongs to exactly these files."""
    return profiles.join(fingerprints, JOB, "left").select(
        JOB,
        F.coalesce(
            (F.length("input_fingerprint") == 64) & (F.lower("input_fingerprint") == F.col("fingerprint")), F.lit(False)
        ).alias("applies"),
    )


def markers_of(text: Column, prefix: str) -> Column:
    """Sorted markers of one text, repeats kept."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(f"({marker_pattern(prefix)})"), F.lit(1)))


def digest_of(texts: Column) -> Column:
    """SHA-256 of the compact JSON array of the sorted texts of one row."""
    return F.sha2(json_array(F.array_sort(texts)), 256)


_LANES, _MODULUS = 4, 1 << 64


def _lanes(value: Column, times: Column) -> list[Column]:
    """The four 64-bit words of a value's SHA-256, each multiplied by how often it counts; a NULL value differs from all texts."""
    tagged = F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), value.cast("string")))
    digest = F.sha2(tagged, 256)
    word = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") for k in range(_LANES)]
    return [w * times.cast("decimal(17,0)") for w in word]


def multiset_digest(df: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """``keys, n, lane0 … lane3``: a digest of the multiset of values of each key, in whatever order they come.

    Each value's SHA-256 is taken as four numbers, which are added up modulo 2^64. The
    sum is combined before the shuffle, nothing is sorted or gathered, and a key with
    10^9 values needs four numbers. Equal multisets have equal digests; ``merge_digests``
    adds digests of parts, and takes parts away with ``times`` of -1.
    """
    n = F.lit(1) if times is None else F.col(times)
    sums = [F.sum(lane).alias(f"lane{k}") for k, lane in enumerate(_lanes(F.col(value), n))]
    return _reduced(df.groupBy(*keys).agg(F.sum(n).cast("bigint").alias("n"), *sums), keys)


def merge_digests(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The digest of all parts of a key together."""
    sums = [F.sum(f"lane{k}").alias(f"lane{k}") for k in range(_LANES)]
    return _reduced(parts.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"), *sums), keys)


def _reduced(sums: DataFrame, keys: list[str]) -> DataFrame:
    modulus = F.lit(str(_MODULUS)).cast("decimal(20,0)")
    return sums.select(*keys, "n", *[F.pmod(F.col(f"lane{k}"), modulus).cast("decimal(20,0)").alias(f"lane{k}") for k in range(_LANES)])


def inventory_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Multiset of values per key, as counts."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def inventory_equal(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, equal``: whether two inventories hold the same values equally often.

    Compares counts by equi-join; no inventory is ever gathered into one value.
    """
    a = inventory_counts(left, keys, value).withColumnRenamed("n", "_a")
    b = inventory_counts(right, keys, value).withColumnRenamed("n", "_b")
    return (
        a.join(b, [*keys, value], "full_outer")
        .groupBy(*keys)
        .agg(F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("equal"))
    )


def integrity_check(declared: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose size or hash is not the declared one, or that are gone."""
    theirs = actual.select(*keys, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    rule = (
        F.when(F.col("_sha").isNull(), "missing")
        .when(F.col("size_bytes") != F.col("_size"), "size_differs")
        .when(F.lower("sha256") != F.col("_sha"), "hash_differs")
    )
    return declared.join(theirs, keys, "left").select(*keys, rule.alias("code")).where("code is not null")


def redact_literals(df: DataFrame, text: str, literals: dict[str, str], prefix: str) -> DataFrame:
    """Replace fixed literals, in order; texts that changed keep the hash of their original.

    ``literals`` is configuration, a handful of names; markers are never replaced.
    """
    whole = "^" + marker_pattern(prefix) + r"\z"
    import re

    used = {a: b for a, b in literals.items() if a and not re.match(whole.replace(r"\z", "$"), a)}
    original = F.col(text)
    redacted = original
    hit = F.lit(False)
    for literal, replacement in used.items():
        hit = hit | redacted.contains(literal)
        redacted = F.replace(redacted, F.lit(literal), F.lit(replacement))
    collapsed = clean_text(original)
    return df.withColumn(
        "removed_sha256", F.when(hit & (collapsed != ""), content_sha256(collapsed))
    ).withColumn(text, redacted)


def redact_dictionary(df: DataFrame, text: str, literals: DataFrame, prefix: str, rule: str = "longest") -> DataFrame:
    """As ``redact_literals`` for a table ``literal, replacement, ord`` of any size, in one pass.

    ``rule`` says which of overlapping occurrences count (``plans.literals``); adds
    ``removed_sha256`` and ``n_replaced``.
    """
    kept = df.withColumn("_original", F.col(text))
    redacted = replace_all(kept, text, literals, rule, marker_pattern(prefix))
    collapsed = clean_text("_original")
    return redacted.withColumn(
        "removed_sha256", F.when((F.col("n_replaced") > 0) & (collapsed != ""), content_sha256(collapsed))
    ).drop("_original")


def literals_left(redacted: DataFrame, keys: list[str], text: str, literals: DataFrame, prefix: str) -> DataFrame:
    """``keys, n_left``: documents in which literals of the dictionary can still be found."""
    found = replace_all(redacted.select(*keys, text), text, literals, "longest", marker_pattern(prefix))
    return found.where("n_replaced > 0").groupBy(*keys).agg(F.sum("n_replaced").alias("n_left"))


def redact_slots(df: DataFrame, keys: list[str], name: str, order: list[str], text: str, prefix: str) -> DataFrame:
    """Every text becomes the marker of its numbered slot; originals survive as hashes only.

    The slot number counts per ``keys`` and ``name`` in ``order``.
    """
    numbered = ordinal(df, [*keys, name], order, "slot_no")
    marker = F.concat(
        F.lit("{{" + prefix + "_"), F.upper(name), F.lit("_"), F.col("slot_no").cast("string"), F.lit("}}")
    )
    original = clean_text(text)
    kept = (original != "") & ~original.rlike("^" + marker_pattern(prefix) + r"\z")
    return (
        numbered.withColumn("removed_sha256", F.when(kept, content_sha256(original)))
        .withColumn(text, marker)
    )


def residual_hashes(removed: DataFrame, output: DataFrame, sha: str = "sha256") -> DataFrame:
    """Removed contents that are in the output after all."""
    return removed.select(sha).distinct().join(output.select(sha).distinct(), sha, "left_semi")


def verify_redaction(redacted: DataFrame, keys: list[str], text: str, removed: DataFrame, prefix: str) -> DataFrame:
    """Per document: markers left in it, and original texts that can still be found in it."""
    markers = residual_markers(redacted, keys, text, prefix).groupBy(*keys).agg(F.sum("n").alias("n_markers"))
    hashed = redacted.select(*keys, content_sha256(clean_text(text)).alias("sha256"))
    leaks = hashed.join(removed.select("sha256").distinct(), "sha256", "left_semi").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_leaks")
    )
    return (
        redacted.select(*keys).distinct().join(markers, keys, "left").join(leaks, keys, "left")
        .fillna(0, subset=["n_markers", "n_leaks"])
    )


__all__ = [
    "content_sha256", "json_text", "job_fingerprint", "fingerprint_gate", "markers_of", "digest_of",
    "inventory_equal", "integrity_check", "redact_literals", "redact_dictionary", "literals_left", "redact_slots", "residual_hashes", "verify_redaction",
]
