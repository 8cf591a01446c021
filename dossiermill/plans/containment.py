"""Pairs in which one text contains another, by an equi-join on one n-gram.

If ``needle`` occurs in ``haystack``, so does every n-gram of ``needle``. Each
needle is looked up by its *rarest* gram of a width that fits it: an index counts
in how many haystacks of its scope every wanted gram stands, and the gram with the
fewest wins. A gram that no haystack has ends the needle there. So names with a
common beginning do not meet all texts that begin like them. Both sides are
distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

WIDTHS = [1, 2, 3, 6, 12]


def _width(length):
    result = F.lit(WIDTHS[0])
    for width in WIDTHS[1:]:
        result = F.when(length >= width, width).otherwise(result)
    return result


def _grams(text: str, width: Column) -> Column:
    """The distinct n-grams of a text; none if it is shorter."""
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda at: F.substring(F.col(text), at, width)))


def gram_index(large: DataFrame, wanted: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, width, gram, haystack)`` for the wanted grams; ``large`` holds ``scope, haystack``."""
    widths = wanted.select(*scope, "width").distinct()
    every = (
        large.join(widths, scope)
        .where(F.length("haystack") >= F.col("width"))
        .select(*scope, "haystack", "width", F.explode(_grams("haystack", F.col("width"))).alias("gram"))
    )
    return every.join(wanted.select(*scope, "width", "gram").distinct(), [*scope, "width", "gram"])


def rarest_grams(probe: DataFrame, index: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, needle, width, gram)``: of each needle's grams the one that stands in the fewest haystacks.

    Needles with a gram that stands in none are left out: nothing contains them.
    """
    counts = index.groupBy(*scope, "width", "gram").agg(F.count(F.lit(1)).alias("n"))
    met = probe.join(counts, [*scope, "width", "gram"], "left")
    best = met.groupBy(*scope, "needle", "width").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("b"))
    return best.where("b.n > 0").select(*scope, "needle", "width", F.col("b.gram").alias("gram"))


def probes(needles: DataFrame, haystacks: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, needle, haystack)`` pairs that share the needle's rarest gram and are worth a test."""
    small = needles.where("needle <> ''").select(*scope, "needle").distinct()
    large = haystacks.where("haystack <> ''").select(*scope, "haystack").distinct()
    width = _width(F.length("needle"))
    wanted = stage(
        small.withColumn("width", width).withColumn("gram", F.explode(_grams("needle", F.col("width")))), "wanted-grams"
    )
    index = stage(gram_index(large, wanted, scope), "gram-index")
    return rarest_grams(wanted, index, scope).join(index, [*scope, "width", "gram"]).select(*scope, "needle", "haystack")


def containment_pairs(needles: DataFrame, haystacks: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, needle, haystack)`` for every haystack that contains the needle."""
    return probes(needles, haystacks, scope).where(F.col("haystack").contains(F.col("needle")))
