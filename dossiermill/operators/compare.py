"""Comparison of two versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.similarity import sequence_ratio


def lines_of(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    breaks = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
    lines = F.split(F.regexp_replace(text, breaks + r"\z", ""), breaks)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(lines)


def line_containment(reference: Column, candidate: Column) -> Column:
    """Share of the reference's lines that occur in the candidate, five digits."""
    lines = lines_of(reference)
    found = F.size(F.filter(lines, lambda x: (x != "") & candidate.contains(x)))
    return F.round(found / F.greatest(F.size(lines), F.lit(1)), 5)


def text_ratio(reference: Column, candidate: Column) -> Column:
    """Sequence ratio of two whole texts, five digits.

    Each pair is one row and is worked on by itself, so pairs spread over tasks
    however many belong to one job. Equal texts do not reach Python.
    """
    different = reference != candidate
    ratio = sequence_ratio(F.when(different, reference), F.when(different, candidate))
    return F.round(F.when(different, ratio).otherwise(F.lit(1.0)), 5)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of ``size`` words of a text; the whole text where it has fewer, none without words."""
    found = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(
            F.size(words) >= size, F.array_distinct(runs)
        ).otherwise(F.array(F.array_join(words, " ")))

    return F.get(F.transform(F.array(found), of), F.lit(0))


def shingle_similarity(reference: Column, candidate: Column, size: int = 3) -> Column:
    """Shared over all distinct word shingles of two texts, five digits; 1 for two texts without words."""

    def of(pair: Column) -> Column:
        shared = F.size(F.array_intersect(pair["a"], pair["b"]))
        every = F.size(pair["a"]) + F.size(pair["b"]) - shared
        return F.when(every == 0, F.lit(1.0)).otherwise(F.round(shared / every, 5))

    both = F.struct(shingles(reference, size).alias("a"), shingles(candidate, size).alias("b"))
    return F.get(F.transform(F.array(both), of), F.lit(0))


def align_by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """Parts with the same number on both sides: as many as the shorter side has."""
    on = [*keys, ord_col]
    a = left.select(*on, *[F.col(c).alias(f"left_{c}") for c in left.columns if c not in on])
    b = right.select(*on, *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in on])
    return a.join(b, on)


def structure_diff(left: DataFrame, right: DataFrame, keys: list[str], ord_col: str, columns: list[str]) -> DataFrame:
    """Parts that differ between two sides, by number; a part on one side only differs."""
    a = left.select(*keys, ord_col, F.struct(*columns).alias("_a"))
    b = right.select(*keys, ord_col, F.struct(*columns).alias("_b"))
    state = (
        F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").otherwise("changed")
    )
    return (
        a.join(b, [*keys, ord_col], "full_outer")
        .where(~F.col("_a").eqNullSafe(F.col("_b")))
        .select(*keys, ord_col, state.alias("state"))
    )


def array_diff_metrics(
    left: Column,
    right: Column,
    threshold: float = rules.ARRAY_DIFF_THRESHOLD,
    blank: float = rules.ARRAY_BLANK_LEVEL,
) -> Column:
    """Metrics of two equally long arrays: mean difference, share changed, blank flags."""
    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return total / F.greatest(F.size(values), F.lit(1))

    diffs = F.zip_with(left, right, lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    changed = F.size(F.filter(diffs, lambda d: d > threshold)) / F.greatest(F.size(diffs), F.lit(1))
    left_blank, right_blank = mean(left) > blank, mean(right) > blank
    return F.struct(
        F.round(mean(diffs), 3).alias("mean_difference"),
        F.round(changed, 5).alias("changed_ratio"),
        left_blank.alias("left_blank"),
        right_blank.alias("right_blank"),
        (right_blank & ~left_blank).alias("unexpected_blank"),
    )
