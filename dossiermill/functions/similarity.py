"""Name and text similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import rules


def key_tokens(key: Column) -> Column:
    """Distinct words of a key, sorted; the empty key has none."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda x: x != "")))


def jaccard_of_tokens(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared / F.greatest(F.size(left) + F.size(right) - shared, F.lit(1))


def token_jaccard(left_key, right_key) -> Column:
    """Shared words over all words of two keys."""
    a = F.col(left_key) if isinstance(left_key, str) else left_key
    b = F.col(right_key) if isinstance(right_key, str) else right_key
    return jaccard_of_tokens(key_tokens(a), key_tokens(b))


@F.pandas_udf(DoubleType())
def sequence_ratio(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff–Obershelp ratio; the order of the two arguments matters.

    One matcher is kept per run of equal right-hand texts, because indexing the
    right-hand text is the costly half of its work.
    """
    from difflib import SequenceMatcher

    matcher, indexed = SequenceMatcher(None), None
    for left, right in parts:
        ratios = []
        for a, b in zip(left, right):
            if a is None or b is None:
                ratios.append(None)
                continue
            if b != indexed:
                matcher.set_seq2(b)
                indexed = b
            matcher.set_seq1(a)
            ratios.append(matcher.ratio())
        yield pd.Series(ratios, dtype="float64")


def edit_ratio(left: Column, right: Column) -> Column:
    """One less the share of the longer text's characters that edits (insert, delete, replace) have to touch."""
    return 1 - F.levenshtein(left, right) / F.greatest(F.length(left), F.length(right), F.lit(1))


def name_similarity(left_key: Column, right_key: Column, mode: str = "sequence") -> Column:
    """Similarity of two name keys, rounded to four digits.

    ``mode="jaccard"`` leaves out the sequence part; ``mode="edit"`` takes the edit
    ratio in its place. Both stay inside the JVM.
    """
    score = token_jaccard(left_key, right_key)
    if mode == "sequence":
        score = F.greatest(score, F.lit(rules.SEQUENCE_WEIGHT) * sequence_ratio(left_key, right_key))
    elif mode == "edit":
        score = F.greatest(score, F.lit(rules.SEQUENCE_WEIGHT) * edit_ratio(left_key, right_key))
    return (
        F.when((left_key == "") | (right_key == ""), F.lit(0.0))
        .when(left_key == right_key, F.lit(1.0))
        .otherwise(F.round(score, 4))
    )
