"""Pairs of similar names, found by blocking instead of pairing everything.

Both sides are reduced to their distinct (scope, key) first. A pair scores at
least ``floor`` only if

* its keys are equal, or
* its word sets have a Jaccard score of at least ``floor`` — then they share a
  word among the rarest words of each side (prefix filter), or
* its sequence ratio is at least ``floor / 0.9`` — then the longer common
  subsequence leaves at most ``u`` characters of both keys unmatched. Cut one
  key into ``u + 1`` pieces: one of them occurs whole in the other key, at most
  ``u`` positions away (partition filter).

In the edit mode the third case is an edit ratio of at least ``floor / 0.9``: then at
most ``k`` edits part the keys, and they share one of the ``2k + 1`` rarest pairs of
neighbouring characters of each (prefix filter), so a key is looked up by a number of
grams that grows with its length only.

Each filter is an equi-join, and no pair above the floor is lost. Only the pairs
that survive are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.similarity import jaccard_of_tokens, key_tokens, name_similarity
from .staging import stage

_ROUNDING = 0.00005  # scores are compared after rounding to four digits
_EPS = 1e-9


def _prefix(tokens: Column, floor: float) -> Column:
    keep = F.size(tokens) - F.ceil(F.size(tokens) * F.lit(floor) - F.lit(_EPS)) + 1
    return F.slice(tokens, 1, F.greatest(keep, F.lit(1)).cast("int"))


def _rarest_first(names: DataFrame, scope: list[str], tokens=key_tokens) -> DataFrame:
    """Words (or other ``tokens``) of each name, rarest first within the scope; ties by the word itself."""
    words = names.select(*scope, "side", "key", F.explode(tokens(F.col("key"))).alias("word"))
    counts = words.groupBy(*scope, "word").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        words.join(counts, [*scope, "word"])
        .groupBy(*scope, "side", "key")
        .agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))
        .select(*scope, "side", "key", F.transform("ranked", lambda x: x["word"]).alias("words"))
    )
    return stage(ranked, "words")


def _word_pairs(names: DataFrame, scope: list[str], floor: float) -> DataFrame:
    ranked = _rarest_first(names, scope)
    heads = ranked.select(*scope, "side", "key", "words", F.explode(_prefix(F.col("words"), floor)).alias("word"))
    left = heads.where("side = 'l'").select(*scope, "word", F.col("key").alias("left_key"), F.col("words").alias("lw"))
    right = heads.where("side = 'r'").select(*scope, "word", F.col("key").alias("right_key"), F.col("words").alias("rw"))
    sizes = (F.size("lw") >= F.size("rw") * F.lit(floor) - _EPS) & (
        F.size("rw") >= F.size("lw") * F.lit(floor) - _EPS
    )
    return (
        left.join(right, [*scope, "word"])
        .where(sizes & (jaccard_of_tokens(F.col("lw"), F.col("rw")) >= F.lit(floor)))
        .select(*scope, "left_key", "right_key")
    )


def _pieces(length: Column, slack: Column) -> Column:
    """Start and size of the pieces a key of ``length`` is cut into."""
    count = slack + 1
    return F.transform(
        F.sequence(F.lit(0), slack),
        lambda i: F.struct(
            i.alias("no"),
            F.floor(i * length / count).cast("int").alias("at"),
            (F.floor((i + 1) * length / count) - F.floor(i * length / count)).cast("int").alias("len"),
        ),
    )


def _sequence_pairs(names: DataFrame, scope: list[str], ratio: float) -> DataFrame:
    reach = (2.0 - ratio) / ratio  # longest partner, as a multiple of the length

    def slack(length: Column) -> Column:
        longest = F.floor(length * F.lit(reach) + _EPS)
        return F.floor((1.0 - ratio) * (length + longest) + _EPS).cast("int")

    left = names.where("side = 'l'").select(*scope, F.col("key").alias("left_key"))
    right = names.where("side = 'r'").select(*scope, F.col("key").alias("right_key"))
    length = F.length("right_key")
    index = right.select(
        *scope, "right_key", length.alias("size"), F.explode(_pieces(length, slack(length))).alias("p")
    ).select(
        *scope, "right_key", "size", F.col("p.no").alias("no"),
        F.substring(F.col("right_key"), F.col("p.at") + 1, F.col("p.len")).alias("piece"),
    )
    own = F.length("left_key")
    probes = (
        left.select(
            *scope, "left_key", own.alias("own"),
            F.explode(
                F.sequence(
                    F.greatest(F.ceil(own / F.lit(reach) - _EPS), F.lit(1)).cast("int"),
                    F.greatest(F.floor(own * F.lit(reach) + _EPS), F.lit(1)).cast("int"),
                )
            ).alias("size"),
        )
        .withColumn("slack", slack(F.col("size")))
        .select(*scope, "left_key", "own", "size", "slack", F.explode(_pieces(F.col("size"), F.col("slack"))).alias("p"))
        .withColumn("low", F.greatest(F.col("p.at") - F.col("slack"), F.lit(0)))
        .withColumn("high", F.least(F.col("p.at") + F.col("slack"), F.col("own") - F.col("p.len")))
        .where("high >= low")
        .select(
            *scope, "left_key", "size", F.col("p.no").alias("no"),
            F.explode(
                F.array_distinct(
                    F.transform(
                        F.sequence(F.col("low"), F.col("high")),
                        lambda at: F.substring(F.col("left_key"), at + 1, F.col("p.len")),
                    )
                )
            ).alias("piece"),
        )
    )
    return probes.join(index, [*scope, "size", "no", "piece"]).select(*scope, "left_key", "right_key")


def _bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters, with a mark before the first and behind the last."""
    padded = F.concat(F.lit("^"), key, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key) + 1), lambda at: F.substring(padded, at, 2)))


def _edit_pairs(names: DataFrame, scope: list[str], ratio: float) -> DataFrame:
    """Pairs whose edit ratio is ``ratio`` or more.

    An edit touches two bigrams, so of two keys that k edits part each has at most 2k
    distinct bigrams that the other lacks: in any common order, the first one that they
    share is among the first 2k + 1 of both. A key with too few bigrams for that meets
    all keys with hardly more, under a mark of their own.
    """
    ranked = _rarest_first(names, scope, _bigrams)
    size = F.length("key")
    # edits towards the longest partner there can be
    lost = (2 * F.floor((1.0 - ratio) * size / ratio + _EPS)).cast("int")
    few = F.when(F.size("words") <= 2 * lost, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    heads = ranked.select(
        *scope, "side", "key", size.alias("size"), F.explode(F.concat(F.slice("words", F.lit(1), lost + 1), few)).alias("gram")
    )
    left, right = (
        heads.where(F.col("side") == s[0]).select(*scope, "gram", F.col("key").alias(f"{s}_key"), F.col("size").alias(f"{s}_size"))
        for s in ("left", "right")
    )
    longer = F.greatest("left_size", "right_size")
    edits = F.floor((1.0 - ratio) * longer + _EPS).cast("int")
    near = F.abs(F.col("left_size") - F.col("right_size")) <= edits
    met = left.join(right, [*scope, "gram"]).where(near).select(*scope, "left_key", "right_key", edits.alias("edits")).distinct()
    return met.where(F.levenshtein("left_key", "right_key") <= F.col("edits")).select(*scope, "left_key", "right_key")


def near_name_pairs(
    left: DataFrame, right: DataFrame, scope: list[str], floor: float, mode: str = "sequence"
) -> DataFrame:
    """``(scope, left_key, right_key, similarity)`` for all pairs of at least ``floor``.

    ``left`` and ``right`` hold ``scope`` and ``key``. Empty keys match nothing.
    """
    sides = left.select(*scope, "key", F.lit("l").alias("side")).unionByName(
        right.select(*scope, "key", F.lit("r").alias("side"))
    )
    names = stage(sides.where("key <> ''").distinct(), "names")
    lefts = names.where("side = 'l'").drop("side")
    rights = names.where("side = 'r'").drop("side")
    equal = lefts.join(rights, [*scope, "key"]).select(
        *scope, F.col("key").alias("left_key"), F.col("key").alias("right_key"),
        F.lit(1.0).alias("similarity"),
    )
    pairs = _word_pairs(names, scope, floor - _ROUNDING)
    if mode == "sequence":
        ratio = (floor - _ROUNDING) / rules.SEQUENCE_WEIGHT
        if ratio <= 1.0:
            pairs = pairs.unionByName(_sequence_pairs(names, scope, ratio))
    if mode == "edit":
        ratio = (floor - _ROUNDING) / rules.SEQUENCE_WEIGHT
        if ratio <= 1.0:
            pairs = pairs.unionByName(_edit_pairs(names, scope, ratio))
    near = (
        pairs.where("left_key <> right_key")
        .distinct()
        .withColumn("similarity", name_similarity(F.col("left_key"), F.col("right_key"), mode))
        .where(F.col("similarity") >= floor)
    )
    return stage(equal.unionByName(near), "pairs")
