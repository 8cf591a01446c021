"""Quality rules: a bitmask ledger, versioned policies over it, and their ablations.

Every rule is evaluated once per document. The ledger keeps what was measured and
one bit per failed rule, so another policy, a new threshold report or the effect of
leaving a rule out needs no second look at the texts.

Defined cases: a null text is an empty one and has no words; the shares of an
empty text are 0 of 0, which no share rule fails; rows are judged one by one, so
repeated rows and null or repeated ids give a row each; an empty table gives an
empty ledger; other columns of the input are not looked at and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, once, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals")

#: name -> condition over the measures; the bit of a rule is its place. Append only: ledgers on disk keep their meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "exclaims": "100 * n_exclaims > 50 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
}
BASE = ("few_words", "repeated_words")
#: version -> the rules that it rejects by
POLICIES: dict[str, tuple[str, ...]] = {"v1": BASE, "v2": tuple(RULES)}


def bit_of(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask_of(version: str) -> int:
    return sum(bit_of(r) for r in POLICIES[version])


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; window i covers words i to i + 2."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])

        return F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        once(ranked, starts),
        start,
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )


def repeat_words(w: Column) -> Column:
    """How many words stand in a window of three that the text holds twice or more.

    Windows are compared by a 64-bit hash of their words. Texts whose windows all
    differ, which most do, are done after one hash set.
    """
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    return once(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))


def measures(text: Column) -> Column:
    """All measures of a text in one struct."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: F.regexp_replace(line, SPACE, "") != "")

    def of(w: Column) -> Column:
        return once(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("bigint").alias("n_words"),
                F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
                F.size(ls).cast("bigint").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
                repeat_words(w).cast("bigint").alias("n_repeat_words"),
                F.regexp_count(t, F.lit("!")).cast("bigint").alias("n_exclaims"),
                F.regexp_count(t, F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
            ),
        )

    return once(words(text), of)


def _bits(m: Column) -> Column:
    """The failed rules of a struct of measures."""
    total = F.lit(0).cast("bigint")
    for name, rule in RULES.items():
        bound = rule
        for measure in MEASURES:
            bound = bound.replace(measure, f"_m.{measure}")
        total = total.bitwiseOR(F.when(F.expr(bound), F.lit(bit_of(name))).otherwise(F.lit(0)).cast("bigint"))
    return total


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the measures, and ``failed_bits``: one bit per failed rule."""
    measured = docs.select(F.col(key), measures(F.col(text)).alias("_m"))
    return measured.select(key, "_m.*", _bits(F.col("_m")).alias("failed_bits"))


def verdicts(entries: DataFrame, version: str) -> DataFrame:
    """Ledger rows with ``kept``: whether the policy's rules all hold."""
    return entries.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(mask_of(version))) == 0)


def ablation(entries: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it rejects, and rows kept without it.

    The ledger shrinks to one row per combination of bits before anything else.
    """
    mask = mask_of(version)
    combos = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit_of(r)).cast("bigint").alias("bit")) for r in POLICIES[version]])
    each = combos.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("bits_seen"),
    )


def keep_good(docs: DataFrame, version: str = "v2", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    judged = docs.select(F.struct("*").alias("row"), measures(F.col(text)).alias("_m"))
    return judged.where(_bits(F.col("_m")).bitwiseAND(F.lit(mask_of(version))) == 0).select("row.*")
