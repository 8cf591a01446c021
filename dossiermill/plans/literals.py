"""Replacing tens of thousands of literals in one pass over every text.

A fold of ``replace`` reads each text once per literal. Here all occurrences come from
one automaton per worker while the dictionary is small enough to be broadcast, and from
an equi-join of first grams beyond that, so its size has no bound. Which of overlapping
occurrences count is a rule of its own:

* ``longest``: from the left, the longest at each place;
* ``listed``: those of an earlier literal (by ``ord``) before those of a later one. This is
  what the fold gives, as long as no replacement takes part in a new occurrence.

Defined cases: null and empty literals, and markers, are no literals; of equal literals the
first listed counts; a null text stays null and an empty one empty, both with no hit; an
empty dictionary changes nothing; repeated rows are judged one by one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .staging import stage

#: characters of a dictionary that is broadcast: about 60 bytes each in a worker's automaton
MOST_CHARACTERS = 2_000_000
#: characters by which literals and places in texts meet beyond that
GRAM = 8
#: bytes of the texts that a worker is handed at once: texts of 10,000 rows, Spark's own bound, grow with their length
BATCH_BYTES = 8 << 20
#: characters of texts that are replaced before their results are handed on
RESULT_CHARACTERS = 1 << 20
RULES = ("longest", "listed")


def chosen(found: Iterable[tuple[int, int, int]], rule: str) -> list[tuple[int, int, int]]:
    """Of occurrences (start, end, literal's number) those that count, from left to right."""
    out: list[tuple[int, int, int]] = []
    if rule == "longest":
        at = 0
        for start, end, k in sorted(found, key=lambda o: (o[0], -o[1])):
            if start >= at:
                out.append((start, end, k))
                at = end
        return out
    for start, end, k in sorted(found, key=lambda o: (o[2], o[0])):
        i = bisect.bisect_left(out, (start,))
        if (i == 0 or out[i - 1][1] <= start) and (i == len(out) or end <= out[i][0]):
            out.insert(i, (start, end, k))
    return out


def replaced(text: str, hits: list[tuple[int, int, str]]) -> str:
    """``text`` with what stands in each (start, end) replaced."""
    parts, at = [], 0
    for start, end, new in hits:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def dictionary(literals: DataFrame, marker: str | None = None) -> DataFrame:
    """``literal, replacement, ord`` with one row per literal that can be replaced."""
    rows = literals.where("literal is not null and literal <> ''")
    if marker is not None:
        rows = rows.where(~F.col("literal").rlike("^(?:" + marker + r")\z"))
    first = F.min_by(F.struct("replacement", "ord"), F.struct("ord", "replacement")).alias("_first")
    return rows.groupBy("literal").agg(first).select("literal", F.coalesce("_first.replacement", F.lit("")).alias("replacement"), "_first.ord")


def replace_all(
    df: DataFrame, text: str, literals: DataFrame, rule: str = "longest", marker: str | None = None, most_characters: int = MOST_CHARACTERS
) -> DataFrame:
    """``df`` with ``text`` redacted, and ``n_replaced``: how many occurrences were."""
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    used = stage(dictionary(literals, marker), "literals")
    size = used.agg(F.coalesce(F.sum(F.length("literal")), F.lit(0)).alias("n")).first()["n"]
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    way = _by_automaton if size <= most_characters else _by_grams
    return way(df, text, used, rule)


def _by_automaton(df: DataFrame, text: str, used: DataFrame, rule: str) -> DataFrame:
    rows = [(r["literal"], r["replacement"]) for r in sorted(used.collect(), key=lambda r: (r["ord"] is None, r["ord"], r["literal"]))]
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def automaton():
        """Of all literals; made once per task."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, (literal, _) in enumerate(shared.value):
            made.add_word(literal, (len(literal), k))
        if shared.value:
            made.make_automaton()
        return made

    @F.pandas_udf("text string, n bigint")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = automaton()
        for texts in batches:
            out: list[tuple[str | None, int]] = []
            size = 0
            for t in texts:
                if not t or not shared.value:
                    out.append((t, 0))
                    continue
                hits = chosen(((end + 1 - n, end + 1, k) for end, (n, k) in made.iter(t)), rule)
                out.append((replaced(t, [(a, b, shared.value[k][1]) for a, b, k in hits]), len(hits)))
                size += len(t)
                if size >= RESULT_CHARACTERS:
                    yield pd.DataFrame(out, columns=["text", "n"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["text", "n"])

    return df.withColumn("_redacted", redact(text)).withColumn(text, F.col("_redacted.text")).withColumn("n_replaced", F.col("_redacted.n")).drop("_redacted")


def _by_grams(df: DataFrame, text: str, used: DataFrame, rule: str) -> DataFrame:
    """Places and literals meet by first grams; what stands at a place is compared with the text itself.

    A row per character of the texts and length of grams carries the gram alone; only
    places that meet a literal come back to their text.
    """
    rows = numbered(df, "_row", "texts")
    literal = used.withColumn("gram", F.substring("literal", 1, GRAM))
    lengths = [r["n"] for r in literal.select(F.length("gram").alias("n")).distinct().collect()]
    places = rows.select("_row", text, F.explode(F.sequence(F.lit(1), F.length(text))).alias("at")).where(F.length(text) > 0)
    each = F.array(*[F.substr(F.col(text), F.col("at"), F.lit(n)) for n in sorted(lengths)])
    grams = places.select("_row", "at", F.explode(F.array_distinct(each)).alias("gram"))
    met = grams.join(literal, "gram").groupBy("_row").agg(F.collect_list(F.struct("at", "literal", "replacement", "ord")).alias("_met"))

    @F.pandas_udf("text string, n bigint")
    def redact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, mets in batches:
            out: list[tuple[str | None, int]] = []
            for t, met in zip(texts, mets, strict=True):
                if not t or met is None or not len(met):
                    out.append((t, 0))
                    continue
                real = [m for m in met if t.startswith(m["literal"], m["at"] - 1)]
                new = {m["literal"]: (m["ord"], m["replacement"]) for m in real}
                order = sorted(new, key=lambda w: (new[w][0] is None, new[w][0], w))
                number = {w: k for k, w in enumerate(order)}
                hits = chosen([(m["at"] - 1, m["at"] - 1 + len(m["literal"]), number[m["literal"]]) for m in real], rule)
                out.append((replaced(t, [(a, b, new[order[k]][1]) for a, b, k in hits]), len(hits)))
            yield pd.DataFrame(out, columns=["text", "n"])

    return (
        rows.join(met, "_row", "left").withColumn("_redacted", redact(text, "_met"))
        .withColumn(text, F.col("_redacted.text")).withColumn("n_replaced", F.col("_redacted.n")).select(*df.columns, "n_replaced")
    )
