"""Phrase collocations from truncated suffix trees, built apart by groups of prefixes.

The suffixes of all word sequences, cut off behind ``LONGEST`` words, form a tree whose
nodes are the phrases of the corpus; a phrase occurs as often as the leaves below its
node say. The tree is never built whole. As in ERA's vertical partitioning it is split
by prefixes: a prefix under which more than ``BUDGET`` leaves lie is lengthened by a
word, and the prefixes that remain are dealt into groups of about that many leaves. Each
group is built by itself: its leaves arrive sorted, and the open path of the tree is
carried from batch to batch, so a task holds one batch and ``LONGEST`` nodes whatever
the group holds. Counts of lengthened prefixes are those of the split.

Only words and pairs of words that occur ``least`` times or more can stand in a phrase
that does, so all others end a suffix as a piece's end does. The ``HEAD`` most frequent
words are broadcast with their codes; where there are more, texts take the codes of their
other words from a join. Frequent pairs are broadcast as a table of ``BITS`` bits, whose
false positives lengthen a suffix and change no count. Equal leaves of a task are added
up before they are shuffled.

A phrase inside a longer one of equal count is inside one that is longer by one word and
has that count too, so only the two phrases a word shorter are looked up to drop it.

Defined cases: a null text has no words; a null language is ``und``; phrases never go
over pieces; repeated rows count as often as they stand there; documents without an id
count too; an empty table, and one without frequent phrases, give an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.staging import stage
from .common import bit_table, in_table, most_frequent
from .components import _drop

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
#: words that are broadcast with their codes
HEAD = 400_000
#: bits of the table of frequent pairs, as a power of two
BITS = 27
#: leaves a group
BUDGET = 500_000
#: words that a task holds before it adds up equal leaves (arrays of 2 MB, which sort fast), and distinct words before it hands counts on
_CHUNK = 1 << 18
_HELD = 300_000
#: what ends a piece becomes a line break, a tab a space
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_SPECIAL = (b"", b"\n")


def tokens(data: bytes) -> list[bytes]:
    """The words of UTF-8 bytes in order, line breaks between pieces, and empty strings that mean nothing."""
    return data.lower().translate(_ENDS).replace(b"\n", b" \n ").split(b" ")


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of ``docs`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, w.decode(), n) for lang, words in held.items() for w, n in words.items() if w not in _SPECIAL]
            held.clear()
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            types = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "word", "f"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[lang].update(tokens(text.as_buffer().to_pybytes()))
                if sum(map(len, held.values())) > _HELD:
                    yield out()
        yield out()

    return docs.select("lang", "text").mapInArrow(count, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def pairs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two words stand together, and what they are, as one number; codes below 0 are no words."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    return at, codes[at] << 32 | codes[at + 1]


def leaves(codes: np.ndarray, table: np.ndarray | None = None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes of two words or more with their counts; codes below 0 and pairs that are not in ``table`` end a suffix.

    A suffix is its first code, and two numbers that hold one more than its second
    and third, fourth and fifth code; 0 stands behind its end.
    """
    n = len(codes)
    at, pairs = pairs_of(codes)
    if table is not None:
        at = at[in_table(table, pairs)]
    joined = np.zeros(n + LONGEST, dtype=bool)
    joined[at] = True
    padded = np.concatenate([codes, np.full(LONGEST, -1, dtype=np.int64)])
    rest, open_ = [], np.ones(len(at), dtype=bool)
    for k in range(1, LONGEST):
        open_ = open_ & joined[at + k - 1] & (k < longest)
        rest.append(np.where(open_, padded[at + k] + 1, 0))
    w, a, b = padded[at], rest[0] << 32 | rest[1], rest[2] << 32 | rest[3]
    order = np.lexsort((b, a, w))
    w, a, b = w[order], a[order], b[order]
    starts = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(w) else np.zeros(0, dtype=np.int64)
    return w[starts], a[starts], b[starts], np.diff(np.append(starts, len(w)))


def _with_others(docs: DataFrame, words: DataFrame, head: DataFrame) -> DataFrame:
    """``docs`` with ``own``: the frequent words of its text that are not in the head, with their codes."""
    names = {lang: set(g) for lang, g in _by_lang(head.select("lang", "word", "code").toArrow()).items()}
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [w.decode() for w in set(tokens(text.as_buffer().to_pybytes())).difference(shared.value.get(lang, ()), _SPECIAL)]
                for lang, text in zip(b.column(1).to_pylist(), b.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], names=["text_id", "lang", "words"])

    named = docs.withColumn("text_id", F.sha2("text", 256))
    rest = words.join(head.select("code"), "code", "left_anti").select("lang", "word", "code")
    met = named.select("text_id", "lang", "text").mapInArrow(others, "text_id string, lang string, words array<string>")
    rows = met.select("text_id", "lang", F.explode("words").alias("word")).join(rest, ["lang", "word"]).distinct()
    own = rows.groupBy("lang", "text_id").agg(F.collect_list(F.struct("word", "code")).alias("own"))
    return named.join(stage(own, "phrase-others"), ["lang", "text_id"], "left").select("lang", "text", "own")


def _by_lang(table: pa.Table) -> dict[str, dict[bytes, int]]:
    out: dict[str, dict[bytes, int]] = defaultdict(dict)
    for lang, word, code in zip(*(c.to_pylist() for c in table.columns), strict=True):
        out[lang][word.encode()] = code
    return dict(out)


def coded(docs: DataFrame, words: DataFrame, head: int = HEAD) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]]:
    """A table to read, and what makes of its batches the codes of many texts at a time, -1 for what is no frequent word."""
    first = stage(most_frequent(words, "f", "word", head), "phrase-head")
    known = first.select("lang", "word", "code").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(known)
    docs = docs.withColumn("own", F.lit(None).cast("array<struct<word:string,code:bigint>>"))
    if known.num_rows < words.count():
        docs = _with_others(docs.drop("own"), words, first)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        codes = _by_lang(shared.value)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for lang, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = tokens(text.as_buffer().to_pybytes())
                here = codes.get(lang, {})
                if own.is_valid:
                    here = here | {x["word"].encode(): x["code"] for x in own.as_py()}
                got = np.fromiter(map(here.get, found, repeat(-1)), dtype=np.int64, count=len(found))
                if b"" in found:
                    got = got[np.fromiter(map(len, found), dtype=np.int64, count=len(found)) > 0]
                held += [got, np.array([-1])]
                size += len(got)
                if size >= _CHUNK:
                    yield np.concatenate(held)
                    held, size = [], 0
        if held:
            yield np.concatenate(held)

    return docs.select("lang", "text", "own"), read


def frequent_pairs(docs: DataFrame, read: Callable, least: int = LEAST, bits: int = BITS) -> np.ndarray:
    """The table of pairs that occur ``least`` times: a bit for each; it has the same size for any corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in read(batches):
            pairs, n = np.unique(pairs_of(codes)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    counted = docs.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return bit_table(counted.select("pair"), bits)


def suffixes(docs: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, head: int = HEAD, bits: int = BITS) -> DataFrame:
    """``w, a, b, n``: leaves as ``leaves`` gives them, equal ones of a chunk added up."""
    docs, read = coded(docs, words, head)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pairs(docs, read, least, bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in read(batches):
            found = leaves(codes, shared.value, longest)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["w", "a", "b", "n"])

    return docs.mapInArrow(cut, "w bigint, a bigint, b bigint, n bigint")


def _prefix(depth: int) -> list[Column]:
    """The columns that the first ``depth`` words of a leaf are."""
    a, b = (F.col("a"), F.col("b")) if depth >= 5 else (F.col("a"), F.shiftleft(F.shiftright("b", 32), 32))
    if depth < 3:
        a = F.shiftleft(F.shiftright("a", 32), 32)
    zero = F.lit(0).cast("bigint")
    return [F.col("w").alias("w"), (a if depth > 1 else zero).alias("a"), (b if depth > 3 else zero).alias("b")]


def _codes() -> Column:
    """The codes of a phrase, in order."""
    low = F.lit((1 << 32) - 1).cast("bigint")
    rest = [F.shiftright("a", 32), F.col("a").bitwiseAND(low), F.shiftright("b", 32), F.col("b").bitwiseAND(low)]
    return F.concat(F.array("w"), F.transform(F.filter(F.array(*rest), lambda x: x > 0), lambda x: x - 1))


def _marked(found: DataFrame, many: DataFrame, depth: int, how: str) -> DataFrame:
    """``found`` joined with the prefixes of ``depth`` words in ``many``; a left join adds ``_in``."""
    marks = many.select(F.col("w").alias("_w"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(1).alias("_in"))
    on = [c == F.col(n) for c, n in zip(_prefix(depth), ("_w", "_a", "_b"), strict=True)]
    return found.join(marks, on, how).drop("_w", "_a", "_b")


def split(found: DataFrame, budget: int = BUDGET, longest: int = LONGEST) -> list[DataFrame]:
    """The prefixes that are lengthened, by length: ``w, a, b, f`` of those with more than ``budget`` leaves."""
    out: list[DataFrame] = []
    for depth in range(1, longest):
        below = _marked(found, out[-1], depth - 1, "left_semi") if out else found
        # leaves that end before this word are no longer than the prefix above
        below = below.where(F.size(_codes()) >= depth)
        sums = below.groupBy(*_prefix(depth)).agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("f"))
        many = stage(sums.where(F.col("leaves") > budget).select("w", "a", "b", "f"), f"phrase-split-{depth}")
        if many.isEmpty():
            break
        out.append(many)
    return out


def phrases(found: DataFrame, least: int = LEAST, budget: int = BUDGET, longest: int = LONGEST) -> DataFrame:
    """``codes, f``: the phrases of two words or more that occur ``least`` times, from staged leaves."""
    long = split(found, budget, longest)
    dealt = found.withColumn("depth", F.lit(1))
    for depth, many in enumerate(long, 1):
        dealt = _marked(dealt, many, depth, "left").withColumn("depth", F.when(F.col("_in") == 1, depth + 1).otherwise(F.col("depth"))).drop("_in")
    by_depth = [F.when(F.col("depth") == d, F.xxhash64(*_prefix(d), F.lit(d))) for d in range(1, len(long) + 2)]
    groups = max(1, -(-found.count() // budget))
    sorted_ = dealt.repartition(groups, F.coalesce(*by_depth)).sortWithinPartitions("w", "a", "b").select("w", "a", "b", "n", "depth")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: dict[int, tuple[tuple[int, int, int], int]] = {}

        def out(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, dtype=np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w", "a", "b", "f"])

        for batch in batches:
            w, a, b, n, depth = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(w):
                continue
            words = [w + 1, a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF]
            made = []
            for level in range(2, longest + 1):
                at = np.flatnonzero((words[level - 1] > 0) & (depth <= level))
                if not len(at):
                    continue
                x, y, z = w[at], (a[at] >> 32 << 32 if level < 3 else a[at]), (b[at] * 0 if level < 4 else b[at] >> 32 << 32 if level < 5 else b[at])
                starts = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]))
                sums = np.add.reduceat(n[at], starts)
                x, y, z = x[starts], y[starts], z[starts]
                if level in path:
                    name, f = path[level]
                    if name == (x[0], y[0], z[0]):
                        sums[0] += f
                    elif f >= least:
                        made.append(tuple(np.array([v]) for v in (*name, f)))
                path[level] = (int(x[-1]), int(y[-1]), int(z[-1])), int(sums[-1])
                keep = np.flatnonzero(sums[:-1] >= least)
                made.append((x[keep], y[keep], z[keep], sums[keep]))
            yield out(made)
        yield out([tuple(np.array([v]) for v in (*name, f)) for name, f in path.values() if f >= least])

    counted = sorted_.mapInArrow(grow, "w bigint, a bigint, b bigint, f bigint")
    for many in long[1:]:
        counted = counted.union(many.where(F.col("f") >= least))
    return counted.select(_codes().alias("codes"), "f").where(F.size("codes") > 1)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, head: int = HEAD, budget: int = BUDGET, bits: int = BITS
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases."""
    narrow = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text")
    )
    counts = stage(word_counts(narrow), "phrase-words")
    totals = stage(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words = stage(numbered(counts.where(F.col("f") >= least), "code", "phrase-codes"), "phrase-coded")
    found = stage(suffixes(narrow, words, least, LONGEST, head, bits), "phrase-leaves")
    counted = stage(phrases(found, least, budget), "phrase-counts")
    _drop(found)

    size = F.size("codes")
    every = counted.union(words.select(F.array("code").alias("codes"), "f"))
    shorter = F.array(F.slice("codes", F.lit(1), size - 1), F.slice("codes", F.lit(2), size - 1))
    longer = counted.where(size > 2).select(F.explode(shorter).alias("codes"), "f").groupBy("codes").agg(F.max("f").alias("longer"))
    kept = counted.join(longer, "codes", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("f"))).select("codes", F.col("f").alias("a"))
    tail = F.slice("codes", F.col("k") + 1, size - F.col("k"))
    cuts = kept.select("codes", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select("codes", "a", "k", F.slice("codes", F.lit(1), F.col("k")).alias("first"), tail.alias("rest"))
    scored = (
        cuts.join(every.toDF("first", "l"), "first")
        .join(every.toDF("rest", "r"), "rest")
        .join(words.select("lang", "code"), F.get("codes", F.lit(0)) == F.col("code"))
        .join(totals, "lang")
        .withColumn("score", F.expr("1000 * cast(a as decimal(16,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))").cast("bigint"))
        .groupBy("lang", "codes", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "codes", "a", "n", "cut.score", "cut.l", "cut.r")
    )
    scored = stage(scored, "phrase-scores")
    spelled = scored.select("codes", F.posexplode("codes").alias("at", "code")).join(words.select("code", "word"), "code").groupBy("codes")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.join(spelled, "codes").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
