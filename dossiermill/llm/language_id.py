"""Language identification, words first, then ever shorter character n-grams.

The counts come from all labelled texts: words per language, and the n-grams of
those words weighted by the words' counts. The model keeps the most frequent words
and n-grams of every language, ``WORDS`` and ``GRAMS`` of them in all (fewer with very
many languages), which bounds what is broadcast. Each language has an equal part of
them, and what one does not need goes to the others, so a small language keeps its words
however large the others grow; texts are scored word by word. A known word adds its log frequency in each language. An
unseen word falls back to those of its longest n-grams that are known, from
``ORDER`` letters down to one. Each vector is centred, so that only what sets the
languages apart adds up, and the score is the softmax of the sums.

Defined cases: a null text, and one without a letter, is ``und`` with score 0, as is
every text where nothing was labelled; of equal languages the more frequent one wins,
then the first by code point; rows are judged one by one, so repeated rows and null
ids give a row each; an empty table gives an empty result; null texts and null
languages teach nothing; other columns are not looked at and not returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

WORDS = 240_000
GRAMS = 60_000
#: and no more items than this by the number of languages
CELLS = 20_000_000
ORDER = 5
LONGEST = 32
#: what ``keep_known`` asks of a text: the share of its words that are known from others, for new words by n-grams of
#: ``LONG`` letters, and the mean margin a word of its language over the second, in nats
LONG = 4
LEAST_SHARE = 0.5
LEAST_MARGIN = 0.05
UNKNOWN = "und"
_RUN = re.compile(r"[^\W\d_]+")
_HELD = 200_000
_CHUNK = 1 << 20


def runs(text: str) -> list[str]:
    """Lower-cased runs of word characters; ``letters`` makes words of the odd ones."""
    return _RUN.findall(text.lower())


def letters(run: str) -> list[str]:
    """The words of a run: its letters only, and no more than ``LONGEST`` at once."""
    word = run if run.isalpha() else "".join(c for c in run if c.isalpha())
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def grams(word: str, order: int) -> list[str]:
    marked = f"_{word}_" if order > 1 else word
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    grams: dict[str, int]
    vectors: np.ndarray
    #: how often each item was counted, over all languages
    totals: np.ndarray | None = None

    def back_off(self, words: list[str]) -> np.ndarray:
        """A vector per unseen word: the mean over the longest of its n-grams that are known, zero without any."""
        flat, starts, counts = [], [], []
        for word in words:
            starts.append(len(flat))
            for order in range(ORDER, 0, -1):
                rows = [i for g in grams(word, order) if (i := self.grams.get(g)) is not None]
                if rows:
                    break
            counts.append(len(rows))
            flat.extend(rows or [0])
        if not flat:
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        n = np.array(counts, dtype=np.float32)[:, None]
        return np.add.reduceat(self.vectors[flat], starts, axis=0) / np.maximum(n, 1) * (n > 0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        return [self.verdict(total) for total, _ in self.sums(texts)]

    def verdict(self, total: np.ndarray | None) -> tuple[str, float]:
        if total is None:
            return UNKNOWN, 0.0
        odds = np.exp(total - total.max())
        return self.langs[int(np.argmax(total + 1e-9 * self.prior))], float(odds.max() / odds.sum())

    def familiar(self, text: str, taught: bool) -> float:
        """The share of a text's words that other texts make known, be it by half of their longer n-grams.

        What a labelled text has itself ``taught`` does not count for it.
        """
        counts = Counter(w for run in runs(text) for w in letters(run))
        own = counts if taught else Counter()
        odd = [w for w in counts if (i := self.words.get(w)) is None or self.totals[i] <= own[w]]
        # n-grams of words that others know are known from there too
        parts: Counter = Counter()
        for w in odd if taught else ():
            for g in grams(w, LONG):
                parts[g] += counts[w]
        strange = 0
        for w in odd:
            each = grams(w, LONG)
            met = sum((i := self.grams.get(g)) is not None and self.totals[i] > parts[g] for g in each)
            strange += 0 if each and 2 * met >= len(each) else counts[w]
        return 1 - strange / max(1, counts.total())

    def recognised(self, texts: list[str | None], taught: list[bool], least: float, share: float, margin: float) -> list[bool]:
        """Whether each text is in a learned language, by figures that do not grow with its length, and by its score."""
        out = []
        for text, own, (total, n) in zip(texts, taught, self.sums(texts), strict=True):
            sure = total is not None and self.verdict(total)[1] >= least
            if sure and len(total) > 1:
                second, first = np.partition(total, -2)[-2:]
                sure = first - second >= margin * n
            out.append(bool(sure and self.familiar(text, own) >= share))
        return out

    def sums(self, texts: list[str | None]) -> list[tuple[np.ndarray | None, int]]:
        """The summed vectors of each text and its number of words; none without a letter or a language."""
        found = [runs(t) if t else [] for t in texts]
        ids = [list(map(self.words.get, f)) for f in found]
        odd: dict[str, list[str]] = {}
        for f, i in zip(found, ids, strict=True):
            if None in i:
                odd.update((w, []) for w, k in zip(f, i, strict=True) if k is None)
        for run in odd:
            odd[run] = letters(run)
        unseen = {w: None for parts in odd.values() for w in parts if w not in self.words}
        base = len(self.vectors)
        place = {w: base + k for k, w in enumerate(unseen)}
        vectors = np.concatenate([self.vectors, self.back_off(list(unseen))]) if unseen else self.vectors
        rows = {run: [place[w] if w in place else self.words[w] for w in parts] for run, parts in odd.items()}
        out = []
        for f, i in zip(found, ids, strict=True):
            if None in i:
                i = [k for w, known in zip(f, i, strict=True) for k in ((known,) if known is not None else rows[w])]
            if not i or not self.langs:
                out.append((None, 0))
                continue
            out.append((vectors[i].sum(axis=0, dtype=np.float64), len(i)))
        return out


def predictions(model: Model, texts: pa.Array) -> list[tuple[str, float]]:
    """Of a column of texts, about ``_CHUNK`` characters at a time."""
    out: list[tuple[str, float]] = []
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= _CHUNK:
            out += model.predict(held)
            held, size = [], 0
    return out + model.predict(held)


def _counted(batches: Iterator[pa.RecordBatch], each: Callable[[dict[str, Counter], pa.RecordBatch, int], None]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, item, n) of what ``each`` adds to a language's Counter; handed on when they have grown."""
    held: dict[str, Counter] = defaultdict(Counter)

    def out() -> pa.RecordBatch:
        rows = [(lang, item, n) for lang, counts in held.items() for item, n in counts.items()]
        held.clear()
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "item", "n"])

    for b in batches:
        for row in range(b.num_rows):
            each(held, b, row)
            if row % 64 == 0 and sum(map(len, held.values())) > _HELD:
                yield out()
    yield out()


_COUNTS = "lang string, item string, n bigint"


def word_counts(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, item, n``: every word of the labelled texts."""

    def add(held: dict[str, Counter], b: pa.RecordBatch, row: int) -> None:
        held[b.column(0)[row].as_py()].update(runs(b.column(1)[row].as_py()))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (lang, word, n)
                for lang, run, n in zip(*(c.to_pylist() for c in b.columns), strict=True)
                for word in ((run,) if len(run) <= LONGEST and run.isalpha() else letters(run))
            ]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "item", "n"])

    rows = labelled.select(F.col(lang).cast("string"), F.col(text)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(lambda batches: tidy(_counted(batches, add)), _COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """``lang, item, n``: n-grams of counted words."""

    def add(held: dict[str, Counter], b: pa.RecordBatch, row: int) -> None:
        language, word, n = (c[row].as_py() for c in b.columns)
        counts = held[language]
        for order in range(1, ORDER + 1):
            for g in grams(word, order):
                counts[g] = counts.get(g, 0) + n

    return words.mapInArrow(lambda batches: _counted(batches, add), _COUNTS).groupBy("lang", "item").agg(F.sum("n").alias("n"))


def quotas(sizes: list[int], most: int) -> list[int]:
    """Equal parts of ``most``; what a language has no items for goes to the others."""
    out, left = [0] * len(sizes), most
    for done, k in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[k] = min(sizes[k], left // (len(sizes) - done))
        left -= out[k]
    return out


def heads(items: DataFrame, langs: int, most: int) -> Column:
    """A condition on ``items`` (item, by: counts by language): among the most frequent of some language, about ``most`` in all.

    Counts are taken in classes of 1/16 of a binary order, a few hundred a language;
    of the class in which a language's part ends, items are taken by their hash.
    """
    level = F.floor(F.log2(F.col("n")) * 16).cast("int")
    rows = items.select(F.posexplode("by").alias("at", "n")).where("n > 0").groupBy("at", level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    classes: list[dict[int, int]] = [{} for _ in range(langs)]
    for r in rows:
        classes[r["at"]][r["level"]] = r["n"]
    chosen = F.lit(False)
    for k, part in enumerate(quotas([sum(c.values()) for c in classes], most)):
        here = F.get("by", F.lit(k))
        mine = F.floor(F.log2(F.when(here > 0, here)) * 16)
        edge = None
        for at in sorted(classes[k], reverse=True):
            if classes[k][at] > part:
                share = F.pmod(F.xxhash64("item"), F.lit(1 << 30)) < int((1 << 30) * part / classes[k][at])
                edge = (mine > at) | ((mine == at) & share)
                break
            part -= classes[k][at]
        chosen = chosen | F.coalesce(here > 0 if edge is None else edge, F.lit(False))
    return chosen


def _top(counts: DataFrame, langs: list[str], most: int, name: str) -> tuple[list[str], np.ndarray]:
    """The items that the model keeps, and their counts by language."""
    each = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)) for k in langs]
    items = stage(counts.groupBy("item").agg(F.array(*each).alias("by")), name)
    top = items.where(heads(items, len(langs), min(most, CELLS // len(langs)))).select("item", "by").toArrow()
    by = top.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
    return top.column(0).to_pylist(), by.astype(np.float64)


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", most_words: int = WORDS, most_grams: int = GRAMS) -> Model:
    """A model from all labelled rows; only the kept words and n-grams reach the driver."""
    words = stage(word_counts(labelled, lang, text), "language-words")
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sums)
    if not langs:
        return Model([], np.zeros(0), {}, {}, np.zeros((0, 0), dtype=np.float32), np.zeros(0))
    size = np.array([sums[k] for k in langs], dtype=np.float64)
    vectors: list[np.ndarray] = []
    kept: list[dict[str, int]] = []
    totals: list[np.ndarray] = []
    for counts, most, name in ((words, most_words, "language-items"), (gram_counts(words), most_grams, "language-grams")):
        items, by = _top(counts, langs, most, name)
        logs = np.log((by + 0.5) / (size + 0.5 * max(1, len(items))))
        base = sum(map(len, vectors))
        vectors.append((logs - logs.mean(axis=1, keepdims=True)).astype(np.float32))
        totals.append(by.sum(axis=1))
        kept.append({item: base + i for i, item in enumerate(items)})
    return Model(langs, np.log(size / size.sum()), kept[0], kept[1], np.concatenate(vectors), np.concatenate(totals))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, the carried columns, ``lang_pred``, ``score``; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(key).alias("doc_id"), *carry, F.col(text).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = predictions(shared.value, b.columns[-1])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=schema.names,
            )

    return narrow.mapInArrow(run, schema)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: what folds are made by."""
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % modulus


def keep_known(
    docs: DataFrame, least: float = 0.5, lang: str = "lang", text: str = "text", share: float = LEAST_SHARE, margin: float = LEAST_MARGIN
) -> DataFrame:
    """The documents in a language that labels teach, with all their columns.

    The score runs to 1 for any long text, so a text must also be ``familiar`` by
    ``share`` and have its language ahead of the second by ``margin`` a word.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, lang, text))
    at, by = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep: list[bool] = []
            held: list[str | None] = []
            size = 0
            taught = b.column(by).is_valid().to_pylist()
            for t in b.column(at):
                held.append(t.as_py())
                size += len(held[-1] or "")
                if size >= _CHUNK:
                    keep += model.value.recognised(held, taught[len(keep) : len(keep) + len(held)], least, share, margin)
                    held, size = [], 0
            keep += model.value.recognised(held, taught[len(keep) :], least, share, margin)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
