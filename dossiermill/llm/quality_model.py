"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of every document are worked out once, from its whole text, and
written as one narrow table. A bounded sample of labelled rows (``TRAIN_ROWS``, by
hash order) fits the trees: statistics are binned by quantiles, and each split is
found on histograms of gradients. All trees have the same depth and lie flattened in
arrays, so that scoring a batch is ``depth`` vectorised steps per tree.

Defined cases: a null text is an empty one, and an empty text has statistics of 0
and a score like any other; labels that are null teach nothing, repeated ones count
as often as they occur; without any label scores are 0.5, with one class only they
are that class; rows are scored one by one, so repeated rows and null ids give a row
each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, RIDGE, LEAST = 0.2, 1.0, 5.0

STATISTICS = (
    "log_words", "word_length", "long_words", "capitals", "lower", "digits", "symbols", "exclaims", "stops",
    "punctuation", "beyond_ascii", "lines_per_word", "repeated_lines", "distinct_words", "repeated_pairs", "top_word", "packed",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_PUNCTUATION = np.frombuffer(b",;:'\"()-", dtype=np.uint8)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text."""
    data = text.encode()
    if not data:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    n, size = max(1, len(words)), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    packed = zlib.compressobj(1)
    packed_size = len(packed.compress(data)) + len(packed.flush())
    return [
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        sum(len(w) > 14 for w in counts) / max(1, len(counts)),
        int(seen[65:91].sum()) / size,
        int(seen[97:123].sum()) / size,
        int(seen[48:58].sum()) / size,
        int(seen[_SYMBOLS].sum()) / n,
        int(seen[33]) / n,
        int(seen[46]) / n,
        int(seen[_PUNCTUATION].sum()) / n,
        int(seen[128:].sum()) / size,
        int(seen[10]) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(counts) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        max(counts.values(), default=0) / n,
        packed_size / size,
    ]


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """``doc_id``, the carried columns, and ``x``: the statistics as an array."""
    narrow = docs.select(F.col(key).alias("doc_id"), *carry, F.col(text).alias("text"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("x", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py() or "") for t in b.columns[-1]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float32()))], names=schema.names)

    return narrow.mapInArrow(run, schema)


@dataclass
class Trees:
    """Flattened trees: node i of a tree has its children at 2 i + 1 and 2 i + 2; leaves stand behind the last level."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int = DEPTH

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boost ``trees`` trees on the logistic loss; splits come from gradient histograms."""
    empty = Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 1)), depth)
    if not len(y):
        return empty
    rate = (y.sum() + 1e-9) / (len(y) + 2e-9)
    empty.base = float(np.log(rate / (1 - rate))) if 0 < y.sum() < len(y) else (40.0 if y.sum() else -40.0)
    if not 0 < y.sum() < len(y):
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = (np.zeros((trees, k)) for k in (inner, inner, leaves))
    features = features.astype(np.int64)
    total = np.full(len(y), empty.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-9)
            split_f, split_b = np.zeros(wide, dtype=np.int64), np.full(wide, bins)
            for f in range(x.shape[1]):
                place = (node - first) * bins + binned[:, f]
                g = np.bincount(place, grad, wide * bins).reshape(wide, bins).cumsum(axis=1)
                h = np.bincount(place, hess, wide * bins).reshape(wide, bins).cumsum(axis=1)
                n = np.bincount(place, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                whole_g, whole_h, whole_n = g[:, -1:], h[:, -1:], n[:, -1:]
                gain = g**2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
                gain[(n < LEAST) | (whole_n - n < LEAST)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better] = gain[np.arange(wide), top][better]
                split_f[better], split_b[better] = f, top[better]
            for k in range(wide):
                features[t, first + k] = split_f[k]
                thresholds[t, first + k] = edges[split_f[k]][split_b[k]] if split_b[k] < bins else np.inf
            at = node - first
            node = 2 * node + 1 + (binned[np.arange(len(y)), split_f[at]] > split_b[at])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        values[t] = RATE * g / (h + RIDGE)
        total += values[t][leaf]
    return Trees(empty.base, features, thresholds, values, depth)


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from a sample, about ``rows`` by the hash of their ids, of the labelled rows of ``stats``."""
    marked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull())
    sample = stage(stats.join(marked, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h")), "labelled")
    share = int((1 << 30) * rows / max(rows, sample.count()))
    got = sample.where(F.col("h") < share).select("x", "y").toArrow()
    x = np.array(got.column(0).to_pylist(), dtype=np.float32).reshape(-1, len(STATISTICS))
    return fit(x.astype(np.float64), np.array(got.column(1).to_pylist(), dtype=np.float64))


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """The columns of ``stats`` but ``x``, with ``score``."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)
    kept = [f for f in stats.schema.fields if f.name != "x"]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(shared.value.scores(x))], names=schema.names)

    return stats.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` of every document; rows that are held out teach nothing."""
    stats = stage(document_statistics(docs, key, text, (held_out.alias("held_out"),)), "statistics")
    trees = train(stats.where(~F.col("held_out")), labels, key, label)
    return score(stats, trees)
