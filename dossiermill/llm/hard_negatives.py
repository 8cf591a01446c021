"""Hard-negative mining with packed R-trees over integer vectors.

Rows are dealt into shards of about ``SHARD`` rows that lie together: by label first, a
small label together with others, then by quantiles of the coordinates that vary most,
and what still holds too many rows, such as copies of one vector, by hash. In a task a
shard is packed into a tree by sort-tile-recursion: the label is the first coordinate
and bounding boxes hold the least and the greatest value of every coordinate. The inner
product of an anchor with any row of a box lies in the interval that the box's sides
give coordinate by coordinate, so a query leaves out boxes whose interval misses its
score window, whose labels cannot serve it, or whose upper end is strictly below the
last score that it has in hand; equal ends stay, for ties go by id. Boxes are taken best
first: every query draws its best open boxes, one, then two, then four at a time, and
drops the rest of its queue as its last score rises. Queries of a block are worked in
one go, a matrix product per box.

Anchors meet shards in blocks of ``BLOCK`` queries, first for the nearest rows of the
same label, then, with each positive's score window, for the others. Every shard hands
on no more than a query's answers, which are merged by query.

Scores are exact: products are taken in doubles while they stay below 2^53 and in 64-bit
integers otherwise. A score that could pass 63 bits is refused with an error.

Defined cases: rows with a null label, a null vector, or a null or non-finite component
take no part; a vector shorter than the longest is continued by zeros; a null id is no
anchor and, as another's answer, comes behind all ids at equal scores; repeated rows are
rows of their own, and repeated anchors answer each for themselves; ties go to the
smaller id; anchors without positives and pairs without negatives give no row; an empty
table gives an empty result; other columns are not looked at and not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.staging import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: rows of a shard, of a leaf, boxes of an inner box, and queries of a block
SHARD = 4096
LEAF = 64
FAN = 8
BLOCK = 2048
#: quantiles that a shard's borders are taken from, a coordinate
CUTS = 32
_LAST = np.iinfo(np.int64).max
_OPEN = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """``id, label, v``: the rows that take part, each component x as floor(scale * x)."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & sound).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


@dataclass
class Level:
    low: np.ndarray
    high: np.ndarray
    #: rows of the level below, or of the shard, that a box holds
    start: np.ndarray
    stop: np.ndarray
    labels: np.ndarray


def _tiles(order: np.ndarray, keys: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursion: slabs by the first key, each cut by the next ones, down to ``leaf`` rows."""
    if len(order) <= leaf:
        return [order]
    order = order[np.argsort(keys[0][order], kind="stable")]
    if len(keys) == 1:
        return [order[i : i + leaf] for i in range(0, len(order), leaf)]
    pages = -(-len(order) // leaf)
    slabs = max(1, round(pages ** (1 / len(keys))))
    size = -(-pages // slabs) * leaf
    return [t for i in range(0, len(order), size) for t in _tiles(order[i : i + size], keys[1:], leaf)]


class Tree:
    """An R-tree over the rows (ids, labels, vectors) of a shard."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> None:
        spread = np.argsort(-vectors.astype(np.float64).var(axis=0), kind="stable")[:3] if len(vectors) else []
        tiles = []
        # the label is the first coordinate: a leaf has one label wherever a label fills a leaf
        for at in np.split(o := np.argsort(labels, kind="stable"), np.flatnonzero(np.diff(labels[o])) + 1):
            tiles += _tiles(at, [vectors[:, k] for k in spread], leaf) if len(at) and len(spread) else [at]
        small = [t for t in tiles if len(t) < leaf // 2]
        tiles = [t for t in tiles if len(t) >= leaf // 2]
        held: list[np.ndarray] = []
        for t in small:
            if held and sum(map(len, held)) + len(t) > leaf:
                tiles.append(np.concatenate(held))
                held = []
            held.append(t)
        tiles += [np.concatenate(held)] if held else []
        # within a leaf rows stand by id, so that equal scores come in the order of ties
        order = np.concatenate([t[np.lexsort((row[t], ids[t]))] for t in tiles]) if tiles else np.zeros(0, dtype=np.int64)
        self.order = order
        self.row, self.ids, self.labels, self.vectors = row[order], ids[order], labels[order], vectors[order]
        stop = np.cumsum([len(t) for t in tiles], dtype=np.int64)
        start = np.concatenate([[0], stop[:-1]]).astype(np.int64) if len(tiles) else stop
        low, high = (f.reduceat(self.vectors, start, axis=0) if len(tiles) else self.vectors for f in (np.minimum, np.maximum))
        ends = np.stack([f.reduceat(self.labels, start) if len(tiles) else self.labels for f in (np.minimum, np.maximum)])
        self.levels = [Level(low, high, start, stop, ends)]
        while len(start) > fan:
            start = np.arange(0, len(low), fan)
            stop = np.minimum(start + fan, len(low))
            low, high = np.minimum.reduceat(low, start, axis=0), np.maximum.reduceat(high, start, axis=0)
            ends = np.stack([np.minimum.reduceat(ends[0], start), np.maximum.reduceat(ends[1], start)])
            self.levels.append(Level(low, high, start, stop, ends))


@dataclass
class Queries:
    """Vectors with a label, a window of scores, and the row that is not to be found; ``same``: rows of the label, else of others."""

    vectors: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same: bool
    count: int


def intervals(vectors: np.ndarray, level: Level, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every vector with what a box may hold."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    low, high = level.low[boxes].T, level.high[boxes].T
    return up @ low + down @ high, up @ high + down @ low


def search(tree: Tree, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, place in the tree and score of each query's best ``count`` rows, in order."""
    n = len(q.vectors)
    best = np.zeros((3, 0), dtype=np.int64)  # query, place, score
    if not n or not len(tree.ids):
        return best[0], best[1], best[2]
    kth = q.least.copy()

    def usable(level: Level, boxes: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``boxes`` each query may need, and the upper ends."""
        low, high = intervals(q.vectors[who], level, boxes)
        first, last = (x[boxes] for x in level.labels)
        mine = q.labels[who][:, None]
        fits = (first <= mine) & (mine <= last) if q.same else (first != mine) | (last != mine)
        return fits & (low <= q.most[who][:, None]) & (high >= kth[who][:, None]), high

    # down the inner levels: a box is opened for the queries that need it
    open_ = np.ones((n, len(tree.levels[-1].start)), dtype=bool)
    for depth in range(len(tree.levels) - 1, 0, -1):
        level = tree.levels[depth]
        below = np.zeros((n, len(tree.levels[depth - 1].start)), dtype=bool)
        needed, _ = usable(level, np.arange(len(level.start)), np.arange(n))
        for box in np.flatnonzero((open_ & needed).any(axis=0)):
            below[np.flatnonzero(open_[:, box] & needed[:, box]), level.start[box] : level.stop[box]] = True
        open_ = below
    leaves = tree.levels[0]
    needed, upper = usable(leaves, np.arange(len(leaves.start)), np.arange(n))
    queue = open_ & needed
    order = np.argsort(np.where(queue, -upper, _LAST), axis=1, kind="stable")
    left, at, draw = queue.sum(axis=1), np.zeros(n, dtype=np.int64), 1
    while True:
        # the queue is in order of the upper ends, so all behind the first one below the last score go with it
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(draw):
            who = np.flatnonzero(at + step < left)
            box = order[who, at[who] + step]
            keep = upper[who, box] >= kth[who]
            taken.append((who[keep], box[keep]))
        at += draw
        who, box = (np.concatenate(x) for x in zip(*taken, strict=True))
        if not len(who):
            break
        found = [best]
        for b in np.unique(box):
            mine = who[box == b]
            rows = slice(leaves.start[b], leaves.stop[b])
            scores = (q.vectors[mine] @ tree.vectors[rows].T).astype(np.int64)  # doubles hold whole numbers here
            same = tree.labels[rows][None, :] == q.labels[mine][:, None]
            fits = (same if q.same else ~same) & (scores >= kth[mine][:, None]) & (scores <= q.most[mine][:, None])
            fits &= tree.row[rows][None, :] != q.row[mine][:, None]
            i, j = np.nonzero(fits)
            found.append(np.stack([mine[i], j + leaves.start[b], scores[i, j]]))
        best = np.concatenate(found, axis=1)
        best = best[:, np.lexsort((tree.row[best[1]], tree.ids[best[1]], -best[2], best[0]))]
        starts = np.searchsorted(best[0], best[0], side="left")
        place = np.arange(best.shape[1]) - starts
        best = best[:, place < q.count]
        full = np.flatnonzero(place[place < q.count] == q.count - 1)
        kth[best[0, full]] = np.maximum(kth[best[0, full]], best[2, full])
        draw *= 2
    return best[0], best[1], best[2]


def _matrix(column: pa.ListArray, dims: int, exact: type) -> np.ndarray:
    """Lists of numbers as rows of ``dims``, short ones continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(-1, dims).astype(exact)
    out = np.zeros((len(sizes), dims), dtype=exact)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by ``cell``, a cell at a time; a cell may go on in the next batch and waits for it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        cell = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for at, to in zip(edges, edges[1:], strict=False):
            if held and at < to and held[0].column(0)[0].as_py() != cell[at]:
                yield pa.Table.from_batches(held)
                held = []
            if at < to:
                held.append(b.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


_FOUND = "query bigint, positive_score bigint, id bigint, row bigint, score bigint"


def _met(index: DataFrame, queries: DataFrame, blocks: int, dims: int, exact: type, same: bool, count: int) -> DataFrame:
    """The best ``count`` rows a query and shard. ``queries``: query, row, label, v, least, most, positive_score, shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            asked = cell.column("asks").to_numpy(zero_copy_only=False)
            rows, asks = cell.filter(pa.array(~asked)).combine_chunks(), cell.filter(pa.array(asked)).combine_chunks()
            if not rows.num_rows or not asks.num_rows:
                continue
            number = lambda t, c: t.column(c).fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)
            tree = Tree(number(rows, "row"), number(rows, "id"), number(rows, "label"), _matrix(_whole(rows.column("v")), dims, exact))
            q = Queries(_matrix(_whole(asks.column("v")), dims, exact), *(number(asks, c) for c in ("label", "row", "least", "most")), same, count)
            who, place, score = search(tree, q)
            at = tree.order[place]
            yield pa.RecordBatch.from_arrays(
                [
                    _whole(asks.column("query")).take(pa.array(who)), _whole(asks.column("positive_score")).take(pa.array(who)),
                    _whole(rows.column("id")).take(pa.array(at)), _whole(rows.column("row")).take(pa.array(at)), pa.array(score),
                ],
                names=["query", "positive_score", "id", "row", "score"],
            )

    none = F.lit(None).cast("bigint")
    cell = F.xxhash64("block", "shard").alias("cell")
    here = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        cell, F.lit(False).alias("asks"), "row", "id", "label", "v", none.alias("least"), none.alias("most"), none.alias("query"), none.alias("positive_score")
    )
    there = queries.withColumn("block", F.pmod(F.xxhash64("query", "positive_score"), F.lit(blocks)).cast("int")).select(
        cell, F.lit(True).alias("asks"), "row", none.alias("id"), "label", "v", "least", "most", "query", "positive_score"
    )
    return here.union(there).repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(run, _FOUND)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _best(found: DataFrame, by: list[str], count: int) -> DataFrame:
    """The first ``count`` of each query, numbered; Spark limits every task's rows before they are shuffled."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), F.asc("row"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def sharded(rows: DataFrame, dims: int, shard: int = SHARD) -> DataFrame:
    """``rows`` with ``shard``: rows of about ``shard`` that lie together."""
    sizes = stage(rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "negatives-labels")
    large = F.col("_n") >= shard // 2
    small = sizes.agg(F.sum(F.when(~large, F.col("_n")))).first()[0] or 0
    buckets = max(1, -(-small // shard))
    tile = F.when(large, F.concat(F.lit("l"), F.col("label"))).otherwise(F.concat(F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(buckets))))
    tiled = rows.join(sizes, "label").withColumn("tile", tile).drop("_n")

    def counted(df: DataFrame, *more: Column) -> DataFrame:
        return stage(df.groupBy("tile").agg(F.count(F.lit(1)).alias("_n"), *more), "negatives-tiles")

    most = counted(tiled).agg(F.max("_n")).first()[0] or 0
    levels = 0
    while most > shard * CUTS**levels and levels < 3:
        levels += 1
    levels = min(levels, dims)
    if levels:
        spread = rows.agg(*[F.var_pop(F.get("v", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dims)]).first()
        widest = sorted(range(dims), key=lambda i: (-(spread[i] or 0.0), i))[:levels]
        steps = [i / CUTS for i in range(1, CUTS)]
        for done, k in enumerate(widest):
            value = F.coalesce(F.get("v", F.lit(k)), F.lit(0))
            cuts = counted(tiled, F.percentile_approx(value, steps, 1000).alias("_cuts"))
            ways = F.least(F.lit(CUTS), F.ceil(F.pow(F.col("_n") / shard, F.lit(1 / (levels - done)))))
            slab = F.floor(F.size(F.filter("_cuts", lambda x: x < value)) * ways / CUTS)
            tiled = tiled.join(cuts, "tile").withColumn("tile", F.concat_ws(".", "tile", slab)).drop("_n", "_cuts")
    # what values cannot part, as copies of one vector, is dealt out by the row
    chunks = counted(tiled).select("tile", F.ceil(F.col("_n") / (2 * shard)).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("row"), F.col("_chunks"))
    return tiled.join(chunks, "tile").withColumn("shard", F.xxhash64("tile", chunk)).drop("tile", "_chunks")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = (50, 95),
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` is a condition on ``id``. A negative's score lies between ``window``
    hundredths of the positive's.
    """
    rows = stage(quantised(vectors, key, vector, label).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.max(largest).alias("largest"), F.count(F.when(anchor, 1)).alias("anchors")).first()
    dims, largest = facts["dims"] or 0, facts["largest"] or 0
    if dims * largest * largest >= 1 << 56:
        raise ArithmeticError("inner products of these vectors may pass 64 bits")
    exact = np.float64 if dims * largest * largest < 1 << 53 else np.int64
    if largest < 1 << 31:
        rows = rows.withColumn("v", F.col("v").cast("array<int>"))
    index = stage(sharded(rows, dims, shard), "negatives-index")
    homes = stage(index.select("label", "shard").distinct(), "negatives-homes")
    places = stage(numbered(homes.groupBy("shard").agg(F.min("label").alias("low"), F.max("label").alias("high")), "no"), "negatives-places")
    none = F.lit(None).cast("bigint")

    asked = index.where(anchor).select(F.col("row").alias("query"), "row", F.col("id").alias("anchor_id"), "label", "v")
    first = asked.withColumns({"least": F.lit(_OPEN), "most": F.lit(_LAST), "positive_score": none}).join(homes, "label")
    blocks = max(1, -(-facts["anchors"] // block))
    near = _best(_met(index, first, blocks, dims, exact, True, positives), ["query"], positives)
    near = stage(near.select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-near")

    score = F.col("positive_score")
    low, high = (F.expr(f"(positive_score * {window[0]} + 99) div 100"), F.expr(f"(positive_score * {window[1]}) div 100"))
    wanted = near.where(score >= 0).select("query", "positive_score").distinct().withColumns({"least": low, "most": high}).where("least <= most")
    second = stage(wanted.join(asked, "query"), "negatives-asked")
    blocks = max(1, -(-second.count() // block))
    # every query goes to every shard but those that hold its own label only
    everywhere = second.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(max(1, places.count()) - 1))))
    spread = everywhere.join(places, "no").where((F.col("low") != F.col("high")) | (F.col("low") != F.col("label")))
    found = _best(_met(index, spread, blocks, dims, exact, False, negatives), ["query", "positive_score"], negatives)
    answers = found.select("query", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(asked.select("query", "anchor_id"), "query")
    return named.join(answers, ["query", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
