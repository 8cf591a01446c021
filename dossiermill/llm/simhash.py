"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint takes 64 majority votes over the hashes of its word shingles.
Distinct fingerprints get a table of Hamming distances to fixed reference
fingerprints, the pivots. By the triangle inequality two fingerprints at d bits
differ by at most d in every coordinate, so pairs are discarded by their largest
coordinate difference, one coordinate after the other, and what survives is verified
bit by bit. The first coordinate is sorted, so most pairs are never formed.

Which rows are compared at all is decided without a cross join: with 64 bits in m
blocks, two fingerprints at no more than r bits agree on some m - r blocks, and rows
meet under those blocks' values. That is exact, nothing is capped: a group of more
than ``CELL`` rows is dealt into chunks, and every two chunks meet in a cell of
their own. A cell returns a forest of its links, not the pairs, so copies in the
thousands give thousands of edges.

Defined cases: a null text is an empty one and has fingerprint zero, as every text
without words; texts of fewer words than a shingle are one shingle; null ids get a
fingerprint and a component, whose id is the least id that is not null; repeated rows
stay; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .common import bit_table, bounded_batches, in_table
from .components import _drop, components

SHINGLE = 4
RADIUS = 4
PIVOTS = 32
CELL = 2048
SEED = 42
#: what ``keep_one`` goes by: words a shingle, least Jaccard, and bands of least hashes by which texts meet
WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: of the 80 least hashes, 64 agree at 0.8, with a deviation of 3.6: one pair at 0.8 in 20,000 has fewer than 50
AGREEING = 50
#: pivots of a cell's signatures, and bits of the table of texts whose shingles are wanted, as a power of two
CELL_PIVOTS = 8
#: shingles of one part of a place whose texts meet in cells, in bytes
CELL_BYTES = 16 << 20
BITS = 27
_PAIRS = 1 << 20
_VOTES = 1 << 15


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of UTF-8 bytes; only A-Z are lower-cased and only ASCII white space parts words."""
    from xxhash import xxh64_intdigest as xxh64

    found = data.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    return _majority(np.fromiter((xxh64(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype="<u8", count=n))


def _majority(hashes: np.ndarray) -> int:
    """The 64 majority votes over hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _VOTES):
        part = hashes[at : at + _VOTES]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed bigint), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = (x.as_buffer() for x in b.column(1))
            got = [fingerprint(x.to_pybytes() if x is not None else b"", shingle) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(got, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    narrow = docs.select(F.col(key).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("t"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(run, schema)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random words."""
    return np.random.default_rng(64).integers(0, 1 << 64, size=count, dtype=np.uint64)


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Every choice of ``blocks - radius`` blocks of the 64 bits, as masks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks at which a meeting place has about a thousand fingerprints or fewer, were they spread evenly."""
    blocks = radius + 1
    while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > 1024:
        blocks += 1
    return blocks


def forest(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS, count: int = PIVOTS) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups as edges from each linked fingerprint to one of its component.

    ``side`` is 0 where all rows of a group meet, else 1 or 2, and then only rows
    of different sides meet.
    """
    table = np.bitwise_count(fp[:, None] ^ pivots(count)[None, :]).astype(np.int16)
    place = group * 1024 + table[:, 0]
    order = np.argsort(place, kind="stable")
    place, table, fp, side = place[order], table[order], fp[order], side[order]
    stop = np.searchsorted(place, place + radius, side="right")
    each = stop - np.arange(len(fp)) - 1
    label = np.arange(len(fp))
    cuts = np.concatenate([[0], np.cumsum(each)])
    at = 0
    while at < len(fp):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(at, end), each[at:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(cuts[at:end] - cuts[at], each[at:end])
        at = end
        keep = (side[i] != side[j]) | (side[i] == 0)
        i, j = i[keep], j[keep]
        for k in range(1, table.shape[1]):
            if not len(i):
                break
            keep = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[keep], j[keep]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        label = merge(label, i[near], j[near])
    linked = label != np.arange(len(fp))
    return fp[linked], fp[label[linked]]


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each row's least known fellow) after joining rows i and j."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        if not len(i):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(jumped := label[label], label):
            label = jumped
    return label


def _cells(distinct: DataFrame, masks: list[int], cell: int) -> DataFrame:
    """``fp`` with each meeting place (``place``, ``cell``) and ``side``."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("value")) for i, m in enumerate(signed)]))
    met = distinct.select("fp", each.alias("b")).select("fp", "b.no", "b.value")
    crowded = met.groupBy("no", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    crowded = stage(crowded.select("no", "value", F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "crowded")
    rows = met.join(crowded, ["no", "value"], "left")
    chunk = F.pmod(F.xxhash64("fp", F.lit(SEED)), F.col("chunks")).cast("int")
    spread = rows.withColumn("chunk", F.coalesce(chunk, F.lit(0))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1))
    )
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    side = F.when(low == high, F.lit(0)).when(F.col("chunk") == low, F.lit(1)).otherwise(F.lit(2))
    return spread.select(F.xxhash64("no", "value", low, high).alias("place"), side.alias("side"), "fp")


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges ``u, v`` that join exactly the distinct fingerprints linked at ``radius`` bits or fewer."""
    masks = block_masks(blocks or blocks_for(distinct.count(), radius), radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> pa.RecordBatch:
            u, v = forest(np.unique(rows[0], return_inverse=True)[1], rows[1], rows[2].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            rows = np.concatenate([*held, rows], axis=1)
            # a place may go on in the next batch: it waits; a place has 2 x cell rows at most
            cut = int(np.searchsorted(rows[0], rows[0, -1], side="left")) if rows.shape[1] else 0
            held = [rows[:, cut:]]
            if cut:
                yield out(rows[:, :cut])
        if held and held[0].shape[1]:
            yield out(held[0])

    met = _cells(distinct, masks, cell)
    return met.repartition("place").sortWithinPartitions("place").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` (the least id reachable over links), one row per row of ``docs``."""
    marked = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = stage(components(links(distinct.select("fp"), radius)), "roots")
    members = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least_id")
    heads = stage(members.groupBy("root").agg(F.min("least_id").alias("head")), "heads")
    linked = stage(members.join(heads, "root").select("fp", "head"), "linked")
    classes = distinct.join(linked, "fp", "left").select("fp", F.when(F.col("head").isNull(), F.col("least_id")).otherwise(F.col("head")).alias("component_id"))
    return marked.join(stage(classes, "classes"), "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@cache
def _turns() -> tuple[np.ndarray, np.ndarray]:
    """What the hashes are turned by, a row per least hash."""
    turn, by = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return turn, by | np.uint64(1)


def _shingles(data: bytes, shingle: int) -> tuple[str, np.ndarray]:
    """Digest of the words, and the distinct shingle hashes in order."""
    from xxhash import xxh3_128_hexdigest, xxh64_intdigest as xxh64

    found = data.lower().split()
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, max(1, len(found))) - 1 :].tolist() or [0]
    hashes = np.unique(np.fromiter((xxh64(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype="<u8", count=n))
    return xxh3_128_hexdigest(joined), hashes


def _marks(data: bytes, shingle: int) -> tuple[str, int, bytes, list[int]]:
    """Digest of the words, fingerprint of the distinct shingles, signature (16 bits of each least hash) and band values of one text."""
    from xxhash import xxh64_intdigest as xxh64

    body, hashes = _shingles(data, shingle)
    turn, by = _turns()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype="<u8")
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[None, i : i + 4096] ^ turn) * by).min(axis=1), out=least)
    values = [xxh64(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    fp = _majority(hashes)
    return body, fp - ((fp >> 63) << 64), (least >> np.uint64(48)).astype("<u2").tobytes(), values


def _marked(texts: DataFrame, shingle: int) -> DataFrame:
    """``own`` of each row with the marks of its ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_marks(x.as_buffer().to_pybytes(), shingle) for x in b.column(1)]
            types = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[k] for g in got], t) for k, t in enumerate(types))], names=["own", "body", "fp", "sig", "bands"])

    narrow = texts.select("own", F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("t"))
    return narrow.mapInArrow(run, "own string, body string, fp bigint, sig binary, bands array<bigint>")


def _grams(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``body, grams`` of the texts whose ``own`` is wanted, and by chance of a few others: shingles are kept for these only."""
    key = F.xxhash64("own")
    shared = texts.sparkSession.sparkContext.broadcast(bit_table(wanted.select(key.alias("key")), BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(in_table(shared.value, b.column(0).to_numpy())))
            for at in range(0, b.num_rows, 512):
                got = [_shingles(x.as_buffer().to_pybytes(), shingle) for x in b.column(1).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["body", "grams"])

    narrow = texts.select(key.alias("key"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("t"))
    return narrow.mapInArrow(run, "body string, grams binary")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), dtype="<u2") for x in column]) if len(column) else np.zeros((0, BANDS * ROWS), dtype="<u2")


def _agreeing(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree in enough places to be worth their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enough = (_signatures(b.column(2)) == _signatures(b.column(3))).sum(axis=1) >= AGREEING
            yield b.select([0, 1]).filter(pa.array(enough))

    left, right = (bodies.select(F.col("body").alias(n), F.col("sig").alias(f"sig_{n}")) for n in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a string, b string")


def _similar(pairs: DataFrame, grams: DataFrame, similarity: float, chunk: int = CELL) -> DataFrame:
    """The pairs ``a, b`` whose sets of shingles have a Jaccard of ``similarity`` or more.

    Each ``a`` comes once for every ``chunk`` of its partners, with them behind it in
    order, so no set of shingles is copied for every pair and a hub's partners are dealt
    out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, x = None, np.zeros(0, dtype="<u8")
        for batch in batches:
            found: list[tuple[str, str]] = []
            for a, part, b, z in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                y = np.frombuffer(z.as_buffer(), dtype="<u8")
                if b is None:
                    name, x = (a, part), y
                elif name == (a, part) and min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                        found.append((a, b))
            columns = zip(*found, strict=True) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["a", "b"])

    sizes = stage(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "near-partners")
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    partners = dealt.select("a", "part", "b").join(grams.withColumnRenamed("body", "b"), "b").select("a", "part", "b", "grams")
    hubs = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    heads = hubs.join(grams.withColumnRenamed("body", "a"), "a").select("a", "part", F.lit(None).cast("string").alias("b"), "grams")
    return heads.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(run, "a string, b string")


def _by_fingerprint(bodies: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of texts that join what the fingerprints link: those of one fingerprint, and one of each of two that are linked."""
    least = stage(bodies.groupBy("fp").agg(F.min("body").alias("least")), "near-fingerprints")
    same = bodies.join(least, "fp").where("body <> least").select(F.col("least").alias("a"), F.col("body").alias("b"))
    u, v = (least.select(F.col("fp").alias(n), F.col("least").alias(f"least_{n}")) for n in ("u", "v"))
    linked = stage(links(least.select("fp")).distinct(), "near-links").join(u, "u").join(v, "v")
    return same.union(linked.select(F.least("least_u", "least_v").alias("a"), F.greatest("least_u", "least_v").alias("b"))).distinct()


def _joined(rows: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between the parts of one cell, as places in ``rows``: a forest over the parts, each link verified by its shingles."""
    side = rows.column("side").to_numpy()
    part = np.unique(rows.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)[1]
    sig = _signatures(rows.column("sig").combine_chunks())
    sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in rows.column("grams")]
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    start = np.cumsum(size) - size
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(int(gram.max()) + 1, dtype=bool)
    seen = np.linspace(0, len(sig) - 1, CELL_PIVOTS).astype(int)
    table = np.stack([(sig != sig[at]).sum(axis=1) for at in seen], axis=1).astype(np.int16)
    found = []
    for i in range(len(sig)):
        j = np.arange(i + 1, len(sig))
        j = j[(part[j] != part[i]) & ((side[j] != side[i]) | (side[i] == 0))]
        j = j[np.abs(table[j] - table[i]).max(axis=1) <= BANDS * ROWS - AGREEING] if len(j) else j
        j = j[(sig[j] == sig[i]).sum(axis=1) >= AGREEING] if len(j) else j
        if not len(j):
            continue
        own = gram[start[i] : start[i] + size[i]]
        marked[own] = True
        ends = np.cumsum(size[j])
        of = np.repeat(start[j] - ends + size[j], size[j]) + np.arange(ends[-1])
        both = np.add.reduceat(marked[gram[of]], ends - size[j], dtype=np.int64)
        marked[own] = False
        j = j[both >= similarity * (size[i] + size[j] - both) - 1e-9]
        for at in j[np.unique(part[j], return_index=True)[1]]:
            found.append((i, int(at)))
        part[np.isin(part, part[j])] = part[i]
    return found


def _unlinked(rest: DataFrame, cell: int, similarity: float) -> DataFrame:
    """Links ``a, b`` that join the parts of every place of ``rest`` (place, body, label, sig, grams).

    Every two rows of a place with different labels are held against each other in
    some cell. The number of places in which two signatures differ is a distance, so a
    cell gets a table of distances to pivots, some of its own signatures; pairs are
    discarded by their largest coordinate difference, those that are left by their
    signatures, and then verified by their shingles. Pairs never leave their cell: it
    returns a forest of its links, fewer than its labels.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        place = rows.column("cell").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for at, end in zip(first, [*first[1:], len(place)], strict=True):
            one = rows.slice(at, end - at)
            names = one.column("body").to_pylist()
            found = [sorted((names[i], names[j])) for i, j in _joined(one, similarity)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            rows = pa.Table.from_batches([b])
            place = rows.column("cell").to_numpy()
            if not len(place):
                continue
            # a cell may go on in the next batch: it waits; its rows and bytes are bounded
            if held and held[-1].column("cell")[-1].as_py() != place[0]:
                yield from pairs(pa.concat_tables(held))
                held = []
            cut = int(np.searchsorted(place, place[-1], side="left"))
            if cut:
                yield from pairs(pa.concat_tables([*held, rows.slice(0, cut)]))
                held = []
            held.append(rows.slice(cut))
        if held:
            yield from pairs(pa.concat_tables(held))

    parts = F.ceil(F.greatest(F.count(F.lit(1)) / cell, F.sum(F.length("grams")) / CELL_BYTES)).cast("int")
    sizes = stage(rest.groupBy("place").agg(parts.alias("chunks")), "near-sizes")
    spread = (
        rest.join(sizes, "place")
        .withColumn("chunk", F.pmod(F.xxhash64("body", F.lit(SEED)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    dealt = spread.select(
        F.xxhash64("place", low, high).alias("cell"),
        F.when(low == high, 0).when(F.col("chunk") == low, 1).otherwise(2).alias("side"),
        "body", "label", "sig", "grams",
    )
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a string, b string").distinct()


def similar(marked: DataFrame, texts: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Links ``a, b`` between digests of words that join what is linked at ``similarity`` or more.

    Texts meet where their SimHash fingerprints are linked (``links``: blocks of bits and
    distances to pivots), and, because these reach about 0.95 only, where a band
    agrees. First every text is held against the least of its place; only places
    that this leaves in several parts have their parts joined, in cells. Every link
    is verified by its shingles, which are made anew from ``texts`` (own, text) for
    those that are needed.
    """
    bodies = stage(
        marked.groupBy("body").agg(F.min(F.struct("own", "fp", "sig", "bands")).alias("m")).select("body", "m.own", "m.fp", "m.sig", "m.bands"), "near-bodies"
    )
    met = bodies.select("body", F.posexplode("bands").alias("no", "value")).select(F.xxhash64("no", "value").alias("place"), "body")
    shared = met.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("body").alias("hub"), F.sum(F.xxhash64("body").cast("decimal(20,0)")).alias("all")).where("n > 1")
    # places of the same texts say the same
    places = stage(shared.groupBy("all", "n", "hub").agg(F.min("place").alias("place")).select("place", "hub"), "near-places")
    crowded = stage(met.join(places, "place"), "near-met")
    star = crowded.where("body <> hub").select(F.col("hub").alias("a"), F.col("body").alias("b")).distinct()
    close = stage(_by_fingerprint(bodies.select("body", "fp")).union(_agreeing(star, bodies)).distinct(), "near-star")

    def with_grams(wanted: DataFrame, name: str) -> DataFrame:
        return stage(_grams(texts, wanted.distinct().join(bodies.select("body", "own"), "body"), shingle), name)

    grams = with_grams(close.select(F.col("a").alias("body")).union(close.select("b")), "near-grams")
    found = stage(_similar(close, grams, similarity), "near-found")
    _drop(grams)
    labels = stage(components(found).select(F.col("node").alias("body"), "root"), "near-labels")
    named = stage(crowded.join(labels, "body", "left").select("place", "body", F.coalesce("root", "body").alias("label")), "near-named")
    _drop(crowded, places)
    parted = stage(named.groupBy("place").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("place"), "near-parted")
    left = stage(named.join(parted, "place"), "near-left")
    _drop(named, parted)
    if left.isEmpty():
        return found
    grams = with_grams(left.select("body"), "near-left-grams")
    rest = stage(left.join(bodies.select("body", "sig"), "body").join(grams.dropDuplicates(["body"]), "body").select("place", "body", "label", "sig", "grams"), "near-rest")
    more = stage(_unlinked(rest, cell, similarity), "near-found-more")
    _drop(left, grams, rest)
    return found.union(more)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group linked by a shingle Jaccard of ``similarity`` or more, with all its columns.

    A document is its id and its text: rows that repeat both count as one. Texts meet
    by their SimHash fingerprints and the tables of distances to pivots; fingerprints
    reach about 0.95 only, so texts further apart also meet by bands of least hashes
    and fall by the pivot tables of their signatures. What is left is verified by its
    shingles. Of pairs at 0.8, which agree in some band but for 3 in 100,000, 5 in
    100,000 have signatures too far apart; closer pairs are surely found.
    """
    own = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))
    bounded_batches(docs.sparkSession)
    texts = docs.select(own.alias("own"), F.col(text).alias("text"))
    marked = stage(_marked(texts, shingle), "near-marks")
    roots = stage(components(similar(marked, texts, shingle, similarity)).select(F.col("node").alias("body"), "root"), "near-roots")
    grouped = marked.select("own", "body").join(roots, "body", "left").select("own", F.coalesce("root", "body").alias("head"))
    kept = stage(grouped.groupBy("head").agg(F.min("own").alias("own")).select("own"), "near-kept")
    return docs.select(F.struct("*").alias("row"), own.alias("own")).join(kept, "own", "left_semi").dropDuplicates(["own"]).select("row.*")
