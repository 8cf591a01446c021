"""What several operators of this subpackage share: words, hashed draws, and running totals without one-task windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a longest run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


class Memory:
    """What a worker has worked out, in two generations: the older one goes when the younger is full.

    What keeps coming stays, memory is bounded, and it does not matter what came first.
    """

    def __init__(self, held: int, longest: int = 64) -> None:
        self.held, self.longest = held, longest
        self.young: dict = {}
        self.old: dict = {}

    def get(self, name: str):
        got = self.young.get(name)
        if got is None and (got := self.old.get(name)) is not None:
            self.keep(name, got)
        return got

    def keep(self, name: str, value) -> None:
        """Longer names are not remembered, so that a generation stays small."""
        if len(name) <= self.longest:
            if len(self.young) >= self.held:
                self.old, self.young = self.young, {}
            self.young[name] = value


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out a single time per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_unit(*parts: Column) -> Column:
    """A number inside (0, 1) drawn from the MD5 of the parts; null parts count as empty.

    52 bits, so that the value is exact in a double and any engine gets the same.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def running(df: DataFrame, group: str, rows: str, place: str, ties: list[str], value: Column, per_stretch: int = 1024) -> DataFrame:
    """``df`` with ``_index`` (rows before, in its group) and ``_before`` (their total of ``value``).

    Rows are ordered by ``place`` (a number in [0, 1), spread about evenly), then
    by ``ties``. A group is cut into stretches of about ``per_stretch`` rows from
    its row count in column ``rows``, so that no task sorts a whole group: windows
    run inside a stretch, and one row per stretch is added up over the group.
    """
    n = F.greatest(F.ceil(F.col(rows) / F.lit(per_stretch)), F.lit(1))
    cut = df.withColumn("_stretch", F.least(n - 1, F.floor(F.col(place) * n)).cast("bigint")).withColumn("_value", value.cast("bigint"))
    ahead = W.partitionBy(group).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        cut.groupBy(group, "_stretch")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("_sum"))
        .select(
            group,
            "_stretch",
            F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rows_ahead"),
            F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"),
        )
    )
    inside = W.partitionBy(group, "_stretch").orderBy(place, *ties)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    return (
        cut.join(starts, [group, "_stretch"])
        .withColumn("_index", F.col("_rows_ahead") + F.row_number().over(inside) - 1)
        .withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_value").over(earlier), F.lit(0)))
        .drop("_stretch", "_rows_ahead", "_ahead", "_value")
    )


def most_frequent(items: DataFrame, total: str, name: str, most: int) -> DataFrame:
    """The rows of the largest ``total``, about ``most`` and not many more, without sorting the table.

    Totals are counted in classes of 1/16 of a binary order, at most about a thousand
    for any table. Of the class in which the limit falls, rows are taken by the hash
    of ``name``. ``items`` is read twice.
    """
    level = F.floor(F.log2(F.col(total)) * 16)
    sizes = {r["level"]: r["n"] for r in items.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
    left = most
    for at in sorted(sizes, reverse=True):
        if sizes[at] > left:
            share = F.pmod(F.xxhash64(name), F.lit(1 << 30)) < int((1 << 30) * left / sizes[at])
            return items.where((level > at) | ((level == at) & share))
        left -= sizes[at]
    return items


#: bytes that Spark hands a Python worker at once; rows of long texts would else come 10,000 at a time
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session bound Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the bit of each key (a 64-bit integer) stands in a table of 2^``bits``."""
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A table with the bit of each key of a one-column table set; it has the same size whatever the keys are."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = slots(b.column(0).to_numpy(), bits)
            words, where = np.unique(at >> np.uint64(6), return_inverse=True)
            value = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(value, where, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(value.view(np.int64))], names=["at", "bits"])

    marked = keys.mapInArrow(mark, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.uint64)
    table[marked.column(0).to_numpy()] = marked.column(1).to_numpy().astype(np.int64).view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set: true for every key of the table, and by chance for a few others."""
    at = slots(keys, int(len(table) * 64).bit_length() - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) > 0
