"""Dense numbers for rows, without a window over all rows or over a whole key.

A position that steps from 0 without gaps is what ``plans.ordered`` cuts into stretches
of equal size, and what compact codes are made of. Rows are put into their order by range
partitioning, so that a key with most of the rows is spread over many tasks; a row's place
in its partition is fixed by writing the table once; and one summary row per key and
partition gives what the partitions before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_AT, _PART = "_nth", "_nth_part"


def numbered(df: DataFrame, name: str, label: str = "numbered") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, ... in no particular order; written once, so the numbers stay."""
    placed = stage(df.withColumn(_AT, F.monotonically_increasing_id()), label)
    return _from_places(placed, [], name).select(*df.columns, name)


def dense(df: DataFrame, keys: list[str], order: list[str | Column], name: str, label: str = "dense") -> DataFrame:
    """``df`` with ``name``: the rows of each key numbered from 0 in ``order``, null values of it first.

    Rows that agree in key and order get different numbers, in no particular order.
    """
    by = [*keys, *order]
    if not by:
        return numbered(df, name, label)
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_AT, F.monotonically_increasing_id())
    return _from_places(stage(placed, label), keys, name).select(*df.columns, name)


def _from_places(placed: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Numbers from the places that ``monotonically_increasing_id`` gave: the partition above bit 33, the row below."""
    placed = placed.withColumn(_PART, F.shiftright(_AT, 33))
    # null keys are keys too, and joins do not match them: keys meet by a struct, which is never null
    key = F.struct(*[F.struct(F.col(k).isNull().alias("no"), F.col(k).alias("value")) for k in keys], F.lit(0).alias("all"))
    text = F.to_json(key)
    sizes = placed.groupBy(text.alias("_key"), _PART).agg(F.min(_AT).alias("_low"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("_key").orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_key", _PART, "_low", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    starts = stage(starts, "starts")
    return placed.withColumn("_key", text).join(starts, ["_key", _PART]).withColumn(name, F.col("_ahead") + F.col(_AT) - F.col("_low"))
