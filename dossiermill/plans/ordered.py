"""Running values over ordered rows, without one task per key.

A plain ``Window.partitionBy(key).orderBy(ord)`` puts all rows of a key into one
task. One document, job or source may hold a third of all rows, so the operators
of this package do not use it on row tables. Instead the rows of a key are cut
into *stretches* of its order (for an integer position: blocks of
``STRETCH`` positions). Then

1. a window runs inside each (key, stretch), which is bounded;
2. a map-side combinable aggregate gives one summary row per (key, stretch);
3. a window over the summaries only, thousands of times fewer rows, gives what
   each stretch inherits from the ones before it;
4. an equi-join on (key, stretch) adds the inherited value to every row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

STRETCH = 8192
_S = "_stretch"


@dataclass(frozen=True)
class Running:
    """One running value.

    ``kind`` is ``sum`` (rows up to and including this one), ``last`` (last
    non-null value up to and including this one), ``prev`` (last non-null value
    strictly before this one), or ``min`` (least value up to and including this one).
    """

    kind: str
    value: Column


def stretch_of(ord_col: str, size: int = STRETCH) -> Column:
    """Stretch of an integer position."""
    return F.floor(F.col(ord_col) / size)


def time_stretch(ts_col: str, seconds: int = 3600) -> Column:
    """Stretch of a timestamp."""
    return F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / (seconds * 1_000_000))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Running],
    stretch: Column | None = None,
) -> DataFrame:
    """Add the running ``values`` to ``df``, per ``keys`` in ``order``.

    ``stretch`` must not decrease along ``order`` and should hold few rows per
    value; it defaults to blocks of the first order column, an integer position.
    """
    stretch = stretch_of(order[0]) if stretch is None else stretch
    rows = df.withColumn(_S, stretch)
    parts = [*keys, _S]
    inside = Window.partitionBy(*parts).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, totals, carries = rows, [], []
    for name, spec in values.items():
        if spec.kind == "sum":
            local = local.withColumn(f"_l_{name}", F.sum(spec.value).over(upto))
            totals.append(F.sum(spec.value).alias(f"_t_{name}"))
            carries.append(F.sum(f"_t_{name}").over(earlier).alias(f"_c_{name}"))
        elif spec.kind == "min":
            local = local.withColumn(f"_l_{name}", F.min(spec.value).over(upto))
            totals.append(F.min(spec.value).alias(f"_t_{name}"))
            carries.append(F.min(f"_t_{name}").over(earlier).alias(f"_c_{name}"))
        else:
            frame = upto if spec.kind == "last" else before
            local = local.withColumn(f"_l_{name}", F.last(spec.value, ignorenulls=True).over(frame))
            totals.append(
                F.max_by(spec.value, F.when(spec.value.isNotNull(), position)).alias(f"_t_{name}")
            )
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
    inherited = rows.groupBy(*parts).agg(*totals).select(*parts, *carries)
    joined = local.join(inherited, parts, "left")
    for name, spec in values.items():
        here, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if spec.kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        elif spec.kind == "min":
            value = F.least(here, carried)
        else:
            value = F.coalesce(here, carried)
        joined = joined.withColumn(name, value)
    return joined.select(*df.columns, *values)


def ordinal(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    stretch: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 1, in ``order``."""
    return running(df, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, stretch)


def first_rows(df: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """``columns`` of the first row of each key: one combinable aggregate, no window."""
    position = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*columns), position).alias("_first")
    ).select(*keys, "_first.*")


def asof_last(
    df: DataFrame, events: DataFrame, keys: list[str], ord_col: str, columns: list[str]
) -> DataFrame:
    """Give every row the ``columns`` of the last event at or before its position.

    ``events`` holds ``keys``, ``ord_col`` and ``columns``; it is read twice and
    should be a small or stored table. The rows of ``df`` are shuffled once. What a
    stretch inherits is found from the events and from the bare positions of
    ``df``, a scan that needs none of its other columns.
    """
    parts = [*keys, _S]
    value = F.struct(*columns)
    at = stretch_of(ord_col)
    ends = events.withColumn(_S, at).groupBy(*parts).agg(F.max_by(value, F.col(ord_col)).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
    inherited = (
        df.select(*keys, at.alias(_S))
        .distinct()
        .join(ends, parts, "left")
        .select(*parts, F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    )
    empty = events.schema
    fields = {f.name: f.dataType for f in empty.fields}
    rows = df.withColumn("_event", F.lit(None).cast(_struct_type(fields, columns))).withColumn("_tag", F.lit(1))
    marks = events.select(
        *[F.col(c) if c in {*keys, ord_col} else F.lit(None).cast(t).alias(c) for c, t in _types(df)],
        value.cast(_struct_type(fields, columns)).alias("_event"),
        F.lit(0).alias("_tag"),
    )
    inside = (
        Window.partitionBy(*parts).orderBy(ord_col, "_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(marks)
        .withColumn(_S, at)
        .withColumn("_here", F.last("_event", ignorenulls=True).over(inside))
        .where("_tag = 1")
        .join(inherited, parts, "left")
        .withColumn("_last", F.coalesce("_here", "_carried"))
        .select(*df.columns, *[F.col(f"_last.{c}").alias(c) for c in columns])
    )


def _types(df: DataFrame):
    return [(f.name, f.dataType) for f in df.schema.fields]


def _struct_type(fields, columns: list[str]) -> StructType:
    return StructType([StructField(c, fields[c], True) for c in columns])
