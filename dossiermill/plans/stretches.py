"""State along an ordered log, in stretches of equal row counts.

``laid_out`` puts a log into its order by range partitioning and writes it once; rows are
then cut into stretches of ``rows`` rows, whatever their spacing in time: a job with most
of the log in one second is spread over as many tasks as it has stretches.

A running state is composed from what each stretch does to it. Inside a stretch windows
give the state from the stretch's own start. One summary row per stretch says what the
stretch does to any state that it is given (a sum and its least prefix; the last opening;
the first and last moment); summaries compose associatively, so windows over the summary
rows of a key, thousands of times fewer than its events, give what each stretch is given.
A join hands that to its rows. The log is read once to lay it out, and shuffled once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import STRETCH
from .staging import stage

AT, CUT = "_at", "_stretch"


@dataclass(frozen=True)
class Stretched:
    """A laid-out log: ``rows`` carry ``_at`` (their position) and ``_stretch``."""

    rows: DataFrame
    keys: list[str]

    @property
    def upto(self) -> WindowSpec:
        """Rows of the stretch up to and including this one."""
        return Window.partitionBy(*self.keys, CUT).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def earlier(self) -> WindowSpec:
        """Rows of the stretch before this one."""
        return Window.partitionBy(*self.keys, CUT).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def ahead(self) -> WindowSpec:
        """Stretches of the key before this one, over summary rows."""
        return Window.partitionBy(*self.keys).orderBy(CUT).rowsBetween(Window.unboundedPreceding, -1)

    def previous(self, value: str) -> Column:
        """A summary value of the stretch just before."""
        return F.lag(value).over(Window.partitionBy(*self.keys).orderBy(CUT))

    def given(self, local: DataFrame, summaries: DataFrame) -> DataFrame:
        """``local`` rows with what their stretch is given; null keys are keys as well."""
        names = [*self.keys, CUT]
        right = summaries.select(*[F.col(n).alias(f"_r{i}") for i, n in enumerate(names)], *[c for c in summaries.columns if c not in names])
        on = [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(names)]
        return local.join(right, on, "left").drop(*[f"_r{i}" for i in range(len(names))])


def laid_out(df: DataFrame, keys: list[str], order: list[str], rows: int = STRETCH) -> Stretched:
    """``df`` written in the order of ``keys`` and ``order``; a position is unique in it."""
    by = [*keys, *order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id())
    # the partition stands above bit 33, so a stretch never goes over two partitions and numbers follow the order
    return Stretched(stage(placed, "log").withColumn(CUT, F.floor(F.col(AT) / rows)), keys)


def carried(log: Stretched, values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """The last non-null ``values`` at each row, or before it."""
    frame = log.upto if inclusive else log.earlier
    local, ends, gifts = log.rows, [], []
    for name, value in values.items():
        local = local.withColumn(f"_l_{name}", F.last(value, ignorenulls=True).over(frame))
        ends.append(F.max_by(value, F.when(value.isNotNull(), F.col(AT))).alias(f"_e_{name}"))
        gifts.append(F.last(f"_e_{name}", ignorenulls=True).over(log.ahead).alias(f"_g_{name}"))
    summaries = log.rows.groupBy(*log.keys, CUT).agg(*ends).select(*log.keys, CUT, *gifts)
    joined = log.given(local, summaries)
    return joined.select(*log.rows.columns, *[F.coalesce(f"_l_{n}", f"_g_{n}").alias(n) for n in values])


def counted(log: Stretched, steps: dict[str, Column], floors: tuple[str, ...] = ()) -> DataFrame:
    """Running sums of ``steps`` at each row; those named in ``floors`` never fall below zero.

    A stretch adds its total t and has a least prefix m (0 at most) on the way. Of two
    stretches the total is t + t', the least prefix min(m, t + m'). A count that is held
    at zero is the sum less the least prefix so far.
    """
    local, sums, gifts, lows, out = log.rows, [], [], [], []
    for name, step in steps.items():
        local = local.withColumn(f"_s_{name}", F.sum(step).over(log.upto))
        if name in floors:
            local = local.withColumn(f"_m_{name}", F.min(f"_s_{name}").over(log.upto))
        sums += [F.max_by(f"_s_{name}", AT).alias(f"_t_{name}"), *([F.min(f"_s_{name}").alias(f"_n_{name}")] if name in floors else [])]
        gifts.append(F.coalesce(F.sum(f"_t_{name}").over(log.ahead), F.lit(0)).alias(f"_g_{name}"))
        if name in floors:
            lows.append(F.coalesce(F.min(F.col(f"_g_{name}") + F.col(f"_n_{name}")).over(log.ahead), F.lit(0)).alias(f"_w_{name}"))
            low = F.least(F.lit(0), f"_w_{name}", F.col(f"_g_{name}") + F.col(f"_m_{name}"))
            out.append((F.col(f"_g_{name}") + F.col(f"_s_{name}") - low).alias(name))
        else:
            out.append((F.col(f"_g_{name}") + F.col(f"_s_{name}")).alias(name))
    # what a stretch does is what its last row has seen: the summaries are aggregated from the windowed rows
    summaries = local.groupBy(*log.keys, CUT).agg(*sums)
    summaries = summaries.select("*", *gifts).select("*", *lows)
    names = [c for c in summaries.columns if c.startswith(("_g_", "_w_"))]
    return log.given(local, summaries.select(*log.keys, CUT, *names)).select(*log.rows.columns, *out)


def last_event(log: Stretched, events: DataFrame, columns: list[str]) -> DataFrame:
    """Every row of the log with the ``columns`` of the last event at or before it.

    ``events`` are rows of the log, with ``_at`` and ``_stretch``; it is read twice and
    should be a small or stored table.
    """
    value = F.struct(*columns)
    marked = log.rows.join(events.select(F.col(AT).alias("_event_at"), value.alias("_event")), F.col(AT) == F.col("_event_at"), "left")
    local = marked.withColumn("_here", F.last("_event", ignorenulls=True).over(log.upto)).drop("_event", "_event_at")
    ends = events.groupBy(*log.keys, CUT).agg(F.max_by(value, AT).alias("_end"))
    places = log.rows.select(*log.keys, CUT).distinct()
    given = log.given(places, ends).select(*log.keys, CUT, F.last("_end", ignorenulls=True).over(log.ahead).alias("_before"))
    joined = log.given(local, given).withColumn("_last", F.coalesce("_here", "_before"))
    return joined.select(*log.rows.columns, *[F.col(f"_last.{c}").alias(c) for c in columns])
