"""Job lifecycle facts from a live event stream.

Event time must be a timestamp with time zone semantics (the session runs in
UTC). Every query works with file, Kafka or any other streaming source; the size
of a micro-batch is set at the source (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``), which also bounds what one key brings to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from .. import rules

JOB = "job_id"


def _with_job(events: DataFrame, rest: str) -> StructType:
    """An output schema whose job ids are of the events' own type."""
    return StructType([StructField(JOB, events.schema[JOB].dataType), *StructType.fromDDL(rest).fields])


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream, oldest first."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("latestFirst", "false")
        .parquet(path)
    )


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with event time and watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def stream_latest_state(events: DataFrame) -> DataFrame:
    """Last status per job, for update or complete mode; partial sums are combined map-side."""
    position = F.struct("ts", "event_id")
    return events.groupBy(JOB).agg(
        F.max_by("status", position).alias("status"),
        F.max("ts").alias("updated_at"),
        F.least(F.greatest(F.max_by("progress", position), F.lit(0)), F.lit(100)).alias("progress"),
    )


def stream_idle_sessions(events: DataFrame, ttl_seconds: int = rules.JOB_TTL_SECONDS) -> DataFrame:
    """Activity sessions of each job; a closed session is a job that was idle for the time to live."""
    return (
        events.groupBy(JOB, F.session_window("ts", f"{ttl_seconds} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(JOB, F.col("w.start").alias("started_at"), F.col("w.end").alias("expired_at"), "n_events")
    )


def stream_first_claim(events: DataFrame) -> DataFrame:
    """First start per job and validation; repeats within the watermark are refused.

    ``epoch`` counts a job's validations and comes with the events; without it, a job
    has one validation within the watermark.
    """
    keys = [JOB, "epoch"] if "epoch" in events.columns else [JOB]
    return events.where("kind = 'start'").dropDuplicatesWithinWatermark(keys)


class CompletionJudge(StatefulProcessor):
    """Keeps one small state per job: the open start and the time of the last event."""

    def __init__(self, stale_seconds: int = rules.GENERATION_STALE_SECONDS):
        self.stale = pd.Timedelta(seconds=stale_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "token bigint, open boolean, timed_out boolean, last_micros bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"])
        token, is_open, timed_out, last = None, False, False, None
        if self.state.exists():
            token, is_open, timed_out, micros = self.state.get()
            last = None if micros is None else pd.Timestamp(micros, unit="us")
        out = []
        for row in batch.itertuples(index=False):
            if last is not None and row.ts - last >= self.stale:
                timed_out = True
            last = row.ts
            own = None if pd.isna(row.token) else int(row.token)
            if row.kind == "start":
                token, is_open, timed_out = own, True, False
            elif row.kind == "complete":
                if not is_open:
                    verdict = "not_generating"
                elif token != own:
                    verdict = "wrong_token"
                else:
                    verdict = "timed_out" if timed_out else "valid"
                out.append((key[0], row.ts, row.event_id, own, verdict))
                is_open = False
            elif row.kind == "fail":
                is_open = False
        self.state.update((token, is_open, timed_out, None if last is None else int(last.value // 1000)))
        yield pd.DataFrame(out, columns=["job_id", "ts", "event_id", "token", "verdict"])

    def close(self) -> None:
        pass


def stream_valid_completions(events: DataFrame, stale_seconds: int = rules.GENERATION_STALE_SECONDS) -> DataFrame:
    """The verdicts of ``operators.lifecycle.valid_completions``, on a stream.

    Needs the RocksDB state store. Events of one job must arrive in order across
    micro-batches; inside one they are sorted.
    """
    return events.select(JOB, "ts", "event_id", "kind", "token").groupBy(JOB).transformWithStateInPandas(
        statefulProcessor=CompletionJudge(stale_seconds),
        outputStructType=_with_job(events, "ts timestamp, event_id bigint, token bigint, verdict string"),
        outputMode="append",
        timeMode="None",
    )


class ExpiryTimer(StatefulProcessor):
    """Emits a job once it was idle for the time to live, by an event-time timer."""

    def __init__(self, ttl_seconds: int = rules.JOB_TTL_SECONDS):
        self.ttl_millis = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "status string, last_millis bigint, last_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last, last_id = self.state.get() if self.state.exists() else (None, -1, -1)
        for batch in rows:
            millis = batch["ts"].astype("int64") // (1_000_000 if batch["ts"].dtype.str.endswith("[ns]") else 1_000)
            for moment, number, value in zip(millis, batch["event_id"], batch["status"]):
                if (moment, number) >= (last, last_id):
                    status, last, last_id = value, int(moment), int(number)
        self.state.update((status, last, last_id))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.ttl_millis)
        yield pd.DataFrame({"job_id": pd.Series(dtype="object"), "status": pd.Series(dtype="object")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status = self.state.get()[0] if self.state.exists() else None
        if status in rules.ACTIVE_STATUSES:
            yield pd.DataFrame({"job_id": pd.Series(dtype="object"), "status": pd.Series(dtype="object")})
        else:
            self.state.clear()
            yield pd.DataFrame({"job_id": [key[0]], "status": [status]})

    def close(self) -> None:
        pass


def stream_expired(events: DataFrame, ttl_seconds: int = rules.JOB_TTL_SECONDS) -> DataFrame:
    """Jobs that expire while the stream runs. Needs a watermark and the RocksDB state store."""
    return events.select(JOB, "ts", "event_id", "status").groupBy(JOB).transformWithStateInPandas(
        statefulProcessor=ExpiryTimer(ttl_seconds),
        outputStructType=_with_job(events, "status string"),
        outputMode="append",
        timeMode="EventTime",
    )
