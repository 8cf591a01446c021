"""The stream and the batch must agree on a replayed log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dossiermill.operators import lifecycle as LC
from dossiermill.streaming import lifecycle as ST


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(1500):
        kind, status = rng.choice([("start", "generating"), ("progress", "validated"), ("complete", "completed"), ("fail", "failed")])
        rows.append((1 if i % 3 == 0 else i % 9 + 2, start + dt.timedelta(seconds=i * 120 + rng.randint(0, 60)), i, status, kind, rng.randint(0, 1), rng.randint(-10, 120)))
    df = spark.createDataFrame(rows, "job_id bigint, ts timestamp, event_id bigint, status string, kind string, token bigint, progress int")
    path = str(tmp_path_factory.mktemp("log"))
    for part in range(5):
        df.where(F.floor(F.col("event_id") / 300) == part).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), path


def drain(stream, name, mode, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_completions_agree(spark, log, tmp_path):
    batch, path = log
    want = LC.valid_completions(batch, 1000).select("job_id", "event_id", "verdict")
    stream = ST.timed(ST.read_events(spark, path, batch.schema))
    got = drain(ST.stream_valid_completions(stream, 1000), "completions", "append", tmp_path).select("job_id", "event_id", "verdict")
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0
    assert want.select("verdict").distinct().count() == 4


def test_jobs_may_have_hex_ids(spark, log, tmp_path):
    batch, path = log
    named = F.md5(F.col("job_id").cast("string"))
    want = LC.valid_completions(batch.withColumn("job_id", named), 1000).select("job_id", "event_id", "verdict")
    stream = ST.timed(ST.read_events(spark, path, batch.schema)).withColumn("job_id", named)
    got = drain(ST.stream_valid_completions(stream, 1000), "hex_completions", "append", tmp_path).select("job_id", "event_id", "verdict")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    expired = drain(ST.stream_expired(stream, 900), "hex_expired", "append", tmp_path)
    assert dict(expired.dtypes)["job_id"] == "string"


def test_latest_state_agrees(spark, log, tmp_path):
    batch, path = log
    stream = ST.timed(ST.read_events(spark, path, batch.schema))
    got = drain(ST.stream_latest_state(stream), "latest", "complete", tmp_path)
    want = LC.latest_state(batch).select("job_id", "status", "updated_at", "progress")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_closed_sessions_agree(spark, log, tmp_path):
    batch, path = log
    closed = drain(ST.stream_idle_sessions(ST.timed(ST.read_events(spark, path, batch.schema), "10 minutes"), 900), "idle", "append", tmp_path)
    whole = batch.groupBy("job_id", F.session_window("ts", "900 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(
        "job_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("expired_at"), "n_events"
    )
    assert closed.exceptAll(whole).count() == 0
    # append mode keeps back only the sessions that were still open at the end
    assert 0 < whole.count() - closed.count() < whole.count() // 20


def test_first_claims_are_unique(spark, log, tmp_path):
    batch, path = log
    stream = ST.timed(ST.read_events(spark, path, batch.schema).withColumn("epoch", F.floor(F.col("event_id") / 300)))
    got = drain(ST.stream_first_claim(stream), "claims", "append", tmp_path)
    want = batch.where("kind = 'start'").select("job_id", F.floor(F.col("event_id") / 300).alias("epoch")).distinct()
    assert got.select("job_id", "epoch").exceptAll(want).count() == 0 and got.count() == want.count()


def test_expiry_timer(spark, tmp_path):
    path = str(tmp_path / "in")
    start = dt.datetime(2024, 1, 1)
    schema = "job_id bigint, ts timestamp, event_id bigint, status string"
    batches = [
        [(1, start, 1, "completed"), (2, start, 2, "generating"), (3, start, 3, "completed")],
        [(3, start + dt.timedelta(seconds=800), 4, "failed")],
        [(9, start + dt.timedelta(seconds=1000), 5, "receiving")],
        [(9, start + dt.timedelta(seconds=1001), 6, "receiving")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = ST.timed(ST.read_events(spark, path, spark.read.parquet(path).schema), "1 second")
    got = drain(ST.stream_expired(stream, 900), "expired", "append", tmp_path)
    assert [tuple(r) for r in got.collect()] == [(1, "completed")]
