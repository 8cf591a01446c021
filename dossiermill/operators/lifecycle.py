"""Job lifecycle facts from an append-only event log.

Events: ``job_id, ts, event_id, status`` and, where an operator says so, ``stage,
progress, kind, token``. Position in a job is (ts, event_id). State along a log is
composed from stretches of equal row counts (see ``plans.stretches``), so one job with
most of the log, be it in one second, is spread over as many tasks as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..plans.ordered import STRETCH
from ..plans.stretches import AT, CUT, carried, counted, laid_out

JOB = "job_id"
POSITION = ["ts", "event_id"]


def as_of(events: DataFrame) -> Column:
    """The last moment of a log, as a scalar subquery."""
    return events.agg(F.max("ts")).scalar()


def idle_seconds(last: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 1_000_000


def latest_state(events: DataFrame) -> DataFrame:
    """Last status of each job, when it was touched, and its progress within 0–100."""
    position = F.struct(*POSITION)
    return events.groupBy(JOB).agg(
        F.max_by("status", position).alias("status"),
        F.max("ts").alias("updated_at"),
        F.least(F.greatest(F.max_by("progress", position), F.lit(0)), F.lit(100)).alias("progress"),
        F.count(F.lit(1)).alias("n_events"),
    )


def expired(
    states: DataFrame, now: Column, ttl_seconds: int = rules.JOB_TTL_SECONDS, variant: str = "web"
) -> DataFrame:
    """Jobs idle for the time to live and free to be removed.

    ``web`` takes ``>=`` seconds and spares active jobs, ``store`` takes ``>`` only.
    Optional columns ``worker_active`` and ``active_downloads`` are honoured.
    """
    idle = idle_seconds(F.col("updated_at"), now)
    if variant == "store":
        return states.where(idle > ttl_seconds)
    free = ~F.col("status").isin(rules.ACTIVE_STATUSES)
    if "worker_active" in states.columns:
        free = free & ~F.coalesce("worker_active", F.lit(False))
    if "active_downloads" in states.columns:
        free = free & (F.coalesce("active_downloads", F.lit(0)) == 0)
    return states.where((idle >= ttl_seconds) & free)


def stalled(states: DataFrame, now: Column, stale_seconds: int = rules.GENERATION_STALE_SECONDS) -> DataFrame:
    """Generations without progress, in the failed state they are put into."""
    idle = idle_seconds(F.col("updated_at"), now)
    return states.where((F.col("status") == "generating") & (idle >= stale_seconds)).select(
        JOB,
        F.lit("failed").alias("status"),
        F.greatest(F.lit(rules.GENERATING_FLOOR_PROGRESS), F.col("progress")).alias("progress"),
        F.lit("generation_timeout").alias("error_code"),
    )


def orphans(
    listing: DataFrame, active: DataFrame, now: Column, ttl_seconds: int = rules.JOB_TTL_SECONDS,
    id_pattern: str = rules.JOB_ID_PATTERN,
) -> DataFrame:
    """Stored job ids that no live job owns and that are old in every root.

    ``listing``: ``root, job_id, modified_at, is_directory``.
    """
    known = listing.where(F.col("is_directory") & F.col(JOB).rlike(id_pattern))
    return (
        known.join(active.select(JOB).distinct(), JOB, "left_anti")
        .groupBy(JOB)
        .agg(
            F.bool_and(idle_seconds(F.col("modified_at"), now) >= ttl_seconds).alias("_old"),
            F.count(F.lit(1)).alias("n_roots"),
        )
        .where("_old")
        .select(JOB, "n_roots")
    )


def transition_check(events: DataFrame, rows: int = STRETCH) -> DataFrame:
    """Generation requests (``kind = 'request'``) with the answer the job's status gives.

    A pending reconciliation needs decisions with the request (``has_decisions``).
    """
    log = laid_out(events, [JOB], POSITION, rows)
    seen = carried(log, {"before": F.when(F.col("kind") != "request", F.col("status"))})
    answer = F.lit(rules.GENERATION_DEFAULT_ANSWER)
    for status, code in rules.GENERATION_ANSWERS.items():
        answer = F.when(F.col("before") == status, code).otherwise(answer)
    undecided = (F.col("before") == "needs_reconciliation") & ~F.coalesce("has_decisions", F.lit(False))
    return seen.where("kind = 'request'").select(
        JOB, *POSITION, "before", F.when(undecided, "reconciliation_required").otherwise(answer).alias("answer")
    )


def valid_completions(events: DataFrame, stale_seconds: int = rules.GENERATION_STALE_SECONDS, rows: int = STRETCH) -> DataFrame:
    """Completions with a verdict: ``valid``, ``not_generating``, ``wrong_token`` or ``timed_out``.

    ``kind`` is start, progress, complete or fail. A completion counts if the last
    start is still open, carries the same token, and no silence of ``stale_seconds``
    came in between.

    A stretch hands on its last moment, its last silence and its last opening or end.
    The silence between two stretches is the later one's first event: known from the two
    moments when summaries are composed.
    """
    log = laid_out(events.select(JOB, *POSITION, "kind", "token"), [JOB], POSITION, rows)
    turn = F.when(F.col("kind").isin("start", "complete", "fail"), F.struct("kind", "token", F.col(AT).alias("at")))
    before = F.max("ts").over(log.earlier)
    local = (
        log.rows.withColumn("_quiet", F.when(idle_seconds(before, F.col("ts")) >= stale_seconds, F.col(AT)))
        .withColumn("_silence", F.max("_quiet").over(log.upto))
        .withColumn("_open", F.last(turn, ignorenulls=True).over(log.earlier))
        .drop("_quiet")
    )
    ends = local.groupBy(JOB, CUT).agg(
        F.min(AT).alias("_first_at"),
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.max("_silence").alias("_inside"),
        F.max_by(turn, F.when(turn.isNotNull(), F.col(AT))).alias("_turn"),
    )
    between = F.when(idle_seconds(log.previous("_last"), F.col("_first")) >= stale_seconds, F.col("_first_at"))
    given = (
        ends.withColumn("_between", between)
        # the silence at its own start is given to a stretch as well
        .withColumn("_given_silence", F.greatest("_between", F.max(F.greatest("_inside", "_between")).over(log.ahead)))
        .select(JOB, CUT, "_given_silence", F.last("_turn", ignorenulls=True).over(log.ahead).alias("_given_turn"))
    )
    opened = F.coalesce("_open", "_given_turn")
    judged = log.given(local, given).withColumn("_open", opened).withColumn("_silence", F.greatest("_silence", "_given_silence"))
    verdict = (
        F.when(~F.col("_open.kind").eqNullSafe(F.lit("start")), "not_generating")
        .when(~F.col("_open.token").eqNullSafe(F.col("token")), "wrong_token")
        .when(F.col("_silence") > F.col("_open.at"), "timed_out")
        .otherwise("valid")
    )
    return judged.where("kind = 'complete'").select(JOB, *POSITION, "token", verdict.alias("verdict"))


def first_claim(events: DataFrame, rows: int = STRETCH) -> DataFrame:
    """Per validation of a job, the first start that came after it, and how many were refused."""
    log = laid_out(events.select(JOB, *POSITION, "kind", "status"), [JOB], POSITION, rows)
    epochs = counted(log, {"epoch": F.when(F.col("status") == "validated", 1).otherwise(0).cast("bigint")})
    return (
        epochs.where("kind = 'start' and epoch > 0")
        .groupBy(JOB, "epoch")
        .agg(
            F.min_by("event_id", F.struct(*POSITION)).alias("event_id"),
            (F.count(F.lit(1)) - 1).alias("n_refused"),
        )
    )


def active_downloads(events: DataFrame, rows: int = STRETCH) -> DataFrame:
    """Open downloads after each event; a close without an open leaves the count at zero."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0).cast("bigint")
    log = laid_out(events, [JOB], POSITION, rows)
    return counted(log, {"active_downloads": step}, ("active_downloads",)).drop(AT, CUT)


def deletion_outcome(states: DataFrame, removed: DataFrame) -> DataFrame:
    """``busy``, ``deleted`` or ``retry`` for each job asked to be deleted.

    ``states`` may carry ``worker_active`` and ``active_downloads``; ``removed``
    holds the jobs whose files could be removed.
    """
    busy = F.col("status").isin(rules.ACTIVE_STATUSES)
    if "worker_active" in states.columns:
        busy = busy | F.coalesce("worker_active", F.lit(False))
    if "active_downloads" in states.columns:
        busy = busy | (F.coalesce("active_downloads", F.lit(0)) > 0)
    gone = removed.select(JOB).distinct().withColumn("_gone", F.lit(True))
    return states.join(gone, JOB, "left").select(
        JOB,
        F.when(~F.col(JOB).cast("string").rlike(rules.JOB_ID_PATTERN), "retry")
        .when(busy, "busy")
        .when(F.col("_gone"), "deleted")
        .otherwise("retry")
        .alias("outcome"),
    )
