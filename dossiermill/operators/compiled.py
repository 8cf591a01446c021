"""Result tables of a job: groups with total, diagnostics, questions, priorities, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_label
from ..plans.ordered import ordinal

JOB = "job_id"


def diagnostic_summary(jobs: DataFrame, groups: DataFrame) -> DataFrame:
    """Base dates, head-count and code list of each job: ``job_id, line, part, value``.

    Every code is a row of line 4, numbered by ``part``, whatever the registry's size.
    """
    totals = groups.groupBy(JOB).agg(F.sum("population").alias("_total"))
    lines = jobs.join(totals, JOB, "left").select(
        JOB,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("line"), F.concat(F.lit("Formulário ERGO – levantamento de "), F.coalesce("ergo_base_date", F.lit(""))).alias("value")),
                F.struct(F.lit(2).alias("line"), F.concat(F.lit("Formulário HSE – relatório emitido em "), F.coalesce("psychosocial_base_date", F.lit(""))).alias("value")),
                F.struct(F.lit(3).alias("line"), F.concat(F.coalesce("_total", F.lit(0)).cast("string"), F.lit(" colaboradores")).alias("value")),
            )
        ).alias("l"),
    ).select(JOB, "l.line", F.lit(1).cast("bigint").alias("part"), "l.value")
    numbered = ordinal(groups.select(JOB, "code", "ord"), [JOB], ["ord", "code"], "_no")
    codes = numbered.select(JOB, F.lit(4).alias("line"), F.col("_no").alias("part"), F.col("code").alias("value"))
    return lines.unionByName(codes)


def priority_table(items: DataFrame) -> DataFrame:
    """Numbered priority rows as they are printed."""
    return items.select(
        JOB, F.col("priority_no").alias("line"), "group_hint", F.coalesce("level", F.lit("")).alias("level"), "reason"
    )


def action_table(items: DataFrame) -> DataFrame:
    """Action rows as they are printed; the last column stays empty."""
    return items.select(
        JOB,
        F.col("action_no").alias("line"),
        F.coalesce("priority", F.lit("")).alias("priority"),
        F.coalesce("group_hint", F.lit("")).alias("group_hint"),
        "action",
        F.coalesce("responsible", F.lit("")).alias("responsible"),
        F.lit("").alias("evolution"),
    )


def run_summary(jobs: DataFrame, groups: DataFrame, plan: DataFrame, issues: DataFrame) -> DataFrame:
    """Group count, head-count and status of each validated job.

    Errors decide first; then any plan item asks for a look at the reconciliation.
    """
    g = groups.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("population").alias("total_population")
    )
    p = plan.groupBy(JOB).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("status") == "needs_review").alias("n_open"))
    i = issues.groupBy(JOB).agg(F.count_if(F.col("severity") == "error").alias("n_errors"))
    joined = jobs.select(JOB).join(g, JOB, "left").join(p, JOB, "left").join(i, JOB, "left").fillna(
        0, subset=["n_groups", "total_population", "n_items", "n_open", "n_errors"]
    )
    return joined.select(
        JOB, "n_groups", "total_population", "n_items", "n_open", "n_errors",
        F.when(F.col("n_errors") > 0, "validation_failed")
        .when(F.col("n_items") > 0, "needs_reconciliation")
        .otherwise("validated")
        .alias("status"),
        count_label(F.col("n_groups"), "grupo", "grupos").alias("groups_label"),
    )

