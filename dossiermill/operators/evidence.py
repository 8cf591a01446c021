"""What an issue names beside its code: a key, a field, and the values it was raised for.

An issue is one row per (job, code, source); what speaks for it can be any number of rows.
``evidence`` gives these as a table of its own, numbered per issue, so a report can show
the first few and a store keeps all. Warnings of the extractions are rows here as well.

Defined cases: an issue without values has no evidence row; equal values of an issue are
one row with their number ``n``; a null value stays null and comes first; repeated issues
share one key and one set of evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..plans.numbering import dense
from ..sources.artifacts import resolvable_ref
from .analyses import mode_check
from .reconcile import scope_mismatch, unknown_targets

JOB = "job_id"


def issue_id(job: Column | str = JOB, code: Column | str = "code", source: Column | str = "source_id") -> Column:
    """The key of an issue: MD5 of job, code and source."""
    source = F.col(source) if isinstance(source, str) else source
    sep = F.lit("\x1f")
    return F.md5(F.concat(job, sep, code, sep, F.coalesce(source.cast("string"), F.lit(""))).cast("binary"))


def with_fields(issues: DataFrame) -> DataFrame:
    """Issues with ``issue_id`` and the ``field`` they name; the role for issues of files, NULL for codes outside the list."""
    field = F.lit(None).cast("string")
    for name, codes in rules.ISSUE_FIELDS.items():
        field = F.when(F.col("code").isin(codes), name).otherwise(field)
    field = F.when(F.col("code").isin(rules.FILE_CODES), F.col("source_id")).otherwise(field)
    return issues.withColumn("issue_id", issue_id()).withColumn("field", field)


def _found(df: DataFrame, code: str | Column, name: str | Column, value: str, source: str | Column | None = None) -> DataFrame:
    lit = [F.lit(c) if isinstance(c, str) else c for c in (code, name)]
    source = F.lit(None) if source is None else (F.col(source) if isinstance(source, str) else source)
    return df.select(
        JOB, lit[0].alias("code"), source.cast("string").alias("source_id"), lit[1].alias("name"), F.col(value).cast("string").alias("value")
    )


def evidence(t: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """``issue_id, job_id, code, source_id, no, name, value, n`` of ``issues``, ``no`` from 0 by name and value.

    ``t``: the tables that the rules read, warnings with ``message``. Values are counted
    before they are numbered, and numbered without a window over an issue or a job.
    """
    exceptions, wrong = t["exceptions"], mode_check(t["jobs"], t["sources"]).select(JOB).distinct()
    repeated = t["groups"].groupBy(JOB, "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sides = scope_mismatch(t["blocks"], t["plan"], [JOB, "source_id"])
    strangers = exceptions.join(t["blocks"].select(JOB, "source_id").distinct(), [JOB, "source_id"], "left_anti")
    warned = F.concat("origin", F.lit("_warning"))
    parts = [
        _found(repeated, "duplicate_official_ghe", "official_code", "code"),
        _found(sides, "reconciliation_scope_mismatch", F.when(F.col("only_in") == "left", "only_in_blocks").otherwise("only_in_plan"), "source_id"),
        _found(wrong.join(t["jobs"], JOB), "technical_mode_sources_invalid", "analysis_mode", "analysis_mode"),
        _found(t["sources"].join(wrong, JOB), "technical_mode_sources_invalid", "source_role", "source_role"),
        _found(
            exceptions, "private_compatibility_mode",
            F.when(F.col("action") == "include", "included_source_id").otherwise("omitted_source_id"), "source_id",
        ),
        _found(exceptions.where("acknowledged is not true"), "compatibility_not_acknowledged", "source_id", "source_id"),
        _found(strangers, "compatibility_unknown_ergo_block", "source_id", "source_id"),
        _found(unknown_targets(t["plan"], t["groups"]), "reconciliation_target_unknown", "official_code", "official_code", "source_id"),
        _found(t["warnings"], warned, "message", "message", F.concat(warned, F.lit("-"), (F.col("ord") + 1).cast("string"))),
    ]
    rows = reduce(DataFrame.unionByName, parts).withColumn("issue_id", issue_id())
    raised = issues.select(issue_id().alias("issue_id")).distinct()
    counted = rows.join(raised, "issue_id", "left_semi").groupBy("issue_id", JOB, "code", "source_id", "name", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return dense(counted, ["issue_id"], ["name", "value"], "no", "evidence")


def _warning(df: DataFrame, code: str | Column, source: str | Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    source = F.lit(None) if source is None else (F.col(source) if isinstance(source, str) else source)
    return df.select(JOB, source.cast("string").alias("source_id"), code.alias("code"))


def _without(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    return jobs.select(JOB).distinct().join(rows.select(JOB).distinct(), JOB, "left_anti")


def block_warnings(jobs: DataFrame, blocks: DataFrame, units: DataFrame) -> DataFrame:
    """``job_id, source_id, code``: jobs without a titled block, and images whose reference leads nowhere.

    ``units`` may carry ``image_ref``; a null is no image, an empty one leads nowhere.
    """
    untitled = _warning(_without(jobs, blocks), "no_group_title")
    if "image_ref" not in units.columns:
        return untitled
    lost = units.where(F.col("image_ref").isNotNull() & ~F.coalesce(resolvable_ref("image_ref"), F.lit(False)))
    return untitled.unionByName(_warning(lost, "image_unresolved", "ord"))


def media_warnings(jobs: DataFrame, media: DataFrame) -> DataFrame:
    """``job_id, source_id, code``: jobs without media, and media whose size could not be read."""
    return _warning(_without(jobs, media), "no_image").unionByName(_warning(media.where("width is null"), "image_format_unknown", "image_id"))


def technical_warnings(jobs: DataFrame, sections: DataFrame) -> DataFrame:
    """``job_id, source_id, code``: every required category that no section of a job has; ``source_id`` is the category."""
    needed = jobs.select(JOB).distinct().select(JOB, F.explode(F.array(*[F.lit(c) for c in rules.REQUIRED_CATEGORIES])).alias("category"))
    return _warning(needed.join(sections.select(JOB, "category").distinct(), [JOB, "category"], "left_anti"), "category_missing", "category")
