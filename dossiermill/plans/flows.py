"""The two flows a user runs: validation of all jobs, and result tables for valid ones.

One plan serves every job at once. Tables that several steps read are staged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analyses as AN
from ..operators import compiled as C
from ..operators import evidence as EV
from ..operators import media as M
from ..operators import quality as Q
from ..operators import reconcile as RC
from ..operators import registry as RG
from ..operators import segments as SG
from .ordered import ordinal
from .staging import stage

JOB = "job_id"
_SOURCE_STEP = 1 << 40


@dataclass
class Inputs:
    """Tables of a batch of jobs.

    ``jobs``: job_id, legal_name, has_card, competence, ergo_base_date,
    psychosocial_base_date, analysis_mode.
    ``sheet_rows``: job_id, sheet, sheet_ord, row_no, cells.
    ``block_units``: job_id, ord, text, rows[, structural][, image_ref].
    ``media_units``: job_id, ord, kind, text, width, height.
    ``report_units``: job_id, source_role, source_ord, ord, text, rows[, style].
    ``exceptions``: job_id, source_id, action, ordinal, acknowledged.
    """

    jobs: DataFrame
    sheet_rows: DataFrame
    block_units: DataFrame
    media_units: DataFrame
    report_units: DataFrame
    exceptions: DataFrame


def registry(rows: DataFrame) -> dict[str, DataFrame]:
    """Groups, their sectors and roles, totals and warnings, from sheet rows."""
    headers = stage(RG.detect_header(rows), "headers")
    data = stage(RG.data_rows(rows, headers), "sheet-rows")
    body, declared = RG.split_total_rows(data)
    filled = stage(RG.group_rows(body), "group-rows")
    found = RG.group_population(filled)
    groups = stage(ordinal(found, [JOB], ["ord_at"], "_no").withColumn("ord", F.col("_no") - 1).drop("_no"), "groups")
    details = stage(RG.detail_rows(rows, groups), "details")
    totals = RG.total_check(groups, declared)
    return {
        "groups": groups,
        "group_values": RG.enrich_from_details(RG.group_values(filled), details),
        "totals": totals,
        "ignored_headers": RG.ignored_person_headers(headers),
        "warnings": RG.extraction_warnings(groups, totals).unionByName(
            RG.missing_details(groups, details).select(
                JOB, F.col("code").alias("source_id"), F.lit("details_missing").alias("code")
            )
        ),
    }


def media_of(units: DataFrame, groups: DataFrame, official: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Media with context, role and official code, and warnings."""
    context = M.nearest_context(units)
    sizes = units.where("kind = 'image'").select(JOB, "ord", "width", "height")
    found = context.join(sizes, [JOB, "ord"])
    numbered = ordinal(found, [JOB], ["ord"], "_no").withColumn(
        "image_id", SG.ordinal_id(F.col("_no") - 1, "psico-image-", 4)
    ).drop("_no")
    named = stage(M.default_first_role(numbered), "media")
    associated = RC.associate_media(
        RC.with_hints(named.withColumnRenamed("code_hint", "block_code"), "block_code", "name_hint"), official, mode
    )
    by_text = stage(
        associated.select(JOB, "image_id", "ord", "role", "width", "height", "block_code", "official_code", "warning"),
        "associated",
    )
    known = named.groupBy(JOB, F.coalesce("code_hint", F.lit("")).alias("_b")).agg(F.lit(1).alias("_x")).groupBy(JOB).agg(
        F.count("_x").alias("n_blocks")
    )
    placed, surplus = M.segment_by_geometry(
        by_text.select(JOB, "image_id", "ord", "width", "height"), groups, known
    )
    placed = stage(placed, "placed")
    by_place = placed.select(
        JOB, "image_id", "ord", "role", "width", "height", F.col("code").alias("block_code"),
        F.col("code").alias("official_code"), F.lit(None).cast("string").alias("warning"),
    )
    media = by_text.join(placed.select(JOB).distinct(), JOB, "left_anti").unionByName(by_place)
    warnings = media.where("warning is not null").select(JOB, F.col("image_id").alias("source_id"), F.col("warning").alias("code"))
    return media, warnings.unionByName(surplus.select(JOB, F.lit(None).cast("string").alias("source_id"), F.col("warning").alias("code")))


def technical(units: DataFrame) -> dict[str, DataFrame]:
    """Sections, analyses, priorities, actions and conclusions of technical reports."""
    per_source = SG.segment_sections(units, [JOB, "source_ord"])
    segmented = stage(
        per_source.withColumn("section_no", F.col("source_ord") * _SOURCE_STEP + F.col("section_no")).withColumn(
            "ord", F.col("source_ord") * _SOURCE_STEP + F.col("ord")
        ),
        "segmented",
    )
    items = AN.section_items(segmented, [JOB])
    sections = segmented.groupBy(JOB, "section_no").agg(
        F.min_by(F.struct("section_title", "category", "group_code", "source_role"), "ord").alias("_s")
    ).select(JOB, "section_no", "_s.*")
    tables = segmented.where("size(rows) > 0")
    analyses = AN.build_analyses(items, [JOB])
    return {
        "sections": stage(sections, "sections"),
        "sources": units.select(JOB, "source_role").distinct(),
        "items": items,
        "tables": tables,
        "analyses": stage(
            analyses.select(
                JOB, F.concat(F.lit("technical-analysis-"), "group_code").alias("analysis_id"),
                F.col("first_section").alias("ord"), "group_code", "group_name", "favorable_percentage",
                "classification", "n_readings", F.lit(1).cast("bigint").alias("n_content"),
            ),
            "analyses",
        ),
        "priorities": AN.priority_rows(tables, [JOB]),
        "actions": AN.action_rows(tables, [JOB]),
        "conclusions": AN.conclusion(items, [JOB]),
    }


def validate(inputs: Inputs, mode: str = "sequence") -> dict[str, DataFrame]:
    """Everything from raw units to issues and a status, for all jobs."""
    reg = registry(inputs.sheet_rows)
    groups = reg["groups"]
    official = stage(RC.official_groups(groups.select(JOB, "ord", "code", "name")), "registry")
    segmented = stage(SG.segment_blocks(inputs.block_units, [JOB]), "blocks")
    blocks = stage(RC.with_hints(SG.blocks_of(segmented, [JOB])), "block-list")
    plan = stage(RC.build_plan(blocks, official, mode), "plan")
    media, media_warnings = media_of(inputs.media_units, groups, official, mode)
    media = stage(media, "media")
    tech = technical(inputs.report_units)
    warnings = (
        media_warnings.withColumn("origin", F.lit("psychosocial_extraction"))
        .unionByName(EV.media_warnings(inputs.jobs, media).withColumn("origin", F.lit("psychosocial_extraction")))
        .unionByName(EV.block_warnings(inputs.jobs, blocks, inputs.block_units).withColumn("origin", F.lit("ergo_extraction")))
        .unionByName(EV.technical_warnings(inputs.jobs, tech["sections"]).withColumn("origin", F.lit("technical_extraction")))
        .unionByName(Q.reconciliation_warnings(plan).withColumn("origin", F.lit("reconciliation")))
        .withColumn("_at", F.xxhash64("source_id", "code"))
    )
    numbered = ordinal(
        warnings, [JOB, "origin"], ["_at", "source_id", "code"], "_no", F.floor(F.col("_at") / (1 << 48))
    ).withColumn("ord", F.col("_no") - 1).withColumn("message", F.concat_ws(" ", "code", "source_id"))
    tables = {
        "jobs": inputs.jobs,
        "groups": groups,
        "blocks": blocks,
        "plan": plan,
        "media": media,
        "sections": tech["sections"],
        "sources": tech["sources"],
        "analyses": tech["analyses"],
        "priorities": tech["priorities"],
        "actions": tech["actions"],
        "conclusions": tech["conclusions"],
        "exceptions": inputs.exceptions,
        "warnings": numbered,
    }
    issues = stage(EV.with_fields(Q.all_issues(tables, strict=False)), "issues")
    return {
        **tables,
        "evidence": EV.evidence(tables, issues),
        "official": official,
        "segmented": segmented,
        "items": tech["items"],
        "tables": tech["tables"],
        "group_values": reg["group_values"],
        "totals": reg["totals"],
        "registry_warnings": reg["warnings"],
        "issues": issues,
        "summary": C.run_summary(inputs.jobs, groups, plan, issues),
    }


def _questions(segmented: DataFrame, chosen: DataFrame) -> DataFrame:
    """Questions of the chosen blocks: their recognised table rows, else their labelled texts paired by number."""
    inside = segmented.where("block_no > 0").withColumn("block_ord", F.col("block_no") - 1).join(chosen, [JOB, "block_ord"])
    block = [JOB, "block_ord", "source_id", "place"]
    asked = stage(SG.question_rows_of(inside, block), "asked")
    labelled = SG.labelled_values(inside, [JOB]).withColumn("block_ord", F.col("block_no") - 1)
    paired = SG.zipped_questions(labelled, [JOB, "block_ord"]).join(asked.select(JOB, "block_ord").distinct(), [JOB, "block_ord"], "left_anti")
    fallback = paired.join(chosen, [JOB, "block_ord"]).select(
        *block, F.lit(None).cast(asked.schema["ord"].dataType).alias("ord"), F.col("item_no").cast(asked.schema["row_no"].dataType).alias("row_no"),
        "question", "answer", "note",
    )
    return asked.unionByName(fallback)


def generate(validated: dict[str, DataFrame], decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply review decisions, check strictly, and compile the tables of jobs without errors."""
    plan, errors = RC.apply_decisions(validated["plan"], decisions, validated["official"])
    plan = stage(plan, "decided")
    issues = stage(Q.all_issues({**validated, "plan": plan}, strict=True), "strict-issues")
    failed = issues.where("severity = 'error'").select(JOB).unionByName(errors.select(JOB)).distinct()
    ready = stage(validated["jobs"].join(failed, JOB, "left_anti"), "ready")

    def of_ready(df: DataFrame) -> DataFrame:
        return df.join(ready.select(JOB), JOB, "left_semi")

    blocks = RC.select_blocks_for_output(
        validated["blocks"], plan, validated["official"], validated["exceptions"]
    )
    chosen = stage(of_ready(blocks).select(JOB, F.col("ord").alias("block_ord"), "source_id", "place"), "chosen")
    questions = stage(_questions(validated["segmented"], chosen), "questions")
    return {
        "plan": plan,
        "issues": issues,
        "decision_errors": errors,
        "ready": ready,
        "groups": of_ready(RG.with_total(validated["groups"])),
        "diagnostics": C.diagnostic_summary(ready, of_ready(validated["groups"])),
        "blocks": of_ready(blocks),
        "questions": questions,
        "answer_counts": SG.answer_counts(questions, [JOB, "block_ord", "source_id", "place"]),
        "texts": of_ready(AN.pivot_sections(validated["items"], [JOB])),
        "priorities": of_ready(C.priority_table(validated["priorities"])),
        "actions": of_ready(C.action_table(validated["actions"])),
        "conclusions": of_ready(validated["conclusions"]),
    }
