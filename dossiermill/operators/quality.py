"""Data-quality rules that emit issue rows: ``job_id, severity, code, source_id``.

Facts are aggregated once per table and job and joined to the jobs; all rules
that compare facts of a job are then one expression over one row. Rules about
single groups, items or files are filters and anti-joins. Nothing raises: one
tenant's bad input gives issue rows and leaves the other jobs alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import is_competence, is_iso_date, norm_ext
from .analyses import analysis_for_group, coverage_gaps, mode_check
from .media import media_coverage
from .reconcile import multi_assignment, scope_mismatch, unknown_targets

JOB = "job_id"


def _severity(code: Column, strict: bool) -> Column:
    result = F.lit("error")
    for name, (severity, _) in rules.ISSUES.items():
        if name in rules.COVERAGE_CODES and not strict:
            severity = "warning"
        if severity != "error":
            result = F.when(code == name, severity).otherwise(result)
    return result


def message_of(code: Column) -> Column:
    result = F.lit(None).cast("string")
    for name, (_, message) in rules.ISSUES.items():
        result = F.when(code == name, message).otherwise(result)
    return result


def with_messages(issues: DataFrame) -> DataFrame:
    """Issues with the catalogue's ``message`` of their code; NULL for codes outside it."""
    return issues.withColumn("message", message_of(F.col("code")))


def issue_rows(df: DataFrame, code: str | Column, source: str | Column | None = None) -> DataFrame:
    """Rows of a rule as issues, severity still to be set."""
    code_col = F.lit(code) if isinstance(code, str) else code
    source_col = F.lit(None).cast("string") if source is None else (F.col(source) if isinstance(source, str) else source)
    return df.select(JOB, code_col.alias("code"), source_col.cast("string").alias("source_id"))


def _explode_codes(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One issue row per condition that holds on a row."""
    raised = F.array_compact(F.array(*[F.when(test, code) for code, test in conditions.items()]))
    return issue_rows(df.select(JOB, F.explode(raised).alias("_code")), F.col("_code"))


def _count(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    value = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.groupBy(JOB).agg(value.alias(name))


def job_facts(t: dict[str, DataFrame]) -> DataFrame:
    """Jobs with the counts all job-level rules look at."""
    groups = t["groups"].groupBy(JOB).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("population").alias("population")
    )
    repeated = (
        t["groups"].groupBy(JOB, "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy(JOB)
        .agg(F.count(F.lit(1)).alias("n_repeated"))
    )
    mismatch = _count(scope_mismatch(t["blocks"], t["plan"], [JOB, "source_id"]), "n_mismatch")
    media = t["media"].groupBy(JOB).agg(
        F.count(F.lit(1)).alias("n_media"), F.count_if(F.col("role") == "general_panel").alias("n_panels")
    )
    sections = t["sections"].groupBy(JOB).agg(
        F.count(F.lit(1)).alias("n_sections"),
        *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in rules.REQUIRED_CATEGORIES],
    )
    exceptions = t["exceptions"].groupBy(JOB).agg(
        F.count(F.lit(1)).alias("n_exceptions"), F.bool_and("acknowledged").alias("acknowledged")
    )
    unknown = _count(
        t["exceptions"].join(t["blocks"].select(JOB, "source_id").distinct(), [JOB, "source_id"], "left_anti"),
        "n_unknown_blocks",
    )
    wrong_mode = mode_check(t["jobs"], t["sources"]).select(JOB, F.lit(1).cast("bigint").alias("n_wrong_mode"))
    facts = t["jobs"]
    for part in (
        groups, repeated, _count(t["blocks"], "n_blocks"), mismatch, media, sections, exceptions, unknown, wrong_mode,
        _count(t["priorities"], "n_priority_rows"), _count(t["actions"], "n_action_rows"),
        _count(t["conclusions"], "n_conclusion_rows"),
    ):
        facts = facts.join(part, JOB, "left")
    counted = [c for c in facts.columns if c.startswith("n_")]
    return facts.fillna(0, subset=[*counted, "population"])


def _empty(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)), F.lit("")) == ""


def job_rules(facts: DataFrame) -> DataFrame:
    """Issues that follow from the facts of a job."""
    f = F.col
    return _explode_codes(
        facts,
        {
            "legal_name_missing": _empty("legal_name"),
            "registration_card_missing": ~F.coalesce(f("has_card"), F.lit(False)),
            "competence_missing": _empty("competence"),
            "ergo_base_date_missing": _empty("ergo_base_date"),
            "psychosocial_base_date_missing": _empty("psychosocial_base_date"),
            "official_ghes_missing": f("n_groups") == 0,
            "duplicate_official_ghe": f("n_repeated") > 0,
            "population_missing": f("population") <= 0,
            "ergo_blocks_missing": f("n_blocks") == 0,
            "reconciliation_scope_mismatch": f("n_mismatch") > 0,
            "psychosocial_images_missing": f("n_media") == 0,
            "general_panel_not_identified": (f("n_media") > 0) & (f("n_panels") == 0),
            "technical_mode_sources_invalid": f("n_wrong_mode") > 0,
            "technical_sections_missing": f("n_sections") == 0,
            "prioritization_missing": f("n_prioritization") == 0,
            "action_plan_missing": f("n_action_plan") == 0,
            "technical_conclusion_missing": f("n_conclusion") == 0,
            "action_plan_rows_missing": (f("n_action_plan") > 0) & (f("n_action_rows") == 0),
            "prioritization_rows_missing": (f("n_prioritization") > 0) & (f("n_priority_rows") == 0),
            "conclusion_text_missing": (f("n_conclusion") > 0) & (f("n_conclusion_rows") == 0),
            "private_compatibility_mode": f("n_exceptions") > 0,
            "compatibility_not_acknowledged": (f("n_exceptions") > 0) & ~F.coalesce(f("acknowledged"), F.lit(False)),
            "compatibility_unknown_ergo_block": f("n_unknown_blocks") > 0,
        },
    )


def stage_rules(facts: DataFrame) -> DataFrame:
    """Issues that stop a job because one extraction came back empty (swapped files)."""
    f = F.col
    technical = f("n_sections") + f("n_priority_rows") + f("n_action_rows") + f("n_conclusion_rows")
    return _explode_codes(
        facts,
        {
            "ghe_spreadsheet_empty": f("n_groups") == 0,
            "ergo_report_empty": f("n_blocks") == 0,
            "psychosocial_report_empty": f("n_media") == 0,
            "technical_report_empty": technical == 0,
        },
    )


def all_issues(t: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """Issues of the rules and of empty extractions, with messages."""
    stops = stage_rules(job_facts(t)).select(JOB, F.lit("error").alias("severity"), "code", "source_id")
    return with_messages(run_rules(t, strict).unionByName(stops))


def propagated_warnings(warnings: DataFrame) -> DataFrame:
    """Warnings of extraction and reconciliation, ``source_id = <code>-<n>``.

    ``warnings``: ``job_id, origin, ord`` with ``ord`` counting from 0 per job and origin.
    """
    code = F.concat("origin", F.lit("_warning"))
    return issue_rows(warnings, code, F.concat(code, F.lit("-"), (F.col("ord") + 1).cast("string")))


def run_rules(t: dict[str, DataFrame], strict: bool = False) -> DataFrame:
    """All rules over the normalised tables of all jobs.

    ``strict`` is the check before generation: pending items become errors and
    coverage gaps are errors rather than warnings.

    Tables: ``jobs, groups, blocks, plan, media, sections, sources, analyses,
    priorities, actions, conclusions, exceptions, warnings``.
    """
    groups, plan = t["groups"], t["plan"]
    analysed = analysis_for_group(groups, t["analyses"], "validate").join(
        t["analyses"].where("n_content > 0").select(JOB, "analysis_id").distinct(), [JOB, "analysis_id"], "left_semi"
    )
    parts = [
        job_rules(job_facts(t)),
        issue_rows(groups.where("population = 0"), "zero_ghe_population", "code"),
        issue_rows(plan.where("status = 'not_applicable'"), "ergo_block_not_applicable", "source_id"),
        issue_rows(unknown_targets(plan, groups), "reconciliation_target_unknown", "source_id"),
        issue_rows(coverage_gaps(groups, media_coverage(t["media"])), "psychosocial_ghe_image_missing", "code"),
        issue_rows(coverage_gaps(groups, analysed), "technical_ghe_analysis_missing", "code"),
        propagated_warnings(t["warnings"]),
    ]
    if strict:
        parts.append(issue_rows(plan.where("status = 'needs_review'"), "reconciliation_pending", "source_id"))
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    severity = F.when(F.col("code").endswith("_warning"), "warning").otherwise(_severity(F.col("code"), strict))
    return issues.withColumn("severity", severity).select(JOB, "severity", "code", "source_id")


def issue_summary(jobs: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts per severity, validity, and the error codes of each job.

    Issues are counted per code before they meet in one row, so the code list is
    as long as the rule catalogue at most.
    """
    per_code = issues.groupBy(JOB, "severity", "code").agg(F.count(F.lit(1)).alias("n"))
    errors = F.when(F.col("severity") == "error", F.col("code"))
    counted = per_code.groupBy(JOB).agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n"))).alias("n_errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n"))).alias("n_warnings"),
        F.array_join(F.array_sort(F.collect_set(errors)), ",").alias("error_codes"),
    )
    return jobs.select(JOB).join(counted, JOB, "left").select(
        JOB,
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
        F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"),
        (F.coalesce("n_errors", F.lit(0)) == 0).alias("valid"),
        F.coalesce("error_codes", F.lit("")).alias("error_codes"),
    )


# --- files -----------------------------------------------------------------------


def policy_table(spark: SparkSession, policies: dict = rules.UPLOAD_POLICIES) -> DataFrame:
    """``role, extensions, kinds, max_bytes, required``: one row per role."""
    return spark.createDataFrame(
        [(role, ext, kinds, size, needed) for role, (ext, kinds, size, needed) in policies.items()],
        "role string, extensions array<string>, kinds array<string>, max_bytes bigint, required boolean",
    )


def policy_check(artifacts: DataFrame, policy: DataFrame) -> DataFrame:
    """Issues of stored files against the policy of their role; ``source_id`` is the role."""
    extension, kind = F.col("extension"), F.col("kind")
    fits = F.lit(False)
    for ext, kinds in rules.EXTENSION_KINDS.items():
        fits = fits | ((extension == ext) & kind.isin(kinds))
    if "available" in artifacts.columns:
        # nothing is known of a file that cannot be read: presence_check reports it
        artifacts = artifacts.where(F.coalesce("available", F.lit(True)))
    joined = artifacts.withColumn("extension", norm_ext("extension")).join(policy, "role")
    tests = {
        "extension_not_allowed": ~F.array_contains("extensions", extension),
        "empty_file": F.col("size_bytes") == 0,
        "file_too_large": F.col("size_bytes") > F.col("max_bytes"),
        "real_type_not_allowed": ~F.array_contains("kinds", kind),
        "extension_content_mismatch": (extension != ".") & (kind != "unknown") & ~fits,
        "legacy_conversion_required": kind == "ole_doc",
        "html_active_content_ignored": (kind == "html_doc") & F.coalesce(F.col("active_content"), F.lit(False)),
    }
    raised = F.array_compact(F.array(*[F.when(test, code) for code, test in tests.items()]))
    issues = joined.select(JOB, "role", F.explode(raised).alias("code"))
    return issues.select(JOB, _severity(F.col("code"), True).alias("severity"), "code", F.col("role").alias("source_id"))


def presence_check(jobs: DataFrame, artifacts: DataFrame, policy: DataFrame) -> DataFrame:
    """Required roles without a file, and files that cannot be read: ``job_id, severity, code, source_id``.

    Roles are required by ``policy``, or by the column ``roles`` of ``jobs`` where it has
    one. ``artifacts`` may carry ``available``; files without it count as readable.
    """
    if "roles" in jobs.columns:
        wanted = jobs.select(JOB, F.explode("roles").alias("role"))
    else:
        roles = [r["role"] for r in policy.where("required").select("role").collect()]  # a row a role
        wanted = jobs.select(JOB, F.explode(F.array(*map(F.lit, roles)).cast("array<string>")).alias("role"))
    absent = wanted.join(artifacts.select(JOB, "role").distinct(), [JOB, "role"], "left_anti").withColumn("code", F.lit("required_file_missing"))
    found = absent.select(JOB, "code", "role")
    if "available" in artifacts.columns:
        gone = artifacts.where(~F.coalesce("available", F.lit(True))).select(JOB, F.lit("file_unavailable").alias("code"), "role")
        found = found.unionByName(gone)
    return found.select(JOB, _severity(F.col("code"), True).alias("severity"), "code", F.col("role").alias("source_id"))


def missing_inputs(jobs: DataFrame, artifacts: DataFrame, required: dict = rules.REQUIRED_ROLES) -> DataFrame:
    """Required roles of each job's mode that have no file: ``job_id, role``."""
    wanted = F.array().cast("array<string>")
    for mode, roles in required.items():
        wanted = F.when(F.col("analysis_mode") == mode, F.array(*[F.lit(r) for r in roles])).otherwise(wanted)
    return (
        jobs.select(JOB, F.explode(wanted).alias("role"))
        .join(artifacts.select(JOB, "role").distinct(), [JOB, "role"], "left_anti")
    )


def archive_safety(members: DataFrame, policy: str = "lenient") -> DataFrame:
    """Issues of package members: ``artifact_id, code``.

    ``members``: ``artifact_id, ord, name, file_size, compress_size, flag_bits,
    external_attr, is_dir``. The lenient policy reads members in order and stops at
    the first bad one; the strict one reports every rule that is broken.
    """
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    lower = F.lower(name)
    if policy == "lenient":
        p = rules.LENIENT_PACKAGE
        unsafe = name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)")
        encrypted = F.col("flag_bits").bitwiseAND(1) == 1
        inflated = (
            (F.col("file_size") > p["ratio_from"])
            & (F.col("compress_size") > 0)
            & (F.col("file_size") > F.col("compress_size") * p["ratio"])
        )
        bad = (
            F.when(unsafe, "unsafe_archive_path")
            .when(encrypted, "encrypted_archive_entry")
            .when(inflated, "suspicious_compression_ratio")
        )
        judged = members.withColumn("_bad", bad).withColumn(
            "_active", lower.endswith("vbaproject.bin") | lower.contains("/embeddings/")
        )
        stops = judged.groupBy("artifact_id").agg(
            F.min_by(F.struct("ord", "_bad"), F.when(F.col("_bad").isNotNull(), F.col("ord"))).alias("_stop"),
            F.count(F.lit(1)).alias("n_members"),
            F.bool_or("_active").alias("_active"),
        )
        # sizes count up to the stop; an unsafe path stops before its own size is added
        read = (
            judged.select("artifact_id", "ord", "file_size")
            .join(stops.select("artifact_id", "_stop"), "artifact_id")
            .where(
                F.col("_stop").isNull()
                | (F.col("ord") < F.col("_stop.ord"))
                | ((F.col("ord") == F.col("_stop.ord")) & (F.col("_stop._bad") != "unsafe_archive_path"))
            )
            .groupBy("artifact_id")
            .agg(F.sum("file_size").alias("_total"))
        )
        tests = [
            F.when(F.col("n_members") > p["max_members"], "archive_too_many_entries"),
            F.col("_stop._bad"),
            F.when(F.coalesce("_total", F.lit(0)) > p["max_total"], "archive_expanded_size"),
            F.when(F.col("_active"), "active_or_embedded_content"),
        ]
        rolled = stops.join(read, "artifact_id", "left")
    else:
        p = rules.STRICT_PACKAGE
        folder = F.col("is_dir") | name.endswith("/")
        path = F.when(folder, F.regexp_replace(name, "/+$", "")).otherwise(name)
        parts = F.split(path, "/")
        unsafe = (
            (path == "")
            | path.startswith("/")
            | F.exists(parts, lambda x: x.isin("", ".", ".."))
            | F.element_at(parts, 1).contains(":")
        )
        mode = F.shiftright("external_attr", 16).bitwiseAND(0xFFFF)
        folded = F.lower(path)
        size = F.when(~folder, F.col("file_size")).otherwise(0)
        repeated = (
            members.groupBy("artifact_id", folded.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("artifact_id").agg((F.max("n") > 1).alias("_repeated"))
        )
        rolled = members.groupBy("artifact_id").agg(
            F.count(F.lit(1)).alias("n_members"),
            F.bool_or(unsafe).alias("_unsafe"),
            F.bool_or(F.col("flag_bits").bitwiseAND(1) == 1).alias("_encrypted"),
            F.bool_or(mode.bitwiseAND(0xF000) == 0xA000).alias("_link"),
            F.bool_or(size > p["max_member"]).alias("_large"),
            F.sum(size).alias("_total"),
            F.bool_or(
                (size >= p["ratio_from"]) & (size > F.greatest("compress_size", F.lit(1)) * p["ratio"])
            ).alias("_inflated"),
            F.bool_or(folded.endswith("/vbaproject.bin") | folded.endswith("/vbaprojectsignature.bin")).alias("_macros"),
        ).join(repeated, "artifact_id")
        tests = [
            F.when(F.col("n_members") > p["max_members"], "too_many_members"),
            F.when(F.col("_unsafe"), "unsafe_path"),
            F.when(F.col("_repeated"), "duplicate_member"),
            F.when(F.col("_encrypted"), "encrypted_member"),
            F.when(F.col("_link"), "linked_member"),
            F.when(F.col("_large"), "large_member"),
            F.when(F.col("_total") > p["max_total"], "large_package"),
            F.when(F.col("_inflated"), "inflated_member"),
            F.when(F.col("_macros"), "macros"),
        ]
    return rolled.select("artifact_id", F.explode(F.array_compact(F.array(*tests))).alias("code"))


# --- forms ------------------------------------------------------------------------

REQUIRED_FIELDS = ["company_name", "competence", "ergo_reference_date", "psychosocial_reference_date"]


def field_checks(forms: DataFrame) -> DataFrame:
    """Issues of form fields: ``job_id, code, field``. The first failing stage of a form counts."""
    blank = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) == "" for name in REQUIRED_FIELDS}
    any_blank = F.lit(False)
    for test in blank.values():
        any_blank = any_blank | test
    too_long = F.length("company_name") > rules.MAX_FIELD_CHARS

    def issue(code: str, field: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))

    def date_issue(name: str) -> Column:
        return F.when(~is_iso_date(F.col(name)), issue("invalid_date", name))

    found = (
        F.when(any_blank, F.array(*[F.when(test, issue("missing_fields", name)) for name, test in blank.items()]))
        .when(too_long, F.array(issue("field_too_long", "company_name")))
        .when(
            ~is_iso_date("ergo_reference_date") | ~is_iso_date("psychosocial_reference_date"),
            F.array(
                F.coalesce(date_issue("ergo_reference_date"), date_issue("psychosocial_reference_date"))
            ),
        )
        .when(~is_competence("competence"), F.array(issue("invalid_competence", "competence")))
    )
    return forms.select(JOB, F.explode(F.array_compact(found)).alias("i")).select(JOB, "i.*")


def upload_checks(uploads: DataFrame, aliases: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unknown, repeated and missing file fields: ``job_id, code, field``."""
    named = uploads.join(aliases, uploads["field"] == aliases["alias"], "left")
    unknown = named.where("canonical is null").select(JOB, F.lit("unexpected_file").alias("code"), "field")
    sent = named.where("canonical is not null").groupBy(JOB, F.col("canonical").alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )
    twice = sent.where("n > 1").select(JOB, F.lit("duplicate_file").alias("code"), F.col("role").alias("field"))
    absent = missing_inputs(jobs, sent).select(JOB, F.lit("missing_files").alias("code"), F.col("role").alias("field"))
    return unknown.unionByName(twice).unionByName(absent)


def normalize_messages(raw: DataFrame, keys: list[str], default_level: str) -> DataFrame:
    """``keys, level, code, message`` with fallbacks; empty messages are left out."""
    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))

    message = F.trim(F.coalesce(first("message", "mensagem", "detail", "code"), F.lit("")))
    return raw.select(
        *keys,
        F.coalesce(first("level", "severity"), F.lit(default_level)).alias("level"),
        F.coalesce(first("code"), F.lit(default_level)).alias("code"),
        message.alias("message"),
    ).where("message <> ''")


# --- records ------------------------------------------------------------------------


def unit_invariants(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose payload does not fit their kind."""
    rule = (
        F.when((F.col("kind") == "table") & (F.coalesce(F.size("rows"), F.lit(0)) <= 0), "table_without_rows")
        .when((F.col("kind") == "image") & F.col("image").isNull(), "image_without_metadata")
        .when(
            ~F.col("kind").isin("table", "image") & (F.coalesce(F.trim("text"), F.lit("")) == ""), "text_missing"
        )
    )
    return units.select(*keys, rule.alias("code")).where("code is not null")


def plan_invariants(plan: DataFrame) -> DataFrame:
    """Plan items whose status, target and reason do not fit."""
    status = F.col("status")
    rule = (
        F.when(status.isin("auto_matched", "confirmed") & F.col("official_code").isNull(), "match_without_target")
        .when((status == "not_applicable") & F.col("official_code").isNotNull(), "target_of_not_applicable")
        .when(
            status.isin("confirmed", "not_applicable") & (F.coalesce("decision_reason", F.lit("")) == ""),
            "decision_without_reason",
        )
    )
    return plan.select(JOB, "source_id", rule.alias("code")).where("code is not null")


def candidate_invariants(candidates: DataFrame) -> DataFrame:
    """Candidates without a target, or with a score that is none or outside 0 to 1: ``job_id, source_id, official_code, code``."""
    score = F.col("score").cast("double")
    rule = F.when(F.col("official_code").isNull(), "candidate_without_target").when(
        score.isNull() | F.isnan(score) | ~score.between(0.0, 1.0), "score_out_of_range"
    )
    return candidates.select(JOB, "source_id", "official_code", rule.alias("code")).where("code is not null")


def exception_invariants(exceptions: DataFrame) -> DataFrame:
    """Blocks that one exception both includes and omits."""
    return (
        exceptions.groupBy(JOB, "source_id")
        .agg(F.bool_or(F.col("action") == "include").alias("_i"), F.bool_or(F.col("action") == "omit").alias("_o"))
        .where("_i and _o")
        .select(JOB, "source_id", F.lit("included_and_omitted").alias("code"))
    )


def reconciliation_warnings(plan: DataFrame) -> DataFrame:
    """Warnings of a plan: per open block, and per code with several blocks."""
    open_items = plan.where("warning is not null").select(JOB, F.col("source_id").cast("string").alias("source_id"), F.col("warning").alias("code"))
    shared = multi_assignment(plan).select(JOB, F.col("official_code").alias("source_id"), F.lit("several_blocks").alias("code"))
    return open_items.unionByName(shared)


def contract_check(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Template contract against what the template holds: ``job_id, code``.

    ``manifest``: declared version, status, counts, marker count and digest, four
    capacities; ``actual``: the recomputed counts, marker count and digest.
    """
    joined = manifest.join(actual, JOB, "left")
    capacity = ["capacity_groups", "capacity_blocks", "capacity_media", "capacity_sections"]
    same = F.col(capacity[0]) > 0
    for name in capacity[1:]:
        same = same & (F.col(name) == F.col(capacity[0]))

    def differs(a: str, b: str) -> Column:
        return ~F.col(a).eqNullSafe(F.col(b))

    return _contract_codes(
        joined,
        {
            "contract_version": ~((F.col("status") == "sanitized") & (F.col("contract_version") == 1)),
            "structure_differs": differs("paragraph_count", "n_paragraphs") | differs("table_count", "n_tables"),
            "markers_differ": ~(F.col("marker_count") > 0)
            | differs("marker_count", "n_markers")
            | differs("marker_digest", "digest"),
            "capacity_invalid": ~same,
        },
    )


def _contract_codes(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    raised = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), c) for c, t in tests.items()]))
    return df.select(JOB, F.explode(raised).alias("code"))
