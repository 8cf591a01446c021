"""Queries of the data-quality rules, file policies, forms and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import analyses as AN
from ..operators import compiled as C
from ..operators import evidence as E
from ..operators import quality as D
from ..operators import reconcile as R
from ..plans.staging import new_path, stage
from ..sinks import reports as SN
from ..sources.artifacts import alias_table
from . import sqltext as Q
from .inputs import cte, derive, load
from .registry import query

_TABLES = [
    "jobs", "groups", "blocks", "plan", "media", "sections", "sources", "analyses", "priorities", "actions",
    "conclusions", "exceptions", "warnings",
]
_DQ = cte(*[f"dq_{t}" for t in _TABLES])


def tables(spark, sf):
    return {t: derive(spark, sf, f"dq_{t}") for t in _TABLES}


def _empty(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


_FACTS = f"""{_DQ}, fj AS (SELECT j.*,
    (SELECT count(*) FROM dq_groups g WHERE g.job_id = j.job_id) AS n_groups, (SELECT coalesce(sum(population), 0) FROM dq_groups g WHERE g.job_id = j.job_id) AS population,
    (SELECT count(*) FROM dq_blocks b WHERE b.job_id = j.job_id) AS n_blocks, (SELECT count(*) FROM dq_media m WHERE m.job_id = j.job_id) AS n_media,
    (SELECT count(*) FROM dq_media m WHERE m.job_id = j.job_id AND role = 'general_panel') AS n_panels, (SELECT count(*) FROM dq_sections s WHERE s.job_id = j.job_id) AS n_sections,
    (SELECT count(*) FROM dq_sections s WHERE s.job_id = j.job_id AND category = 'prioritization') AS n_prio, (SELECT count(*) FROM dq_sections s WHERE s.job_id = j.job_id AND category = 'action_plan') AS n_action,
    (SELECT count(*) FROM dq_sections s WHERE s.job_id = j.job_id AND category = 'conclusion') AS n_concl, (SELECT count(*) FROM dq_priorities s WHERE s.job_id = j.job_id) AS r_prio,
    (SELECT count(*) FROM dq_actions s WHERE s.job_id = j.job_id) AS r_action, (SELECT count(*) FROM dq_conclusions s WHERE s.job_id = j.job_id) AS r_concl,
    (SELECT count(*) FROM dq_exceptions e WHERE e.job_id = j.job_id) AS n_exc, (SELECT bool_and(acknowledged) FROM dq_exceptions e WHERE e.job_id = j.job_id) AS ack,
    (SELECT count(*) FROM dq_exceptions e WHERE e.job_id = j.job_id AND (e.job_id, e.source_id) NOT IN (SELECT (job_id, source_id) FROM dq_blocks)) AS n_unknown,
    (SELECT string_agg(source_role, ',' ORDER BY source_role) FROM dq_sources s WHERE s.job_id = j.job_id) AS roles,
    (SELECT count(*) FROM (SELECT job_id, source_id FROM dq_blocks EXCEPT SELECT job_id, source_id FROM dq_plan) x WHERE x.job_id = j.job_id) + (SELECT count(*) FROM (SELECT job_id, source_id FROM dq_plan EXCEPT SELECT job_id, source_id FROM dq_blocks) x WHERE x.job_id = j.job_id) AS n_mismatch
    FROM dq_jobs j)"""
_JOB_RULES = {
    "legal_name_missing": _empty("legal_name"),
    "registration_card_missing": "NOT has_card",
    "competence_missing": _empty("competence"),
    "ergo_base_date_missing": _empty("ergo_base_date"),
    "psychosocial_base_date_missing": _empty("psychosocial_base_date"),
    "official_ghes_missing": "n_groups = 0",
    "population_missing": "population <= 0",
    "ergo_blocks_missing": "n_blocks = 0",
    "reconciliation_scope_mismatch": "n_mismatch > 0",
    "psychosocial_images_missing": "n_media = 0",
    "general_panel_not_identified": "n_media > 0 AND n_panels = 0",
    "technical_mode_sources_invalid": "coalesce(roles, '') <> CASE WHEN analysis_mode = 'integrated' THEN 'integrated' ELSE 'ergonomic_agent,psychosocial_agent' END",
    "technical_sections_missing": "n_sections = 0",
    "prioritization_missing": "n_prio = 0",
    "action_plan_missing": "n_action = 0",
    "technical_conclusion_missing": "n_concl = 0",
    "action_plan_rows_missing": "n_action > 0 AND r_action = 0",
    "prioritization_rows_missing": "n_prio > 0 AND r_prio = 0",
    "conclusion_text_missing": "n_concl > 0 AND r_concl = 0",
    "private_compatibility_mode": "n_exc > 0",
    "compatibility_not_acknowledged": "n_exc > 0 AND NOT ack",
    "compatibility_unknown_ergo_block": "n_unknown > 0",
}
_WARN = "('general_panel_not_identified', 'private_compatibility_mode', 'zero_ghe_population', 'ergo_block_not_applicable')"
_COVER = "('psychosocial_ghe_image_missing', 'technical_ghe_analysis_missing', 'action_plan_rows_missing', 'prioritization_rows_missing', 'conclusion_text_missing')"


def _issues_sql(strict: bool) -> str:
    job = " UNION ALL ".join(f"SELECT job_id, '{c}' AS code, NULL AS source_id FROM fj WHERE {w}" for c, w in _JOB_RULES.items())
    pending = "UNION ALL SELECT job_id, 'reconciliation_pending', source_id FROM dq_plan WHERE status = 'needs_review'" if strict else ""
    soft = "" if strict else f"WHEN code IN {_COVER} THEN 'warning'"
    return f"""{_FACTS}, an AS (SELECT g.job_id, g.code, first(a.n_content ORDER BY a.ord) AS n_content FROM dq_groups g JOIN dq_analyses a ON a.job_id = g.job_id
      AND ({Q.code('a.group_code')} = g.code OR contains({Q.key('a.group_name')}, {Q.key('g.name')})) GROUP BY 1, 2),
    i AS ({job} UNION ALL SELECT job_id, 'zero_ghe_population', code FROM dq_groups WHERE population = 0
      UNION ALL SELECT job_id, 'ergo_block_not_applicable', source_id FROM dq_plan WHERE status = 'not_applicable'
      UNION ALL SELECT job_id, 'reconciliation_target_unknown', source_id FROM dq_plan WHERE official_code IS NOT NULL AND (job_id, official_code) NOT IN (SELECT (job_id, code) FROM dq_groups)
      UNION ALL SELECT job_id, 'psychosocial_ghe_image_missing', code FROM dq_groups WHERE (job_id, code) NOT IN (SELECT (job_id, official_code) FROM dq_media WHERE official_code IS NOT NULL)
      UNION ALL SELECT g.job_id, 'technical_ghe_analysis_missing', g.code FROM dq_groups g LEFT JOIN an ON an.job_id = g.job_id AND an.code = g.code WHERE coalesce(an.n_content, 0) = 0
      UNION ALL SELECT job_id, origin || '_warning', origin || '_warning-' || (ord + 1) FROM dq_warnings {pending}),
    issues AS (SELECT job_id, CASE WHEN ends_with(code, '_warning') OR code IN {_WARN} THEN 'warning' {soft} ELSE 'error' END AS severity, code, source_id FROM i)"""


@query("dq_rules", f"{_issues_sql(False)} SELECT job_id, severity, code, source_id FROM issues")
def dq_rules(spark, sf):
    return D.run_rules(tables(spark, sf), strict=False)


@query("dq_rules_strict", f"{_issues_sql(True)} SELECT job_id, severity, code, source_id FROM issues")
def dq_rules_strict(spark, sf):
    return D.run_rules(tables(spark, sf), strict=True)


_SUMMARY = """SELECT j.job_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS valid,
    coalesce(string_agg(DISTINCT code, ',' ORDER BY code) FILTER (WHERE severity = 'error'), '') AS error_codes FROM dq_jobs j LEFT JOIN issues i ON i.job_id = j.job_id GROUP BY j.job_id"""


@query("ag_issue_summary", f"{_issues_sql(True)} {_SUMMARY}")
def ag_issue_summary(spark, sf):
    t = tables(spark, sf)
    return D.issue_summary(t["jobs"], D.run_rules(t, strict=True))


@query(
    "dq_stage_rules",
    f"{_FACTS} SELECT job_id, code, NULL AS source_id FROM (SELECT job_id, 'technical_report_empty' AS code FROM fj WHERE n_sections + r_prio + r_action + r_concl = 0 UNION ALL SELECT job_id, 'psychosocial_report_empty' FROM fj WHERE n_media = 0 "
    "UNION ALL SELECT job_id, 'ergo_report_empty' FROM fj WHERE n_blocks = 0 UNION ALL SELECT job_id, 'ghe_spreadsheet_empty' FROM fj WHERE n_groups = 0 "
    "UNION ALL SELECT c_name, unnest(['ghe_spreadsheet_empty', 'ergo_report_empty', 'psychosocial_report_empty', 'technical_report_empty']) FROM customer) AS s",
)
def dq_stage_rules(spark, sf):
    """With jobs added for which no extraction gave anything."""
    t = tables(spark, sf)
    blank = load(spark, sf, "customer").select(
        F.col("c_name").alias("job_id"), F.lit("x").alias("legal_name"), F.lit(True).alias("has_card"), F.lit("2024-01").alias("competence"),
        F.lit("d").alias("ergo_base_date"), F.lit("d").alias("psychosocial_base_date"), F.lit("integrated").alias("analysis_mode"),
    )
    return D.stage_rules(D.job_facts({**t, "jobs": t["jobs"].unionByName(blank)}))


@query(
    "ag_run_summary",
    f"""{_issues_sql(False)} SELECT job_id, n_groups, population::BIGINT AS total_population, n_items, n_open, n_errors, CASE WHEN n_errors > 0 THEN 'validation_failed' WHEN n_items > 0 THEN 'needs_reconciliation' ELSE 'validated' END AS status,
      n_groups || CASE WHEN n_groups = 1 THEN ' grupo' ELSE ' grupos' END AS groups_label FROM (SELECT fj.job_id, n_groups, population, (SELECT count(*) FROM dq_plan p WHERE p.job_id = fj.job_id) AS n_items,
      (SELECT count(*) FROM dq_plan p WHERE p.job_id = fj.job_id AND status = 'needs_review') AS n_open, (SELECT count(*) FROM issues i WHERE i.job_id = fj.job_id AND severity = 'error') AS n_errors FROM fj) AS z""",
)
def ag_run_summary(spark, sf):
    t = tables(spark, sf)
    return C.run_summary(t["jobs"], t["groups"], t["plan"], D.run_rules(t, strict=False))


@query(
    "ag_diagnostic_summary",
    f"""{_DQ}, g AS (SELECT job_id, sum(population) AS p FROM dq_groups GROUP BY 1)
    SELECT job_id, line, 1::BIGINT AS part, value FROM (SELECT j.job_id, unnest([1, 2, 3]) AS line, unnest(['Formulário ERGO – levantamento de ' || coalesce(ergo_base_date, ''), 'Formulário HSE – relatório emitido em ' || coalesce(psychosocial_base_date, ''),
      CAST(coalesce(p, 0) AS BIGINT) || ' colaboradores']) AS value FROM dq_jobs j LEFT JOIN g ON g.job_id = j.job_id) AS x
    UNION ALL SELECT job_id, 4, row_number() OVER (PARTITION BY job_id ORDER BY ord), code FROM dq_groups""",
)
def ag_diagnostic_summary(spark, sf):
    return C.diagnostic_summary(derive(spark, sf, "dq_jobs"), derive(spark, sf, "dq_groups"))


_FIELDS_SQL = " ".join(f"WHEN code IN ({', '.join(repr(c) for c in codes)}) THEN '{field}'" for field, codes in rules.ISSUE_FIELDS.items())
_ISSUE_ID = "md5(job_id || chr(31) || code || chr(31) || coalesce(source_id, ''))"


@query("dq_issue_fields", f"{_issues_sql(True)} SELECT {_ISSUE_ID} AS issue_id, job_id, code, source_id, CASE {_FIELDS_SQL} END AS field FROM issues")
def dq_issue_fields(spark, sf):
    return E.with_fields(D.run_rules(tables(spark, sf), strict=True)).select("issue_id", "job_id", "code", "source_id", "field")


@query(
    "dq_evidence",
    f"""{_issues_sql(False)}, bad AS (SELECT job_id, analysis_mode FROM fj WHERE EXISTS (FROM issues i WHERE i.job_id = fj.job_id AND i.code = 'technical_mode_sources_invalid')),
    e AS (SELECT job_id, 'duplicate_official_ghe' AS code, NULL::VARCHAR AS source_id, 'official_code' AS name, code AS value FROM dq_groups GROUP BY job_id, dq_groups.code HAVING count(*) > 1
      UNION ALL SELECT job_id, 'reconciliation_scope_mismatch', NULL, 'only_in_blocks', source_id FROM (SELECT job_id, source_id FROM dq_blocks EXCEPT SELECT job_id, source_id FROM dq_plan) AS x
      UNION ALL SELECT job_id, 'reconciliation_scope_mismatch', NULL, 'only_in_plan', source_id FROM (SELECT job_id, source_id FROM dq_plan EXCEPT SELECT job_id, source_id FROM dq_blocks) AS x
      UNION ALL SELECT job_id, 'technical_mode_sources_invalid', NULL, 'analysis_mode', analysis_mode FROM bad
      UNION ALL SELECT job_id, 'technical_mode_sources_invalid', NULL, 'source_role', source_role FROM dq_sources WHERE job_id IN (SELECT job_id FROM bad)
      UNION ALL SELECT job_id, 'private_compatibility_mode', NULL, CASE WHEN action = 'include' THEN 'included_source_id' ELSE 'omitted_source_id' END, source_id FROM dq_exceptions
      UNION ALL SELECT job_id, 'compatibility_not_acknowledged', NULL, 'source_id', source_id FROM dq_exceptions WHERE acknowledged IS NOT TRUE
      UNION ALL SELECT job_id, 'compatibility_unknown_ergo_block', NULL, 'source_id', source_id FROM dq_exceptions WHERE (job_id, source_id) NOT IN (SELECT (job_id, source_id) FROM dq_blocks)
      UNION ALL SELECT job_id, 'reconciliation_target_unknown', source_id, 'official_code', official_code FROM dq_plan WHERE official_code IS NOT NULL AND (job_id, official_code) NOT IN (SELECT (job_id, code) FROM dq_groups)
      UNION ALL SELECT job_id, origin || '_warning', origin || '_warning-' || (ord + 1), 'message', message FROM dq_warnings),
    k AS (SELECT {_ISSUE_ID} AS issue_id, * FROM e), c AS (SELECT issue_id, job_id, code, source_id, name, value, count(*) AS n FROM k WHERE issue_id IN (SELECT {_ISSUE_ID} FROM issues) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY name, value NULLS FIRST) - 1 AS no FROM c""",
)
def dq_evidence(spark, sf):
    t = tables(spark, sf)
    return E.evidence(t, D.run_rules(t, strict=False))


@query(
    "dq_report_warnings",
    f"""{_DQ}, u AS (SELECT p_brand AS job_id, p_partkey AS ord, CASE WHEN length(p_name) % 3 > 0 THEN p_retailprice END AS width FROM part)
    SELECT DISTINCT job_id, NULL::VARCHAR AS source_id, 'no_group_title' AS code FROM dq_jobs WHERE job_id NOT IN (SELECT job_id FROM dq_blocks)
    UNION ALL SELECT DISTINCT job_id, NULL, 'no_image' FROM dq_jobs WHERE job_id NOT IN (SELECT job_id FROM u)
    UNION ALL SELECT job_id, 'img-' || ord, 'image_format_unknown' FROM u WHERE width IS NULL
    UNION ALL SELECT job_id, category, 'category_missing' FROM (SELECT DISTINCT job_id, unnest([{', '.join(repr(c) for c in rules.REQUIRED_CATEGORIES)}]) AS category FROM dq_jobs) AS n WHERE (job_id, category) NOT IN (SELECT (job_id, category) FROM dq_sections)
    UNION ALL SELECT page_id::VARCHAR, page_id::VARCHAR, 'image_unresolved' FROM (SELECT page_id, url AS ref FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://', '') FROM pages) AS p WHERE regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_extract(ref, '^[^?#]*') = ''""",
)
def dq_report_warnings(spark, sf):
    """Images of the parts, and references of the pages, with and without a scheme."""
    t = tables(spark, sf)
    pictures = load(spark, sf, "part").select(
        F.col("p_brand").alias("job_id"), F.concat(F.lit("img-"), F.col("p_partkey").cast("string")).alias("image_id"),
        F.when(F.length("p_name") % 3 > 0, F.col("p_retailprice")).alias("width"),
    )
    refs = F.explode(F.array("url", F.regexp_replace("url", "^[a-z]+://", "")))
    pages = load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("job_id"), F.col("page_id").alias("ord"), refs.alias("image_ref"))
    found = E.block_warnings(t["jobs"], t["blocks"], pages)
    return found.unionByName(E.media_warnings(t["jobs"], pictures)).unionByName(E.technical_warnings(t["jobs"], t["sections"]))


@query(
    "dq_plan_invariants",
    f"""{_DQ} SELECT job_id, source_id, code FROM (SELECT job_id, source_id, CASE WHEN status IN ('auto_matched', 'confirmed') AND official_code IS NULL THEN 'match_without_target' WHEN status = 'not_applicable' AND official_code IS NOT NULL THEN 'target_of_not_applicable'
      WHEN status IN ('confirmed', 'not_applicable') AND coalesce(decision_reason, '') = '' THEN 'decision_without_reason' END AS code FROM dq_plan) AS p WHERE code IS NOT NULL""",
)
def dq_plan_invariants(spark, sf):
    return D.plan_invariants(derive(spark, sf, "dq_plan"))


@query(
    "dq_candidate_invariants",
    """WITH c AS (SELECT p_brand AS job_id, CAST(p_partkey AS VARCHAR) AS source_id, CASE WHEN p_size % 10 > 0 THEN 'GHE ' || p_size END AS official_code, (p_size - 5) / 40.0 AS score FROM part)
    SELECT job_id, source_id, official_code, CASE WHEN official_code IS NULL THEN 'candidate_without_target' ELSE 'score_out_of_range' END AS code FROM c
    WHERE official_code IS NULL OR NOT (score BETWEEN 0 AND 1)""",
)
def dq_candidate_invariants(spark, sf):
    found = load(spark, sf, "part").select(
        F.col("p_brand").alias("job_id"), F.col("p_partkey").cast("string").alias("source_id"),
        F.when(F.col("p_size") % 10 > 0, F.concat(F.lit("GHE "), F.col("p_size").cast("string"))).alias("official_code"),
        ((F.col("p_size") - 5) / 40.0).alias("score"),
    )
    return D.candidate_invariants(found)


@query(
    "dq_unit_invariants",
    """SELECT conv_id AS job_id, turn AS ord, CASE CAST(turn AS BIGINT) % 4 WHEN 0 THEN 'table_without_rows' WHEN 1 THEN 'image_without_metadata' ELSE 'text_missing' END AS code FROM conversations WHERE (conv_id % 3 = 0 AND turn % 4 < 2) OR (turn % 4 = 2 AND conv_id % 5 = 0)""",
)
def dq_unit_invariants(spark, sf):
    kind = F.when(F.col("turn") % 4 == 0, "table").when(F.col("turn") % 4 == 1, "image").otherwise("text")
    rows = F.when((F.col("turn") % 4 == 0) & (F.col("conv_id") % 3 == 0), F.array().cast("array<array<string>>")).otherwise(F.array(F.array("text")))
    units = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), kind.alias("kind"), rows.alias("rows"),
        F.when(F.col("conv_id") % 3 != 0, F.col("role")).alias("image"),
        F.when((F.col("turn") % 4 == 2) & (F.col("conv_id") % 5 == 0), "  ").otherwise(F.concat(F.lit("x"), "text")).alias("text"),
    )
    return D.unit_invariants(units, ["job_id", "ord"])


@query(
    "dq_exception_invariants",
    """SELECT p_brand AS job_id, p_name AS source_id, 'included_and_omitted' AS code FROM part GROUP BY 1, 2 HAVING bool_or(p_size % 2 = 0) AND bool_or(p_size % 2 = 1)""",
)
def dq_exception_invariants(spark, sf):
    rows = load(spark, sf, "part").select(
        F.col("p_brand").alias("job_id"), F.col("p_name").alias("source_id"),
        F.when(F.col("p_size") % 2 == 0, "include").otherwise("omit").alias("action"),
    )
    return D.exception_invariants(rows)


_POLICY = ", ".join(
    f"('{r}', [{', '.join(repr(e) for e in ext)}], [{', '.join(repr(k) for k in kinds)}], {size})" for r, (ext, kinds, size, _) in rules.UPLOAD_POLICIES.items()
)
_FITS = " OR ".join(f"(ext = '{e}' AND kind IN ({', '.join(repr(k) for k in ks)}))" for e, ks in rules.EXTENSION_KINDS.items())


@query(
    "jn_policy_check",
    f"""{cte('artifacts')}, p(role, extensions, kinds, max_bytes) AS (VALUES {_POLICY}),
    a AS (SELECT artifacts.*, CASE WHEN starts_with(lower(extension), '.') THEN lower(extension) ELSE '.' || lower(extension) END AS ext, extensions, kinds, max_bytes FROM artifacts JOIN p USING (role)),
    i AS (SELECT job_id, role, unnest(list_filter([CASE WHEN NOT list_contains(extensions, ext) THEN 'extension_not_allowed' END, CASE WHEN size_bytes = 0 THEN 'empty_file' END, CASE WHEN size_bytes > max_bytes THEN 'file_too_large' END,
      CASE WHEN NOT list_contains(kinds, kind) THEN 'real_type_not_allowed' END, CASE WHEN kind <> 'unknown' AND NOT ({_FITS}) THEN 'extension_content_mismatch' END, CASE WHEN kind = 'ole_doc' THEN 'legacy_conversion_required' END,
      CASE WHEN kind = 'html_doc' AND active_content THEN 'html_active_content_ignored' END], lambda x: x IS NOT NULL)) AS code FROM a)
    SELECT job_id, CASE WHEN code IN ('legacy_conversion_required', 'html_active_content_ignored') THEN 'warning' ELSE 'error' END AS severity, code, role AS source_id FROM i""",
)
def jn_policy_check(spark, sf):
    # every stored file with its metadata; whether it can still be read is dq_presence_check's
    return D.policy_check(derive(spark, sf, "artifacts").drop("available"), D.policy_table(spark))


_NEEDED = ", ".join(f"('{r}')" for r, (*_, needed) in rules.UPLOAD_POLICIES.items() if needed)


@query(
    "dq_presence_check",
    f"""{cte('artifacts')}, r(role) AS (VALUES {_NEEDED})
    SELECT job_id, 'error' AS severity, 'required_file_missing' AS code, role AS source_id FROM (SELECT DISTINCT job_id FROM artifacts), r WHERE (job_id, role) NOT IN (SELECT (job_id, role) FROM artifacts)
    UNION ALL SELECT job_id, 'error', 'file_unavailable', role FROM artifacts WHERE NOT available""",
)
def dq_presence_check(spark, sf):
    files = derive(spark, sf, "artifacts")
    return D.presence_check(files.select("job_id").distinct(), files, D.policy_table(spark))


_REQ = ", ".join(f"('{m}', '{r}')" for m, rs in rules.REQUIRED_ROLES.items() for r in rs)
_ALIASES = ", ".join(f"('{a}', '{name}')" for name, names in rules.UPLOAD_ALIASES.items() for a in names)


@query(
    "jn_missing_inputs",
    f"""{cte('form_jobs', 'uploads')}, r(mode, role) AS (VALUES {_REQ}), a(alias, canonical) AS (VALUES {_ALIASES})
    SELECT job_id, role FROM form_jobs JOIN r ON r.mode = analysis_mode WHERE (job_id, role) NOT IN (SELECT (job_id, canonical) FROM uploads JOIN a ON a.alias = uploads.field)""",
)
def jn_missing_inputs(spark, sf):
    sent = derive(spark, sf, "uploads").join(alias_table(spark).withColumnRenamed("alias", "field"), "field")
    return D.missing_inputs(derive(spark, sf, "form_jobs"), sent.select("job_id", F.col("canonical").alias("role")))


@query(
    "dq_upload_checks",
    f"""{cte('form_jobs', 'uploads')}, r(mode, role) AS (VALUES {_REQ}), a(alias, canonical) AS (VALUES {_ALIASES}), n AS (SELECT job_id, field, canonical FROM uploads LEFT JOIN a ON a.alias = uploads.field)
    SELECT job_id, 'unexpected_file' AS code, field FROM n WHERE canonical IS NULL UNION ALL SELECT job_id, 'duplicate_file', canonical FROM n WHERE canonical IS NOT NULL GROUP BY job_id, canonical HAVING count(*) > 1
    UNION ALL SELECT job_id, 'missing_files', role FROM form_jobs JOIN r ON r.mode = analysis_mode WHERE (job_id, role) NOT IN (SELECT (job_id, canonical) FROM n WHERE canonical IS NOT NULL)""",
)
def dq_upload_checks(spark, sf):
    return D.upload_checks(derive(spark, sf, "uploads"), alias_table(spark), derive(spark, sf, "form_jobs"))


def _iso(c: str) -> str:
    return f"(regexp_full_match(coalesce({c}, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({c} AS DATE) IS NOT NULL)"


_BLANK = {f: f"trim(coalesce({f}, '')) = ''" for f in D.REQUIRED_FIELDS}
_ANY = " OR ".join(_BLANK.values())


@query(
    "dq_field_checks",
    f"""{cte('forms')}, s AS (SELECT *, CASE WHEN {_ANY} THEN 1 WHEN length(company_name) > 240 THEN 2 WHEN NOT {_iso('ergo_reference_date')} OR NOT {_iso('psychosocial_reference_date')} THEN 3
      WHEN NOT regexp_full_match(trim(competence), '\\d{{4}}-(0[1-9]|1[0-2])') THEN 4 END AS st FROM forms)
    {" UNION ALL ".join(f"SELECT job_id, 'missing_fields' AS code, '{f}' AS field FROM s WHERE st = 1 AND {w}" for f, w in _BLANK.items())}
    UNION ALL SELECT job_id, 'field_too_long', 'company_name' FROM s WHERE st = 2
    UNION ALL SELECT job_id, 'invalid_date', CASE WHEN NOT {_iso('ergo_reference_date')} THEN 'ergo_reference_date' ELSE 'psychosocial_reference_date' END FROM s WHERE st = 3
    UNION ALL SELECT job_id, 'invalid_competence', 'competence' FROM s WHERE st = 4""",
)
def dq_field_checks(spark, sf):
    return D.field_checks(derive(spark, sf, "forms"))


_MEM = cte("members")


@query(
    "ag_archive_lenient",
    f"""{_MEM}, b AS (SELECT *, CASE WHEN starts_with(name, '/') OR contains(name, '..') THEN 'unsafe_archive_path' WHEN flag_bits % 2 = 1 THEN 'encrypted_archive_entry' WHEN file_size > 10485760 AND compress_size > 0 AND file_size > compress_size * 200 THEN 'suspicious_compression_ratio' END AS bad,
      ends_with(lower(name), 'vbaproject.bin') OR contains(lower(name), '/embeddings/') AS active FROM members),
    s AS (SELECT artifact_id, first(bad ORDER BY ord) FILTER (WHERE bad IS NOT NULL) AS stop, min(ord) FILTER (WHERE bad IS NOT NULL) AS stop_ord, count(*) AS n, bool_or(active) AS active FROM b GROUP BY 1),
    t AS (SELECT s.artifact_id, any_value(n) AS n, any_value(stop) AS stop, any_value(s.active) AS active, coalesce(sum(file_size) FILTER (WHERE stop_ord IS NULL OR ord < stop_ord OR (ord = stop_ord AND stop <> 'unsafe_archive_path')), 0) AS total FROM s JOIN b ON b.artifact_id = s.artifact_id GROUP BY s.artifact_id)
    SELECT artifact_id, 'archive_too_many_entries' AS code FROM t WHERE n > 5000 UNION ALL SELECT artifact_id, stop FROM t WHERE stop IS NOT NULL UNION ALL SELECT artifact_id, 'archive_expanded_size' FROM t WHERE total > 262144000
    UNION ALL SELECT artifact_id, 'active_or_embedded_content' FROM t WHERE active""",
)
def ag_archive_lenient(spark, sf):
    return D.archive_safety(derive(spark, sf, "members"), "lenient")


@query(
    "ag_archive_strict",
    f"""{_MEM}, f AS (SELECT *, CASE WHEN is_dir THEN 0 ELSE file_size END AS sz FROM members), d AS (SELECT DISTINCT artifact_id FROM (SELECT artifact_id, lower(name), count(*) AS k FROM members GROUP BY 1, 2) AS x WHERE k > 1),
    t AS (SELECT artifact_id, count(*) AS n, bool_or(contains(name, '..')) AS unsafe, bool_or(flag_bits % 2 = 1) AS enc, bool_or(external_attr = 2717843456) AS link, bool_or(sz > 104857600) AS large, sum(sz) AS total,
      bool_or(sz >= 1048576 AND sz > greatest(compress_size, 1) * 200) AS infl, bool_or(ends_with(lower(name), '/vbaproject.bin')) AS macros FROM f GROUP BY 1)
    SELECT artifact_id, 'too_many_members' AS code FROM t WHERE n > 20000 UNION ALL SELECT artifact_id, 'unsafe_path' FROM t WHERE unsafe UNION ALL SELECT artifact_id, 'duplicate_member' FROM d UNION ALL SELECT artifact_id, 'encrypted_member' FROM t WHERE enc
    UNION ALL SELECT artifact_id, 'linked_member' FROM t WHERE link UNION ALL SELECT artifact_id, 'large_member' FROM t WHERE large UNION ALL SELECT artifact_id, 'large_package' FROM t WHERE total > 262144000
    UNION ALL SELECT artifact_id, 'inflated_member' FROM t WHERE infl UNION ALL SELECT artifact_id, 'macros' FROM t WHERE macros""",
)
def ag_archive_strict(spark, sf):
    return D.archive_safety(derive(spark, sf, "members"), "strict")


@query(
    "sc_normalize_messages",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'warning' END AS level, CASE WHEN event_type = 'view' THEN 'warning' ELSE event_type END AS code, CASE WHEN event_id % 4 = 0 THEN 'aviso ' || event_type ELSE event_type END AS message
    FROM events WHERE NOT (event_type = 'view' AND event_id % 4 <> 0)""",
)
def sc_normalize_messages(spark, sf):
    raw = load(spark, sf, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "error").alias("severity"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("code"),
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" aviso "), "event_type")).alias("mensagem"),
    )
    return D.normalize_messages(raw, ["event_id"], "warning")


@query(
    "dq_contract_check",
    """WITH t AS (SELECT l_orderkey AS job_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
    SELECT job_id, 'contract_version' AS code FROM t WHERE job_id % 7 = 0 UNION ALL SELECT job_id, 'structure_differs' FROM t WHERE job_id % 5 = 0 UNION ALL SELECT job_id, 'markers_differ' FROM t WHERE r = 0 OR job_id % 11 = 0
    UNION ALL SELECT job_id, 'capacity_invalid' FROM t WHERE job_id % 3 = 0""",
)
def dq_contract_check(spark, sf):
    actual = stage(
        load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
            F.count(F.lit(1)).alias("n_paragraphs"), F.lit(2).alias("n_tables"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_markers"),
            F.md5(F.sum("l_partkey").cast("string").cast("binary")).alias("digest"),
        ),
        "contract",
    )
    job = F.col("job_id")
    manifest = actual.select(
        "job_id", F.when(job % 7 == 0, "draft").otherwise("sanitized").alias("status"), F.lit(1).alias("contract_version"),
        (F.col("n_paragraphs") + F.when(job % 5 == 0, 1).otherwise(0)).alias("paragraph_count"), F.col("n_tables").alias("table_count"),
        F.col("n_markers").alias("marker_count"), F.when(job % 11 == 0, "x").otherwise(F.col("digest")).alias("marker_digest"),
        F.lit(3).alias("capacity_groups"), F.lit(3).alias("capacity_blocks"), F.lit(3).alias("capacity_media"),
        F.when(job % 3 == 0, 4).otherwise(3).alias("capacity_sections"),
    )
    return D.contract_check(manifest, actual)


@query(
    "st_mode_check",
    f"""{cte('dq_jobs', 'dq_sources')} SELECT j.job_id, j.analysis_mode FROM dq_jobs j WHERE coalesce((SELECT string_agg(source_role, ',' ORDER BY source_role) FROM dq_sources s WHERE s.job_id = j.job_id), '') <> CASE WHEN analysis_mode = 'integrated' THEN 'integrated' ELSE 'ergonomic_agent,psychosocial_agent' END""",
)
def st_mode_check(spark, sf):
    return AN.mode_check(derive(spark, sf, "dq_jobs"), derive(spark, sf, "dq_sources"))


@query(
    "dq_reconciliation_warnings",
    f"""{_DQ} SELECT job_id, source_id, 'no_candidate' AS code FROM dq_plan WHERE status = 'needs_review' UNION ALL SELECT job_id, official_code, 'several_blocks' FROM dq_plan WHERE official_code IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
)
def dq_reconciliation_warnings(spark, sf):
    plan = derive(spark, sf, "dq_plan").withColumn("warning", F.when(F.col("status") == "needs_review", "no_candidate"))
    return D.reconciliation_warnings(plan)


@query(
    "snk_audit_view",
    f"""{_DQ} SELECT job_id, source_id, '{{"job_id":"' || job_id || '","source_id":"' || source_id || '","status":"' || status || '"' || CASE WHEN official_code IS NOT NULL THEN ',"official_code":"' || official_code || '"' ELSE '' END
      || CASE WHEN decision_reason IS NOT NULL THEN ',"decision_reason":"' || decision_reason || '"' ELSE '' END || '}}' AS record FROM dq_plan""",
)
def snk_audit_view(spark, sf):
    return SN.audit_json(derive(spark, sf, "dq_plan").withColumn("path", F.lit("/private/x")), "plan", ["job_id", "source_id"])


@query(
    "snk_json_safe",
    """SELECT o_orderkey, 'order-' || o_orderkey || '.json' AS path, '<' || length(o_orderpriority) || ' bytes>' AS payload, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
)
def snk_json_safe(spark, sf):
    rows = load(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("/srv/jobs/"), "o_custkey", F.lit("/order-"), "o_orderkey", F.lit(".json")).alias("path"),
        F.col("o_orderpriority").cast("binary").alias("payload"), F.col("o_orderdate").alias("ts"), F.col("o_orderdate").cast("date").alias("day"),
    )
    return SN.json_safe(rows, ["path"])


@query(
    "snk_report_rows",
    f"""{_issues_sql(False)}, r AS (SELECT job_id, 'summary' AS section FROM dq_jobs UNION ALL SELECT job_id, severity || 's' FROM issues UNION ALL SELECT job_id, 'reconciliation' FROM dq_plan UNION ALL SELECT job_id, 'exception' FROM dq_exceptions)
    SELECT job_id, section, count(*) AS n FROM r GROUP BY 1, 2""",
)
def snk_report_rows(spark, sf):
    t = tables(spark, sf)
    issues = stage(D.run_rules(t, strict=False), "issues")
    summary = C.run_summary(t["jobs"], t["groups"], t["plan"], issues)
    rows = SN.report_rows(summary, issues, t["plan"], t["exceptions"])
    return rows.groupBy("job_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_current_reports",
    f"""{_issues_sql(False)}, r AS (SELECT job_id, severity, code, count(*) AS n FROM issues GROUP BY ALL) SELECT job_id, severity, code, n FROM r WHERE NOT ends_with(job_id, '1')""",
)
def snk_current_reports(spark, sf):
    """Written in two batches, the second of which replaces the first one's jobs; jobs that end in 1 have no report left."""
    issues = stage(D.run_rules(tables(spark, sf), strict=False), "issues")
    rows = issues.groupBy("job_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))
    path = new_path(spark, "reports")
    SN.write_generation(rows.withColumn("n", -F.col("n")), path)
    gone = rows.where(F.col("job_id").endswith("1"))
    SN.write_generation(rows.where(~F.col("job_id").endswith("1")), path, jobs=gone)
    return SN.read_current(spark, path, rows.schema)


_TAB = "SELECT s_suppkey AS job_id, CASE s_suppkey % 3 WHEN 0 THEN 'prioritization' ELSE 'action_plan' END AS category FROM supplier"


def _report_tables(spark, sf):
    """One table per supplier: a header and a row per nation of its region, or rows alone."""
    header = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("Ordem"), F.lit("GHE"), F.lit("Classificação"), F.lit("Justificativa"))).when(
        F.col("s_suppkey") % 3 == 1, F.array(F.lit("Prioridade"), F.lit("GHE/Abrangência"), F.lit("Plano de ação"), F.lit("Responsável"))
    )
    row = F.when(
        F.col("s_suppkey") % 3 == 0,
        F.array(F.lit("1"), F.when(F.col("s_acctbal") < 0, "").otherwise("GHE 01"), F.lit("Alta"), F.concat(F.lit("motivo "), "s_name")),
    ).otherwise(F.array(F.lit("Média"), F.lit(""), F.concat(F.when(F.col("s_suppkey") % 3 == 1, "ação ").otherwise("tarefa "), "s_name"), F.lit("RH")))
    second = F.array(F.lit(""), F.lit("GHE 02"), F.lit(""), F.lit(""))
    return load(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("job_id"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").alias("section_no"),
        F.when(F.col("s_suppkey") % 3 == 0, "prioritization").otherwise("action_plan").alias("category"),
        F.concat(F.lit("GHE "), (F.col("s_suppkey") % 90).cast("string")).alias("group_code"),
        F.filter(F.array(header, row, second), lambda r: r.isNotNull()).alias("rows"),
    )


@query(
    "fl_priority_rows",
    """SELECT s_nationkey AS job_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS priority_no, 'GHE 01' AS group_hint, 'Alta' AS level, 'motivo ' || s_name AS reason FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal >= 0""",
)
def fl_priority_rows(spark, sf):
    return AN.priority_rows(_report_tables(spark, sf), ["job_id"]).select("job_id", "priority_no", "group_hint", "level", "reason")


@query(
    "fl_action_rows",
    """WITH a AS (SELECT s_nationkey AS job_id, s_suppkey AS ord, 1 AS k, CASE WHEN s_suppkey % 3 = 1 THEN 'ação ' || s_name ELSE 'Média' END AS action, 'GHE ' || (s_suppkey % 90) AS group_hint, CASE WHEN s_suppkey % 3 = 1 THEN 'RH' END AS responsible, CASE WHEN s_suppkey % 3 = 1 THEN 'Média' END AS priority FROM supplier WHERE s_suppkey % 3 > 0
      UNION ALL SELECT s_nationkey, s_suppkey, 2, 'GHE 02', 'GHE ' || (s_suppkey % 90), NULL, NULL FROM supplier WHERE s_suppkey % 3 = 2)
    SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord, k) AS action_no, action, group_hint, responsible, priority, '' AS evolution FROM a""",
)
def fl_action_rows(spark, sf):
    return AN.action_rows(_report_tables(spark, sf), ["job_id"]).select(
        "job_id", "action_no", "action", "group_hint", "responsible", "priority", "evolution"
    )


@query(
    "snk_compiled_tables",
    """SELECT 'priorities' AS result, s_nationkey AS job_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line, 'motivo ' || s_name AS text FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal >= 0
    UNION ALL SELECT 'actions', job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord, k), action FROM (SELECT s_nationkey AS job_id, s_suppkey AS ord, 1 AS k, CASE WHEN s_suppkey % 3 = 1 THEN 'ação ' || s_name ELSE 'Média' END AS action FROM supplier WHERE s_suppkey % 3 > 0
      UNION ALL SELECT s_nationkey, s_suppkey, 2, 'GHE 02' FROM supplier WHERE s_suppkey % 3 = 2) AS a""",
)
def snk_compiled_tables(spark, sf):
    t = _report_tables(spark, sf)
    p = C.priority_table(AN.priority_rows(t, ["job_id"]))
    a = C.action_table(AN.action_rows(t, ["job_id"]))
    return p.select(F.lit("priorities").alias("result"), "job_id", "line", F.col("reason").alias("text")).unionByName(
        a.select(F.lit("actions").alias("result"), "job_id", "line", F.col("action").alias("text"))
    )


@query(
    "jn_question_rows",
    """SELECT n_regionkey AS job_id, 'GHE ' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS code, s_suppkey AS ord, count(*) AS n_rows FROM (SELECT s.*, unnest([1, 2, 3]) AS k FROM supplier s) AS x JOIN nation ON n_nationkey = s_nationkey
    WHERE s_suppkey % 4 < 3 AND NOT (k = 1 AND s_suppkey % 2 = 0) AND NOT (k = 3 AND s_suppkey % 5 = 0) GROUP BY 1, 2, 3""",
)
def jn_question_rows(spark, sf):
    nation = load(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("job_id"))
    matches = nation.select(
        "job_id", F.concat(F.lit("GHE "), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("code"),
        F.col("n_nationkey").cast("string").alias("group_code"),
    )
    category = F.element_at(F.array(*[F.lit(c) for c in [*rules.QUESTION_CATEGORIES, "overview"]]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    tables_ = load(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "job_id", F.col("s_nationkey").cast("string").alias("group_code"), F.col("s_suppkey").alias("section_no"), F.col("s_suppkey").alias("ord"),
        category.alias("category"),
        F.array(
            F.array(F.when(F.col("s_suppkey") % 2 == 0, "Pergunta").otherwise("Item"), F.lit("Favorável")),
            F.array(F.col("s_name"), F.lit("72%")),
            F.array(F.when(F.col("s_suppkey") % 5 == 0, " - ").otherwise("x"), F.lit("")),
        ).alias("rows"),
    )
    return AN.question_rows_for_groups(matches, tables_).groupBy("job_id", "code", "ord").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "ag_answer_counts",
    f"""{cte('questions')}, q AS (SELECT id, CASE WHEN c3 IS NULL THEN 2 ELSE 3 END AS w, {Q.clean('c1')} AS a, {Q.clean('c2')} AS b, {Q.key("c1 || ' ' || c2 || ' ' || coalesce(c3, '')")} AS k FROM questions),
    r AS (SELECT id, CASE WHEN w = 2 AND regexp_matches(a, '^\\d+$') AND regexp_matches(b, '(?i)(sim|não|nao)\\s*$') THEN CASE WHEN regexp_matches(b, '(?i)sim\\s*$') THEN 'sim' ELSE 'nao' END ELSE {Q.key('b')} END AS ans FROM q
      WHERE k <> '' AND NOT {Q.starts_any('k', rules.QUESTION_SKIP_PREFIXES)} AND ((w = 2 AND regexp_matches(a, '^\\d+$') AND regexp_matches(b, '(?i)(sim|não|nao)\\s*$')) OR regexp_matches(a, '^\\d+(?:[.) -]|$)') OR {Q.key('b')} IN ('sim', 'nao', 'conforme')))
    SELECT id % 50 AS job_id, count(*) FILTER (WHERE starts_with(ans, 'sim')) AS n_yes, count(*) FILTER (WHERE starts_with(ans, 'nao')) AS n_no FROM r GROUP BY 1""",
)
def ag_answer_counts(spark, sf):
    from ..operators import segments as G

    cells = F.when(F.col("c3").isNull(), F.array("c1", "c2")).otherwise(F.array("c1", "c2", "c3"))
    tables_ = derive(spark, sf, "questions").select((F.col("id") % 50).alias("job_id"), F.col("id").alias("ord"), F.array(cells).alias("rows"))
    return G.answer_counts(G.question_rows_of(tables_, ["job_id"]), ["job_id"])


@query(
    "fl_clean_question_rows",
    f"{cte('questions')} SELECT id, {Q.clean('c1')} AS first_cell FROM (SELECT id, CASE WHEN id % 9 = 0 THEN 'PERGUNTA' ELSE c1 END AS c1, CASE WHEN id % 9 = 0 THEN 'Favorável' ELSE c2 END AS c2 FROM questions) AS q WHERE {Q.key('c1 || chr(32) || c2')} <> '' AND NOT starts_with({Q.key('c1 || chr(32) || c2')}, 'pergunta favoravel')",
)
def fl_clean_question_rows(spark, sf):
    from ..functions.text import clean_text
    from ..operators import segments as G

    def cell(name, title):
        return F.when(F.col("id") % 9 == 0, title).otherwise(F.col(name))

    rows = derive(spark, sf, "questions").select("id", F.array(cell("c1", "PERGUNTA"), cell("c2", "Favorável")).alias("cells"))
    return G.clean_question_rows(rows).select("id", clean_text(F.element_at("cells", 1)).alias("first_cell"))


@query(
    "jn_normalize_decisions",
    """SELECT p_brand AS job_id, CAST(p_partkey AS STRING) AS source_id, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'GHE ' || p_size ELSE 'ghe-' || p_size END AS target,
    p_partkey % 3 = 0 OR p_partkey % 7 = 0 AS not_applicable, CASE WHEN p_partkey % 5 = 0 THEN 'confirmed in review' ELSE 'motivo' END AS reason FROM part""",
)
def jn_normalize_decisions(spark, sf):
    raw = load(spark, sf, "part").select(
        F.col("p_brand").alias("job_id"), F.lit(None).cast("string").alias("source_id"), F.col("p_partkey").alias("ergo_id"),
        (F.col("p_partkey") % 3 == 0).alias("not_applicable"), F.when(F.col("p_partkey") % 7 == 0, "NOT_APPLICABLE").alias("action"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("GHE "), "p_size")).alias("official_ghe_code"),
        F.concat(F.lit("ghe-"), "p_size").alias("official_ghe_id"), F.when(F.col("p_partkey") % 5 != 0, "motivo").alias("reason"),
    )
    return R.normalize_decisions(raw).drop("decided_at")
