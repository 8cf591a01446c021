"""Queries of the text, code and identifier scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import similarity as S
from ..functions import text as X
from . import sqltext as Q
from .inputs import cte, derive, load
from .registry import query

_WIDE = "replace(replace(text, '. ', '.' || chr(160) || chr(8239)), chr(10), '  ' || chr(10))"


@query("sc_clean_text", f"SELECT doc_id, length(c) AS n_clean, md5(c) AS digest FROM (SELECT doc_id, {Q.clean(_WIDE)} AS c FROM documents) AS t")
def sc_clean_text(spark, sf):
    wide = F.regexp_replace(F.regexp_replace("text", r"\. ", ".  "), "\n", "  \n")
    c = X.clean_text(wide)
    return load(spark, sf, "documents").select(
        "doc_id", F.length(c).cast("bigint").alias("n_clean"), F.md5(c.cast("binary")).alias("digest")
    )


@query(
    "sc_normalize_key",
    f"SELECT 'd' AS origin, doc_id AS id, md5(k) AS digest, length(k) AS n FROM (SELECT doc_id, {Q.key('text')} AS k FROM documents) AS d "
    f"UNION ALL SELECT 'b', item_id, md5(k), length(k) FROM (SELECT item_id, {Q.key('text')} AS k FROM benchmark) AS b",
)
def sc_normalize_key(spark, sf):
    def keyed(table, key, origin):
        k = X.normalize_key("text")
        return load(spark, sf, table).select(
            F.lit(origin).alias("origin"), F.col(key).alias("id"), F.md5(k.cast("binary")).alias("digest"),
            F.length(k).cast("bigint").alias("n"),
        )

    return keyed("documents", "doc_id", "d").unionByName(keyed("benchmark", "item_id", "b"))


@query("sc_canonical_code", f"{cte('refs')} SELECT id, {Q.code('ref')} AS code FROM refs")
def sc_canonical_code(spark, sf):
    return derive(spark, sf, "refs").select("id", X.canonical_code("ref").alias("code"))


_LOOSE = r"regexp_extract(ref, '(?i)\bGHE\s*[-_:.]?\s*0*(\d+)\b', 1)"


@query(
    "sc_code_or_raw",
    f"{cte('refs')} SELECT id, CASE WHEN n2 <> '' THEN {Q.fmt('n2')} ELSE upper(trim(ref)) END AS code "
    f"FROM (SELECT id, ref, {_LOOSE} AS n2 FROM refs) AS t",
)
def sc_code_or_raw(spark, sf):
    return derive(spark, sf, "refs").select("id", X.canonical_code_or_raw("ref").alias("code"))


@query(
    "sc_parse_reference",
    f"{cte('refs')} SELECT id, {Q.code('ref')} AS code, CASE WHEN {Q.code('ref')} IS NOT NULL THEN {Q.ref_name('ref')} END AS name FROM refs",
)
def sc_parse_reference(spark, sf):
    return derive(spark, sf, "refs").select("id", X.parse_reference("ref").alias("r")).select("id", "r.*")


@query("sc_group_name", f"{cte('refs')} SELECT id, {Q.group_name('ref')} AS name_key FROM refs")
def sc_group_name(spark, sf):
    return derive(spark, sf, "refs").select("id", X.normalize_group_name("ref").alias("name_key"))


@query(
    "sc_token_jaccard",
    f"{cte('refs')}, k AS (SELECT id, {Q.group_name('ref')} AS a, {Q.key('nm')} AS b FROM refs) "
    f"SELECT id, round({Q.jaccard('a', 'b')}, 6) AS jaccard, {Q.similarity('a', 'b')} AS similarity FROM k",
)
def sc_token_jaccard(spark, sf):
    keyed = derive(spark, sf, "refs").select(
        "id", X.normalize_group_name("ref").alias("a"), X.normalize_key("nm").alias("b")
    )
    return keyed.select(
        "id", F.round(S.token_jaccard("a", "b"), 6).alias("jaccard"),
        S.name_similarity(F.col("a"), F.col("b"), "jaccard").alias("similarity"),
    )


_NUM = r"replace(regexp_extract(c, '(?:^|[^0-9.,-])(-?\d+(?:[.,]\d+)?)', 1), ',', '.')"


@query(
    "sc_parse_population",
    f"{cte('cells')}, t AS (SELECT id, {Q.clean('qty')} AS c, {Q.key('qty')} AS k FROM cells), "
    f"u AS (SELECT id, k, try_cast({_NUM} AS DECIMAL(38,10)) AS v FROM t) "
    "SELECT id, CASE WHEN k NOT IN ('total', 'subtotal', 'n a', 'na') AND v >= 0 AND v = floor(v) THEN CAST(v AS BIGINT) END AS population FROM u",
)
def sc_parse_population(spark, sf):
    return derive(spark, sf, "cells").select("id", X.parse_population("qty").alias("population"))


@query(
    "sc_stable_unique",
    f"{cte('cells')}, v AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array({Q.clean('listing')}, '[;|]+'), lambda x: trim(x)), lambda x: x <> '')) AS value, "
    f"generate_subscripts(list_filter(list_transform(regexp_split_to_array({Q.clean('listing')}, '[;|]+'), lambda x: trim(x)), lambda x: x <> ''), 1) AS pos FROM cells), "
    f"f AS (SELECT id, value, pos, row_number() OVER (PARTITION BY id, {Q.key('value')} ORDER BY pos) AS rn FROM v) "
    "SELECT id, string_agg(value, '/' ORDER BY pos) AS kept, count(*) AS n FROM f WHERE rn = 1 GROUP BY id",
)
def sc_stable_unique(spark, sf):
    values = X.stable_unique(X.split_values("listing"))
    return derive(spark, sf, "cells").select("id", values.alias("v")).where(F.size("v") > 0).select(
        "id", F.array_join("v", "/").alias("kept"), F.size("v").cast("bigint").alias("n")
    )


@query(
    "sc_split_values",
    f"{cte('cells')}, v AS (SELECT id, list_filter(list_transform(regexp_split_to_array({Q.clean('listing')}, '[;|]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM cells) "
    "SELECT id, len(l) AS n, coalesce(array_to_string(l, '/'), '') AS parts FROM v",
)
def sc_split_values(spark, sf):
    v = X.split_values("listing")
    return derive(spark, sf, "cells").select("id", F.size(v).cast("bigint").alias("n"), F.array_join(v, "/").alias("parts"))


_PCT = r"regexp_extract(phrase, '(?:^|[^0-9])(\d{1,3}(?:[.,]\d{1,2})?)\s*%', 1)"


@query("sc_percentage", f"{cte('cells')} SELECT id, CASE WHEN {_PCT} <> '' THEN {_PCT} || '%' END AS pct FROM cells")
def sc_percentage(spark, sf):
    return derive(spark, sf, "cells").select("id", X.extract_percentage("phrase").alias("pct"))


def _tail(mark: str) -> str:
    at = f"strpos(phrase, '{mark}')"
    return f"CASE WHEN {at} > 0 THEN nullif(trim(substr(phrase, {at} + 1)), '') END"


@query("sc_after_separator", f"{cte('cells')} SELECT id, coalesce({_tail(':')}, {_tail('–')}, {_tail('—')}) AS tail FROM cells")
def sc_after_separator(spark, sf):
    return derive(spark, sf, "cells").select("id", X.after_separator("phrase").alias("tail"))


@query("sc_classify_heading", f"{cte('headings')} SELECT id, {Q.category('text')} AS category FROM headings")
def sc_classify_heading(spark, sf):
    return derive(spark, sf, "headings").select("id", X.classify_heading("text").alias("category"))


@query(
    "sc_heading_tests",
    f"{cte('headings')} SELECT id, {Q.heading('text', 'style')} AS heading, {Q.section_heading('text', 'style')} AS section_heading, "
    f"{Q.group_heading('text')} AS group_heading, regexp_matches(text, '^\\d+\\.\\s+\\S') AND length(text) <= 140 AS numbered FROM headings",
)
def sc_heading_tests(spark, sf):
    return derive(spark, sf, "headings").select(
        "id",
        X.looks_like_heading("text", "style").alias("heading"),
        X.is_section_heading("text", "style").alias("section_heading"),
        X.is_group_heading("text").alias("group_heading"),
        X.is_numbered_heading("text").alias("numbered"),
    )


@query(
    "sc_label_kind",
    f"{cte('headings')} SELECT id, CASE " + " ".join(
        f"WHEN {Q.starts_any(Q.key('text'), p)} THEN '{n}'" for n, p in rules.LABEL_PREFIXES
    ) + " END AS label FROM headings",
)
def sc_label_kind(spark, sf):
    return derive(spark, sf, "headings").select("id", X.label_kind("text").alias("label"))


_H = Q.key("header")


@query(
    "sc_column_kind",
    f"{cte('headers')} SELECT id, CASE WHEN {_H} = '' THEN NULL WHEN {Q.contains_any(_H, rules.PERSON_HEADERS)} THEN 'person' "
    f"WHEN {_H} IN ('ghe', 'identificacao ghe', 'grupo homogeneo de exposicao') OR (contains({_H}, 'ghe') AND {Q.contains_any(_H, rules.COMBINED_WORDS)}) THEN 'combined' "
    f"WHEN contains({_H}, 'ghe') AND {Q.contains_any(_H, rules.CODE_WORDS)} THEN 'code' "
    f"WHEN contains({_H}, 'ghe') AND {Q.contains_any(_H, rules.NAME_WORDS)} THEN 'name' "
    f"WHEN {Q.contains_any(_H, rules.SECTOR_WORDS)} THEN 'sector' WHEN {Q.contains_any(_H, rules.ROLE_WORDS)} THEN 'role' "
    f"WHEN {_H} IN ('qtd', 'qtde', 'quantidade', 'populacao', 'headcount') OR {Q.contains_any(_H, rules.POPULATION_PHRASES)} THEN 'population' END AS kind FROM headers",
)
def sc_column_kind(spark, sf):
    return derive(spark, sf, "headers").select("id", X.column_kind("header").alias("kind"))


@query(
    "sc_action_header",
    f"{cte('headers')} SELECT id, CASE WHEN {Q.contains_any(_H, ['evolucao', 'registro'])} THEN 'evolution' WHEN contains({_H}, 'responsavel') THEN 'responsible' "
    f"WHEN contains({_H}, 'prazo') OR {_H} = 'data' THEN 'deadline' WHEN contains({_H}, 'indicador') THEN 'indicator' WHEN contains({_H}, 'prioridade') THEN 'priority' "
    f"WHEN {_H} = 'ghe' OR {Q.contains_any(_H, ['ghe ', 'grupo'])} THEN 'group' WHEN {Q.contains_any(_H, ['acao', 'medida', 'atividade'])} THEN 'action' END AS kind FROM headers",
)
def sc_action_header(spark, sf):
    return derive(spark, sf, "headers").select("id", X.action_header_kind("header").alias("kind"))


@query(
    "sc_coerce_code",
    f"{cte('refs')} SELECT id, CASE WHEN {Q.code('ref')} IS NOT NULL THEN {Q.code('ref')} WHEN regexp_matches({Q.clean('ref')}, '^\\d+$') THEN {Q.fmt(Q.clean('ref'))} END AS code FROM refs",
)
def sc_coerce_code(spark, sf):
    return derive(spark, sf, "refs").select("id", X.coerce_code("ref").alias("code"))


_C = Q.key("context")


@query(
    "sc_media_role",
    f"{cte('contexts')} SELECT id, {Q.contextual('context')} AS contextual, CASE WHEN contains({_C}, 'matriz') AND contains({_C}, 'risco') THEN 'risk_matrix' "
    f"WHEN contains({_C}, 'radar') THEN 'radar' WHEN contains({_C}, 'dominio') AND {Q.contains_any(_C, ['resumo', 'sintese', 'painel'])} THEN 'domain_summary' "
    f"WHEN {Q.contains_any(_C, ['favorabilidade', 'favoravel'])} THEN 'favorability' WHEN {Q.contains_any(_C, ['painel geral', 'visao geral'])} THEN 'general_panel' "
    f"WHEN code IS NOT NULL AND contains({_C}, 'painel') THEN 'ghe_panel' WHEN {Q.contains_any(_C, ['grafico', 'chart'])} THEN 'chart' ELSE 'other' END AS role FROM contexts",
)
def sc_media_role(spark, sf):
    return derive(spark, sf, "contexts").select(
        "id", X.is_contextual("context").alias("contextual"), X.media_role("context", "code").alias("role")
    )


@query(
    "sc_geometry",
    f"{cte('contexts')}, g AS (SELECT id, width, height, width / height AS r FROM contexts) SELECT id, CAST(floor(r * 1000) AS BIGINT) AS ratio, r >= 2.2 AS panel, r BETWEEN 1.6 AND 3.0 AS chart, "
    "r >= 3.0 AS matrix, r BETWEEN 2.5 AND 3.5 AND height BETWEEN 350 AND 700 AS dashboard FROM g",
)
def sc_geometry(spark, sf):
    g = X.geometry_flags("width", "height")
    return derive(spark, sf, "contexts").select("id", g.alias("g")).select(
        "id", F.floor(F.col("g.ratio") * 1000).alias("ratio"), "g.panel", "g.chart", "g.matrix", "g.dashboard"
    )


_C1, _C2, _C3 = Q.clean("c1"), Q.clean("c2"), Q.clean("c3")
_ROWKEY = Q.key("c1 || ' ' || c2 || ' ' || coalesce(c3, '')")
_ANS = r"(?i)(?:[✅☑✓❌✗]\s*)?(Sim|Não|Nao)\s*$"


@query(
    "sc_question_row",
    f"{cte('questions')}, q AS (SELECT id, c3 IS NULL AS two, {_C1} AS a, {_C2} AS b, {_C3} AS c, {_ROWKEY} AS k FROM questions), "
    f"r AS (SELECT *, regexp_extract(b, '{_ANS}', 1) AS ans FROM q WHERE (a <> '' OR b <> '' OR c <> '') AND NOT {Q.starts_any('k', rules.QUESTION_SKIP_PREFIXES)}) "
    f"SELECT id, CASE WHEN two AND regexp_matches(a, '^\\d+$') AND ans <> '' THEN a || '. ' || trim(regexp_replace(b, '{_ANS}', '')) ELSE a END AS question, "
    "CASE WHEN two AND regexp_matches(a, '^\\d+$') AND ans <> '' THEN replace(ans, 'Nao', 'Não') ELSE b END AS answer, c AS note FROM r "
    f"WHERE (two AND regexp_matches(a, '^\\d+$') AND ans <> '') OR regexp_matches(a, '^\\d+(?:[.) -]|$)') OR {Q.key('b')} IN ('sim', 'nao', 'conforme')",
)
def sc_question_row(spark, sf):
    cells = F.when(F.col("c3").isNull(), F.array("c1", "c2")).otherwise(F.array("c1", "c2", "c3"))
    return (
        derive(spark, sf, "questions").select("id", X.question_row(cells).alias("q"))
        .where("q is not null").select("id", "q.*")
    )


@query(
    "sc_safe_name",
    f"""{cte('forms')}, f AS (SELECT job_id, coalesce(filename, '') AS r FROM forms),
    u AS (SELECT job_id, r, trim(regexp_replace(regexp_extract(regexp_replace(r, '[/\\\\]+$', ''), '[^/\\\\]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS up,
      regexp_replace(regexp_extract(regexp_replace(CASE WHEN r = '' THEN 'arquivo' ELSE r END, '/+$', ''), '[^/]*$'), '[^A-Za-z0-9._ -]+', '_', 'g') AS di,
      trim(regexp_replace(regexp_replace(strip_accents(regexp_extract(CASE WHEN r = '' THEN 'file' ELSE r END, '[^/\\\\]*$')), '[^\\x00-\\x7f]', '', 'g'), '[^a-zA-Z0-9._-]+', '-', 'g'), '._-') AS we FROM f)
    SELECT job_id, CASE WHEN up = '' THEN 'upload' ELSE substr(up, 1, 120) END AS upload_name, CASE WHEN di = '' THEN 'arquivo' ELSE substr(di, 1, 120) END AS display_name,
      CASE WHEN we = '' THEN 'file' ELSE right(we, 120) END AS web_name FROM u""",
)
def sc_safe_name(spark, sf):
    return derive(spark, sf, "forms").select(
        "job_id", X.safe_name("filename").alias("upload_name"), X.safe_name("filename", "display").alias("display_name"),
        X.safe_name("filename", "web").alias("web_name"),
    )


@query(
    "sc_form_values",
    f"""{cte('forms')} SELECT job_id, CASE WHEN starts_with(lower(trim(ext)), '.') THEN lower(trim(ext)) ELSE '.' || lower(trim(ext)) END AS extension,
      CASE lower(trim(CASE WHEN coalesce(mode_text, '') = '' THEN 'integrated' ELSE mode_text END)) WHEN 'integrado' THEN 'integrated' WHEN 'integrated' THEN 'integrated'
        WHEN 'separado' THEN 'separate' WHEN 'separate' THEN 'separate' WHEN 'separated' THEN 'separate' END AS mode,
      lower(trim(coalesce(flag_text, ''))) IN ('1', 'true', 'yes', 'on', 'sim') AS flag FROM forms""",
)
def sc_form_values(spark, sf):
    return derive(spark, sf, "forms").select(
        "job_id", X.norm_ext("ext").alias("extension"), X.norm_mode("mode_text").alias("mode"), X.norm_flag("flag_text").alias("flag")
    )


@query(
    "sc_field_formats",
    f"""{cte('forms')} SELECT job_id, regexp_full_match(trim(coalesce(competence, '')), '\\d{{4}}-(0[1-9]|1[0-2])') AS competence_ok,
      regexp_full_match(coalesce(ergo_reference_date, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(ergo_reference_date AS DATE) IS NOT NULL AS ergo_ok,
      regexp_full_match(coalesce(psychosocial_reference_date, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(psychosocial_reference_date AS DATE) IS NOT NULL AS psy_ok,
      length(company_name) <= 240 AS length_ok FROM forms""",
)
def sc_field_formats(spark, sf):
    return derive(spark, sf, "forms").select(
        "job_id", X.is_competence("competence").alias("competence_ok"), X.is_iso_date("ergo_reference_date").alias("ergo_ok"),
        X.is_iso_date("psychosocial_reference_date").alias("psy_ok"),
        (F.length("company_name") <= rules.MAX_FIELD_CHARS).alias("length_ok"),
    )


@query(
    "sc_dig",
    "SELECT event_id, coalesce(nullif(props ->> '$.summary.k', ''), nullif(props ->> '$.k', ''), 'none') AS k FROM events",
)
def sc_dig(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", F.coalesce(X.dig("props", "$.summary.k", "$.k"), F.lit("none")).alias("k")
    )


@query(
    "sc_labels",
    f"""{cte('refs')} SELECT id, regexp_replace('Setor / GHE: setor/ghe ' || coalesce(ref, ''), '(?i)^(?:setor\\s*/\\s*ghe\\s*:?\\s*)+', '') AS title,
      'GHE ' || n || ' - ' || nm AS label, n || CASE WHEN n = 1 THEN ' item' ELSE ' itens' END AS counted FROM refs""",
)
def sc_labels(spark, sf):
    return derive(spark, sf, "refs").select(
        "id",
        X.display_title(F.concat(F.lit("Setor / GHE: setor/ghe "), F.coalesce("ref", F.lit("")))).alias("title"),
        X.group_label(F.concat(F.lit("GHE "), F.col("n").cast("string")), "nm").alias("label"),
        X.count_label("n", "item", "itens").alias("counted"),
    )


@query(
    "sc_fill_markers",
    f"""{cte('forms')} SELECT job_id, replace(replace('Documento de {{{{X_COMPANY}}}} em {{{{X_COMPETENCE}}}} - {{{{X_OTHER}}}}', '{{{{X_COMPANY}}}}', plain), '{{{{X_COMPETENCE}}}}', coalesce(competence, '')) AS body FROM forms""",
)
def sc_fill_markers(spark, sf):
    body = X.fill_markers(
        F.lit("Documento de {{X_COMPANY}} em {{X_COMPETENCE}} - {{X_OTHER}}"),
        {"{{X_COMPANY}}": F.col("plain"), "{{X_COMPETENCE}}": F.coalesce("competence", F.lit(""))},
    )
    return derive(spark, sf, "forms").select("job_id", body.alias("body"))
