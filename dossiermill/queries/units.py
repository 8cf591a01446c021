"""Queries of the ordered-unit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..operators import analyses as AN
from ..operators import segments as G
from ..plans.staging import stage
from ..sources.html import html_units
from . import sqltext as Q
from .inputs import cte, derive, load, text_lines
from .registry import query

_BREAK = r"E'\n'"


def _lines_sql(column: str, source: str = "turns") -> str:
    return (
        f"SELECT job_id, turn * 4294967296 + pos AS ord, line AS text FROM (SELECT job_id, turn, unnest(string_split({column}, chr(10))) AS line, "
        f"generate_subscripts(string_split({column}, chr(10)), 1) - 1 AS pos FROM {source}) AS t WHERE trim(line) <> ''"
    )


def block_units(spark, sf):
    return text_lines(derive(spark, sf, "turns"), "job_id", F.col("turn"), "body")


def report_units(spark, sf):
    return text_lines(derive(spark, sf, "turns"), "job_id", F.col("turn"), "report")


_BLOCKS_SQL = f"""{cte('turns')}, u AS ({_lines_sql('body')}),
  h AS (SELECT *, {Q.code('text')} AS code, {Q.ref_name('text')} AS rname, {Q.group_heading('text')} AS titled FROM u),
  s AS (SELECT *, titled AND row_number() OVER (PARTITION BY job_id, titled, code, {Q.key('rname')} ORDER BY ord) = 1 AS opens FROM h),
  b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS block_no FROM s)"""


@query("wn_segment_blocks", f"{_BLOCKS_SQL} SELECT job_id, ord, opens, block_no FROM b")
def wn_segment_blocks(spark, sf):
    return G.segment_blocks(block_units(spark, sf), ["job_id"]).select("job_id", "ord", "opens", "block_no")


@query(
    "wn_blocks",
    f"{_BLOCKS_SQL} SELECT job_id, 'ergo-' || lpad(block_no::VARCHAR, greatest(3, length(block_no::VARCHAR))::INT, '0') AS source_id, block_no - 1 AS ord, text AS title, code AS source_code, rname AS source_name FROM b WHERE opens",
)
def wn_blocks(spark, sf):
    return G.blocks_of(G.segment_blocks(block_units(spark, sf), ["job_id"]), ["job_id"])


@query("wn_preamble", f"{_BLOCKS_SQL} SELECT job_id, count(*) AS n_units, min(ord) AS first_ord FROM b WHERE block_no = 0 GROUP BY job_id")
def wn_preamble(spark, sf):
    pre = G.preamble(G.segment_blocks(block_units(spark, sf), ["job_id"]))
    return pre.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_units"), F.min("ord").alias("first_ord"))


_SECTIONS_SQL = f"""{cte('turns')}, u AS ({_lines_sql('report')}),
  h AS (SELECT *, {Q.section_heading('text')} AS is_heading, {Q.code('text')} AS code, {Q.ref_name('text')} AS rname,
    regexp_matches(text, '^\\d+\\.\\s+\\S') AND length(text) <= 140 AS numbered FROM u),
  n AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER w::BIGINT AS section_no,
    max(CASE WHEN is_heading AND (code IS NOT NULL OR numbered) THEN ord END) OVER w AS state_ord,
    max(CASE WHEN is_heading THEN ord END) OVER w AS head_ord FROM h WINDOW w AS (PARTITION BY job_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT n.job_id, n.ord, n.text, n.is_heading, n.section_no, coalesce(hh.text, '') AS section_title,
    CASE WHEN hh.text IS NULL THEN 'other' ELSE {Q.category('hh.text')} END AS category, ss.code AS group_code, CASE WHEN ss.code IS NOT NULL THEN ss.rname END AS group_name
    FROM n LEFT JOIN h hh ON hh.job_id = n.job_id AND hh.ord = n.head_ord LEFT JOIN h ss ON ss.job_id = n.job_id AND ss.ord = n.state_ord)"""


@query("wn_segment_sections", f"{_SECTIONS_SQL} SELECT job_id, ord, is_heading, section_no, category, group_code, group_name FROM s")
def wn_segment_sections(spark, sf):
    return G.segment_sections(report_units(spark, sf), ["job_id"]).select(
        "job_id", "ord", "is_heading", "section_no", "category", "group_code", "group_name"
    )


_SECTION_ROWS_SQL = """, sec AS (SELECT job_id, section_no, any_value(section_title) AS section_title, any_value(category) AS category, any_value(group_code) AS group_code, any_value(group_name) AS group_name,
    min(ord) AS first_ord FROM s GROUP BY job_id, section_no), z AS (SELECT job_id, min(section_no) AS base FROM sec GROUP BY job_id)"""


@query(
    "wn_sections",
    f"{_SECTIONS_SQL}{_SECTION_ROWS_SQL} SELECT job_id, 'technical-section-' || lpad((section_no - base)::VARCHAR, greatest(4, length((section_no - base)::VARCHAR))::INT, '0') AS section_id, section_no - base AS section_ord, section_title, category, group_code FROM sec JOIN z USING (job_id)",
)
def wn_sections(spark, sf):
    return G.sections_of(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"]).select(
        "job_id", "section_id", "section_ord", "section_title", "category", "group_code"
    )


@query(
    "fl_unit_values",
    f"{cte('turns')}, u AS ({_lines_sql('body')}) SELECT job_id, ord, pos, value FROM (SELECT job_id, ord, unnest(list_filter([text] || string_split(lower(text), ', '), lambda x: x <> '')) AS value, "
    "generate_subscripts(list_filter([text] || string_split(lower(text), ', '), lambda x: x <> ''), 1) - 1 AS pos FROM u) AS v",
)
def fl_unit_values(spark, sf):
    units = block_units(spark, sf).withColumn("rows", F.array(F.split(F.lower("text"), ", ")))
    return G.unit_values(units, ["job_id"])


@query(
    "sc_labelled_values",
    f"""{_BLOCKS_SQL}, l AS (SELECT job_id, block_no, ord, replace(replace(text, substr(text, 1, 4), CASE ord % 4 WHEN 0 THEN 'Pergunta ' WHEN 1 THEN 'Resposta: ' WHEN 2 THEN 'Observação - ' ELSE 'Recomendações, ' END), chr(13), '') AS value FROM b WHERE block_no > 0),
    k AS (SELECT *, CASE {" ".join(f"WHEN {Q.starts_any(Q.key('value'), p)} THEN '{n}'" for n, p in rules.LABEL_PREFIXES)} END AS label FROM l)
    SELECT job_id, block_no, label, row_number() OVER (PARTITION BY job_id, block_no, label ORDER BY ord) AS item_no, md5(value) AS digest FROM k WHERE label IS NOT NULL""",
)
def sc_labelled_values(spark, sf):
    seg = G.segment_blocks(block_units(spark, sf), ["job_id"])
    opening = (
        F.when(F.col("ord") % 4 == 0, "Pergunta ").when(F.col("ord") % 4 == 1, "Resposta: ")
        .when(F.col("ord") % 4 == 2, "Observação - ").otherwise("Recomendações, ")
    )
    marked = seg.withColumn("text", F.replace(F.replace("text", F.substring("text", 1, 4), opening), F.lit("\r"), F.lit("")))
    return G.labelled_values(marked, ["job_id"]).select(
        "job_id", "block_no", "label", "item_no", F.md5(F.col("value").cast("binary")).alias("digest")
    )


_REGION_TEXT = "CASE WHEN pos % 7 = 3 THEN 'Visão geral' WHEN pos % 7 = 5 THEN 'Pontos críticos' WHEN pos % 11 = 6 THEN 'Termo de encerramento' ELSE line END"


@query(
    "rd_body_regions",
    f"""WITH l AS (SELECT doc_id, pos, {_REGION_TEXT} AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) AS d),
    k AS (SELECT *, {Q.key('text')} AS k FROM l),
    m AS (SELECT *, CASE k WHEN 'visao geral' THEN 'overview' WHEN 'pontos positivos' THEN 'positive_points' WHEN 'pontos criticos' THEN 'critical_points' WHEN 'indicacoes de melhoria' THEN 'improvements' END AS cat FROM k),
    e AS (SELECT *, cat IS NOT NULL OR {Q.starts_any('k', rules.REGION_BOUNDARIES)} AS edge FROM m),
    r AS (SELECT *, sum(CASE WHEN edge THEN 1 ELSE 0 END) OVER w::BIGINT AS region_no, max(CASE WHEN edge THEN pos END) OVER w AS edge_pos FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT r.doc_id, r.pos AS ord, r.region_no, o.cat AS category, row_number() OVER (PARTITION BY r.doc_id, r.region_no ORDER BY r.pos) AS slot_no
    FROM r JOIN e o ON o.doc_id = r.doc_id AND o.pos = r.edge_pos WHERE NOT r.edge AND o.cat IS NOT NULL AND {Q.clean('r.text')} <> ''""",
)
def rd_body_regions(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    text = (
        F.when(F.col("pos") % 7 == 3, "Visão geral").when(F.col("pos") % 7 == 5, "Pontos críticos")
        .when(F.col("pos") % 11 == 6, "Termo de encerramento").otherwise(F.col("line"))
    )
    units = lines.select("doc_id", F.col("pos").cast("bigint").alias("ord"), text.alias("text"))
    return G.body_regions(units, ["doc_id"]).drop("text")


_SLOTS = 3


@query(
    "wn_fill_slots",
    f"""SELECT n_nationkey AS owner, slot_no, s_name AS item FROM nation CROSS JOIN (SELECT unnest(generate_series(1, {_SLOTS})) AS slot_no) AS s
    LEFT JOIN (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) AS x ON x.s_nationkey = n_nationkey AND x.rn = slot_no""",
)
def wn_fill_slots(spark, sf):
    owners = load(spark, sf, "nation").select(F.col("n_nationkey").alias("owner"))
    return G.fill_slots(_numbered_items(spark, sf), owners, ["owner"], _SLOTS, ["item"])


def _numbered_items(spark, sf):
    from ..plans.ordered import ordinal

    items = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("owner"), "s_suppkey", F.col("s_name").alias("item"))
    return ordinal(items, ["owner"], ["s_suppkey"], "slot_no")


@query(
    "wn_slot_overflow",
    f"""SELECT s_nationkey AS owner, rn AS slot_no, rn - {_SLOTS} AS over, s_name AS item
    FROM (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) AS x WHERE rn > {_SLOTS}""",
)
def wn_slot_overflow(spark, sf):
    return G.slot_overflow(_numbered_items(spark, sf), ["owner"], _SLOTS, ["item"])


@query(
    "wn_dedupe_cells",
    """SELECT l_orderkey AS job_id, l_partkey AS cell_id, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def wn_dedupe_cells(spark, sf):
    cells = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("cell_id"), F.col("l_linenumber").alias("first_line")
    )
    once = G.dedupe_cells(cells, ["job_id"], "cell_id", ["first_line"], [])
    counts = cells.groupBy("job_id", "cell_id").agg(F.count(F.lit(1)).alias("n"))
    return once.join(counts, ["job_id", "cell_id"])


@query(
    "wn_first_seen_order",
    """WITH f AS (SELECT c_mktsegment AS job_id, c_nationkey AS value, min(c_custkey) AS first_at FROM customer GROUP BY 1, 2)
    SELECT job_id, value, first_at, row_number() OVER (PARTITION BY job_id ORDER BY first_at, value) AS seen_no FROM f""",
)
def wn_first_seen_order(spark, sf):
    rows = load(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("job_id"), F.col("c_nationkey").alias("value"), F.col("c_custkey").alias("at")
    )
    return G.first_seen_order(rows, ["job_id"], "value", "at")


@query(
    "ag_collect_stable",
    f"""WITH v AS (SELECT o_orderpriority AS job_id, CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderstatus) ELSE lower(o_orderstatus) END || ' ' || (o_custkey % 50) AS value, o_orderkey AS ord FROM orders),
    r AS (SELECT *, {Q.key('value')} AS value_key, row_number() OVER (PARTITION BY job_id, {Q.key('value')} ORDER BY ord) AS rn FROM v) SELECT job_id, value_key, value, ord AS first_at FROM r WHERE rn = 1""",
)
def ag_collect_stable(spark, sf):
    value = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, F.upper("o_orderstatus")).otherwise(F.lower("o_orderstatus")),
        F.lit(" "), (F.col("o_custkey") % 50).cast("string"),
    )
    rows = load(spark, sf, "orders").select(F.col("o_orderpriority").alias("job_id"), value.alias("value"), F.col("o_orderkey").alias("ord"))
    return G.collect_stable(rows, ["job_id"], "value", ["ord"]).select(
        "job_id", "value_key", "value", F.col("at.ord").alias("first_at")
    )


@query(
    "ag_structure_counts",
    r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g') AS h FROM pages)
    SELECT page_id, len(regexp_extract_all(h, '(?i)<h1\b')) AS n_headings, len(regexp_extract_all(h, '(?i)<(p|li)\b')) - len(regexp_extract_all(h, '(?is)<(p|li)\b[^>]*>(\s|<br>|<b>|</b>|<[ai]\b[^>]*>|</[ai]>)*</?(p|li|div|ul|nav|article|footer|h1|body)\b')) AS n_paragraphs, 0::BIGINT AS n_tables, 0::BIGINT AS n_images FROM b""",
)
def ag_structure_counts(spark, sf):
    units = html_units(load(spark, sf, "pages"), "page_id", "html")
    return G.structure_counts(units, ["page_id"]).drop("n_units")


_SECTION_ITEMS = f"{_SECTIONS_SQL}, i AS (SELECT *, CASE WHEN is_heading THEN 0 ELSE 1 END AS part FROM s)"
_PCT = r"regexp_extract(text, '(?:^|[^0-9])(\d{1,3}(?:[.,]\d{1,2})?)\s*%', 1)"
_AFTER = "nullif(trim(substr(text, strpos(text, ':') + 1)), '')"


@query(
    "ag_build_analyses",
    f"""{_SECTION_ITEMS}, p AS (SELECT *, CASE WHEN category = 'favorability' AND {_PCT} <> '' THEN {_PCT} || '%' END AS pct,
      CASE WHEN category = 'classification' AND part = 0 AND strpos(text, ':') > 0 THEN {_AFTER} WHEN category = 'classification' AND part = 0 AND strpos(text, '–') > 0 THEN nullif(trim(substr(text, strpos(text, '–') + 1)), '')
        WHEN category = 'classification' AND part = 1 THEN nullif({Q.clean('text')}, '') END AS label FROM i WHERE group_code IS NOT NULL)
    SELECT job_id, group_code, min(section_no) AS first_section, first(group_name ORDER BY section_no, part, ord) FILTER (WHERE coalesce(group_name, '') <> '') AS group_name,
      first(pct ORDER BY section_no, part, ord) FILTER (WHERE pct IS NOT NULL) AS favorable_percentage, first(label ORDER BY section_no, part, ord) FILTER (WHERE label IS NOT NULL) AS classification,
      count(*) FILTER (WHERE category = 'technical_reading' AND part = 1) AS n_readings FROM p GROUP BY job_id, group_code""",
)
def ag_build_analyses(spark, sf):
    items = AN.section_items(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"])
    return AN.build_analyses(items, ["job_id"]).drop("last_section")


@query(
    "ag_readings",
    f"{_SECTION_ITEMS} SELECT job_id, group_code, row_number() OVER (PARTITION BY job_id, group_code ORDER BY ord) AS reading_no, md5(text) AS digest FROM i WHERE category = 'technical_reading' AND part = 1 AND group_code IS NOT NULL",
)
def ag_readings(spark, sf):
    items = AN.section_items(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"])
    return AN.readings(items, ["job_id"]).select("job_id", "group_code", "reading_no", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(
    "ag_conclusion",
    f"{_SECTION_ITEMS} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS paragraph_no, md5(text) AS digest FROM i WHERE category = 'conclusion' AND part = 1",
)
def ag_conclusion(spark, sf):
    items = AN.section_items(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"])
    return AN.conclusion(items, ["job_id"]).select("job_id", "paragraph_no", F.md5(F.col("value").cast("binary")).alias("digest"))


@query(
    "ag_category_coverage",
    f"""{_SECTIONS_SQL}{_SECTION_ROWS_SQL}, c AS (SELECT job_id, bool_or(category = 'prioritization') AS a, bool_or(category = 'action_plan') AS b, bool_or(category = 'conclusion') AS c FROM sec GROUP BY job_id)
    SELECT job_id, category FROM (SELECT job_id, unnest(['prioritization', 'action_plan', 'conclusion']) AS category, unnest([a, b, c]) AS has FROM c) AS x WHERE NOT has""",
)
def ag_category_coverage(spark, sf):
    sections = G.sections_of(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"])
    return AN.missing_categories(AN.category_coverage(sections, ["job_id"]), ["job_id"])


@query(
    "ag_pivot_sections",
    f"""{_SECTION_ITEMS}, nn AS (SELECT job_id, group_code, category, text, row_number() OVER (PARTITION BY job_id, group_code, category ORDER BY ord) AS line_no FROM i
      WHERE part = 1 AND group_code IS NOT NULL AND category IN ('overview', 'positive_points', 'critical_points', 'improvements'))
    SELECT job_id, group_code, line_no, max(md5(text)) FILTER (WHERE category = 'overview') AS overview, max(md5(text)) FILTER (WHERE category = 'positive_points') AS positive_points,
      max(md5(text)) FILTER (WHERE category = 'critical_points') AS critical_points, max(md5(text)) FILTER (WHERE category = 'improvements') AS improvements FROM nn GROUP BY 1, 2, 3""",
)
def ag_pivot_sections(spark, sf):
    items = AN.section_items(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"])
    wide = AN.pivot_sections(items, ["job_id"])
    return wide.select(
        "job_id", "group_code", "line_no",
        *[F.md5(F.col(c).cast("binary")).alias(c) for c in rules.TEXT_SLOT_CATEGORIES],
    )


@query(
    "st_union_sources",
    f"""{_SECTIONS_SQL}{_SECTION_ROWS_SQL}, a AS (SELECT job_id, section_no - base AS section_ord, section_title FROM sec JOIN z USING (job_id)), nn AS (SELECT job_id, count(*) AS k FROM a GROUP BY job_id)
    SELECT job_id, section_ord, section_title, 'psychosocial_agent' AS source_role FROM a UNION ALL SELECT job_id, section_ord + k, section_title, 'ergonomic_agent' FROM a JOIN nn USING (job_id)""",
)
def st_union_sources(spark, sf):
    """The same report as both sources: twice the sections, numbered on."""
    sections = stage(
        G.sections_of(G.segment_sections(report_units(spark, sf), ["job_id"]), ["job_id"]).select(
            "job_id", "section_ord", "section_title"
        ),
        "sections",
    )
    return AN.union_sources([("psychosocial_agent", sections), ("ergonomic_agent", sections)])
