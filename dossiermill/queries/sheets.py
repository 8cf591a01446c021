"""Queries of the registry operators, on spreadsheet rows made from order lines.

Every order is a job with one sheet: a title row, a header row in one of three
layouts, its lines, and a total row that is wrong for every tenth order.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import registry as R
from ..plans.ordered import STRETCH, ordinal
from ..plans.staging import stage
from .inputs import load
from .registry import query

_LINE = """SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_extendedprice AS p,
    l_discount AS d, l_tax AS t, l_shipdate AS sd, l_returnflag AS rf FROM """
_ORDER = ["ln", "pk", "sk", "q", "p", "d", "t", "sd"]
# the shared texts of the cells, by layout = job_id % 3
_CODE = "CASE WHEN rn = 1 OR rf = 'R' THEN CASE WHEN pk % 2 = 0 THEN CAST(pk % 40 AS STRING) ELSE 'GHE ' || (pk % 40) END ELSE '' END"
_NAME = "CASE WHEN pk % 3 = 0 THEN '' ELSE 'grupo ' || (pk % 40) END"
_COMBINED = "CASE WHEN rn = 1 OR rf = 'R' THEN 'GHE ' || (pk % 40) || CASE WHEN pk % 3 = 0 THEN '' ELSE ' - grupo ' || (pk % 40) END ELSE '' END"
_SECTOR = "'Setor ' || (pk % 5) || CASE WHEN pk % 4 = 0 THEN '; setor ' || (pk % 3) ELSE '' END"
_ROLE = "'Cargo ' || (pk % 7)"
_QTY = "CASE WHEN pk % 10 = 0 THEN 'n/a' ELSE CAST(CAST(q AS INT) AS STRING) END"
_PERSON = "CASE WHEN pk % 6 = 0 THEN '' ELSE 'pessoa ' || pk END"
_HEADERS = {
    0: ["Código GHE", "Nome GHE", "Setores", "Cargos", "Quantidade", "CPF"],
    1: ["GHE", "Observação", "Departamento", "Função", "QTD.", "Matrícula"],
    2: ["Código do GHE", "Nome do GHE", "Unidade", "Posto", "Nome Colaborador", "Obs"],
}


def _by_layout(*texts: str) -> str:
    return "CASE job_id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END".format(*texts)


_CELLS = [
    _by_layout(_CODE, _COMBINED, _CODE),
    _by_layout(_NAME, "'obs'", _NAME),
    _SECTOR,
    _ROLE,
    _by_layout(_QTY, _QTY, _PERSON),
    _by_layout(_PERSON, _PERSON, "'obs'"),
]


def sheet(spark, sf):
    """``job_id, sheet, sheet_ord, row_no, cells``."""
    lines = spark.sql(_LINE + "{lineitem}", lineitem=load(spark, sf, "lineitem"))
    facts = stage(
        lines.groupBy("job_id").agg(
            F.sum(F.when(F.col("pk") % 10 != 0, F.col("q").cast("int"))).alias("total"), (F.count(F.lit(1)) + 3).alias("last")
        ),
        "sheet-facts",
    )
    # an order's lines are few: they are numbered in one sort; only those of larger jobs are cut into stretches
    large = facts.where(F.col("last") > STRETCH + 3).select("job_id")
    in_order = F.row_number().over(Window.partitionBy("job_id").orderBy(*_ORDER)).cast("bigint")
    if large.isEmpty():
        numbered = lines.withColumn("rn", in_order)
    else:
        small = lines.join(large, "job_id", "left_anti").withColumn("rn", in_order)
        cut = ordinal(lines.join(large, "job_id", "left_semi"), ["job_id"], _ORDER, "rn", F.col("ln") * 1_000_000_000 + F.floor(F.col("pk") / 1000))
        numbered = small.unionByName(cut)
    body = numbered.select("job_id", (F.col("rn") + 2).alias("row_no"), F.array(*[F.expr(c) for c in _CELLS]).alias("cells"))
    wrong = F.when(F.col("job_id") % 10 == 0, 1).otherwise(0)
    total = F.array(
        F.lit("Total geral"), F.lit(""), F.lit(""), F.lit(""), (F.coalesce("total", F.lit(0)) + wrong).cast("string"), F.lit("")
    )
    header = F.array(*[F.lit(h) for h in _HEADERS[2]])
    for layout in (0, 1):
        header = F.when(F.col("job_id") % 3 == layout, F.array(*[F.lit(h) for h in _HEADERS[layout]])).otherwise(header)
    extra = facts.select(
        "job_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit("Setores e cargos"), F.lit("")).alias("cells")),
                F.struct(F.lit(2).cast("bigint").alias("row_no"), header.alias("cells")),
                F.struct(F.col("last").alias("row_no"), total.alias("cells")),
            )
        ).alias("r"),
    ).select("job_id", "r.*")
    rows = body.unionByName(extra).select(
        "job_id", F.lit("GHEs").alias("sheet"), F.lit(1).alias("sheet_ord"), "row_no", "cells"
    )
    return stage(rows, "sheet")  # a sheet is a stored table wherever it comes from


_ROWS_SQL = f"""WITH li AS ({_LINE} lineitem), rn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY {', '.join(_ORDER)}) AS rn FROM li),
  c AS (SELECT job_id, rn + 2 AS row_no, {', '.join(f'{e} AS c{i}' for i, e in enumerate(_CELLS, 1))} FROM rn),
  f AS (SELECT job_id, row_no, CASE WHEN job_id % 3 = 1 THEN nullif(regexp_extract(c1, 'GHE (\\d+)', 1), '') ELSE nullif(regexp_extract(c1, '(\\d+)$', 1), '') END AS num,
    CASE WHEN job_id % 3 = 1 THEN regexp_extract(c1, ' - (.*)$', 1) ELSE c2 END AS nm, c3 AS sector, c4 AS role,
    CASE WHEN job_id % 3 < 2 THEN try_cast(c5 AS BIGINT) END AS qty, CASE WHEN job_id % 3 = 2 THEN c5 <> '' ELSE c6 <> '' END AS present FROM c),
  o AS (SELECT *, CASE WHEN num IS NOT NULL THEN 'GHE ' || lpad(num, 2, '0') END AS own FROM f),
  w AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS code FROM o)"""
_GROUPS_SQL = f"""{_ROWS_SQL}, g AS (SELECT job_id, code, min(row_no) AS ord_at, coalesce(first(nm ORDER BY row_no) FILTER (WHERE own IS NOT NULL AND nm <> ''), code) AS name,
    coalesce(sum(qty), count(*) FILTER (WHERE job_id % 3 = 2 AND present))::BIGINT AS population, sum(qty) IS NULL AND count(*) FILTER (WHERE job_id % 3 = 2 AND present) > 0 AS counted,
    count(*) FILTER (WHERE own IS NOT NULL AND nm <> '') > 0 AS named FROM w WHERE code IS NOT NULL GROUP BY job_id, code)"""


@query(
    "wn_detect_header",
    """SELECT DISTINCT l_orderkey AS job_id, 2::BIGINT AS row_no, CASE l_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 7 ELSE 6 END AS score FROM lineitem""",
)
def wn_detect_header(spark, sf):
    return R.detect_header(sheet(spark, sf)).select("job_id", "row_no", "score")


def _rows(spark, sf):
    """Data rows, and the last row number of the sheets."""
    rows = sheet(spark, sf)
    return R.data_rows(rows, R.detect_header(rows)), R.last_row(rows)


def _split(spark, sf):
    """Data rows, declared totals (both are read: the rows are stored), and the last row number."""
    rows, last = _rows(spark, sf)
    return *R.split_total_rows(stage(rows, "sheet-rows")), last


def _grouped(spark, sf):
    """Data rows under their group's code, where nothing else of the sheet is read."""
    rows, last = _rows(spark, sf)
    return R.group_rows(R.split_total_rows(rows)[0], last)


@query("wn_forward_fill", f"{_ROWS_SQL} SELECT job_id, row_no, own AS own_code, code AS group_code FROM w WHERE code IS NOT NULL")
def wn_forward_fill(spark, sf):
    return _grouped(spark, sf).select("job_id", "row_no", "own_code", "group_code")


@query(
    "fl_split_total_rows",
    """SELECT l_orderkey AS job_id, count(*) AS n_data, (coalesce(sum(CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_quantity AS INT) END), 0) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END)::BIGINT AS declared_total
    FROM lineitem WHERE l_orderkey % 3 < 2 GROUP BY l_orderkey""",
)
def fl_split_total_rows(spark, sf):
    data, declared, _ = _split(spark, sf)
    return data.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_data")).join(declared, "job_id")


@query("ag_group_population", f"{_GROUPS_SQL} SELECT job_id, ord_at, code, name, population, counted, named FROM g")
def ag_group_population(spark, sf):
    return R.group_population(_grouped(spark, sf))


_DECLARED = "(SELECT l_orderkey AS job_id, sum(CASE WHEN l_partkey % 10 <> 0 THEN CAST(l_quantity AS INT) END) AS s FROM lineitem GROUP BY 1)"


@query(
    "ag_total_check",
    f"""{_GROUPS_SQL} SELECT g.job_id, sum(population)::BIGINT AS total_population, CASE WHEN g.job_id % 3 < 2 THEN (coalesce(any_value(s), 0) + CASE WHEN g.job_id % 10 = 0 THEN 1 ELSE 0 END)::BIGINT END AS declared_total,
      g.job_id % 3 < 2 AND sum(population) <> coalesce(any_value(s), 0) + CASE WHEN g.job_id % 10 = 0 THEN 1 ELSE 0 END AS diverges FROM g JOIN {_DECLARED} AS x ON x.job_id = g.job_id GROUP BY g.job_id""",
)
def ag_total_check(spark, sf):
    data, declared, last = _split(spark, sf)
    return R.total_check(R.group_population(R.group_rows(data, last)), declared)


@query(
    "ag_with_total",
    f"{_GROUPS_SQL} SELECT job_id, code || ' - ' || name AS label, population, false AS is_total FROM g UNION ALL SELECT job_id, 'TOTAL', sum(population)::BIGINT, true FROM g GROUP BY job_id",
)
def ag_with_total(spark, sf):
    return R.with_total(R.group_population(_grouped(spark, sf))).drop("ord_at")


_VALUES_SQL = f"""{_ROWS_SQL}, v AS (SELECT job_id, code, row_no, 'sector' AS kind, unnest(string_split(sector, '; ')) AS value, generate_subscripts(string_split(sector, '; '), 1) AS pos FROM w WHERE code IS NOT NULL
    UNION ALL SELECT job_id, code, row_no, 'role', role, 1 FROM w WHERE code IS NOT NULL),
  d AS (SELECT *, row_number() OVER (PARTITION BY job_id, code, kind, lower(value) ORDER BY row_no, pos) AS k FROM v)"""


@query("ag_group_values", f"{_VALUES_SQL} SELECT job_id, code, kind, value, row_no FROM d WHERE k = 1")
def ag_group_values(spark, sf):
    values = R.distinct_values(R.group_values(_grouped(spark, sf)))
    return values.select("job_id", "code", "kind", "value", F.col("at.row_no").alias("row_no"))


@query(
    "rd_drop_person_columns",
    """SELECT l_orderkey AS job_id, count(*) + 3 AS n_rows, 5 * (count(*) + 2) + 2 AS n_cells FROM lineitem GROUP BY 1""",
)
def rd_drop_person_columns(spark, sf):
    rows = sheet(spark, sf)
    kept = R.drop_person_columns(rows, R.detect_header(rows))
    return kept.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.size("cells")).alias("n_cells")
    )


@query(
    "rd_ignored_headers",
    "SELECT DISTINCT l_orderkey AS job_id, CASE l_orderkey % 3 WHEN 0 THEN 'CPF' WHEN 1 THEN 'Matrícula' ELSE 'Nome Colaborador' END AS header FROM lineitem",
)
def rd_ignored_headers(spark, sf):
    return R.ignored_person_headers(R.detect_header(sheet(spark, sf))).select("job_id", "header")


@query(
    "dq_extraction_warnings",
    f"""{_GROUPS_SQL}, t AS (SELECT g.job_id, g.job_id % 3 < 2 AND sum(population) <> coalesce(any_value(s), 0) + CASE WHEN g.job_id % 10 = 0 THEN 1 ELSE 0 END AS diverges FROM g JOIN {_DECLARED} AS x ON x.job_id = g.job_id GROUP BY g.job_id)
    SELECT job_id, code AS source_id, 'name_missing' AS code FROM g WHERE NOT named UNION ALL SELECT job_id, code, 'zero_population' FROM g WHERE population = 0
    UNION ALL SELECT DISTINCT job_id, NULL, 'population_counted' FROM g WHERE counted UNION ALL SELECT job_id, NULL, 'total_diverges' FROM t WHERE diverges""",
)
def dq_extraction_warnings(spark, sf):
    data, declared, last = _split(spark, sf)
    groups = stage(R.group_population(R.group_rows(data, last)), "groups")  # read five times
    return R.extraction_warnings(groups, R.total_check(groups, declared))


_DETAIL_GROUPS = "SELECT CAST(n_regionkey AS BIGINT) AS job_id, 'GHE ' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS code FROM nation"


def _detail_inputs(spark, sf):
    groups = spark.sql(_DETAIL_GROUPS.replace("FROM nation", "FROM {nation}"), nation=load(spark, sf, "nation"))
    nation = load(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("job_id"))
    customers = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select(
        "job_id", F.concat(F.when(F.col("n_nationkey") % 5 == 4, "Anexo ").otherwise("GHE "), "n_nationkey").alias("sheet"), F.col("n_nationkey").alias("sheet_ord"),
        (F.col("c_custkey") + 2).alias("row_no"),
        F.array(
            F.concat(F.lit("Setor "), F.col("c_mktsegment")), F.concat(F.lit("Cargo "), (F.col("c_custkey") % 9).cast("string"), F.lit("; apoio"))
        ).alias("cells"),
    )
    heads = nation.select(
        "job_id", F.concat(F.when(F.col("n_nationkey") % 5 == 4, "anexo-").otherwise("ghe-"), "n_nationkey").alias("sheet"), F.col("n_nationkey").alias("sheet_ord"),
        F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit("Setor"), F.lit("Cargo")).alias("cells"),
    )
    return groups, rows.unionByName(heads)


@query(
    "jn_enrich_from_details",
    """WITH c AS (SELECT CAST(n_regionkey AS BIGINT) AS job_id, 'GHE ' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS code, c_mktsegment AS seg, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4)
    SELECT DISTINCT job_id, code, 'sector' AS kind, 'Setor ' || seg AS value FROM c UNION ALL SELECT DISTINCT job_id, code, 'role', 'Cargo ' || (c_custkey % 9) FROM c
    UNION ALL SELECT DISTINCT job_id, code, 'role', 'apoio' FROM c
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'GHE ' || lpad(CAST(n_nationkey AS STRING), 2, '0'), 'sector', 'Setor próprio' FROM nation""",
)
def jn_enrich_from_details(spark, sf):
    groups, rows = _detail_inputs(spark, sf)
    own = groups.select(
        "job_id", "code", F.lit("sector").alias("kind"), F.lit(1).cast("bigint").alias("row_no"), F.lit(0).alias("pos"), F.lit("Setor próprio").alias("value")
    )
    return R.enrich_from_details(own, R.detail_rows(rows, groups)).select("job_id", "code", "kind", "value")


@query(
    "so_missing_details",
    "SELECT CAST(n_regionkey AS BIGINT) AS job_id, 'GHE ' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS code FROM nation WHERE n_nationkey % 5 = 4 OR n_nationkey NOT IN (SELECT c_nationkey FROM customer) ORDER BY 1, 2",
)
def so_missing_details(spark, sf):
    groups, rows = _detail_inputs(spark, sf)
    return R.missing_details(groups, R.detail_rows(rows, groups)).orderBy("job_id", "code")


@query("st_duplicate_keys", "SELECT l_orderkey AS job_id, l_linenumber AS code, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def st_duplicate_keys(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("code"))
    return R.duplicate_keys(rows, ["job_id", "code"])
