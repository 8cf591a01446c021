"""Queries of the reconciliation, media and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyses as AN
from ..operators import media as M
from ..operators import reconcile as R
from ..plans.staging import stage
from . import sqltext as Q
from .inputs import cte, derive, load
from .registry import query


def prepared(spark, sf):
    groups = stage(R.official_groups(derive(spark, sf, "groups")), "registry")
    blocks = R.with_hints(derive(spark, sf, "blocks"))
    return blocks, groups


def planned(spark, sf, mode="jaccard"):
    blocks, groups = prepared(spark, sf)
    return blocks, groups, R.build_plan(blocks, groups, mode)


_PREP = f"""{cte('groups', 'blocks')}, g AS (SELECT job_id, ord, code, name, {Q.group_name('name')} AS nk FROM groups),
  b AS (SELECT job_id, source_id, ord, p_size, source_code, source_name, {Q.code('source_code')} AS sc, {Q.group_name('source_name')} AS nk FROM blocks),
  h AS (SELECT DISTINCT job_id, sc, nk FROM b),
  p AS (SELECT h.job_id, h.sc, h.nk, g.code, g.ord, coalesce(h.sc = g.code, false) AS same_code, {Q.similarity('h.nk', 'g.nk')} AS sim FROM h JOIN g ON g.job_id = h.job_id),
  s AS (SELECT *, CASE WHEN same_code THEN 0.55::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN sim = 1 THEN 0.45::DOUBLE WHEN sim >= 0.65 THEN 0.35::DOUBLE * sim ELSE 0.0::DOUBLE END AS raw FROM p),
  c AS (SELECT *, round(least(raw, 1.0), 4) AS score, concat_ws(',', CASE WHEN same_code THEN 'same_code' END, CASE WHEN sim = 1 THEN 'same_name' WHEN sim >= 0.65 THEN 'similar_name' END) AS reasons FROM s WHERE raw >= 0.3)"""
_PLAN = f"""{_PREP}, a AS (SELECT job_id, sc, nk, count(*) AS n, count(*) FILTER (WHERE same_code AND (sim = 1 OR nk = '')) AS n_exact, max(code) FILTER (WHERE same_code AND (sim = 1 OR nk = '')) AS exact_code,
    first(code ORDER BY score DESC, ord) AS top_code FROM c GROUP BY 1, 2, 3),
  pl AS (SELECT b.job_id, b.source_id, b.ord, b.p_size, b.sc, b.nk, b.source_name, coalesce(a.n, 0) AS n_candidates, CASE WHEN a.n_exact = 1 THEN 'auto_matched' ELSE 'needs_review' END AS status,
    CASE WHEN a.n_exact = 1 THEN exact_code END AS official_code, CASE WHEN a.n_exact = 1 THEN NULL WHEN a.n IS NULL THEN 'no_candidate' WHEN b.sc IS NOT NULL AND top_code <> b.sc THEN 'other_code_suggested' ELSE 'review_required' END AS warning
    FROM b LEFT JOIN a ON a.job_id = b.job_id AND a.sc IS NOT DISTINCT FROM b.sc AND a.nk = b.nk)"""


@query("reconcile_summary", f"{_PLAN} SELECT job_id, status, coalesce(warning, 'none') AS warning, count(*) AS n_blocks FROM pl GROUP BY 1, 2, 3")
def reconcile_summary(spark, sf):
    _, _, plan = planned(spark, sf)
    return plan.groupBy("job_id", "status", F.coalesce("warning", F.lit("none")).alias("warning")).agg(
        F.count(F.lit(1)).alias("n_blocks")
    )


@query(
    "jn_candidates",
    f"{_PREP} SELECT job_id, coalesce(sc, '') AS code_hint, nk AS name_key, code AS official_code, same_code, sim AS similarity, score, reasons FROM c",
)
def jn_candidates(spark, sf):
    blocks, groups = prepared(spark, sf)
    return R.candidates(R.distinct_hints(blocks), groups, "jaccard").drop("official_ord")


_PREP_EDIT = _PREP.replace(Q.similarity("h.nk", "g.nk"), Q.edit_similarity("h.nk", "g.nk"))


@query(
    "jn_candidates_edit",
    f"{_PREP_EDIT} SELECT job_id, coalesce(sc, '') AS code_hint, nk AS name_key, code AS official_code, same_code, sim AS similarity, score, reasons FROM c",
)
def jn_candidates_edit(spark, sf):
    blocks, groups = prepared(spark, sf)
    return R.candidates(R.distinct_hints(blocks), groups, "edit").drop("official_ord")


@query("jn_candidates_sequence")
def jn_candidates_sequence(spark, sf):
    """With the sequence ratio; compared with brute force in the tests."""
    blocks, groups = prepared(spark, sf)
    return R.candidates(R.distinct_hints(blocks), groups, "sequence").drop("official_ord")


@query(
    "so_rank_candidates",
    f"{_PREP} SELECT job_id, coalesce(sc, '') AS code_hint, nk AS name_key, code AS official_code, row_number() OVER (PARTITION BY job_id, sc, nk ORDER BY score DESC, ord) AS rank FROM c",
)
def so_rank_candidates(spark, sf):
    blocks, groups = prepared(spark, sf)
    return R.rank_candidates(R.candidates(R.distinct_hints(blocks), groups, "jaccard")).select(
        "job_id", "code_hint", "name_key", "official_code", "rank"
    )


@query("jn_build_plan", f"{_PLAN} SELECT job_id, source_id, n_candidates, status, official_code, warning FROM pl")
def jn_build_plan(spark, sf):
    _, _, plan = planned(spark, sf)
    return plan.select("job_id", "source_id", "n_candidates", "status", "official_code", "warning")


_NEXT = "'GHE ' || CASE WHEN p_size % 50 + 1 < 10 THEN '0' ELSE '' END || (p_size % 50 + 1)"
_DECIDE = f"""{_PLAN}, d AS (SELECT job_id, source_id, CASE WHEN source_id % 3 = 1 THEN {_NEXT} END AS target, source_id % 3 = 0 AS na FROM pl WHERE status = 'needs_review' AND source_id % 3 < 2),
  dd AS (SELECT d.*, g.code IS NOT NULL AS known, d.source_id % 10 = 9 AS twice FROM d LEFT JOIN g ON g.job_id = d.job_id AND g.code = d.target),
  ok AS (SELECT * FROM dd WHERE NOT twice AND (na OR known)),
  np AS (SELECT pl.job_id, pl.source_id, pl.ord, CASE WHEN ok.source_id IS NULL THEN pl.status WHEN ok.na THEN 'not_applicable' ELSE 'confirmed' END AS status,
    CASE WHEN ok.source_id IS NULL THEN pl.official_code WHEN ok.na THEN NULL ELSE ok.target END AS official_code, CASE WHEN ok.source_id IS NULL THEN pl.warning END AS warning
    FROM pl LEFT JOIN ok ON ok.job_id = pl.job_id AND ok.source_id = pl.source_id)"""


def decided(spark, sf):
    blocks, groups, plan = planned(spark, sf)
    plan = stage(plan, "plan")
    open_items = plan.where("status = 'needs_review' and source_id % 3 < 2")
    follower = F.concat(F.lit("GHE "), (F.col("p_size") % 50 + 1).cast("string"))
    decisions = open_items.select(
        "job_id", "source_id", F.when(F.col("source_id") % 3 == 1, follower).alias("target"),
        (F.col("source_id") % 3 == 0).alias("not_applicable"), F.lit("reviewed").alias("reason"),
        F.lit(None).cast("timestamp").alias("decided_at"),
    )
    # repeated decisions, and one for a source that does not exist
    repeated = decisions.where("source_id % 10 = 9")
    stray = groups.where("ord = 1").select(
        "job_id", F.lit(-1).cast("bigint").alias("source_id"), F.col("code").alias("target"), F.lit(False).alias("not_applicable"),
        F.lit("stray").alias("reason"), F.lit(None).cast("timestamp").alias("decided_at"),
    )
    return blocks, groups, *R.apply_decisions(plan, decisions.unionByName(repeated).unionByName(stray), groups)


@query("jn_apply_decisions", f"{_DECIDE} SELECT job_id, source_id, status, official_code, warning FROM np")
def jn_apply_decisions(spark, sf):
    return decided(spark, sf)[2].select("job_id", "source_id", "status", "official_code", "warning")


@query(
    "jn_decision_errors",
    f"{_DECIDE} SELECT job_id, source_id, CASE WHEN twice THEN 'duplicate_decision' ELSE 'unknown_target' END AS error FROM dd WHERE twice OR NOT (na OR known) UNION ALL SELECT job_id, -1, 'unknown_source' FROM g WHERE ord = 1",
)
def jn_decision_errors(spark, sf):
    return decided(spark, sf)[3]


@query("ag_multi_assignment", f"{_DECIDE} SELECT job_id, official_code, count(*) AS n_blocks FROM np WHERE official_code IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def ag_multi_assignment(spark, sf):
    return R.multi_assignment(decided(spark, sf)[2])


@query("ag_plan_complete", f"{_DECIDE} SELECT job_id, bool_and(status <> 'needs_review') AS complete FROM np GROUP BY 1")
def ag_plan_complete(spark, sf):
    blocks, _, plan, _ = decided(spark, sf)
    return R.plan_complete(blocks.select("job_id").distinct(), plan)


@query("fl_select_status", f"{_DECIDE} SELECT job_id, source_id, status FROM np WHERE status IN ('auto_matched', 'confirmed')")
def fl_select_status(spark, sf):
    return R.select_status(decided(spark, sf)[2], "auto_matched", "confirmed").select("job_id", "source_id", "status")


_EXC = "SELECT p_type AS job_id, p_partkey AS source_id, CASE WHEN p_partkey % 15 <> 4 OR p_type NOT IN ('PROMO', 'SMALL') THEN 'none' WHEN p_partkey % 2 = 0 THEN 'include' ELSE 'omit' END AS action, CAST(p_size AS BIGINT) * 1000000 + p_partkey AS ordinal FROM part"


def _exceptions(spark, sf):
    return spark.sql(_EXC.replace("FROM part", "FROM {part}"), part=load(spark, sf, "part"))


@query(
    "st_select_blocks",
    f"{_DECIDE}, e AS ({_EXC}) SELECT job_id, source_id FROM b WHERE ((job_id, source_id) IN (SELECT (job_id, source_id) FROM np WHERE status <> 'not_applicable') OR (job_id, source_id) IN (SELECT (job_id, source_id) FROM e WHERE action = 'include')) AND (job_id, source_id) NOT IN (SELECT (job_id, source_id) FROM e WHERE action = 'omit')",
)
def st_select_blocks(spark, sf):
    blocks, _, plan, _ = decided(spark, sf)
    return R.select_blocks(blocks, plan, _exceptions(spark, sf)).select("job_id", "source_id")


@query(
    "st_select_for_output",
    f"""{_DECIDE}, e AS ({_EXC}) SELECT b.job_id, b.source_id, e.ordinal AS place FROM b JOIN e ON e.job_id = b.job_id AND e.source_id = b.source_id AND e.action = 'include'
    UNION ALL SELECT np.job_id, np.source_id, coalesce(g.ord, 1099511627776 + np.ord) FROM np LEFT JOIN g ON g.job_id = np.job_id AND g.code = np.official_code
    WHERE np.status IN ('auto_matched', 'confirmed') AND np.job_id NOT IN (SELECT job_id FROM e WHERE action = 'include')""",
)
def st_select_for_output(spark, sf):
    blocks, groups, plan, _ = decided(spark, sf)
    return R.select_blocks_for_output(blocks, plan, groups, _exceptions(spark, sf)).select("job_id", "source_id", "place")


@query(
    "so_official_order",
    f"{_DECIDE} SELECT np.job_id, np.source_id, coalesce(g.ord, 1099511627776 + np.ord) AS place FROM np LEFT JOIN g ON g.job_id = np.job_id AND g.code = np.official_code",
)
def so_official_order(spark, sf):
    _, groups, plan, _ = decided(spark, sf)
    return R.official_order(plan, groups).select("job_id", "source_id", "place")


@query(
    "jn_unknown_targets",
    f"{_DECIDE} SELECT np.job_id, np.source_id FROM np WHERE official_code IS NOT NULL AND (job_id, official_code) NOT IN (SELECT (job_id, CASE WHEN ord % 2 = 0 THEN code ELSE code || ' B' END) FROM g)",
)
def jn_unknown_targets(spark, sf):
    _, groups, plan, _ = decided(spark, sf)
    return R.unknown_targets(plan, groups.withColumn("code", F.when(F.col("ord") % 2 == 0, F.col("code")).otherwise(F.concat("code", F.lit(" B"))))).select("job_id", "source_id")


@query(
    "jn_scope_mismatch",
    """WITH a AS (SELECT p_type AS job_id, CASE WHEN p_partkey % 3 = 0 THEN -p_partkey ELSE p_partkey END AS source_id FROM part), b AS (SELECT p_type AS job_id, CASE WHEN p_partkey % 5 = 0 THEN -p_partkey ELSE p_partkey END AS source_id FROM part)
    SELECT job_id, source_id, 'left' AS only_in FROM (FROM a EXCEPT FROM b) UNION ALL SELECT job_id, source_id, 'right' FROM (FROM b EXCEPT FROM a)""",
)
def jn_scope_mismatch(spark, sf):
    parts = load(spark, sf, "part").select(F.col("p_type").alias("job_id"), F.col("p_partkey").alias("source_id"))
    sides = [parts.withColumn("source_id", F.when(F.col("source_id") % n == 0, -F.col("source_id")).otherwise(F.col("source_id"))) for n in (3, 5)]
    return R.scope_mismatch(*sides, ["job_id", "source_id"])


@query(
    "jn_nominal_decisions",
    f"""{_PLAN}, best AS (SELECT job_id, nk, code, row_number() OVER (PARTITION BY job_id, nk ORDER BY sim DESC, ord) AS rn FROM (SELECT DISTINCT job_id, nk, code, ord, sim FROM p WHERE sim >= 0.95) AS q)
    SELECT pl.job_id, pl.source_id, best.code AS target, best.code IS NULL AS not_applicable FROM pl LEFT JOIN best ON best.job_id = pl.job_id AND best.nk = pl.nk AND best.rn = 1 WHERE pl.status <> 'auto_matched'""",
)
def jn_nominal_decisions(spark, sf):
    _, groups, plan = planned(spark, sf)
    return R.nominal_decisions(plan, groups).drop("reason")


_MEDIA = f"""{cte('groups', 'media')}, g AS (SELECT job_id, ord, code, name, {Q.group_name('name')} AS nk FROM groups),
  m AS (SELECT *, {Q.code('code_hint')} AS sc, {Q.group_name('name_hint')} AS nk FROM media), h AS (SELECT DISTINCT job_id, sc, nk FROM m),
  pairs AS MATERIALIZED (SELECT DISTINCT h.nk AS a, g.nk AS b FROM (SELECT DISTINCT job_id, nk FROM h) h JOIN (SELECT DISTINCT job_id, nk FROM g) g ON g.job_id = h.job_id),
  scored AS MATERIALIZED (SELECT a, b, {Q.similarity('a', 'b')} AS sim FROM pairs),
  p AS MATERIALIZED (SELECT h.job_id, h.sc, h.nk, g.code, g.ord, scored.sim FROM h JOIN g ON g.job_id = h.job_id JOIN scored ON scored.a = h.nk AND scored.b = g.nk),
  t AS (SELECT *, row_number() OVER w AS rn, lead(sim) OVER w AS runner FROM p WINDOW w AS (PARTITION BY job_id, sc, nk ORDER BY sim DESC, ord)),
  best AS (SELECT job_id, sc, nk, CASE WHEN nk <> '' AND sim >= 0.82 AND (runner IS NULL OR sim > runner) THEN code END AS name_code FROM t WHERE rn = 1),
  x AS (SELECT h.job_id, h.sc, h.nk, best.name_code, p.code AS code_match, p.sim AS code_sim FROM h LEFT JOIN best ON best.job_id = h.job_id AND best.sc IS NOT DISTINCT FROM h.sc AND best.nk = h.nk
    LEFT JOIN p ON p.job_id = h.job_id AND p.sc IS NOT DISTINCT FROM h.sc AND p.nk = h.nk AND p.code = h.sc),
  y AS (SELECT *, CASE WHEN code_match IS NOT NULL AND name_code IS NOT NULL AND code_match <> name_code THEN NULL WHEN code_match IS NOT NULL AND (nk = '' OR code_sim >= 0.65) THEN code_match ELSE name_code END AS official_code,
    coalesce(code_match <> name_code, false) AS conflict FROM x),
  am AS (SELECT m.job_id, m.image_id, m.ord, m.role, m.code_hint, y.official_code, CASE WHEN conflict THEN 'code_name_conflict' WHEN m.sc IS NOT NULL AND y.official_code IS NULL THEN 'review_required' END AS warning
    FROM m JOIN y ON y.job_id = m.job_id AND y.sc IS NOT DISTINCT FROM m.sc AND y.nk = m.nk)"""


def associated(spark, sf):
    groups = stage(R.official_groups(derive(spark, sf, "groups")), "registry")
    media = R.with_hints(derive(spark, sf, "media").withColumnRenamed("code_hint", "raw_code"), "raw_code", "name_hint")
    return R.associate_media(media, groups, "jaccard"), groups


@query("jn_associate_media", f"{_MEDIA} SELECT job_id, image_id, official_code, warning FROM am")
def jn_associate_media(spark, sf):
    return associated(spark, sf)[0].select("job_id", "image_id", "official_code", "warning")


@query(
    "so_top1_with_margin",
    f"{_MEDIA} SELECT DISTINCT job_id, nk AS name_key, name_code AS best_code FROM best WHERE name_code IS NOT NULL",
)
def so_top1_with_margin(spark, sf):
    groups = stage(R.official_groups(derive(spark, sf, "groups")), "registry")
    media = R.with_hints(derive(spark, sf, "media").withColumnRenamed("code_hint", "raw_code"), "raw_code", "name_hint")
    return R.top1_with_margin(media, groups, 0.82, "jaccard").select("job_id", "name_key", "best_code")


@query(
    "ag_unanimous_code",
    f"{_MEDIA} SELECT job_id, code_hint AS block, CASE WHEN count(DISTINCT official_code) = 1 THEN max(official_code) END AS official_code FROM am GROUP BY 1, 2",
)
def ag_unanimous_code(spark, sf):
    media, _ = associated(spark, sf)
    return R.unanimous_code(media.withColumn("block", F.col("raw_code")), ["job_id", "block"])


@query("ag_media_coverage", f"{_MEDIA} SELECT DISTINCT job_id, official_code AS code FROM am WHERE official_code IS NOT NULL")
def ag_media_coverage(spark, sf):
    return M.media_coverage(associated(spark, sf)[0])


@query("jn_coverage_gaps", f"{_MEDIA} SELECT job_id, code FROM g WHERE (job_id, code) NOT IN (SELECT (job_id, official_code) FROM am WHERE official_code IS NOT NULL AND ord % 3 = 0)")
def jn_coverage_gaps(spark, sf):
    media, groups = associated(spark, sf)
    return AN.coverage_gaps(groups, M.media_coverage(media.withColumn("official_code", F.when(F.col("ord") % 3 == 0, F.col("official_code")))))


_CTX = f"""{cte('context_units')}, u AS (SELECT *, {Q.code('text')} AS code, {Q.ref_name('text')} AS nm, {Q.contextual('text')} AS ctx FROM context_units),
  i AS (SELECT job_id, ord, text AS own, ctx AND text IS NOT NULL AS own_ctx, code AS own_code, nm AS own_name FROM u WHERE kind = 'image'),
  b AS (SELECT i.job_id, i.ord, t.text, t.code, t.nm, t.ord AS t_ord, row_number() OVER (PARTITION BY i.job_id, i.ord ORDER BY t.ord DESC) AS k FROM i JOIN u t ON t.job_id = i.job_id AND t.kind = 'text' AND t.ctx AND t.ord < i.ord),
  a AS (SELECT i.job_id, i.ord, t.text, t.ord AS t_ord, row_number() OVER (PARTITION BY i.job_id, i.ord ORDER BY t.ord) AS k FROM i JOIN u t ON t.job_id = i.job_id AND t.kind = 'text' AND t.ctx AND t.ord > i.ord),
  c AS (SELECT job_id, ord, min(k) AS code_k FROM b WHERE code IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT i.*, c.code_k, CASE WHEN own_ctx THEN 1 ELSE 2 END AS need, CASE WHEN own_ctx THEN 3 ELSE 4 END AS room FROM i LEFT JOIN c ON c.job_id = i.job_id AND c.ord = i.ord),
  l AS (SELECT s.*, least(room, CASE WHEN own_code IS NOT NULL THEN need WHEN code_k IS NOT NULL THEN greatest(need, code_k) ELSE room END) AS take FROM s),
  r AS (SELECT l.job_id, l.ord, l.own, l.own_ctx, coalesce(l.own_code, bc.code) AS code_hint, CASE WHEN l.own_code IS NOT NULL THEN l.own_name ELSE bc.nm END AS name_hint,
    (SELECT string_agg(b.text, ' | ' ORDER BY b.t_ord) FROM b WHERE b.job_id = l.job_id AND b.ord = l.ord AND b.k <= l.take) AS prev,
    (SELECT string_agg(a.text, ' | ' ORDER BY a.t_ord) FROM a WHERE a.job_id = l.job_id AND a.ord = l.ord AND a.k <= 2) AS foll,
    (SELECT a.text FROM a WHERE a.job_id = l.job_id AND a.ord = l.ord AND a.k = 1) AS f1, (SELECT b.text FROM b WHERE b.job_id = l.job_id AND b.ord = l.ord AND b.k = 1 AND l.take >= 1) AS p1
    FROM l LEFT JOIN b bc ON bc.job_id = l.job_id AND bc.ord = l.ord AND bc.k = l.code_k)"""


@query(
    "wn_nearest_context",
    f"{_CTX} SELECT job_id, ord, concat_ws(' | ', prev, CASE WHEN own_ctx THEN own END, foll) AS context, coalesce(own, f1, p1) AS caption, code_hint, name_hint FROM r",
)
def wn_nearest_context(spark, sf):
    return M.nearest_context(derive(spark, sf, "context_units")).drop("role")


_GEO = f"""{cte('groups', 'media')}, g AS (SELECT job_id, code, row_number() OVER (PARTITION BY job_id ORDER BY ord) + 1 AS seg FROM (SELECT CASE WHEN ord <= 20 THEN job_id ELSE job_id || ' outro' END AS job_id, code, ord FROM groups) AS o),
  d AS (SELECT *, width / height AS r, width / height BETWEEN 2.5 AND 3.5 AND height BETWEEN 350 AND 700 AS dash FROM (SELECT * FROM media UNION ALL SELECT * REPLACE (job_id || ' outro' AS job_id) FROM media) AS both_jobs),
  n AS (SELECT *, sum(CASE WHEN dash THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord)::BIGINT AS seg, count(*) OVER (PARTITION BY job_id) AS nm, count(*) FILTER (WHERE dash) OVER (PARTITION BY job_id) AS nd FROM d),
  k AS (SELECT n.*, g.code FROM n LEFT JOIN g ON g.job_id = n.job_id AND g.seg = n.seg WHERE n.seg >= 1 AND nm >= 2 AND nd >= 2 AND (n.seg = 1 OR g.code IS NOT NULL)),
  q AS (SELECT *, row_number() OVER (PARTITION BY job_id, seg ORDER BY ord) AS place FROM k)"""


def _short_registry(spark, sf):
    """All groups; those behind the twentieth belong to a second job, which has the same media."""
    return derive(spark, sf, "groups").withColumn(
        "job_id", F.when(F.col("ord") <= 20, F.col("job_id")).otherwise(F.concat("job_id", F.lit(" outro")))
    )


def _media_of_both(spark, sf):
    media = derive(spark, sf, "media").drop("role")
    return media.union(media.withColumn("job_id", F.concat("job_id", F.lit(" outro"))))


@query(
    "wn_segment_by_geometry",
    f"""{_GEO} SELECT job_id, image_id, seg AS segment_no, code, CASE WHEN place = 1 THEN CASE WHEN seg = 1 THEN 'general_panel' ELSE 'ghe_panel' END WHEN place = 2 THEN 'chart' WHEN place = 3 THEN 'domain_summary'
      WHEN place IN (4, 5) AND r >= 3 THEN 'risk_matrix' ELSE 'other' END AS role FROM q""",
)
def wn_segment_by_geometry(spark, sf):
    placed, _ = M.segment_by_geometry(_media_of_both(spark, sf), _short_registry(spark, sf))
    return placed.select("job_id", "image_id", "segment_no", "code", "role")


@query(
    "wn_surplus_segments",
    f"{_GEO} SELECT job_id, 'segment_without_group' AS warning FROM (SELECT DISTINCT job_id, nd FROM n WHERE nd >= 2 AND nm >= 2) AS z WHERE nd > (SELECT max(seg) FROM g WHERE g.job_id = z.job_id)",
)
def wn_surplus_segments(spark, sf):
    return M.segment_by_geometry(_media_of_both(spark, sf), _short_registry(spark, sf))[1]


@query(
    "wn_default_first_role",
    f"""{cte('media')}, f AS (SELECT *, row_number() OVER (PARTITION BY job_id, code_hint ORDER BY ord) AS rn FROM media)
    SELECT job_id, image_id, CASE WHEN rn = 1 AND role = 'other' THEN CASE WHEN code_hint IS NULL THEN 'general_panel' ELSE 'ghe_panel' END ELSE role END AS role FROM f""",
)
def wn_default_first_role(spark, sf):
    return M.default_first_role(derive(spark, sf, "media")).select("job_id", "image_id", "role")


@query(
    "so_pick_media",
    f"""{cte('media')}, d AS (SELECT *, coalesce(code_hint, '-') AS block, width / height AS r FROM media),
    p AS (SELECT job_id, block, coalesce(first(ord ORDER BY ord) FILTER (WHERE role IN ('ghe_panel', 'general_panel')), first(ord ORDER BY ord) FILTER (WHERE r >= 2.2)) AS panel FROM d GROUP BY 1, 2)
    SELECT d.job_id, d.block, 'img-' || any_value(p.panel) AS panel_id,
      coalesce(first(image_id ORDER BY ord) FILTER (WHERE role IN ('chart', 'radar')), first(image_id ORDER BY ord) FILTER (WHERE r BETWEEN 1.6 AND 3.0 AND ord IS DISTINCT FROM p.panel)) AS chart_id,
      coalesce(first(image_id ORDER BY ord) FILTER (WHERE role = 'risk_matrix'), first(image_id ORDER BY ord DESC) FILTER (WHERE r >= 3.0)) AS matrix_id
    FROM d JOIN p ON p.job_id = d.job_id AND p.block = d.block GROUP BY d.job_id, d.block""",
)
def so_pick_media(spark, sf):
    media = derive(spark, sf, "media").withColumn("block", F.coalesce("code_hint", F.lit("-")))
    return M.pick_media(media, ["job_id", "block"])


@query(
    "so_global_matrix",
    f"{cte('media')} SELECT job_id, coalesce(first(image_id ORDER BY ord) FILTER (WHERE role = 'risk_matrix' AND code_hint IS NULL), first(image_id ORDER BY ord DESC) FILTER (WHERE width / height >= 3.0)) AS matrix_id FROM media WHERE code_hint IS NULL GROUP BY job_id",
)
def so_global_matrix(spark, sf):
    return M.pick_global_matrix(derive(spark, sf, "media").where("code_hint is null"))


_AN = f"""{cte('groups', 'dq_analyses')}, g AS (SELECT job_id, code, {Q.key('name')} AS nk FROM groups),
  a AS (SELECT CASE WHEN ord % 2 = 0 THEN 'PROMO' ELSE 'SMALL' END AS job_id, analysis_id, ord, CASE WHEN ord % 2 = 0 THEN group_code END AS group_code, group_name FROM dq_analyses),
  k AS (SELECT job_id, analysis_id, ord, {Q.code('group_code')} AS code, {Q.key('group_name')} AS hay FROM a),
  m AS (SELECT g.job_id, g.code, k.analysis_id, k.ord, coalesce(k.code = g.code, false) AS by_code, g.nk <> '' AND contains(k.hay, g.nk) AS by_name FROM g JOIN k ON k.job_id = g.job_id)"""


def _analyses(spark, sf):
    base = derive(spark, sf, "dq_analyses").select("analysis_id", "ord", "group_code", "group_name")
    even = F.col("ord") % 2 == 0
    dealt = base.withColumn("job_id", F.when(even, "PROMO").otherwise("SMALL")).withColumn("group_code", F.when(even, F.col("group_code")))
    return derive(spark, sf, "groups"), dealt


@query(
    "jn_analysis_for_group",
    f"{_AN} SELECT job_id, code, first(analysis_id ORDER BY by_code DESC, ord) AS analysis_id, CASE WHEN bool_or(by_code) THEN 'code' ELSE 'name' END AS matched_by FROM m WHERE by_code OR by_name GROUP BY 1, 2",
)
def jn_analysis_for_group(spark, sf):
    return AN.analysis_for_group(*_analyses(spark, sf), "compile")


@query(
    "jn_analysis_for_group_validate",
    f"{_AN} SELECT job_id, code, first(analysis_id ORDER BY ord) AS analysis_id FROM m WHERE by_code OR by_name GROUP BY 1, 2",
)
def jn_analysis_for_group_validate(spark, sf):
    return AN.analysis_for_group(*_analyses(spark, sf), "validate").drop("matched_by")


@query(
    "jn_block_for_group",
    f"{_AN}, s AS (SELECT *, CASE WHEN by_code THEN 10 ELSE 0 END + CASE WHEN by_name THEN 4 ELSE 0 END AS score FROM m) SELECT job_id, code, first(analysis_id ORDER BY score DESC, ord) AS block_id, max(score) AS score FROM s WHERE score > 0 GROUP BY 1, 2",
)
def jn_block_for_group(spark, sf):
    groups, analyses = _analyses(spark, sf)
    blocks = analyses.select("job_id", F.col("analysis_id").alias("block_id"), "ord", F.col("group_code").alias("code"), F.col("group_name").alias("name"))
    return AN.block_for_group(groups, blocks)


@query(
    "ag_merge_analyses",
    """WITH a AS (SELECT p_type AS job_id, p_partkey AS ord, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'ghe ' || p_size ELSE 'GHE ' || p_size END AS group_code, p_name AS group_name,
        CASE WHEN p_partkey % 3 = 1 THEN p_size || '%' END AS favorable_percentage, CASE WHEN p_partkey % 5 = 1 THEN p_brand END AS classification, CAST(p_size % 4 AS BIGINT) AS n_readings FROM part),
      m AS (SELECT job_id, min(ord) AS ord, first(group_code ORDER BY ord) AS group_code, first(group_name ORDER BY ord) AS group_name, first(favorable_percentage ORDER BY ord) FILTER (WHERE favorable_percentage IS NOT NULL) AS favorable_percentage,
        first(classification ORDER BY ord) FILTER (WHERE classification IS NOT NULL) AS classification, sum(n_readings)::BIGINT AS n_readings, count(*) AS n_merged, 0 AS loose FROM a WHERE group_code IS NOT NULL GROUP BY job_id, upper(group_code)
        UNION ALL SELECT job_id, ord, NULL, group_name, favorable_percentage, classification, n_readings, 1, 1 FROM a WHERE group_code IS NULL)
    SELECT job_id, group_code, group_name, favorable_percentage, classification, n_readings, n_merged, row_number() OVER (PARTITION BY job_id ORDER BY loose, ord) - 1 AS place FROM m""",
)
def ag_merge_analyses(spark, sf):
    part = load(spark, sf, "part")
    code = F.when(F.col("p_partkey") % 6 == 0, None).when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ghe "), "p_size")).otherwise(F.concat(F.lit("GHE "), "p_size"))
    analyses = part.select(
        F.col("p_type").alias("job_id"), F.col("p_partkey").alias("ord"), code.alias("group_code"), F.col("p_name").alias("group_name"),
        F.when(F.col("p_partkey") % 3 == 1, F.concat("p_size", F.lit("%"))).alias("favorable_percentage"),
        F.when(F.col("p_partkey") % 5 == 1, F.col("p_brand")).alias("classification"), (F.col("p_size") % 4).cast("bigint").alias("n_readings"),
    )
    return AN.merge_analyses(analyses)


_PROFILE = "SELECT p_type AS job_id, CASE WHEN p_partkey % 4 = 0 THEN 'omit' ELSE 'include' END AS action, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) + CASE WHEN p_type = 'PROMO' THEN 1 WHEN p_type = 'LARGE' AND p_partkey % 3 = 0 THEN -1 ELSE 0 END AS ordinal FROM part"


@query(
    "st_partition_check",
    f"""WITH l AS ({_PROFILE}), n AS (SELECT p_type AS job_id, count(*) AS n FROM part GROUP BY 1)
    SELECT n.job_id, n.n, count(*) FILTER (WHERE action = 'include') AS n_included, count(DISTINCT ordinal) = n.n AND count(*) = n.n AND min(ordinal) = 1 AND max(ordinal) = n.n AND count(*) FILTER (WHERE action = 'include') > 0 AS valid
    FROM n JOIN l ON l.job_id = n.job_id GROUP BY n.job_id, n.n""",
)
def st_partition_check(spark, sf):
    from ..plans.ordered import ordinal

    part = load(spark, sf, "part").select(F.col("p_type").alias("job_id"), "p_partkey")
    listed = ordinal(part, ["job_id"], ["p_partkey"], "_no").select(
        "job_id", F.when(F.col("p_partkey") % 4 == 0, "omit").otherwise("include").alias("action"),
        (F.col("_no") + F.when(F.col("job_id") == "PROMO", 1).when((F.col("job_id") == "LARGE") & (F.col("p_partkey") % 3 == 0), -1).otherwise(0)).alias("ordinal"),
    )
    return R.partition_check(listed, part.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")))


@query(
    "jn_profile_ids",
    """WITH b AS (SELECT o_custkey AS job_id, o_orderkey AS source_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ordinal FROM orders)
    SELECT job_id, source_id, ordinal, CASE WHEN ordinal IN (1, 3) THEN 'include' ELSE 'omit' END AS action FROM b WHERE ordinal <= 3""",
)
def jn_profile_ids(spark, sf):
    from ..plans.ordered import ordinal

    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("source_id"))
    blocks = ordinal(orders, ["job_id"], ["source_id"], "_no").withColumn("ord", F.col("_no") - 1)
    profile = orders.select("job_id").distinct().select(
        "job_id", F.array(F.lit(1).cast("bigint"), F.lit(3).cast("bigint")).alias("included"), F.array(F.lit(2).cast("bigint")).alias("omitted")
    )
    return R.profile_ids(profile, blocks)


@query(
    "jn_capacity_check",
    "SELECT p_type AS job_id, count(*) AS n_items, 330::BIGINT AS capacity FROM part GROUP BY 1 HAVING count(*) > 330",
)
def jn_capacity_check(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_type").alias("job_id"))
    contract = items.distinct().withColumn("capacity", F.lit(330).cast("bigint"))
    return AN.capacity_check(items, contract)
