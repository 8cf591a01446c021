"""Queries of hashing, redaction, comparison and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions.hashing import content_sha256, json_text
from ..operators import compare as CP
from ..operators import lifecycle as LC
from ..operators import lineage as LN
from ..operators import segments as G
from ..plans.staging import stage
from . import sqltext as Q
from .inputs import cte, derive, load
from .registry import query


@query("hx_content_sha256", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def hx_content_sha256(spark, sf):
    return load(spark, sf, "documents").select("doc_id", content_sha256("text").alias("sha256"))


_FP = """WITH a AS (SELECT o_custkey AS job_id, CASE o_orderkey % 7 WHEN 0 THEN 'ghe' WHEN 1 THEN 'psychosocial_raw' WHEN 2 THEN 'ergo_raw' WHEN 3 THEN 'cnpj_card' WHEN 4 THEN 'technical_integrated' WHEN 5 THEN 'psychosocial_analysis' ELSE 'ergonomic_analysis' END AS role,
    min(sha256(CAST(o_orderkey AS STRING))) AS sha FROM orders GROUP BY 1, 2), j AS (SELECT c_custkey AS job_id, CASE WHEN c_custkey % 2 = 0 THEN 'integrated' ELSE 'separate' END AS mode FROM customer),
  r(mode, n, role) AS (VALUES ('integrated', 1, 'ghe'), ('integrated', 2, 'psychosocial_raw'), ('integrated', 3, 'ergo_raw'), ('integrated', 4, 'cnpj_card'), ('integrated', 5, 'technical_integrated'),
    ('separate', 1, 'ghe'), ('separate', 2, 'psychosocial_raw'), ('separate', 3, 'ergo_raw'), ('separate', 4, 'cnpj_card'), ('separate', 5, 'psychosocial_analysis'), ('separate', 6, 'ergonomic_analysis')),
  f AS (SELECT j.job_id, CASE WHEN count(a.sha) = count(*) THEN sha256('{"analysis_mode":"' || any_value(j.mode) || '","sources":[' || string_agg('{"role":"' || r.role || '","sha256":"' || a.sha || '"}', ',' ORDER BY r.n) || ']}') END AS fingerprint
    FROM j JOIN r ON r.mode = j.mode LEFT JOIN a ON a.job_id = j.job_id AND a.role = r.role GROUP BY j.job_id)"""


def _fingerprints(spark, sf):
    roles = ["ghe", "psychosocial_raw", "ergo_raw", "cnpj_card", "technical_integrated", "psychosocial_analysis", "ergonomic_analysis"]
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    artifacts = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("job_id"), role.alias("role"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256")
    )
    jobs = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("job_id"), F.when(F.col("c_custkey") % 2 == 0, "integrated").otherwise("separate").alias("analysis_mode")
    )
    return LN.job_fingerprint(jobs, artifacts)


@query("hx_job_fingerprint", f"{_FP} SELECT job_id, fingerprint FROM f")
def hx_job_fingerprint(spark, sf):
    return _fingerprints(spark, sf)


@query("hx_fingerprint_gate", f"{_FP} SELECT job_id, fingerprint IS NOT NULL AND job_id % 3 <> 0 AS applies FROM f")
def hx_fingerprint_gate(spark, sf):
    prints = stage(_fingerprints(spark, sf), "fingerprints")
    profiles = prints.select(
        "job_id", F.when(F.col("job_id") % 3 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.upper("fingerprint")).alias("input_fingerprint")
    )
    return LN.fingerprint_gate(prints, profiles)




@query(
    "hx_inventory_digest",
    r"""WITH m AS (SELECT doc_id, list_sort(regexp_extract_all(upper(regexp_replace(text, ' (de|the|und|que) ', ' {{FIELD_\1}} ', 'g')), '\{\{FIELD_[A-Z0-9_]+\}\}')) AS l FROM documents)
    SELECT doc_id, len(l) AS n_markers, sha256('[' || coalesce(array_to_string(list_transform(l, lambda x: '"' || x || '"'), ','), '') || ']') AS digest FROM m""",
)
def hx_inventory_digest(spark, sf):
    marked = F.upper(F.regexp_replace("text", " (de|the|und|que) ", " {{FIELD_$1}} "))
    markers = LN.markers_of(marked, "FIELD")
    return load(spark, sf, "documents").select("doc_id", markers.alias("m")).select(
        "doc_id", F.size("m").cast("bigint").alias("n_markers"), LN.digest_of(F.col("m")).alias("digest")
    )


_LANES_SQL = ", ".join(
    f"CAST(CAST(sum(CAST('0x' || substr(sha256('s' || m), {16 * k + 1}, 16) AS UBIGINT)::HUGEINT) AS HUGEINT) % 18446744073709551616 AS DECIMAL(20, 0)) AS lane{k}"
    for k in range(4)
)


@query(
    "hx_multiset_digest",
    f"""WITH d AS (SELECT l_suppkey AS artifact_id, CAST(l_partkey AS VARCHAR) || '-' || CAST(l_shipdate AS VARCHAR)[:10] AS m FROM lineitem)
    SELECT artifact_id, count(*) AS n, {_LANES_SQL} FROM d GROUP BY artifact_id""",
)
def hx_multiset_digest(spark, sf):
    """By month of shipment first: digests of the parts are added up."""
    marks = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("artifact_id"), F.month("l_shipdate").alias("month"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.substring(F.col("l_shipdate").cast("string"), 1, 10)).alias("m"),
    )
    return LN.merge_digests(LN.multiset_digest(marks, ["artifact_id", "month"], "m"), ["artifact_id"])


@query("hx_json_text", "SELECT event_id, to_json(event_type || chr(10) || '\"' || props) AS body FROM events")
def hx_json_text(spark, sf):
    raw = F.concat("event_type", F.lit('\n"'), "props")
    return load(spark, sf, "events").select("event_id", json_text(raw).alias("body"))


@query(
    "st_inventory_equal",
    """WITH a AS (SELECT l_orderkey AS job_id, l_partkey % 3 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS job_id, CASE WHEN l_orderkey % 4 = 0 THEN l_suppkey % 3 ELSE l_partkey % 3 END AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT coalesce(a.job_id, b.job_id) AS job_id, bool_and(coalesce(a.n = b.n, false)) AS equal FROM a FULL JOIN b ON a.job_id = b.job_id AND a.v = b.v GROUP BY 1""",
)
def st_inventory_equal(spark, sf):
    lines = load(spark, sf, "lineitem")
    left = lines.select(F.col("l_orderkey").alias("job_id"), (F.col("l_partkey") % 3).alias("v"))
    right = lines.select(
        F.col("l_orderkey").alias("job_id"), F.when(F.col("l_orderkey") % 4 == 0, F.col("l_suppkey") % 3).otherwise(F.col("l_partkey") % 3).alias("v")
    )
    return LN.inventory_equal(left, right, ["job_id"], "v")


@query(
    "hx_integrity_check",
    """SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'size_differs' ELSE 'hash_differs' END AS code FROM documents WHERE doc_id % 13 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0""",
)
def hx_integrity_check(spark, sf):
    docs = load(spark, sf, "documents")
    actual = docs.select(F.when(F.col("doc_id") % 13 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.octet_length("text").alias("size_bytes"), content_sha256("text").alias("sha256"))
    declared = docs.select(
        "doc_id", (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("size_bytes"),
        F.when(F.col("doc_id") % 7 == 0, F.md5(F.col("text").cast("binary"))).otherwise(F.upper(content_sha256("text"))).alias("sha256"),
    )
    return LN.integrity_check(declared, actual, ["doc_id"])


_LITERALS = {" the ": " {{FIELD_A}} ", "des": "{{FIELD_B}}", "{{FIELD_Z}}": "x", "und ": ""}


@query(
    "rd_redact_literals",
    f"""WITH r AS (SELECT doc_id, text, replace(replace(replace(text, ' the ', ' {{{{FIELD_A}}}} '), 'des', '{{{{FIELD_B}}}}'), 'und ', '') AS out FROM documents)
    SELECT doc_id, md5(out) AS digest, CASE WHEN out <> text THEN sha256({Q.clean('text')}) END AS removed_sha256 FROM r""",
)
def rd_redact_literals(spark, sf):
    out = LN.redact_literals(load(spark, sf, "documents").select("doc_id", "text"), "text", _LITERALS, "FIELD")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "removed_sha256")


# a dictionary of the words of benchmark passages and of their first four letters, each behind a blank
_NAMES = """b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{5,}')) AS word FROM benchmark), names AS (SELECT word FROM b UNION SELECT left(word, 4) FROM b),
    pieces AS (SELECT doc_id, unnest(string_split(text, ' ')) AS piece, unnest(range(len(string_split(text, ' ')))) AS place FROM documents),
    best AS (SELECT piece, max_by(word, length(word)) AS word FROM (SELECT DISTINCT piece, left(piece, n) AS start FROM pieces, (SELECT DISTINCT length(word) AS n FROM names)) AS s JOIN names ON word = start GROUP BY piece),
    redacted AS (SELECT doc_id, string_agg(CASE WHEN place > 0 AND word IS NOT NULL THEN '{{FIELD_' || upper(left(md5(word), 6)) || '}}' || substr(pieces.piece, length(word) + 1) ELSE pieces.piece END, ' ' ORDER BY place) AS out,
      count(word) FILTER (WHERE place > 0) AS n_replaced FROM pieces LEFT JOIN best ON best.piece = pieces.piece GROUP BY doc_id)"""


def _names(spark, sf):
    words = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{5,})"))).alias("word"))
    names = words.union(words.select(F.substring("word", 1, 4))).distinct()
    marker = F.concat(F.lit(" {{FIELD_"), F.upper(F.substring(F.md5(F.col("word").cast("binary")), 1, 6)), F.lit("}}"))
    return names.select(F.concat(F.lit(" "), "word").alias("literal"), marker.alias("replacement"), F.lit(0).alias("ord"))


@query(
    "rd_redact_dictionary",
    f"""WITH {_NAMES} SELECT doc_id, md5(out) AS digest, n_replaced, CASE WHEN n_replaced > 0 THEN sha256({Q.clean('text')}) END AS removed_sha256 FROM documents JOIN redacted USING (doc_id)""",
)
def rd_redact_dictionary(spark, sf):
    out = LN.redact_dictionary(load(spark, sf, "documents").select("doc_id", "text"), "text", _names(spark, sf), "FIELD")
    return out.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_replaced", "removed_sha256")


@query("rd_literals_left", f"WITH {_NAMES} SELECT doc_id, n_replaced AS n_left FROM redacted WHERE n_replaced > 0")
def rd_literals_left(spark, sf):
    return LN.literals_left(load(spark, sf, "documents"), ["doc_id"], "text", _names(spark, sf), "FIELD")


@query(
    "rd_redact_slots",
    f"""SELECT conv_id, turn, '{{{{FIELD_' || upper(role) || '_' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) || '}}}}' AS text, CASE WHEN {Q.clean('text')} <> '' THEN sha256({Q.clean('text')}) END AS removed_sha256 FROM conversations""",
)
def rd_redact_slots(spark, sf):
    rows = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return LN.redact_slots(rows, ["conv_id"], "role", ["turn"], "text", "FIELD").select("conv_id", "turn", "text", "removed_sha256")


@query(
    "fl_residual_markers",
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(upper(regexp_replace(text, ' (de|the|und|que) ', ' {{FIELD_\1}} ', 'g')), '\{\{FIELD_[A-Z0-9_]+\}\}')) AS marker FROM documents) SELECT doc_id, marker, count(*) AS n FROM m GROUP BY 1, 2""",
)
def fl_residual_markers(spark, sf):
    marked = F.upper(F.regexp_replace("text", " (de|the|und|que) ", " {{FIELD_$1}} "))
    return G.residual_markers(load(spark, sf, "documents").select("doc_id", marked.alias("t")), ["doc_id"], "t", "FIELD")


@query("jn_residual_hashes", "SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def jn_residual_hashes(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", content_sha256("text").alias("sha256"))
    return LN.residual_hashes(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"))


@query(
    "rd_verify_redaction",
    rf"""WITH o AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN text ELSE '{{{{FIELD_' || upper(role) || '_' || turn || '}}}}' END AS out FROM conversations), r AS (SELECT DISTINCT sha256({Q.clean('text')}) AS s FROM conversations)
    SELECT conv_id, sum(len(regexp_extract_all(out, '\{{\{{FIELD_[A-Z0-9_]+\}}\}}')))::BIGINT AS n_markers, count(*) FILTER (WHERE sha256({Q.clean('out')}) IN (SELECT s FROM r)) AS n_leaks FROM o GROUP BY 1""",
)
def rd_verify_redaction(spark, sf):
    from ..functions.text import clean_text

    conv = load(spark, sf, "conversations")
    marker = F.concat(F.lit("{{FIELD_"), F.upper("role"), F.lit("_"), F.col("turn").cast("string"), F.lit("}}"))
    out = conv.select("conv_id", F.when(F.col("turn") % 5 == 4, F.col("text")).otherwise(marker).alias("text"))
    removed = conv.select(content_sha256(clean_text("text")).alias("sha256"))
    return LN.verify_redaction(out, ["conv_id"], "text", removed, "FIELD")


# --- comparison ---------------------------------------------------------------------

_PAIRS = "SELECT a.doc_id AS pair_id, a.text AS ref, b.text AS cand FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0"


def _pairs(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    left = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"), F.col("text").alias("ref"))
    right = docs.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("cand"))
    return left.join(right, "pair_id")


@query(
    "cp_line_containment",
    f"""WITH p AS ({_PAIRS}), q AS (SELECT pair_id, ref, CASE WHEN pair_id % 4 = 0 THEN cand ELSE cand || chr(10) || substr(ref, 1, CAST(floor(length(ref) / 2) AS INT)) END AS cand FROM p),
    l AS (SELECT pair_id, cand, string_split(CASE WHEN ends_with(ref, chr(10)) THEN ref[:-2] ELSE ref END, chr(10)) AS lines FROM q)
    SELECT pair_id, CAST(floor(100000 * len(list_filter(lines, lambda x: x <> '' AND contains(cand, x))) / len(lines) + 0.5) AS BIGINT) AS share FROM l""",
)
def cp_line_containment(spark, sf):
    half = F.substring(F.col("ref"), F.lit(1), F.floor(F.length("ref") / 2).cast("int"))
    cand = F.when(F.col("pair_id") % 4 == 0, F.col("cand")).otherwise(F.concat("cand", F.lit("\n"), half))
    return _pairs(spark, sf).select("pair_id", F.round(CP.line_containment(F.col("ref"), cand) * 100000).cast("bigint").alias("share"))


def _words_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _shingles_of(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 3 THEN [array_to_string({words}, ' ')] ELSE list_distinct(list_transform(range(1, len({words}) - 1), lambda i: {words}[i] || ' ' || {words}[i + 1] || ' ' || {words}[i + 2])) END"


@query(
    "cp_shingle_similarity",
    f"""WITH p AS ({_PAIRS}), q AS (SELECT pair_id, ref, CASE WHEN pair_id % 4 = 0 THEN cand ELSE cand || chr(10) || substr(ref, 1, CAST(floor(length(ref) / 2) AS INT)) END AS cand FROM p),
    w AS (SELECT pair_id, {_words_of('ref')} AS a, {_words_of('cand')} AS b FROM q), s AS (SELECT pair_id, {_shingles_of('a')} AS a, {_shingles_of('b')} AS b FROM w),
    n AS (SELECT pair_id, len(list_intersect(a, b)) AS shared, len(a) + len(b) AS total FROM s)
    SELECT pair_id, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE round(shared / (total - shared), 5) END AS similarity FROM n""",
)
def cp_shingle_similarity(spark, sf):
    half = F.substring(F.col("ref"), F.lit(1), F.floor(F.length("ref") / 2).cast("int"))
    cand = F.when(F.col("pair_id") % 4 == 0, F.col("cand")).otherwise(F.concat("cand", F.lit("\n"), half))
    return _pairs(spark, sf).select("pair_id", CP.shingle_similarity(F.col("ref"), cand).alias("similarity"))


@query(
    "cp_structure_diff",
    """WITH a AS (SELECT conv_id AS job_id, CASE WHEN turn % 7 = 5 THEN turn + 1000000 ELSE turn END AS ord, role, length(text) AS n FROM conversations), b AS (SELECT conv_id AS job_id, CASE WHEN conv_id % 6 = 1 AND turn % 2 = 1 THEN turn + 2000000 ELSE turn END AS ord, CASE WHEN conv_id % 4 = 0 AND turn % 3 = 0 THEN 'x' ELSE role END AS role, length(text) AS n FROM conversations)
    SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.ord, b.ord) AS ord, CASE WHEN a.job_id IS NULL THEN 'only_right' WHEN b.job_id IS NULL THEN 'only_left' ELSE 'changed' END AS state
    FROM a FULL JOIN b ON a.job_id = b.job_id AND a.ord = b.ord WHERE a.role IS DISTINCT FROM b.role OR a.n IS DISTINCT FROM b.n""",
)
def cp_structure_diff(spark, sf):
    base = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), "role", F.length("text").alias("n")
    )
    at = F.col("ord")
    left = base.withColumn("ord", F.when(at % 7 == 5, at + 1_000_000).otherwise(at))
    right = base.withColumn("role", F.when((F.col("job_id") % 4 == 0) & (at % 3 == 0), "x").otherwise(F.col("role"))).withColumn(
        "ord", F.when((F.col("job_id") % 6 == 1) & (at % 2 == 1), at + 2_000_000).otherwise(at)
    )
    return CP.structure_diff(left, right, ["job_id"], "ord", ["role", "n"])


@query(
    "jn_align_by_ordinal",
    "SELECT a.conv_id, a.turn, length(a.text) AS left_n, length(b.text) AS right_n FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn + b.conv_id % 2 = a.turn",
)
def jn_align_by_ordinal(spark, sf):
    base = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return CP.align_by_ordinal(base, base.withColumn("turn", F.col("turn") + F.col("conv_id") % 2), ["conv_id"], "turn")


@query(
    "cp_array_diff",
    """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: floor(x::DOUBLE * 512 + 128)) AS a, list_transform(b.embedding, lambda x: floor(x::DOUBLE * 512 + 128)) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    d AS (SELECT vec_id, a, b, list_transform(generate_series(1, len(a)), lambda i: abs(a[i] - b[i])) AS d FROM p)
    SELECT vec_id, CAST(list_sum(d) AS BIGINT) AS total_difference, len(list_filter(d, lambda x: x > 16)) AS n_changed, list_sum(a) / len(a) > 128 AS left_blank, list_sum(b) / len(b) > 128 AS right_blank, list_sum(b) / len(b) > 128 AND NOT list_sum(a) / len(a) > 128 AS unexpected_blank FROM d""",
)
def cp_array_diff(spark, sf):
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 512 + 128).cast("double"))
    vectors = load(spark, sf, "embeddings").select("vec_id", scaled.alias("v"))
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    m = CP.array_diff_metrics(F.col("v"), F.col("w"), rules.ARRAY_DIFF_THRESHOLD, 128.0)
    return vectors.join(after, "vec_id").select("vec_id", F.size("v").alias("n"), m.alias("m")).select(
        "vec_id", F.round(F.col("m.mean_difference") * F.col("n")).cast("bigint").alias("total_difference"),
        F.round(F.col("m.changed_ratio") * F.col("n")).cast("bigint").alias("n_changed"),
        "m.left_blank", "m.right_blank", "m.unexpected_blank",
    )


# --- lifecycle ------------------------------------------------------------------------

_LOG = cte("event_log")
_LATEST = f"""{_LOG}, l AS (SELECT job_id, first(status ORDER BY ts DESC, event_id DESC) AS status, max(ts) AS updated_at, least(greatest(first(progress ORDER BY ts DESC, event_id DESC), 0), 100) AS progress, count(*) AS n_events FROM event_log GROUP BY 1),
  now AS (SELECT max(ts) AS t FROM event_log)"""


def _micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("lc_latest_state", f"{_LATEST} SELECT job_id, status, strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, progress, n_events FROM l")
def lc_latest_state(spark, sf):
    s = LC.latest_state(derive(spark, sf, "event_log"))
    return s.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("lc_expired", f"{_LATEST} SELECT job_id, status FROM l, now WHERE epoch_us(t) - epoch_us(updated_at) >= 900 * 1000000 AND status NOT IN ('receiving', 'validating', 'generating')")
def lc_expired(spark, sf):
    log = derive(spark, sf, "event_log")
    return LC.expired(LC.latest_state(log), LC.as_of(log)).select("job_id", "status")


@query("lc_expired_store", f"{_LATEST} SELECT job_id, status FROM l, now WHERE epoch_us(t) - epoch_us(updated_at) > 7200 * 1000000::BIGINT")
def lc_expired_store(spark, sf):
    log = derive(spark, sf, "event_log")
    return LC.expired(LC.latest_state(log), LC.as_of(log), 7200, "store").select("job_id", "status")


@query("lc_stalled", f"{_LATEST} SELECT job_id, 'failed' AS status, greatest(55, progress) AS progress, 'generation_timeout' AS error_code FROM l, now WHERE status = 'generating' AND epoch_us(t) - epoch_us(updated_at) >= 600 * 1000000")
def lc_stalled(spark, sf):
    log = derive(spark, sf, "event_log")
    return LC.stalled(LC.latest_state(log), LC.as_of(log))


@query(
    "lc_orphans",
    f"""{_LOG}, s AS (SELECT CASE WHEN job_id % 10 = 0 THEN 'x' ELSE '' END || md5(CAST(job_id AS STRING)) AS id, job_id, ts FROM event_log), now AS (SELECT max(ts) AS t FROM event_log),
    r AS (SELECT id, event_type, max(ts) AS m FROM (SELECT CASE WHEN user_id % 10 = 0 THEN 'x' ELSE '' END || md5(CAST(user_id AS STRING)) AS id, event_type, ts, user_id FROM events WHERE user_id % 4 > 0) AS e GROUP BY 1, 2)
    SELECT id AS job_id, count(*) AS n_roots FROM r, now WHERE length(id) = 32 GROUP BY id HAVING bool_and(epoch_us(t) - epoch_us(m) >= 43200 * 1000000::BIGINT)""",
)
def lc_orphans(spark, sf):
    """Storage roots stand for event types; every fourth user is a live job."""
    events = load(spark, sf, "events").select(
        F.concat(F.when(F.col("user_id") % 10 == 0, "x").otherwise(""), F.md5(F.col("user_id").cast("string").cast("binary"))).alias("job_id"),
        "user_id", F.col("event_type").alias("root"), "ts",
    )
    listing = events.groupBy("root", "job_id").agg(F.max("ts").alias("modified_at")).withColumn("is_directory", F.lit(True))
    active = events.where("user_id % 4 = 0").select("job_id")
    return LC.orphans(listing, active, LC.as_of(events), 43200)


@query(
    "lc_transition_check",
    f"""{_LOG}, e AS (SELECT *, CASE WHEN kind = 'start' THEN 'request' ELSE kind END AS k FROM event_log),
    w AS (SELECT *, last_value(CASE WHEN k <> 'request' THEN status END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT job_id, event_id, before, CASE before WHEN 'validating' THEN 'job_busy' WHEN 'failed' THEN 'validation_errors' WHEN 'completed' THEN 'already_completed' WHEN 'validated' THEN 'accepted' ELSE 'job_not_validated' END AS answer FROM w WHERE k = 'request'""",
)
def lc_transition_check(spark, sf):
    log = derive(spark, sf, "event_log").withColumn("has_decisions", F.lit(False)).withColumn(
        "kind", F.when(F.col("kind") == "start", "request").otherwise(F.col("kind"))
    )
    return LC.transition_check(log).select("job_id", "event_id", "before", "answer")


@query(
    "lc_valid_completions",
    f"""{_LOG}, a AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200 * 1000000::BIGINT AS gap, row_number() OVER w AS n FROM event_log WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    b AS (SELECT *, max(CASE WHEN gap THEN n END) OVER (PARTITION BY job_id ORDER BY n) AS silence, max(CASE WHEN kind IN ('start', 'complete', 'fail') THEN n END) OVER (PARTITION BY job_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_n FROM a)
    SELECT b.job_id, b.event_id, b.token, CASE WHEN o.kind IS DISTINCT FROM 'start' THEN 'not_generating' WHEN o.token <> b.token THEN 'wrong_token' WHEN b.silence > b.open_n THEN 'timed_out' ELSE 'valid' END AS verdict
    FROM b LEFT JOIN a o ON o.job_id = b.job_id AND o.n = b.open_n WHERE b.kind = 'complete'""",
)
def lc_valid_completions(spark, sf):
    return LC.valid_completions(derive(spark, sf, "event_log"), 43200).select("job_id", "event_id", "token", "verdict")


@query(
    "lc_first_claim",
    f"""{_LOG}, e AS (SELECT *, sum(CASE WHEN status = 'validated' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM event_log)
    SELECT job_id, epoch, first(event_id ORDER BY ts, event_id) AS event_id, count(*) - 1 AS n_refused FROM e WHERE kind = 'start' AND epoch > 0 GROUP BY 1, 2""",
)
def lc_first_claim(spark, sf):
    return LC.first_claim(derive(spark, sf, "event_log"))


@query(
    "lc_active_downloads",
    f"""{_LOG}, s AS (SELECT job_id, event_id, ts, sum(CASE download WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM event_log)
    SELECT job_id, event_id, (s - least(0, min(s) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))::BIGINT AS active_downloads FROM s""",
)
def lc_active_downloads(spark, sf):
    log = derive(spark, sf, "event_log").select("job_id", "ts", "event_id", F.col("download").alias("kind"))
    return LC.active_downloads(log).select("job_id", "event_id", "active_downloads")


@query(
    "lc_deletion_outcome",
    f"""{_LATEST} SELECT CASE WHEN job_id % 10 = 0 THEN 'x' ELSE '' END || md5(CAST(job_id AS STRING)) AS job_id, CASE WHEN job_id % 10 = 0 THEN 'retry' WHEN status IN ('validating', 'generating') OR job_id % 6 = 0 THEN 'busy' WHEN job_id % 7 < 5 THEN 'deleted' ELSE 'retry' END AS outcome FROM l""",
)
def lc_deletion_outcome(spark, sf):
    hashed = F.concat(F.when(F.col("user") % 10 == 0, "x").otherwise(""), F.md5(F.col("user").cast("string").cast("binary")))
    states = (
        LC.latest_state(derive(spark, sf, "event_log")).withColumnRenamed("job_id", "user")
        .withColumn("job_id", hashed).withColumn("active_downloads", F.when(F.col("user") % 6 == 0, 1).otherwise(0))
    )
    users = load(spark, sf, "events").select(F.col("user_id").alias("user")).distinct()
    removed = users.where("user % 7 < 5").select(hashed.alias("job_id"))
    return LC.deletion_outcome(states, removed)
