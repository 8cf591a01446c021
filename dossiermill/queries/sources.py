"""Queries of the source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions.hashing import content_sha256
from ..sources import artifacts as A
from ..sources.chunks import chained_digest, reassemble_chunks, reassembled_blocks
from ..sources.html import html_units
from ..sources.sheets import dispatch_contracts
from . import sqltext as Q
from .inputs import cte, derive, load
from .registry import query


@query(
    "src_artifact_inventory",
    """SELECT page_id, 'page' AS role, 'page-' || substr(sha256(html), 1, 12) AS artifact_id, 'html_doc' AS kind, '.html' AS extension,
    'text/html' AS media_type, octet_length(encode(html)) AS size_bytes, sha256(html) AS sha256, contains(lower(html), '<script') AS active_content FROM pages""",
)
def src_artifact_inventory(spark, sf):
    files = load(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("/in/"), "page_id", F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content")
    )
    return A.artifact_inventory(files, "page")


_HEADS = {
    0: ("504b0304", "docx"), 1: ("d0cf11e0a1b11ae1", "ole_doc"), 2: ("89504e470d0a1a0a", "png"),
    3: ("ffd8ff", "jpeg"), 4: ("524946460000000057454250", "webp"), 5: ("efbbbf", None), 6: ("", None),
}


@query(
    "src_detect_kind",
    """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'docx' WHEN 1 THEN 'ole_doc' WHEN 2 THEN 'png' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'webp' ELSE 'html_doc' END AS full_kind,
    CASE page_id % 7 WHEN 0 THEN 'docx' WHEN 1 THEN 'ole_doc' ELSE 'html_doc' END AS report_kind,
    CASE WHEN page_id % 7 >= 5 THEN 'html_doc' ELSE 'unknown' END AS strict_kind FROM pages""",
)
def src_detect_kind(spark, sf):
    head = F.lit("")
    for rest, (bytes_hex, _) in _HEADS.items():
        head = F.when(F.col("page_id") % 7 == rest, bytes_hex).otherwise(head)
    content = F.concat(F.unhex(head), F.col("html").cast("binary"))
    pages = load(spark, sf, "pages").withColumn("content", content)
    members = F.array(F.lit("word/document.xml"))
    return pages.select(
        "page_id",
        A.detect_kind("content", "full", members).alias("full_kind"),
        A.detect_kind("content", "report").alias("report_kind"),
        A.detect_kind("content", "html").alias("strict_kind"),
    )


_BARE = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), "
    r"'(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g')"
)
_ENT = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query(
    "src_html_units",
    rf"""WITH pieces AS (SELECT page_id, unnest(string_split(regexp_replace({_BARE}, '(?i)<(/?(?:h1|p|li|div|ul|nav|article|footer|body|html)\b)', chr(1) || '<\1', 'g'), chr(1))) AS piece,
        generate_subscripts(string_split(regexp_replace({_BARE}, '(?i)<(/?(?:h1|p|li|div|ul|nav|article|footer|body|html)\b)', chr(1) || '<\1', 'g'), chr(1)), 1) AS pos FROM pages),
      units AS (SELECT page_id, pos, lower(regexp_extract(piece, '(?i)^<(h1|p|li)\b', 1)) AS tag,
        {Q.clean(_ENT.format(r"regexp_replace(regexp_replace(piece, '^<[^>]*>', ''), '<[^>]*>', ' ', 'g')"))} AS text FROM pieces)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS ord, CASE WHEN tag = 'h1' THEN 'heading' ELSE 'text' END AS kind, text
    FROM units WHERE tag <> '' AND text <> ''""",
)
def src_html_units(spark, sf):
    return html_units(load(spark, sf, "pages"), "page_id", "html").select("page_id", "ord", "kind", "text")


@query(
    "src_decode_text",
    r"""SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '[^\x{00}-\x{ff}]', '?', 'g') ELSE html END) AS digest FROM pages""",
)
def src_decode_text(spark, sf):
    """A third of the pages is stored as Latin-1 without a charset, the rest as UTF-8."""
    narrow = F.regexp_replace(F.regexp_replace("html", r"[^\x00-\xff]", "?"), r"charset=\"utf-8\"", "charset=\"latin-1\"")
    stored = F.when(F.col("page_id") % 3 == 0, F.encode(narrow, "ISO-8859-1")).otherwise(F.col("html").cast("binary"))
    decoded = A.decode_text(F.col("content"))
    back = F.regexp_replace(F.col("text"), r"charset=\"latin-1\"", "charset=\"utf-8\"")
    return (
        load(spark, sf, "pages").select("page_id", stored.alias("content"))
        .select("page_id", decoded.alias("text"))
        .select("page_id", F.md5(back.cast("binary")).alias("digest"))
    )


@query(
    "src_sheet_presence",
    """SELECT c_mktsegment AS segment, count(*) AS n_rows, count(*) FILTER (WHERE trim(c_name) <> '' AND c_custkey % 4 <> 0) AS n_present FROM customer GROUP BY c_mktsegment""",
)
def src_sheet_presence(spark, sf):
    from ..sources.sheets import sheet_rows

    raw = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("row_no"), F.col("c_mktsegment").alias("h1"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).otherwise(" ").alias("h2"), F.col("c_acctbal").alias("h3"),
    )
    rows = sheet_rows(raw, ["row_no"], {"h1": "Setor", "h2": "Nome Colaborador", "h3": "Observação"})
    return rows.groupBy(F.col("sector").alias("segment")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("person_present").alias("n_present")
    )


_CHUNK = 8192


def _parts(spark, sf, size):
    """The documents' texts in Base64, cut into numbered parts of ``size`` characters."""
    encoded = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    n = F.ceil(F.length("b64") / F.lit(size)).cast("int")
    return (
        load(spark, sf, "documents").select("doc_id", encoded.alias("b64"))
        .where("b64 <> ''")
        .select("doc_id", "b64", F.explode(F.sequence(F.lit(1), n)).alias("part_no"))
        .select("doc_id", "part_no", F.substring(F.col("b64"), (F.col("part_no") - 1) * size + 1, F.lit(size)).alias("chunk"))
    )


@query(
    "src_reassemble_chunks",
    f"""WITH b AS (SELECT doc_id, text, ceil(length(base64(encode(text))) / {_CHUNK}.0)::BIGINT AS n FROM documents)
    SELECT doc_id, n AS n_parts, 'ok' AS status, sha256(text) AS sha256 FROM b WHERE n > 0""",
)
def src_reassemble_chunks(spark, sf):
    whole = reassemble_chunks(_parts(spark, sf, _CHUNK), ["doc_id"], "part_no", "chunk", max_parts=None, max_part_chars=None, max_total_chars=None)
    return whole.select(
        "doc_id", "n_parts", "status", content_sha256("content").alias("sha256")
    )


#: parts that end anywhere in a group of four characters, and blocks in characters and in bytes
_ODD_CHUNK, _BLOCK, _BLOCK_BYTES = 4099, 4096, 3072


@query(
    "src_reassembled_blocks",
    f"""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text <> ''),
    k AS (SELECT doc_id, n, unnest(range(CAST(ceil(n / {_BLOCK_BYTES}.0) AS BIGINT))) AS block_no, h FROM b),
    d AS (SELECT doc_id, n, block_no, sha256(unhex(substr(h, block_no * {2 * _BLOCK_BYTES} + 1, {2 * _BLOCK_BYTES}))) AS d FROM k)
    SELECT doc_id, count(*) AS n_blocks, max(n) AS n_bytes, sha256(string_agg(d, '' ORDER BY block_no)) AS digest, 'ok' AS status FROM d GROUP BY doc_id""",
)
def src_reassembled_blocks(spark, sf):
    blocks = reassembled_blocks(_parts(spark, sf, _ODD_CHUNK), ["doc_id"], "part_no", "chunk", _BLOCK)
    return chained_digest(blocks, ["doc_id"])


@query(
    "src_contract_records",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN left(props, 3) WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN '{"v": 9, "k": 1}'
        WHEN event_id % 3 = 0 THEN '{"v": 2, "key": {"k": ' || regexp_extract(props, '[0-9]+') || '}}' ELSE '{"v": 1, ' || substr(props, 2) END AS body FROM events)
    SELECT event_id, CASE WHEN body IS NULL THEN 'missing' WHEN event_id % 11 = 0 THEN 'unreadable' WHEN event_id % 5 = 0 THEN 'version' ELSE 'ok' END AS status,
        CASE WHEN body IS NOT NULL AND event_id % 11 > 0 AND event_id % 5 > 0 THEN CAST(regexp_extract(body, '([0-9]+)[^0-9]*$', 1) AS BIGINT) END AS k FROM e""",
)
def src_contract_records(spark, sf):
    number = F.regexp_extract("props", "[0-9]+", 0)
    body = (
        F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 3))
        .when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(F.col("event_id") % 5 == 0, '{"v": 9, "k": 1}')
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v": 2, "key": {"k": '), number, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"v": 1, '), F.substr("props", F.lit(2))))
    )
    records = load(spark, sf, "events").select("event_id", body.alias("body"))
    good, broken = dispatch_contracts(records, "body", {1: "v int, k bigint", 2: "v int, key struct<k: bigint>"}, "v")
    k = F.coalesce("v1.k", "v2.key.k")
    return good.select("event_id", F.lit("ok").alias("status"), k.alias("k")).unionByName(
        broken.select("event_id", "status", F.lit(None).cast("bigint").alias("k"))
    )


@query(
    "src_data_uri",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN octet_length(encode(text)) END AS n_bytes, CASE WHEN doc_id % 4 < 3 THEN sha256(text) END AS sha256 FROM documents""",
)
def src_data_uri(spark, sf):
    b64 = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    uri = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("data:text/plain;base64,"), b64))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("DATA:text/plain,"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("data:;BASE64,"), b64))
        .otherwise(F.concat(F.lit("data:text/plain;base64,!"), b64))
    )
    data = A.decode_data_uri(uri)
    return load(spark, sf, "documents").select("doc_id", data.alias("data")).select(
        "doc_id", F.length("data").cast("bigint").alias("n_bytes"), content_sha256("data").alias("sha256")
    )


_ALIASES = ", ".join(
    f"('{a}', '{name}', {i})" for name, names in rules.UPLOAD_ALIASES.items() for i, a in enumerate(names)
)


@query(
    "src_resolve_roles",
    f"""{cte('uploads')}, a(alias, canonical, priority) AS (VALUES {_ALIASES}),
    r AS (SELECT job_id, canonical, field, filename, row_number() OVER (PARTITION BY job_id, canonical ORDER BY priority, filename) AS rn
      FROM uploads JOIN a ON a.alias = uploads.field WHERE filename <> '')
    SELECT job_id, canonical, filename, field AS alias FROM r WHERE rn = 1""",
)
def src_resolve_roles(spark, sf):
    return A.resolve_roles(derive(spark, sf, "uploads"), A.alias_table(spark), ["job_id"], "field", "filename")


@query(
    "fl_resolvable_ref",
    """SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS resolvable FROM pages""",
)
def fl_resolvable_ref(spark, sf):
    ref = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("img/"), "page_id", F.lit(".png")))
        .when(F.col("page_id") % 6 == 1, F.col("url"))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit("DATA:image/png;base64,"), "page_id"))
        .when(F.col("page_id") % 6 == 3, F.concat(F.lit("a/../../"), "page_id"))
        .when(F.col("page_id") % 6 == 4, F.concat(F.lit("\\a\\..\\b%20c\\"), "page_id"))
        .otherwise(F.concat(F.lit("file:///c:/"), "page_id"))
    )
    return load(spark, sf, "pages").select("page_id", "url", A.resolvable_ref(ref).alias("resolvable"))


@query(
    "fl_path_within",
    """SELECT page_id, page_id % 4 = 0 AS inside FROM pages""",
)
def fl_path_within(spark, sf):
    path = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("/srv/jobs/"), "page_id", F.lit("/a..b.txt")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("/srv/jobs/"), "page_id", F.lit("/../x")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("/srv/jobsx/"), "page_id"))
        .otherwise("/srv/jobs/")
    )
    return load(spark, sf, "pages").select("page_id", A.path_within(path, F.lit("/srv/jobs/")).alias("inside"))
