"""Files as tables: inventory, kind detection, charset fallback, data URIs, roles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import rules
from ..functions.hashing import content_sha256
from ..functions.text import norm_ext

# File signatures, hexadecimal.
ZIP_SIGNATURES = ["504B0304", "504B0506", "504B0708"]
OLE_SIGNATURE = "D0CF11E0A1B11AE1"
PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_SIGNATURE = "FFD8FF"
HTML_MARKERS = ["<!doctype html", "<html", "<head", "<body", "<table", "xmlns:w="]
HTML_PREFIXES = ["<!doctype html", "<html", "<head", "<body"]
HTML_SAMPLE_BYTES = 65536
MEDIA_TYPES = {
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html_doc": "text/html",
    "ole_doc": "application/msword",
    "png": "image/png",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
}
# Printable characters that code page 1252 puts on 0x80-0x9F, and the
# bytes it leaves undefined.
CP1252_BYTES = "".join(
    chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
)
CP1252_CHARS = "".join(bytes([ord(c)]).decode("cp1252") for c in CP1252_BYTES)
CP1252_UNDEFINED = "[\\x81\\x8d\\x8f\\x90\\x9d]"


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` with their content."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )


def _latin(c: Column) -> Column:
    return F.decode(c, "ISO-8859-1")


def detect_kind(content, variant: str = "full", members=None) -> Column:
    """Real kind of a file by its first bytes.

    ``full`` looks into the member names of a package when they are given,
    ``report`` takes every package for a document, ``html`` only tells whether
    the file opens like a web page.
    """
    data = F.col(content) if isinstance(content, str) else content
    if variant == "html":
        opening = F.lower(
            F.substring(F.regexp_replace(_latin(F.substring(data, 1, 4096)), r"^[\xef\xbb\xbf\x00\t\r\n ]+", ""), 1, 512)
        )
        test = F.lit(False)
        for prefix in HTML_PREFIXES:
            test = test | opening.startswith(prefix)
        return F.when(test, "html_doc").otherwise("unknown")
    head = F.hex(F.substring(data, 1, 12))
    sample = F.replace(F.lower(_latin(F.substring(data, 1, HTML_SAMPLE_BYTES))), F.lit("\0"), F.lit(""))
    html = F.lit(False)
    for marker in HTML_MARKERS:
        html = html | sample.contains(marker)
    zipped = F.substring(head, 1, 8).isin(ZIP_SIGNATURES)
    if variant == "report":
        package = F.lit("docx")
    elif members is None:
        package = F.lit("unknown")
    else:
        names = F.col(members) if isinstance(members, str) else members
        package = (
            F.when(F.array_contains(names, "xl/workbook.xml"), "xlsx")
            .when(F.array_contains(names, "word/document.xml"), "docx")
            .otherwise("unknown")
        )
    kind = F.when(zipped, package).when(head.startswith(OLE_SIGNATURE), "ole_doc")
    if variant == "full":
        kind = (
            kind.when(head.startswith(PNG_SIGNATURE), "png")
            .when(head.startswith(JPEG_SIGNATURE), "jpeg")
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        )
    return kind.when(html, "html_doc").otherwise("unknown")


def artifact_inventory(files: DataFrame, role: Column | str, members: str | None = None) -> DataFrame:
    """One metadata row per file of ``files(path, content)``; the content is not kept."""
    role_col = F.lit(role) if isinstance(role, str) else role
    ext = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"[^.](\.[^.]+)\z", 1))
    kind = detect_kind("content", "full", members)
    media_type = F.lit(None).cast("string")
    for name, value in MEDIA_TYPES.items():
        media_type = F.when(F.col("kind") == name, value).otherwise(media_type)
    keep = [c for c in files.columns if c not in {"content", "path", "length", "modificationTime"}]
    return (
        files.withColumn("role", role_col)
        .withColumn("kind", kind)
        .withColumn("sha256", content_sha256("content"))
        .withColumn("size_bytes", F.length("content").cast("bigint"))
        .withColumn("has_script", F.lower(_latin(F.col("content"))).contains("<script"))
        .select(
            *[c for c in keep if c != "role"],
            "role",
            F.concat(F.col("role"), F.lit("-"), F.substring("sha256", 1, 12)).alias("artifact_id"),
            "kind",
            F.when(ext == "", ".bin").otherwise(norm_ext(ext)).alias("extension"),
            media_type.alias("media_type"),
            "size_bytes",
            "sha256",
            F.col("has_script") & (F.col("kind") == "html_doc"),
        )
        .toDF(
            *[c for c in keep if c != "role"],
            "role", "artifact_id", "kind", "extension", "media_type", "size_bytes", "sha256", "active_content",
        )
    )


@F.pandas_udf(StringType())
def _decode_declared(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, charset in parts:
        texts = []
        for raw, name in zip(data, charset):
            text = None
            if raw is not None:
                try:
                    text = bytes(raw).decode(name)
                except (LookupError, UnicodeDecodeError):
                    text = None
            texts.append(text)
        yield pd.Series(texts, dtype="object")


def decode_text(content) -> Column:
    """Text of a web page: declared charset, UTF-8, code page 1252, Latin-1, in this order.

    Only rows that declare a charset outside UTF-8, Latin-1, ASCII and 1252 reach Python.
    """
    data = F.col(content) if isinstance(content, str) else content
    probe = F.regexp_replace(_latin(F.substring(data, 1, 4096)), r"[^\x00-\x7f]", "")
    charset = F.lower(F.regexp_extract(probe, r"(?i)charset\s*=\s*[\"']?\s*([a-z0-9._-]+)", 1))
    latin = _latin(data)
    utf8 = data.cast("string")
    valid = F.is_valid_utf8(utf8)
    cp1252 = F.when(~latin.rlike(CP1252_UNDEFINED), F.translate(latin, CP1252_BYTES, CP1252_CHARS))
    known = charset.isin(
        "", "utf-8", "utf8", "iso-8859-1", "latin-1", "latin1", "windows-1252", "cp1252", "ascii", "us-ascii"
    )
    declared = _decode_declared(F.when(~known, data), F.when(~known, charset))
    return F.coalesce(
        F.when(charset.isin("utf-8", "utf8") & valid, utf8)
        .when(charset.isin("iso-8859-1", "latin-1", "latin1"), latin)
        .when(charset.isin("windows-1252", "cp1252"), cp1252)
        .when(charset.isin("ascii", "us-ascii") & latin.rlike(r"^[\x00-\x7f]*\z"), utf8)
        .when(~known, declared),
        F.when(valid, F.regexp_replace(utf8, "^\\ufeff", "")),
        cp1252,
        latin,
    )


def decode_data_uri(c) -> Column:
    """Bytes of a ``data:`` reference, NULL when it is not one or is malformed."""
    text = F.col(c) if isinstance(c, str) else c
    at = F.locate(",", text)
    header = F.lower(F.substring(text, F.lit(1), at - 1))
    body = F.substring(text, at + 1, F.length(text))
    strict = body.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(body) % 4 == 0)
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    return F.when(
        (at > 0) & F.lower(text).startswith("data:"),
        F.when(header.contains(";base64"), F.when(strict, F.try_to_binary(body, F.lit("base64")))).otherwise(plain),
    )


def resolvable_ref(c) -> Column:
    """A ``data:`` reference, or a relative path that stays below its folder."""
    text = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    scheme = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    path = F.regexp_replace(F.replace(F.regexp_extract(text, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")), "^/+", "")
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    # depth never negative: fold the parts, counting down on '..'
    depth = F.aggregate(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
            F.least(
                acc["low"],
                acc["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1),
            ).alias("low"),
        ),
    )
    relative = (scheme == "") & (path != "") & (depth["low"] >= 0) & (depth["d"] > 0)
    return F.lower(text).startswith("data:") | relative


def path_within(path, root) -> Column:
    """The stored path lies strictly below the root and has no parent step."""
    p = F.col(path) if isinstance(path, str) else path
    r = F.regexp_replace(F.col(root) if isinstance(root, str) else root, "/+$", "")
    return p.startswith(F.concat(r, F.lit("/"))) & (F.length(p) > F.length(r) + 1) & ~p.rlike(r"(^|/)\.\.(/|$)")


def alias_table(spark: SparkSession, aliases: dict[str, list[str]] = rules.UPLOAD_ALIASES) -> DataFrame:
    """``alias, canonical, priority``: a fixed table of a few dozen rows."""
    data = [(a, name, i) for name, names in aliases.items() for i, a in enumerate(names)]
    return spark.createDataFrame(data, "alias string, canonical string, priority int")


def resolve_roles(files: DataFrame, aliases: DataFrame, keys: list[str], field: str, value: str) -> DataFrame:
    """The first non-empty alias of each role, in declared order, per ``keys``."""
    known = files.where(F.col(value).isNotNull() & (F.col(value) != "")).join(
        aliases.withColumnRenamed("alias", field), field
    )
    return known.groupBy(*keys, "canonical").agg(
        F.min_by(F.col(value), F.struct("priority", value)).alias(value),
        F.min_by(F.col(field), F.struct("priority", value)).alias("alias"),
    )
