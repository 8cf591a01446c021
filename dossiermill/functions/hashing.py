"""Hashes and canonical JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_sha256(c) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def json_text(c: Column) -> Column:
    """A JSON string literal with ASCII output, for texts of the basic plane and beyond.

    ``to_json`` keeps non-ASCII characters, canonical JSON escapes them. UTF-16 code
    units are read from the hex form, so that surrogate pairs come out as two escapes.
    """
    quoted = F.to_json(F.array(c))
    body = F.substring(quoted, 2, F.length(quoted) - 2)
    escaped = F.array_join(
        F.transform(
            F.split(body, ""),
            lambda ch: F.when(ch.rlike(r"^[\x00-\x7f]*$"), ch).otherwise(
                F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1")
            ),
        ),
        "",
    )
    return F.when(body.rlike(r"[^\x00-\x7f]"), escaped).otherwise(body)


def json_array(texts: Column) -> Column:
    """Compact JSON array of texts."""
    return F.concat(F.lit("["), F.array_join(F.transform(texts, json_text), ","), F.lit("]"))
