"""Unicode folding tables for comparison keys.

A key keeps only ``a-z``, ``0-9`` and single spaces. What one code point
contributes to a key does not depend on its neighbours (case folding, NFKD and
the removal of combining marks all act per code point), so the whole rule is a
table. It is generated from the ``unicodedata`` module, once per interpreter:

* code points that contribute exactly one character, or nothing, go into the
  two arguments of one ``translate`` call;
* the few that contribute several characters (ligatures, ``ß``, fractions …)
  go into a map that is consulted only for rows that contain one of them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

_KEEP = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def fold_code_point(ch: str) -> str:
    """The text one code point contributes to a key, spaces standing for separators."""
    decomposed = unicodedata.normalize("NFKD", ch.casefold())
    kept = (c for c in decomposed if not unicodedata.combining(c))
    return "".join(c if c in _KEEP else " " for c in kept)


@lru_cache(maxsize=1)
def folding_tables() -> tuple[str, str, dict[str, str]]:
    """``(from, to, multi)``: the translate pair and the multi-character map."""
    single: list[tuple[str, str]] = []
    dropped: list[str] = []
    multi: dict[str, str] = {}
    for number in range(sys.maxunicode + 1):
        if 0xD800 <= number <= 0xDFFF:
            continue
        ch = chr(number)
        folded = "" if ch == "\0" else fold_code_point(ch)
        if folded == "":
            dropped.append(ch)
        elif len(folded) > 1 and folded.strip():
            multi[ch] = folded
        elif folded.strip() and folded != ch:
            single.append((ch, folded))
    source = "".join(a for a, _ in single) + "".join(dropped)
    target = "".join(b for _, b in single)
    return source, target, multi


@lru_cache(maxsize=1)
def digit_tables() -> tuple[str, str]:
    """Every decimal digit outside ASCII and its ASCII form."""
    pairs = [
        (chr(n), str(unicodedata.decimal(chr(n))))
        for n in range(128, sys.maxunicode + 1)
        if unicodedata.category(chr(n)) == "Nd"
    ]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
