"""Pieces of DuckDB SQL for the checks, written from the definitions of the operators."""

from __future__ import annotations

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CODE = r"(?i)\bGHE\s*(?:N[º°o.]?\s*)?[-_:./]?\s*0*(\d{1,4})\b"
_CODE_NAME = _CODE + r"(?:\s*[-–—:|]\s*([^\r\n]+))?"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def key(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(replace(replace(lower(replace(coalesce({x}, ''), 'ß', 'ss')), 'º', 'o'), 'ª', 'a')), '[^a-z0-9]+', ' ', 'g'))"


def fmt(n: str) -> str:
    return f"'GHE ' || CASE WHEN length(ltrim({n}, '0')) >= 2 THEN ltrim({n}, '0') ELSE lpad(ltrim({n}, '0'), 2, '0') END"


def code(x: str) -> str:
    n = f"regexp_extract({clean(x)}, '{_CODE}', 1)"
    return f"CASE WHEN {n} <> '' THEN {fmt(n)} END"


def ref_name(x: str) -> str:
    n = f"regexp_extract({clean(x)}, '{_CODE_NAME}', 2)"
    cut = rf"trim(regexp_replace({n}, '\s+[|]\s+.*$', ''), ' -–—:;')"
    return f"nullif({cut}, '')"


def group_name_of(k: str) -> str:
    bare = rf"regexp_replace({k}, '^ghe\s+\d+\s*', '')"
    return f"trim(regexp_replace({bare}, '^(analise do |analise |resultados do |resultados |grupo )', ''))"


def group_name(x: str) -> str:
    return group_name_of(key(x))


def tokens(k: str) -> str:
    return f"list_distinct(list_filter(string_split({k}, ' '), lambda t: t <> ''))"


def jaccard(a: str, b: str) -> str:
    ta, tb = tokens(a), tokens(b)
    return (
        f"(len(list_intersect({ta}, {tb}))::DOUBLE / greatest(len(list_distinct(list_concat({ta}, {tb}))), 1))"
    )


def similarity(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
        f"ELSE round({jaccard(a, b)}, 4) END"
    )


def edit_similarity(a: str, b: str) -> str:
    from .. import rules

    edit = f"{rules.SEQUENCE_WEIGHT}::DOUBLE * (1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b}), 1))"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE "
        f"ELSE round(greatest({jaccard(a, b)}, {edit}), 4) END"
    )


def category(x: str) -> str:
    from .. import rules

    k = key(x)
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({k}, '{p}')" for p in phrases) + f" THEN '{name}'"
        for name, phrases in rules.HEADING_CATEGORIES
    )
    return f"CASE {arms} ELSE 'other' END"


def contains_any(k: str, words) -> str:
    return "(" + " OR ".join(f"contains({k}, '{w}')" for w in words) + ")"


def starts_any(k: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({k}, '{w}')" for w in words) + ")"


def heading(x: str, style: str | None = None) -> str:
    c = clean(x)
    styled = starts_any(key(style), ["heading", "titulo", "title", "cabecalho"]) if style else "false"
    return (
        f"({c} <> '' AND ({styled} OR (length({c}) <= 160 AND ({code(x)} IS NOT NULL OR {category(x)} <> 'other')) "
        f"OR (length({c}) <= 100 AND right({c}, 1) NOT IN ('.', ';', ',') AND "
        f"((upper({c}) = {c} AND lower({c}) <> upper({c})) OR ends_with({c}, ':')))))"
    )


def section_heading(x: str, style: str | None = None) -> str:
    listed = f"NOT {starts_any(key(style), ['list', 'lista'])}" if style else "true"
    return f"((regexp_matches({x}, '^\\d+\\.\\s+\\S') AND length({x}) <= 140) OR ({heading(x, style)} AND {listed}))"


def group_heading(x: str) -> str:
    opening = starts_any(key(x), ["ghe ", "grupo ghe ", "analise ghe ", "resultados ghe ", "ghe n "])
    return f"({code(x)} IS NOT NULL AND length({x}) <= 180 AND {opening})"


def contextual(x: str) -> str:
    words = ["painel", "grafico", "radar", "matriz", "dominio", "favorabilidade", "resumo", "risco"]
    return f"({code(x)} IS NOT NULL OR {contains_any(key(x), words)})"
