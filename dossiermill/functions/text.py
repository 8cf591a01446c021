"""Text, code and identifier scalars.

Every function takes and returns a ``Column`` built from JVM expressions, so a
scan, these projections and a partial aggregate stay in one stage.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .folding import digit_tables, folding_tables

# The whitespace that text cleaning collapses (Java syntax).
WHITESPACE = (
    r"[[^\x21-\x7e]&&[\t\n\x0B\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]+"
)
# How a text refers to a group; group 1 is the number, group 2 the name.
_CODE = r"\b%s\s*(?:N[º°o.]?\s*)?[-_:./]?\s*0*(\d{1,4})\b"
_CODE_AND_NAME = _CODE + r"(?:\s*[-–—:|]\s*([^\r\n]+))?"
_LOOSE_CODE = r"\b%s\s*[-_:.]?\s*0*(\d+)\b"
_PERCENT = r"(?U)(?<!\d)(\d{1,3}(?:[.,]\d{1,2})?)\s*%"
_HEADCOUNT = r"(?U)(?<![\d.,])(-?\d+(?:[.,]\d+)?)"
_NUMBERED = r"(?U)^\d+\.\s+\S"
_NAME_EDGE = " -–—:;"
# a character that cleaning leaves
SHOWN = r"[^\x00\t\n\x0B\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time, however often it is read."""
    return F.transform(F.array(value), use)[0]


def any_of(key: Column, words: Iterable[str]) -> Column:
    """True when ``key`` contains one of ``words``.

    One pattern rather than a chain of tests: filters do not share subexpressions,
    so a chain would make the key anew for every word.
    """
    return key.rlike("|".join(re.escape(w) for w in words))


def holds_any(key: Column, words: Iterable[str]) -> Column:
    """``any_of`` for a key that is at hand: plain searches, cheaper than one pattern."""
    shortest: list[str] = []
    for word in sorted(words, key=len):
        if not any(s in word for s in shortest):
            shortest.append(word)
    found = key.contains(shortest[0])
    for word in shortest[1:]:
        found = found | key.contains(word)
    return found


def starts_any(key: Column, prefixes: Iterable[str]) -> Column:
    """True when ``key`` starts with one of ``prefixes``."""
    return key.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def clean_text(c) -> Column:
    """Collapse every whitespace run to one space; NULL becomes the empty text."""
    text = F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("\0"), F.lit(""))
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def shows_text(c) -> Column:
    """True when ``clean_text`` leaves something."""
    return F.coalesce(_col(c).cast("string").rlike(SHOWN), F.lit(False))


def _ranges(chars: Iterable[str]) -> list[str]:
    """Character-class ranges of a set of code points."""
    spans: list[list[int]] = []
    for number in sorted(ord(ch) for ch in chars):
        if spans and spans[-1][1] == number - 1:
            spans[-1][1] = number
        else:
            spans.append([number, number])
    return [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans]


def _fold_multi(c: Column, multi: dict[str, str]) -> Column:
    """Expand the code points that fold to several characters, where there are any."""
    # the outer range lets ASCII text fail at the first comparison
    char_class = r"[[^\x00-\xbb]&&[" + "".join(_ranges(multi)) + "]]"
    packed = "\x02".join(f"{ch}\x01{text}" for ch, text in multi.items())
    table = F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))
    expanded = F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    return F.when(c.rlike(char_class), expanded).otherwise(c)


def fold_marks(text: Column) -> Column:
    """Case and accents folded away, code point by code point; what separates words stays."""
    source, target, multi = folding_tables()
    rest = {ch: text for ch, text in multi.items() if ch != "ß"}
    return F.translate(_fold_multi(F.replace(text, F.lit("ß"), F.lit("ss")), rest), source, target)


def normalize_key(c) -> Column:
    """Accent-, case- and punctuation-insensitive comparison key."""
    text = F.replace(F.coalesce(_col(c).cast("string"), F.lit("")), F.lit("\0"), F.lit(""))
    # as many bytes as characters: plain ASCII, where lower case is all there is to fold
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold_marks(text))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def _digits(c: Column) -> Column:
    return F.translate(c, *digit_tables())


def format_code(number: Column, prefix: str = rules.CODE_PREFIX) -> Column:
    """``PREFIX NN`` from a text of ASCII digits, two digits at least."""
    bare = F.regexp_replace(number, "^0+(?=\\d)", "")
    return once(bare, lambda n: F.concat(F.lit(prefix + " "), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def _code_of_clean(text: Column, prefix: str) -> Column:
    number = F.regexp_extract(text, "(?iU)" + _CODE % prefix, 1)
    return once(number, lambda n: F.when(n != "", format_code(_digits(n), prefix)))


def canonical_code(c, prefix: str = rules.CODE_PREFIX) -> Column:
    """The first code reference as ``PREFIX NN``, or NULL."""
    return _code_of_clean(clean_text(c), prefix)


def canonical_code_or_raw(c, prefix: str = rules.CODE_PREFIX) -> Column:
    """The registry's own looser rule: any digits, else the trimmed upper-case text."""
    text = _col(c)
    number = F.regexp_extract(text, "(?iU)" + _LOOSE_CODE % prefix, 1)
    return F.when(number != "", format_code(_digits(number), prefix)).otherwise(F.upper(F.trim(text)))


def parse_reference(c, prefix: str = rules.CODE_PREFIX) -> Column:
    """``struct(code, name)``: a code and the name written next to it."""
    pattern = "(?iU)" + _CODE_AND_NAME % prefix

    def reference(text: Column) -> Column:
        raw = F.trim(F.regexp_extract(text, pattern, 2))
        name = F.btrim(F.element_at(F.split(raw, r"\s+[|]\s+"), 1), F.lit(_NAME_EDGE))
        number = F.regexp_extract(text, pattern, 1)
        return once(
            number,
            lambda n: F.struct(
                F.when(n != "", format_code(_digits(n), prefix)).alias("code"),
                F.when(n != "", F.nullif(name, F.lit(""))).alias("name"),
            ),
        )

    full = once(clean_text(c), reference)
    if not (prefix.isascii() and prefix.isalpha()):
        return full
    # a plain code with plain words behind a dash, or none, is read as it stands
    raw = _col(c).cast("string")
    plain = rf"^{prefix} ([1-9][0-9]{{0,3}})(?: - ([A-Za-z0-9]+(?: [A-Za-z0-9]+)*))?\z"
    name = F.nullif(F.regexp_extract(raw, plain, 2), F.lit(""))
    return F.when(
        raw.rlike(plain), F.struct(_plain_code(F.regexp_extract(raw, plain, 1), prefix).alias("code"), name.alias("name"))
    ).otherwise(full)


def _plain_code(number: Column, prefix: str) -> Column:
    """``format_code`` of digits that do not begin with 0, or of 0 itself."""
    return F.concat(F.when(F.length(number) < 2, f"{prefix} 0").otherwise(f"{prefix} "), number)


def group_name_of_key(key: Column) -> Column:
    """Name key from a comparison key: drop a leading code, then one known prefix."""
    bare = F.regexp_replace(key, r"^ghe\s+\d+\s*", "")
    cut = F.lit(0)
    for prefix in reversed(rules.NAME_PREFIXES):
        cut = F.when(bare.startswith(prefix), len(prefix)).otherwise(cut)
    return F.trim(F.substring(bare, cut + 1, F.length(bare)))


def normalize_group_name(c) -> Column:
    """Name key of a group reference."""
    return group_name_of_key(normalize_key(c))


def parse_population(c) -> Column:
    """Head-count written in a cell, NULL when it is absent, negative or fractional."""
    raw = _col(c).cast("string")

    def written(text: Column) -> Column:
        number = _digits(F.replace(F.regexp_extract(text, _HEADCOUNT, 1), F.lit(","), F.lit(".")))
        blank = normalize_key(text).isin(rules.POPULATION_BLANKS)
        return once(
            number.try_cast("decimal(38,10)"),
            lambda value: F.when((value >= 0) & (value == F.floor(value)) & ~blank, value.cast("bigint")),
        )

    # plain digits are the number itself, and ASCII text without a digit has none
    return (
        F.when(raw.rlike(r"^[0-9]{1,18}\z"), raw.try_cast("bigint"))
        .when(raw.rlike(r"[0-9]|[^\x00-\x7f]"), once(clean_text(raw), written))
    )


def population_of_number(c) -> Column:
    """Head-count of a numeric cell: finite, integral and not negative."""
    value = _col(c).cast("double")
    whole = ~F.isnan(value) & (value >= 0) & (value < 9.2e18) & (value == F.floor(value))
    return F.when(whole, value.cast("bigint"))


def extract_percentage(c) -> Column:
    """First percentage as written, in the form ``<value>%``."""
    value = F.regexp_extract(clean_text(c), _PERCENT, 1)
    return F.when(value != "", F.concat(value, F.lit("%")))


def category_of_key(key: Column) -> Column:
    result = F.lit(rules.OTHER_CATEGORY)
    for category, phrases in reversed(rules.HEADING_CATEGORIES):
        result = F.when(any_of(key, phrases), category).otherwise(result)
    return result


def classify_heading(c) -> Column:
    """Category of a heading; the first rule that matches wins."""
    return category_of_key(normalize_key(c))


def looks_like_heading(text, style=None) -> Column:
    """Structural heading test by style, code, category or typography."""
    body = clean_text(text)
    style_key = normalize_key(style) if style is not None else F.lit("")
    upper = (F.upper(body) == body) & (F.lower(body) != F.upper(body))
    short = (
        (F.length(body) <= 100)
        & ~F.right(body, F.lit(1)).isin(".", ";", ",")
        & (upper | body.endswith(":"))
    )
    medium = (F.length(body) <= 160) & (
        _code_of_clean(body, rules.CODE_PREFIX).isNotNull()
        | any_of(normalize_key(body), [p for _, phrases in rules.HEADING_CATEGORIES for p in phrases])
    )
    return (body != "") & (starts_any(style_key, rules.HEADING_STYLES) | medium | short)


def is_group_heading(text, structural=False) -> Column:
    """A code, at most 180 characters, and structure or a known opening."""
    body = _col(text)
    opening = starts_any(normalize_key(body), rules.GROUP_HEADING_PREFIXES)
    if structural is False:
        shaped = opening
    elif structural is True:
        shaped = F.lit(True)
    else:
        shaped = _col(structural) | opening
    return canonical_code(body).isNotNull() & (F.length(body) <= 180) & shaped


def is_numbered_heading(c) -> Column:
    """``1. Title`` within 140 characters."""
    body = _col(c)
    return body.rlike(_NUMBERED) & (F.length(body) <= 140)


def is_section_heading(text, style=None) -> Column:
    """Numbered, or structural unless the style is a list style."""
    style_key = normalize_key(style) if style is not None else F.lit("")
    return is_numbered_heading(text) | (
        looks_like_heading(text, style) & ~starts_any(style_key, rules.LIST_STYLES)
    )


def column_kind(header) -> Column:
    """Kind of a spreadsheet column by its header, NULL when unknown."""
    return once(normalize_key(header), column_kind_of_key)


def column_kind_of_key(key: Column) -> Column:
    any_of = holds_any
    has_code = key.contains("ghe")
    return (
        F.when(key == "", None)
        .when(any_of(key, rules.PERSON_HEADERS), "person")
        .when(key.isin(rules.COMBINED_HEADERS) | (has_code & any_of(key, rules.COMBINED_WORDS)), "combined")
        .when(has_code & any_of(key, rules.CODE_WORDS), "code")
        .when(has_code & any_of(key, rules.NAME_WORDS), "name")
        .when(any_of(key, rules.SECTOR_WORDS), "sector")
        .when(any_of(key, rules.ROLE_WORDS), "role")
        .when(key.isin(rules.POPULATION_HEADERS) | any_of(key, rules.POPULATION_PHRASES), "population")
    )


def coerce_code(c, prefix: str = rules.CODE_PREFIX) -> Column:
    """Code of a separate code cell: canonical, all digits, or an integral number."""
    raw = _col(c).cast("string")

    def coerced(text: Column) -> Column:
        integral = F.regexp_extract(text, r"^(\d+)\.0+$", 1)
        return F.coalesce(
            _code_of_clean(text, prefix),
            F.when(text.rlike(r"(?U)^\d+$"), format_code(_digits(text), prefix)),
            F.when(integral != "", format_code(integral, prefix)),
        )

    full = once(clean_text(raw), coerced)
    if not (prefix.isascii() and prefix.isalpha()):
        return full
    # plain digits hold no prefix and are no other form; a plain reference needs no search
    return (
        F.when(raw.rlike(r"^(?:0|[1-9][0-9]*)\z"), _plain_code(raw, prefix))
        .when(raw.rlike(rf"^{prefix} [1-9][0-9]{{0,3}}\z"), _plain_code(F.substring(raw, len(prefix) + 2, 4), prefix))
        .when(raw.rlike(r"^[0-9]+\z"), format_code(raw, prefix))
        .otherwise(full)
    )


def split_values(c) -> Column:
    """Values of a multi-value cell."""
    def values(text: Column) -> Column:
        # a split makes its pattern anew for every row, and most cells have one value
        parts = F.when(text.rlike("[;|]"), F.split(text, "[;|]+")).otherwise(F.array(text))
        return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")

    return once(clean_text(c), values)


def after_separator(c) -> Column:
    """Text behind the first colon, else en dash, else em dash; empty tails do not count."""
    text = _col(c)
    tails = []
    for mark in (":", "–", "—"):
        at = F.locate(mark, text)
        tail = clean_text(F.substring(text, at + 1, F.length(text)))
        tails.append(F.when((at > 0) & (tail != ""), tail))
    return F.coalesce(*tails)


def is_contextual(c) -> Column:
    """A text that can tell what a nearby media shows."""
    return canonical_code(c).isNotNull() | any_of(normalize_key(c), rules.CONTEXT_TOKENS)


def media_role(context, code) -> Column:
    """Role of a media by its context text."""
    key = normalize_key(context)
    return (
        F.when(key.contains("matriz") & key.contains("risco"), "risk_matrix")
        .when(key.contains("radar"), "radar")
        .when(key.contains("dominio") & any_of(key, ["resumo", "sintese", "painel"]), "domain_summary")
        .when(any_of(key, ["favorabilidade", "favoravel"]), "favorability")
        .when(any_of(key, ["painel geral", "visao geral"]), "general_panel")
        .when(_col(code).isNotNull() & (_col(code) != "") & key.contains("painel"), "ghe_panel")
        .when(any_of(key, ["grafico", "chart"]), "chart")
        .otherwise("other")
    )


def action_header_kind(c) -> Column:
    """Kind of an action-table column by its header, NULL when unknown."""
    return action_kind_of_key(normalize_key(c))


def action_kind_of_key(key: Column) -> Column:
    return (
        F.when(any_of(key, ["evolucao", "registro"]), "evolution")
        .when(key.contains("responsavel"), "responsible")
        .when(key.contains("prazo") | (key == "data"), "deadline")
        .when(key.contains("indicador"), "indicator")
        .when(key.contains("prioridade"), "priority")
        .when((key == "ghe") | any_of(key, ["ghe ", "grupo"]), "group")
        .when(any_of(key, ["acao", "medida", "atividade"]), "action")
    )


def priority_kind_of_key(key: Column) -> Column:
    """Kind of a priority-table column by the key of its header, NULL when unknown."""
    return (
        F.when(key == "ordem", "order")
        .when(key == "ghe", "group")
        .when(any_of(key, ["classificacao", "prioridade"]), "level")
        .when(any_of(key, ["justificativa", "fundamentacao", "descricao"]), "reason")
    )


def label_kind(c) -> Column:
    """Question, answer, observation or guidance, by the opening of the line."""
    key = normalize_key(c)
    result = F.lit(None).cast("string")
    for kind, prefixes in reversed(rules.LABEL_PREFIXES):
        result = F.when(starts_any(key, prefixes), kind).otherwise(result)
    return result


def cells_key(cells) -> Column:
    """Comparison key of a whole row of cells."""
    return normalize_key(F.array_join(_col(cells), " "))


def question_row(cells) -> Column:
    """``struct(question, answer, note)`` of a question-table row, NULL when it is none."""
    values = _col(cells)
    first, second, third = (clean_text(F.try_element_at(values, F.lit(i))) for i in (1, 2, 3))
    answer_pattern = r"(?i)(?:[✅☑✓❌✗]\s*)?(Sim|Não|Nao)\s*$"
    answer = F.regexp_extract(second, answer_pattern, 1)
    numbered = (F.size(values) == 2) & first.rlike(r"(?U)^\d+$") & (answer != "")
    plain = (F.size(values) >= 2) & (
        first.rlike(r"(?U)^\d+(?:[.) -]|$)") | normalize_key(second).isin(rules.QUESTION_ANSWERS)
    )
    # a skipped opening needs letters, so the key is only made for rows that could count
    skipped = starts_any(cells_key(values), rules.QUESTION_SKIP_PREFIXES)
    possible = numbered | plain
    return (
        F.when(~possible, None)
        .when(skipped, None)
        .when(
            numbered,
            F.struct(
                F.concat(first, F.lit(". "), F.trim(F.regexp_replace(second, answer_pattern, ""))).alias("question"),
                F.replace(answer, F.lit("Nao"), F.lit("Não")).alias("answer"),
                F.lit("").alias("note"),
            ),
        )
        .when(plain, F.struct(first.alias("question"), second.alias("answer"), third.alias("note")))
    )


def is_counter_row(cells) -> Column:
    """First row of a counter table: ``3 Sim`` and, in another cell, ``2 Não``."""
    values = F.transform(_col(cells), clean_text)
    head = F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))
    rest = F.slice(values, 2, F.greatest(F.size(values), F.lit(1)))
    return head.rlike(r"(?iU)^\d+\s*Sim\b") & F.exists(rest, lambda x: x.rlike(r"(?iU)^\d+\s*N[aã]o\b"))


_LEAF = r"[^/\\]*\z"


def safe_name(c, variant: str = "upload", fallback: str = "file") -> Column:
    """File name made safe. Variants: ``upload``, ``display`` and ``web``."""
    raw = F.coalesce(_col(c), F.lit(""))
    if variant == "upload":
        leaf = F.regexp_extract(F.regexp_replace(raw, r"[/\\]+\z", ""), _LEAF, 0)
        name = F.substring(F.btrim(F.regexp_replace(leaf, "[^A-Za-z0-9._-]+", "_"), F.lit("._")), 1, 120)
        return F.when(name == "", "upload").otherwise(name)
    if variant == "display":
        source = F.when(raw == "", "arquivo").otherwise(raw)
        leaf = F.regexp_extract(F.regexp_replace(source, r"/+\z", ""), r"[^/]*\z", 0)
        name = F.substring(F.regexp_replace(leaf, "[^A-Za-z0-9._ -]+", "_"), 1, 120)
        return F.when(name == "", "arquivo").otherwise(name)
    source = F.when(raw == "", fallback).otherwise(raw)
    leaf = ascii_only(F.regexp_extract(source, _LEAF, 0))
    name = F.btrim(F.regexp_replace(leaf, "[^a-zA-Z0-9._-]+", "-"), F.lit("._-"))
    return F.when(name == "", fallback).otherwise(F.right(name, F.lit(120)))


def ascii_only(c) -> Column:
    """ASCII rest of a text after its accents are dropped, case kept."""
    import sys
    import unicodedata

    pairs, gone = [], []
    for n in range(128, 0x250):
        rest = unicodedata.normalize("NFKD", chr(n)).encode("ascii", "ignore").decode()
        (pairs if len(rest) == 1 else gone).append((chr(n), rest))
    source = "".join(a for a, _ in pairs)
    text = F.translate(_col(c), source, "".join(b for _, b in pairs))
    return F.regexp_replace(text, r"[^\x00-\x7f]", "")


def norm_ext(c) -> Column:
    """Lower-case extension with its leading dot."""
    ext = F.lower(F.trim(_col(c)))
    return F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for word, value in table.items():
        result = F.when(key == word, value).otherwise(result)
    return result


def norm_mode(c) -> Column:
    """Analysis mode with its aliases; empty means integrated, unknown means NULL."""
    text = F.coalesce(_col(c), F.lit(""))
    key = F.lower(F.trim(F.when(text == "", "integrated").otherwise(text)))
    return _lookup(key, rules.MODE_ALIASES)


def norm_flag(c) -> Column:
    """Checkbox value."""
    return F.lower(F.trim(F.coalesce(_col(c), F.lit("")))).isin(rules.TRUE_WORDS)


def is_iso_date(c) -> Column:
    """A real calendar date written ``YYYY-MM-DD``."""
    text = F.coalesce(_col(c), F.lit(""))
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def is_competence(c) -> Column:
    """A month written ``YYYY-MM``."""
    return F.trim(F.coalesce(_col(c), F.lit(""))).rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def dig(json_col, *paths: str) -> Column:
    """First path that holds a non-empty value."""
    found = [F.nullif(F.get_json_object(_col(json_col), path), F.lit("")) for path in paths]
    return F.coalesce(*found)


def display_title(c) -> Column:
    """Block title without its repeated sector prefix."""
    return F.regexp_replace(_col(c), r"(?iU)^(?:setor\s*/\s*ghe\s*:?\s*)+", "")


def group_label(code, name) -> Column:
    return F.concat(_col(code), F.lit(" - "), _col(name))


def count_label(n, singular: str, plural: str) -> Column:
    """``1 item`` or ``n items``."""
    value = _col(n)
    return F.concat(value.cast("string"), F.lit(" "), F.when(value == 1, singular).otherwise(plural))


def marker_pattern(prefix: str) -> str:
    return r"\{\{" + prefix + r"_[A-Z0-9_]+\}\}"


def fill_markers(c, values: dict[str, Column | str]) -> Column:
    """Replace each marker by its value, in the order given."""
    text = _col(c)
    for marker, value in values.items():
        text = F.replace(text, F.lit(marker), value if isinstance(value, Column) else F.lit(value))
    return text


def geometry_flags(width, height) -> Column:
    """``struct(ratio, panel, chart, matrix, dashboard)`` of a picture's size."""
    w, h = _col(width).cast("double"), _col(height).cast("double")
    known = (w > 0) & (h > 0)
    ratio = F.when(known, w / F.nullif(h, F.lit(0.0)))

    def test(condition):
        return F.coalesce(known & condition, F.lit(False))

    return F.struct(
        ratio.alias("ratio"),
        test(ratio >= 2.2).alias("panel"),
        test(ratio.between(1.6, 3.0)).alias("chart"),
        test(ratio >= 3.0).alias("matrix"),
        test(ratio.between(2.5, 3.5) & h.between(350, 700)).alias("dashboard"),
    )


def stable_unique(values, key=normalize_key) -> Column:
    """First spelling per key in the order of an array (for arrays inside one row)."""
    cleaned = F.filter(F.transform(_col(values), clean_text), lambda x: x != "")
    keyed = F.transform(cleaned, lambda x: F.struct(key(x).alias("key"), x.alias("text")))
    keys = F.array_distinct(F.transform(keyed, lambda s: s["key"]))
    # array_position finds the first holder of each key; keys are already in first-seen order
    all_keys = F.transform(keyed, lambda s: s["key"])
    return F.transform(keys, lambda k: F.element_at(cleaned, F.array_position(all_keys, k).cast("int")))


def casefold_key(c) -> Column:
    """Case-insensitive key that keeps accents and punctuation."""
    return F.replace(F.lower(clean_text(c)), F.lit("ß"), F.lit("ss"))
