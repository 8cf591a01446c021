"""The official registry of groups, from spreadsheet rows.

Input rows: ``job_id, sheet, sheet_ord, row_no, cells`` with ``cells`` an array of
texts. Sheets may be of any length; no operator here keeps one in a single task.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import (
    SHOWN,
    canonical_code,
    clean_text,
    coerce_code,
    column_kind_of_key,
    fold_marks,
    holds_any,
    normalize_key,
    parse_population,
    parse_reference,
    shows_text,
    split_values,
    starts_any,
)
from ..plans.ordered import STRETCH, Running, running, stretch_of
from ..plans.staging import stage

JOB = "job_id"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later expressions read many times.

    Projections are merged, which would copy the expression into each of its
    readers; a generator of one row is a border they do not cross. The value is made
    by a projection below it, which is compiled even where a part of it is not.
    """
    made = df.select("*", value.alias("_made"))
    return made.select(*[F.col(c) for c in df.columns], F.explode(F.array("_made")).alias(name))


def with_header_columns(rows: DataFrame) -> DataFrame:
    """Add ``columns``: place (from 1) of the first column of each kind, and all person columns."""
    keys = F.transform("cells", normalize_key)
    kinds = F.transform(keys, lambda k: F.coalesce(column_kind_of_key(k), F.lit("")))
    first = [
        F.nullif(F.array_position("_kinds", kind), F.lit(0)).cast("int").alias(kind) for kind in rules.COLUMN_KINDS
    ]
    persons = F.filter(
        F.transform("_kinds", lambda k, i: F.when(k == "person", i + 1)), lambda i: i.isNotNull()
    ).alias("person")
    return _once(_once(rows, "_kinds", kinds), "columns", F.struct(*first, persons)).drop("_kinds")


def header_score(columns: Column) -> Column:
    score = F.when(F.size(columns["person"]) > 0, 1).otherwise(0)
    for kind, weight in rules.HEADER_WEIGHTS.items():
        score = score + F.when(columns[kind].isNotNull(), weight).otherwise(0)
    return score


#: between cells in one text; folding leaves it and no word holds it
_BORDER = "\x01"
_WEIGHT = {**rules.HEADER_WEIGHTS, "person": 1}
#: a last word of every header that is known without the code's prefix
_UNCODED = sorted({h.split()[-1] for h in rules.COMBINED_HEADERS if "ghe" not in h})


def _joined(cells: Column) -> Column:
    return F.array_join(cells, _BORDER, "")


def _is_odd(cells: Column) -> Column:
    """A cell holds the border, or a NUL, which keys drop: words may hide, any score is possible."""
    bare = F.array_join(cells, "", "")
    return bare.contains("\0") | bare.contains(_BORDER)


def _folded(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold_marks(text))


def _kinds_in(text: Column) -> dict[str, Column]:
    """By kind: may a cell of the folded, joined ``text`` be of it? Never false where one is.

    The longest word of each kind's phrases is looked for in the text, and words that
    need the code's prefix in the same cell.
    """
    def has(phrases: list[str]) -> Column:
        return holds_any(text, [max(p.split(), key=len) for p in phrases])

    def beside(words: list[str]) -> Column:
        either = "|".join(re.escape(w) for w in words)
        inside = f"[^{_BORDER}]*"
        return coded & has(words) & text.rlike(f"ghe{inside}(?:{either})|(?:{either}){inside}ghe")

    coded = text.contains("ghe")
    apart = f"[^a-z0-9{_BORDER}]"
    headers = "|".join(f"{apart}+".join(h.split()) for h in rules.COMBINED_HEADERS)
    whole = text.rlike(f"(?:^|{_BORDER}){apart}*(?:{headers}){apart}*(?:{_BORDER}|\\z)")  # a cell that is one of the headers
    return {
        "combined": beside(rules.COMBINED_WORDS) | (_may_be_coded(text) & whole),
        "code": beside(rules.CODE_WORDS),
        "name": beside(rules.NAME_WORDS),
        "sector": has(rules.SECTOR_WORDS),
        "role": has(rules.ROLE_WORDS),
        "population": has([*rules.POPULATION_HEADERS, *rules.POPULATION_PHRASES]),
        "person": has(rules.PERSON_HEADERS),
    }


def _may_be_coded(text: Column) -> Column:
    return functools.reduce(operator.or_, [text.contains(w) for w in _UNCODED], text.contains("ghe"))


def _most_score(text: Column) -> Column:
    """No less than the score of a row with this folded, joined text."""
    return functools.reduce(operator.add, [F.when(there, _WEIGHT[k]).otherwise(0) for k, there in _kinds_in(text).items()])


def may_be_header(cells: Column) -> Column:
    """Cheap test that every row with a usable row's score passes.

    A row below ``HEADER_USABLE`` cannot keep a usable row from winning.
    """
    return _is_odd(cells) | F.exists(F.array(_folded(_joined(cells))), lambda t: _most_score(t) >= rules.HEADER_USABLE)


def _possible_headers(rows: DataFrame) -> DataFrame:
    """The rows that ``may_be_header`` lets pass, with ``_most``: no less than their score.

    The same test as plain columns, which are compiled, in steps: most rows end at the
    code's prefix.
    """
    names = [JOB, "sheet", "sheet_ord", "row_no", "cells"]
    text = F.col("_text")
    read = _once(rows.select(*names), "_joined", _joined(F.col("cells")))
    read = _once(read, "_text", _folded(F.col("_joined")))
    kinds = _kinds_in(text)
    plain = [k for k in rules.HEADER_WEIGHTS if k not in ("combined", "code", "name")]
    # without the prefix a row has the other kinds only, and needs a person column if these are too few
    uncoded = kinds["person"] if sum(_WEIGHT[k] for k in plain) < rules.HEADER_USABLE else F.lit(True)
    likely = read.where(F.col("_joined").contains("\0") | _may_be_coded(text) | uncoded)
    most = F.when(_is_odd(F.col("cells")), sum(_WEIGHT.values())).otherwise(_most_score(text))
    return _once(likely, "_most", most).where(F.col("_most") >= rules.HEADER_USABLE).select(*names, "_most")


def detect_header(rows: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """The header row of each job: ``job_id, sheet, sheet_ord, row_no, score, columns``.

    The first perfect row wins, else the best score, earliest on ties. Jobs whose
    best row is not usable give no row. All rows of every sheet are looked at;
    ``scan_rows`` limits that to the first ones where a caller wants it. Rows that
    cannot reach a usable row's score are left out by one cheap test first; where a
    job has a perfect row, its rows that cannot be perfect are not tested further.
    """
    near = rows if scan_rows is None else rows.where(F.col("row_no") <= scan_rows)
    found = stage(_possible_headers(near), "possible-headers")  # read three times below, and few
    sure = _best_headers(found.where(F.col("_most") >= rules.HEADER_PERFECT)).where(F.col("score") >= rules.HEADER_PERFECT)
    sure = stage(sure, "perfect-headers")
    # what is no perfect header counts only in jobs that have none
    known = sure.select(F.col(JOB).alias("_known"))
    rest = _best_headers(stage(found.join(known, F.col(JOB).eqNullSafe(F.col("_known")), "left_anti"), "open-headers"))
    return sure.unionByName(rest)


def _best_headers(rows: DataFrame) -> DataFrame:
    """The best row of each job, where it is usable. Equal rows are scored once; ``rows`` is read twice."""
    scored = (
        _once(with_header_columns(rows.select("cells").distinct()), "score", header_score(F.col("columns")))
        .withColumn(
            "usable",
            (F.col("columns.combined").isNotNull() | F.col("columns.code").isNotNull())
            & (F.col("score") >= rules.HEADER_USABLE),
        )
        .withColumnRenamed("cells", "_cells")
    )
    perfect = F.col("usable") & (F.col("score") >= rules.HEADER_PERFECT)
    rank = F.struct(
        F.when(perfect, 0).otherwise(1),
        F.when(perfect, 0).otherwise(-F.col("score")),
        F.col("sheet_ord"),
        F.col("row_no"),
    )
    placed = rows.join(stage(scored, "header-kinds"), F.col("cells") == F.col("_cells"))
    return (
        placed.groupBy(JOB)
        .agg(F.min_by(F.struct("sheet", "sheet_ord", "row_no", "score", "usable", "columns", "cells"), rank).alias("h"))
        .select(JOB, "h.*")
        .where("usable")
        .drop("usable")
    )


def ignored_person_headers(headers: DataFrame) -> DataFrame:
    """Names of the person columns that were left out: provenance, no cell values."""
    return (
        headers.select(JOB, F.posexplode("columns.person").alias("pos", "at"), "cells")
        .select(JOB, "pos", clean_text(F.try_element_at("cells", F.col("at"))).alias("header"))
        .where("header <> ''")
        .groupBy(JOB, normalize_key("header").alias("header_key"))
        .agg(F.min_by("header", "pos").alias("header"), F.min("pos").alias("pos"))
    )


def data_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows below the header with their fields by kind; person cells become presence.

    Blank rows are gone; ``is_total`` marks total and subtotal rows.
    """
    at = headers.select(
        JOB, F.col("sheet_ord").alias("_sheet"), F.col("row_no").alias("_header"), F.col("columns").alias("_c")
    )
    # joined by job alone, as windows and groups that follow want it: an equality would become a key, and they would shuffle anew
    below = rows.join(at, JOB).where("sheet_ord between _sheet and _sheet and row_no > _header")

    def cell(kind: str) -> Column:
        return F.when(F.col(f"_c.{kind}").isNotNull(), F.try_element_at("cells", F.col(f"_c.{kind}")))

    def shows(i: Column) -> Column:
        return shows_text(F.try_element_at(F.col("cells"), i))

    # one person column or none is the rule, and needs no lambda, which is not compiled
    persons = F.col("_c.person")
    present = F.when(F.size(persons) == 0, F.lit(False)).when(F.size(persons) == 1, shows(F.get(persons, F.lit(0)))).otherwise(F.exists(persons, shows))
    fields = below.select(
        JOB,
        "row_no",
        *[cell(kind).alias(kind) for kind in rules.COLUMN_KINDS],
        present.alias("person_present"),
        F.col("_c.population").isNotNull().alias("has_population"),
    )
    # blank rows and totals are told by one text of all kinds; the generator keeps its cells from being read again
    read = _once(fields, "_all", _all_kinds())
    shown = read.where(F.col("_all").rlike(SHOWN) | F.col("person_present"))
    return shown.withColumn("is_total", _is_total(F.col("_all"))).drop("_all")


def _all_kinds() -> Column:
    return F.replace(F.concat_ws(" ", *rules.COLUMN_KINDS), F.lit("\0"), F.lit(""))


def _is_total(text: Column) -> Column:
    """``is_total_row`` by the one text of all kinds: that of ASCII has its key's words as they stand."""
    apart = "[^a-z0-9]"
    # a prefix that ends in a space asks for another word
    openings = [f"{apart}+".join(p.split()) + (f"{apart}+[a-z0-9]" if p.endswith(" ") else "") for p in rules.TOTAL_ROW_PREFIXES]
    plain = text.rlike(rf"(?i)\A{apart}*(?:{'|'.join(openings)})")
    return F.when(F.octet_length(text) == F.length(text), plain).otherwise(is_total_row())


def _visible() -> Column:
    return F.array(*[clean_text(kind) for kind in rules.COLUMN_KINDS])


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    """Without rows that show nothing and have no person either."""
    shown = F.col("person_present")
    for kind in reversed(rules.COLUMN_KINDS):
        shown = shows_text(kind) | shown  # the first cell that shows something ends the test
    return rows.where(shown)


def is_total_row() -> Column:
    # both ways are behind lambdas: a projection would work out what a second operand repeats for every row
    # ASCII text without a prefix's letters has none in its key; only the others are cleaned and folded
    words = sorted({p.split()[0] for p in rules.TOTAL_ROW_PREFIXES})
    raw = F.replace(F.concat_ws(" ", *rules.COLUMN_KINDS), F.lit("\0"), F.lit(""))
    plain = F.exists(F.array(raw), lambda t: (F.octet_length(t) == F.length(t)) & ~F.exists(F.array(F.lower(t)), lambda low: holds_any(low, words)))
    full = F.exists(F.array(F.array_join(_visible(), " ")), lambda t: starts_any(normalize_key(t), rules.TOTAL_ROW_PREFIXES))
    return F.when(plain, F.lit(False)).otherwise(full)


def split_total_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Data rows, and per job the last total that could be read."""
    total = parse_population("population")
    declared = (
        rows.where("is_total")
        .select(JOB, "row_no", total.alias("total"))
        .where("total is not null")
        .groupBy(JOB)
        .agg(F.max_by("total", "row_no").alias("declared_total"))
    )
    return rows.where("not is_total"), declared


def forward_fill(df: DataFrame, keys: list[str], ord_col: str, column: str, stretch: Column | None = None) -> DataFrame:
    """Replace NULLs by the last value before them."""
    filled = running(
        df, keys, [ord_col], {"_filled": Running("last", F.col(column))}, stretch or stretch_of(ord_col)
    )
    return filled.withColumn(column, F.col("_filled")).drop("_filled")


def last_row(rows: DataFrame) -> int:
    """The greatest ``row_no`` of a stored table; one column is read."""
    return rows.agg(F.coalesce(F.max("row_no"), F.lit(0)).alias("n")).first()["n"]


def group_rows(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """Data rows under the group code that is in force; rows before the first code are out.

    Where ``longest``, the greatest ``row_no`` of the sheets, is known and within the first
    stretch, no row inherits from another stretch: one window fills in the codes, and only
    the columns that are asked for are worked out.
    """
    read = rows.withColumn("_ref", F.when(F.col("combined") != "", parse_reference("combined")))
    coded = read.withColumn("own_code", F.coalesce(F.col("_ref.code"), F.when(F.col("code") != "", coerce_code("code"))))
    if longest is not None and longest < STRETCH:
        upto = Window.partitionBy(JOB).orderBy("row_no")  # by job alone: groups and totals need no other shuffle
        upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = _named_rows(coded.withColumn("group_code", F.last("own_code", ignorenulls=True).over(upto)))
    else:
        named = stage(_named_rows(coded.withColumn("group_code", F.col("own_code"))), "group-rows")  # read twice below, and narrow
        filled = forward_fill(named, [JOB], "row_no", "group_code")
    return filled.where("group_code is not null")


def _named_rows(coded: DataFrame) -> DataFrame:
    return coded.select(
        JOB,
        "row_no",
        "own_code",
        "group_code",
        F.when(
            F.col("own_code").isNotNull(),
            F.coalesce(F.nullif(clean_text("name"), F.lit("")), F.col("_ref.name"), F.lit("")),
        ).alias("own_name"),
        "sector",
        "role",
        parse_population("population").alias("population"),
        F.col("person_present"),
        F.col("has_population"),
    )


def group_population(rows: DataFrame) -> DataFrame:
    """Official groups: ``job_id, ord_at, code, name, population, counted, named``.

    The population is the sum of the readable head-counts; only where a sheet has
    no population column are rows with a person counted.
    """
    name = F.min_by(
        F.col("own_name"), F.when(F.col("own_code").isNotNull() & (F.col("own_name") != ""), F.col("row_no"))
    )
    people = F.count_if(F.col("population").isNull() & ~F.col("has_population") & F.col("person_present"))
    return (
        rows.groupBy(JOB, F.col("group_code").alias("code"))
        .agg(
            F.min("row_no").alias("ord_at"),
            name.alias("_name"),
            F.sum("population").alias("_sum"),
            people.alias("_people"),
        )
        .select(
            JOB,
            "ord_at",
            "code",
            F.coalesce("_name", "code").alias("name"),
            F.coalesce("_sum", "_people").alias("population"),
            (F.col("_sum").isNull() & (F.col("_people") > 0)).alias("counted"),
            F.col("_name").isNotNull().alias("named"),
        )
    )


def group_values(rows: DataFrame) -> DataFrame:
    """Sectors and roles as rows: ``job_id, code, kind, row_no, pos, value``."""
    listed = F.array(
        F.struct(F.lit("sector").alias("kind"), split_values("sector").alias("items")),
        F.struct(F.lit("role").alias("kind"), split_values("role").alias("items")),
    )
    return (
        rows.select(JOB, F.col("group_code").alias("code"), "row_no", F.explode(listed).alias("l"))
        .select(JOB, "code", "row_no", F.col("l.kind").alias("kind"), F.posexplode("l.items").alias("pos", "value"))
    )


def distinct_values(values: DataFrame) -> DataFrame:
    """First spelling of each sector and role per group, with its place."""
    return (
        values.withColumn("value_key", normalize_key("value"))
        .groupBy(JOB, "code", "kind", "value_key")
        .agg(
            F.min_by("value", F.struct("row_no", "pos")).alias("value"),
            F.min(F.struct("row_no", "pos")).alias("at"),
        )
    )


def total_check(groups: DataFrame, declared: DataFrame) -> DataFrame:
    """``job_id, total_population, declared_total, diverges`` per job."""
    totals = groups.groupBy(JOB).agg(F.sum("population").alias("total_population"))
    return totals.join(declared, JOB, "left").select(
        JOB,
        "total_population",
        "declared_total",
        F.coalesce(F.col("declared_total") != F.col("total_population"), F.lit(False)).alias("diverges"),
    )


def with_total(groups: DataFrame) -> DataFrame:
    """Groups and one TOTAL row per job, from one grouping-sets aggregate."""
    label = F.concat("code", F.lit(" - "), "name")
    return (
        groups.withColumn("label", label)
        .groupingSets([[JOB, "ord_at", "label"], [JOB]], JOB, "ord_at", "label")
        .agg(F.sum("population").alias("population"), F.grouping("label").alias("_total"))
        .select(
            JOB,
            F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("label")).alias("label"),
            "population",
            (F.col("_total") == 1).alias("is_total"),
            F.col("ord_at"),
        )
    )


def detail_rows(rows: DataFrame, groups: DataFrame, scan_rows: int | None = None) -> DataFrame:
    """Sector and role cells of sheets named after an official group.

    The header of such a sheet is its first row with a sector and a role, among the
    first ``scan_rows`` where that is given.
    """
    named = rows.withColumn("code", canonical_code("sheet")).where("code is not null")
    known = named.join(groups.select(JOB, "code").distinct(), [JOB, "code"], "left_semi")
    heads = (
        with_header_columns(known if scan_rows is None else known.where(F.col("row_no") <= scan_rows))
        .where("columns.sector is not null and columns.role is not null")
        .groupBy(JOB, "sheet_ord")
        .agg(F.min_by(F.struct("row_no", "columns"), "row_no").alias("_h"))
    )
    return (
        known.join(heads, [JOB, "sheet_ord"])
        .where("row_no > _h.row_no")
        .select(
            JOB,
            F.col("code").alias("group_code"),
            "sheet_ord",
            "row_no",
            F.try_element_at("cells", F.col("_h.columns.sector")).alias("sector"),
            F.try_element_at("cells", F.col("_h.columns.role")).alias("role"),
        )
    )


def enrich_from_details(values: DataFrame, details: DataFrame) -> DataFrame:
    """Own values first, then those of the detail sheets, first spelling kept."""
    extra = group_values(details.drop("sheet_ord").withColumn("_s", F.lit(0)))
    ranked = values.withColumn("origin", F.lit(0)).unionByName(extra.withColumn("origin", F.lit(1)))
    place = F.struct("origin", "row_no", "pos")
    return (
        ranked.withColumn("value_key", normalize_key("value"))
        .groupBy(JOB, "code", "kind", "value_key")
        .agg(F.min_by("value", place).alias("value"), F.min(place).alias("at"))
    )


def missing_details(groups: DataFrame, details: DataFrame) -> DataFrame:
    """Codes without any sector or role on a sheet of their own."""
    found = group_values(details.drop("sheet_ord")).select(JOB, "code").distinct()
    return groups.select(JOB, "code").distinct().join(found, [JOB, "code"], "left_anti")


def extraction_warnings(groups: DataFrame, totals: DataFrame) -> DataFrame:
    """Warnings of the registry extraction: ``job_id, source_id, code``."""
    unnamed = groups.where("not named").select(JOB, F.col("code").alias("source_id"), F.lit("name_missing").alias("code"))
    empty = groups.where("population = 0").select(
        JOB, F.col("code").alias("source_id"), F.lit("zero_population").alias("code")
    )
    counted = groups.where("counted").select(JOB).distinct().select(
        JOB, F.lit(None).cast("string").alias("source_id"), F.lit("population_counted").alias("code")
    )
    diverging = totals.where("diverges").select(
        JOB, F.lit(None).cast("string").alias("source_id"), F.lit("total_diverges").alias("code")
    )
    return unnamed.unionByName(empty).unionByName(counted).unionByName(diverging)


def duplicate_keys(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_person_columns(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells of the header's sheet without the person columns."""
    at = headers.select(JOB, F.col("sheet_ord").alias("_sheet"), F.col("columns.person").alias("_p"))
    kept = F.filter("cells", lambda c, i: ~F.array_contains(F.col("_p"), i + 1))
    return rows.join(at, JOB).where("sheet_ord = _sheet").select(
        JOB, "sheet_ord", "row_no", kept.alias("cells"), F.size("_p").alias("n_dropped")
    )
