"""Ordered document units cut into blocks, sections, regions and slots.

Units are rows of ``keys + ord`` with ``text``, ``rows`` (cells of a table) and,
where the source knows it, ``style`` or ``structural``. ``ord`` is an integer
position, unique per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import (
    cells_key,
    classify_heading,
    clean_text,
    is_group_heading,
    is_numbered_heading,
    is_section_heading,
    label_kind,
    normalize_key,
    parse_reference,
    starts_any,
)
from ..plans.numbering import dense
from ..plans.ordered import Running, first_rows, ordinal, running
from ..plans.staging import stage
from ..plans.stretches import AT, CUT, laid_out, last_event

_NO_ROWS = "array<array<string>>"


def _with_rows(units: DataFrame) -> DataFrame:
    return units if "rows" in units.columns else units.withColumn("rows", F.lit(None).cast(_NO_ROWS))


def value_array() -> Column:
    """Text first, then the non-empty cells row by row."""
    cells = F.coalesce(F.flatten("rows"), F.array().cast("array<string>"))
    return F.filter(F.concat(F.array(F.coalesce(F.col("text"), F.lit(""))), cells), lambda x: x != "")


def unit_values(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row per value of each unit: ``keys, ord, pos, value``."""
    return _with_rows(units).select(*keys, "ord", F.posexplode(value_array()).alias("pos", "value"))


def segment_blocks(units: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``block_no`` (0 before the first block), ``opens`` and the block's title hints.

    A unit opens a block when its first value is a group heading whose code and
    name were not seen before in the document; a repeated heading stays inside
    the block that is open.

    Units are laid out in stretches of equal row counts, whatever the spacing of
    ``ord``. The openings are found in one pass over the texts and stored: they
    are few. Units then take the last opening before them.
    """
    structural = F.col("structural") if "structural" in units.columns else F.lit(False)
    log = laid_out(units, keys, ["ord"])
    titled = (
        _with_rows(log.rows)
        .select(*keys, "ord", AT, CUT, F.coalesce(F.try_element_at(value_array(), F.lit(1)), F.lit("")).alias("block_title"), structural.alias("_s"))
        .where(is_group_heading(F.col("block_title"), F.col("_s")))
        .select(*keys, "ord", AT, CUT, "block_title", parse_reference("block_title").alias("_ref"))
    )
    firsts = titled.groupBy(
        *keys, F.col("_ref.code").alias("block_code"), normalize_key(F.col("_ref.name")).alias("_name")
    ).agg(F.min_by(F.struct(F.col("ord").alias("_from"), AT, CUT, "block_title", F.col("_ref.name").alias("block_name")), AT).alias("_o"))
    numbered = dense(firsts.select(*keys, "block_code", "_o.*"), keys, [AT], "_no", "openings")
    openings = stage(numbered.withColumn("block_no", F.col("_no") + 1).drop("_no"), "openings")
    carried = last_event(log, openings, ["block_no", "_from", "block_title", "block_code", "block_name"])
    return carried.select(
        *units.columns,
        F.coalesce(F.col("_from") == F.col("ord"), F.lit(False)).alias("opens"),
        F.coalesce("block_no", F.lit(0)).alias("block_no"),
        "block_title",
        "block_code",
        "block_name",
    )


def blocks_of(segmented: DataFrame, keys: list[str], prefix: str = "ergo-", width: int = 3) -> DataFrame:
    """One row per block: ``keys, source_id, ord, title, source_code, source_name``."""
    return segmented.where("opens").select(
        *keys,
        ordinal_id(F.col("block_no"), prefix, width).alias("source_id"),
        (F.col("block_no") - 1).alias("ord"),
        F.col("block_title").alias("title"),
        F.col("block_code").alias("source_code"),
        F.col("block_name").alias("source_name"),
    )


def preamble(segmented: DataFrame) -> DataFrame:
    """Units before the first block."""
    return segmented.where("block_no = 0")


def labelled_values(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """Question, answer, observation and guidance lines of each block, numbered per kind."""
    values = (
        _with_rows(segmented.where("block_no > 0"))
        .select(*keys, "block_no", "ord", F.posexplode(value_array()).alias("pos", "value"))
        .withColumn("label", label_kind("value"))
        .where("label is not null")
    )
    return ordinal(values, [*keys, "block_no", "label"], ["ord", "pos"], "item_no")


def ordinal_id(number: Column, prefix: str, width: int, base: int = 0) -> Column:
    """``prefix`` and a zero-padded ordinal."""
    text = (number + base).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def segment_sections(units: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``is_heading, section_no, section_title, category, group_code, group_name``.

    Headings open sections; what comes before the first one is section 0. The
    group of a section is the one named by the last heading with a code; a
    numbered heading without a code ends it.

    Headings are found in one pass over the texts, numbered among themselves and
    stored; units then take the last heading before them.
    """
    columns = units.columns
    style = F.col("style") if "style" in columns else None
    textual = F.size(F.coalesce(F.col("rows"), F.array().cast(_NO_ROWS))) == 0 if "rows" in columns else F.lit(True)
    log = laid_out(units, keys, ["ord"])
    found = stage(
        log.rows.where(textual & (clean_text("text") != "") & is_section_heading(F.col("text"), style)).select(
            *keys,
            "ord",
            AT,
            CUT,
            F.col("text").alias("section_title"),
            classify_heading("text").alias("category"),
            parse_reference("text").alias("_ref"),
            is_numbered_heading("text").alias("_numbered"),
        ),
        "headings",
    )
    changes = F.when(F.col("_ref.code").isNotNull() | F.col("_numbered"), F.col("_ref"))
    numbered = running(
        found,
        keys,
        [AT],
        {"section_no": Running("sum", F.lit(1).cast("bigint")), "_group": Running("last", changes)},
        F.col(CUT),
    )
    headings = stage(
        numbered.select(
            *keys, AT, CUT, F.col("ord").alias("_from"), "section_no", "section_title", "category",
            F.col("_group.code").alias("group_code"),
            F.when(F.col("_group.code").isNotNull(), F.col("_group.name")).alias("group_name"),
        ),
        "sections",
    )
    carried = last_event(log, headings, ["_from", "section_no", "section_title", "category", "group_code", "group_name"])
    return carried.select(
        *columns,
        F.coalesce(F.col("_from") == F.col("ord"), F.lit(False)).alias("is_heading"),
        F.coalesce("section_no", F.lit(0)).alias("section_no"),
        F.coalesce("section_title", F.lit("")).alias("section_title"),
        F.coalesce("category", F.lit(rules.OTHER_CATEGORY)).alias("category"),
        "group_code",
        "group_name",
    )


def sections_of(
    segmented: DataFrame, keys: list[str], prefix: str = "technical-section-", width: int = 4
) -> DataFrame:
    """One row per section; the untitled opening section counts when it has units."""
    described = F.struct("section_title", "category", "group_code", "group_name")
    sections = stage(
        segmented.groupBy(*keys, "section_no").agg(F.min_by(described, "ord").alias("_d")).select(*keys, "section_no", "_d.*"),
        "sections",
    )
    untitled = sections.where("section_no = 0").select(*keys, F.lit(0).alias("_shift"))
    position = F.col("section_no") - F.coalesce("_shift", F.lit(1))
    return sections.join(untitled, keys, "left").select(
        *keys,
        ordinal_id(position, prefix, width).alias("section_id"),
        position.alias("section_ord"),
        "section_no", "section_title", "category", "group_code", "group_name",
    )


def body_regions(units: DataFrame, keys: list[str]) -> DataFrame:
    """Body slots under the known headings: ``keys, ord, region_no, category, slot_no``.

    A known heading opens a region, any boundary line ends it; blank lines are
    no slots.
    """
    key = normalize_key("text")
    category = F.lit(None).cast("string")
    for heading, name in rules.REGION_HEADINGS.items():
        category = F.when(key == heading, name).otherwise(category)
    boundary = category.isNotNull() | starts_any(key, rules.REGION_BOUNDARIES)
    log = laid_out(units.select(*keys, "ord", "text"), keys, ["ord"])
    edges = log.rows.where(boundary).select(*keys, AT, CUT, F.col("ord").alias("_from"), category.alias("category"))
    numbered = stage(ordinal(edges, keys, [AT], "region_no", F.col(CUT)), "regions")
    inside = last_event(log, numbered, ["_from", "region_no", "category"])
    body = inside.where(
        (F.col("ord") != F.col("_from")) & F.col("category").isNotNull() & (clean_text("text") != "")
    ).select(*keys, "ord", AT, CUT, "text", "region_no", "category")
    return ordinal(body, [*keys, "region_no"], [AT], "slot_no", F.col(CUT)).drop(AT, CUT)


def fill_slots(items: DataFrame, owners: DataFrame, keys: list[str], capacity: int, columns: list[str]) -> DataFrame:
    """Slot k of each owner holds its k-th item (by ``slot_no``); other slots are blank.

    ``capacity`` is a fixed number of slots, so this multiplies the owners by a
    constant. Items beyond it are rows of ``slot_overflow``; ``capacity_check`` names
    their owners.
    """
    slots = owners.select(*keys).distinct().withColumn("slot_no", F.explode(F.sequence(F.lit(1), F.lit(capacity))))
    return slots.withColumn("slot_no", F.col("slot_no").cast("bigint")).join(
        items.select(*keys, "slot_no", *columns), [*keys, "slot_no"], "left"
    )


def slot_overflow(items: DataFrame, keys: list[str], capacity: int, columns: list[str]) -> DataFrame:
    """The items that ``fill_slots`` has no slot for, with how far behind the last slot they stand."""
    beyond = F.col("slot_no") > capacity
    return items.where(beyond).select(*keys, "slot_no", (F.col("slot_no") - capacity).alias("over"), *columns)


def dedupe_cells(cells: DataFrame, keys: list[str], cell_id: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each physical cell once, at its first position."""
    return first_rows(cells, [*keys, cell_id], order, *order, *columns)


def first_seen_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each key numbered by first appearance."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
    return ordinal(firsts, keys, ["first_at", value], "seen_no")


def collect_stable(values: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """First spelling per comparison key, over rows: ``keys, value_key, value, at``."""
    keyed = values.withColumn("_v", clean_text(value)).where("_v <> ''").withColumn("value_key", normalize_key("_v"))
    return keyed.groupBy(*keys, "value_key").agg(
        F.min_by(F.col("_v"), F.struct(*order)).alias(value), F.min(F.struct(*order)).alias("at")
    )


def question_rows_of(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Recognised question rows of table units, with counter tables left out.

    One output row per question: ``keys, ord, row_no, question, answer, note``.
    """
    from ..functions.text import is_counter_row, question_row

    counter = F.coalesce(is_counter_row(F.try_element_at("rows", F.lit(1))), F.lit(False))
    return (
        tables.where(F.size("rows") > 0)
        .where(~counter)
        .select(*keys, "ord", F.posexplode("rows").alias("row_no", "cells"))
        .withColumn("qa", question_row("cells"))
        .where("qa is not null")
        .select(*keys, "ord", "row_no", "qa.question", "qa.answer", "qa.note")
    )


def zipped_questions(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Questions paired with answers, and with observations or else guidance, by number.

    For blocks without recognised question rows. Each number occurs once per kind,
    so this is a pivot with one row per (block, number).
    """
    def of(label: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col("value")))

    paired = labelled.groupBy(*keys, "item_no").agg(
        of("question").alias("question"), of("answer").alias("answer"),
        of("observation").alias("_o"), of("guidance").alias("_g"),
    )
    return paired.where(F.col("question").isNotNull() | F.col("answer").isNotNull()).select(
        *keys, "item_no",
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"),
        F.coalesce("_o", "_g", F.lit("")).alias("note"),
    )


def answer_counts(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Yes and no answers per block."""
    key = normalize_key("answer")
    return questions.groupBy(*keys).agg(
        F.count_if(key.startswith("sim")).alias("n_yes"), F.count_if(key.startswith("nao")).alias("n_no")
    )


def clean_question_rows(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Without blank rows and repeated header rows."""
    key = cells_key(cells)
    return rows.where((key != "") & ~key.startswith(rules.QUESTION_TABLE_HEADER))


def structure_counts(units: DataFrame, keys: list[str]) -> DataFrame:
    """Units of each kind per document."""
    kind = F.col("kind")
    return units.groupBy(*keys).agg(
        F.count_if(kind == "heading").alias("n_headings"),
        F.count_if(kind == "text").alias("n_paragraphs"),
        F.count_if(kind == "table").alias("n_tables"),
        F.count_if(kind == "image").alias("n_images"),
        F.count(F.lit(1)).alias("n_units"),
    )


def residual_markers(df: DataFrame, keys: list[str], text: str, prefix: str) -> DataFrame:
    """Every marker that is still in a text, with its number of occurrences in it."""
    from ..functions.text import marker_pattern

    found = F.regexp_extract_all(F.col(text), F.lit(f"({marker_pattern(prefix)})"), F.lit(1))
    return (
        df.select(*keys, F.explode(found).alias("marker"))
        .groupBy(*keys, "marker")
        .agg(F.count(F.lit(1)).alias("n"))
    )
