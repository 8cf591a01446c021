"""Technical sections gathered into analyses, tables and result rows.

Section items: ``job_id, section_no, item_ord, part, value`` with ``part`` 0 for the
title, 1 for paragraphs and 2 for table cells; ``category, group_code, group_name``
come from the section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import (
    action_kind_of_key,
    after_separator,
    canonical_code,
    clean_text,
    extract_percentage,
    normalize_key,
    priority_kind_of_key,
)
from ..plans.containment import containment_pairs
from ..plans.ordered import ordinal

JOB = "job_id"
ITEM_ORDER = ["section_no", "part", "item_ord", "pos"]


def section_items(segmented: DataFrame, keys: list[str]) -> DataFrame:
    """Titles, paragraphs and cells of sections as one ordered list of rows."""
    base = [*keys, "section_no", "category", "group_code", "group_name"]
    has_rows = "rows" in segmented.columns
    paragraph = ~F.col("is_heading") & (F.size("rows") <= 0 if has_rows else F.lit(True))
    titles = segmented.where("is_heading").select(
        *base, F.lit(0).alias("part"), F.col("ord").alias("item_ord"), F.lit(0).alias("pos"), F.col("text").alias("value")
    )
    paragraphs = segmented.where(paragraph).select(
        *base, F.lit(1).alias("part"), F.col("ord").alias("item_ord"), F.lit(0).alias("pos"), F.col("text").alias("value")
    )
    items = titles.unionByName(paragraphs)
    if has_rows:
        cells = segmented.where("size(rows) > 0").select(
            *base, F.lit(2).alias("part"), F.col("ord").alias("item_ord"), F.posexplode(F.flatten("rows")).alias("pos", "value")
        )
        items = items.unionByName(cells)
    return items.where("value <> ''")


def build_analyses(items: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (job, group): first percentage, classification and name, in order.

    Every field is a combinable minimum over (section, part, position), so a group
    with most of the items is reduced before it is shuffled.
    """
    position = F.struct(*ITEM_ORDER)
    percent = F.when(F.col("category") == "favorability", extract_percentage("value"))
    in_class = F.col("category") == "classification"
    label = F.when(in_class & (F.col("part") == 0), after_separator("value")).when(
        in_class & (F.col("part") == 1), F.nullif(clean_text("value"), F.lit(""))
    )
    name = F.nullif(F.col("group_name"), F.lit(""))

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), position))

    return (
        items.where("group_code is not null")
        .groupBy(*keys, "group_code")
        .agg(
            F.min("section_no").alias("first_section"),
            first(name).alias("group_name"),
            first(percent).alias("favorable_percentage"),
            first(label).alias("classification"),
            F.count_if((F.col("category") == "technical_reading") & (F.col("part") == 1)).alias("n_readings"),
            F.max("section_no").alias("last_section"),
        )
    )


def readings(items: DataFrame, keys: list[str]) -> DataFrame:
    """Technical readings of each group as numbered rows."""
    rows = items.where("category = 'technical_reading' and part = 1 and group_code is not null")
    return ordinal(
        rows.select(*keys, "group_code", "item_ord", "value"), [*keys, "group_code"], ["item_ord"], "reading_no"
    )


def merge_analyses(analyses: DataFrame) -> DataFrame:
    """Analyses of one code merged, code-less ones behind them, numbered anew from 0.

    ``analyses``: ``job_id, ord, group_code, group_name, favorable_percentage,
    classification, n_readings``.
    """
    keyed = analyses.withColumn("_key", F.upper(F.trim(F.coalesce("group_code", F.lit("")))))

    def first(column: str) -> Column:
        value = F.nullif(F.col(column), F.lit(""))
        return F.min_by(value, F.when(value.isNotNull(), F.col("ord"))).alias(column)

    merged = (
        keyed.where("_key <> ''")
        .groupBy(JOB, "_key")
        .agg(
            F.min("ord").alias("ord"),
            F.min_by("group_code", "ord").alias("group_code"),
            F.min_by("group_name", "ord").alias("group_name"),
            first("favorable_percentage"),
            first("classification"),
            F.sum("n_readings").alias("n_readings"),
            F.count(F.lit(1)).alias("n_merged"),
        )
        .drop("_key")
    )
    loose = keyed.where("_key = ''").drop("_key").withColumn("n_merged", F.lit(1).cast("bigint"))
    both = merged.withColumn("_loose", F.lit(0).cast("bigint")).unionByName(
        loose.select(
            JOB, "ord", "group_code", "group_name", "favorable_percentage", "classification", "n_readings", "n_merged"
        ).withColumn("_loose", F.lit(1).cast("bigint"))
    )
    stretch = F.col("_loose") * F.lit(1 << 50) + F.floor(F.col("ord") / 8192)
    return (
        ordinal(both, [JOB], ["_loose", "ord"], "_no", stretch)
        .withColumn("place", F.col("_no") - 1)
        .drop("_no", "_loose", "ord")
    )


def conclusion(items: DataFrame, keys: list[str]) -> DataFrame:
    """Conclusion paragraphs of all conclusion sections as numbered rows."""
    rows = items.where("category = 'conclusion' and part = 1").select(*keys, "item_ord", "value")
    return ordinal(rows, keys, ["item_ord"], "paragraph_no")


def _header_map(cells: Column, kind_of) -> Column:
    """Position of the first column of each kind, as a map."""
    keys = F.transform(cells, normalize_key)
    kinds = F.transform(keys, lambda k, i: F.struct(F.coalesce(kind_of(k), F.lit("")).alias("k"), (i + 1).alias("at")))
    names = F.array_distinct(F.transform(kinds, lambda s: s["k"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.element_at(F.filter(kinds, lambda s: s["k"] == n), 1)["at"]),
    )


def _cell(cells: Column, at: Column, kind: str) -> Column:
    index = F.try_element_at(at, F.lit(kind))
    return F.when(index.isNotNull(), F.nullif(clean_text(F.try_element_at(cells, index)), F.lit("")))


def priority_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Priority items of prioritization tables; rows need a group and a reason.

    ``tables``: ``keys, section_no, ord, category, rows``.
    """
    at = _header_map(F.try_element_at("rows", F.lit(1)), priority_kind_of_key)
    opened = (
        tables.where("category = 'prioritization' and size(rows) > 0")
        .withColumn("_at", at)
        .where(F.map_contains_key("_at", "group") & F.map_contains_key("_at", "reason"))
        .select(*keys, "section_no", "ord", "_at", F.posexplode("rows").alias("row_no", "cells"))
        .where("row_no > 0")
    )
    items = opened.select(
        *keys, "section_no", "ord", "row_no",
        _cell(F.col("cells"), F.col("_at"), "group").alias("group_hint"),
        _cell(F.col("cells"), F.col("_at"), "level").alias("level"),
        _cell(F.col("cells"), F.col("_at"), "reason").alias("reason"),
    ).where("group_hint is not null and reason is not null")
    return ordinal(items, keys, ["ord", "row_no"], "priority_no")


def action_rows(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Action items of action-plan tables; header-less tables give their first cell.

    The evolution column is left empty on purpose: it is filled in by hand later.
    """
    at = _header_map(F.try_element_at("rows", F.lit(1)), action_kind_of_key)
    opened = (
        tables.where("category = 'action_plan' and size(rows) > 0")
        .withColumn("_at", at)
        .withColumn("_headed", F.map_contains_key("_at", "action"))
        .select(*keys, "section_no", "ord", "group_code", "_at", "_headed", F.posexplode("rows").alias("row_no", "cells"))
        .where("not (_headed and row_no = 0)")
        .where(F.exists("cells", lambda x: x != ""))
    )
    cells, index = F.col("cells"), F.col("_at")
    first = F.try_element_at(F.filter(cells, lambda x: x != ""), F.lit(1))
    items = opened.select(
        *keys, "section_no", "ord", "row_no",
        F.when(F.col("_headed"), _cell(cells, index, "action")).otherwise(first).alias("action"),
        F.coalesce(_cell(cells, index, "group"), F.col("group_code")).alias("group_hint"),
        *[_cell(cells, index, k).alias(k) for k in ("responsible", "deadline", "indicator", "priority")],
        F.lit("").alias("evolution"),
    ).where("action is not null and action <> ''")
    return ordinal(items, keys, ["ord", "row_no"], "action_no")


def category_coverage(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Which required categories each document has, one row per document."""
    return sections.groupBy(*keys).agg(
        *[F.bool_or(F.col("category") == c).alias(f"has_{c}") for c in rules.REQUIRED_CATEGORIES],
        F.count(F.lit(1)).alias("n_sections"),
    )


def missing_categories(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Required categories that a document lacks, one row each."""
    absent = F.array_compact(F.array(*[F.when(~F.col(f"has_{c}"), c) for c in rules.REQUIRED_CATEGORIES]))
    return coverage.select(*keys, F.explode(absent).alias("category"))


def pivot_sections(items: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of the four slot categories side by side, row k holding the k-th text of each.

    Texts stay rows, so a group with very many paragraphs is not one value.
    """
    rows = items.where(F.col("category").isin(rules.TEXT_SLOT_CATEGORIES) & (F.col("part") == 1) & F.col("group_code").isNotNull())
    numbered = ordinal(
        rows.select(*keys, "group_code", "category", "item_ord", "value"),
        [*keys, "group_code", "category"], ["item_ord"], "line_no",
    )
    return numbered.groupBy(*keys, "group_code", "line_no").pivot("category", rules.TEXT_SLOT_CATEGORIES).agg(F.max("value"))


def analysis_for_group(groups: DataFrame, analyses: DataFrame, variant: str = "compile") -> DataFrame:
    """The analysis of each official group, by code or by its name inside the analysis name.

    ``compile`` tries all codes before any name; ``validate`` takes the first
    analysis in order for which either holds. ``analyses``: ``job_id, ord,
    analysis_id, group_code, group_name``.
    """
    official = groups.select(JOB, "code", normalize_key("name").alias("_needle"))
    listed = analyses.select(
        JOB, "analysis_id", "ord", F.coalesce(canonical_code("group_code"), F.lit("")).alias("code"),
        normalize_key("group_name").alias("_hay"),
    )
    by_code = official.join(listed.drop("_hay"), [JOB, "code"]).select(
        JOB, "code", "analysis_id", "ord", F.lit(0).alias("how")
    )
    pairs = containment_pairs(
        official.select(JOB, F.col("_needle").alias("needle")), listed.select(JOB, F.col("_hay").alias("haystack")), [JOB]
    )
    # of the analyses with one name only the first can win
    first_named = listed.groupBy(JOB, F.col("_hay").alias("haystack")).agg(
        F.min_by("analysis_id", "ord").alias("analysis_id"), F.min("ord").alias("ord")
    )
    best_named = (
        pairs.join(first_named, [JOB, "haystack"])
        .groupBy(JOB, F.col("needle").alias("_needle"))
        .agg(F.min_by("analysis_id", "ord").alias("analysis_id"), F.min("ord").alias("ord"))
    )
    by_name = official.join(best_named, [JOB, "_needle"]).select(
        JOB, "code", "analysis_id", "ord", F.lit(1).alias("how")
    )
    rank = F.struct("how", "ord") if variant == "compile" else F.struct("ord", "how")
    return by_code.unionByName(by_name).groupBy(JOB, "code").agg(
        F.min_by(F.struct("analysis_id", "how"), rank).alias("a")
    ).select(JOB, "code", "a.analysis_id", F.when(F.col("a.how") == 0, "code").otherwise("name").alias("matched_by"))


def block_for_group(groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """The media block of each official group: ten points for the code, four for the name.

    ``blocks``: ``job_id, block_id, ord, code, name``.
    """
    official = groups.select(JOB, "code", normalize_key("name").alias("_needle"))
    listed = blocks.select(
        JOB, "block_id", "ord", F.coalesce(canonical_code("code"), F.lit("")).alias("_code"),
        normalize_key("name").alias("_hay"),
    )
    pairs = containment_pairs(
        official.select(JOB, F.col("_needle").alias("needle")), listed.select(JOB, F.col("_hay").alias("haystack")), [JOB]
    )
    # a block scores by code, by name or by both; per (name, code) only its first block can win
    first_of = listed.groupBy(JOB, "_hay", "_code").agg(
        F.min_by("block_id", "ord").alias("block_id"), F.min("ord").alias("ord")
    )
    by_code = (
        official.join(first_of.withColumn("code", F.col("_code")), [JOB, "code"])
        .select(
            JOB, "code", "block_id", "ord",
            F.when(
                (F.col("_needle") != "") & F.col("_hay").contains(F.col("_needle")),
                rules.BLOCK_CODE_POINTS + rules.BLOCK_NAME_POINTS,
            ).otherwise(rules.BLOCK_CODE_POINTS).alias("score"),
        )
    )
    named = first_of.groupBy(JOB, F.col("_hay").alias("haystack")).agg(
        F.min_by("block_id", "ord").alias("block_id"), F.min("ord").alias("ord")
    )
    best_named = (
        pairs.join(named, [JOB, "haystack"])
        .groupBy(JOB, F.col("needle").alias("_needle"))
        .agg(F.min_by("block_id", "ord").alias("block_id"), F.min("ord").alias("ord"))
    )
    by_name = official.join(best_named, [JOB, "_needle"]).select(
        JOB, "code", "block_id", "ord", F.lit(rules.BLOCK_NAME_POINTS).alias("score")
    )
    rank = F.struct(F.col("score"), -F.col("ord"))
    return by_code.unionByName(by_name).groupBy(JOB, "code").agg(
        F.max_by(F.struct("block_id", "score"), rank).alias("b")
    ).select(JOB, "code", "b.block_id", "b.score")


def question_rows_for_groups(matches: DataFrame, tables: DataFrame) -> DataFrame:
    """Question-table rows of the analysis each group was given.

    ``matches``: ``job_id, code, group_code``; ``tables``: ``job_id, group_code,
    section_no, ord, category, rows``.
    """
    from .segments import clean_question_rows

    rows = tables.where(F.col("category").isin(rules.QUESTION_CATEGORIES)).select(
        JOB, "group_code", "ord", F.posexplode("rows").alias("row_no", "cells")
    )
    return clean_question_rows(rows).join(matches.select(JOB, "code", "group_code"), [JOB, "group_code"])


def coverage_gaps(groups: DataFrame, covered: DataFrame) -> DataFrame:
    """Official codes without a counterpart."""
    return groups.select(JOB, "code").distinct().join(covered.select(JOB, "code").distinct(), [JOB, "code"], "left_anti")


def capacity_check(items: DataFrame, contract: DataFrame) -> DataFrame:
    """Jobs with more items than their contract has slots: ``job_id, n_items, capacity``."""
    counts = items.groupBy(JOB).agg(F.count(F.lit(1)).alias("n_items"))
    return counts.join(contract, JOB).where("n_items > capacity").select(JOB, "n_items", "capacity")


def union_sources(sources: list[tuple[str, DataFrame]], key: str = JOB) -> DataFrame:
    """Sections of several sources in one order: later sources continue the numbering.

    The offset of a source is the section count of the sources before it, per job.
    """
    result, before = None, None
    for role, sections in sources:
        tagged = sections.withColumn("source_role", F.lit(role))
        if before is not None:
            tagged = (
                tagged.join(before, key, "left")
                .withColumn("section_ord", F.col("section_ord") + F.coalesce("_offset", F.lit(0)))
                .drop("_offset")
            )
        counts = sections.groupBy(key).agg(F.count(F.lit(1)).alias("_offset"))
        before = counts if before is None else (
            before.unionByName(counts).groupBy(key).agg(F.sum("_offset").alias("_offset"))
        )
        result = tagged if result is None else result.unionByName(tagged)
    return result


def mode_check(jobs: DataFrame, sources: DataFrame) -> DataFrame:
    """Jobs whose source roles do not fit their mode."""
    facts = sources.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("source_role") == r).alias(f"_{r}") for roles in rules.SOURCE_ROLES.values() for r in roles],
    )
    fits = F.lit(False)
    for mode, roles in rules.SOURCE_ROLES.items():
        test = (F.col("analysis_mode") == mode) & (F.col("_n") == len(roles))
        for r in roles:
            test = test & (F.col(f"_{r}") == 1)
        fits = fits | test
    return jobs.join(facts, JOB, "left").where(~F.coalesce(fits, F.lit(False))).select(JOB, "analysis_mode")
