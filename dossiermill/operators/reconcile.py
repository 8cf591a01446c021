"""Blocks matched against the official registry.

Copies cost nothing here: blocks are first reduced to their distinct *hints*
(job, code, name key). Candidates and the proposed plan are worked out per hint,
and blocks take their plan row by an equi-join. A name or code that a third of
all blocks share is therefore scored once.

Registries are joined by key, never broadcast by hint: nothing bounds their
size, and adaptive execution broadcasts them by itself where they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.similarity import name_similarity
from ..functions.text import canonical_code, canonical_code_or_raw, clean_text, normalize_group_name, normalize_key
from ..plans.near_names import near_name_pairs
from ..plans.staging import stage

JOB = "job_id"
HINT = [JOB, "code_hint", "name_key"]


def official_groups(groups: DataFrame) -> DataFrame:
    """Registry rows with their matching keys, one per code: the first in order."""
    keyed = groups.withColumn("code", canonical_code_or_raw("code")).withColumn("name_key", normalize_group_name("name"))
    return (
        keyed.groupBy(JOB, "code")
        .agg(F.min_by(F.struct("ord", "name", "name_key"), F.struct("ord", "name")).alias("g"))
        .select(JOB, "code", "g.*")
    )


def distinct_hints(blocks: DataFrame) -> DataFrame:
    """The distinct hints of blocks or media, stored: everything else is worked out on them."""
    return stage(blocks.select(*HINT).distinct(), "hints")


def with_hints(blocks: DataFrame, code: str = "source_code", name: str = "source_name") -> DataFrame:
    """Blocks with ``code_hint`` and ``name_key``, both empty texts when absent, and ``has_name``.

    A name without a letter or digit has an empty key and is still a name.
    """
    return (
        blocks.withColumn("code_hint", F.coalesce(canonical_code(code), F.lit("")))
        .withColumn("has_name", clean_text(name) != "")
        .withColumn("name_key", normalize_group_name(name))
    )


def similarity_floor() -> float:
    """Lowest similarity at which a name alone makes a candidate.

    The candidate floor over the similar-name weight, at the four digits scores
    are kept with.
    """
    raw = rules.CANDIDATE_FLOOR / rules.SIMILAR_NAME_WEIGHT
    steps = int(raw * 10_000)
    return steps / 10_000 if steps >= raw * 10_000 else (steps + 1) / 10_000


def candidates(hints: DataFrame, groups: DataFrame, mode: str = "sequence") -> DataFrame:
    """Scored candidates of every distinct hint.

    ``job_id, code_hint, name_key, official_code, official_ord, same_code,
    similarity, score, reasons``. Needs ``distinct_hints`` of the blocks and
    ``official_groups``.
    """
    official = groups.select(
        JOB, F.col("code").alias("official_code"), F.col("ord").alias("official_ord"), F.col("name_key").alias("off_key")
    )
    by_code = (
        hints.where("code_hint <> ''")
        .join(official.withColumn("code_hint", F.col("official_code")), [JOB, "code_hint"])
        .select(
            *HINT, "official_code", "official_ord",
            F.lit(True).alias("same_code"),
            name_similarity(F.col("name_key"), F.col("off_key"), mode).alias("similarity"),
        )
    )
    pairs = near_name_pairs(
        hints.select(JOB, F.col("name_key").alias("key")),
        official.select(JOB, F.col("off_key").alias("key")),
        [JOB],
        similarity_floor(),
        mode,
    )
    by_name = (
        hints.join(pairs.withColumnRenamed("left_key", "name_key"), [JOB, "name_key"])
        .join(official.withColumnRenamed("off_key", "right_key"), [JOB, "right_key"])
        .where("code_hint <> official_code")
        .select(*HINT, "official_code", "official_ord", F.lit(False).alias("same_code"), "similarity")
    )
    return (
        by_code.unionByName(by_name)
        .withColumn("score", score_of(F.col("same_code"), F.col("similarity")))
        .where(F.col("score") >= rules.CANDIDATE_FLOOR)
        .withColumn("score", F.round(F.least("score", F.lit(1.0)), 4))
        .withColumn("reasons", reasons_of(F.col("same_code"), F.col("similarity")))
    )


def score_of(same_code: Column, similarity: Column) -> Column:
    return F.when(same_code, rules.SAME_CODE_WEIGHT).otherwise(0.0) + (
        F.when(similarity == 1.0, rules.SAME_NAME_WEIGHT)
        .when(similarity >= rules.SIMILAR_NAME_FLOOR, similarity * rules.SIMILAR_NAME_WEIGHT)
        .otherwise(0.0)
    )


def reasons_of(same_code: Column, similarity: Column) -> Column:
    return F.concat_ws(
        ",",
        F.when(same_code, "same_code"),
        F.when(similarity == 1.0, "same_name").when(similarity >= rules.SIMILAR_NAME_FLOOR, "similar_name"),
    )


def rank_candidates(cands: DataFrame) -> DataFrame:
    """Candidates of each hint numbered by score, ties in registry order.

    A hint has at most one candidate per official code of its job.
    """
    order = Window.partitionBy(*HINT).orderBy(F.col("score").desc(), F.col("official_ord"))
    return cands.withColumn("rank", F.row_number().over(order).cast("bigint"))


def hint_plans(hints: DataFrame, cands: DataFrame) -> DataFrame:
    """Proposed status, target and warning of every distinct hint."""
    exact = F.col("same_code") & ((F.col("similarity") == 1.0) | (F.col("name_key") == ""))
    best = F.struct(F.col("score"), -F.col("official_ord"))
    facts = cands.groupBy(*HINT).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if(exact).alias("n_exact"),
        F.max(F.when(exact, F.col("official_code"))).alias("exact_code"),
        F.max_by("official_code", best).alias("top_code"),
        F.max("score").alias("top_score"),
    )
    matched = F.col("n_exact") == 1
    return (
        hints.join(facts, HINT, "left")
        .select(
            *HINT,
            F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
            F.when(matched, "auto_matched").otherwise("needs_review").alias("status"),
            F.when(matched, F.col("exact_code")).alias("official_code"),
            F.when(matched, None)
            .when(F.col("n_candidates").isNull(), "no_candidate")
            .when((F.col("code_hint") != "") & (F.col("top_code") != F.col("code_hint")), "other_code_suggested")
            .otherwise("review_required")
            .alias("warning"),
            "top_code",
            "top_score",
        )
    )


def build_plan(blocks: DataFrame, groups: DataFrame, mode: str = "sequence") -> DataFrame:
    """One plan row per block; blocks without candidates are kept."""
    hints = distinct_hints(blocks)
    plans = stage(hint_plans(hints, candidates(hints, groups, mode)), "plans")
    return blocks.join(plans, HINT)


def apply_decisions(plan: DataFrame, decisions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviewed decisions on a plan: the new plan, and error rows.

    ``decisions``: ``job_id, source_id, target, not_applicable, reason, decided_at``.
    A decision that is repeated, malformed, or names an unknown source or target is
    reported and not applied, so one tenant's mistake does not stop the others.
    """
    one = decisions.groupBy(JOB, "source_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct(canonical_code("target").alias("target"), "not_applicable", "reason", "decided_at")).alias("d"),
        F.count_if(F.col("target").isNotNull() & (F.col("target") != "")).alias("_targets"),
    )
    flat = one.select(JOB, "source_id", "_n", "_targets", "d.*")
    shaped = flat.withColumn(
        "_error",
        F.when(F.col("_n") > 1, "duplicate_decision")
        .when(F.col("not_applicable") == (F.col("_targets") > 0), "decision_shape")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "reason_missing"),
    )
    known = groups.select(JOB, F.col("code").alias("target"), F.lit(True).alias("_known"))
    checked = shaped.join(known, [JOB, "target"], "left").withColumn(
        "_error",
        F.coalesce(
            "_error",
            F.when(~F.col("not_applicable") & F.col("_known").isNull(), "unknown_target"),
        ),
    )
    both = plan.withColumn("_planned", F.lit(True)).join(
        checked.select(
            JOB, "source_id", F.lit(True).alias("_decided"), "target", "not_applicable", "reason", "decided_at", "_error"
        ),
        [JOB, "source_id"],
        "full_outer",
    )
    errors = both.where(F.col("_decided") & (F.col("_planned").isNull() | F.col("_error").isNotNull())).select(
        JOB, "source_id", F.when(F.col("_planned").isNull(), "unknown_source").otherwise(F.col("_error")).alias("error")
    )
    applies = F.col("_decided").isNotNull() & F.col("_error").isNull()
    result = both.where("_planned").select(
        *[c for c in plan.columns if c not in {"status", "official_code", "warning"}],
        F.when(applies & F.col("not_applicable"), "not_applicable")
        .when(applies, "confirmed")
        .otherwise(F.col("status"))
        .alias("status"),
        F.when(applies & F.col("not_applicable"), None)
        .when(applies, F.col("target"))
        .otherwise(F.col("official_code"))
        .alias("official_code"),
        F.when(~applies, F.col("warning")).alias("warning"),
        F.when(applies, F.col("reason"))
        .when(F.col("status") == "auto_matched", "exact code and name")
        .alias("decision_reason"),
        F.when(applies, F.col("decided_at")).alias("decided_at"),
    )
    return result, errors


def normalize_decisions(raw: DataFrame) -> DataFrame:
    """Decisions from loosely named columns of a review screen."""
    columns = set(raw.columns)

    def first(*names: str) -> Column:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    flag = F.coalesce(F.col("not_applicable"), F.lit(False)) if "not_applicable" in columns else F.lit(False)
    action = F.lower(F.coalesce(first("action"), F.lit(""))) == "not_applicable"
    unwanted = flag | action
    return raw.select(
        JOB,
        first("source_id", "ergo_id").alias("source_id"),
        F.when(~unwanted, first("official_ghe_code", "official_ghe_id", "official_ghe", "target")).alias("target"),
        unwanted.alias("not_applicable"),
        F.coalesce(first("reason"), F.lit("confirmed in review")).alias("reason"),
        (F.col("decided_at") if "decided_at" in columns else F.lit(None).cast("timestamp")).alias("decided_at"),
    )


def nominal_decisions(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """Decisions by name alone for items that were not matched automatically.

    A name this close has equal keys or nearly equal word sets; the sequence part
    of the score cannot reach the floor.
    """
    open_items = plan.where("status <> 'auto_matched'")
    best = _best_names(open_items.select(JOB, "name_key"), groups, rules.NOMINAL_FLOOR, "jaccard")
    return open_items.join(best.select(JOB, "name_key", "best_code"), [JOB, "name_key"], "left").select(
        JOB, "source_id", F.col("best_code").alias("target"), F.col("best_code").isNull().alias("not_applicable"),
        F.when(F.col("best_code").isNull(), "no official name is close enough").otherwise("same name").alias("reason"),
    )


def _best_names(names: DataFrame, groups: DataFrame, floor: float, mode: str) -> DataFrame:
    """Best official group per name key at or above ``floor``, and how many share the best score."""
    pairs = near_name_pairs(
        names.select(JOB, F.col("name_key").alias("key")), groups.select(JOB, F.col("name_key").alias("key")),
        [JOB], floor, mode,
    )
    # registry rows of one name collapse to their count and their first row
    official = groups.groupBy(JOB, F.col("name_key").alias("right_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.struct("code", "ord"), "ord").alias("_first")
    )
    scored = stage(pairs.join(official, [JOB, "right_key"]), "scored")
    tops = scored.groupBy(JOB, F.col("left_key").alias("name_key")).agg(
        F.max("similarity").alias("best_score"),
        F.max_by("_first.code", F.struct(F.col("similarity"), -F.col("_first.ord"))).alias("best_code"),
    )
    ties = (
        scored.join(tops.select(JOB, F.col("name_key").alias("left_key"), "best_score"), [JOB, "left_key"])
        .where("similarity = best_score")
        .groupBy(JOB, F.col("left_key").alias("name_key"))
        .agg(F.sum("_n").alias("n_best"))
    )
    return tops.join(ties, [JOB, "name_key"]).select(JOB, "name_key", "best_score", "best_code", "n_best")


def top1_with_margin(names: DataFrame, groups: DataFrame, floor: float, mode: str = "sequence") -> DataFrame:
    """Best name that strictly beats the runner-up."""
    return _best_names(names, groups, floor, mode).where("n_best = 1").select(JOB, "name_key", "best_code", "best_score")


def associate_media(media: DataFrame, groups: DataFrame, mode: str = "sequence") -> DataFrame:
    """Official code of each media by code and name; NULL with a warning on conflict.

    ``media``: ``job_id, image_id, …`` and ``with_hints`` on its hints. Worked out per
    distinct hint, like candidates.
    """
    hints = distinct_hints(media)
    official = groups.select(JOB, F.col("code").alias("code_hint"), F.col("name_key").alias("off_key"), F.lit(True).alias("_is"))
    named = top1_with_margin(hints, groups, rules.MEDIA_NAME_FLOOR, mode).select(
        JOB, "name_key", F.col("best_code").alias("name_code")
    )
    joined = hints.join(official, [JOB, "code_hint"], "left").join(named, [JOB, "name_key"], "left")
    judged = joined.withColumn(
        "_sim", name_similarity(F.coalesce("name_key", F.lit("")), F.coalesce("off_key", F.lit("")), mode)
    )
    conflict = F.col("_is").isNotNull() & F.col("name_code").isNotNull() & (F.col("name_code") != F.col("code_hint"))
    accepted = F.col("_is").isNotNull() & (
        (F.col("name_key") == "") | (F.col("_sim") >= rules.MEDIA_CODE_NAME_FLOOR)
    )
    code = F.when(conflict, None).when(accepted, F.col("code_hint")).otherwise(F.col("name_code"))
    decided = judged.select(
        *HINT,
        code.alias("official_code"),
        F.when(conflict, "code_name_conflict")
        .when((F.col("code_hint") != "") & code.isNull(), "review_required")
        .alias("warning"),
    )
    nameless = F.col("has_name") & (F.col("name_key") == "")  # a name that says nothing backs no code
    return (
        media.join(decided, HINT)
        .withColumn("warning", F.when(nameless, F.when(F.col("code_hint") != "", "review_required")).otherwise(F.col("warning")))
        .withColumn("official_code", F.when(~nameless, F.col("official_code")))
    )


def unanimous_code(media: DataFrame, keys: list[str]) -> DataFrame:
    """Official code of a media block if all its associated media agree."""
    return media.groupBy(*keys).agg(
        F.when(F.min("official_code") == F.max("official_code"), F.max("official_code")).alias("official_code")
    )


def multi_assignment(plan: DataFrame) -> DataFrame:
    """Official codes that more than one block was assigned to."""
    return (
        plan.where("official_code is not null")
        .groupBy(JOB, "official_code")
        .agg(F.count(F.lit(1)).alias("n_blocks"))
        .where("n_blocks > 1")
    )


def plan_complete(jobs: DataFrame, plan: DataFrame) -> DataFrame:
    """``job_id, complete``; a job without items is complete."""
    done = plan.groupBy(JOB).agg(F.bool_and(F.col("status") != "needs_review").alias("complete"))
    return jobs.select(JOB).join(done, JOB, "left").select(JOB, F.coalesce("complete", F.lit(True)).alias("complete"))


def select_status(plan: DataFrame, *statuses: str) -> DataFrame:
    return plan.where(F.col("status").isin(*statuses))


def scope_mismatch(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return (
        a.join(b, keys, "full_outer")
        .where("_l is null or _r is null")
        .select(*keys, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))
    )


def unknown_targets(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """Plan items that point to a code outside the registry."""
    pointed = plan.where("official_code is not null").withColumn("_c", canonical_code("official_code"))
    known = groups.select(JOB, F.col("code").alias("_c")).distinct()
    return pointed.join(known, [JOB, "_c"], "left_anti").drop("_c")


def select_blocks(blocks: DataFrame, plan: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(Reconciled ∪ included) − omitted.

    ``exceptions``: ``job_id, source_id, action`` with include or omit. Where they have
    a column ``acknowledged``, those without it count as not given.
    """
    if "acknowledged" in exceptions.columns:
        exceptions = exceptions.where("acknowledged")
    chosen = plan.where("status <> 'not_applicable'").select(JOB, "source_id")
    included = exceptions.where("action = 'include'").select(JOB, "source_id")
    omitted = exceptions.where("action = 'omit'").select(JOB, "source_id")
    wanted = chosen.unionByName(included).distinct().join(omitted, [JOB, "source_id"], "left_anti")
    return blocks.join(wanted, [JOB, "source_id"], "left_semi")


def select_blocks_for_output(
    blocks: DataFrame, plan: DataFrame, groups: DataFrame, exceptions: DataFrame
) -> DataFrame:
    """Blocks with their ``place`` in the compiled output.

    A job with an include list gives exactly that list, in its order
    (``exceptions.ordinal``); the others give their matched blocks in official order.
    """
    listed = exceptions.where("action = 'include'").select(JOB, "source_id", F.col("ordinal").alias("place"))
    by_list = blocks.join(listed, [JOB, "source_id"])
    rest = plan.where(F.col("status").isin("auto_matched", "confirmed")).join(
        listed.select(JOB).distinct(), JOB, "left_anti"
    )
    placed = official_order(rest, groups).select(JOB, "source_id", "place")
    return by_list.unionByName(blocks.join(placed, [JOB, "source_id"]))


UNMATCHED = 1 << 40


def official_order(plan: DataFrame, groups: DataFrame) -> DataFrame:
    """Place of each item: the registry position, or behind all of it by block order.

    Unmatched items start at ``UNMATCHED``, above any registry position.
    """
    official = groups.select(JOB, F.col("code").alias("_c"), F.col("ord").alias("_o"))
    return (
        plan.withColumn("_c", F.coalesce(canonical_code("official_code"), F.lit("")))
        .join(official, [JOB, "_c"], "left")
        .withColumn("place", F.coalesce("_o", F.lit(UNMATCHED) + F.col("ord")).cast("bigint"))
        .drop("_c", "_o")
    )


def profile_ids(profile: DataFrame, blocks: DataFrame) -> DataFrame:
    """Include and omit ordinals of an exception profile as source ids."""
    listed = profile.select(
        JOB, F.explode(
            F.concat(
                F.transform("included", lambda i: F.struct(F.lit("include").alias("action"), i.alias("ordinal"))),
                F.transform("omitted", lambda i: F.struct(F.lit("omit").alias("action"), i.alias("ordinal"))),
            )
        ).alias("p")
    ).select(JOB, "p.*")
    return listed.join(blocks.select(JOB, "source_id", (F.col("ord") + 1).alias("ordinal")), [JOB, "ordinal"])


def partition_check(listed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Whether include and omit ordinals partition ``1..n`` with something included.

    ``listed``: ``job_id, action, ordinal``; ``sizes``: ``job_id, n``. Counting
    decides: n ordinals that are distinct and lie in 1..n are all of them.
    """
    facts = listed.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("_all"),
        F.min("ordinal").alias("_low"),
        F.max("ordinal").alias("_high"),
        F.count_if(F.col("action") == "include").alias("n_included"),
    )
    spread = listed.groupBy(JOB, "ordinal").agg(F.lit(1).alias("_x")).groupBy(JOB).agg(F.count("_x").alias("_distinct"))
    ok = (
        (F.col("_all") == F.col("_distinct"))
        & (F.col("_all") == F.col("n"))
        & (F.col("_low") == 1)
        & (F.col("_high") == F.col("n"))
        & (F.col("n_included") > 0)
    )
    return (
        sizes.join(facts, JOB, "left")
        .join(spread, JOB, "left")
        .select(JOB, "n", F.coalesce("n_included", F.lit(0)).alias("n_included"), F.coalesce(ok, F.lit(False)).alias("valid"))
    )
