"""Media occurrences: context, roles, geometry and picks.

Units: ``job_id, ord, kind, text`` where a media unit (``kind = 'image'``) carries
its own alternative text in ``text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import geometry_flags, is_contextual, media_role, parse_reference
from ..plans.ordered import Running, ordinal, running

JOB = "job_id"


def nearest_context(units: DataFrame, keys: list[str] = [JOB]) -> DataFrame:
    """Context, caption and code hint of each media from the texts around it.

    Contextual texts are numbered; a media then looks up at most four numbers
    before it and two after it, by equi-joins on (document, number). Reading
    backwards stops once a code and two texts are known: that point is the place
    of the later of the two, so texts before it are left out.
    """
    ref = parse_reference("text")
    is_image = F.col("kind") == "image"
    own = F.col("text").isNotNull() & (F.col("text") != "")
    flagged = (
        units.select(*keys, "ord", "kind", "text")
        .withColumn("_ref", ref)
        .withColumn("_ctx", ~is_image & is_contextual("text"))
    )
    numbered = running(
        flagged,
        keys,
        ["ord"],
        {
            "_n": Running("sum", F.col("_ctx").cast("bigint")),
            "_coded": Running(
                "last",
                F.when(
                    ~is_image & F.col("_ref.code").isNotNull(),
                    F.struct(F.col("ord").alias("at"), F.col("_ref.code").alias("code"), F.col("_ref.name").alias("name")),
                ),
            ),
        },
    )
    texts = numbered.where("_ctx").select(
        *keys, F.col("_n").alias("_no"), F.col("ord").alias("_at"), F.col("text").alias("_text")
    )
    own_code = F.when(own, F.col("_ref.code"))
    images = numbered.where(is_image).select(
        *keys,
        "ord",
        F.when(own, F.col("text")).alias("own_text"),
        F.coalesce(own & is_contextual("text"), F.lit(False)).alias("_own_ctx"),
        F.coalesce(own_code, F.col("_coded.code")).alias("code_hint"),
        F.when(own_code.isNotNull(), F.col("_ref.name")).otherwise(F.col("_coded.name")).alias("name_hint"),
        F.when(own_code.isNull(), F.col("_coded.at")).alias("_code_at"),
        own_code.isNotNull().alias("_own_code"),
        F.col("_n").alias("_before"),
    )
    steps = [*range(-rules.CONTEXT_BEFORE + 1, 1), *range(1, rules.CONTEXT_AFTER + 1)]
    probes = images.select("*", F.explode(F.array(*[F.lit(i) for i in steps])).alias("_step")).withColumn(
        "_no", F.col("_before") + F.col("_step")
    )
    found = probes.join(texts, [*keys, "_no"], "left")
    def at_step(step: int, column: str) -> Column:
        return F.max(F.when(F.col("_step") == step, F.col(column)))

    wide = found.groupBy(
        *keys, "ord", "own_text", "_own_ctx", "code_hint", "name_hint", "_code_at", "_own_code", "_before"
    ).agg(*[at_step(s, c).alias(f"{c}{s}".replace("-", "m")) for s in steps for c in ("_text", "_at")])

    def col_of(step: int, what: str) -> Column:
        return F.col(f"{what}{step}".replace("-", "m"))

    # how many earlier texts are needed to have two, the own text counting as one
    needed = rules.CONTEXT_BEFORE_ENOUGH - F.when(F.col("_own_ctx"), 1).otherwise(0)
    enough_at = F.when(needed <= 1, col_of(0, "_at")).otherwise(col_of(-1, "_at"))
    stop_at = F.when(F.col("code_hint").isNull() | enough_at.isNull(), F.lit(None)).when(
        F.col("_own_code"), enough_at
    ).otherwise(F.least(enough_at, F.col("_code_at")))
    room = rules.CONTEXT_BEFORE - F.when(F.col("_own_ctx"), 1).otherwise(0)
    kept = [
        F.when(
            (F.lit(-s) < room) & (stop_at.isNull() | (col_of(s, "_at") >= stop_at)), col_of(s, "_text")
        )
        for s in range(-rules.CONTEXT_BEFORE + 1, 1)
    ]
    after = [col_of(s, "_text") for s in range(1, rules.CONTEXT_AFTER + 1)]
    own_last = F.when(F.col("_own_ctx"), F.col("own_text"))
    context = F.concat_ws(" | ", *kept, own_last, *after)
    nearest_before = F.coalesce(own_last, *reversed(kept))
    return wide.select(
        *keys,
        "ord",
        context.alias("context"),
        F.coalesce(F.col("own_text"), after[0], nearest_before).alias("caption"),
        "code_hint",
        "name_hint",
        media_role(context, F.col("code_hint")).alias("role"),
    )


def geometry(media: DataFrame) -> DataFrame:
    """Add the shape flags of each media's size."""
    return media.withColumn("_g", geometry_flags("width", "height")).select(*media.columns, "_g.*")


def segment_by_geometry(media: DataFrame, groups: DataFrame, blocks_known: DataFrame | None = None):
    """Text-less reports: dashboards open segments, in visual order.

    Segment 1 is the general one, segment k belongs to the (k-1)-th official group.
    Only jobs with two media, two dashboards and at most one known block are
    treated; media before the first dashboard and surplus segments are left out.
    Returns the media with ``segment_no, code, role`` and one warning row per job
    with surplus segments.
    """
    shaped = geometry(media)
    facts = shaped.groupBy(JOB).agg(
        F.count(F.lit(1)).alias("_media"), F.count_if("dashboard").alias("_dashboards")
    )
    if blocks_known is not None:
        facts = facts.join(blocks_known, JOB, "left").where(F.coalesce("n_blocks", F.lit(0)) <= 1)
    treated = facts.where("_media >= 2 and _dashboards >= 2").select(JOB, "_dashboards")
    numbered = running(
        shaped.join(treated.select(JOB), JOB, "left_semi"),
        [JOB],
        ["ord"],
        {"segment_no": Running("sum", F.col("dashboard").cast("bigint"))},
    ).where("segment_no >= 1")
    ranked = ordinal(groups.select(JOB, "code", "ord"), [JOB], ["ord"], "_rank")
    owners = ranked.select(JOB, (F.col("_rank") + 1).alias("segment_no"), "code")
    owned = numbered.join(owners, [JOB, "segment_no"], "left").where("segment_no = 1 or code is not null")
    placed = role_by_position(owned)
    last = owners.groupBy(JOB).agg(F.max("segment_no").alias("_last"))
    surplus = (
        treated.join(last, JOB, "left")
        .where(F.col("_dashboards") > F.coalesce("_last", F.lit(1)))
        .select(JOB, F.lit("segment_without_group").alias("warning"))
    )
    return placed, surplus


def role_by_position(media: DataFrame) -> DataFrame:
    """Role of each media by its place in its segment."""
    placed = ordinal(media, [JOB, "segment_no"], ["ord"], "_place")
    role = (
        F.when(F.col("_place") == 1, F.when(F.col("segment_no") == 1, "general_panel").otherwise("ghe_panel"))
        .when(F.col("_place") == 2, "chart")
        .when(F.col("_place") == 3, "domain_summary")
        .when(F.col("_place").isin(4, 5) & F.col("matrix"), "risk_matrix")
        .otherwise("other")
    )
    return placed.withColumn("role", role).withColumn("place", F.col("_place") - 1).drop("_place")


def default_first_role(media: DataFrame) -> DataFrame:
    """The first media of a block takes the panel role if it has none."""
    block = F.coalesce(F.col("code_hint"), F.lit(""))
    firsts = media.groupBy(JOB, block.alias("_b")).agg(F.min("ord").alias("ord")).select(JOB, "ord", F.lit(True).alias("_first"))
    role = F.when(
        F.col("_first") & (F.col("role") == "other"), F.when(block == "", "general_panel").otherwise("ghe_panel")
    ).otherwise(F.col("role"))
    return media.join(firsts, [JOB, "ord"], "left").withColumn("role", role).drop("_first")


def pick_media(media: DataFrame, keys: list[str]) -> DataFrame:
    """Panel, chart and matrix of each block: by role, else by shape.

    Two passes, because the chart must not be the panel again: the panel's place
    is joined back by position, not by block.
    """
    shaped = geometry(media)

    def first(condition: Column, of: str = "image_id") -> Column:
        return F.min_by(F.col(of), F.when(condition, F.col("ord")))

    panel_role = F.col("role").isin("ghe_panel", "general_panel")
    panels = shaped.groupBy(*keys).agg(
        F.coalesce(first(panel_role), first(F.col("panel"))).alias("panel_id"),
        F.coalesce(first(panel_role, "ord"), first(F.col("panel"), "ord")).alias("_panel_at"),
        first(F.col("role").isin("chart", "radar")).alias("_chart"),
        F.coalesce(
            first(F.col("role") == "risk_matrix"),
            F.max_by(F.col("image_id"), F.when(F.col("matrix"), F.col("ord"))),
        ).alias("matrix_id"),
    )
    taken = panels.where("_panel_at is not null").select(*keys, F.col("_panel_at").alias("ord"), F.lit(True).alias("_taken"))
    others = (
        shaped.where("chart")
        .join(taken, [*keys, "ord"], "left_anti")
        .groupBy(*keys)
        .agg(F.min_by("image_id", "ord").alias("_shaped"))
    )
    return panels.join(others, keys, "left").select(
        *keys, "panel_id", F.coalesce("_chart", "_shaped").alias("chart_id"), "matrix_id"
    )


def pick_global_matrix(media: DataFrame) -> DataFrame:
    """Matrix of the general block: by role from the front, else by shape from the end."""
    shaped = geometry(media)
    return shaped.groupBy(JOB).agg(
        F.coalesce(
            F.min_by(F.col("image_id"), F.when(F.col("role") == "risk_matrix", F.col("ord"))),
            F.max_by(F.col("image_id"), F.when(F.col("matrix"), F.col("ord"))),
        ).alias("matrix_id")
    )


def media_coverage(media: DataFrame) -> DataFrame:
    """Official codes that have media."""
    from ..functions.text import canonical_code

    return media.where("official_code is not null").select(JOB, canonical_code("official_code").alias("code")).distinct()
