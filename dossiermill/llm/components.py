"""Connected components of an edge table by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import remove, stage


def _least(edges: DataFrame, name: str) -> DataFrame:
    """``u`` with ``m``, the least of itself and its neighbours; a table of its own, so a hub's join can be split."""
    return stage(edges.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m")), name)


def _path(df: DataFrame) -> str:
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def _drop(*tables: DataFrame) -> None:
    for t in tables:
        if path := _path(t):
            remove(t.sparkSession, path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "stars")
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = stage(moved.where("u <> v").distinct(), "edges")
    _drop(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them; edges run from large to small."""
    least = _least(edges, "stars")
    joined = edges.join(least, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = stage(moved.where("u <> v").distinct(), "edges")
    _drop(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge; the root is the least node of its component.

    ``edges`` has two columns of one orderable type. A round halves the depth of
    every tree at least, so the rounds grow with the logarithm of the longest path.
    """
    u, v = edges.columns
    now = stage(
        edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(now)
    while True:
        large = _large_star(now)
        small = _small_star(large)
        _drop(now, large)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
