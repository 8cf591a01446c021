"""Shards by a hierarchical weighted hash tree.

A row descends from the root over regions and racks to a shard. At each level the
children draw from the row's key, -ln(u) / weight, and the smallest draw wins; a
child therefore gets rows in proportion to its weight, and a draw changes only with
its own child's weight. Growing or shrinking a subtree moves rows into or out of
that subtree and nowhere else.

A tree of n equal shards has racks of 4 and regions of 2 racks. One more shard on
top of full regions is a region of its own, so that it takes rows only into itself.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id hashes like
an empty one; repeated rows have equal draws and share a shard, with slots of their
own; an empty table gives an empty result; other columns are not looked at and not
returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import hash_unit, running

RACK, REGION = 4, 8
#: node -> its children with their weights; leaves are "s0", "s1", ...
Tree = Mapping[str, Sequence[tuple[str, float]]]


def even_tree(shards: int) -> Tree:
    """Root, regions of up to 8 shards, racks of up to 4, shards of weight 1."""
    tree: dict[str, list[tuple[str, float]]] = {"root": []}
    for first in range(0, shards, REGION):
        region = f"region{first // REGION}"
        tree["root"].append((region, float(min(REGION, shards - first))))
        tree[region] = []
        for low in range(first, min(first + REGION, shards), RACK):
            rack, leaves = f"rack{low // RACK}", range(low, min(low + RACK, first + REGION, shards))
            tree[region].append((rack, float(len(leaves))))
            tree[rack] = [(f"s{s}", 1.0) for s in leaves]
    return tree


def depth_of(tree: Tree, node: str = "root") -> int:
    return 1 + max((depth_of(tree, c) for c, _ in tree[node]), default=0) if node in tree else 0


def descend(key: Column, tree: Tree) -> Column:
    """The shard number of a key: the best draw at each level."""
    children = F.create_map(
        *[
            x
            for node, below in tree.items()
            for x in (F.lit(node), F.array(*[F.struct(F.lit(c).alias("node"), F.lit(float(w)).alias("weight")) for c, w in below]))
        ]
    )
    node = F.lit("root")
    for _ in range(depth_of(tree)):
        drawn = F.transform(
            F.element_at(children, node),
            lambda c: F.struct((-F.ln(hash_unit(key, c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")),
        )
        node = F.array_min(drawn)["node"]
    return F.substring(node, 2, 9).cast("int")


def shards(docs: DataFrame, count: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot and the shard it would have with one more."""
    utf8 = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    id_ = F.col(key)
    placed = stage(
        docs.select(
            id_.alias("doc_id"),
            (F.octet_length(utf8) + 1).cast("bigint").alias("size"),
            F.crc32(utf8).cast("bigint").alias("text_crc32"),
            descend(id_, even_tree(count)).alias("shard"),
            descend(id_, even_tree(count + 1)).alias("grown_shard"),
            hash_unit(id_, F.lit("slot")).alias("_place"),
        ),
        "shards",
    )
    counts = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("_rows"))
    numbered = running(placed.join(counts, "shard"), "shard", "_rows", "_place", ["doc_id", "text_crc32", "size"], F.lit(1))
    return numbered.select(
        F.col("doc_id").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("_index").alias("slot"), "grown_shard"
    )
