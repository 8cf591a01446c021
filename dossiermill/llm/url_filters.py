"""URL filters as a sort-merge range join.

A host is written label by label from its end (``net.example.www.``), so that a rule
for a host and its subdomains is an interval of keys: all that begin with the rule's.
Rules nest like brackets. Keys of URLs and interval starts are sorted together, and
one sweep keeps the stack of rules whose interval is open: a URL's rules are on it.
Among them the path decides, and the longest rule wins (host and path together; of
equals the one with the longer host).

The sweep is split at keys taken from the sorted keys' quantiles. A rule goes to
every split that its interval meets, which for nested intervals is once plus once per
split edge inside it. URLs carry a hash behind their key, so that one host, or one
URL, with a third of the rows is cut as well. Split keys only balance the work;
results do not depend on them.

Defined cases: a null URL, or one without ``://``, has an empty host and path and no
rule; so has a URL with an empty host; rules with a null or empty host, or a null
path, fit nothing; equal rules count once, and of a blocking and an allowing one the
blocking one is taken; rows are judged one by one, so repeated rows and null ids give
a row each; empty tables give empty results, and without rules every URL gets the
default; other columns are not looked at and not returned.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

DEFAULT = "allow"
#: split keys: about this many rows, chosen by hash, are looked at for them, whatever the table's size
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The stack of open rules while keys go by in order."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, str], list[int]]] = []

    def to(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: str, path: str, verdict: str) -> None:
        self.to(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, paths, lengths = self.open[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        if len(path) not in lengths:
            lengths.append(len(path))

    def url(self, host_key: str, path: str) -> tuple[str | None, str | None, str | None]:
        """(rule's host key, rule's path, verdict) of the longest open rule that the path fits."""
        self.to(host_key)
        best: tuple[int, int] | None = None
        found: tuple[str | None, str | None, str | None] = (None, None, None)
        for key, paths, lengths in self.open:
            for n in lengths:
                if (verdict := paths.get(path[:n])) is not None and n <= len(path) and (best is None or (len(key) + n, len(key)) > best):
                    best, found = (len(key) + n, len(key)), (key, path[:n], verdict)
        return found


def _split_keys(urls: DataFrame, parts: int) -> list[str]:
    """Up to ``parts - 1`` keys that cut the URLs about evenly, from a bounded hashed sample."""
    share = int((1 << 30) * SAMPLE / max(SAMPLE, urls.count()))
    keys = sorted(r["sort"] for r in urls.where(F.pmod(F.xxhash64("sort"), F.lit(1 << 30)) < share).select("sort").collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", parts: int | None = None, default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    u = F.col(url)
    urls = pages.select(F.col(key).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"), F.xxhash64(u, F.col(key).cast("string")).alias("h"))
    urls = stage(
        urls.withColumn("key", reversed_host(F.col("host"))).withColumn(
            "sort", F.concat("key", F.lit("\x00"), "path", F.lit("\x00"), F.lpad(F.hex("h"), 16, "0"))
        ),
        "urls",
    )
    cuts = _split_keys(urls, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(cuts)

    # U+10FFFF ends an interval: no host has it
    fit = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    starts = fit.select(reversed_host(F.lower("host")).alias("key"), "path", "verdict").distinct()

    def split_number(sort: Column) -> Column:
        edges = F.array(*map(F.lit, cuts)).cast("array<string>")
        return F.size(F.filter(edges, lambda edge: edge <= sort))

    def split_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared.value
        for b in batches:
            yield b.append_column("split", pa.array([bisect_right(edges, s.as_py()) for s in b.column("sort")], pa.int32()))

    placed = urls.mapInArrow(split_of, T.StructType([*urls.schema.fields, T.StructField("split", T.IntegerType())]))
    id_type = urls.schema["id"].dataType
    events = placed.select("split", "sort", F.lit(1).alias("kind"), "key", "path", F.lit(None).cast("string").alias("verdict"), "id", "host").union(
        starts.select(
            F.explode(F.sequence(split_number(F.col("key")), split_number(F.concat("key", F.lit("\U0010ffff"))))).alias("split"), F.col("key").alias("sort"), F.lit(0).alias("kind"), "key", "path", "verdict",
            F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("string").alias("host"),
        )
    )
    schema = T.StructType(
        [T.StructField("id", id_type), *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule_key", "rule_path", "verdict"))]
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state = None, Sweep()
        for b in batches:
            rows, got = [], []
            columns = zip(*(b.column(n).to_pylist() for n in ("split", "kind", "key", "path", "verdict")), strict=True)
            for at, (now, kind, host_key, path, verdict) in enumerate(columns):
                if now != split:
                    split, state = now, Sweep()
                if kind:
                    rows.append(at)
                    got.append(state.url(host_key, path))
                else:
                    state.rule(host_key, path, verdict)
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column("id"), taken.column("host"), taken.column("path"), *(pa.array([g[i] for g in got], pa.string()) for i in range(3))],
                names=schema.names,
            )

    swept = events.repartition("split").sortWithinPartitions("split", "sort", "kind").mapInArrow(sweep, schema)
    plain_host = F.array_join(F.reverse(F.split(F.regexp_replace("rule_key", r"\.$", ""), r"\.")), ".")
    return swept.select(
        F.col("id").alias(key), "host", "path", F.concat(plain_host, "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
