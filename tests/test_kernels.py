"""Kernels against brute force: running values, as-of carry, near names, containment."""

import random
from difflib import SequenceMatcher

from pyspark.sql import Window
from pyspark.sql import functions as F

from dossiermill.plans import ordered as O
from dossiermill.plans.containment import containment_pairs, probes
from dossiermill.plans.near_names import near_name_pairs


def skewed(spark, n=4000):
    """One key holds most rows; positions have gaps."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 17}", i * 3 + rng.randint(0, 2), rng.choice([None, "a", "b", "c"]), rng.randint(-3, 3)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ord bigint, v string, x bigint")


def test_running_equals_plain_windows(spark):
    df = skewed(spark)
    stretch = O.stretch_of("ord", 64)
    got = O.running(
        df, ["k"], ["ord"],
        {
            "s": O.Running("sum", F.col("x")), "l": O.Running("last", F.col("v")), "p": O.Running("prev", F.col("v")),
            "m": O.Running("min", F.col("x")),
        },
        stretch,
    )
    w = Window.partitionBy("k").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "*", F.sum("x").over(w).alias("s"), F.last("v", True).over(w).alias("l"), F.last("v", True).over(before).alias("p"),
        F.min("x").over(w).alias("m"),
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    ranked = O.ordinal(df, ["k"], ["ord"], "n", stretch)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("ord")).cast("bigint"))
    assert ranked.exceptAll(want).count() == 0


def test_running_never_sorts_a_whole_key(spark):
    """The only window over a bare key runs on the stretch summary."""
    plan = O.ordinal(skewed(spark), ["k"], ["ord"], "n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_stretch" in line for line in windows)


def test_asof_last_equals_window(spark, monkeypatch):
    monkeypatch.setattr(O, "STRETCH", 32)
    monkeypatch.setattr(O.stretch_of, "__defaults__", (32,))
    df = skewed(spark).select("k", "ord", "v")
    events = df.where("v = 'a'").withColumn("at", F.col("ord"))
    got = O.asof_last(df, events.select("k", "ord", "at"), ["k"], "ord", ["at"])
    w = Window.partitionBy("k").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("at", F.last(F.when(F.col("v") == "a", F.col("ord")), True).over(w))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    ta, tb = set(a.split()), set(b.split())
    return round(max(len(ta & tb) / len(ta | tb), 0.9 * SequenceMatcher(None, a, b).ratio()), 4)


def names(rng, n):
    words = ["operacao", "operacoes", "apoio", "sala", "salas", "linha", "de", "montagem", "setor", "a", "b", "experimental"]
    out = set()
    while len(out) < n:
        base = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, max(len(base) - 1, 0))
            base = base[:i] + rng.choice(["", "x", base[i:i + 1] * 2]) + base[i + 1:]
        base = " ".join(base.split())
        if base:
            out.add(base)
    return sorted(out)


def test_near_names_equal_brute_force(spark):
    rng = random.Random(11)
    left, right = names(rng, 250), names(rng, 200)
    right += [w + "s" for w in left[:40]] + left[40:60]
    ldf = spark.createDataFrame([("j", k) for k in left], "job_id string, key string")
    rdf = spark.createDataFrame([("j", k) for k in right], "job_id string, key string")
    for floor in (0.8572, 0.82, 0.95):
        got = {(r.left_key, r.right_key): r.similarity for r in near_name_pairs(ldf, rdf, ["job_id"], floor).collect()}
        want = {(a, b): similarity(a, b) for a in left for b in set(right) if similarity(a, b) >= floor}
        assert got == want, floor


def test_near_names_never_cross_scopes(spark):
    ldf = spark.createDataFrame([("a", "sala um")], "job_id string, key string")
    rdf = spark.createDataFrame([("b", "sala um"), ("a", "sala dois")], "job_id string, key string")
    assert near_name_pairs(ldf, rdf, ["job_id"], 0.8).count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    needles = ["", "a", "ab", "sala", "operacao experimental"] + names(rng, 40)
    haystacks = names(rng, 120) + ["xxoperacao experimentalyy", "b"]
    n = spark.createDataFrame([("j", x) for x in needles], "job_id string, needle string")
    h = spark.createDataFrame([("j", x) for x in haystacks], "job_id string, haystack string")
    got = {(r.needle, r.haystack) for r in containment_pairs(n, h, ["job_id"]).collect()}
    assert got == {(a, b) for a in needles if a for b in haystacks if a in b}


def test_names_with_a_common_beginning_meet_few(spark):
    """Thousands of names that begin alike: pairs tested stay within ten times the hits."""
    rows = [("j", f"departamento regional de operacoes unidade {i * 7919 % 100003:06d}") for i in range(3000)]
    n = spark.createDataFrame(rows[:1500], "job_id string, needle string")
    h = spark.createDataFrame([("j", f"setor {t} anexo") for _, t in rows], "job_id string, haystack string")
    hits, tested = containment_pairs(n, h, ["job_id"]).count(), probes(n, h, ["job_id"]).count()
    assert hits == 1500 and tested <= 10 * hits


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit_similarity(a, b):
    if a == b:
        return 1.0
    ta, tb = set(a.split()), set(b.split())
    return max(len(ta & tb) / len(ta | tb), 0.9 * (1 - edits(a, b) / max(len(a), len(b))))


def test_near_names_by_edits_equal_brute_force(spark):
    rng = random.Random(12)
    left, right = names(rng, 120), names(rng, 100)
    right += [w + "s" for w in left[:40]] + left[40:60] + ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    left += ["a" * n for n in range(1, 40, 2)] + ["ab" * n + "a" for n in range(1, 20)] + ["x", "y z"]
    ldf = spark.createDataFrame([("j", k) for k in left], "job_id string, key string")
    rdf = spark.createDataFrame([("j", k) for k in right], "job_id string, key string")
    for floor in (0.8572, 0.75):
        got = {(r.left_key, r.right_key): r.similarity for r in near_name_pairs(ldf, rdf, ["job_id"], floor, "edit").collect()}
        want = {(a, b): s for a in left for b in set(right) if (s := edit_similarity(a, b)) >= floor - 0.00005}
        assert {p for p in want if want[p] >= floor + 0.00005} <= set(got) <= set(want)
        assert all(abs(got[p] - want[p]) <= 0.00006 for p in got)
