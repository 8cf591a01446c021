"""State composed over stretches against a walk over each job's events, with a job that has most of them in one second."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from dossiermill.operators import lifecycle as lc
from dossiermill.plans.numbering import dense, numbered

SCHEMA = "job_id bigint, ts timestamp, event_id bigint, status string, kind string, token bigint, has_decisions boolean"
START = datetime(2024, 1, 1)


def events(n=900):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        job = 1 if rng.random() < 0.9 else rng.choice([2, 3, None])
        at = START + (timedelta(seconds=5) if job == 1 and rng.random() < 0.9 else timedelta(seconds=rng.randint(0, 40_000)))
        rows.append((
            job, at, i, rng.choice(["validating", "validated", "generating", "completed", "failed", "needs_reconciliation"]),
            rng.choice(["start", "progress", "complete", "fail", "request", "open", "close", "close", None]), rng.randint(0, 1), rng.random() < 0.5,
        ))
    return rows


def by_job(rows):
    jobs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        jobs[r[0]].append(r)
    return jobs


@pytest.fixture(scope="module")
def log(spark):
    rows = events()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("rows", [3, 8192])
def test_active_downloads(log, rows):
    want = {}
    for job in by_job(log[0]).values():
        n = 0
        for e in job:
            n = max(0, n + {"open": 1, "close": -1}.get(e[4], 0))
            want[e[2]] = n
    assert {r.event_id: r.active_downloads for r in lc.active_downloads(log[1], rows).collect()} == want


@pytest.mark.parametrize("rows", [3, 8192])
def test_valid_completions(log, rows):
    want = {}
    for job in by_job(log[0]).values():
        turn, last, quiet = None, None, False
        for e in job:
            if last is not None and (e[1] - last).total_seconds() >= 300:
                quiet = True
            last = e[1]
            if e[4] == "complete":
                if turn is None or turn[4] != "start":
                    want[e[2]] = "not_generating"
                else:
                    want[e[2]] = "wrong_token" if turn[5] != e[5] else "timed_out" if quiet else "valid"
            if e[4] in ("start", "complete", "fail"):
                turn, quiet = e, False
    got = {r.event_id: r.verdict for r in lc.valid_completions(log[1], 300, rows).collect()}
    assert got == want and len(set(want.values())) == 4


@pytest.mark.parametrize("rows", [3, 8192])
def test_first_claim_and_transitions(log, rows):
    claims, answers = {}, {}
    for key, job in by_job(log[0]).items():
        epoch, status = 0, None
        for e in job:
            epoch += e[3] == "validated"
            if e[4] == "start" and epoch:
                claims.setdefault((key, epoch), []).append(e[2])
            if e[4] == "request":
                answers[e[2]] = status
            elif e[4] is not None:
                status = e[3]
    got = {(r.job_id, r.epoch): (r.event_id, r.n_refused) for r in lc.first_claim(log[1], rows).collect()}
    assert got == {k: (v[0], len(v) - 1) for k, v in claims.items()}
    assert {r.event_id: r.before for r in lc.transition_check(log[1], rows).collect()} == answers


def test_empty_log(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (lc.active_downloads, lc.valid_completions, lc.first_claim, lc.transition_check):
        assert f(none).collect() == []


def test_a_busy_job_is_spread(log):
    from dossiermill.plans.stretches import CUT, laid_out

    laid = laid_out(log[1], ["job_id"], ["ts", "event_id"], 50).rows
    sizes = Counter((r.job_id, r[CUT]) for r in laid.collect())
    assert max(sizes.values()) <= 50 and sum(k[0] == 1 for k in sizes) >= 16


def test_dense_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 500) * 2**32) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, at bigint").repartition(6)
    got = defaultdict(list)
    for r in dense(df, ["k"], ["at"], "n").collect():
        got[r.k].append((r.n, r.at))
    for k, pairs in got.items():
        assert [n for n, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [at for _, at in sorted(pairs)] == sorted(a for q, a in rows if q == k)
    assert sorted(r.n for r in numbered(df, "n").collect()) == list(range(400))
    assert numbered(df.limit(0), "n").collect() == [] and dense(df.limit(0), ["k"], ["at"], "n").collect() == []


def test_multiset_digests(spark):
    import hashlib

    from dossiermill.operators.lineage import merge_digests, multiset_digest

    rows = [(k, v) for k in ("a", "b") for v in ("x", "y", "y", "", None, "s")] + [("b", "y")]
    df = spark.createDataFrame(rows, "k string, v string").repartition(5)
    got = {r.k: (r.n, [int(r[f"lane{i}"]) for i in range(4)]) for r in multiset_digest(df, ["k"], "v").collect()}

    def brute(values):
        digests = [hashlib.sha256(b"n" if v is None else b"s" + v.encode()).hexdigest() for v in values]
        return len(digests), [sum(int(d[16 * i : 16 * i + 16], 16) for d in digests) % 2**64 for i in range(4)]

    assert got == {k: brute([v for q, v in rows if q == k]) for k in ("a", "b")} and got["a"] != got["b"]
    # one more y taken away again: b is a
    parts = multiset_digest(df, ["k"], "v").where("k = 'b'").unionByName(
        multiset_digest(spark.createDataFrame([("b", "y", -1)], "k string, v string, t int"), ["k"], "v", "t")
    )
    assert [(r.n, [int(r[f"lane{i}"]) for i in range(4)]) for r in merge_digests(parts, ["k"]).collect()] == [got["a"]]
