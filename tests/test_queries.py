"""Every registered query on the smallest tables, against its SQL where it has one."""

import math
import os

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    if name not in CHECKS:
        assert rows or name == "none"
        return
    rel = duck.sql(CHECKS[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table(df.columns, rows) == table(rel.columns, rel.fetchall())


def test_entry(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


def test_sequence_candidates_equal_brute_force(spark):
    from difflib import SequenceMatcher

    from dossiermill.operators import reconcile as R
    from dossiermill.queries.matching import prepared

    blocks, groups = prepared(spark, SF_DIR)
    hints = [tuple(r) for r in blocks.select("job_id", "code_hint", "name_key").distinct().collect()]
    official = [(r.job_id, r.code, r.name_key) for r in groups.collect()]

    def similarity(a, b):
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        ta, tb = set(a.split()), set(b.split())
        return round(max(len(ta & tb) / len(ta | tb), 0.9 * SequenceMatcher(None, a, b).ratio()), 4)

    want = {}
    for job, code, key in hints:
        for gjob, gcode, gkey in official:
            if job != gjob:
                continue
            same, sim = bool(code) and code == gcode, similarity(key, gkey)
            score = (0.55 if same else 0.0) + (0.45 if sim == 1.0 else 0.35 * sim if sim >= 0.65 else 0.0)
            if score >= 0.3:
                want[(job, code, key, gcode)] = round(min(score, 1.0), 4)
    got = {
        (r.job_id, r.code_hint, r.name_key, r.official_code): r.score
        for r in R.candidates(R.distinct_hints(blocks), groups, "sequence").collect()
    }
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_policy_check_looks_at_every_file(spark):
    from dossiermill import rules
    from dossiermill.queries.inputs import derive

    files = derive(spark, SF_DIR, "artifacts").where("kind = 'ole_doc'").collect()
    found = QUERIES["jn_policy_check"](spark, SF_DIR).where("code = 'legacy_conversion_required'").count()
    assert found == sum(r.role in rules.UPLOAD_POLICIES for r in files) and not all(r.available for r in files)
