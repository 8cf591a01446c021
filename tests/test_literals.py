"""Replacing many literals at once, against a fold of ``replace`` and brute force."""

import random

import pytest

from dossiermill.operators.lineage import literals_left, redact_dictionary
from dossiermill.plans import literals as L

ALPHABET = "abc é😀"
SCHEMA = "literal string, replacement string, ord int"


def brute(text, rules, rule):
    """(text, hits) by the rule's own words; ``rules`` in order."""
    if rule == "listed":
        n = 0
        for a, b in rules:
            n += text.count(a)
            text = text.replace(a, b)
        return text, n
    out, at, n = "", 0, 0
    while at < len(text):
        best = max((a for a, _ in rules if text.startswith(a, at)), key=len, default=None)
        out += dict(rules)[best] if best else text[at]
        at += len(best) if best else 1
        n += best is not None
    return out, n


def sample(seed, n):
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, most)))
    rules = [(w, f"<{k}>") for k, w in enumerate(dict.fromkeys(word(12) for _ in range(n)))]
    return rules, [word(200) for _ in range(40)] + ["", "a" * 5000]


@pytest.mark.parametrize("rule", L.RULES)
@pytest.mark.parametrize("most", [L.MOST_CHARACTERS, 0])
def test_equals_brute_force(spark, rule, most):
    rules, texts = sample(most + len(rule), 60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    listed = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(rules)], SCHEMA)
    got = {r["id"]: (r["text"], r["n_replaced"]) for r in L.replace_all(df, "text", listed, rule, most_characters=most).collect()}
    assert got == {i: brute(t, rules, rule) for i, t in enumerate(texts)}


def test_fifty_thousand_literals(spark):
    rng = random.Random(7)
    names = list(dict.fromkeys("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(50_000)))
    # names stand apart, so none overlaps another
    texts = [" ".join(rng.choice(names) if rng.random() < 0.5 else "zzzz" for _ in range(200)) for _ in range(20)]
    listed = spark.createDataFrame([(a, f"[{k}]", k) for k, a in enumerate(names)], SCHEMA)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    new = {a: f"[{k}]" for k, a in enumerate(names)}
    want = {i: " ".join(new.get(w, w) for w in t.split(" ")) for i, t in enumerate(texts)}
    for rule in L.RULES:
        assert {r["id"]: r["text"] for r in L.replace_all(df, "text", listed, rule).collect()} == want


@pytest.mark.parametrize("most", [L.MOST_CHARACTERS, 0])
def test_odd_rows(spark, most):
    listed = spark.createDataFrame([("ab", "1", 2), ("ab", "2", 1), (None, "3", 0), ("", "4", 0), ("{{FIELD_X}}", "5", 0), ("c", None, 3)], SCHEMA)
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, "xabc{{FIELD_X}}"), (3, "xabc{{FIELD_X}}"), (None, "no")], "id int, text string")
    got = L.replace_all(df, "text", listed, "longest", r"\{\{FIELD_[A-Z0-9_]+\}\}", most).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(id={i!r}, text={t!r}, n_replaced={n})"
        for i, t, n in [(1, None, 0), (1, None, 0), (2, "", 0), (3, "x2{{FIELD_X}}", 2), (3, "x2{{FIELD_X}}", 2), (None, "no", 0)]
    )
    assert L.replace_all(df.limit(0), "text", listed, most_characters=most).collect() == []
    unchanged = L.replace_all(df, "text", listed.limit(0), most_characters=most)
    assert sorted(map(str, unchanged.select("id", "text").collect())) == sorted(map(str, df.collect()))


def test_rule_is_known(spark):
    with pytest.raises(ValueError):
        L.replace_all(spark.createDataFrame([("a",)], "text string"), "text", spark.createDataFrame([], SCHEMA), "shortest")


def test_nothing_is_left(spark):
    listed = spark.createDataFrame([("Ana", "{{FIELD_A}}", 0), ("Ana Lima", "{{FIELD_B}}", 1)], SCHEMA)
    df = spark.createDataFrame([(1, "Ana Lima e Ana"), (2, "ninguém")], "id int, text string")
    out = redact_dictionary(df, "text", listed, "FIELD")
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["text"] == "{{FIELD_B}} e {{FIELD_A}}" and rows[1]["removed_sha256"] and rows[2]["removed_sha256"] is None
    assert literals_left(out, ["id"], "text", listed, "FIELD").collect() == []
    assert [tuple(r) for r in literals_left(df, ["id"], "text", listed, "FIELD").collect()] == [(1, 2)]


def test_workers_are_handed_and_hand_on_few_bytes(spark, monkeypatch):
    """Long texts come in batches bounded by their bytes, and results leave in pieces: every row has its own."""
    monkeypatch.setattr(L, "RESULT_CHARACTERS", 50)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = {i: None if i % 7 == 0 else "ab " * i for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "i int, t string").coalesce(1)
    literals = spark.createDataFrame([("ab", "x", 0)], SCHEMA)
    got = {r.i: (r.t, r.n_replaced) for r in L.replace_all(df, "t", literals).collect()}
    assert got == {i: (t, 0) if t is None else ("x " * i, i) for i, t in texts.items()}
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
