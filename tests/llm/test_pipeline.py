"""The pipeline's stages, each against brute force over its own input."""

import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from dossiermill.llm import quality_rules  # noqa: E402
from dossiermill.llm.queries import vocabulary  # noqa: E402

from test_operators import SF_DIR, WORD, brute_measures, brute_similar, fill  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows in, rows out) of each stage, as ``run`` chains them."""
    found, docs = {}, spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        out = spark.read.parquet(path)
        found[name] = docs.collect(), out.collect()
        docs = out
    return found


def test_columns(stages):
    for name in list(stages)[:-1]:
        assert all(tuple(r.asDict()) == corpus_pipeline.COLUMNS for r in stages[name][1])


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    want = set()
    for r in before:
        n, chars, symbols, dups, repeats = brute_measures(r.text)
        lines = sum(bool(WORD.search(x)) for x in (r.text or "").split("\n"))
        capitals = sum("A" <= c <= "Z" for c in r.text or "")
        bad = n < 50 or 2 * repeats > n or 5 * symbols > n or 2 * dups > lines or 2 * (r.text or "").count("!") > n or 5 * capitals > 2 * chars
        want |= set() if bad else {r}
    assert set(after) == want and quality_rules.POLICIES[corpus_pipeline.POLICY] == tuple(quality_rules.RULES)


def test_languages(stages):
    before, after = stages["language_id"]
    assert set(after) <= set(before)
    # every text that is words in its own labelled language stays
    assert {r.doc_id for r in before} == {r.doc_id for r in after}


def test_near_duplicates(stages):
    before, after = stages["simhash_near_dedup"]
    root = list(range(len(before)))
    for i, j in sorted(brute_similar([r.text or "" for r in before])):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    classes = {r: root[i] for i, r in enumerate(before)}
    assert Counter(classes[r] for r in after) == Counter(dict.fromkeys(root, 1))


def test_mixture(stages):
    before, after = stages["source_mixing"]
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in before}
    sources = Counter()
    for r in before:
        sources[r.source] += size[r.doc_id]
    order = sorted(sources)
    target = fill(dict(sources), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = Counter()
    for r in after:
        taken[r.source] += size[r.doc_id]
    assert max(Counter(r.doc_id for r in after).values()) <= 3 and set(after) <= set(before)
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in sources)


def test_pieces(stages):
    from sentencepiece import SentencePieceProcessor

    before, after = stages["sentencepiece"]
    plain = SentencePieceProcessor(model_file=vocabulary(corpus_pipeline.TOKENIZER))
    want = Counter((r.doc_id, tuple(plain.encode(r.text or ""))) for r in before)
    assert Counter((r.doc_id, tuple(r.piece_ids)) for r in after) == want
    assert all(r.parity and r.round_trip and r.n_pieces == len(r.piece_ids) for r in after)


def test_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.n_pieces) for r in rows) == Counter((r.doc_id, r.n_pieces) for r in stages["sentencepiece"][1])


FINNISH = (
    "tämä on suomenkielinen kertomus jossa kuvataan pitkästi metsän puita sekä järven rannalla asuvia lintuja joita kukaan "
    "ei ole vielä nähnyt koska ne lentävät vain yöllä kun kuu paistaa pilvien takaa ja tuuli puhaltaa pohjoisesta"
)


def test_languages_reject_what_no_label_teaches(spark):
    """Random letters, labelled or not, and an unlearned language go, however long; labelled clean documents stay."""
    import random

    rng = random.Random(3)
    docs = corpus_pipeline.rules(spark, spark.read.parquet(f"{SF_DIR}/documents.parquet"), SF_DIR)
    columns = list(corpus_pipeline.COLUMNS)
    planted = [(-1, FINNISH, None), (-2, " ".join([FINNISH] * 30), None)]
    for i, lang in enumerate(("en", "fr", None, None)):
        text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(100 * (1 + i)))
        planted.append((-3 - i, text, lang))
    extra = spark.createDataFrame([(d, t, g, "planted", len(t)) for d, t, g in planted], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, docs.union(extra), SF_DIR).collect()}
    assert columns == docs.columns and kept == {r.doc_id for r in docs.collect()}
