"""BPE, hard negatives and collocations against the library and brute force, and on awkward rows."""

import hashlib
import random
import re
from array import array
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

pytest.importorskip("dossiermill.llm")

from dossiermill.llm import bpe, collocations, hard_negatives, language_id, mixing  # noqa: E402
from dossiermill.llm.queries import llm_queries, vocabulary  # noqa: E402

from test_operators import SF_DIR, documents, needs_tables, odd  # noqa: E402, F401

FILE = "word_bpe_49k.json"


# -- 11: BPE -----------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(FILE))


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_of_awkward_rows(odd, library):  # noqa: F811
    got = Counter(tuple(r) for r in bpe.digests(odd, vocabulary(FILE)).collect())
    assert got == Counter((r["doc_id"], *wanted(library, r["text"])) for r in odd.collect())
    ids = bpe.encode(odd, vocabulary(FILE))
    rows = {(r["doc_id"], tuple(r["ids"])) for r in ids.collect()}
    assert rows == {(r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()}
    back = {(r["doc_id"], r["text"]) for r in bpe.decode(ids, vocabulary(FILE)).collect()}
    assert back == {(d, library.decode(list(i), skip_special_tokens=False)) for d, i in rows}
    assert bpe.digests(odd.limit(0), vocabulary(FILE)).collect() == []
    none = odd.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r["text"] for r in bpe.decode(none, vocabulary(FILE)).collect()} == {""}


@pytest.mark.parametrize("held", [3, bpe.HELD])
def test_bpe_of_any_text(library, held):
    rng = random.Random(11)
    with open(vocabulary(FILE), encoding="utf-8") as f:
        codec = bpe.Codec(f.read(), held)
    near = "\x00abcdeſßüÄİıΣσς'ABC 0129²½ªº_-.,;<|>\t\n\x1c\x85\xa0 　́éﬁ漢字👍‍﻿࢏\U00010eecŉǅ"
    texts = ["".join(rng.choices(near, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x17F), rng.randint(0, 0x3000), rng.randint(0x10000, 0x1FFFF)])) for _ in range(8)) for _ in range(2000)]
    texts += ["", "x" * 3000, "a<|endoftext|>b<|startoftext|>", "<|endoftext|>", "don't WE'LL"]
    for text in texts:
        ids, back = codec.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert (bpe.unpacked(ids), back) == (want, library.decode(want, skip_special_tokens=False)), repr(text)


def test_merges_by_rank_then_place():
    vocab = {s: i for i, s in enumerate(bpe.byte_symbols())}
    vocab |= {"aa": 256, "aaa": 257, "ab": 258}
    merges = bpe.Merges({"vocab": vocab, "merges": [["a", "a"], ["aa", "a"], ["a", "b"]]})
    a, b = vocab["a"], vocab["b"]
    assert merges.encode(b"aaaa") == [256, 256] and merges.encode(b"aaa") == [257]
    assert merges.encode(b"aab") == [256, b] and merges.encode(b"bab") == [b, 258] and merges.encode(b"a") == [a] and merges.encode(b"") == []


@needs_tables
def test_bpe_query(spark, library):
    rows = llm_queries()["op11_bpe"](spark, SF_DIR)
    assert [c for c, _ in rows.dtypes] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, rows.collect())) == Counter((r["doc_id"], *wanted(library, r["text"])) for r in documents(spark).collect())


# -- 12: hard negatives ------------------------------------------------------


def brute_negatives(rows, every=3, positives=5, negatives=3):
    """rows: (id, label, vector); every row is its place in the list."""
    good = [
        (k, i, g, [floor(256 * x) for x in v])
        for k, (i, g, v) in enumerate(rows)
        if g is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)
    ]
    out = []
    last = (1 << 63) - 1
    for k, i, g, v in good:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), last if j is None else j, h == g, j) for m, j, h, w in good if m != k]
        for p, _, _, pid in sorted((s for s in scored if s[2]), key=lambda s: s[:2])[:positives]:
            fit = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, pid, n, s[3], -p, -s[0]) for n, s in enumerate(sorted(fit, key=lambda s: s[:2])[:negatives], 1)]
    return Counter(out)


def vectors_of(spark, rows):
    clash = [F.lit("x").alias(c) for c in ("id", "v", "row", "shard", "tile", "query", "score", "_n")]
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").repartition(3).select("*", *clash)


@pytest.mark.parametrize(("shard", "block"), [(4096, 2048), (12, 5)])
def test_hard_negatives(spark, shard, block):
    rng = random.Random(12)
    centre = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    rows = []
    for i in range(150):
        g = rng.randrange(4)
        rows.append((i, g, [float(round(c + rng.gauss(0, 0.2), 1)) for c in centre[g]]))
    rows += [(200 + i, 1 + i % 2, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for i in range(40)]  # copies of one vector, many ties
    rows += [(3, 1, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]), (3, 1, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0])]  # repeated rows that are anchors
    rows += [(300, None, [1.0] * 6), (303, 1, None), (306, 2, [float("nan")] * 6), (309, 2, [float("inf")] + [0.0] * 5), (312, 2, [None] * 6)]
    rows += [(315, 0, [0.5]), (318, 0, []), (None, 1, [0.5, 0.25, 0.0, 0.0, -0.5, 0.75]), (None, None, None)]
    rows += [(400 + i, 1000 + i, [0.1 * (i % 7)] * 6) for i in range(30)]  # labels of one row
    rows = [(i, g, [float(__import__("numpy").float32(x)) if x is not None else None for x in v] if v is not None else None) for i, g, v in rows]
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("id") % 3 == 0, shard=shard, block=block).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows)


def test_no_negatives(spark):
    for rows in ([], [(0, 1, [1.0]), (50, 1, [1.0])], [(0, None, None)]):
        assert hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("id") % 50 == 0).collect() == []
    with pytest.raises(ArithmeticError):
        hard_negatives.hard_negatives(vectors_of(spark, [(0, 1, [1e12]), (1, 1, [1e12])]), F.col("id") % 50 == 0)


def test_large_scores_are_exact(spark):
    rows = [(0, 0, [262143.99609375]), (1, 0, [262143.0]), (2, 1, [200000.00390625]), (3, 1, [200000.0])]
    got = hard_negatives.hard_negatives(vectors_of(spark, rows), F.col("id") % 50 == 0).collect()
    assert Counter(map(tuple, got)) == brute_negatives([(i, g, [float(__import__("numpy").float32(x)) for x in v]) for i, g, v in rows], 50)


def test_boxes_are_pruned():
    import numpy as np

    rng = np.random.default_rng(5)
    near, far = rng.integers(90, 110, (512, 4)), rng.integers(-110, -90, (3584, 4))
    vectors = np.concatenate([near, far]).astype(float)
    tree = hard_negatives.Tree(np.arange(4096), np.arange(4096), np.zeros(4096, dtype=np.int64), vectors)
    met = []
    scan = tree.vectors.view()

    class Seen:
        """The vectors of the tree, with a note of the leaves that are read."""

        def __getitem__(self, rows):
            met.append(rows)
            return scan[rows]

    tree.vectors = Seen()
    whole = np.iinfo(np.int64)
    q = hard_negatives.Queries(np.full((1, 4), 100.0), np.zeros(1, dtype=np.int64), np.array([-1]), np.array([whole.min]), np.array([whole.max]), True, 5)
    who, place, score = hard_negatives.search(tree, q)
    assert score.tolist() == sorted((near.sum(axis=1) * 100).tolist())[::-1][:5]
    assert len(met) <= 10


# -- 13: collocations --------------------------------------------------------


def brute_phrases(rows, least, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 6):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    f = {p: a for p, a in f.items() if a >= least}
    out = []
    for lang in n:
        cand = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1}
        inside = {q for p, a in cand.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and (q := p[i:j]) in cand and 100 * a >= 100 * cand[q]}
        found = []
        for p, a in cand.items():
            if p in inside:
                continue
            cuts = [(floor(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i, t.decode(), -a, left, right, n[lang], -s) for i, (s, a, t, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("head", "budget", "bits"), [(collocations.HEAD, collocations.BUDGET, collocations.BITS), (3, 4, 8), (0, 1, 6)])
def test_collocations(spark, head, budget, bits):
    rng = random.Random(13)
    words = ["the", "The", "of", "a", "é", "Ünd", "x\x00y", "b", "c", "d\x1c", "rare"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "!?"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und", ""])))
    rows += [(1, "New York is big, new york is big", "en")] * 60 + [(None, None, "en"), (None, "", None), (2, "a " * 3000, "fr"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    df = df.select("*", *[F.lit("x").alias(c) for c in ("w", "a", "b", "n", "code", "codes", "word", "f", "rank", "own", "depth")])
    got = collocations.collocations(df, least=5, head=head, budget=budget, bits=bits).collect()
    want = brute_phrases([(r[2], r[1]) for r in rows], 5)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_no_collocations(spark):
    df = spark.createDataFrame([(1, "one two", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    assert collocations.collocations(df).collect() == [] and collocations.collocations(df.limit(0)).collect() == []


def test_top_phrases_and_ties(spark):
    rows = [(i, "b c. a b. é f. a c", "en") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = collocations.collocations(df, least=5, top=3).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(r[2], r[1]) for r in rows], 5, 3) and len(got) == 3


# -- 8: small languages beside large ones -------------------------------------


def test_quotas():
    assert language_id.quotas([5, 100, 100], 60) == [5, 27, 28] and language_id.quotas([1, 2], 10) == [1, 2] and language_id.quotas([], 5) == []


@pytest.mark.parametrize("large", [3, 400])
def test_a_small_language_keeps_its_words(spark, large):
    """A large language with more words than the model holds takes none of the small one's."""
    rng = random.Random(large)
    small = ["".join(rng.choices("αβγδεζηθικλμνξοπρστυφχψω", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(small, k=80)), "el") for i in range(10)]
    for i in range(large):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)]
        rows.append((1000 + i, " ".join(words * 5), "en"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language_id.learn(df, most_words=400, most_grams=400)
    assert set(small) <= set(model.words) and len(model.words) <= 460
    assert model.predict([" ".join(small)])[0][0] == "el"
    assert all(model.familiar(r[1], True) == 1.0 for r in rows[:10])


def brute_languages(rows):
    """Log-frequency vectors of all words and n-grams, words first, then ever shorter n-grams; every count kept."""
    import math

    words, grams, size = {}, {}, Counter()
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words.setdefault(w, Counter())[lang] += 1
            size[lang] += 1
    for w, by in words.items():
        for order in range(1, 6):
            m = f"_{w}_" if order > 1 else w
            for i in range(len(m) - order + 1):
                grams.setdefault(m[i : i + order], Counter()).update(by)
    langs = sorted(size)

    def vector(table, item):
        logs = [math.log((table[item][g] + 0.5) / (size[g] + 0.5 * len(table))) for g in langs]
        return [x - sum(logs) / len(logs) for x in logs]

    def predict(text):
        total = [0.0] * len(langs)
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            found = [vector(words, w)] if w in words else []
            for order in range(5, 0, -1):
                if found:
                    break
                m = f"_{w}_" if order > 1 else w
                found = [vector(grams, m[i : i + order]) for i in range(len(m) - order + 1) if m[i : i + order] in grams]
            for k in range(len(langs)):
                total[k] += sum(v[k] for v in found) / max(1, len(found))
        odds = [math.exp(x - max(total)) for x in total]
        return langs[odds.index(max(odds))], max(odds) / sum(odds)

    return predict


def test_languages_equal_brute_force(spark):
    rng = random.Random(4)
    pools = {"en": ["the", "house", "of", "wind", "run"], "de": ["der", "haus", "von", "wind", "lauf"], "fr": ["le", "maison", "de", "vent", "cours"]}
    rows = [(i, " ".join(rng.choices(pools[g], k=30)), g) for i, g in enumerate(rng.choices(list(pools), [5, 2, 1], k=60))]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    predict = brute_languages([(r[2], r[1]) for r in rows])
    texts = ["the wind", "haus winde laufen", "maisons", "zzz qq", "wind", "venta de la casa", "x", "der house vent"]
    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        want = predict(text)
        assert abs(score - want[1]) < 1e-4 and (lang == want[0] or want[1] < 0.5001), text


# -- 4: targets beside giants --------------------------------------------------


@pytest.mark.parametrize("ids", [0, 1000, 50_000, 777_777])
@pytest.mark.parametrize("giant", [60_000, 150_000])
def test_mix_comes_near_beside_a_giant(spark, ids, giant):
    """Within half a short document, where certain copies allow it: giants do not end the draw, and a document gives up to three copies."""
    small = giant + 100_000
    rows = [(ids + i, "a", 1000) for i in range(100)] + [(ids + 100, "a", giant)] + [(ids + 1000 + i, "b", 100) for i in range(small * 37 // 1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    out = mixing.mix(df, weights=(1, 1)).collect()
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert abs(taken["a"] - target["a"]) <= 500 and abs(taken["b"] - target["b"]) <= 50
