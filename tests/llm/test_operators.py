"""The training-data operators against brute force, and on awkward rows."""

import hashlib
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("dossiermill.llm")

from dossiermill.llm import (  # noqa: E402
    language_id,
    media,
    mixing,
    pieces,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    token_counts,
    url_filters,
)
from dossiermill.llm.components import components  # noqa: E402
from dossiermill.llm.queries import llm_queries, vocabulary  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names the operators use inside."""
    long_text = " ".join(f"word{i % 4001}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, None, None, None),
        (3, "", "en", ""),
        (None, "le renard brun saute par dessus le chien", "fr", "b"),
        (None, None, "fr", None),
        (4, long_text, "en", "a"),
        (5, "\n\n \t", "de", "b"),
        (6, "12345 !!! ###", "en", "a"),
        (7, "日本語 🙂 ÀÉÎ ΣΑΣ Σ", None, "c"),
        (8, "<|endoftext|>It's 42<|startoftext|> <|endoftext|>", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = ["size", "copies", "row", "own", "fp", "h", "split", "kind", "n_words", "_m", "_key", "_stretch", "score", "digest", "payload", "token", "x", "_text"]
    return df.select("*", *[F.lit("clash").alias(c) for c in extra]).cache()


def documents(spark, name="documents"):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def column(df, *names):
    return [tuple(r) if len(names) > 1 else r[0] for r in df.select(*names).collect()]


# -- awkward rows ------------------------------------------------------------

OPERATORS = {
    "media": lambda d: media.media_columns(d)[0],
    "media_headers": lambda d: media.media_columns(d)[1],
    "statistics": quality_model.document_statistics,
    "simhash": simhash.near_duplicates,
    "keep_one": simhash.keep_one,
    "mix": lambda d: mixing.mix(mixing.sized_documents(d)),
    "mix_repeat": mixing.repeat,
    "tokens": lambda d: token_counts.token_counts(d, vocabulary("word_bpe_49k.json")),
    "pieces": lambda d: pieces.encode(d, vocabulary("piece_bpe_32k.model")),
    "language": lambda d: language_id.identify(d, language_id.learn(d)),
    "keep_known": language_id.keep_known,
    "shards": sharding.shards,
    "rules": quality_rules.ledger,
    "keep_good": quality_rules.keep_good,
}
ROW_BY_ROW = {"media", "statistics", "simhash", "mix", "tokens", "pieces", "language", "shards", "rules"}
WHOLE_ROWS = {"keep_one", "mix_repeat", "keep_known", "keep_good"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(odd, name):
    out = OPERATORS[name](odd)
    rows = out.collect()
    if name in ROW_BY_ROW:
        assert len(rows) == odd.count()
    if name in WHOLE_ROWS:
        assert out.columns == odd.columns
        assert {r["doc_id"] for r in rows} <= set(column(odd, "doc_id"))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


# -- 1: media ----------------------------------------------------------------


def test_media_round_trip(spark, odd, tmp_path):
    rows, index, folder = media.media_columns(odd, folder=f"file://{tmp_path}/shards")
    placed = {r["digest"].hex(): r for r in index.collect()}
    want = [media.padded((t or "").encode()) for t in column(odd, "text")]
    assert {hashlib.sha256(p).hexdigest() for p in want} == set(placed)
    assert sorted(d.hex() for d in column(rows, "digest")) == sorted(hashlib.sha256(p).hexdigest() for p in want)
    for p in want:
        r = placed[hashlib.sha256(p).hexdigest()]
        with open(f"{tmp_path}/shards/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            image = f.read(r["length"])
        assert media.from_png(image) == p
        assert (r["width"], r["height"], r["bit_depth"]) == (media.WIDTH, len(p) // media.WIDTH, 8)
        assert struct.unpack(">I", image[16:20])[0] == media.WIDTH
    facts = {r["digest"].hex(): r for r in media.with_facts(index, folder).collect()}
    for p in want:
        r = facts[hashlib.sha256(p).hexdigest()]
        assert r["payload_sha256"] == r["digest"] and r["payload_bytes"] == len(p) and r["tail_crc32"] == zlib.crc32(p[-32:])


def test_media_shards_are_tar_files(spark, tmp_path):
    import tarfile

    df = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    _, index, _ = media.media_columns(df, folder=f"file://{tmp_path}/s")
    names = set()
    for f in os.listdir(f"{tmp_path}/s"):
        if f.endswith(".tar"):
            with tarfile.open(f"{tmp_path}/s/{f}") as t:
                names |= {m.name.removesuffix(".png") for m in t.getmembers()}
    assert names == {d.hex() for d in column(index, "digest")} and len(names) == 7


@needs_tables
def test_media_query(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    out = llm_queries()["op1_media_columns"](spark, SF_DIR).collect()
    assert len(out) == len(docs)
    for r in out:
        p = media.padded((docs[r.doc_id] or "").encode())
        image = media.to_png(p)
        assert (r.n_bytes, r.payload_bytes) == (len((docs[r.doc_id] or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


# -- 2: quality trees --------------------------------------------------------


def test_trees_learn_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 5))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    trees = quality_model.fit(x, y)
    fresh = rng.random((2000, 5))
    want = (fresh[:, 1] > 0.4) & (fresh[:, 3] < 0.7)
    assert ((trees.scores(fresh) >= 0.5) == want).mean() > 0.98


def test_trees_match_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((500, 4))
    trees = quality_model.fit(x, (x.sum(axis=1) > 2).astype(float), trees=8)
    for row in x[:50]:
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - trees.scores(row[None])[0]) < 1e-12


def test_trees_without_both_classes():
    assert quality_model.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality_model.fit(np.ones((4, 3)), np.ones(4)).scores(np.zeros((1, 3)))[0] > 0.99
    assert quality_model.fit(np.ones((4, 3)), np.zeros(4)).scores(np.zeros((1, 3)))[0] < 0.01


def test_quality_of_awkward_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (4, 0), (99, 1)], "doc_id bigint, quality int")
    out = quality_model.quality_scores(odd, labels, F.lit(False)).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len(quality_model.quality_scores(odd, labels.limit(0), F.lit(False)).where("score = 0.5").collect()) == odd.count()


def test_quality_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    out = llm_queries()["op2_quality_trees"](spark, folder)
    both = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.95


# -- 3: simhash --------------------------------------------------------------


def brute_fingerprint(text, shingle=4):
    from xxhash import xxh64

    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_classes(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprints(odd):
    got = Counter((r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(odd).collect())
    assert got == Counter((r.doc_id, brute_fingerprint(r.text)) for r in odd.select("doc_id", "text").collect())


@needs_tables
def test_simhash_query(spark):
    docs = documents(spark).orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    want = dict(zip([d.doc_id for d in docs], zip([f"{f:016x}" for f in fps], brute_classes([d.doc_id for d in docs], fps), strict=True), strict=True))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in llm_queries()["op3_simhash_pivots"](spark, SF_DIR).collect()}
    assert got == want


@pytest.mark.parametrize(("blocks", "cell"), [(5, 2048), (5, 16), (6, 64), (7, 2048)])
def test_links_lose_nothing(spark, blocks, cell):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in rng.integers(1, 7, 600)])
    fps = np.unique(np.concatenate([centres[rng.integers(0, 30, 600)] ^ flips, centres, rng.integers(0, 1 << 64, 300, dtype=np.uint64)]))
    # one crowded place: all share the first 13 bits
    fps = np.unique(np.concatenate([fps, (rng.integers(0, 1 << 51, 300, dtype=np.uint64) << np.uint64(13)) | np.uint64(5)]))
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    roots = dict(column(components(simhash.links(df, blocks=blocks, cell=cell)), "node", "root"))
    ids = fps.view(np.int64).tolist()
    want = brute_classes(ids, [int(f) for f in fps])
    assert [roots.get(i, i) for i in ids] == want


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = dict(column(components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root"))
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_keep_one_keeps_one_of_each(spark, odd):
    kept = simhash.keep_one(odd).select("doc_id", "text").collect()
    texts = [brute_fingerprint(r.text) for r in kept]
    assert len(texts) == len(set(texts))
    assert set(texts) == {brute_fingerprint(t) for t in column(odd, "text")}


# -- 4: mixing ---------------------------------------------------------------


def fill(sizes, weights, most):
    """Targets by weight, none above ``most`` sizes: capped sources drop out until none is above."""
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weights[s] / w if w else 0 for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] >= most * sizes[s]}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 5}, {"a": 1, "b": 1000, "c": 2, "d": 50, None: 9}, {"a": 0, "b": 3}, {"z": 7}])
def test_targets(spark, sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = dict(column(mixing.source_targets(df), "source", "target"))
    want = fill(sizes, weights, 3)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_mix_hits_targets_with_a_hot_source(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 12}", 1 + i * 7919 % 500) for i in range(9000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")).collect()
    assert len(out) == len(rows) and all(0 <= r.copies <= 3 for r in out)
    taken, target = Counter(), {}
    for r in out:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(2, 0.002 * target[s]) for s in target)


def test_unequal_inclusion_shows(spark):
    rows = [(i, "a" if i < 3000 else "b", 10 if i % 2 else 100_000) for i in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, source string, size bigint"), weights=(1, 3)).collect()
    share = {n: np.mean([r.copies for r in out if r.source == "a" and r["size"] == n]) for n in (10, 100_000)}
    assert share[100_000] > 1.3 * share[10] > 0


@pytest.mark.parametrize("giants, others, weight", [(1, 60_000, 9), (3, 40_000, 11)])
def test_fill_draws_behind_a_giant(spark, giants, others, weight):
    """Documents that can never fit do not end the draw: the target is met to half a short document."""
    rows = [(i, "a", 1000) for i in range(100)] + [(1000 + i, "a", 200_000 + i) for i in range(giants)] + [(5000 + i, "b", 10) for i in range(others)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    out = mixing.mix(df, weights=(1, weight), fill=True).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((d, n) for d, _, n in rows)
    for source, step in (("a", 1000), ("b", 10)):
        mine = [r for r in out if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= step / 2


# -- 5 and 6: tokens and pieces ----------------------------------------------


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_token_counts(odd, head):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tool.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.select("doc_id", "text").collect())
    got = Counter(map(tuple, token_counts.token_counts(odd, vocabulary("word_bpe_49k.json"), head=head).collect()))
    assert got == want


@needs_tables
def test_token_query(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in llm_queries()["op5_token_counts"](spark, SF_DIR).collect():
        assert r.n_tokens == len(tool.encode(docs[r.doc_id] or "", add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len((docs[r.doc_id] or "").encode())


def test_splitter_on_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        splitter = token_counts.Splitter(f.read())
    tool = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    alphabet = st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn", "Cs"])

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet, max_size=60))
    def same(text):
        found, added = splitter.pretokens(text)
        assert added + sum(map(splitter.pieces, found)) == len(tool.encode(text, add_special_tokens=False).ids)

    same()


@needs_tables
def test_pieces_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = vocabulary("piece_bpe_32k.model")
    plain = SentencePieceProcessor(model_file=model)
    coded = pieces.encode(documents(spark), model, keep=("doc_id", "text")).cache()
    for r in coded.collect():
        assert r.piece_ids == plain.encode(r.text or "") and r.parity and r.round_trip
    back = {r.doc_id: r.text for r in pieces.decode(coded, model).collect()}
    assert back == {r.doc_id: r.text or "" for r in documents(spark).collect()}
    digests = {r.doc_id: (r.n_pieces, r.ids_md5) for r in llm_queries()["op6_sentencepiece"](spark, SF_DIR).collect()}
    for r in coded.collect():
        assert digests[r.doc_id] == (len(r.piece_ids), hashlib.md5(",".join(map(str, r.piece_ids)).encode()).hexdigest())


def test_pieces_of_awkward_texts():
    from sentencepiece import SentencePieceProcessor

    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        message = f.read()
    codec, plain = pieces.Codec(message), SentencePieceProcessor(model_proto=message)
    texts = ["", " ", "a  b", "  lead", "trail  ", "\n\n x", "日本語🙂", "a▁b", "x\ny 12a\n\nb1\n", "\x7f\tq\r\nZ", "<s> hi </s>", "<unk>", "\x00\x01", "a" * 3000, "<0x41>", "▁▁ ▁"]
    assert [g[0] for g in codec.encode(texts)] == plain.encode(texts)
    assert [g[2] for g in codec.encode(texts)] == [a == b for a, b in zip(codec.decode(plain.encode(texts)), texts, strict=True)]
    whole = [e.ids for e in codec.fast.encode_batch(texts, add_special_tokens=False)]
    assert whole == plain.encode(texts)


def unigram_model():
    """A model message put together by hand: no training, fixed scores."""

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def put(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + struct.pack("<f", value)
        return varint(number << 3 | 2) + varint(len(value)) + value

    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    listed += [(p, -1.0 - 0.37 * i, 1) for i, p in enumerate(["▁the", "▁", "th", "e", "▁a", "n", "an", "▁an", "t", "a", "h", "er", "r", "▁other", "o"])]
    message = b"".join(put(1, put(1, p.encode()) + put(2, s) + put(3, k)) for p, s, k in listed)
    message += put(2, put(3, 1) + put(35, 1)) + put(3, put(1, b"identity") + put(3, 1) + put(4, 0) + put(5, 1))
    return message


def test_unigram_models():
    from sentencepiece import SentencePieceProcessor

    message = unigram_model()
    plain = SentencePieceProcessor(model_proto=message)
    tool = pieces.backend(pieces.parse(message))
    texts = ["the other", "an antenna", "ther  rathe", "", "zebra the", "é"]
    assert [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)] == plain.encode(texts)
    assert [g[0] for g in pieces.Codec(message).encode(texts)] == plain.encode(texts)


# -- 7: url filters ----------------------------------------------------------


def brute_rule(host, path, rules):
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[3:] if fit else (None, "allow")


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_urls_against_all_rules(spark, parts):
    rng = np.random.default_rng(3)
    labels = ["a", "b", "net", "org", "x-y", "a1"]
    some = lambda n: ".".join(rng.choice(labels, n))
    rules = [(some(rng.integers(1, 4)), "/" + "/".join(rng.choice(["en", "de", "e"], rng.integers(0, 3))), str(rng.choice(["block", "allow"]))) for _ in range(80)]
    rules += rules[:5] + [(None, "/", "block"), ("", "/", "block"), ("net", None, "block")]
    urls = [f"http://{some(rng.integers(1, 5))}/{'/'.join(rng.choice(['en', 'de', 'e', 'enx'], rng.integers(0, 4)))}" for _ in range(600)]
    urls += ["http://A.NET/en"] * 300 + [None, "", "no scheme", "http://", "https://org?x=/en", "http://a.b#/en", "x://y://net/en", "http://net"]
    pages = spark.createDataFrame([(i, u, "clash", 1) for i, u in enumerate(urls)], "page_id bigint, url string, key string, split int")
    out = {r.page_id: r for r in url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=parts).collect()}
    assert len(out) == len(urls)
    fitting = [r for r in rules if r[0] and r[1] is not None]
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        assert (out[i].host, out[i].path) == (host, path)
        assert (out[i].rule, out[i].verdict) == (brute_rule(host, path, fitting) if host else (None, "allow")), u


def test_no_urls_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://net/a"), (None, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
    assert url_filters.judge(pages.limit(0), rules).collect() == []
    assert [r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()] == ["allow", "allow"]


# -- 8: languages ------------------------------------------------------------


def test_languages_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    out = llm_queries()["op8_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.99


def test_language_backs_off_to_ngrams(spark):
    rows = [("en", "thing nothing something anything"), ("de", "zeitung heizung wohnung sitzung")] * 5
    model = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    got = model.predict(["plaything", "Rechnung!", "123 ...", None, "thing zeitung qqq", ""])
    assert [g[0] for g in got[:2]] == ["en", "de"] and [got[i] for i in (2, 3, 5)] == [("und", 0.0)] * 3
    assert set(language_id.grams("ab", 3)) == {"_ab", "ab_"}


# -- 9: shards ---------------------------------------------------------------


def brute_shard(doc_id, tree):
    node = "root"
    while node in tree:

        def draw(child):
            text = ("" if doc_id is None else str(doc_id)) + ":" + child[0]
            return -np.log((int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / child[1]

        node = min(tree[node], key=draw)[0]
    return int(node[1:])


@needs_tables
def test_shard_query(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    out = llm_queries()["op9_shard_tree"](spark, SF_DIR).collect()
    assert len(out) == len(docs)
    for r in out:
        data = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == brute_shard(r.doc_id, sharding.even_tree(16)) and r.grown_shard == brute_shard(r.doc_id, sharding.even_tree(17))
        assert r.grown_shard in (r.shard, 16)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_weights_move_only_into_what_grew(spark):
    keys = spark.range(4000)
    before = {"root": [("r0", 2.0), ("r1", 2.0)], "r0": [("s0", 1.0), ("s1", 1.0)], "r1": [("s2", 1.0), ("s3", 1.0)]}
    after = before | {"root": [("r0", 2.0), ("r1", 5.0)], "r1": [("s2", 1.0), ("s3", 4.0)]}
    moved = keys.select(sharding.descend(F.col("id"), before).alias("a"), sharding.descend(F.col("id"), after).alias("b")).where("a <> b").collect()
    assert moved and all(r.b in (2, 3) for r in moved) and all(r.b == 3 for r in moved if r.a in (2, 3))
    shares = Counter(column(keys.select(sharding.descend(F.col("id"), after).alias("s")), "s"))
    assert abs(shares[3] / 4000 - 5 / 7 * 4 / 5) < 0.03


def test_slots_over_many_stretches(spark):
    out = sharding.shards(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 2).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


# -- 10: rules ---------------------------------------------------------------


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures(odd):
    got = Counter(map(tuple, quality_rules.ledger(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == Counter((r.doc_id, *brute_measures(r.text)) for r in odd.select("doc_id", "text").collect())


def test_repeats_on_any_text(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(200)] + ["a a a a", "a b c x a b c", "a\nb\nc\na\nb\nc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert dict(column(quality_rules.ledger(df), "doc_id", "n_repeat_words")) == {i: brute_measures(t)[4] for i, t in enumerate(texts)}


def test_ablation(spark):
    bits = quality_rules.bit_of
    rows = [(0,), (0,), (bits("few_words"),), (bits("symbols"),), (bits("symbols") | bits("exclaims"),)]
    got = {r.rule: tuple(r)[1:4] for r in quality_rules.ablation(spark.createDataFrame(rows, "failed_bits bigint"), "v2").collect()}
    assert got["few_words"] == (1, 1, 3) and got["symbols"] == (2, 1, 3) and got["exclaims"] == (1, 0, 2) and got["capitals"] == (0, 0, 2)


@needs_tables
def test_rules_leave_clean_documents(spark):
    out = quality_rules.verdicts(quality_rules.ledger(documents(spark)), "v2").join(documents(spark, "labels"), "doc_id").collect()
    assert all(r.kept or r.n_words < 50 or r.n_repeat_words * 2 > r.n_words for r in out if r.quality == 1)
    assert not any(r.kept for r in out if r.quality == 0)


# -- near copies by shingles ---------------------------------------------------


def brute_similar(texts, words=5, least=0.8):
    """Pairs of places whose five-word shingle sets have a Jaccard of ``least`` or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})
    return {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}


@pytest.mark.parametrize("cell", [16, 2048])
def test_keep_one_finds_copies_at_its_similarity(spark, cell):
    """Near copies between 0.8 and 0.95, which differ in more bits than the fingerprints' radius, are linked; others stay."""
    rng = np.random.default_rng(7)
    texts = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        texts.append(" ".join(words))
        for changes in (2, 5, 7, 8, 9, 14):
            copy = list(words)
            for at in rng.choice(400, changes, replace=False):
                copy[at] = f"n{rng.integers(0, 1 << 40)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    own = df.select(F.col("doc_id").cast("string").alias("own"), "text")
    named = simhash._marked(own, simhash.WORDS).cache()
    at = {r.body: int(r.own) for r in named.collect()}
    got = {tuple(sorted((at[r.a], at[r.b]))) for r in simhash.similar(named, own, cell=cell).collect()}
    want = brute_similar(texts)
    assert got <= want and len(want) > 200

    def groups(pairs):
        root = list(range(len(texts)))
        for i, j in sorted(pairs):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    assert groups(got) == groups(want)
    kept = simhash.keep_one(df).collect()
    assert sorted(groups(want)[r.doc_id] for r in kept) == sorted(set(groups(want)))


def test_texts_of_one_fingerprint_meet_without_a_band(spark):
    """SimHash finds its own pairs: bands that agree nowhere keep no near copy apart."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(f"v{i}" for i in range(400))]
    own = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "own string, text string")
    marked = simhash._marked(own, simhash.WORDS).withColumn("bands", F.array(F.xxhash64("body")))
    at = {r.body: r.own for r in marked.collect()}
    assert [sorted((at[r.a], at[r.b])) for r in simhash.similar(marked, own).collect()] == [["0", "1"]]


def test_cells_return_no_more_links_than_parts():
    """Near copies of which each is alike to each: a cell gives a forest, not the pairs."""
    import pyarrow as pa

    words = [f"w{i}" for i in range(300)]
    marks = [simhash._marks(" ".join([*words[:k], "x", *words[k + 1 :]]).encode(), simhash.WORDS) for k in range(0, 300, 5)]
    grams = [simhash._shingles(" ".join([*words[:k], "x", *words[k + 1 :]]).encode(), simhash.WORDS)[1].tobytes() for k in range(0, 300, 5)]
    rows = pa.table({"side": [0] * len(marks), "label": [m[0] for m in marks], "sig": pa.array([m[2] for m in marks], pa.binary()), "grams": pa.array(grams, pa.binary())})
    assert len(simhash._joined(rows, simhash.SIMILARITY)) == len(marks) - 1
