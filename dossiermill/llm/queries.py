"""The registered queries of the training-data operators, with SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import stage
from . import bpe, collocations, hard_negatives, language_id, media, mixing, pieces, quality_model, quality_rules, sharding, simhash, token_counts, url_filters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_checks() -> dict[str, str]:
    return dict(CHECKS)


SQL_UNIT = "((CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT))::DOUBLE + 0.5) / 4503599627370496.0"


@query("op1_media_columns")
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index, folder = media.media_columns(table(spark, sf_dir, "documents"))
    facts = stage(media.with_facts(index, folder), "media-facts")
    payload, image = (F.lower(F.hex(c)).alias(c) for c in ("payload_sha256", "media_sha256"))
    return rows.join(facts, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", payload, "tail_crc32", F.col("length").alias("media_bytes"), image,
        "feature", "width", "height", "shard", "offset",
    )


@query("op2_quality_trees")
def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = language_id.remainder("doc_id", 3) == 1
    scored = quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


#: each round draws, in order, towards the gap that the one before it has left
_ROUNDS_SQL = " ".join(
    f"""open{k} AS (SELECT *, NOT taken AND size <= gap{f' AND gap > {mixing.TOLERANCE} * target' if k else ''} AS may FROM round{k}),
    head{k} AS (SELECT *, may AND coalesce(sum(CASE WHEN may THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY layer, place, doc_id, size, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) <= gap AS fits FROM open{k}),
    round{k + 1} AS (SELECT id, source, doc_id, size, place, target, layer, taken OR fits AS taken,
        gap - coalesce(sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source), 0) AS gap FROM head{k}),"""
    for k in range(mixing.ROUNDS)
)


@query(
    "op4_mix_sources",
    f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
    propensity AS (SELECT *, 4 + length(CAST(size AS VARCHAR)) AS p FROM sized),
    sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(p * size) AS BIGINT) AS p_size FROM propensity GROUP BY source),
    weighed AS (
        SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w FROM sources),
    -- the filling level: the smallest total share at which the capped and the open sources add up
    levels AS (
        SELECT a.source, a.source_size, a.p_size, a.w, 3.0 * a.source_size / a.w AS own,
            (SELECT sum(source_size) FROM weighed) AS total FROM weighed a),
    at_level AS (
        SELECT b.own, sum(CASE WHEN a.own <= b.own THEN 3 * a.source_size ELSE 0 END) AS capped,
            sum(CASE WHEN a.own <= b.own THEN 0 ELSE a.w END) AS open_w, min(a.total) AS total
        FROM levels a, (SELECT DISTINCT own FROM levels UNION ALL SELECT -1.0) b GROUP BY b.own),
    filled AS (
        SELECT capped, open_w, total, own FROM at_level WHERE open_w > 0
            AND (total - capped) / open_w >= own AND (total - capped) / open_w <=
            coalesce((SELECT min(l.own) FROM levels l WHERE l.own > at_level.own), 1e300) ORDER BY own LIMIT 1),
    targets AS (
        SELECT l.*, CASE WHEN l.own <= f.own THEN (3 * l.source_size)::DOUBLE
            ELSE (l.w * (f.total - f.capped))::DOUBLE / f.open_w::DOUBLE END AS target FROM levels l, filled f),
    expected AS (
        SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
            CASE WHEN t.p_size > 0 THEN t.target * d.p / t.p_size ELSE 0.0 END AS e,
            CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
            {SQL_UNIT.format("coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'")} AS u
        FROM propensity d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    drawn AS (
        SELECT *, least(3, floor(e))::BIGINT AS sure, greatest(0.01, least(0.99, ratio - floor(ratio))) AS mean FROM expected),
    incl AS (SELECT *, row_number() OVER () AS id, CASE WHEN sure < 3 THEN e - sure ELSE 0.0 END AS pi FROM drawn),
    placed AS (
        SELECT *, CASE WHEN pi > 0 THEN ((u / (1 - u)) * (mean / (1 - mean))) / ((u / (1 - u)) * (mean / (1 - mean)) + pi / (1 - pi)) ELSE 1.0 END AS place,
            greatest(0.0, target - sum(sure * size) OVER (PARTITION BY source)) AS rest FROM incl),
    round0 AS (SELECT id, source, doc_id, size, place, target, rest AS gap, false AS taken, unnest(range(1, 4 - sure)) AS layer FROM placed WHERE size > 0),
    {_ROUNDS_SQL}
    closing AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT taken AND abs(size - gap) < gap THEN abs(size - gap) ELSE 1e300 END, layer, place, doc_id, id) AS nearest
        FROM round{mixing.ROUNDS}),
    extra AS (SELECT id, count(*) AS n FROM closing WHERE taken OR (nearest = 1 AND abs(size - gap) < gap) GROUP BY id)
    SELECT doc_id, size, source_size, target, CAST(size * (sure + coalesce(n, 0)) AS BIGINT) AS taken FROM placed LEFT JOIN extra USING (id)""",
)
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized_documents(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op3_simhash_pivots")
def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


TOKEN_LIMIT = 2048


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "text")
    coded = pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep=("doc_id", "n_bytes"))
    ids_text = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", "n_bytes", F.size("piece_ids").cast("bigint").alias("n_pieces"), F.md5(ids_text).alias("ids_md5"), "parity", "round_trip"
    )


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op7_url_filters",
    """
    WITH parts AS (
        SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    urls AS (SELECT page_id, lower(raw) AS host, path FROM parts),
    rules(rule_host, rule_path, verdict) AS (
        VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    fitting AS (
        SELECT page_id, rule_host || rule_path AS rule, verdict,
            row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
        FROM urls JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND prefix(path, rule_path))
    SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM urls u LEFT JOIN fitting f ON u.page_id = f.page_id AND f.place = 1""",
)
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.remainder("doc_id", 4) == 2
    model = language_id.learn(docs.where(~held))
    return language_id.identify(docs, model, carry=(held.alias("held_out"),))


def _nodes(shards: int) -> str:
    """Parent, child and weight of each edge of the even tree, as SQL values."""
    edges = [("root", f"region{r}", min(8, shards - 8 * r)) for r in range(-(-shards // 8))]
    edges += [(f"region{k // 2}", f"rack{k}", min(4, shards - 4 * k)) for k in range(-(-shards // 4))]
    edges += [(f"rack{s // 4}", f"s{s}", 1) for s in range(shards)]
    return ", ".join(f"('{a}', '{b}', {w})" for a, b, w in edges)


def _levels(shards: int) -> str:
    """One common table per level of the descent: the child with the least draw."""
    draw = "-ln(" + SQL_UNIT.format("coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || n.node") + ") / n.weight"
    texts = [f"n{shards}(parent, node, weight) AS (VALUES {_nodes(shards)})", f"l{shards}_0 AS (SELECT doc_id, 'root' AS node FROM documents)"]
    for k in range(3):
        texts.append(
            f"l{shards}_{k + 1} AS (SELECT d.doc_id, arg_min(n.node, {draw}) AS node FROM l{shards}_{k} d JOIN n{shards} n ON n.parent = d.node GROUP BY d.doc_id)"
        )
    return ", ".join(texts)


@query(
    "op9_shard_tree",
    f"""
    WITH RECURSIVE steps AS (
        SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
    bytes AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(list_filter(
            string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda h: h <> ''), lambda h: CAST('0x' || h AS BIGINT))) AS b
        FROM documents),
    sums AS (
        SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM bytes, crc_table),
    {_levels(16)}, {_levels(17)},
    placed AS (
        SELECT s.doc_id, s.size, s.crc, CAST(a.node[2:] AS INT) AS shard, CAST(b.node[2:] AS INT) AS grown_shard,
            {SQL_UNIT.format("coalesce(CAST(s.doc_id AS VARCHAR), '') || ':slot'")} AS place
        FROM sums s JOIN l16_3 a ON a.doc_id = s.doc_id JOIN l17_3 b ON b.doc_id = s.doc_id)
    SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
        row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, crc, size) - 1 AS slot, grown_shard FROM placed""",
)
def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 16)


@query(
    "op10_quality_rules",
    """
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    split_up AS (
        SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
            list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM texts),
    positions AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM split_up),
    windows AS (
        SELECT doc_id, i, w || ' ' || lead(w) OVER one || ' ' || lead(w, 2) OVER one AS three FROM positions
        WINDOW one AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (
        SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows WHERE three IS NOT NULL) WHERE n > 1),
    covered AS (
        SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    measured AS (
        SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
            CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
            length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
        FROM split_up s LEFT JOIN covered c ON s.doc_id = c.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_exclaims > 50 * n_words OR 100 * n_capitals > 40 * word_chars) AS kept
    FROM measured""",
)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.verdicts(quality_rules.ledger(table(spark, sf_dir, "documents")), "v2")
    base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask_of("v1"))) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept"
    )


@query("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(
    "op13_collocations",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    split_up AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split_up GROUP BY lang),
    grams AS (
        SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase FROM (
            SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM split_up, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
    counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    -- a longer phrase of equal count around a phrase holds one that is longer by a word and has that count too
    inside AS (
        SELECT lang, phrase, max(f) AS longer FROM (
            SELECT lang, f, unnest([array_to_string(ws[1 : k - 1], ' '), array_to_string(ws[2 : k], ' ')]) AS phrase
            FROM (SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE k > 2)) GROUP BY ALL),
    kept AS (
        SELECT c.lang, c.k, c.phrase, c.f AS a, string_split(c.phrase, ' ') AS ws FROM counted c
        LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
        WHERE c.k > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * c.f)),
    cuts AS (
        SELECT lang, phrase, a, h, array_to_string(ws[1 : h], ' ') AS one, array_to_string(ws[h + 1 : k], ' ') AS two FROM (
            SELECT *, unnest(range(1, k)) AS h FROM kept)),
    scored AS (
        SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c.h
        FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.one JOIN counted y ON y.lang = c.lang AND y.phrase = c.two
        JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) AS place FROM scored),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query(
    "op12_hard_negatives",
    """
    WITH sound AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pairs AS (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
        FROM sound a JOIN sound b ON a.id <> b.id WHERE a.id % 50 = 0),
    near AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM pairs WHERE same) WHERE place <= 5),
    found AS (
        SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
            row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
        FROM near p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
            AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.hard_negatives(vectors, F.col("id") % 50 == 0)
