"""Scalars against plain Python definitions of the same rules."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from dossiermill.functions import similarity as S
from dossiermill.functions import text as X


def clean(value):
    return re.sub(r"[\s   ]+", " ", (value or "").replace("\x00", "")).strip()


def key(value):
    folded = unicodedata.normalize("NFKD", clean(value).casefold())
    bare = "".join(c for c in folded if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", bare).split())


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_clean_and_key_on_random_unicode(spark):
    rng = random.Random(7)
    pools = [(32, 126), (0xA0, 0x24F), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2000, 0x206F), (0x2150, 0x218F),
             (0xFB00, 0xFB06), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x13A0, 0x13FF), (9, 13), (0x1C, 0x1F), (0x660, 0x669)]
    values = []
    for _ in range(3000):
        n = rng.randint(0, 12)
        values.append("".join(chr(rng.randint(*rng.choice(pools))) for _ in range(n)))
    got = column(spark, values, X.clean_text("v").alias("c"), X.normalize_key("v").alias("k"))
    for value, (c, k) in zip(values, got):
        assert c == clean(value), repr(value)
        assert k == key(value), repr(value)


def test_every_folding_code_point(spark):
    from dossiermill.functions.folding import folding_tables

    source, _, multi = folding_tables()
    values = [f"x{ch}y" for ch in list(source)[::7] + list(multi)]
    got = column(spark, values, X.normalize_key("v").alias("k"))
    assert [k for (k,) in got] == [key(v) for v in values]


@pytest.mark.parametrize(
    "text, code, name",
    [
        ("GHE 10 - Operacao Experimental", "GHE 10", "Operacao Experimental"),
        ("ghe nº 007: Laboratorio | resumo", "GHE 07", "Laboratorio"),
        ("GHE 12345", None, None),
        ("GHE 3 – Sala", "GHE 03", "Sala"),
        ("éGHE 3", None, None),
        ("GHE 00", "GHE 00", None),
        ("GHE 1234 | - ", "GHE 1234", None),
        ("nada", None, None),
        ("GHE ٣ - árabe", "GHE 03", "árabe"),
    ],
)
def test_reference(spark, text, code, name):
    (row,) = column(spark, [text], X.parse_reference("v").alias("r"))
    assert (row[0].code, row[0].name) == (code, name)


def test_population_rules(spark):
    cases = {"5": 5, "5 pessoas": 5, "5,0": 5, "5.5": None, "1.234": None, "-3": None, "TOTAL": None, "n/a": None,
             "": None, "cerca de 12": 12, "12.000": 12, None: None}
    got = column(spark, list(cases), X.parse_population("v").alias("p"))
    assert [p for (p,) in got] == list(cases.values())


def test_group_name_drops_one_prefix(spark):
    cases = {"Analise do GHE 1 - x": "ghe 1 x", "GHE 5 - Grupo Resultados A": "resultados a", "grupo B": "b"}
    got = column(spark, list(cases), X.normalize_group_name("v").alias("n"))
    assert [n for (n,) in got] == list(cases.values())


def test_headings_and_categories(spark):
    texts = ["ANALISE TECNICA POR GHE - GHE 01 - A", "1. Intro", "texto comum.", "PLANO DE AÇÃO", "Resumo:", "CAIXA.", "12"]
    got = column(spark, texts, X.classify_heading("v").alias("c"), X.is_section_heading("v").alias("h"))
    assert got == [
        ("technical_reading", True), ("other", True), ("other", False), ("action_plan", True),
        ("other", True), ("other", False), ("other", False),
    ]


def test_column_kinds_follow_the_fixture(spark):
    headers = ["Codigo GHE", "Nome GHE", "Setores", "Cargos", "Quantidade", "Aviso", "GHE", "QTD.", "CPF", "Grupo GHE"]
    got = column(spark, headers, X.column_kind("v").alias("k"))
    assert [k for (k,) in got] == ["code", "name", "sector", "role", "population", None, "combined", "population", "person", "combined"]


def test_stable_unique_keeps_first_spelling_and_is_idempotent(spark):
    df = spark.createDataFrame([(["Ação", "ACAO", " b ", "", "B", "c"],)], "v array<string>")
    once = df.select(X.stable_unique("v").alias("v"))
    assert once.first().v == ["Ação", "b", "c"]
    assert once.select(X.stable_unique("v").alias("v")).first().v == ["Ação", "b", "c"]


def test_sequence_ratio_is_difflib(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    pairs = [("tide", "diet"), ("diet", "tide"), ("", "a")] + [
        ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 250))), "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 250))))
        for _ in range(60)
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r.r for r in df.select("i", S.sequence_ratio("a", "b").alias("r")).orderBy("i").collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_question_rows(spark):
    rows = [["3", "A postura é boa? ✅ Sim"], ["1. Item", "Talvez", "obs"], ["Pergunta", "Resposta"], ["a", "Conforme"], ["x"], ["", ""]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c array<string>")
    got = [r.q for r in df.select("i", X.question_row("c").alias("q")).orderBy("i").collect()]
    assert [tuple(q) if q else None for q in got] == [
        ("3. A postura é boa?", "Sim", ""), ("1. Item", "Talvez", "obs"), None, ("a", "Conforme", ""), None, None,
    ]


def test_geometry_boundaries(spark):
    df = spark.createDataFrame([(2.2, 1.0), (1.6, 1.0), (1400.0, 400.0), (1.0, 0.0)], "w double, h double")
    got = [tuple(r.g)[1:] for r in df.select(X.geometry_flags("w", "h").alias("g")).collect()]
    assert got == [
        (True, True, False, False), (False, True, False, False), (True, False, True, True), (False, False, False, False),
    ]


def test_marker_and_label_helpers(spark):
    (row,) = column(
        spark, ["Setor/GHE: setor / ghe GHE 1"], X.display_title("v").alias("t"),
        X.fill_markers(F.lit("{{A_X}}-{{A_Y}}"), {"{{A_X}}": "1"}).alias("m"), X.count_label(F.lit(1), "um", "uns").alias("c"),
    )
    assert row == ("GHE 1", "1-{{A_Y}}", "1 um")


def test_sequence_ratios_equal_difflib(spark):
    from difflib import SequenceMatcher

    from dossiermill.functions.similarity import name_similarity
    from dossiermill.operators.compare import shingle_similarity, text_ratio

    pairs = [("setor de apoio", "setor apoio"), ("abc", "abd"), ("", "x"), ("mesmo", "mesmo"), ("um dois tres", "tres dois um")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", name_similarity(a, b).alias("n"), text_ratio(a, b).alias("t"), shingle_similarity(a, b, 2).alias("s")).collect():
        ratio = SequenceMatcher(None, r.a, r.b).ratio()
        words, other = set(r.a.split()), set(r.b.split())
        want = 0.0 if not (r.a and r.b) else 1.0 if r.a == r.b else round(max(len(words & other) / len(words | other), 0.9 * ratio), 4)
        assert abs(r.n - want) < 1e-9 and abs(r.t - round(ratio, 5)) < 1e-9
        pairs_of = lambda t: {tuple(t.split()[i : i + 2]) for i in range(max(1, len(t.split()) - 1))} - {()}
        x, y = pairs_of(r.a), pairs_of(r.b)
        assert abs(r.s - (round(len(x & y) / len(x | y), 5) if x | y else 1.0)) < 1e-9
