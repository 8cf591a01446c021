"""What keeps sheets in proportion: values are worked out once, and only where a row needs them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from dossiermill import rules
from dossiermill.functions import text as T
from dossiermill.operators import registry as R


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_reference_cleans_its_text_once(spark):
    cells = spark.createDataFrame([("GHE 07 - Alfa",)], "c string").select(T.parse_reference("c").alias("r"))
    assert _plan(cells).count("x85") == 1  # the class of white space
    assert cells.select("r.*").first() == ("GHE 07", "Alfa")


def test_total_rows_are_not_keyed_before_the_cheap_look(spark):
    """As a plain second operand the key's parts would be shared by the projection, so worked out for every row."""
    row = spark.createDataFrame([("x", "", "", "a", "b", "1")], ", ".join(f"{k} string" for k in rules.COLUMN_KINDS))
    plan = _plan(row.select(R.is_total_row().alias("t")))
    assert len(re.findall("exists", plan)) >= 3
    assert [r["t"] for r in row.select(R.is_total_row().alias("t")).collect()] == [False]


def test_short_ways_give_what_the_full_ways_give(spark):
    cells = ["", " ", "\t", "\0", "12", "007", "0", "GHE 5", "GHE 05", "GHE 12345", "ghe 5", "GHE 5 ", "12.0", "٣", "GHE ٣", "1.5", "-4", "n/a", "TOTAL 3", "1,0", None, "a;b", " a | ;b ", " ", " x"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {
        r["i"]: r
        for r in df.select(
            "i", T.coerce_code("c").alias("code"), T.parse_population("c").alias("n"), T.shows_text("c").alias("shown"),
            (T.clean_text("c") != "").alias("clean"), T.split_values("c").alias("values"),
        ).collect()
    }
    assert all(r["shown"] == r["clean"] for r in got.values())
    by = {c: got[i] for i, c in enumerate(cells)}
    assert [by[c]["code"] for c in ("12", "007", "0", "GHE 5", "GHE 05", "GHE 12345", "ghe 5", "GHE 5 ", "12.0", "٣", "GHE ٣", "1.5", None)] == [
        "GHE 12", "GHE 07", "GHE 00", "GHE 05", "GHE 05", None, "GHE 05", "GHE 05", "GHE 12", "GHE 03", "GHE 03", None, None,
    ]
    assert [by[c]["n"] for c in ("", "12", "007", "12.0", "٣", "1.5", "-4", "n/a", "TOTAL 3", "1,0", None)] == [
        None, 12, 7, 12, 3, None, None, None, 3, 1, None,
    ]
    assert by["a;b"]["values"] == ["a", "b"] and by[" a | ;b "]["values"] == ["a", "b"] and by[""]["values"] == [] and by["12"]["values"] == ["12"]


def test_no_row_that_counts_is_left_out_by_the_cheap_test(spark):
    """Every row of a grid of cells whose full score is usable passes, combined headers and folded ones too."""
    import itertools

    options = [
        ["GHE", "x", "GHE 3 - grupo 4", "Código do GHE", "Grupo Homogêneo de Exposição", "identificação: ghe"],
        ["Nome do GHE", "", "obs"], ["Setor", "ÁREA"], ["Cargo", "1"], ["Qtd. Colaboradores", "Total - pessoas", ""], ["CPF", "Nome  colaborador", "", None],
    ]
    rows = [(i, list(c)) for i, c in enumerate(itertools.product(*options))]
    df = spark.createDataFrame(rows, "row_no int, cells array<string>")
    scored = R.with_header_columns(df).withColumn("score", R.header_score(F.col("columns"))).where(F.col("score") >= rules.HEADER_USABLE)
    lost = scored.where(~F.coalesce(R.may_be_header(F.col("cells")), F.lit(False)))
    assert scored.count() > 100 and lost.count() == 0


def test_rows_behind_a_perfect_header_are_not_scored_and_equal_rows_once(spark, monkeypatch):
    scored = []
    full = R.with_header_columns
    monkeypatch.setattr(R, "with_header_columns", lambda rows: scored.append(sorted(r["cells"] for r in rows.collect())) or full(rows))
    perfect, good = ["Código GHE", "Nome GHE", "Setor", "Cargo", "Quantidade", "CPF"], ["Código GHE", "Setor", "Cargo", "CPF"]
    body = ["GHE 1 - grupo 1", "Setor", "Cargo"]  # a score of 5, as far as a row alone tells
    rows = [(j, "s", 1, n, cells) for j in (1, 2) for n, cells in enumerate([["x"], perfect, body, body, perfect])]
    rows += [(j, "s", 1, n, cells) for j in (3, None) for n, cells in enumerate([["x"], good, ["GHE 1", "Setor 1", "Cargo 1"]])]
    rows += [(4, "s", 1, 0, ["ghe\x01codigo", "Setor", "Cargo", "CPF", "x"]), (5, "s", 1, 0, ["GHE", "c\0pf", "Setor", "Cargo", "QTD"]), (None, "s", 1, 7, perfect)]
    df = spark.createDataFrame(rows, "job_id bigint, sheet string, sheet_ord int, row_no bigint, cells array<string>")
    got = {r.job_id: (r.row_no, r.score) for r in R.detect_header(df).collect()}
    assert got == {1: (1, 7), 2: (1, 7), 3: (1, 5), None: (7, 7), 4: (0, 5), 5: (0, 7)}
    assert [len(s) for s in scored] == [3, 2] and body not in scored[0] + scored[1] and scored[1][0] == good


def test_sheets_within_a_stretch_are_filled_in_place(spark, monkeypatch):
    """The same rows as by stretches, without a stored table between, and names only where they are asked for."""
    kinds = {"code": None, "name": None, "combined": None, "sector": "s", "role": "r", "population": "1"}
    texts = [(1, 3, "GHE 1 - grupo  1"), (1, 4, ""), (1, 9000, "GHE 02"), (2, 5, None), (2, 6, "GHE 3 - alfa beta"), (2, 7, "x GHE 4 – b")]
    rows = [(j, n, *{**kinds, "combined": t}.values(), True, True) for j, n, t in texts]
    df = spark.createDataFrame(rows, "job_id bigint, row_no bigint, " + ", ".join(f"{k} string" for k in kinds) + ", person_present boolean, has_population boolean")
    whole = sorted(R.group_rows(df).collect())
    assert [r.group_code for r in whole] == ["GHE 01", "GHE 01", "GHE 02", "GHE 03", "GHE 04"]
    assert sorted(R.group_rows(df, 9000).collect()) == whole  # over a stretch: carried
    monkeypatch.setattr(R, "stage", lambda *_: 1 / 0)
    short = df.where("row_no < 9000")
    assert sorted(R.group_rows(short, R.last_row(short)).collect()) == [r for r in whole if r.row_no < 9000]
    assert "beta" not in _plan(R.group_rows(short, 7).select("group_code")) and R.last_row(df.where("false")) == 0


def test_plain_references_are_read_as_the_full_way_reads_them(spark):
    texts = ["GHE 7", "GHE 7 - grupo 3", "GHE 12345", "GHE 7 - a - b", "GHE 7 -a", "GHE 0 - x", "GHE 07 - x", "GHE 7 - x ", "GHE 7 - x  y", "GHE 7 - x\n", "ghe 7 - x", "GHE 7 - - x", None, ""]
    df = spark.createDataFrame([(t, None if t is None else "\t" + t) for t in texts], "t string, u string")  # white space ahead: the full way
    got = df.select(T.parse_reference("t").alias("a"), T.parse_reference("u").alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert tuple(got[0].a) == ("GHE 07", None) and tuple(got[1].a) == ("GHE 07", "grupo 3")


def test_totals_of_ascii_text_are_told_as_the_full_way_tells_them(spark):
    heads = ["Total", "TOTAL 3", "total geral", "Total\tgeralx", " - Total: x", "subtotal", "Subtotal 1", "totalx 1", "x total 1", "tot al 1", "\0to\0tal 5", "Total é", "Tótal 3", "", None, "total -", "\u00a0total 9"]
    rows = [(h, None, rest, "", "", last) for h in heads for rest in (None, "", "geral", " 7") for last in (None, "", "12")]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in rules.COLUMN_KINDS))
    got = df.select(R._is_total(R._all_kinds()).alias("short"), R.is_total_row().alias("full")).collect()
    assert all(r.short == r.full for r in got) and {r.full for r in got} == {True, False}


def test_rows_are_brought_together_once_from_header_to_groups(spark):
    """Join, fill and groups all go by job: one exchange for the rows and one for the headers."""
    kept = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    cells = ["Código GHE", "Nome GHE", "Setor", "Cargo", "Quantidade", "CPF"]
    body = [(1, "a", 1, 2, cells), (1, "a", 1, 3, ["1", "x", "s", "c", "4", ""]), (1, "a", 1, 4, ["", "", "s", "c", "2", ""])]
    other = [(1, "b", 2, 7, ["5", "x", "s", "c", "4", ""]), (1, "a", 0, 9, ["6", "x", "s", "c", "4", ""]), (1, "a", 1, 1, ["7", "", "", "", "", ""])]
    rows = spark.createDataFrame(body + other, "job_id bigint, sheet string, sheet_ord int, row_no bigint, cells array<string>")
    try:
        for name, value in zip(kept, ("false", "-1")):
            spark.conf.set(name, value)
        data, _ = R.split_total_rows(R.data_rows(rows, R.stage(R.detect_header(rows), "headers")))
        groups = R.group_population(R.group_rows(data, 9))
        assert groups._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = [tuple(r)[:5] for r in groups.collect()]
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert got == [(1, 3, "GHE 01", "x", 6)]
