"""Readers, decoders and writers on small files."""

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from dossiermill.operators.quality import archive_safety
from dossiermill.sinks import reports as SN
from dossiermill.sources import artifacts as A
from dossiermill.sources.chunks import chained_digest, reassemble_chunks, reassembled_blocks
from dossiermill.sources.html import html_units
from dossiermill.sources.sheets import dispatch_contracts, read_contract


def test_inventory_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.html").write_bytes(b"<html><body><SCRIPT></SCRIPT></body></html>")
    (tmp_path / "b.PNG").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    rows = {r.extension: r for r in A.artifact_inventory(A.read_binary(spark, str(tmp_path)), "ergo").collect()}
    assert rows[".html"].kind == "html_doc" and rows[".html"].active_content
    sha = hashlib.sha256((tmp_path / "b.PNG").read_bytes()).hexdigest()
    assert rows[".png"].sha256 == sha and rows[".png"].artifact_id == f"ergo-{sha[:12]}"
    assert "content" not in rows[".png"].asDict() and "path" not in rows[".png"].asDict()


def test_charset_chain(spark):
    cases = [
        ("ação €".encode("utf-8"), "ação €"),
        (b"\xef\xbb\xbfok", "ok"),
        ("ação €".encode("cp1252"), "ação €"),
        (b"caf\xe9 \x81", "caf\xe9 \x81"),
        ("<meta charset=koi8-r>мир".encode("koi8-r"), "<meta charset=koi8-r>мир"),
        ("<meta charset=nonsense>é".encode("utf-8"), "<meta charset=nonsense>é"),
        ("<meta charset='iso-8859-1'>é".encode("latin-1"), "<meta charset='iso-8859-1'>é"),
        ("<meta charset=utf-8>é".encode("cp1252"), "<meta charset=utf-8>é"),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    got = [r.t for r in df.select("i", A.decode_text("b").alias("t")).orderBy("i").collect()]
    assert got == [t for _, t in cases]


def test_html_tables_images_and_entities(spark):
    html = (
        "<html><head><title>x</title></head><body><!-- <p>no</p> --><h2>GHE 10 - A &amp; B</h2><p>Um&nbsp;dois<br>tr&#234;s"
        "<p>GHE 10 - B<ul><li>item <b>x</b></li></ul><table><tr><th>GHE 20 - C</th><td>v</td></tr><tr><td> </td></tr></table>"
        "<img src='data:image/png;base64,AA=='><script>var a='<p>z</p>'</script></body></html>"
    )
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = [(r.kind, r.text, r.structural) for r in html_units(df, "id", "html").orderBy("ord").collect()]
    assert got == [
        ("heading", "GHE 10 - A & B", True), ("text", "Um dois três", False), ("heading", "GHE 10 - B", False),
        ("text", "item x", False), ("heading", "GHE 20 - C", True), ("table", "", False), ("image", "data:image/png;base64,AA==", False),
    ]


def test_chunks(spark):
    text = base64.b64encode(b"conteudo inteiro").decode()
    rows = [("ok", 2, text[8:]), ("ok", 1, text[:4] + "\n" + text[4:8]), ("dup", 1, "AA=="), ("dup", 1, "AA=="), ("bad", 1, "A*=="), ("big", 1, "A" * 64)]
    rows += [("many", i, "AAAA") for i in range(65)]
    df = spark.createDataFrame(rows, "k string, n int, c string")
    got = {r.k: (r.status, bytes(r.content) if r.content else None) for r in reassemble_chunks(df, ["k"], "n", "c", max_part_chars=50).collect()}
    assert got == {
        "ok": ("ok", b"conteudo inteiro"), "dup": ("duplicate_part", None), "bad": ("invalid", None), "many": ("too_many_parts", None), "big": ("too_large", None),
    }


def test_data_uris_and_references(spark):
    uris = ["data:x;base64,QUJD", "data:,a%20b", "DATA:;BASE64,QUJ", "img/a.png", "data:none"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(uris)], "i int, u string")
    got = [bytes(r.d) if r.d is not None else None for r in df.select("i", A.decode_data_uri("u").alias("d")).orderBy("i").collect()]
    assert got == [b"ABC", b"a b", None, None, None]


def test_contract_versions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": 1, "mode": "m"}))
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": 2, "mode": "m"}))
    (tmp_path / "c.json").write_text("{broken")
    rows = read_contract(spark, str(tmp_path), "schema_version int, mode string", 1)
    assert sorted(r.contract_status for r in rows.collect()) == ["ok", "unreadable", "version"]


def test_package_policies_stop_at_the_first_bad_member(spark):
    schema = "artifact_id string, ord int, name string, file_size bigint, compress_size bigint, flag_bits int, external_attr bigint, is_dir boolean"
    rows = [("a", 1, "ok.xml", 300 << 20, 300 << 20, 0, 0, False), ("a", 2, "../x", 1, 1, 0, 0, False), ("a", 3, "enc", 1, 1, 1, 0, False), ("b", 1, "w/vbaProject.bin", 1, 1, 0, 0, False), ("c", 1, "d/", 0, 0, 0, 0, True)]
    df = spark.createDataFrame(rows, schema)
    lenient = {(r.artifact_id, r.code) for r in archive_safety(df, "lenient").collect()}
    assert lenient == {("a", "unsafe_archive_path"), ("a", "archive_expanded_size"), ("b", "active_or_embedded_content")}
    strict = {(r.artifact_id, r.code) for r in archive_safety(df, "strict").collect()}
    assert strict == {("a", "unsafe_path"), ("a", "encrypted_member"), ("a", "large_member"), ("a", "large_package"), ("b", "macros")}


def test_audit_lists_hold_no_private_columns():
    for columns in SN.AUDIT_COLUMNS.values():
        assert not {"path", "content", "source_rows", "person_present", "runtime_path"} & set(columns)


def test_reports_round_trip(spark, tmp_path):
    summary = spark.createDataFrame([("a", 1)], "job_id string, n int")
    issues = spark.createDataFrame([("a", "error", "x"), ("a", "warning", "y")], "job_id string, severity string, code string")
    plan = spark.createDataFrame([("a", "s", "auto_matched")], "job_id string, source_id string, status string")
    exc = spark.createDataFrame([], "job_id string, source_id string")
    SN.write_reports(SN.report_rows(summary, issues, plan, exc), str(tmp_path / "r"))
    back = SN.read_current(spark, str(tmp_path / "r"), kind="json")
    assert {(r.section, r["count"]) for r in back.groupBy("section").count().collect()} == {("summary", 1), ("errors", 1), ("warnings", 1), ("reconciliation", 1)}
    SN.write_compiled({"t": summary}, str(tmp_path / "c"))
    assert SN.read_current(spark, str(tmp_path / "c/t")).collect() == summary.collect()


def _files(path):
    return {(str(f), f.stat().st_mtime_ns) for f in path.rglob("part-*")}


def test_writers_keep_other_jobs(spark, tmp_path):
    path = str(tmp_path / "r")
    lines = lambda job, n: spark.range(n).select(F.lit(job).alias("job_id"), F.lit("errors").alias("section"), F.col("id").cast("string").alias("body"))
    schema = "job_id string, section string, body string"
    counts = lambda: {r.job_id: r["count"] for r in SN.read_current(spark, path, schema, "json").groupBy("job_id").count().collect()}
    for job, n in (("a", 3), ("b", 500), ("a", 2), ("c", 1)):
        before = _files(tmp_path)
        SN.write_reports(lines(job, n), path)
        assert before <= _files(tmp_path)  # a write touches no file that is there
    assert counts() == {"a": 2, "b": 500, "c": 1}
    SN.write_reports(lines("c", 0), path, jobs=spark.createDataFrame([("c",)], "job_id string"))
    assert counts() == {"a": 2, "b": 500}
    SN.compact(spark, path, "json", schema)
    assert counts() == {"a": 2, "b": 500} and len(list((tmp_path / "r/data").iterdir())) == 1
    SN.write_reports(lines("a", 7), path)
    assert counts() == {"a": 7, "b": 500}


def test_files_follow_bytes(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("a").alias("job_id"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
    SN.write_generation(rows, str(tmp_path / "w"), target=300_000)
    files = [f.stat().st_size for f in (tmp_path / "w/data").rglob("part-*")]
    assert 4 <= len(files) <= 16 and SN.read_current(spark, str(tmp_path / "w")).count() == 20_000


def test_staging_refuses_local_folders():
    from dossiermill.plans.staging import usable

    assert usable("file:/x/spark-warehouse", "local[8]") and usable("s3a://store/w", "yarn")
    for warehouse in ("file:/x/spark-warehouse", "/x/spark-warehouse"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            usable(warehouse, "spark://host:7077")


@pytest.mark.parametrize("block", [4, 64, 1 << 20])
def test_blocks_of_any_parts(spark, block):
    rng = random.Random(9)
    texts = {"a": b"x", "b": bytes(rng.randrange(256) for _ in range(1000)), "c": b"whole text" * 7, "d": b"", "hot": bytes(rng.randrange(256) for _ in range(3000))}
    rows = []
    for key, data in texts.items():
        code, at, no = base64.b64encode(data).decode(), 0, 0
        while at < len(code):
            size = rng.choice([1, 1, 2, 3, 5, 90])
            rows.append((key, no * 1000, " " + code[at : at + size] + "\n"))
            at, no = at + size, no + 1
    rows += [("twice", 1, "eA=="), ("twice", 1, "eA=="), ("bad", 1, "e!=="), ("short", 1, "eA="), ("early", 1, "eA==eA==")]
    df = spark.createDataFrame(rows, "k string, no int, chunk string").repartition(5)
    blocks = reassembled_blocks(df, ["k"], "no", "chunk", block)
    got = {}
    for r in sorted(blocks.where("status = 'ok'").collect(), key=lambda r: (r.k, r.block_no)):
        assert len(r.content) <= block * 3 // 4
        got.setdefault(r.k, b"")
        got[r.k] += bytes(r.content)
    assert {k: v for k, v in got.items() if k in texts} == {k: v for k, v in texts.items() if v}
    status = {r.k: r.status for r in chained_digest(blocks, ["k"]).collect()}
    assert status == {**{k: "ok" for k, v in texts.items() if v}, "twice": "duplicate_part", "bad": "invalid", "short": "invalid", "early": "invalid"}


def test_no_text_of_parts_is_laid_out(spark, monkeypatch):
    """Only lengths are put in order and stored; the parts themselves are shuffled to their place and to their block."""
    from dossiermill.plans import stretches
    from dossiermill.sources import chunks

    stored, stage = [], stretches.stage
    for module in (stretches, chunks):
        monkeypatch.setattr(module, "stage", lambda df, name: stored.append(df.columns) or stage(df, name), raising=False)
    parts = [("a", 2, "eHh4"), ("a", None, "eHl6"), ("b", 1, None), (None, 1, "eHh4"), ("c", 5, "eHh4" * 3), ("c", 5, ""), ("d", 1, " ")]
    df = spark.createDataFrame(parts, "k string, no int, chunk string")
    got = sorted((r.k, r.block_no, r.content and bytes(r.content), r.status) for r in reassembled_blocks(df, ["k"], "no", "chunk", 8).collect())
    assert got == [("a", 0, b"xyzxxx", "ok"), ("c", 0, None, "duplicate_part"), ("c", 1, None, "duplicate_part")]
    assert stored and not any("_chunk" in columns for columns in stored)


def test_contracts_by_version(spark):
    rows = [(1, '{"v": 1, "k": 5}'), (2, '{"v": 2, "key": {"k": 6}}'), (3, None), (4, '{"v": 3}'), (5, "{"), (6, '{"v": 1, "k": "x"}'), (7, "{}"), (8, "[1]"), (9, '{"v": 1}')]
    df = spark.createDataFrame(rows, "id int, body string")
    good, bad = dispatch_contracts(df, "body", {1: "v int, k bigint", 2: "v int, key struct<k: bigint>"}, "v")
    assert {r.id: (r.version, r.v1 and r.v1.k, r.v2 and r.v2.key.k) for r in good.collect()} == {1: (1, 5, None), 2: (2, None, 6), 9: (1, None, None)}
    assert {r.id: r.status for r in bad.collect()} == {3: "missing", 4: "version", 5: "unreadable", 6: "unreadable", 7: "version", 8: "unreadable"}


def test_presence(spark):
    from dossiermill.operators.quality import policy_table, presence_check

    files = spark.createDataFrame([("a", "ghe", False), ("a", "ergo", None)], "job_id string, role string, available boolean")
    jobs = spark.createDataFrame([("a", ["ghe", "ergo", "psychosocial"]), ("b", ["ghe"]), ("c", [])], "job_id string, roles array<string>")
    got = {(r.job_id, r.code, r.source_id) for r in presence_check(jobs, files, policy_table(spark)).collect()}
    assert got == {("a", "required_file_missing", "psychosocial"), ("a", "file_unavailable", "ghe"), ("b", "required_file_missing", "ghe")}


def test_comparison_is_written(spark, tmp_path):
    summary = spark.createDataFrame([("a", 1)], "job_id string, n int")
    SN.write_comparison(summary.withColumn("ratio", F.lit(0.5)), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().ratio == 0.5


def test_html_nesting_loses_nothing(spark):
    pages = {
        1: "<table><tr><td>A<table><tr><td>in</td></tr></table></td></tr><tr><td>B</td><td>C</td></tr></table>",
        2: "<li>alpha<div>beta</div> gamma<img src=i.png></li><p>&#x1F600;&apos;&check;&#128;",
        3: "<ul><li>a<ul><li>b</ul><li>c</ul><p>x<table><tr><td>q<td>r<tr><td>s</table>tail<p>end",
        4: None,
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    got = {}
    for r in html_units(df, "id", "html").orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append((r.kind, r.text, [list(x) for x in r.rows]))
    assert got == {
        1: [("table", "", [["A in"], ["in"], ["B", "C"]])],
        2: [("text", "alpha beta gamma", []), ("image", "i.png", []), ("text", "\U0001f600'✓€", [])],
        3: [("text", "a b", []), ("text", "c", []), ("text", "x", []), ("table", "", [["q", "r"], ["s"]]), ("text", "end", [])],
    }


def test_headers_are_found_in_any_row(spark):
    from dossiermill.operators.registry import detect_header

    full = ["Código GHE", "Nome GHE", "Setor", "Cargo", "Quantidade"]
    rows = [("late", "s", 1, i, ["Setor 1", "Cargo 2", "7"]) for i in range(1, 90)] + [("late", "s", 1, 90, full)]
    # the first row scores as much as the usable one and stands before it: the job has no header
    rows += [("blocked", "s", 1, 1, ["Nome GHE", "Setor", "Cargo", "QTD"]), ("blocked", "s", 1, 2, ["GHE", "Quantidade"])]
    rows += [("second", "a", 1, 1, ["nada"]), ("second", "b", 2, 5, full), ("second", "c", 3, 1, full)]
    rows += [("none", "s", 1, 1, ["Setor", "Cargo"])]
    df = spark.createDataFrame(rows, "job_id string, sheet string, sheet_ord int, row_no bigint, cells array<string>")
    got = {r.job_id: (r.sheet, r.row_no) for r in detect_header(df).collect()}
    assert got == {"late": ("s", 90), "second": ("b", 5)}
    assert "late" not in {r.job_id for r in detect_header(df, scan_rows=60).collect()}


def test_cheap_header_test_is_a_bound(spark):
    """No row that can win is lost, and rows whose words stand in different cells do not pass."""
    import itertools

    from dossiermill import rules
    from dossiermill.operators.registry import header_score, may_be_header, with_header_columns

    texts = ["", "GHE", " ghe. ", "GHE 12", "Código-GHE", "nome  GHE", "GHE 1 - grupo 1", "grupo 1", "Setor", "Função", "QTD.", "CPF", "g\0he id", "Total (pessoas)", None]
    rows = [(i, list(c)) for i, c in enumerate(itertools.combinations(texts, 5))] + [(-1, ["GHE 12", "grupo 12", "Setor 1", "Cargo 2", "3", ""])]
    df = spark.createDataFrame(rows, "row_no bigint, cells array<string>")
    scored = with_header_columns(df).withColumn("score", header_score(F.col("columns"))).withColumn("may", may_be_header(F.col("cells"))).collect()
    assert not [r for r in scored if r.score >= rules.HEADER_USABLE and not r.may]
    assert sum(r.score >= rules.HEADER_USABLE for r in scored) > 100
    assert not [r for r in scored if r.row_no == -1 and r.may]


def test_html_head_left_open(spark):
    pages = {
        1: "<html><head><title>t</title><meta charset=utf-8><body><p>text</p></body></html>",
        2: "<head><title>t</title><style>p{}</style><h1>A</h1><p>b",
        3: "<head><noscript><img src=x.png></noscript><title>t</title></head><body><p>text",
    }
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    got = [(r.id, r.kind, r.text) for r in html_units(df, "id", "html").orderBy("id", "ord").collect()]
    assert got == [(1, "text", "text"), (2, "heading", "A"), (2, "text", "b"), (3, "text", "text")]


def test_html_references_need_their_semicolon(spark):
    pages = {1: "<h1>A &amp; B&amp</h1><p>&lt;&ltx &notit; &copy2 &copy;&eacute", 2: "<p>&amp;amp &amp;lt;&#65 &#x42;<img src='a?b=1&lt=2&amp;c'>"}
    df = spark.createDataFrame(list(pages.items()), "id int, html string")
    got = [(r.id, r.kind, r.text) for r in html_units(df, "id", "html").orderBy("id", "ord").collect()]
    assert got == [(1, "heading", "A & B&amp"), (1, "text", "<&ltx &notit; &copy2 ©&eacute"), (2, "text", "&amp &lt;A B"), (2, "image", "a?b=1&lt=2&c")]


def test_long_texts_come_back_whole(spark, tmp_path):
    import hashlib

    from dossiermill.queries.sources import src_reassemble_chunks

    texts = {1: "kurz", 2: "lang é " * 300_000}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.status, r.sha256) for r in src_reassemble_chunks(spark, str(tmp_path)).collect()}
    assert got == {k: ("ok", hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()}
