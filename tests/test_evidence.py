"""Evidence of issues, the fields they name, and warnings of the extractions."""

from dossiermill.operators import evidence as E


def tables(spark):
    rows = {
        "jobs": ([("a", "separate"), ("b", "integrated")], "job_id string, analysis_mode string"),
        "groups": ([("a", "GHE 01"), ("a", "GHE 01"), ("b", "GHE 02")], "job_id string, code string"),
        "blocks": ([("a", "1"), ("b", "1")], "job_id string, source_id string"),
        "plan": ([("a", "2", "GHE 09"), ("b", "1", None)], "job_id string, source_id string, official_code string"),
        "sources": ([("a", "integrated"), ("a", "integrated"), ("b", "integrated")], "job_id string, source_role string"),
        "exceptions": ([("a", "7", "include", None), ("a", None, "omit", True), ("b", "1", "omit", True)], "job_id string, source_id string, action string, acknowledged boolean"),
        "warnings": ([("a", "ergo_extraction", 0, "x")], "job_id string, origin string, ord bigint, message string"),
    }
    return {k: spark.createDataFrame(r, s) for k, (r, s) in rows.items()}


RAISED = [
    ("a", "duplicate_official_ghe", None), ("a", "technical_mode_sources_invalid", None), ("a", "private_compatibility_mode", None),
    ("a", "compatibility_not_acknowledged", None), ("a", "reconciliation_target_unknown", "2"), ("a", "ergo_extraction_warning", "ergo_extraction_warning-1"),
    ("a", "legal_name_missing", None), ("a", "legal_name_missing", None), ("b", "private_compatibility_mode", None),
]


def test_evidence_belongs_to_raised_issues(spark):
    issues = spark.createDataFrame(RAISED, "job_id string, code string, source_id string")
    got = {(r.job_id, r.code, r.no): (r.name, r.value, r.n) for r in E.evidence(tables(spark), issues).collect()}
    assert got == {
        ("a", "duplicate_official_ghe", 0): ("official_code", "GHE 01", 1),
        ("a", "technical_mode_sources_invalid", 0): ("analysis_mode", "separate", 1),
        ("a", "technical_mode_sources_invalid", 1): ("source_role", "integrated", 2),
        ("a", "private_compatibility_mode", 0): ("included_source_id", "7", 1),
        ("a", "private_compatibility_mode", 1): ("omitted_source_id", None, 1),
        ("a", "compatibility_not_acknowledged", 0): ("source_id", "7", 1),
        ("a", "reconciliation_target_unknown", 0): ("official_code", "GHE 09", 1),
        ("a", "ergo_extraction_warning", 0): ("message", "x", 1),
        ("b", "private_compatibility_mode", 0): ("omitted_source_id", "1", 1),
    }


def test_no_issues_no_evidence(spark):
    none = spark.createDataFrame([], "job_id string, code string, source_id string")
    assert E.evidence(tables(spark), none).collect() == []


def test_fields(spark):
    rows = [("a", "legal_name_missing", None), ("a", "empty_file", "ghe"), ("a", "other", None), ("a", "compatibility_not_acknowledged", None)]
    got = E.with_fields(spark.createDataFrame(rows, "job_id string, code string, source_id string")).collect()
    assert [r.field for r in got] == ["company.legal_name", "ghe", None, "document.compatibility.acknowledged"]
    assert len({r.issue_id for r in got}) == 4


def test_warnings_of_extractions(spark):
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    blocks = spark.createDataFrame([("a",)], "job_id string")
    units = spark.createDataFrame(
        [("a", 1, None), ("a", 2, ""), ("a", 3, "../x.png"), ("a", 4, "img/x.png"), ("a", 5, "data:image/png;base64,AA"), ("a", 6, "http://x/y.png")],
        "job_id string, ord bigint, image_ref string",
    )
    got = {tuple(r) for r in E.block_warnings(jobs, blocks, units).collect()}
    assert got == {("b", None, "no_group_title"), ("a", "2", "image_unresolved"), ("a", "3", "image_unresolved"), ("a", "6", "image_unresolved")}
    assert {tuple(r) for r in E.block_warnings(jobs, blocks, units.drop("image_ref")).collect()} == {("b", None, "no_group_title")}
    media = spark.createDataFrame([("b", "m1", None), ("b", "m2", 3.0)], "job_id string, image_id string, width double")
    assert {tuple(r) for r in E.media_warnings(jobs, media).collect()} == {("a", None, "no_image"), ("b", "m1", "image_format_unknown")}
    sections = spark.createDataFrame([("a", "conclusion"), ("a", "prioritization"), ("a", "action_plan"), ("b", "conclusion")], "job_id string, category string")
    assert {tuple(r) for r in E.technical_warnings(jobs, sections).collect()} == {("b", "prioritization", "category_missing"), ("b", "action_plan", "category_missing")}
