"""The public sample job end to end, its goldens, and a mutation of one number."""

import pytest
from pyspark.sql import functions as F

from dossiermill.operators import reconcile as RC
from dossiermill.plans.flows import Inputs, generate, registry, validate

GROUPS = [
    ("11", "Oficina de Bicicletas", "Galpao Norte", "Mecanico de rodas; Ajudante", 7, 64, "Moderado"),
    ("24", "Cozinha Central", "Predio Sul; Entregas", "Cozinheira", 4, 39, "Elevado"),
    ("37", "Viveiro de Mudas", "Estufa Leste", "Jardineiro", 9, 90, "Baixo"),
]
EXTRA = ("88", "Deposito Antigo")


def sheet(job, first=7):
    rows = [
        (job, "Resumo", 0, 1, ["Indicador", "Valor"]),
        (job, "Resumo", 0, 2, ["Grupos", "3"]),
        (job, "GHEs", 1, 1, ["Codigo GHE", "Nome GHE", "Setores", "Cargos", "Quantidade", "Nota"]),
    ]
    for i, (code, name, sectors, roles, n, _, _) in enumerate(GROUPS):
        rows.append((job, "GHEs", 1, i + 2, [code, name, sectors, roles, str(first if i == 0 else n), "-"]))
    return rows


def block_units(job):
    out, at = [], 0
    for code, name in [(g[0], g[1]) for g in GROUPS] + [EXTRA]:
        lines = [f"GHE {code} - {name}", "Pergunta: a?", "Resposta: Sim", "Observacao: o", "Orientacao: g", f"GHE {code} - {name}"]
        for i, line in enumerate(lines):
            out.append((job, at, line, None, i == 0))
            at += 1
        out.append((job, at, None, [["Campo", "Conteudo"], ["1", "Postura boa? Sim"], ["2", "Pausas? Não"]], False))
        at += 1
    return out


def media_units(job):
    out = [(job, 0, "image", "Painel geral | resumo", 1400.0, 500.0)]
    for code, name, *_ in GROUPS:
        for kind in ("Painel", "Resumo por dominio", "Radar", "Matriz de risco"):
            out.append((job, len(out), "image", f"{kind} | GHE {code} - {name} | nota", 800.0, 600.0))
    return out


def report_units(job, role="integrated", source=0, priorities=True):
    out = []

    def add(text=None, rows=None, style=None):
        out.append((job, role, source, len(out), text, rows or [], style))

    add("VISAO GERAL")
    add("Texto geral.")
    for code, name, _, _, _, pct, label in GROUPS:
        add(f"GHE {code} - {name}", style="Heading 1")
        add(f"Favorabilidade do GHE {code} - {name}", style="Heading 2")
        add(f"Percentual: {pct}%")
        add(f"Classificacao: {label}", style="Heading 2")
        add("Leitura tecnica", style="Heading 2")
        add(f"Leitura de {name}.")
        add(rows=[["Pergunta sintetica", "Favorabilidade"], ["p1", "70%"]])
        add("Pontos positivos", style="Heading 2")
        add("Bom clima.")
    add("1. Encerramento")
    if priorities:
        add("Priorizacao", style="Heading 1")
        add(rows=[["Ordem", "GHE", "Prioridade", "Fundamentacao aprovada"], ["1", "GHE 24", "Alta", "motivo"], ["2", "", "", "x"]])
    add("Plano de acao", style="Heading 1")
    add(rows=[["Acao", "Origem", "Prioridade", "Responsavel", "Prazo", "Indicador", "Evolucao/Registros"], ["Fazer", "o", "Alta", "RH", "30d", "i", "antigo"]])
    add("Conclusao", style="Heading 1")
    add("Fim.")
    return out


JOBS = "job_id string, legal_name string, has_card boolean, competence string, ergo_base_date string, psychosocial_base_date string, analysis_mode string"


@pytest.fixture(scope="module")
def flow(spark):
    jobs = [(j, "Empresa", j != "nocard", "2024-05", "2024-05-01", "2024-05-02", "integrated") for j in ("base", "six", "nocard")]
    ids = [j[0] for j in jobs]
    inputs = Inputs(
        jobs=spark.createDataFrame(jobs, JOBS),
        sheet_rows=spark.createDataFrame(
            [r for j in ids for r in sheet(j, 8 if j == "six" else 7)],
            "job_id string, sheet string, sheet_ord int, row_no bigint, cells array<string>",
        ),
        block_units=spark.createDataFrame(
            [r for j in ids for r in block_units(j)], "job_id string, ord bigint, text string, rows array<array<string>>, structural boolean"
        ),
        media_units=spark.createDataFrame(
            [r for j in ids for r in media_units(j)], "job_id string, ord bigint, kind string, text string, width double, height double"
        ),
        report_units=spark.createDataFrame(
            [r for j in ids for r in report_units(j, priorities=j != "nocard")],
            "job_id string, source_role string, source_ord bigint, ord bigint, text string, rows array<array<string>>, style string",
        ),
        exceptions=spark.createDataFrame([], "job_id string, source_id string, action string, ordinal bigint, acknowledged boolean"),
    )
    return validate(inputs)


def test_groups_match_the_sample(flow):
    got = [tuple(r) for r in flow["groups"].where("job_id = 'base'").orderBy("ord").select("code", "name", "population").collect()]
    assert got == [("GHE 11", "Oficina de Bicicletas", 7), ("GHE 24", "Cozinha Central", 4), ("GHE 37", "Viveiro de Mudas", 9)]
    values = [r.value for r in flow["group_values"].where("job_id = 'base' and code = 'GHE 24' and kind = 'sector'").orderBy("at").collect()]
    assert values == ["Predio Sul", "Entregas"]


def test_mutating_one_number_changes_only_its_group(flow):
    totals = {r.job_id: r.total_population for r in flow["totals"].collect()}
    assert totals["base"] == 20 and totals["six"] == 21
    changed = flow["groups"].where("job_id = 'six'").select("code", "population").exceptAll(
        flow["groups"].where("job_id = 'base'").select("code", "population")
    )
    assert [tuple(r) for r in changed.collect()] == [("GHE 11", 8)]


def test_blocks_and_plan(flow):
    plan = {r.source_id: r for r in flow["plan"].where("job_id = 'base'").collect()}
    assert sorted(plan) == ["ergo-001", "ergo-002", "ergo-003", "ergo-004"]
    assert [plan[k].status for k in sorted(plan)] == ["auto_matched"] * 3 + ["needs_review"]
    assert plan["ergo-004"].n_candidates == 0 and plan["ergo-004"].warning == "no_candidate"
    assert flow["segmented"].where("job_id = 'base' and block_no = 0").count() == 0


def test_media(flow):
    media = flow["media"].where("job_id = 'base'").orderBy("ord").collect()
    assert len(media) == 13
    assert [m.official_code for m in media] == [None] + [c for c in ("GHE 11", "GHE 24", "GHE 37") for _ in range(4)]
    assert [m.role for m in media[:5]] == ["general_panel", "ghe_panel", "domain_summary", "radar", "risk_matrix"]


def test_analyses(flow):
    first = flow["analyses"].where("job_id = 'base'").orderBy("ord").first()
    assert (first.group_code, first.favorable_percentage, first.classification, first.n_readings) == ("GHE 11", "64%", "Moderado", 1)
    actions = flow["actions"].where("job_id = 'base'").collect()
    assert [(a.action, a.responsible, a.deadline, a.evolution) for a in actions] == [("Fazer", "RH", "30d", "")]
    assert [p.group_hint for p in flow["priorities"].where("job_id = 'base'").collect()] == ["GHE 24"]


def test_issues_and_status(flow):
    issues = {(r.job_id, r.code) for r in flow["issues"].where("severity = 'error'").collect()}
    assert issues == {("nocard", "registration_card_missing"), ("nocard", "prioritization_missing")}
    assert all(r.message for r in flow["issues"].where("severity = 'error'").collect())
    status = {r.job_id: r.status for r in flow["summary"].collect()}
    assert status == {"base": "needs_reconciliation", "six": "needs_reconciliation", "nocard": "validation_failed"}


def test_generation_needs_decisions(spark, flow):
    schema = "job_id string, source_id string, target string, not_applicable boolean, reason string, decided_at timestamp"
    decisions = spark.createDataFrame([("base", "ergo-004", None, True, "fora do escopo", None), ("six", "ergo-009", None, True, "x", None)], schema)
    out = generate(flow, decisions)
    assert [r.job_id for r in out["ready"].collect()] == ["base"]
    assert {(r.job_id, r.error) for r in out["decision_errors"].collect()} == {("six", "unknown_source")}
    assert [r.source_id for r in out["blocks"].orderBy("place").collect()] == ["ergo-001", "ergo-002", "ergo-003"]
    assert [(r.label, r.population) for r in out["groups"].where("is_total").collect()] == [("TOTAL", 20)]
    codes = [r.value for r in out["diagnostics"].where("line = 4").orderBy("part").collect()]
    assert codes == ["GHE 11", "GHE 24", "GHE 37"]
    assert {r.block_ord for r in out["questions"].select("block_ord").distinct().collect()} == {0, 1, 2}
    q = out["questions"].where("block_ord = 0").orderBy("row_no").collect()
    assert [(r.question, r.answer) for r in q] == [("1. Postura boa?", "Sim"), ("2. Pausas?", "Não")]
    assert {r.code for r in out["issues"].where("job_id = 'six' and severity = 'error'").collect()} == {"reconciliation_pending"}


def test_alternative_workbook_counts_and_details(spark):
    rows = [("j", "Resumo", 0, 1, ["aviso"]), ("j", "Resumo", 0, 2, ["GHE", "QTD."])]
    rows += [("j", "Resumo", 0, 3 + i, [f"GHE {i + 1:02d} - Grupo {i}", str(5 - i)]) for i in range(3)]
    for i in range(3):
        rows += [("j", f"GHE {i + 1}", i + 1, 1, ["Setor", "Cargo"]), ("j", f"GHE {i + 1}", i + 1, 2, [f"S{i}", "Cargo A; cargo a"])]
    df = spark.createDataFrame(rows, "job_id string, sheet string, sheet_ord int, row_no bigint, cells array<string>")
    # the summary sheet has identity and population only: the score of 4 is just usable
    reg = registry(df)
    assert [(r.code, r.population) for r in reg["groups"].orderBy("ord").collect()] == [("GHE 01", 5), ("GHE 02", 4), ("GHE 03", 3)]
    assert reg["totals"].first().total_population == 12
    roles = {(r.code, r.value) for r in reg["group_values"].where("kind = 'role'").collect()}
    assert roles == {(f"GHE 0{i}", "Cargo A") for i in (1, 2, 3)}


def test_unmatched_blocks_are_never_dropped_and_hot_hints_are_scored_once(spark):
    groups = spark.createDataFrame([("j", 1, "GHE 01", "sala um")], "job_id string, ord bigint, code string, name string")
    blocks = spark.range(3000).select(
        F.lit("j").alias("job_id"), F.col("id").alias("source_id"), F.col("id").alias("ord"),
        F.when(F.col("id") % 3 > 0, "GHE 1").alias("source_code"), F.when(F.col("id") % 3 > 0, "Sala Um").otherwise("zzz").alias("source_name"),
    )
    hinted = RC.with_hints(blocks)
    official = RC.official_groups(groups)
    assert RC.distinct_hints(hinted).count() == 2
    plan = RC.build_plan(hinted, official)
    assert {(r.status, r["count"]) for r in plan.groupBy("status").count().collect()} == {("auto_matched", 2000), ("needs_review", 1000)}
