"""Rule lists, thresholds and policies.

Nothing here is logic. Order inside each list matters, because the first
matching entry decides.
"""

# --- identifiers -----------------------------------------------------------
CODE_PREFIX = "GHE"

# Group-name prefixes, one of which is dropped from a name key.
NAME_PREFIXES = ["analise do ", "analise ", "resultados do ", "resultados ", "grupo "]

# A text unit that opens with one of these keys titles a group.
GROUP_HEADING_PREFIXES = ["ghe ", "grupo ghe ", "analise ghe ", "resultados ghe ", "ghe n "]

# --- headings --------------------------------------------------------------
HEADING_CATEGORIES = [
    ("conclusion", ["conclusao", "consideracoes finais"]),
    ("action_plan", ["plano de acao", "acoes integradas"]),
    ("prioritization", ["priorizacao", "prioridades"]),
    ("positive_points", ["pontos positivos", "aspectos positivos"]),
    ("critical_points", ["pontos criticos", "aspectos criticos"]),
    ("improvements", ["indicacoes de melhoria", "oportunidades de melhoria", "melhorias"]),
    ("relevant_questions", ["perguntas de maior relevancia", "questoes relevantes"]),
    ("favorability", ["favorabilidade", "percentual favoravel"]),
    ("classification", ["classificacao", "classe"]),
    ("technical_reading", ["leitura tecnica", "analise tecnica"]),
    ("overview", ["visao geral", "resumo geral", "panorama geral"]),
]
OTHER_CATEGORY = "other"
REQUIRED_CATEGORIES = ["prioritization", "action_plan", "conclusion"]
TEXT_SLOT_CATEGORIES = ["overview", "positive_points", "critical_points", "improvements"]
QUESTION_CATEGORIES = ["relevant_questions", "favorability", "technical_reading"]

HEADING_STYLES = ["heading", "titulo", "title", "cabecalho"]
LIST_STYLES = ["list", "lista"]

REGION_HEADINGS = {
    "visao geral": "overview",
    "pontos positivos": "positive_points",
    "pontos criticos": "critical_points",
    "indicacoes de melhoria": "improvements",
}
REGION_BOUNDARIES = [
    "perguntas de maior relevancia",
    "priorizacoes recomendadas",
    "plano de acao geral integrado",
    "conclusao tecnica",
    "termo de encerramento",
    "assinaturas",
    "pagina institucional",
]

# --- spreadsheet headers ----------------------------------------------------
PERSON_HEADERS = [
    "nome colaborador", "nome funcionario", "nome empregado", "colaborador nome",
    "funcionario nome", "trabalhador nome", "matricula", "cpf",
]
COMBINED_HEADERS = ["ghe", "identificacao ghe", "grupo homogeneo de exposicao"]
COMBINED_WORDS = ["identificacao", "grupo"]
CODE_WORDS = ["codigo", "cod", "numero", "nro", "id"]
NAME_WORDS = ["nome", "descricao", "denominacao"]
SECTOR_WORDS = ["setor", "departamento", "area", "unidade"]
ROLE_WORDS = ["cargo", "funcao", "ocupacao", "posto"]
POPULATION_HEADERS = ["qtd", "qtde", "quantidade", "populacao", "headcount"]
POPULATION_PHRASES = [
    "quantidade colaboradores", "numero colaboradores", "total colaboradores",
    "qtd colaboradores", "numero trabalhadores", "total pessoas",
]
COLUMN_KINDS = ["code", "name", "combined", "sector", "role", "population"]
HEADER_WEIGHTS = {"combined": 3, "code": 2, "name": 1, "sector": 1, "role": 1, "population": 1}
HEADER_PERFECT = 7
HEADER_USABLE = 4
TOTAL_ROW_PREFIXES = ["total ", "total geral", "subtotal "]
POPULATION_BLANKS = ["total", "subtotal", "n a", "na"]

# --- media ------------------------------------------------------------------
CONTEXT_TOKENS = [
    "painel", "grafico", "radar", "matriz", "dominio", "favorabilidade", "resumo", "risco",
]
CONTEXT_BEFORE = 4
CONTEXT_BEFORE_ENOUGH = 2
CONTEXT_AFTER = 2

# --- labelled lines ----------------------------------------------------------
LABEL_PREFIXES = [
    ("question", ["pergunta ", "questao "]),
    ("answer", ["resposta ", "resultado "]),
    ("observation", ["observacao ", "observacoes ", "comentario "]),
    ("guidance", ["orientacao ", "orientacoes ", "recomendacao ", "recomendacoes ",
                  "medida proposta "]),
]
QUESTION_SKIP_PREFIXES = ["pergunta resposta", "sim conforme", "empresa setor ghe"]
QUESTION_ANSWERS = ["sim", "nao", "conforme"]
QUESTION_TABLE_HEADER = "pergunta favoravel"

# --- scores -----------------------------------------------------------------
SAME_CODE_WEIGHT = 0.55
SAME_NAME_WEIGHT = 0.45
SIMILAR_NAME_WEIGHT = 0.35
SIMILAR_NAME_FLOOR = 0.65
CANDIDATE_FLOOR = 0.3
SEQUENCE_WEIGHT = 0.9
MEDIA_NAME_FLOOR = 0.82
MEDIA_CODE_NAME_FLOOR = 0.65
NOMINAL_FLOOR = 0.95
BLOCK_CODE_POINTS = 10
BLOCK_NAME_POINTS = 4

# --- comparison --------------------------------------------------------------
ARRAY_DIFF_THRESHOLD = 16.0
ARRAY_BLANK_LEVEL = 252.0

# --- lifecycle ---------------------------------------------------------------
JOB_TTL_SECONDS = 900
GENERATION_STALE_SECONDS = 600
ACTIVE_STATUSES = ["receiving", "validating", "generating"]
JOB_ID_PATTERN = "^[a-f0-9]{32}$"
GENERATING_FLOOR_PROGRESS = 55

# Answer to a generation request, by the status the job is in.
GENERATION_ANSWERS = {
    "receiving": "job_busy",
    "validating": "job_busy",
    "generating": "job_busy",
    "validation_failed": "validation_errors",
    "failed": "validation_errors",
    "completed": "already_completed",
    "validated": "accepted",
    "needs_reconciliation": "accepted",
}
GENERATION_DEFAULT_ANSWER = "job_not_validated"

# --- uploads ------------------------------------------------------------------
MIB = 1024 * 1024
UPLOAD_ALIASES = {
    "ghe_spreadsheet": ["ghe_spreadsheet", "ghe_file", "planilha_ghes", "ghe_planilha"],
    "psychosocial_report": ["psychosocial_report", "psychosocial_raw_report",
                            "relatorio_psicossocial"],
    "ergo_report": ["ergo_report", "ergo_raw_report", "relatorio_ergo"],
    "integrated_report": ["integrated_report", "technical_report", "relatorio_integrado"],
    "psychosocial_analysis": ["psychosocial_analysis", "agent1_report", "analise_psicossocial"],
    "ergonomic_analysis": ["ergonomic_analysis", "agent2_report", "analise_ergonomica"],
    "cnpj_card": ["cnpj_card", "cnpj_image", "cartao_cnpj"],
    "company_logo": ["company_logo", "logo", "logo_empresa"],
}
FIELD_ALIASES = {
    "company_name": ["company_name", "legal_name", "razao_social"],
    "competence": ["competence", "competencia"],
    "ergo_reference_date": ["ergo_reference_date", "ergo_base_date", "data_base_ergo"],
    "psychosocial_reference_date": ["psychosocial_reference_date", "psychosocial_base_date",
                                    "data_base_psicossocial"],
    "analysis_mode": ["analysis_mode", "modo_analise"],
    "compatibility_mode": ["compatibility_mode", "modo_compatibilidade"],
}
REQUIRED_ROLES = {
    "integrated": ["ghe_spreadsheet", "psychosocial_report", "ergo_report", "cnpj_card",
                   "integrated_report"],
    "separate": ["ghe_spreadsheet", "psychosocial_report", "ergo_report", "cnpj_card",
                 "psychosocial_analysis", "ergonomic_analysis"],
}
MODE_ALIASES = {
    "integrado": "integrated",
    "integrated": "integrated",
    "separado": "separate",
    "separate": "separate",
    "separated": "separate",
}
TRUE_WORDS = ["1", "true", "yes", "on", "sim"]
SOURCE_ROLES = {
    "integrated": ["integrated"],
    "separate": ["ergonomic_agent", "psychosocial_agent"],
}
MAX_FIELD_CHARS = 240

IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp"]
IMAGE_KINDS = ["png", "jpeg", "webp"]
# role: (allowed extensions, allowed kinds, maximum bytes, required)
UPLOAD_POLICIES = {
    "ghe": ([".xlsx"], ["xlsx"], 30 * MIB, True),
    "psychosocial": ([".docx"], ["docx"], 30 * MIB, True),
    "ergo": ([".doc", ".docx"], ["html_doc", "ole_doc", "docx"], 30 * MIB, True),
    "technical_integrated": ([".docx"], ["docx"], 30 * MIB, True),
    "technical_psychosocial": ([".docx"], ["docx"], 30 * MIB, True),
    "technical_ergonomic": ([".docx"], ["docx"], 30 * MIB, True),
    "registration_card": (IMAGE_EXTENSIONS, IMAGE_KINDS, 30 * MIB, True),
    "logo": (IMAGE_EXTENSIONS, IMAGE_KINDS, 30 * MIB, False),
}
EXTENSION_KINDS = {
    ".xlsx": ["xlsx"],
    ".docx": ["docx"],
    ".doc": ["html_doc", "ole_doc"],
    ".png": ["png"],
    ".jpg": ["jpeg"],
    ".jpeg": ["jpeg"],
    ".webp": ["webp"],
}

# Package limits of the lenient and the strict policy.
LENIENT_PACKAGE = {
    "max_members": 5000,
    "max_total": 250 * MIB,
    "ratio": 200,
    "ratio_from": 10 * MIB,
}
STRICT_PACKAGE = {
    "max_members": 20_000,
    "max_total": 250 * MIB,
    "max_member": 100 * MIB,
    "ratio": 200,
    "ratio_from": 1 * MIB,
}

# --- encoded chunks -----------------------------------------------------------
MAX_CHUNKS = 64

# --- issue catalogue: code -> (severity, message) ------------------------------
ISSUES = {
    "required_file_missing": ("error", "A required file was not supplied."),
    "file_unavailable": ("error", "The file cannot be read."),
    "extension_not_allowed": ("error", "The extension is not accepted for this role."),
    "empty_file": ("error", "The file is empty."),
    "file_too_large": ("error", "The file exceeds the size limit."),
    "real_type_not_allowed": ("error", "The real type is not accepted for this role."),
    "extension_content_mismatch": ("error", "Extension and real type differ."),
    "legacy_conversion_required": ("warning", "A legacy binary file needs conversion."),
    "html_active_content_ignored": ("warning", "Active content is ignored."),
    "legal_name_missing": ("error", "The legal name is required."),
    "registration_card_missing": ("error", "The registration card is required."),
    "competence_missing": ("error", "The competence is required."),
    "ergo_base_date_missing": ("error", "The base date of the block report is required."),
    "psychosocial_base_date_missing": ("error", "The base date of the media report is required."),
    "official_ghes_missing": ("error", "The registry has no official group."),
    "duplicate_official_ghe": ("error", "An official code occurs more than once."),
    "zero_ghe_population": ("warning", "An official group has no population."),
    "population_missing": ("error", "The total population must be positive."),
    "ergo_blocks_missing": ("error", "No block was extracted."),
    "reconciliation_scope_mismatch": ("error", "Plan and blocks differ."),
    "reconciliation_pending": ("error", "An item still needs a decision."),
    "ergo_block_not_applicable": ("warning", "A block was marked not applicable."),
    "reconciliation_target_unknown": ("error", "A decision targets an unknown group."),
    "psychosocial_images_missing": ("error", "No media was extracted."),
    "general_panel_not_identified": ("warning", "The general panel was not identified."),
    "psychosocial_ghe_image_missing": ("error", "An official group has no media."),
    "technical_mode_sources_invalid": ("error", "The sources do not fit the mode."),
    "technical_sections_missing": ("error", "No technical section was extracted."),
    "technical_ghe_analysis_missing": ("error", "An official group has no analysis."),
    "prioritization_missing": ("error", "The prioritization section is missing."),
    "action_plan_missing": ("error", "The action plan section is missing."),
    "technical_conclusion_missing": ("error", "The conclusion section is missing."),
    "action_plan_rows_missing": ("error", "The action plan has no rows."),
    "prioritization_rows_missing": ("error", "The prioritization has no rows."),
    "conclusion_text_missing": ("error", "The conclusion has no text."),
    "private_compatibility_mode": ("warning", "A private exception is recorded."),
    "compatibility_not_acknowledged": ("error", "The exception is not acknowledged."),
    "compatibility_unknown_ergo_block": ("error", "The exception names an unknown block."),
    "missing_fields": ("error", "A required field is empty."),
    "field_too_long": ("error", "A field is too long."),
    "invalid_date": ("error", "A date is not in ISO format."),
    "invalid_competence": ("error", "The competence is not in YYYY-MM format."),
    "missing_files": ("error", "A required file is missing."),
    "duplicate_file": ("error", "A file was sent more than once."),
    "unexpected_file": ("error", "A file field is unknown."),
    "ghe_spreadsheet_empty": ("error", "The registry sheet gave no group."),
    "ergo_report_empty": ("error", "The block report gave no block."),
    "psychosocial_report_empty": ("error", "The media report gave no media."),
    "technical_report_empty": ("error", "The technical report gave no recognised section."),
}
# Coverage rules that only warn while a job is being validated.
COVERAGE_CODES = [
    "psychosocial_ghe_image_missing", "technical_ghe_analysis_missing",
    "action_plan_rows_missing", "prioritization_rows_missing", "conclusion_text_missing",
]

# The field that an issue names, and the codes that its rules raise.
ISSUE_FIELDS = {
    "company.legal_name": ["legal_name_missing"],
    "company.registration_card": ["registration_card_missing"],
    "document.competence": ["competence_missing"],
    "document.ergo_base_date": ["ergo_base_date_missing"],
    "document.psychosocial_base_date": ["psychosocial_base_date_missing"],
    "official_ghes": ["official_ghes_missing", "duplicate_official_ghe", "population_missing"],
    "ergo.blocks": ["ergo_blocks_missing"],
    "reconciliation": ["reconciliation_scope_mismatch"],
    "psychosocial.images": ["psychosocial_images_missing", "general_panel_not_identified"],
    "technical.source_roles": ["technical_mode_sources_invalid"],
    "technical.sections": ["technical_sections_missing", "prioritization_missing", "action_plan_missing", "technical_conclusion_missing"],
    "technical.analyses": ["technical_ghe_analysis_missing"],
    "technical.action_plan": ["action_plan_rows_missing"],
    "technical.priorities": ["prioritization_rows_missing"],
    "technical.conclusion": ["conclusion_text_missing"],
    "document.compatibility": ["private_compatibility_mode", "compatibility_unknown_ergo_block"],
    "document.compatibility.acknowledged": ["compatibility_not_acknowledged"],
}
# Codes of single files: the field is the file's role.
FILE_CODES = [
    "required_file_missing", "file_unavailable", "extension_not_allowed", "empty_file", "file_too_large",
    "real_type_not_allowed", "extension_content_mismatch", "legacy_conversion_required", "html_active_content_ignored",
]
