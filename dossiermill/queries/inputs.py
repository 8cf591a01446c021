"""Logical inputs derived from the given tables.

Each input is one plain SQL text that Spark and DuckDB both understand, so that
a query and its check start from the same rows. Only the inputs are shared: the
operators and their checks are written independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_NAME = "lower(substr(o_orderpriority, 3)) || CASE o_custkey % 4 WHEN 0 THEN ' alfa' WHEN 1 THEN ' beta' WHEN 2 THEN ' operação' ELSE '' END"

INPUTS: dict[str, str] = {
    # references to groups as people write them, one per order
    "refs": f"""
        SELECT id, n, nm, CASE id % 14
            WHEN 0 THEN 'GHE ' || n || ' - ' || nm
            WHEN 1 THEN 'ghe nº 0' || n || ' : ' || nm
            WHEN 2 THEN 'GHE-' || n
            WHEN 3 THEN 'GHE  ' || n || ' –  ' || nm || ' | resumo'
            WHEN 4 THEN 'Análise do GHE ' || n || ' - ' || nm
            WHEN 5 THEN 'GHE ' || (n + 10000)
            WHEN 6 THEN 'Grupo ' || nm
            WHEN 7 THEN 'XGHE ' || n
            WHEN 8 THEN 'ghe_' || n || ' — ' || upper(nm) || ';'
            WHEN 9 THEN 'Resultados do GHE N. ' || n || ': ' || nm
            WHEN 10 THEN '  Grupo   ' || nm || '  geral '
            WHEN 11 THEN 'GHE/' || n || '|' || nm
            WHEN 12 THEN CAST(n AS STRING)
            ELSE NULL END AS ref
        FROM (SELECT o_orderkey AS id, o_custkey % 1200 AS n, {_NAME} AS nm FROM orders) AS o""",
    # spreadsheet cells with head-counts and lists, one per order line
    "cells": """
        SELECT o_orderkey AS id, CASE o_orderkey % 11
            WHEN 0 THEN CAST(o_custkey AS STRING)
            WHEN 1 THEN o_custkey || ' pessoas'
            WHEN 2 THEN o_custkey || ',0'
            WHEN 3 THEN '1.' || (o_custkey % 1000)
            WHEN 4 THEN 'TOTAL'
            WHEN 5 THEN '-' || o_custkey
            WHEN 6 THEN 'n/a'
            WHEN 7 THEN o_custkey || ',5'
            WHEN 8 THEN 'cerca de ' || o_custkey || ' no setor ' || (o_custkey % 7)
            WHEN 9 THEN ''
            ELSE NULL END AS qty,
            CASE o_orderkey % 6
            WHEN 0 THEN 'Unidade Alfa; Unidade Beta|unidade alfa ;; '
            WHEN 1 THEN lower(o_orderpriority)
            WHEN 2 THEN 'Operação ' || o_orderstatus || '; OPERACAO ' || o_orderstatus || '; Apoio'
            WHEN 3 THEN ' ; | '
            WHEN 4 THEN o_orderstatus || '|' || o_orderpriority || '|' || lower(o_orderstatus)
            ELSE NULL END AS listing,
            CASE o_orderkey % 7
            WHEN 0 THEN 'Favorável: ' || (o_custkey % 100) || '%'
            WHEN 1 THEN (o_custkey % 100) || ',5 % dos casos'
            WHEN 2 THEN '1234% e ' || (o_custkey % 10) || '.25%'
            WHEN 3 THEN 'Classificação – ' || lower(o_orderpriority)
            WHEN 4 THEN 'sem número: '
            WHEN 5 THEN 'Título: — ' || o_orderstatus
            ELSE 'texto' END AS phrase
        FROM orders""",
    # heading candidates, one per order
    "headings": """
        SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'Heading 1' WHEN 1 THEN 'Lista' WHEN 2 THEN 'Título 2' ELSE 'Normal' END AS style,
            CASE (o_orderkey + o_custkey) % 19
            WHEN 0 THEN 'Conclusão técnica'
            WHEN 1 THEN '3. Plano de Ação geral'
            WHEN 2 THEN 'PRIORIZAÇÃO DE RISCOS'
            WHEN 3 THEN 'Pontos positivos:'
            WHEN 4 THEN 'Aspectos críticos'
            WHEN 5 THEN 'Oportunidades de melhoria'
            WHEN 6 THEN 'Perguntas de maior relevância'
            WHEN 7 THEN 'Favorabilidade por domínio'
            WHEN 8 THEN 'Classificação: ' || o_orderpriority
            WHEN 9 THEN 'ANÁLISE TÉCNICA POR GHE - GHE ' || (o_custkey % 60) || ' - ' || lower(o_orderpriority)
            WHEN 10 THEN 'Visão geral'
            WHEN 11 THEN 'TEXTO EM CAIXA ALTA'
            WHEN 12 THEN 'TEXTO COM PONTO.'
            WHEN 13 THEN 'Resposta: sim'
            WHEN 14 THEN 'Pergunta ' || o_orderstatus
            WHEN 15 THEN 'Observações gerais do setor'
            WHEN 16 THEN 'Medida proposta ' || o_orderpriority
            WHEN 17 THEN '12345'
            ELSE 'Um parágrafo comum sobre o setor ' || o_orderpriority || ' e seus riscos, com muitas palavras até o fim' END AS text
        FROM orders""",
    # column headers, one per customer
    "headers": """
        SELECT c_custkey AS id, CASE c_custkey % 22
            WHEN 0 THEN 'Código GHE' WHEN 1 THEN 'Nome GHE' WHEN 2 THEN 'GHE' WHEN 3 THEN 'Identificação do GHE'
            WHEN 4 THEN 'Setores' WHEN 5 THEN 'Departamento ' || c_mktsegment WHEN 6 THEN 'Cargo' WHEN 7 THEN 'Função'
            WHEN 8 THEN 'QTD.' WHEN 9 THEN 'Total colaboradores' WHEN 10 THEN 'Nome Colaborador' WHEN 11 THEN 'Matrícula'
            WHEN 12 THEN 'CPF' WHEN 13 THEN 'Ação proposta' WHEN 14 THEN 'Responsável' WHEN 15 THEN 'Prazo'
            WHEN 16 THEN 'Evolução/Registros' WHEN 17 THEN 'Prioridade' WHEN 18 THEN 'GHE/Abrangência'
            WHEN 19 THEN 'Indicador de ' || c_mktsegment WHEN 20 THEN 'Grupo homogêneo de exposição' ELSE c_mktsegment END AS header
        FROM customer""",
    # media contexts, one per part
    "contexts": """
        SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE 'GHE ' || p_size END AS code,
            CASE p_partkey % 11
            WHEN 0 THEN 'Matriz de risco ' || p_name WHEN 1 THEN 'Gráfico radar' WHEN 2 THEN 'Resumo por domínio'
            WHEN 3 THEN 'Índice de favorabilidade' WHEN 4 THEN 'Painel geral' WHEN 5 THEN 'Painel do grupo ' || p_name
            WHEN 6 THEN 'Chart of ' || p_name WHEN 7 THEN 'GHE ' || p_size || ' - ' || p_name WHEN 8 THEN p_name
            WHEN 9 THEN 'Gráfico de risco' ELSE NULL END AS context,
            p_retailprice AS width, p_size * 20 AS height
        FROM part""",
    # question table rows of two or three cells, one per order
    "questions": """
        SELECT o_orderkey AS id,
            CASE o_orderkey % 8 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN o_custkey || '. Item' WHEN 2 THEN 'Item'
                WHEN 3 THEN 'Pergunta' WHEN 4 THEN '' WHEN 5 THEN 'Empresa' WHEN 6 THEN o_custkey || ') Item' ELSE CAST(o_custkey AS STRING) END AS c1,
            CASE o_orderkey % 8 WHEN 0 THEN 'A postura é adequada? ✅ Sim' WHEN 1 THEN 'Talvez' WHEN 2 THEN 'Não' WHEN 3 THEN 'Resposta'
                WHEN 4 THEN '' WHEN 5 THEN 'Setor GHE' WHEN 6 THEN 'Conforme' ELSE 'Há pausas? nao' END AS c2,
            CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'nota ' || o_orderstatus ELSE '' END AS c3
        FROM orders""",
    # file names and form fields, one per customer
    "forms": """
        SELECT c_custkey AS job_id, c_name AS plain,
            CASE c_custkey % 6 WHEN 0 THEN 'C:/pasta/' || c_name || '.DOCX' WHEN 1 THEN '../Relatório final (' || c_mktsegment || ').doc'
                WHEN 2 THEN '..' WHEN 3 THEN 'ação técnica ' || c_custkey || '.xlsx' WHEN 4 THEN '' ELSE c_name || '__.png' END AS filename,
            CASE c_custkey % 4 WHEN 0 THEN ' .XLSX ' WHEN 1 THEN 'Docx' WHEN 2 THEN '.png' ELSE 'JPEG' END AS ext,
            CASE c_custkey % 7 WHEN 0 THEN 'Integrado' WHEN 1 THEN ' separated ' WHEN 2 THEN 'separado' WHEN 3 THEN 'outro' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'INTEGRATED' END AS mode_text,
            CASE c_custkey % 5 WHEN 0 THEN 'on' WHEN 1 THEN 'SIM' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE ' true ' END AS flag_text,
            CASE WHEN c_custkey % 13 = 0 THEN '  ' WHEN c_custkey % 17 = 0 THEN repeat(c_name, 14) ELSE c_name END AS company_name,
            CASE c_custkey % 9 WHEN 0 THEN '2024-13' WHEN 1 THEN '2024-1' WHEN 2 THEN NULL ELSE '2024-0' || (c_custkey % 9) END AS competence,
            CASE c_custkey % 8 WHEN 0 THEN '2023-02-29' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '29/02/2024' ELSE '2024-06-1' || (c_custkey % 8) END AS ergo_reference_date,
            CASE c_custkey % 10 WHEN 0 THEN '2024-00-10' WHEN 1 THEN '' ELSE '2024-07-2' || (c_custkey % 10) END AS psychosocial_reference_date
        FROM customer""",
    # uploaded files by form field, several per customer
    "uploads": """
        SELECT o_custkey AS job_id, CASE o_orderkey % 12
            WHEN 0 THEN 'ghe_spreadsheet' WHEN 1 THEN 'planilha_ghes' WHEN 2 THEN 'ergo_report' WHEN 3 THEN 'relatorio_ergo'
            WHEN 4 THEN 'psychosocial_report' WHEN 5 THEN 'technical_report' WHEN 6 THEN 'integrated_report'
            WHEN 7 THEN 'cnpj_card' WHEN 8 THEN 'agent1_report' WHEN 9 THEN 'agent2_report' WHEN 10 THEN 'logo'
            ELSE 'anexo' END AS field,
            CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE 'file-' || o_orderkey END AS filename
        FROM orders""",
    "form_jobs": """
        SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'separate' ELSE 'integrated' END AS analysis_mode
        FROM customer""",
    # official registry: one job per part type
    "groups": """
        SELECT p_type AS job_id, CAST(p_size AS BIGINT) AS ord,
            'GHE ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS code,
            min(p_name) AS name, count(*) AS population
        FROM part GROUP BY p_type, p_size""",
    # source blocks: one per part, with planted deviations
    "blocks": """
        SELECT p_type AS job_id, p_partkey AS source_id, p_partkey AS ord,
            CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 2 THEN 'GHE ' || (p_size + 50) ELSE 'GHE ' || p_size END AS source_code,
            CASE p_partkey % 7 WHEN 1 THEN NULL
                WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)
                ELSE p_name END AS source_name,
            p_size
        FROM part""",
    # media occurrences: one per part
    "media": """
        SELECT p_type AS job_id, p_partkey AS ord, 'img-' || p_partkey AS image_id,
            p_retailprice AS width, CAST(p_size * 20 AS DOUBLE) AS height,
            CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'GHE ' || (p_size + 50) ELSE 'GHE ' || p_size END AS code_hint,
            CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Resultados ' || p_name ELSE p_name END AS name_hint,
            CASE p_partkey % 9 WHEN 0 THEN 'ghe_panel' WHEN 1 THEN 'chart' WHEN 2 THEN 'risk_matrix' WHEN 3 THEN 'radar'
                WHEN 4 THEN 'domain_summary' WHEN 5 THEN 'general_panel' ELSE 'other' END AS role
        FROM part""",
    # text and media units around each other: one document per part type
    "context_units": """
        SELECT p_type AS job_id, p_partkey AS ord, CASE WHEN p_partkey % 4 = 0 THEN 'image' ELSE 'text' END AS kind,
            CASE p_partkey % 16 WHEN 0 THEN NULL WHEN 4 THEN 'Painel GHE ' || p_size || ' - ' || p_name WHEN 8 THEN 'figura'
                WHEN 12 THEN NULL WHEN 1 THEN 'GHE ' || p_size || ' - ' || p_name WHEN 2 THEN 'Gráfico radar de ' || p_name
                WHEN 5 THEN 'Resumo do risco' WHEN 9 THEN 'GHE ' || p_size WHEN 11 THEN 'Matriz de risco'
                ELSE 'parágrafo livre sobre ' || p_name END AS text
        FROM part""",
    # conversation turns with a title line in front of some
    "turns": """
        SELECT conv_id AS job_id, turn, role, CASE
            WHEN role = 'user' AND (conv_id + turn) % 5 < 2 THEN 'GHE ' || ((conv_id + turn) % 4) || ' - bloco ' || (turn % 3) || chr(10) || text
            WHEN role = 'user' AND (conv_id + turn) % 5 = 2 THEN 'Painel GHE ' || (turn % 4) || chr(10) || text
            ELSE text END AS body,
            CASE WHEN role = 'assistant' THEN text ELSE CASE (conv_id + turn) % 9
            WHEN 0 THEN 'ANÁLISE TÉCNICA POR GHE - GHE ' || (conv_id % 30) || ' - grupo ' || (turn % 4)
            WHEN 1 THEN '2. Introdução'
            WHEN 2 THEN 'Favorabilidade' || chr(10) || 'Foram ' || (conv_id % 100) || ',5% favoráveis'
            WHEN 3 THEN 'Classificação: nível ' || (conv_id % 3)
            WHEN 4 THEN 'PRIORIZAÇÃO'
            WHEN 5 THEN 'Conclusão técnica'
            WHEN 6 THEN 'Plano de ação'
            WHEN 7 THEN 'Leitura técnica do GHE ' || (conv_id % 30)
            ELSE 'Visão geral' END || chr(10) || text END AS report
        FROM conversations""",
    # job events
    "event_log": """
        SELECT user_id AS job_id, ts, event_id,
            CASE event_type WHEN 'view' THEN 'validating' WHEN 'signup' THEN 'validated' WHEN 'click' THEN 'generating'
                WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
            CASE event_type WHEN 'view' THEN 'progress' WHEN 'signup' THEN 'progress' WHEN 'click' THEN 'start'
                WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS kind,
            CASE event_type WHEN 'view' THEN 'open' WHEN 'signup' THEN 'close' WHEN 'click' THEN 'open'
                WHEN 'purchase' THEN 'close' ELSE 'other' END AS download,
            event_id % 2 AS token,
            CAST(floor(value * 3) AS INT) - 20 AS progress
        FROM events""",
    # rule tables: one job per brand
    "dq_jobs": """
        SELECT p_brand AS job_id, CASE WHEN min(p_partkey) % 5 = 0 THEN '' ELSE p_brand END AS legal_name,
            min(p_partkey) % 4 <> 0 AS has_card, CASE WHEN min(p_partkey) % 6 = 0 THEN NULL ELSE '2024-05' END AS competence,
            '2024-05-01' AS ergo_base_date, CASE WHEN min(p_partkey) % 7 = 0 THEN ' ' ELSE '2024-05-02' END AS psychosocial_base_date,
            CASE WHEN min(p_partkey) % 3 = 0 THEN 'separate' ELSE 'integrated' END AS analysis_mode
        FROM part GROUP BY p_brand
        UNION ALL SELECT p_brand || ' outro' AS job_id, p_brand AS legal_name, min(p_partkey) % 3 <> 0 AS has_card, '2024-06' AS competence,
            CASE WHEN min(p_partkey) % 5 = 1 THEN '' ELSE '2024-06-01' END AS ergo_base_date, '2024-06-02' AS psychosocial_base_date,
            CASE WHEN min(p_partkey) % 2 = 0 THEN 'separate' ELSE 'integrated' END AS analysis_mode
        FROM part GROUP BY p_brand""",
    "dq_groups": """
        SELECT p_brand AS job_id, CAST(p_size AS BIGINT) AS ord, 'GHE ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS code,
            min(p_name) AS name, CASE WHEN p_size % 9 = 0 THEN 0 ELSE count(*) END AS population
        FROM part GROUP BY p_brand, p_size
        UNION ALL SELECT p_brand || ' outro' AS job_id, CAST(p_size AS BIGINT) AS ord, 'GHE ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS code,
            max(p_name) AS name, count(*) AS population
        FROM part WHERE p_size % 2 = 1 GROUP BY p_brand, p_size""",
    "dq_blocks": """
        SELECT CASE WHEN p_partkey % 4 <> 1 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CAST(p_partkey AS STRING) AS source_id FROM part""",
    "dq_plan": """
        SELECT CASE WHEN p_partkey % 4 <> 1 OR p_partkey % 100 = 1 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CAST(p_partkey AS STRING) AS source_id,
            CASE p_partkey % 6 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'confirmed' ELSE 'auto_matched' END AS status,
            CASE WHEN p_partkey % 6 <= 1 THEN NULL WHEN p_partkey % 11 = 0 THEN 'GHE 77' ELSE 'GHE ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size END AS official_code,
            CASE WHEN p_partkey % 6 IN (1, 2) AND p_partkey % 5 <> 0 THEN 'motivo' END AS decision_reason
        FROM part""",
    "dq_media": """
        SELECT CASE WHEN p_size % 10 <> 3 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CASE WHEN p_partkey % 50 = 0 THEN 'general_panel' ELSE 'chart' END AS role,
            CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'GHE ' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size END AS official_code
        FROM part""",
    "dq_sections": """
        SELECT CASE WHEN p_partkey % 8 = 0 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CASE p_size % 12 WHEN 0 THEN 'prioritization' WHEN 1 THEN 'action_plan' WHEN 2 THEN 'conclusion' ELSE 'overview' END AS category
        FROM part""",
    "dq_sources": """
        SELECT p_brand AS job_id, CASE WHEN min(p_partkey) % 2 = 0 THEN 'integrated' ELSE 'psychosocial_agent' END AS source_role
        FROM part GROUP BY p_brand
        UNION ALL SELECT p_brand AS job_id, 'ergonomic_agent' AS source_role FROM part GROUP BY p_brand HAVING min(p_partkey) % 2 = 1
        UNION ALL SELECT p_brand || ' outro' AS job_id, CASE WHEN min(p_partkey) % 3 = 0 THEN 'ergonomic_agent' ELSE 'integrated' END AS source_role
        FROM part GROUP BY p_brand""",
    "dq_analyses": """
        SELECT CASE WHEN p_size % 5 <> 2 THEN p_brand ELSE p_brand || ' outro' END AS job_id, 'an-' || p_partkey AS analysis_id, p_partkey AS ord,
            CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'GHE ' || p_size END AS group_code,
            'setor ' || p_name || ' ' || p_type AS group_name, p_partkey % 4 AS n_content
        FROM part""",
    "dq_priorities": "SELECT CASE WHEN p_size % 12 = 0 AND p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ' outro' END AS job_id FROM part",
    "dq_actions": "SELECT CASE WHEN p_size % 24 = 1 THEN p_brand ELSE p_brand || ' outro' END AS job_id FROM part",
    "dq_conclusions": "SELECT CASE WHEN p_size % 24 = 2 THEN p_brand ELSE p_brand || ' outro' END AS job_id FROM part",
    "dq_exceptions": """
        SELECT CASE WHEN p_partkey % 20 = 7 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CASE WHEN p_partkey % 500 = 7 THEN 'missing-block' ELSE CAST(p_partkey AS STRING) END AS source_id,
            CASE WHEN p_partkey % 2 = 0 THEN 'include' ELSE 'omit' END AS action, p_partkey % 40 <> 7 AS acknowledged
        FROM part""",
    "dq_warnings": """
        SELECT CASE WHEN p_partkey % 30 = 11 THEN p_brand ELSE p_brand || ' outro' END AS job_id, CASE WHEN p_size % 2 = 0 THEN 'ergo_extraction' ELSE 'technical_extraction' END AS origin,
            CAST(p_partkey AS BIGINT) AS ord, 'aviso ' || p_name AS message
        FROM part""",
    # stored files: one per order
    "artifacts": """
        SELECT o_custkey AS job_id, CASE o_orderkey % 8 WHEN 0 THEN 'ghe' WHEN 1 THEN 'psychosocial' WHEN 2 THEN 'ergo'
                WHEN 3 THEN 'technical_integrated' WHEN 4 THEN 'registration_card' WHEN 5 THEN 'logo' WHEN 6 THEN 'technical_psychosocial' ELSE 'technical_ergonomic' END AS role,
            CASE o_orderkey % 5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.docx' WHEN 2 THEN 'DOC' WHEN 3 THEN '.png' ELSE '.docx' END AS extension,
            CASE o_orderkey % 7 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN 'html_doc' WHEN 3 THEN 'ole_doc' WHEN 4 THEN 'png' WHEN 5 THEN 'unknown' ELSE 'docx' END AS kind,
            CAST(floor(CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE o_totalprice * 100 END) AS BIGINT) AS size_bytes,
            o_orderkey % 3 = 0 AS active_content, o_orderkey % 13 > 0 AS available, md5(CAST(o_orderkey AS STRING)) AS md5
        FROM orders""",
    # package members: one package per supplier
    "members": """
        SELECT l_suppkey AS artifact_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 1000000 AS ord,
            CASE WHEN l_partkey % 971 = 0 THEN '../evil.xml' WHEN l_partkey % 613 = 0 THEN 'word/embeddings/obj1.bin'
                WHEN l_partkey % 787 = 0 THEN 'word/vbaProject.bin' ELSE 'word/part' || l_orderkey || '-' || l_partkey || '.xml' END AS name,
            CAST(floor(l_extendedprice * 300) AS BIGINT) AS file_size,
            CAST(floor(CASE WHEN l_partkey % 499 = 0 THEN 10 ELSE l_extendedprice * 100 END) AS BIGINT) AS compress_size,
            CASE WHEN l_partkey % 1201 = 0 THEN 1 ELSE 0 END AS flag_bits,
            CASE WHEN l_partkey % 1777 = 0 THEN 2717843456 ELSE 0 END AS external_attr,
            l_quantity = 50 AND l_tax = 0 AS is_dir
        FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax FROM lineitem) AS l""",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical input as a DataFrame."""
    text = INPUTS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in used})


def cte(*names: str) -> str:
    """The same inputs as the opening of a SQL text."""
    return "WITH " + ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)


def text_lines(df: DataFrame, key: str, ord_base, text: str) -> DataFrame:
    """Non-blank lines of texts as units: ``key, ord, text``; a text can have 2**32 lines."""
    return (
        df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_pos", "text"), ord_base.alias("_base"))
        .select(key, (F.col("_base") * (1 << 32) + F.col("_pos")).cast("bigint").alias("ord"), "text")
        .where(F.trim("text") != "")
    )
