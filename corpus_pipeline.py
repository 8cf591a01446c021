"""A training corpus from raw documents, in five stages.

Each stage takes what the one before it kept, decides with one operator, and hands
on whole documents (the last one their pieces). Its result is written as Parquet and
read again before the next stage starts, so a lost executor costs a part of one stage.

Defined cases are those of the operators; a stage that gets an empty table returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossiermill.llm import language_id, mixing, pieces, quality_rules, simhash
from dossiermill.llm.common import bounded_batches
from dossiermill.llm.queries import vocabulary
from dossiermill.plans.staging import new_path

POLICY = "v2"
LEAST_LANGUAGE_SCORE = 0.5
TOKENIZER = "piece_bpe_32k.model"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded(docs: DataFrame) -> DataFrame:
    """The columns of documents; whatever reads them in Python gets them in batches of bounded size."""
    bounded_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality_rules.keep_good(bounded(docs), POLICY)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their own labels teach, recognised with some certainty."""
    return language_id.keep_known(bounded(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(bounded(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat(bounded(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with proof that they are the model's and decode to the text."""
    coded = pieces.encode(bounded(docs), vocabulary(TOKENIZER), keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_pieces", F.size("piece_ids").cast("bigint"))


STAGES = [
    ("quality_rules", rules),
    ("language_id", languages),
    ("simhash_near_dedup", near_duplicates),
    ("source_mixing", mixture),
    ("sentencepiece", encoding),
]

#: Fingerprints, learned languages and pieces are beyond SQL; a test runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
