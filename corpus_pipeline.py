"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, language, mixing, near_dedup, pii
from fieldloom.llm._common import free_name, kept, scratch, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language that the model knows go."""
    return language.keep_known(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of exact and near copies the least doc_id stays."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    columns = docs.columns
    spans = free_name(docs, "spans")
    found = pii.redact(pii.find(docs, out=spans), spans=spans)
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that the tokens meet the target weights."""
    return mixing.draw(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_class),
    ("decontaminate", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote besides its rows is deleted when they are
    written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), name)
    return docs


#: SQL can say neither the language model nor the verified overlaps; tests/llm holds the
#: rows against brute force.
ORACLE_SQL = None
