"""The registered queries of this package and their SQL, where SQL can say them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, html_text, language, lm, mixing, near_dedup, pii, quality, search, token_counts
from fieldloom.llm._common import crc_mod, keyed_text, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(keyed_text(table(spark, sf_dir, "documents"))).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = search.top_k(docs, docs.where(F.col("doc_id") % 50 == 0))
    return found.withColumn("score", F.round("score", 6))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {"op1_decontaminate": op1_decontaminate, "op2_near_dedup": op2_near_dedup, "op3_token_counts": op3_token_counts, "op4_language": op4_language, "op5_html_text": op5_html_text, "op6_pii": op6_pii, "op7_mixing": op7_mixing, "op8_quality": op8_quality, "op9_search": op9_search, "op10_lm": op10_lm}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.duckdb_sql(), "op9_search": search.duckdb_sql()}
