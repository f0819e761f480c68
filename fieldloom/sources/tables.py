"""Readers and writers: explicit schemas, torn logs, caches, guarded sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = "supplier_part_number string, customer_part_number string, purchase_order string, quantity string"
HEADER = (
    "invoice_number string, invoice_date string, supplier_name string, buyer_name string, ship_to_name string, currency string, total_amount string, awb_number string, "
    "carrier string, mawb string, hawb string, origin_airport string, destination_airport string, shipper_name string, consignee_name string, pieces string, gross_weight_kg string"
)
GOLD = f"doc_id string, doc_type string, header struct<{HEADER.replace(' string', ':string')}>, line_items array<struct<{CELL.replace(' string', ':string')}>>, pages array<string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def gold(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file a document; an empty folder is an error."""
    df = spark.read.schema(GOLD).option("multiLine", True).json(folder)
    if df.isEmpty():
        raise ValueError("no labels found")
    return df


def gold_of(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Labels of several splits; of a document in two, the later split's."""
    parts = [gold(spark, f).withColumn("__s", F.lit(i)) for i, f in enumerate(folders)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.withColumn("__r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("__s")))).where("__r = 1").drop("__r", "__s")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a damaged one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def torn_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log whose very last line may be cut off: that line is dropped, damage elsewhere is an
    error when the rows are read."""
    lines = spark.read.text(path, lineSep="\n").where(F.trim("value") != "").withColumn("__at", F.monotonically_increasing_id())
    lines = lines.withColumn("__ok", F.try_parse_json("value").isNotNull())
    last = lines.agg(F.max("__at").alias("__last"))
    kept = lines.join(F.broadcast(last)).where(F.col("__ok") | (F.col("__at") != F.col("__last")))
    whole = F.when(F.col("__ok"), F.col("value")).otherwise(F.raise_error(F.lit("a line before the last is damaged")))
    return kept.select(F.from_json(whole, schema).alias("r")).select("r.*")


def codes(spark: SparkSession, path: str) -> DataFrame:
    """A code list: one a line, comments after #."""
    code = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.upper(code).alias("code")).where("code <> ''").distinct()


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, doc_id, page) of page files named <doc>_p<n>.<ext>; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    return df.select("path", "length", F.regexp_replace(name, r"_p\d+$", "").alias("doc_id"), F.coalesce(F.regexp_extract(name, r"_p(\d+)$", 1).try_cast("int"), F.lit(1)).alias("page"))


def cache_status(expected: DataFrame, cached: DataFrame, key: str, valid: Column) -> DataFrame:
    """(key, status): valid, invalid or missing."""
    c = cached.select(key, valid.alias("__ok"))
    status = F.when(F.col("__ok").isNull(), "missing").when(F.col("__ok"), "valid").otherwise("invalid")
    return expected.select(key).join(c, key, "left").select(key, status.alias("status"))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has still to do."""
    return work.join(done.select(key), key, "left_anti")


def write_checked(df: DataFrame, path: str, problems: DataFrame) -> None:
    """Write only if there is no problem."""
    if not problems.isEmpty():
        raise ValueError(f"not written: {problems.count()} checks failed")
    df.write.mode("overwrite").parquet(path)


def write_numbers_csv(df: DataFrame, path: str, allowed_text: Sequence[str] = ()) -> None:
    """CSV of ids and numbers only: other text columns are refused; six decimals."""
    bad = [c for c, t in df.dtypes if t not in ("int", "bigint", "double", "float", "boolean") and c not in allowed_text]
    if bad:
        raise ValueError(f"columns that may hold values: {bad}")
    cols = [F.format_string("%.6f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def ids_digest(df: DataFrame, key: str) -> DataFrame:
    """One row: 16 hex digits over the ordered ids. For id lists of runs (bounded by the run)."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n")
    return df.agg(F.substr(F.sha2(ids.cast("binary"), 256), F.lit(1), F.lit(16)).alias("digest"))


def markdown(rows: list[tuple], head: Sequence[str]) -> str:
    line = lambda r: "| " + " | ".join("" if x is None else str(x) for x in r) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)]) + "\n"
