"""The canonical tables over the driver's: gold and predicted rows and headers, scores, steps.

A prediction is the gold data changed by integer arithmetic on keys, so that any engine
makes the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.sources.tables import table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def gold_rows(spark: SparkSession, d: str) -> DataFrame:
    """(doc, row, spn, cpn, po, qty in hundredths)"""
    li = table(spark, d, "lineitem")
    row = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("long")
    return li.select(
        F.col("l_orderkey").alias("doc"), row.alias("row"), F.concat(F.lit("P"), "l_partkey").alias("spn"), F.concat(F.lit("C"), "l_suppkey").alias("cpn"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("O"), "l_linenumber")).alias("po"), F.round(F.col("l_quantity") * 100).cast("long").alias("qty"), F.col("l_partkey").alias("part"),
    )


def pred_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows dropped, part numbers off by one, cells blanked, filled and swapped, quantities wrong."""
    g = gold_rows(spark, d).where("(doc + row) % 17 <> 0")
    swap = F.expr("(doc * 3 + row) % 23 = 0")
    cpn = F.when(F.expr("(doc + row) % 13 = 0"), F.lit(None)).otherwise(F.col("cpn"))
    po = F.when(F.col("po").isNull() & F.expr("doc % 5 = 0"), "O1").otherwise(F.col("po"))
    return g.select(
        "doc", "row", F.when(F.expr("(doc * 7 + row) % 19 = 0"), F.concat(F.lit("P"), F.col("part") + 1)).otherwise(F.col("spn")).alias("spn"), F.when(swap, po).otherwise(cpn).alias("cpn"),
        F.when(swap, cpn).otherwise(po).alias("po"), (F.col("qty") + F.when(F.expr("(part + row) % 29 = 0"), 100).otherwise(0)).alias("qty"), "part",
    )


def header_cells(spark: SparkSession, d: str) -> DataFrame:
    """(doc, field, gold, pred): three header fields of an order."""
    o = table(spark, d, "orders").withColumn("doc", F.col("o_orderkey"))
    day = lambda add: F.date_format(F.date_add(F.to_date("o_orderdate"), add), "yyyy-MM-dd")
    price = lambda more: F.round(F.col("o_totalprice") * 100 + more).cast("long").cast("string")
    status = F.when(F.expr("doc % 11 <> 3"), F.col("o_orderstatus"))
    cells = F.array(
        F.struct(F.lit("invoice_date").alias("field"), day(0).alias("gold"), F.when(F.expr("doc % 37 = 0"), F.lit(None)).when(F.expr("doc % 31 = 0"), day(1)).otherwise(day(0)).alias("pred")),
        F.struct(F.lit("currency").alias("field"), status.alias("gold"), F.when(status.isNull() & F.expr("doc % 2 = 0"), "F").otherwise(status).alias("pred")),
        F.struct(F.lit("total_amount").alias("field"), price(0).alias("gold"), F.when(F.expr("doc % 41 = 0"), price(1)).when(F.expr("doc % 43 = 0"), F.lit(" ")).otherwise(price(0)).alias("pred")),
    )
    return o.select("doc", F.explode(cells).alias("c")).select("doc", "c.*")


def groups(spark: SparkSession, d: str) -> DataFrame:
    """(doc, grp, region, urgent, fold): customer's nation as the supplier group."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    dims = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_nationkey", "r_name")
    both = o.join(dims, o.o_custkey == dims.c_custkey)
    return both.select(F.col("o_orderkey").alias("doc"), F.col("n_nationkey").alias("grp"), F.col("r_name").alias("region"), F.col("o_orderpriority").startswith("1").alias("urgent"), (F.col("n_nationkey") % 3).alias("fold"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """(doc, y, s, fold): labelled documents with a score that is a fraction of integers."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    s = ((F.col("doc_id") * 7919 + F.col("n_chars") * 31) % 97 + F.col("quality") * 20) / F.lit(117.0)
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("doc"), F.col("quality").alias("y"), s.alias("s"), (F.col("doc_id") % 3).alias("fold"), "lang", "n_chars")


#: The same tables as SQL for DuckDB.
SQL = {
    "gold": f"""SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS row, 'P' || l_partkey AS spn, 'C' || l_suppkey AS cpn,
 CASE WHEN l_returnflag <> 'R' THEN 'O' || l_linenumber END AS po, CAST(round(l_quantity * 100) AS BIGINT) AS qty, l_partkey AS part FROM lineitem""",
    "pred0": "SELECT *, CASE WHEN (doc + row) % 13 = 0 THEN NULL ELSE cpn END AS c2, CASE WHEN po IS NULL AND doc % 5 = 0 THEN 'O1' ELSE po END AS p2 FROM gold WHERE (doc + row) % 17 <> 0",
    "pred": """SELECT doc, row, CASE WHEN (doc * 7 + row) % 19 = 0 THEN 'P' || (part + 1) ELSE spn END AS spn, CASE WHEN (doc * 3 + row) % 23 = 0 THEN p2 ELSE c2 END AS cpn,
 CASE WHEN (doc * 3 + row) % 23 = 0 THEN c2 ELSE p2 END AS po, qty + CASE WHEN (part + row) % 29 = 0 THEN 100 ELSE 0 END AS qty, part FROM pred0""",
    "head": """SELECT o_orderkey AS doc, 'invoice_date' AS field, strftime(o_orderdate, '%Y-%m-%d') AS gold,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS pred FROM orders
 UNION ALL SELECT o_orderkey, 'currency', CASE WHEN o_orderkey % 11 <> 3 THEN o_orderstatus END, CASE WHEN o_orderkey % 11 = 3 AND o_orderkey % 2 = 0 THEN 'F' WHEN o_orderkey % 11 <> 3 THEN o_orderstatus END FROM orders
 UNION ALL SELECT o_orderkey, 'total_amount', CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR),
 CASE WHEN o_orderkey % 41 = 0 THEN CAST(CAST(round(o_totalprice * 100 + 1) AS BIGINT) AS VARCHAR) WHEN o_orderkey % 43 = 0 THEN ' ' ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END FROM orders""",
    "grp": """SELECT o_orderkey AS doc, n_nationkey AS grp, r_name AS region, o_orderpriority LIKE '1%' AS urgent, n_nationkey % 3 AS fold
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "sc": "SELECT doc_id AS doc, quality AS y, ((doc_id * 7919 + n_chars * 31) % 97 + quality * 20) / 117.0::DOUBLE AS s, doc_id % 3 AS fold, lang, n_chars FROM documents JOIN labels USING (doc_id)",
    "k1": "SELECT *, concat_ws('|', spn, coalesce(cpn, '~'), coalesce(po, '~'), qty) AS k FROM ",
    "p1": "SELECT *, row_number() OVER (PARTITION BY doc, spn, cpn, po, qty ORDER BY row) AS r FROM pred",
    "g1": "SELECT *, row_number() OVER (PARTITION BY doc, spn, cpn, po, qty ORDER BY row) AS r FROM gold",
    "m1": "SELECT p1.doc, p1.row AS left_row, g1.row AS right_row FROM p1 JOIN g1 ON p1.doc = g1.doc AND p1.spn = g1.spn AND p1.cpn IS NOT DISTINCT FROM g1.cpn AND p1.po IS NOT DISTINCT FROM g1.po AND p1.qty = g1.qty AND p1.r = g1.r",
    "p2": "SELECT *, row_number() OVER (PARTITION BY doc, spn ORDER BY row) AS r FROM pred WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.doc = pred.doc AND m1.left_row = pred.row)",
    "g2": "SELECT *, row_number() OVER (PARTITION BY doc, spn ORDER BY row) AS r FROM gold WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.doc = gold.doc AND m1.right_row = gold.row)",
    "m2": "SELECT p2.doc, p2.row AS left_row, g2.row AS right_row FROM p2 JOIN g2 ON p2.doc = g2.doc AND p2.spn = g2.spn AND p2.r = g2.r",
    "pairs": "SELECT *, 1 AS pass FROM m1 UNION ALL SELECT *, 2 FROM m2",
    "ok": "SELECT doc, field, gold, pred, coalesce(nullif(trim(gold), ''), '') = coalesce(nullif(trim(pred), ''), '') AS right_ FROM head",
    "docs": """SELECT h.doc, h.header_right, h.header_cells, coalesce(m.n, 0) AS rows_full, coalesce(p.n, 0) AS rows_pred, coalesce(g.n, 0) AS rows_gold,
 (h.header_right = h.header_cells AND coalesce(m.n, 0) = coalesce(g.n, 0) AND coalesce(p.n, 0) = coalesce(g.n, 0))::INT AS fully
 FROM (SELECT doc, sum(right_::INT) AS header_right, count(*) AS header_cells FROM ok GROUP BY doc) h LEFT JOIN (SELECT doc, count(*) AS n FROM m1 GROUP BY doc) m USING (doc)
 LEFT JOIN (SELECT doc, count(*) AS n FROM pred GROUP BY doc) p USING (doc) LEFT JOIN (SELECT doc, count(*) AS n FROM gold GROUP BY doc) g USING (doc)""",
}
MATCH = ("gold", "pred0", "pred", "p1", "g1", "m1")
PAIRS = (*MATCH, "p2", "g2", "m2", "pairs")
SCORES = (*MATCH, "head", "ok", "docs")


def sql(names, body: str, **more: str) -> str:
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
