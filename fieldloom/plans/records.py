"""Queries on records: matching, scores, rules, integrity, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.numbers import same
from fieldloom.functions.text import is_blank, shape_of
from fieldloom.operators import integrity, layout, matching, rules, scoring, sharding
from fieldloom.plans import hosts
from fieldloom.plans.hosts import PAIRS, SCORES, sql
from fieldloom.sources.tables import table

FULL = [F.col, ("spn", "cpn", "po", "qty")]


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.pair_rows(hosts.pred_rows(spark, d), hosts.gold_rows(spark, d), "doc", "row", [F.col(c) for c in FULL[1]], [F.col("spn")])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient statistics of each document."""
    head = hosts.header_cells(spark, d).withColumn("ok", same("date", "gold", "pred"))
    head = head.groupBy("doc").agg(F.count_if("ok").alias("header_right"), F.count("*").alias("header_cells"))
    pred, gold = hosts.pred_rows(spark, d), hosts.gold_rows(spark, d)
    full = matching.rank_join(pred, gold, "doc", "row", [F.col(c) for c in FULL[1]]).groupBy("doc").agg(F.count("*").alias("rows_full"))
    out = head.join(full, "doc", "left")
    for df, n in ((pred, "rows_pred"), (gold, "rows_gold")):
        out = out.join(df.groupBy("doc").agg(F.count("*").alias(n)), "doc", "left")
    out = out.fillna(0, ["rows_full", "rows_pred", "rows_gold"])
    fully = (F.col("header_right") == F.col("header_cells")) & (F.col("rows_full") == F.col("rows_gold")) & (F.col("rows_pred") == F.col("rows_gold"))
    return out.withColumn("fully", fully.cast("int"))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, t in df.dtypes if t == "double"})


_SCORES_SQL = """CAST(count(*) AS BIGINT) AS docs, CAST(sum(rows_full) AS BIGINT) AS rows_full, CAST(sum(rows_pred) AS BIGINT) AS rows_pred, CAST(sum(rows_gold) AS BIGINT) AS rows_gold,
round(sum(header_right) / sum(header_cells)::DOUBLE, 6) AS header_accuracy, round(2 * sum(rows_full) / (sum(rows_pred) + sum(rows_gold))::DOUBLE, 6) AS row_f1,
round(0.4 * sum(header_right) / sum(header_cells)::DOUBLE + 0.4 * 2 * sum(rows_full) / (sum(rows_pred) + sum(rows_gold))::DOUBLE + 0.2 * sum(fully) / count(*)::DOUBLE, 6) AS overall"""
_KEPT = ["docs", "rows_full", "rows_pred", "rows_gold", "header_accuracy", "row_f1", "overall"]


def match_rows_f1(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).join(hosts.groups(spark, d), "doc")
    return _rounded(scoring.overall(both, ["region"])).select("region", *_KEPT)


def overall_by_slice(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).join(hosts.groups(spark, d), "doc")
    both = scoring.slices(both, {"urgent": F.col("urgent"), "multiline": F.col("rows_gold") > 1})
    return _rounded(scoring.overall(both, ["slice"])).select("slice", *_KEPT)


def row_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).groupBy("pass").agg(F.count("*").alias("n"), F.sum("left_row").alias("left_sum"), F.sum(F.col("right_row") * F.col("doc")).alias("right_sum"))


def null_confusion(spark: SparkSession, d: str) -> DataFrame:
    cells = hosts.header_cells(spark, d).join(hosts.groups(spark, d), "doc")
    return _rounded(scoring.null_confusion(cells, [[], ["field"], ["region"], ["field", "region"]]))


def over_null_counts(spark: SparkSession, d: str) -> DataFrame:
    pred, gold = hosts.pred_rows(spark, d), hosts.gold_rows(spark, d)
    cells = lambda df, s: df.select("doc", F.col("row").alias(f"{s}_row"), F.col("cpn").alias(f"{s}_cpn"), F.col("po").alias(f"{s}_po"))
    both = _pairs(spark, d).join(cells(pred, "left"), ["doc", "left_row"]).join(cells(gold, "right"), ["doc", "right_row"])
    each = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"left_{f}").alias("p"), F.col(f"right_{f}").alias("g")) for f in ("cpn", "po")])).alias("c")).select("c.*")
    return each.groupBy("field").agg(F.count_if(is_blank("p") & ~is_blank("g")).alias("over_null"), F.count_if(~is_blank("p") & is_blank("g")).alias("false_fill"), F.count("*").alias("cells"))


def fixed_broken_neutral(spark: SparkSession, d: str) -> DataFrame:
    """A rule that fills blank dates with the first of the month, against gold."""
    cells = hosts.header_cells(spark, d)
    after = rules.fill_if_blank("pred", F.concat(F.substr("gold", F.lit(1), F.lit(8)), F.lit("01")), (F.col("field") == "invoice_date") & (F.col("doc") % 2 == 0))
    cells = cells.withColumns({"before_ok": same("date", "pred", "gold"), "after": after}).withColumn("after_ok", same("date", "after", "gold"))
    return cells.groupBy("field", rules.effect("before_ok", "after_ok").alias("effect")).agg(F.count("*").alias("n"))


def slot_shape_swap(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    learn = part.where("p_partkey % 5 <> 0").select(F.col("p_brand").alias("cpn"), F.concat(F.lit("PO-"), "p_size").alias("po"))
    lone = F.expr("p_partkey % 4 = 1")
    both = part.select("p_partkey", F.when(lone, F.concat(F.lit("PO-"), "p_size")).when(F.expr("p_partkey % 4 = 2"), F.concat(F.lit("PO-"), "p_size")).otherwise(F.col("p_brand")).alias("cpn"), F.when(lone, F.lit(None)).when(F.expr("p_partkey % 4 = 2"), F.col("p_brand")).otherwise(F.concat(F.lit("PO-"), "p_size")).alias("po"))
    out = rules.swap_by_shape(both, "cpn", "po", rules.learn_exclusive_shapes(learn, "cpn", "po"))
    return out.groupBy("change").agg(F.count("*").alias("n"), F.count("cpn").alias("cpn_filled"), F.count("po").alias("po_filled"), F.count_if(F.col("po").startswith("PO-")).alias("po_right"))


def unique_pattern_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = docs.select("doc_id", rules.unique_match("text", r"[0-9]{16}").alias("number"), rules.unique_match("text", r"[a-z0-9.]+@[a-z0-9.]+").alias("mail"))
    return found.where("number IS NOT NULL OR mail IS NOT NULL")


def rule_records(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    rec = rules.records(o, "o_orderkey", [("R1", "carrier", F.expr("o_orderkey % 7 = 0")), ("R2", "mawb", F.expr("o_orderkey % 5 = 0")), ("R3", "cpn_po", F.col("o_orderstatus") == "P")])
    return rec.groupBy("rule", "field").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("docs"))


def gate_select_slot(spark: SparkSession, d: str) -> DataFrame:
    c = hosts.header_cells(spark, d).withColumns({"pa": F.expr("doc % 10 / 10.0D"), "pb": F.expr("doc % 7 / 7.0D")})
    return c.withColumn("out", rules.select_slot("pred", "gold", "pa", "pb")).groupBy("field").agg(
        F.count("out").alias("filled"), F.count_if(F.col("out") == F.col("pred")).alias("from_a"), F.count_if(F.col("out") == F.col("gold")).alias("from_b")
    )


def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = hosts.gold_rows(spark, d).select(F.concat_ws("-", "doc", "row").alias("key"), "spn", "cpn", "po", "qty")
    b = hosts.pred_rows(spark, d).select(F.concat_ws("-", "doc", "row").alias("key"), "spn", "cpn", "po", "qty")
    return matching.compare_runs(a, b, "key", ["spn", "cpn", "po", "qty"])


def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    c = hosts.header_cells(spark, d)
    both = matching.join_cells(c.where("doc % 9 <> 0").selectExpr("doc", "field", "gold AS value"), c.where("doc % 8 <> 0").selectExpr("doc", "field", "pred AS value"), ["doc", "field"])
    return both.groupBy("field").agg(F.count_if(F.col("in_a") & F.col("in_b")).alias("both"), F.count_if(~F.col("in_b")).alias("only_a"), F.count_if(~F.col("in_a")).alias("only_b"), F.count_if(F.col("in_a") & F.col("in_b") & F.col("a_value").eqNullSafe(F.col("b_value"))).alias("equal"))


def split_merge_rows(spark: SparkSession, d: str) -> DataFrame:
    gold = hosts.gold_rows(spark, d).withColumn("q", F.col("qty") / 100)
    one = gold.where("part % 3 = 0").groupBy("doc", "spn").agg(F.sum("q").alias("q"), F.max("row").alias("row"))
    return scoring.split_merge(one, gold, "doc", "spn", "q").select("doc", "spn", F.round("total", 2).alias("total"), "parts")


def concentration_top5(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.concentration(table(spark, d, "lineitem"), "l_suppkey"))


def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return scoring.top_groups(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber")


def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return sharding.quota_sample(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 20).select("o_orderpriority", "o_orderkey")


def id_integrity(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    found = li.select(F.col("l_orderkey").alias("id")).where("id % 3 <> 1 OR id > 300")
    return integrity.check_ids(found, o.select(F.col("o_orderkey").alias("id")), "id").groupBy("problem").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def partition_check(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    parts = o.where("id % 3 = 0").unionByName(o.where("id % 3 = 1")).unionByName(o.where("id % 3 = 2 OR id % 50 = 0"))
    return integrity.check_partition(parts, o, "id")


def split_leak(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("side", F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train"))
    return integrity.split_leaks(o, "o_custkey", "side").select("o_custkey", "sides", "n")


def no_synthesis(spark: SparkSession, d: str) -> DataFrame:
    c = hosts.header_cells(spark, d)
    out = c.select("doc", "field", F.when(F.expr("doc % 13 = 0"), "made up").otherwise(F.col("pred")).alias("value"))
    bad = integrity.no_synthesis(out, [c.selectExpr("doc", "field", "gold AS value"), c.selectExpr("doc", "field", "pred AS value")], ["doc", "field"])
    return bad.groupBy("field").agg(F.count("*").alias("n"))


def forward_backward_page(spark: SparkSession, d: str) -> DataFrame:
    rows = hosts.gold_rows(spark, d).withColumn("page", F.when(F.expr("(doc + row) % 4 < 2"), F.expr("row DIV 3")))
    return layout.fill_pages(rows, "doc", "row", "page").groupBy("source").agg(F.count("*").alias("n"), F.sum("resolved").alias("pages"))


def log_repair(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("step", F.expr("event_id % 37"))
    return integrity.repair_log(e, ["user_id"], "step", "event_id").select("user_id", "event_id", "step")


def step_problems(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("step", F.expr("event_id % 5 + 1"))
    return integrity.step_problems(e, ["user_id"], "step", "event_id")


def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    o = sharding.batches(table(spark, d, "orders"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], 16)
    return o.groupBy("o_orderpriority", "batch").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def shard_deal(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), (F.col("l_orderkey") % 4).alias("g"))
    return sharding.deal(n, ["g"], "n", "l_orderkey", 5).groupBy("g", "shard").agg(F.sum("n").alias("rows"), F.count("*").alias("docs"))


def doc_windows(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("lane", F.col("l_orderkey") % 16)
    return sharding.windows(n, "lane", "l_orderkey", "n", 24)


def shape_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(shape_of("p_brand").alias("shape")).agg(F.count("*").alias("n"), F.min("p_brand").alias("first"))


QUERIES = {f.__name__: f for f in (
    match_rows_f1, overall_by_slice, row_pairs, null_confusion, over_null_counts, fixed_broken_neutral, slot_shape_swap, unique_pattern_backfill, rule_records, gate_select_slot, run_agreement, cell_diff,
    split_merge_rows, concentration_top5, top_groups, quota_sample, id_integrity, partition_check, split_leak, no_synthesis, forward_backward_page, log_repair, step_problems, plan_batches, shard_deal, doc_windows, shape_profile,
)}

_BLANK = lambda c: f"({c} IS NULL OR trim({c}) = '')"
_CONF = f"""CAST(count(*) AS BIGINT) AS cells, CAST(sum(({_BLANK('gold')})::INT) AS BIGINT) AS gold_null, CAST(sum(({_BLANK('pred')})::INT) AS BIGINT) AS pred_null,
CAST(sum(({_BLANK('gold')} AND {_BLANK('pred')})::INT) AS BIGINT) AS true_null, CAST(sum((NOT {_BLANK('gold')} AND {_BLANK('pred')})::INT) AS BIGINT) AS over_null, CAST(sum(({_BLANK('gold')} AND NOT {_BLANK('pred')})::INT) AS BIGINT) AS false_fill"""
SQL = {
    "match_rows_f1": sql((*SCORES, "grp"), f"SELECT region, {_SCORES_SQL} FROM docs JOIN grp USING (doc) GROUP BY region"),
    "overall_by_slice": sql((*SCORES, "grp"), f"SELECT slice, {_SCORES_SQL} FROM (SELECT *, unnest(['all', 'urgent=' || CASE WHEN urgent THEN 'yes' ELSE 'no' END, 'multiline=' || CASE WHEN rows_gold > 1 THEN 'yes' ELSE 'no' END]) AS slice FROM docs JOIN grp USING (doc)) GROUP BY slice"),
    "row_pairs": sql(PAIRS, "SELECT pass, count(*) AS n, CAST(sum(left_row) AS BIGINT) AS left_sum, CAST(sum(right_row * doc) AS BIGINT) AS right_sum FROM pairs GROUP BY pass"),
    "null_confusion": sql(("head", "grp"), f"SELECT *, round(true_null / nullif(pred_null, 0)::DOUBLE, 6) AS null_precision, round(true_null / nullif(gold_null, 0)::DOUBLE, 6) AS null_recall FROM (SELECT field, region, {_CONF} FROM head JOIN grp USING (doc) GROUP BY GROUPING SETS ((), (field), (region), (field, region)))"),
    "over_null_counts": sql(PAIRS, "SELECT field, CAST(sum((p IS NULL AND g IS NOT NULL)::INT) AS BIGINT) AS over_null, CAST(sum((p IS NOT NULL AND g IS NULL)::INT) AS BIGINT) AS false_fill, count(*) AS cells FROM (SELECT 'cpn' AS field, pred.cpn AS p, gold.cpn AS g FROM pairs JOIN pred ON pairs.doc = pred.doc AND left_row = pred.row JOIN gold ON pairs.doc = gold.doc AND right_row = gold.row UNION ALL SELECT 'po', pred.po, gold.po FROM pairs JOIN pred ON pairs.doc = pred.doc AND left_row = pred.row JOIN gold ON pairs.doc = gold.doc AND right_row = gold.row) GROUP BY field"),
    "fixed_broken_neutral": sql(("head",), f"SELECT field, CASE WHEN NOT b AND a THEN 'fixed' WHEN b AND NOT a THEN 'broken' ELSE 'neutral' END AS effect, count(*) AS n FROM (SELECT field, coalesce(pred = gold, false) OR ({_BLANK('pred')} AND {_BLANK('gold')}) AS b, coalesce(aft = gold, false) OR ({_BLANK('aft')} AND {_BLANK('gold')}) AS a FROM (SELECT *, CASE WHEN {_BLANK('pred')} AND field = 'invoice_date' AND doc % 2 = 0 THEN substr(gold, 1, 8) || '01' ELSE pred END AS aft FROM head)) GROUP BY ALL"),
    "slot_shape_swap": """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'PO-' || p_size ELSE p_brand END AS c, CASE WHEN p_partkey % 4 = 1 THEN NULL WHEN p_partkey % 4 = 2 THEN p_brand ELSE 'PO-' || p_size END AS p FROM part),
f AS (SELECT regexp_replace(regexp_replace(p_brand, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS sh FROM part WHERE p_partkey % 5 <> 0), g AS (SELECT regexp_replace(regexp_replace('PO-' || p_size, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS sh FROM part WHERE p_partkey % 5 <> 0),
co AS (SELECT sh FROM f EXCEPT SELECT sh FROM g), po AS (SELECT sh FROM g EXCEPT SELECT sh FROM f),
x AS (SELECT *, regexp_replace(regexp_replace(c, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') IN (SELECT sh FROM po) AS ca, coalesce(regexp_replace(regexp_replace(p, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') IN (SELECT sh FROM co), false) AS pa FROM s),
y AS (SELECT *, CASE WHEN c IS NOT NULL AND p IS NULL AND ca THEN 'moved_to_po' WHEN p IS NOT NULL AND c IS NULL AND pa THEN 'moved_to_cpn' WHEN ca AND pa THEN 'swapped' END AS change FROM x),
z AS (SELECT change, CASE WHEN change = 'moved_to_po' THEN NULL WHEN change IS NOT NULL THEN p ELSE c END AS c, CASE WHEN change = 'moved_to_cpn' THEN NULL WHEN change IS NOT NULL THEN c ELSE p END AS p FROM y)
SELECT change, count(*) AS n, count(c) AS cpn_filled, count(p) AS po_filled, CAST(coalesce(sum((p LIKE 'PO-%')::INT), 0) AS BIGINT) AS po_right FROM z GROUP BY change""",
    "unique_pattern_backfill": """WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{16}')) AS a, list_distinct(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) = 1 THEN a[1] END AS number, CASE WHEN len(b) = 1 THEN b[1] END AS mail FROM m WHERE len(a) = 1 OR len(b) = 1""",
    "rule_records": "SELECT rule, field, count(*) AS n, count(DISTINCT o_orderkey) AS docs FROM (SELECT o_orderkey, 'R1' AS rule, 'carrier' AS field FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'R2', 'mawb' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'R3', 'cpn_po' FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL",
    "gate_select_slot": sql(("head",), f"SELECT field, count(v) AS filled, CAST(sum((v = pred)::INT) AS BIGINT) AS from_a, CAST(sum((v = gold)::INT) AS BIGINT) AS from_b FROM (SELECT *, CASE WHEN NOT {_BLANK('pred')} AND {_BLANK('gold')} THEN CASE WHEN doc % 10 >= 5 THEN pred END WHEN {_BLANK('pred')} AND NOT {_BLANK('gold')} THEN CASE WHEN (doc % 7) * 2 >= 7 THEN gold END WHEN {_BLANK('pred')} THEN NULL WHEN (doc % 10) * 7 > (doc % 7) * 10 THEN pred ELSE gold END AS v FROM head) GROUP BY field"),
    "run_agreement": sql(("gold", "pred0", "pred"), "SELECT CAST(sum((p.doc IS NOT NULL AND g.doc IS NOT NULL AND e)::INT) AS BIGINT) AS identical, CAST(sum((p.doc IS NOT NULL AND g.doc IS NOT NULL AND NOT e)::INT) AS BIGINT) AS different, CAST(sum((p.doc IS NULL)::INT) AS BIGINT) AS only_first, CAST(sum((g.doc IS NULL)::INT) AS BIGINT) AS only_second FROM (SELECT p.doc AS pd, g.doc AS gd, g.spn = p.spn AND g.cpn IS NOT DISTINCT FROM p.cpn AND g.po IS NOT DISTINCT FROM p.po AND g.qty = p.qty AS e FROM gold g FULL JOIN pred p ON g.doc = p.doc AND g.row = p.row) t, LATERAL (SELECT t.pd AS doc) p, LATERAL (SELECT t.gd AS doc) g"),
    "cell_diff": sql(("head",), "SELECT coalesce(a.field, b.field) AS field, CAST(sum((a.doc IS NOT NULL AND b.doc IS NOT NULL)::INT) AS BIGINT) AS both, CAST(sum((b.doc IS NULL)::INT) AS BIGINT) AS only_a, CAST(sum((a.doc IS NULL)::INT) AS BIGINT) AS only_b, CAST(sum((a.doc IS NOT NULL AND b.doc IS NOT NULL AND a.gold IS NOT DISTINCT FROM b.pred)::INT) AS BIGINT) AS equal FROM (SELECT * FROM head WHERE doc % 9 <> 0) a FULL JOIN (SELECT * FROM head WHERE doc % 8 <> 0) b ON a.doc = b.doc AND a.field = b.field GROUP BY 1"),
    "split_merge_rows": sql(("gold",), "SELECT g.doc, g.spn, round(sum(g.qty) / 100, 2) AS total, count(*) AS parts FROM gold g WHERE part % 3 = 0 GROUP BY g.doc, g.spn HAVING count(*) > 1"),
    "concentration_top5": "WITH p AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS top FROM (SELECT n FROM p ORDER BY n DESC, l_suppkey LIMIT 5)) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS keys, CAST(max(top) AS BIGINT) AS top, round(max(top) / sum(n)::DOUBLE, 6) AS share FROM p, t",
    "top_groups": "SELECT l_suppkey, count(*) AS rows, CAST(sum(l_linenumber) AS BIGINT) AS cells, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY 1 ORDER BY cells DESC, 1 LIMIT 6",
    "quota_sample": "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 20",
    "id_integrity": "WITH f AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 1 OR l_orderkey > 300 GROUP BY 1) SELECT problem, count(*) AS n, min(id) AS first FROM (SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' END AS problem FROM orders LEFT JOIN f ON o_orderkey = id) WHERE problem IS NOT NULL GROUP BY problem",
    "partition_check": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(sum((o_orderkey % 50 = 0 AND o_orderkey % 3 <> 2)::INT) AS BIGINT) AS duplicate, sum((o_orderkey % 50 = 0 AND o_orderkey % 3 <> 2)::INT) = 0 AS ok FROM orders",
    "split_leak": "SELECT o_custkey, count(DISTINCT o_orderkey % 4 = 0) AS sides, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 4 = 0) > 1 OR o_custkey IS NULL",
    "no_synthesis": sql(("head",), "SELECT field, count(*) AS n FROM head WHERE doc % 13 = 0 GROUP BY field"),
    "forward_backward_page": sql(("gold",), "SELECT source, count(*) AS n, CAST(sum(CASE WHEN source = 'ambiguous' THEN NULL ELSE coalesce(page, b, a) END) AS BIGINT) AS pages FROM (SELECT *, CASE WHEN page IS NOT NULL THEN 'assigned' WHEN a = b THEN 'between' WHEN b IS NULL AND a IS NOT NULL THEN 'next' WHEN a IS NULL AND b IS NOT NULL THEN 'previous' ELSE 'ambiguous' END AS source FROM (SELECT *, last_value(page IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(page IGNORE NULLS) OVER (PARTITION BY doc ORDER BY row ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (SELECT *, CASE WHEN (doc + row) % 4 < 2 THEN row // 3 END AS page FROM gold))) GROUP BY source"),
    "log_repair": "SELECT user_id, event_id, step FROM (SELECT *, min(step) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM (SELECT *, event_id % 37 AS step FROM events)) WHERE nx IS NULL OR nx > step",
    "step_problems": "SELECT user_id, CAST(sum((step > back + 1)::INT) AS BIGINT) AS gaps, count(step) - count(DISTINCT step) AS duplicates, CAST(sum((step <= back)::INT) AS BIGINT) AS backwards FROM (SELECT *, coalesce(lag(step) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS back FROM (SELECT *, event_id % 5 + 1 AS step FROM events)) GROUP BY user_id",
    "plan_batches": "SELECT o_orderpriority, batch, count(*) AS n, max(o_orderkey) AS last FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1) // 16 AS batch FROM orders) GROUP BY ALL",
    "shard_deal": "SELECT g, CASE WHEN lane < 5 THEN lane ELSE 9 - lane END::INT AS shard, CAST(sum(n) AS BIGINT) AS rows, count(*) AS docs FROM (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY n DESC, l_orderkey) - 1) % 10 AS lane FROM (SELECT l_orderkey, l_orderkey % 4 AS g, count(*) AS n FROM lineitem GROUP BY 1)) GROUP BY 1, 2",
    "shape_profile": "SELECT regexp_replace(regexp_replace(p_brand, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n, min(p_brand) AS first FROM part GROUP BY 1",
}
