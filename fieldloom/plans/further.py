"""Queries on whole documents: records, tags, readings, recall, agreement, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import documents, rules
from fieldloom.plans import hosts
from fieldloom.plans.coverage import _PB, _SAME
from fieldloom.plans.hosts import sql
from fieldloom.sources.tables import table


def normalized_records(spark: SparkSession, d: str) -> DataFrame:
    """Orders with printed dates and totals and coded rows: normalised, with flags by path."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    head = F.struct(F.date_format("day", "d MMMM yyyy").alias("day"), F.concat(F.lit("EUR "), F.expr("cents DIV 100").cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")).alias("total"), F.when(F.expr("doc % 3 = 0"), " ").otherwise("ham hamburg").alias("port"))
    items = hosts.gold_rows(spark, d).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "spn", "qty"))), lambda r: F.struct(F.lower(r["spn"]).alias("spn"), F.concat(r["qty"].cast("string"), F.lit(" pcs")).alias("qty"))).alias("line_items"))
    out = documents.normalized(o.withColumn("header", head).join(items, "doc"), "header", {"day": "date", "total": "number", "port": "airport"}, "line_items", {"spn": "code", "qty": "number"})
    return out.select("doc", "header.*", F.array_join(F.transform("line_items", lambda r: F.concat_ws("=", r["spn"], r["qty"])), ",").alias("rows"), F.array_join(F.transform(F.array_sort(F.map_entries("flags")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("flags"))


def number_readings(spark: SparkSession, d: str) -> DataFrame:
    """Prices printed in six ways, two of them with misread separators: what each may mean."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.round(F.col("o_totalprice") * 100).cast("long") + 100_000_000).alias("cents"))
    a, b, e, f = F.expr("(cents DIV 100) DIV 1000000"), F.expr("((cents DIV 100) DIV 1000) % 1000"), F.expr("(cents DIV 100) % 1000"), F.expr("cents % 100")
    z = lambda x, n: F.lpad(x.cast("string"), n, "0")
    t = [F.concat(a, F.lit(s[0]), z(b, 3), F.lit(s[1]), z(e, 3), F.lit(s[2]), z(f, 2)) for s in ((",", ",", "."), (".", ".", ","), (",", ".", ","), (".", ".", "."))]
    t += [F.concat(a, F.lit("."), z(b, 3)), F.concat(a, F.lit(","), z(e, 3), F.lit(","), z(f, 2))]
    way, raw = F.col("doc") % 6, F.lit(None).cast("string")
    for k, v in enumerate(t):
        raw = F.when(way == k, v).otherwise(raw)
    o = o.withColumn("raw", raw)
    show = lambda x: F.array_join(F.transform(x, lambda v: F.format_string("%.3f", v)), "|")
    return o.select("doc", show(documents.number_readings("raw")).alias("readings"), show(documents.repaired_readings("raw")).alias("repaired"))


def document_tags(spark: SparkSession, d: str) -> DataFrame:
    t = documents.tags(hosts.header_cells(spark, d), "doc", "field", "pred", ["currency"], ["total_amount"])
    return t.groupBy("illegible", "absent").agg(F.count("*").alias("n"))


def flagged_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("p"))
    return p.groupBy(documents.flagged_path("p", ["es", "fr"], [".html", "/"]).alias("why")).agg(F.count("*").alias("n"))


def unseen_groups(spark: SparkSession, d: str) -> DataFrame:
    g = hosts.groups(spark, d)
    folds = g.select("doc", F.when(F.expr("doc % 2 = 0 AND grp < 20"), F.lit(0)).otherwise(F.expr("grp % 3")).alias("fold"))
    out = documents.fold_meta(g.select("doc", "grp"), folds, "doc", "grp", 1)
    return out.groupBy("grp", "unseen").agg(F.count("*").alias("n"))


def one_value_nulled(spark: SparkSession, d: str) -> DataFrame:
    i = hosts.gold_rows(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("row", "spn"))).alias("items"))
    out = i.withColumn("items", documents.with_null("items", F.expr("cast(doc % 3 as int)"), "spn"))
    return out.select("doc", F.array_join(F.transform("items", lambda r: r["spn"]), ",", "-").alias("spns"))


def arm_agreement(spark: SparkSession, d: str) -> DataFrame:
    out = documents.agreement(hosts.pred_rows(spark, d), hosts.gold_rows(spark, d), "doc", "row", ["spn", "cpn", "po", "qty"])
    return out.select("doc", "row", "field", "agree", F.round("row_share", 6).alias("row_share"), F.round("doc_share", 6).alias("doc_share"))


def half_sample_interval(spark: SparkSession, d: str) -> DataFrame:
    """The share of right labels and its interval by half samples."""
    share = lambda df: df.groupBy("draw").agg(F.avg(F.col("y").cast("double")).alias("x"))
    out = documents.half_sample_interval(hosts.scored(spark, d).select("doc", "y"), "doc", share, 20)
    return out.select(*[F.round(c, 6).alias(c) for c in ("x", "lo", "hi")])


def cause_counts(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).where(~text.same_value("gold", "pred"))
    h = h.select("field", F.when(text.is_blank("pred"), "over_null").when(text.is_blank("gold"), "false_fill").otherwise("wrong").alias("cause"))
    return documents.cause_cube(h, ["field", "cause"])


def groups_with_both(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return documents.groups_with_all(o, "o_custkey", "o_orderstatus", ["F", "O"])


def line_crossing_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of words of a conversation that cross from one turn to the next."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.slice(F.split(F.trim(F.replace("text", F.lit("ß"), F.lit("s"))), r"\s+"), 1, 1_000_000)).alias("place", "word"))
    out = documents.line_crossing_runs(c, ["conv_id"], "turn", "place", "word", 3)
    return out.groupBy("conv_id", "first_line", "last_line").agg(F.count("*").alias("n"), F.max("run").alias("last"))


def recall_levels(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).where(~text.is_blank("gold"))
    out = documents.recall_levels(h, [F.col("gold") == F.col("pred"), F.lower(F.trim("gold")) == F.lower(F.trim("pred")), F.levenshtein("gold", "pred") <= 2], ["field"])
    return out.select("field", "n", *[F.round(f"level_{k}", 6).alias(f"level_{k}") for k in (1, 2, 3)])


def chosen_threshold(spark: SparkSession, d: str) -> DataFrame:
    out = documents.choose_threshold(hosts.scored(spark, d).withColumn("pos", F.col("y") == 1), "s", "pos", [k / 20 for k in range(20)], 0.05)
    return out.select(*[F.round(c, 6).alias(c) for c in ("t", "false_rate", "found")])


def restoring_rules(spark: SparkSession, d: str) -> DataFrame:
    """Saved cells are the base's with dates or totals put right; which rule alone restores them."""
    h = hosts.header_cells(spark, d)
    cell = lambda c: h.select("doc", "field", c.alias("value"))
    fix = lambda f: F.when(F.col("field") == f, F.col("gold")).otherwise(F.col("pred"))
    saved = F.when((F.expr("doc % 2 = 0") & (F.col("field") == "invoice_date")) | (F.col("field") == "total_amount"), F.col("gold")).otherwise(F.col("pred"))
    out = documents.restoring_rule(cell(saved), cell(F.col("pred")), {"dates": cell(fix("invoice_date")), "totals": cell(fix("total_amount"))}, ["doc", "field"], "doc")
    return out.groupBy(F.array_join("rules", "+").alias("rules")).agg(F.count("*").alias("n"))


def recomposed_headline(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).join(hosts.groups(spark, d).select("doc", "region"), "doc").withColumn("ok", text.same_value("gold", "pred"))
    out = documents.recomposed(h, ["region"], "field", "ok")
    return out.select("region", F.round("headline", 6).alias("headline"), F.round("recomposed", 6).alias("recomposed"), "agree")


def keyed_entries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("v", F.col("event_id") % 1000)
    out = documents.keyed(e, "user_id", "event_type", "v")
    return out.select("user_id", F.array_join(F.transform(F.map_entries("entries"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",").alias("entries"))


def oracle_selection(spark: SparkSession, d: str) -> DataFrame:
    """Of two arms the slot that gold says is right: an upper bound."""
    h = hosts.header_cells(spark, d).withColumn("other", F.when(F.expr("doc % 3 > 0"), F.col("gold")))
    ok = lambda x: text.same_value("gold", x).cast("double")
    h = h.withColumns({"pa": ok("pred"), "pb": ok("other")})
    best = h.withColumn("best", rules.select_slot("pred", "other", "pa", "pb"))
    return best.groupBy("field").agg(*[F.count_if(text.same_value("gold", c)).alias(c) for c in ("pred", "other", "best")])


QUERIES = {f.__name__: f for f in (
    normalized_records, number_readings, document_tags, flagged_paths, unseen_groups, one_value_nulled, arm_agreement, half_sample_interval, cause_counts, groups_with_both, line_crossing_runs, recall_levels,
    chosen_threshold, restoring_rules, recomposed_headline, keyed_entries, oracle_selection,
)}

_GB = "coalesce(trim(gold), '') = ''"
_Z = lambda x, n: f"lpad(CAST({x} AS VARCHAR), {n}, '0')"
SQL = {
    "normalized_records": sql(("gold",), "SELECT doc, strftime(o_orderdate, '%Y-%m-%d') AS day, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS total, CASE WHEN doc % 3 > 0 THEN 'HAM' END AS port, rows, CASE WHEN doc % 3 = 0 THEN 'header.port:empty_to_null' ELSE 'header.port:airport_city_stripped' END || ',header.total:number_decimal_comma' AS flags FROM (SELECT *, o_orderkey AS doc, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) JOIN i USING (doc)", i="SELECT doc, string_agg(spn || '=' || qty, ',' ORDER BY row) AS rows FROM gold GROUP BY doc"),
    "number_readings": f"""WITH o AS (SELECT o_orderkey AS doc, o_orderkey % 6 AS way, CAST(round(o_totalprice * 100) AS BIGINT) + 100000000 AS cents FROM orders), p AS (SELECT doc, way, cents / 100.0::DOUBLE AS v, (cents // 100) // 1000000 AS a, ((cents // 100) // 1000) % 1000 AS b, (cents // 100) % 1000 AS e, cents % 100 AS f FROM o)
SELECT doc, CASE WHEN way IN (0, 1) THEN printf('%.3f', v) WHEN way = 4 THEN printf('%.3f', (a || '.' || {_Z('b', 3)})::DOUBLE) || '|' || printf('%.3f', (a * 1000 + b)::DOUBLE) ELSE '' END AS readings, CASE WHEN way IN (2, 3) THEN printf('%.3f', v) WHEN way = 5 THEN printf('%.3f', (a || {_Z('e', 3)} || '.' || {_Z('f', 2)})::DOUBLE) ELSE '' END AS repaired FROM p""",
    "document_tags": sql(("head",), f"SELECT illegible, absent, count(*) AS n FROM (SELECT doc, bool_or({_PB} AND field <> 'currency') AS illegible, bool_or({_PB} AND field = 'total_amount') AS absent FROM head GROUP BY doc) GROUP BY 1, 2"),
    "flagged_paths": "WITH p AS (SELECT lower(regexp_replace(url, '^https?://', '')) AS p FROM pages) SELECT CASE WHEN starts_with(p, 'es/') OR contains(p, '/es/') OR starts_with(p, 'fr/') OR contains(p, '/fr/') THEN 'folder' WHEN p LIKE '%.html' OR p LIKE '%/' THEN 'suffix' END AS why, count(*) AS n FROM p GROUP BY 1",
    "unseen_groups": sql(("grp",), "SELECT grp, grp NOT IN (SELECT grp FROM f WHERE fold <> 1) AS unseen, count(*) AS n FROM f WHERE fold = 1 GROUP BY 1, 2", f="SELECT doc, grp, CASE WHEN doc % 2 = 0 AND grp < 20 THEN 0 ELSE grp % 3 END AS fold FROM (SELECT doc, grp FROM grp)"),
    "one_value_nulled": sql(("gold",), "SELECT doc, string_agg(CASE WHEN row - 1 = doc % 3 THEN '-' ELSE spn END, ',' ORDER BY row) AS spns FROM gold GROUP BY doc"),
    "arm_agreement": sql(("gold", "pred0", "pred"), "SELECT doc, row, field, agree, round(avg(agree::INT) OVER (PARTITION BY doc, row), 6) AS row_share, round(avg(agree::INT) OVER (PARTITION BY doc), 6) AS doc_share FROM x", x="SELECT p.doc, p.row, unnest(['spn', 'cpn', 'po', 'qty']) AS field, unnest([p.spn = g.spn, p.cpn IS NOT DISTINCT FROM g.cpn, p.po IS NOT DISTINCT FROM g.po, p.qty = g.qty]) AS agree FROM pred p JOIN gold g ON p.doc = g.doc AND p.row = g.row"),
    "half_sample_interval": sql(("sc",), "SELECT round(any_value(c), 6) AS x, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (SELECT c, c + (x - c) * sqrt(m / n) AS v FROM s, w)", w="SELECT avg(y)::DOUBLE AS c, count(*)::DOUBLE AS n FROM sc", s="SELECT draw, avg(y)::DOUBLE AS x, count(*) AS m FROM sc, (SELECT unnest(range(1, 21)) AS draw) WHERE CAST('0x' || substr(md5(draw || '|' || doc), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE >= 0.36787944117144233 GROUP BY draw"),
    "cause_counts": sql(("head",), "SELECT coalesce(field, '(all)') AS field, coalesce(cause, '(all)') AS cause, count(*) AS n FROM e GROUP BY CUBE (field, cause)", e=f"SELECT field, CASE WHEN {_PB} THEN 'over_null' WHEN {_GB} THEN 'false_fill' ELSE 'wrong' END AS cause FROM head WHERE NOT ({_SAME})"),
    "groups_with_both": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O')",
    "line_crossing_runs": "WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(trim(replace(text, 'ß', 's')), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(replace(text, 'ß', 's')), '\\s+'), 1) AS place FROM conversations), l AS (SELECT conv_id, turn, word, lead(turn, 1) OVER o AS t1, lead(word, 1) OVER o AS w1, lead(turn, 2) OVER o AS t2, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY turn, place)), r AS (SELECT conv_id, turn AS first_line, t1 AS last_line, word || w1 AS run FROM l UNION ALL SELECT conv_id, turn, t2, word || w1 || w2 FROM l) SELECT conv_id, first_line, last_line, count(*) AS n, max(upper(run)) AS last FROM r WHERE last_line > first_line AND run IS NOT NULL GROUP BY 1, 2, 3",
    "recall_levels": sql(("head",), f"SELECT field, count(*) AS n, round(avg(coalesce(gold = pred, false)::INT), 6) AS level_1, round(avg(coalesce(gold = pred OR lower(trim(gold)) = lower(trim(pred)), false)::INT), 6) AS level_2, round(avg(coalesce(gold = pred OR lower(trim(gold)) = lower(trim(pred)) OR levenshtein(gold, pred) <= 2, false)::INT), 6) AS level_3 FROM head WHERE NOT {_GB} GROUP BY field"),
    "chosen_threshold": sql(("sc",), "SELECT round(t, 6) AS t, round(f, 6) AS false_rate, round(g, 6) AS found FROM (SELECT k / 20.0::DOUBLE AS t, avg((s >= k / 20.0::DOUBLE)::INT) FILTER (WHERE y <> 1) AS f, avg((s >= k / 20.0::DOUBLE)::INT) FILTER (WHERE y = 1) AS g FROM sc, (SELECT unnest(range(20)) AS k) GROUP BY k) WHERE f <= 0.05 ORDER BY t LIMIT 1"),
    "restoring_rules": sql(("head",), "SELECT CASE WHEN NOT dd AND tt THEN 'totals' WHEN dd AND NOT tt THEN 'dates' ELSE '' END AS rules, count(*) AS n FROM d WHERE dd OR tt GROUP BY 1", d=f"SELECT doc, bool_or(field = 'invoice_date' AND doc % 2 = 0 AND NOT ({_SAME})) AS dd, bool_or(field = 'total_amount' AND NOT ({_SAME})) AS tt, bool_or(field = 'invoice_date' AND doc % 2 = 1 AND NOT ({_SAME})) AS odd FROM head GROUP BY doc"),
    "recomposed_headline": sql(("head", "grp"), f"SELECT region, round(avg(({_SAME})::INT), 6) AS headline, round(avg(({_SAME})::INT), 6) AS recomposed, true AS agree FROM head JOIN grp USING (doc) GROUP BY 1"),
    "keyed_entries": "SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS entries FROM (SELECT user_id, event_type, max(event_id % 1000) AS v FROM events GROUP BY 1, 2) GROUP BY 1",
    "oracle_selection": sql(("head",), f"SELECT field, count(*) FILTER (WHERE {_SAME}) AS pred, count(*) FILTER (WHERE doc % 3 > 0 OR {_GB}) AS other, count(*) FILTER (WHERE {_SAME} OR doc % 3 > 0 OR {_GB}) AS best FROM head GROUP BY field"),
}
