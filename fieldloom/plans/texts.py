"""Queries on text: normalisation, page merge, layout, location, JSON, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates, numbers, similarity, text
from fieldloom.operators import integrity, json_pages, layout, matching, merging, scoring, sharding
from fieldloom.plans import hosts
from fieldloom.plans.hosts import sql
from fieldloom.sources.tables import table


def normalize_date_order(spark: SparkSession, d: str) -> DataFrame:
    """Order dates printed by group (day first, month first, dotted, ISO), read back."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 4).alias("grp"), F.to_date("o_orderdate").alias("day"))
    printed = F.when(F.col("grp") == 0, F.date_format("day", "dd/MM/yyyy")).when(F.col("grp") == 1, F.date_format("day", "MM-dd-yyyy")).when(F.col("grp") == 2, F.date_format("day", "d.M.yyyy")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    o = o.withColumn("raw", F.when(F.expr("doc % 50 = 0"), F.lit("31/02/1999")).otherwise(printed))
    o = o.join(F.broadcast(dates.infer_order(o, "grp", "raw")), "grp", "left")
    return o.select("doc", dates.normalize_date("raw", "date_order").alias("n")).select("doc", "n.value", "n.flag")


def ambiguous_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("raw"))
    return o.select("doc", dates.normalize_date("raw").alias("n")).select("doc", "n.value", "n.flag")


def normalize_number_flags(spark: SparkSession, d: str) -> DataFrame:
    """Prices printed five ways and read back: values and flags by way."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    whole, part, way = F.expr("cents DIV 100").cast("string"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.col("doc") % 5
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), cents.alias("cents"))
    group = lambda sep: F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", sep)
    raw = (
        F.when(way == 0, F.concat(F.lit("USD "), group(","), F.lit("."), part)).when(way == 1, F.concat(group("."), F.lit(","), part)).when(way == 2, F.concat(group(" "), F.lit(","), part))
        .when(way == 3, group(",")).otherwise(F.concat(F.lit("EUR"), whole, F.lit("."), part))
    )
    return o.select("doc", numbers.normalize_number(raw).alias("n")).select("doc", "n.value", "n.flag")


def mawb_checks(spark: SparkSession, d: str) -> DataFrame:
    serial = F.lpad((F.col("o_orderkey") * 7919 % 10000000).cast("string"), 7, "0")
    code = F.concat(F.lit("020-"), serial, F.lit(" "), ((F.col("o_orderkey") * 7919 % 10000000) % 7 + F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)).cast("string"))
    return table(spark, d, "orders").groupBy(numbers.mawb_check(F.when(F.col("o_orderkey") % 9 != 0, code)).alias("result")).agg(F.count("*").alias("n"))


def keys_and_masks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer")
    name = F.concat(F.lit(" "), "c_name", F.lit(" / x_"), F.col("c_custkey").cast("string"))
    return n.select("c_custkey", text.alnum_key(name).alias("k"), text.id_key(name).alias("id"), text.shape_of(name).alias("shape"), text.mask(name).alias("masked"), text.sha16("c_name").alias("digest"))


def misread_classes(spark: SparkSession, d: str) -> DataFrame:
    """Part names against changed ones: what kind of edit it was."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("gold"))
    k = F.col("p_partkey") % 5
    pred = F.when(k == 0, F.concat("gold", F.lit("-"))).when(k == 1, F.concat("gold", F.lit("0"))).when(k == 2, F.reverse("gold")).when(k == 3, F.concat(F.lit("X"), F.substr("gold", F.lit(2), F.lit(99)))).otherwise(F.col("gold"))
    p = p.withColumn("pred", pred)
    return p.groupBy(text.is_misread("pred", "gold").alias("misread"), (scoring.edit_class("pred", "gold") == "punctuation_only").alias("same_key")).agg(F.count("*").alias("n"))


def merge_vote_last_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as pages: the first one's text, the last text of an assistant,
    the most frequent role."""
    c = table(spark, d, "conversations").withColumn("total_amount", F.when(F.col("role") == "assistant", F.md5("text"))).withColumn("first_text", F.md5("text"))
    merged = merging.merge_headers(c, "conv_id", "turn", ["first_text"], ["total_amount"])
    voted = merging.vote(c, "conv_id", "turn", "role", ["user", "assistant"])
    return merged.join(voted, "conv_id", "left").select("conv_id", "first_text", "total_amount", "winner", "votes")


def page_disagreement(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("v", F.upper(F.substr("text", F.lit(1), F.lit(1))))
    return merging.disagreement(c.withColumn("v", F.when(F.col("v").rlike("[A-Z]"), F.col("v"))), "conv_id", "v")


def row_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("a", F.when(F.col("turn") % 3 == 1, "Part No").when(F.col("turn") % 3 == 2, " ").otherwise(F.md5("text"))).withColumn("b", F.lit(None).cast("string"))
    return merging.kept_rows(c, "conv_id", "turn", "turn", ["a", "b"]).select("conv_id", "turn", F.col("row").cast("long").alias("row"))


def reading_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """Boxes placed by arithmetic on keys, read in order."""
    g = hosts.gold_rows(spark, d).select("doc", "row", ((F.col("part") * 37 + F.col("row") * 101) % 400).cast("double").alias("x"), ((F.col("part") * 13 + F.col("row") * 57) % 90).cast("double").alias("y"))
    g = g.withColumn("y1", F.col("y") + 6 + F.col("row") % 5)
    return layout.reading_lines(g, ["doc"], "x", "y", "y1", "row").select("doc", "row", F.col("line").cast("long").alias("line"), F.col("pos").cast("long").alias("pos"))


def span_ngrams_top(spark: SparkSession, d: str) -> DataFrame:
    """Runs of up to three words of the test passages: the most frequent."""
    s = table(spark, d, "benchmark").select("item_id", F.explode(layout.ngrams(F.lower("text"), 3)).alias("s")).select("item_id", "s.*")
    return s.groupBy("n", "span").agg(F.count("*").alias("times"), F.count_distinct("item_id").alias("items")).where("times > 1")


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return integrity.contained(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "item_id")


def layout_keywords(spark: SparkSession, d: str) -> DataFrame:
    sig = layout.keyword_signature("html", {"nav": "<nav", "ad": 'class="ad"', "article": "<article", "table": "<table"}, grid=0.1)
    return table(spark, d, "pages").select("page_id", sig.alias("s")).select("page_id", *[F.col("s")[i].alias(f"s{i}") for i in range(8)])


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    g = hosts.gold_rows(spark, d)
    out = layout.regions(g, ["doc"], "row", F.expr("part % 5 = 0"), F.expr("part % 7 = 0"))
    return out.groupBy("region").agg(F.count("*").alias("n"), F.sum("row").alias("rows"))


def token_budget_lines(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.token_budget(table(spark, d, "conversations"), ["conv_id"], "turn", "text", 300)
    return out.groupBy("conv_id").agg(F.count("*").alias("kept"))


def text_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming window aggregate."""
    e = table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def lossless_json(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of event properties as printed, with a zero appended before parsing."""
    raw = F.concat(F.substr("props", F.lit(1), F.char_length("props") - 1), F.lit(', "p": 1.50, "s": "7 of 7.0"}'))
    return table(spark, d, "events").select("event_id", json_pages.parse_page(raw, "k string, p string, s string").alias("j")).select("event_id", "j.*")


def schema_error_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.explode(json_pages.schema_errors("props", ["k", "z"])).alias("error"))
    return e.groupBy("error").agg(F.count("*").alias("n"))


def salvaged_json(spark: SparkSession, d: str) -> DataFrame:
    """Records cut off at some character, salvaged; a state machine, so without SQL."""
    rec = F.concat(F.lit('{"k": {"id": '), "o_orderkey", F.lit('}, "rows": [["a", 1], ["b", 2], ["c'))
    return table(spark, d, "orders").select("o_orderkey", json_pages.salvaged(F.substr(rec, F.lit(1), F.col("o_orderkey") % 40 + 8)).alias("json"))


def json_value_spans(spark: SparkSession, d: str) -> DataFrame:
    return json_pages.spans_table(table(spark, d, "events"), "event_id", "props")


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """The most similar other part name of the same brand and size, blocked by length."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return similarity.nearest_text(p, "p_partkey", "p_name", ["p_brand", "p_size"], 60).select("p_partkey", F.round("ratio", 4).alias("ratio"))


def align_two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Four passes of alignment, one of them sequential, so without SQL."""
    out = matching.align_rows(hosts.pred_rows(spark, d), hosts.gold_rows(spark, d), "doc", "row", [F.col(c) for c in ("spn", "cpn", "po", "qty")], "spn")
    return out.groupBy("pass").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    normalize_date_order, ambiguous_dates, normalize_number_flags, mawb_checks, keys_and_masks, misread_classes, merge_vote_last_nonnull, page_disagreement, row_sources, reading_order_lines, span_ngrams_top, leak_scan,
    layout_keywords, page_regions, token_budget_lines, text_window_counts, lossless_json, schema_error_counts, salvaged_json, json_value_spans, fuzzy_names, align_two_runs,
)}

_NAME = "(' ' || c_name || ' / x_' || c_custkey)"
_AT = lambda k: f"instr(lower(html), '{k}')"
SQL = {
    "normalize_date_order": """WITH o AS (SELECT o_orderkey AS doc, o_custkey % 4 AS grp, o_orderdate AS day FROM orders), e AS (SELECT grp, max(day(day) > 12) AS one FROM o WHERE doc % 50 <> 0 GROUP BY grp)
SELECT doc, CASE WHEN doc % 50 = 0 THEN '31/02/1999' WHEN grp IN (2, 3) OR one OR day(day) > 12 OR day(day) = month(day) THEN strftime(day, '%Y-%m-%d') WHEN grp = 0 THEN strftime(day, '%d/%m/%Y') ELSE strftime(day, '%m-%d-%Y') END AS value,
CASE WHEN doc % 50 = 0 THEN 'date_unparsed' WHEN grp IN (2, 3) OR day(day) > 12 OR day(day) = month(day) THEN NULL WHEN one THEN 'date_order_inferred' ELSE 'date_ambiguous' END AS flag FROM o JOIN e USING (grp)""",
    "ambiguous_dates": "SELECT o_orderkey AS doc, CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS value, CASE WHEN day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate) THEN NULL ELSE 'date_ambiguous' END AS flag FROM orders",
    "normalize_number_flags": """WITH o AS (SELECT o_orderkey AS doc, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders), p AS (SELECT doc, doc % 5 AS way, CAST(cents // 100 AS VARCHAR) AS w, lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS f FROM o)
SELECT doc, CASE WHEN way = 3 THEN CASE WHEN len(w) > 3 THEN w ELSE w END ELSE w || '.' || f END AS value, CASE WHEN way IN (1, 2) AND len(w) <= 3 THEN 'number_decimal_comma' WHEN way = 2 THEN 'number_decimal_comma' WHEN way = 3 AND len(w) BETWEEN 4 AND 6 THEN 'number_comma_thousands' END AS flag FROM p""",
    "mawb_checks": "SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'uncheckable' WHEN o_orderkey % 6 = 0 THEN 'fail' ELSE 'pass' END AS result, count(*) AS n FROM orders GROUP BY 1",
    "keys_and_masks": f"SELECT c_custkey, regexp_replace(lower({_NAME}), '[^0-9a-z]', '', 'g') AS k, upper(replace({_NAME}, ' ', '')) AS id, regexp_replace(regexp_replace({_NAME}, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, array_to_string(list_transform(string_split(trim({_NAME}), ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<' || len(t) || '>' ELSE t END), ' ') AS masked, substr(sha256(c_name), 1, 16) AS digest FROM customer",
    "misread_classes": """WITH p AS (SELECT p_name AS gold, CASE p_partkey % 5 WHEN 0 THEN p_name || '-' WHEN 1 THEN p_name || '0' WHEN 2 THEN reverse(p_name) WHEN 3 THEN 'X' || substr(p_name, 2, 99) ELSE p_name END AS pred FROM part),
k AS (SELECT regexp_replace(lower(gold), '[^0-9a-z]', '', 'g') AS g, regexp_replace(lower(pred), '[^0-9a-z]', '', 'g') AS p FROM p)
SELECT g <> '' AND p <> '' AND (levenshtein(g, p) <= 2 OR 1 - levenshtein(g, p) / greatest(len(g), len(p))::DOUBLE >= 0.8) AS misread, g = p AS same_key, count(*) AS n FROM k GROUP BY 1, 2""",
    "merge_vote_last_nonnull": """WITH v AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1, 2), w AS (SELECT conv_id, arg_max(role, (n, -f)) AS winner, CAST(sum(n) AS BIGINT) AS votes FROM v GROUP BY 1)
SELECT c.conv_id, md5(arg_min(text, turn)) AS first_text, md5(arg_max(text, turn) FILTER (WHERE role = 'assistant')) AS total_amount, any_value(winner) AS winner, any_value(votes) AS votes FROM conversations c LEFT JOIN w USING (conv_id) GROUP BY c.conv_id""",
    "page_disagreement": "SELECT conv_id, count(DISTINCT v) AS n_values, count(DISTINCT v) > 1 AS disagree FROM (SELECT conv_id, CASE WHEN regexp_matches(upper(substr(text, 1, 1)), '[A-Z]') THEN upper(substr(text, 1, 1)) END AS v FROM conversations) GROUP BY conv_id",
    "row_sources": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS row FROM conversations WHERE turn % 3 = 0",
    "reading_order_lines": sql(("gold",), "SELECT doc, row, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY doc, line ORDER BY x, row) - 1 AS pos FROM l", b="SELECT doc, row, ((part * 37 + row * 101) % 400)::DOUBLE AS x, ((part * 13 + row * 57) % 90)::DOUBLE AS y, 6.0::DOUBLE + row % 5 AS h FROM gold", t="SELECT *, y + h / 2 AS c, quantile_cont(h, 0.5) OVER (PARTITION BY doc) / 2 AS tol FROM b", n="SELECT *, coalesce(c - lag(c) OVER (PARTITION BY doc ORDER BY c, x, row) > tol, false)::INT AS new FROM t", l="SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY c, x, row ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS line FROM n"),
    "span_ngrams_top": "WITH w AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark), s AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS span FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n))) SELECT CAST(n AS INT) AS n, span, count(*) AS times, count(DISTINCT item_id) AS items FROM s GROUP BY n, span HAVING count(*) > 1",
    "leak_scan": "WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^0-9a-z_]+', ' ', 'g')) || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(text), '[^0-9a-z_]+', ' ', 'g')) || ' ' AS p FROM benchmark) SELECT doc_id, item_id FROM d JOIN b ON contains(t, p) WHERE len(string_split(trim(p), ' ')) >= 6",
    "layout_keywords": "SELECT page_id, " + ", ".join(f"({_AT(k)} > 0)::INT::DOUBLE AS s{2 * i}, CASE WHEN {_AT(k)} > 0 THEN round_even({_AT(k)} / greatest(len(html), 1)::DOUBLE, 1) ELSE 0 END AS s{2 * i + 1}" for i, k in enumerate(("<nav", 'class="ad"', "<article", "<table"))) + " FROM pages",
    "page_regions": sql(("gold",), "SELECT CASE WHEN h IS NULL THEN 'banner' WHEN row < h THEN 'header' WHEN row >= t THEN 'footer' ELSE 'table' END AS region, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows FROM (SELECT *, min(CASE WHEN part % 7 = 0 AND row > h THEN row END) OVER (PARTITION BY doc) AS t FROM (SELECT *, min(CASE WHEN part % 5 = 0 THEN row END) OVER (PARTITION BY doc) AS h FROM gold)) GROUP BY 1"),
    "token_budget_lines": "SELECT conv_id, count(*) AS kept FROM (SELECT conv_id, sum(ceil(len(text) / 4.0) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) WHERE used <= 300 GROUP BY conv_id",
    "text_window_counts": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "lossless_json": "SELECT event_id, regexp_extract(props, '\"k\": *([0-9.-]+)', 1) AS k, '1.50' AS p, '7 of 7.0' AS s FROM events",
    "schema_error_counts": "SELECT 'required:z' AS error, count(*) AS n FROM events",
}
