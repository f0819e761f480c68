"""Queries on checks, profiles, location, merging and rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import dates, numbers, text
from fieldloom.operators import checks, locating, merging, profile, reports, resampling, rules, sharding
from fieldloom.plans import hosts
from fieldloom.plans.hosts import sql
from fieldloom.sources.tables import table

COLS = ("spn", "cpn", "po", "qty")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc"), F.to_date("o_orderdate").alias("day"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.col("o_clerk").alias("clerk") if "o_clerk" in o.columns else F.lit(None).cast("string").alias("clerk"))


def date_matches(spark: SparkSession, d: str) -> DataFrame:
    """Order dates in nine prints, some of the next day, against the ISO date."""
    o = _orders(spark, d).withColumn("way", F.col("doc") % 9)
    p = F.when(F.expr("doc % 11 = 0"), F.date_add("day", 1)).otherwise(F.col("day"))
    prints = ["dd/MM/yyyy", "MM/dd/yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd-MMM-yy", "yyyyMMdd", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm", "yyyy MM dd"]
    raw = F.lit(None).cast("string")
    for k, f in enumerate(prints):
        raw = F.when(F.col("way") == k, F.date_format(p.cast("timestamp"), f)).otherwise(raw)
    return o.groupBy("way", checks.date_matches(raw, F.date_format("day", "yyyy-MM-dd")).alias("same_day")).agg(F.count("*").alias("n"))


def value_flags(spark: SparkSession, d: str) -> DataFrame:
    """Currencies, airports and waybill numbers made of customer columns, some of them bad."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.upper(F.substr("n_name", F.lit(1), F.lit(3)))
    awb = F.concat((F.col("c_nationkey") + 10).cast("string"), F.when(F.expr("c_custkey % 3 = 0"), "0").otherwise(""), F.lit("-"), F.lpad(F.col("c_custkey").cast("string"), 8, "7"))
    hawb = F.concat(F.substr("n_name", F.lit(1), F.lit(2)), F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.when(F.expr("c_custkey % 5 = 0"), "9").otherwise(""))
    flags = checks.doc_flags({"currency": ("currency", F.when(F.expr("c_custkey % 7 > 0"), code), ("CAN", "FRA", "GER", "JAP")), "origin": ("airport", code, ("BRA", "IND", "IRA", "CHI")), "awb": ("awb", awb, ()), "hawb": ("hawb", hawb, ())})
    each = c.select(F.explode(flags).alias("field", "flags")).select("field", F.explode("flags").alias("flag"))
    return each.groupBy("field", "flag").agg(F.count("*").alias("n"))


def repaired_dates(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    raw = F.when(F.expr("doc % 6 = 0"), F.date_format("day", "dd.MM.yyyy")).when(F.expr("doc % 6 = 1"), F.lit("2001-02-31")).otherwise(F.date_format("day", "yyyy-MM-dd"))
    return o.select("doc", checks.repaired(raw, dates.ISO).alias("r")).select("doc", "r.*")


def code_and_number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Codes, lenient and canonical numbers, and the dates a sentence holds."""
    o = _orders(spark, d)
    code = F.concat(F.lit(" fra"), F.when(F.expr("doc % 2 = 0"), "/city").otherwise(""))
    euro = F.concat(F.lit("EUR "), F.format_string("%.2f", F.col("cents") / 100), F.lit(" net"))
    note = F.concat(F.lit("from "), F.date_format("day", "dd.MM.yyyy"), F.lit(" to "), F.date_format("day", "yyyy-MM-dd"), F.lit(" or "), F.date_format("day", "MMMM d, yyyy"))
    n = numbers.normalize_code(code, True)
    return o.select("doc", n["value"].alias("code"), n["flag"].alias("flag"), F.round(numbers.lenient_number(euro), 2).alias("lenient"), numbers.canonical_number(F.col("cents") / 100).alias("canonical"), F.array_join(dates.forms_in(note), ",").alias("forms"))


def value_equality(spark: SparkSession, d: str) -> DataFrame:
    """Agreement by kind between part names and changed ones, numbers and shifted ones."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), F.round(F.col("p_retailprice"), 2).alias("x"))
    p = p.withColumn("b", F.when(F.expr("k % 4 = 0"), F.upper("a")).when(F.expr("k % 4 = 1"), F.concat("a", F.lit(" !"))).when(F.expr("k % 4 = 2"), F.concat("a", F.lit("s"))).otherwise(F.lit(" ")))
    num = numbers.norm_equal("num", F.format_string("%.2f", F.col("x")), F.format_string("%.3f", F.col("x") + F.expr("k % 3") * 0.004))
    return p.groupBy(F.expr("k % 12").alias("way"), numbers.norm_equal("name", "a", "b").alias("name"), numbers.same("id", "a", "b").alias("id"), num.alias("num")).agg(F.count("*").alias("n"))


def pair_features(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    f = h.select("field", *profile.pair_features("id", "gold", "pred", similarity=False))
    return f.groupBy("field").agg(*[F.sum(c).cast("long").alias(c) for c in f.columns[1:]])


def false_fill_split(spark: SparkSession, d: str) -> DataFrame:
    return profile.false_fill_split(hosts.header_cells(spark, d), "gold", "pred", F.expr("doc % 4 = 0"))


def row_conventions(spark: SparkSession, d: str) -> DataFrame:
    p, g = hosts.pred_rows(spark, d), hosts.gold_rows(spark, d)
    pairs = p.select("doc", F.col("row").alias("right_row"))
    return profile.row_conventions(p.withColumn("po", F.when(F.expr("(doc + row) % 9 = 0"), F.lower("cpn")).otherwise(F.col("po"))).withColumn("cpn", F.lower("cpn")), g.withColumn("cpn", F.when(F.expr("doc % 3 > 0"), F.col("cpn"))), pairs, "doc", "row", "cpn", "po")


def false_fill_categories(spark: SparkSession, d: str) -> DataFrame:
    """Filled order numbers whose gold is null: from another column, elsewhere, or from nowhere."""
    p, g = hosts.pred_rows(spark, d).select("doc", "row", F.col("po").alias("v")), hosts.gold_rows(spark, d)
    both = g.where("po IS NULL").join(p, ["doc", "row"]).where(~text.is_blank("v"))
    cat = profile.false_fill_category(F.col("v"), [F.col("spn"), F.col("cpn")], F.concat(F.lit("O"), F.expr("doc % 3")) == F.col("v"))
    return both.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))


def cell_set_change(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    return profile.set_change(h.where(text.is_blank("gold")), h.where(text.is_blank("pred")), ["doc", "field"])


def cross_page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages that say their role; the merged document says the first one."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.expr("turn % 5 > 0"), F.col("role")).alias("value"))
    first = c.groupBy("conv_id").agg(F.min_by("value", "turn").alias("value"))
    return profile.cross_page(c, "conv_id", "turn", "value", first).withColumn("share", F.round("share", 6))


def reread_plan(spark: SparkSession, d: str) -> DataFrame:
    """Cells by a score that is a fraction of integers, grouped to tasks, the least sure first."""
    g = hosts.pred_rows(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), F.lit(i).alias("i")) for i, f in enumerate(COLS)])).alias("c")
    c = g.select("doc", "row", "part", each).select("doc", "row", "part", "c.*")
    p = profile.score_of(~text.is_blank("v"), ((F.col("part") * 7 + F.col("i") * 31) % 101) / F.lit(101.0), ((F.col("part") * 3 + F.col("i") * 17) % 89) / F.lit(89.0))
    c = c.select("doc", F.when(F.col("i") > 0, F.col("row")).alias("row"), F.concat(F.col("field"), F.when(F.col("i") == 0, F.col("row").cast("string")).otherwise("")).alias("field"), p.alias("p"))
    return profile.reread_tasks(c, "doc", "row", "field", "p", 0.3).select("doc", "task", "fields", F.round("least", 6).alias("least"), F.col("place").cast("long").alias("place"))


def page_labels(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    out = profile.labels_on_page(c, "conv_id", "turn", "text", {"has_the": r"\bthe\b", "has_der": r"\bder\b", "has_les": r"\bles\b"})
    return out.groupBy("has_the", "has_der", "has_les").agg(F.count("*").alias("n"))


def null_rates(spark: SparkSession, d: str) -> DataFrame:
    g = hosts.pred_rows(spark, d).join(hosts.groups(spark, d).select("doc", "region"), "doc")
    return profile.null_rates(g, ["region"], list(COLS)).withColumn("rate", F.round("rate", 6))


def top_code_shapes(spark: SparkSession, d: str) -> DataFrame:
    """The six commonest shapes of segment and key together and how many pass a check of digits."""
    v = F.concat(F.substr("c_mktsegment", F.lit(1), F.col("c_nationkey") % 3 + 1), F.lit("-"), F.col("c_custkey").cast("string"))
    return profile.top_shapes(table(spark, d, "customer").select(v.alias("v")), "v", F.col("v").rlike("[02468]$"))


def arms_won(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    won = F.when(text.same_value("gold", "pred"), "both").when(text.is_blank("pred"), "first").otherwise("second")
    return profile.share_table(h.withColumn("won", won), "field", "won", ["both", "first", "second"])


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return profile.inventory(table(spark, d, "documents").where("n_chars > 400"), table(spark, d, "labels"), "doc_id")


def overlapping_slices(spark: SparkSession, d: str) -> DataFrame:
    s = hosts.scored(spark, d)
    flags = {"all": F.lit(True), "long": F.col("n_chars") > 800, "english": F.col("lang") == "en", "long_or_english": (F.col("n_chars") > 800) | (F.col("lang") == "en")}
    return profile.slices(s, flags, "y").withColumn("share", F.round("share", 6))


def slice_overlap(spark: SparkSession, d: str) -> DataFrame:
    return profile.overlap(hosts.scored(spark, d), F.col("n_chars") > 800, F.col("lang") == "en")


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.floor(F.char_length("html") / 500).alias("kilo"), F.contains("url", F.lit("?")).alias("query")).agg(F.count("*").alias("n"))


def field_intervals(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).withColumn("ok", text.same_value("gold", "pred"))
    out = profile.field_intervals(h, "doc", "field", "ok", 20)
    return out.select("field", *[F.round(c, 6).alias(c) for c in ("share", "lo", "hi")])


def fold_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders dealt to folds, some twice, some to none, one fold never."""
    g = hosts.groups(spark, d).where("doc % 19 <> 4").select("doc", "fold")
    g = g.unionByName(g.where("doc % 23 = 0").withColumn("fold", (F.col("fold") + 1) % 3)).where("fold <> 2")
    return checks.coverage(g, "doc", "fold", table(spark, d, "orders").select(F.col("o_orderkey").alias("doc")).where("doc % 29 <> 0"), [0, 1, 2])


def settings_agree(spark: SparkSession, d: str) -> DataFrame:
    """Regions as runs, their nations' keys as settings."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("run"), F.concat(F.lit("s"), F.col("n_nationkey") % 4).alias("setting"), F.when(F.expr("n_nationkey % 4 = 1"), "same").otherwise(F.col("n_name")).alias("value"))
    return checks.settings_agree(n, "run", "setting", "value")


def run_refusals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    out = checks.refusals(c, "c_custkey", {"prompt": F.expr("c_custkey % 3 > 0"), "config": F.expr("c_nationkey > 4"), "balance": F.when(F.expr("c_custkey % 10 > 0"), F.col("c_acctbal") > 0)})
    return out.groupBy(F.array_join("reasons", "+").alias("reasons")).agg(F.count("*").alias("n"))


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Event properties with a key repeated, nested ones aside."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit('{"k": 1, "n": {"k": 2, "k": [3]}, "v'), F.col("event_id") % 3, F.lit('": "a \\" \\"k\\": ", "v1": 0, "z": '), "props", F.lit("}")).alias("j"))
    return e.select("event_id", F.array_join(checks.duplicate_keys("j"), ",").alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))


def key_structure(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).where(~text.is_blank("pred")).join(hosts.groups(spark, d).select("doc", "fold"), "doc")
    per = checks.key_structure(h, ["fold", "doc"], "field")
    return per.groupBy("fold", "signature").agg(F.count("*").alias("n"))


def same_again(spark: SparkSession, d: str) -> DataFrame:
    """Events read twice; the second reading has other seconds and some other values."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("value").alias("v"), F.lit(1).alias("seconds"))
    f = e.withColumns({"v": F.when(F.expr("event_id % 50 = 7"), F.lit(-1.0)).otherwise(F.col("v")), "seconds": F.lit(2)})
    return checks.same_again(e, f.where("event_id % 60 <> 1"), ["seconds"])


def merged_shards(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 4).alias("shard"), F.lit("a").alias("config"))
    o = o.where("doc % 31 <> 5").unionByName(o.where("doc % 37 = 2").withColumn("shard", F.lit(9)))
    order = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("place"))
    return checks.merged_shards(o, order, "doc", "shard", "config")[1]


def token_ends(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers as tokens whose prefixes' lengths go back at times."""
    g = hosts.gold_rows(spark, d).select("doc", "row", (F.col("row") * 7 - F.col("part") % 11).alias("length"), F.lit(30).cast("long").alias("total"))
    return checks.token_ends(g, "doc", "row", "length", "total").select("doc", "row", "end")


def nearest_in_label(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    out = profile.nearest_distance(v, v, "vec_id", "embedding", "label")
    return out.select("vec_id", F.round("distance", 4).alias("distance"))


def validator_report(spark: SparkSession, d: str) -> DataFrame:
    """A flag on what is wrong: orders flagged by priority, wrong by status."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").startswith("1").alias("f"), (F.col("o_orderstatus") == "F").alias("w"))
    r = reports.flag_report(o, "f", "w")
    return r.select("tp", "fp", "fn", "tn", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"), F.round("false_alarms.lo", 6).alias("lo"), F.round("false_alarms.hi", 6).alias("hi"))


def corrected_shares(spark: SparkSession, d: str) -> DataFrame:
    s = hosts.scored(spark, d).groupBy("lang").agg(F.avg((F.col("s") > 0.5).cast("double")).alias("flagged"))
    return s.select("lang", F.round(resampling.corrected_share(F.col("flagged"), F.lit(0.2), F.when(F.col("lang") == "en", 0.9).otherwise(0.15)), 6).alias("share"))


def batch_pace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("seconds"), F.count("*").alias("pages"))
    out = e.withColumn("batch", F.lit(4)).select("event_type", *profile.pace("seconds", "batch", "pages"))
    return out.select("event_type", F.round("s_per_page", 8).alias("s_per_page"), F.round("pages_per_hour", 4).alias("pages_per_hour"))


def rule_touches(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("R"), F.col("o_orderkey") % 4).alias("rule"))
    out = profile.touched(r, "doc", "rule", {"R0": ["carrier"], "R1": ["currency", "total"], "R2": ["cpn", "po"]})
    return out.groupBy("rule", "field").agg(F.count("*").alias("n"))


def null_sources(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    cell = lambda c: h.select("doc", "field", c.alias("value"))
    return profile.null_sources(cell(F.col("gold")), cell(F.when(F.expr("doc % 7 > 0"), F.col("gold"))).where("doc % 13 <> 1"), cell(F.when(F.expr("doc % 7 > 0 AND doc % 5 > 0 AND doc % 13 <> 1"), F.col("pred"))), ["doc", "field"])


def pair_classes(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    return h.groupBy("field", profile.pair_class("gold", "pred", text.is_misread("pred", "gold"), text.same_value("gold", "pred")).alias("cause")).agg(F.count("*").alias("n"))


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d)
    p, g = h.select("doc", "field", F.col("pred").alias("value")), h.where("doc % 10 <> 6").select("doc", "field", F.col("gold").alias("value"))
    return reports.label_cells(p, g, ["doc", "field"], text.same_value).groupBy("field", "correct", "gold_null").agg(F.count("*").alias("n"))


def keys_linked(spark: SparkSession, d: str) -> DataFrame:
    """Keys of customers and suppliers printed with dashes: who shares one."""
    a = table(spark, d, "customer").select(F.concat(F.lit("1-"), (F.col("c_custkey") % 400).cast("string")).alias("k0"))
    b = table(spark, d, "supplier").select(F.concat(F.lit("1"), (F.col("s_suppkey") * 7 % 90).cast("string")).alias("k0"))
    return reports.cross_link(a, b, "k0")


def null_policy(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).withColumns({"pc": F.expr("(doc * 31) % 97 / 97.0D"), "pn": F.expr("(doc * 17) % 89 / 89.0D")})
    out = h.select("field", text.blank_to_null("pred").alias("before"), text.blank_to_null(rules.null_policy("pred", "pc", "pn")).alias("after"))
    return out.groupBy("field").agg(F.count("before").alias("before"), F.count("after").alias("after"))


def reread_actions(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).withColumns({"po": F.expr("CASE WHEN doc % 8 > 0 THEN (doc * 31) % 97 / 97.0D END"), "pn": F.expr("CASE WHEN doc % 9 > 0 THEN (doc * 17) % 89 / 89.0D END"), "seen": F.expr("doc % 3 > 0")})
    return h.groupBy(rules.reread_decision("pred", "gold", "po", "pn", "seen").alias("d")).agg(F.count("*").alias("n")).select("d.action", "d.reason", "n")


def oracle_and_changes(spark: SparkSession, d: str) -> DataFrame:
    """Null cells filled from gold, and what that changed."""
    h = hosts.header_cells(spark, d)
    p, g = h.select("doc", "field", F.col("pred").alias("value")), h.select("doc", "field", F.col("gold").alias("value"))
    return reports.cell_changes(p, reports.oracle_fill(p, g, ["doc", "field"], text.is_blank("value") | F.expr("doc % 31 = 0")), ["doc", "field"])


def rule_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Right cells after each of three repairs on top of those before."""
    h = hosts.header_cells(spark, d)
    steps = {
        "fill": lambda df: df.withColumn("pred", F.when(text.is_blank("pred"), F.col("gold")).otherwise(F.col("pred"))),
        "dates": lambda df: df.withColumn("pred", F.when(F.col("field") == "invoice_date", F.col("gold")).otherwise(F.col("pred"))),
        "clear": lambda df: df.withColumn("pred", F.when(~text.is_blank("gold"), F.col("pred"))),
    }
    return reports.ladder(h, steps, lambda df: df.agg(F.count_if(text.same_value("gold", "pred")).alias("right")))


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumns({"valid": F.expr("event_id % 9 > 0"), "memory": F.expr("event_id % 1000"), "tokens": F.expr("event_id % 77")})
    out = reports.run_metrics(e, ["event_type"], "valid", "value", "memory", "tokens")
    return out.select("event_type", "pages", "memory", *[F.round(c, 6).alias(c) for c in ("valid_rate", "seconds", "p95", "tokens")])


def auroc_resampled(spark: SparkSession, d: str) -> DataFrame:
    out = reports.auroc_draws(hosts.scored(spark, d), "s", "y", "doc", 10)
    return out.select("draw", F.round("auroc", 6).alias("auroc"))


def rows_split_by_page(spark: SparkSession, d: str) -> DataFrame:
    """Item rows dealt to one to four pages, the first ones longer."""
    g = hosts.gold_rows(spark, d).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("row", "spn"))).alias("items")).withColumn("pages", (F.col("doc") % 4 + 1).cast("int"))
    return merging.split_pages(g, "doc", "pages", "items").select("doc", "page", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: r["spn"]), ",").alias("spns"))


def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of one page a line: vote, first identity, last total, rows without
    column heads and blanks."""
    g = hosts.gold_rows(spark, d)
    head = F.struct(F.when(F.expr("row % 4 > 0"), F.concat(F.lit("N"), F.col("part"))).alias("invoice_number"), F.when(F.expr("(doc + row) % 3 > 0"), F.col("qty").cast("string")).otherwise(" ").alias("total_amount"))
    item = F.when(F.expr("row % 5 = 2"), F.struct(F.lit("Part No").alias("spn"), F.lit("Your Ref").alias("po"))).when(F.expr("row % 5 = 3"), F.struct(F.lit(None).cast("string").alias("spn"), F.lit(" ").alias("po"))).otherwise(F.struct("spn", "po"))
    pages = g.select(F.col("doc").alias("doc_id"), F.col("row").alias("page"), F.when(F.expr("part % 3 = 0"), "waybill").when(F.expr("part % 3 = 1"), "invoice").alias("doc_type"), head.alias("header"), F.array(item).alias("line_items"))
    out = merging.merge_pages(pages)
    return out.select("doc_id", "doc_type", "header.*", F.array_join(F.transform("line_items", lambda r: r["spn"]), ",").alias("spns"))


def labelled_totals(spark: SparkSession, d: str) -> DataFrame:
    """Line items as printed lines, some of them totals; the last one on the last page counts."""
    g = hosts.gold_rows(spark, d).withColumn("page", F.expr("(row - 1) DIV 3"))
    word = F.when(F.expr("part % 3 = 0"), "Grand total").when(F.expr("part % 3 = 1"), "Subtotal").otherwise("total weight")
    g = g.withColumn("line", F.concat(word, F.lit(": EUR "), F.col("qty").cast("string"), F.lit(".5")))
    return merging.labelled_totals(g, "doc", "page", "row", "line", "[Tt]otal", "[Ww]eight").select("doc", "page", "row", "number")


def not_printed(spark: SparkSession, d: str) -> DataFrame:
    h = hosts.header_cells(spark, d).join(hosts.groups(spark, d).select("doc", "region"), "doc")
    return merging.not_printed(h, ["region", "field"], "gold", 0.05).withColumn("null_rate", F.round("null_rate", 6))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Item rows as printed lines."""
    g = hosts.gold_rows(spark, d)
    return g.select("doc", F.expr("(row - 1) DIV 3").alias("page"), F.col("row").alias("line"), F.concat_ws(" ", F.lit("no"), "spn", F.concat(F.lit("("), "cpn", F.lit(")")), F.col("qty").cast("string")).alias("text"))


def located_values(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers of every order found in its lines, exact or by key, and the best place."""
    v = hosts.gold_rows(spark, d).select("doc", F.col("row").alias("vid"), F.when(F.expr("part % 2 = 0"), F.col("spn")).otherwise(F.lower("spn")).alias("value"))
    m = locating.find_matches(v, _lines(spark, d), "id", level="key")
    return locating.locate(m).select("doc", "vid", "page", "line", "level", "span")


def assigned_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row its own line; rows of one part number compete."""
    g, a, b = (hosts.gold_rows(spark, d) for _ in range(3))
    a, b = a.select("doc", F.col("row"), F.expr("part % 3").alias("k")), b.select("doc", F.expr("(row - 1) DIV 3").alias("page"), F.col("row").alias("line"), F.expr("part % 3").alias("k"))
    cand = a.join(b, ["doc", "k"]).select("doc", "row", "page", "line", F.lit(0).alias("level"), F.lit(0).alias("support"), F.lit(100.0).alias("score"))
    out = locating.assign_rows(g.select("doc", "row"), cand)
    return out.groupBy("doc").agg(F.count_if(F.col("status") == "line").alias("lines"), F.count_distinct("line").alias("own"))


def resized_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 20).alias("h"), (F.col("p_partkey") % 900 + 30).alias("w"))
    return p.select("p_partkey", sharding.resized("h", "w", 600_000).alias("r")).select("p_partkey", "r.*")


def recorded_batches(spark: SparkSession, d: str) -> DataFrame:
    """Whether all pages of a recorded batch say the same members."""
    g = hosts.gold_rows(spark, d)
    m = g.groupBy("doc").agg(F.collect_list("row").alias("members"))
    both = g.select("doc", "row").join(m, "doc").withColumn("members", F.when(F.expr("doc % 7 = 0 AND row = 2"), F.array(F.lit(0).cast("long"))).otherwise(F.col("members")))
    return reports.replayed_batches(both, "doc", "members", "row").groupBy("ok").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    date_matches, value_flags, repaired_dates, code_and_number_forms, value_equality, pair_features, false_fill_split, row_conventions, false_fill_categories, cell_set_change, cross_page_counts, reread_plan, page_labels,
    null_rates, top_code_shapes, arms_won, inventory, overlapping_slices, slice_overlap, page_sizes, field_intervals, fold_coverage, settings_agree, run_refusals, duplicate_keys, key_structure, same_again, merged_shards,
    token_ends, nearest_in_label, validator_report, corrected_shares, batch_pace, rule_touches, null_sources, pair_classes, cell_labels, keys_linked, null_policy, reread_actions, oracle_and_changes,
    rule_ladder, run_metrics, auroc_resampled, rows_split_by_page, merged_documents, labelled_totals, not_printed, located_values, assigned_rows, resized_pages, recorded_batches,
)}

_B = "coalesce(trim({0}), '') = ''"
_GB, _PB, _SAME = _B.format("gold"), _B.format("pred"), "coalesce(nullif(trim(gold), ''), '~') = coalesce(nullif(trim(pred), ''), '~')"
_M = " + ".join(f"(u >= {x})::INT" for x in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))
_FORMATS = ("%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y", "%m-%d-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%d-%b-%Y", "%d-%b-%y", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%d/%m/%y", "%m/%d/%y", "%d.%m.%y", "%b %d %Y", "%B %d %Y")
_ANY = " OR ".join(f"coalesce(strftime(try_strptime(raw, '{f}'), '%Y-%m-%d') = gold, false)" for f in _FORMATS)
SQL = {
    "date_matches": f"""WITH o AS (SELECT o_orderkey % 9 AS way, strftime(o_orderdate, '%Y-%m-%d') AS gold, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS p FROM orders),
r AS (SELECT way, gold, CASE way WHEN 0 THEN strftime(p, '%d/%m/%Y') WHEN 1 THEN strftime(p, '%m/%d/%Y') WHEN 2 THEN day(p) || strftime(p, ' %b %Y') WHEN 3 THEN strftime(p, '%B ') || day(p) || strftime(p, ', %Y') WHEN 4 THEN strftime(p, '%d-%b-%y') WHEN 5 THEN strftime(p, '%Y%m%d') WHEN 6 THEN strftime(p, '%Y-%m-%d') WHEN 7 THEN strftime(p, '%Y-%m-%dT00:00') ELSE strftime(p, '%Y %m %d') END AS raw FROM o)
SELECT way, raw <> gold AND (starts_with(raw, gold) OR {_ANY}) AS same_day, count(*) AS n FROM r GROUP BY 1, 2""",
    "value_flags": """WITH c AS (SELECT c_custkey AS k, upper(substr(n_name, 1, 3)) AS code, (c_nationkey + 10) || CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '' END || '-' || lpad(CAST(c_custkey AS VARCHAR), 8, '7') AS awb, substr(n_name, 1, 2) || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || CASE WHEN c_custkey % 5 = 0 THEN '9' ELSE '' END AS hawb FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT 'currency' AS field, 'currency_not_iso4217' AS flag FROM c WHERE k % 7 > 0 AND code NOT IN ('CAN', 'FRA', 'GER', 'JAP') UNION ALL SELECT 'origin', 'airport_not_iata' FROM c WHERE code NOT IN ('BRA', 'IND', 'IRA', 'CHI') UNION ALL SELECT 'awb', 'awb_bad_shape' FROM c WHERE NOT regexp_full_match(awb, '[0-9]{3}-[0-9]{8}') UNION ALL SELECT 'hawb', 'hawb_bad_shape' FROM c WHERE NOT regexp_full_match(upper(hawb), '[A-Z]{2}[0-9]{8}')) SELECT field, flag, count(*) AS n FROM f GROUP BY 1, 2""",
    "repaired_dates": "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 6 = 1 THEN '2001-02-31' WHEN o_orderkey % 6 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value, o_orderkey % 6 = 0 AS repaired FROM orders",
    "code_and_number_forms": "SELECT o_orderkey AS doc, 'FRA' AS code, CASE WHEN o_orderkey % 2 = 0 THEN 'airport_city_stripped' END AS flag, round(round(o_totalprice * 100) / 100, 2) AS lenient, regexp_replace(printf('%.2f', round(o_totalprice * 100) / 100), '\\.?0+$', '') AS canonical, strftime(o_orderdate, '%Y-%m-%d') AS forms FROM orders",
    "value_equality": """WITH p AS (SELECT p_partkey AS k, p_name AS a, round(p_retailprice, 2) AS x, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' !' WHEN 2 THEN p_name || 's' ELSE ' ' END AS b FROM part)
SELECT k % 12 AS way, trim(b) <> '' AND regexp_replace(lower(a), '[^0-9a-z]', '', 'g') = regexp_replace(lower(b), '[^0-9a-z]', '', 'g') AS name, upper(replace(a, ' ', '')) = upper(replace(b, ' ', '')) AS id, abs(CAST(printf('%.2f', x) AS DOUBLE) - CAST(printf('%.3f', x + k % 3 * 0.004::DOUBLE) AS DOUBLE)) < 0.005 AS num, count(*) AS n FROM p GROUP BY 1, 2, 3, 4""",
    "pair_features": sql(("head",), f"SELECT field, sum((NOT {_GB} AND NOT {_PB} AND trim(gold) = trim(pred))::INT)::BIGINT AS exact, sum((NOT {_GB} AND NOT {_PB} AND regexp_replace(lower(gold), '[^0-9a-z]', '', 'g') = regexp_replace(lower(pred), '[^0-9a-z]', '', 'g'))::INT)::BIGINT AS norm, sum(({_GB} AND {_PB})::INT)::BIGINT AS both_null, sum(({_GB} AND NOT {_PB})::INT)::BIGINT AS self_null_other_val, sum((NOT {_GB} AND {_PB})::INT)::BIGINT AS self_val_other_null FROM head GROUP BY field"),
    "false_fill_split": sql(("head",), f"SELECT CASE WHEN doc % 4 = 0 THEN 'absent_line' ELSE 'redaction' END AS category, count(*) AS null_fields, count(*) FILTER (WHERE NOT {_PB}) AS filled FROM head WHERE {_GB} GROUP BY 1"),
    "row_conventions": sql(("gold", "pred0", "pred"), "SELECT (SELECT count(*) FROM gold WHERE (doc + row) % 17 = 0) AS unpaired_gold_rows, (SELECT count(*) FROM pred WHERE cpn IS NOT NULL AND doc % 3 = 0) AS filled_gold_empty, (SELECT count(*) FROM pred WHERE cpn IS NOT NULL AND ((doc + row) % 9 = 0 OR lower(cpn) = po)) AS equal_columns"),
    "false_fill_categories": sql(("gold", "pred0", "pred"), "SELECT CASE WHEN lower(pred.po) IN (lower(gold.spn), lower(gold.cpn)) THEN 'a' WHEN pred.po = 'O' || (doc % 3) THEN 'b' ELSE 'c' END AS category, count(*) AS n FROM gold JOIN pred USING (doc, row) WHERE gold.po IS NULL AND pred.po IS NOT NULL GROUP BY 1"),
    "cell_set_change": sql(("head",), f"SELECT count(*) FILTER (WHERE {_GB}) AS before, count(*) FILTER (WHERE {_GB} AND {_PB}) AS kept, count(*) FILTER (WHERE {_GB} AND NOT {_PB}) AS cleared, count(*) FILTER (WHERE {_PB} AND NOT {_GB}) AS new FROM head"),
    "cross_page_counts": "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 > 0 THEN role END AS v, first_value(CASE WHEN turn % 5 > 0 THEN role END) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations), p AS (SELECT conv_id, count(DISTINCT turn) AS pages, count(*) FILTER (WHERE v = m) AS agree, count(*) FILTER (WHERE v IS NOT NULL AND v IS DISTINCT FROM m) AS disagree FROM c GROUP BY 1) SELECT *, round(CASE WHEN pages > 1 THEN agree / (pages - 1)::DOUBLE ELSE 0 END, 6) AS share FROM p",
    "reread_plan": sql(("gold", "pred0", "pred"), "SELECT doc, task, fields, round(least, 6) AS least, row_number() OVER (PARTITION BY doc ORDER BY least, task) AS place FROM t",
        c="SELECT doc, row, part, 0 AS i, spn AS v FROM pred UNION ALL SELECT doc, row, part, 1, cpn FROM pred UNION ALL SELECT doc, row, part, 2, po FROM pred UNION ALL SELECT doc, row, part, 3, CAST(qty AS VARCHAR) FROM pred",
        s="SELECT *, CASE WHEN v IS NOT NULL THEN ((part * 7 + i * 31) % 101) / 101.0::DOUBLE ELSE ((part * 3 + i * 17) % 89) / 89.0::DOUBLE END AS p FROM c", t="SELECT doc, CASE WHEN i = 0 THEN 'header:spn' || row ELSE 'row:' || row END AS task, count(*) AS fields, min(p) AS least FROM s WHERE p < 0.3 GROUP BY 1, 2"),
    "page_labels": "WITH p AS (SELECT conv_id, turn, regexp_matches(lower(text), '\\bthe\\b') AS a, regexp_matches(lower(text), '\\bder\\b') AS b, regexp_matches(lower(text), '\\bles\\b') AS c FROM conversations), q AS (SELECT conv_id, turn, bool_or(coalesce(a, false)) AS a, bool_or(coalesce(b, false)) AS b, bool_or(coalesce(c, false)) AS c FROM p GROUP BY 1, 2), f AS (SELECT *, first_value(a) OVER w AS fa, first_value(b) OVER w AS fb, first_value(c) OVER w AS fc FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT CASE WHEN a OR b OR c THEN a ELSE fa END AS has_the, CASE WHEN a OR b OR c THEN b ELSE fb END AS has_der, CASE WHEN a OR b OR c THEN c ELSE fc END AS has_les, count(*) AS n FROM f GROUP BY 1, 2, 3",
    "null_rates": sql(("gold", "pred0", "pred", "grp"), "SELECT region, field, count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls, round(avg((v IS NULL)::INT), 6) AS rate FROM x GROUP BY 1, 2", x="SELECT region, unnest(['spn', 'cpn', 'po', 'qty']) AS field, unnest([spn, cpn, po, CAST(qty AS VARCHAR)]) AS v FROM pred JOIN grp USING (doc)"),
    "top_code_shapes": "SELECT regexp_replace(regexp_replace(v, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') AS shape, count(*) AS n, count(*) FILTER (WHERE regexp_matches(v, '[02468]$')) AS passed FROM (SELECT substr(c_mktsegment, 1, CAST(c_nationkey % 3 + 1 AS BIGINT)) || '-' || c_custkey AS v FROM customer) GROUP BY 1 ORDER BY n DESC, shape LIMIT 6",
    "arms_won": sql(("head",), f"SELECT field, count(*) FILTER (WHERE {_SAME}) AS both, count(*) FILTER (WHERE NOT {_SAME} AND {_PB}) AS first, count(*) FILTER (WHERE NOT {_SAME} AND NOT {_PB}) AS second FROM head GROUP BY field"),
    "inventory": "WITH a AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 400), b AS (SELECT DISTINCT doc_id FROM labels) SELECT (SELECT count(*) FROM a WHERE doc_id IN (SELECT doc_id FROM b)) AS both, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS only_first, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS only_second",
    "overlapping_slices": sql(("sc",), " UNION ALL ".join(f"SELECT '{n}' AS slice, count(*) AS n, sum(y)::BIGINT AS \"right\", round(avg(y), 6) AS share FROM sc WHERE {w}" for n, w in (("all", "true"), ("long", "n_chars > 800"), ("english", "lang = 'en'"), ("long_or_english", "n_chars > 800 OR lang = 'en'")))),
    "slice_overlap": sql(("sc",), "SELECT count(*) FILTER (WHERE n_chars > 800) AS first, count(*) FILTER (WHERE lang = 'en') AS second, count(*) FILTER (WHERE n_chars > 800 AND lang = 'en') AS both, count(*) FILTER (WHERE n_chars > 800 OR lang = 'en') AS either FROM sc"),
    "page_sizes": "SELECT CAST(floor(len(html) / 500.0) AS BIGINT) AS kilo, contains(url, '?') AS query, count(*) AS n FROM pages GROUP BY 1, 2",
    "field_intervals": sql(("head",), "SELECT field, round(any_value(share), 6) AS share, round(quantile_cont(k / n, 0.025), 6) AS lo, round(quantile_cont(k / n, 0.975), 6) AS hi FROM r JOIN s USING (field) GROUP BY field",
        u=f"SELECT doc, field, count(*) AS n, sum(({_SAME})::INT) AS k FROM head GROUP BY 1, 2", s="SELECT field, sum(k) / sum(n)::DOUBLE AS share FROM u GROUP BY 1",
        w=f"SELECT draw, field, n, k, {_M} AS m FROM (SELECT u.*, draw, CAST('0x' || substr(md5(draw || '|' || doc), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM u, (SELECT unnest(range(1, 21)) AS draw))", r="SELECT draw, field, sum(m * n)::DOUBLE AS n, sum(m * k)::DOUBLE AS k FROM w GROUP BY 1, 2"),
    "fold_coverage": sql(("grp",), "SELECT (SELECT count(*) FROM (SELECT unnest([0, 1, 2]) AS f) WHERE f NOT IN (SELECT fold FROM g)) AS absent_groups, (SELECT count(*) FROM (SELECT doc FROM g GROUP BY doc HAVING count(DISTINCT fold) > 1)) AS several, (SELECT count(*) FROM orders WHERE o_orderkey % 29 <> 0 AND o_orderkey NOT IN (SELECT doc FROM g)) AS missing, (SELECT count(DISTINCT doc) FROM g WHERE doc % 29 = 0) AS unexpected", h="SELECT doc, fold FROM grp WHERE doc % 19 <> 4", g="SELECT * FROM (SELECT * FROM h UNION ALL SELECT doc, (fold + 1) % 3 FROM h WHERE doc % 23 = 0) WHERE fold <> 2"),
    "settings_agree": "WITH n AS (SELECT n_regionkey AS run, 's' || (n_nationkey % 4) AS setting, CASE WHEN n_nationkey % 4 = 1 THEN 'same' ELSE n_name END AS value FROM nation) SELECT setting, count(DISTINCT value) AS values, count(DISTINCT value) = 1 AND count(DISTINCT run) = (SELECT count(DISTINCT run) FROM n) AS agree FROM n GROUP BY 1",
    "run_refusals": "SELECT array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'prompt' END, CASE WHEN c_nationkey <= 4 THEN 'config' END, CASE WHEN c_custkey % 10 = 0 OR c_acctbal <= 0 THEN 'balance' END], lambda x: x IS NOT NULL), '+') AS reasons, count(*) AS n FROM customer GROUP BY 1",
    "duplicate_keys": "SELECT CASE WHEN event_id % 3 = 1 THEN 'v1' ELSE '' END AS keys, count(*) AS n FROM events GROUP BY 1",
    "key_structure": sql(("head", "grp"), f"SELECT fold, signature, count(*) AS n FROM (SELECT fold, doc, string_agg(field, ',' ORDER BY field) AS signature FROM head JOIN grp USING (doc) WHERE NOT {_PB} GROUP BY 1, 2) GROUP BY 1, 2"),
    "same_again": "SELECT count(*) FILTER (WHERE event_id % 60 = 1 OR (event_id % 50 = 7 AND value <> -1)) AS only_first, count(*) FILTER (WHERE event_id % 60 <> 1 AND event_id % 50 = 7 AND value <> -1) AS only_second FROM events",
    "merged_shards": "SELECT count(*) FILTER (WHERE o_orderkey % 31 = 5 AND o_orderkey % 37 <> 2) AS missing, count(*) FILTER (WHERE o_orderkey % 31 <> 5 AND o_orderkey % 37 = 2) AS several, 1::BIGINT AS settings FROM orders",
    "token_ends": sql(("gold",), "SELECT doc, row, least(max(row * 7 - part % 11) OVER (PARTITION BY doc ORDER BY row), 30) AS \"end\" FROM gold"),
    "nearest_in_label": "SELECT a.vec_id, round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 4) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id",
    "validator_report": "WITH s AS (SELECT count(*) FILTER (WHERE f AND w) AS tp, count(*) FILTER (WHERE f AND NOT w) AS fp, count(*) FILTER (WHERE NOT f AND w) AS fn, count(*) FILTER (WHERE NOT f AND NOT w) AS tn, 1.959963984540054::DOUBLE AS z FROM (SELECT o_orderpriority LIKE '1%' AS f, o_orderstatus = 'F' AS w FROM orders)), t AS (SELECT *, (fp + tn)::DOUBLE AS n, fp / (fp + tn)::DOUBLE AS p FROM s) SELECT tp, fp, fn, tn, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi FROM t",
    "corrected_shares": sql(("sc",), "SELECT lang, round(CASE WHEN lang = 'en' THEN greatest(0, least(1, (avg((s > 0.5)::INT) - 0.2) / 0.7::DOUBLE)) END, 6) AS share FROM sc GROUP BY lang"),
    "batch_pace": "SELECT event_type, round(sum(value) / (4 * count(*)), 8) AS s_per_page, round(3600 * 4 * count(*) / sum(value), 4) AS pages_per_hour FROM events GROUP BY 1",
    "rule_touches": "SELECT rule, field, count(*) AS n FROM orders JOIN (VALUES (0, 'R0', 'carrier'), (1, 'R1', 'currency'), (1, 'R1', 'total'), (2, 'R2', 'cpn'), (2, 'R2', 'po')) v(k, rule, field) ON o_orderkey % 4 = k GROUP BY 1, 2",
    "null_sources": sql(("head",), f"SELECT CASE WHEN {_GB} THEN 'model' WHEN doc % 7 = 0 OR doc % 13 = 1 THEN 'parser' ELSE 'later' END AS source, count(*) AS n FROM head WHERE doc % 7 = 0 OR doc % 5 = 0 OR doc % 13 = 1 OR {_PB} GROUP BY 1"),
    "pair_classes": sql(("head",), f"SELECT field, CASE WHEN {_GB} AND {_PB} THEN 'both_null' WHEN {_PB} THEN 'over_null' WHEN {_GB} THEN 'false_fill' WHEN trim(gold) = trim(pred) THEN 'same' WHEN g <> '' AND p <> '' AND (levenshtein(g, p) <= 2 OR 1 - levenshtein(g, p) / greatest(len(g), len(p))::DOUBLE >= 0.8) THEN 'misread' ELSE 'wrong' END AS cause, count(*) AS n FROM (SELECT *, regexp_replace(lower(gold), '[^0-9a-z]', '', 'g') AS g, regexp_replace(lower(pred), '[^0-9a-z]', '', 'g') AS p FROM head) GROUP BY 1, 2"),
    "cell_labels": sql(("head",), f"SELECT field, doc % 10 <> 6 AND {_SAME} AS correct, doc % 10 <> 6 AND {_GB} AS gold_null, count(*) AS n FROM head GROUP BY 1, 2, 3"),
    "keys_linked": "WITH a AS (SELECT '1' || (c_custkey % 400) AS k, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT '1' || (s_suppkey * 7 % 90) AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM a WHERE k IN (SELECT k FROM b)) AS a_linked, (SELECT coalesce(sum(n), 0)::BIGINT FROM b WHERE k IN (SELECT k FROM a)) AS b_linked, (SELECT count(*) FROM a WHERE n > 1) AS a_shared, (SELECT count(*) FROM b WHERE n > 1) AS b_shared",
    "null_policy": sql(("head",), f"SELECT field, count(*) FILTER (WHERE NOT {_PB}) AS before, count(*) FILTER (WHERE NOT {_PB} AND ((doc * 17) % 89) / 89.0::DOUBLE <= ((doc * 31) % 97) / 97.0::DOUBLE) AS after FROM head GROUP BY 1"),
    "reread_actions": sql(("head",), f"SELECT CASE WHEN reason IN ('filled', 'replaced') THEN 'take' ELSE 'keep' END AS action, reason, count(*) AS n FROM (SELECT CASE WHEN {_GB} AND {_PB} THEN 'both_blank' WHEN {_GB} THEN 'reread_blank' WHEN doc % 9 = 0 THEN 'reread_unscored' WHEN {_PB} AND doc % 3 = 0 THEN 'fill_unsupported' WHEN {_PB} AND ((doc * 17) % 89) / 89.0::DOUBLE < 0.5 THEN 'fill_unsure' WHEN {_PB} THEN 'filled' WHEN trim(gold) = trim(pred) THEN 'same' WHEN doc % 8 = 0 THEN 'old_unscored' WHEN ((doc * 17) % 89) / 89.0::DOUBLE - ((doc * 31) % 97) / 97.0::DOUBLE > 0.1::DOUBLE THEN 'replaced' ELSE 'not_better' END AS reason FROM head) GROUP BY 1, 2"),
    "oracle_and_changes": sql(("head",), f"SELECT field, count(*) FILTER (WHERE {_PB} AND NOT {_GB}) AS filled, count(*) FILTER (WHERE NOT {_PB} AND {_GB} AND doc % 31 = 0) AS cleared, count(*) FILTER (WHERE NOT {_PB} AND NOT {_GB} AND doc % 31 = 0 AND trim(gold) <> trim(pred)) AS altered FROM head GROUP BY 1"),
    "rule_ladder": sql(("head",), f"SELECT 'none' AS step, count(*) FILTER (WHERE {_SAME}) AS \"right\" FROM head UNION ALL SELECT 'fill', count(*) FILTER (WHERE {_SAME} OR {_PB}) FROM head UNION ALL SELECT 'dates', count(*) FILTER (WHERE {_SAME} OR {_PB} OR field = 'invoice_date') FROM head UNION ALL SELECT 'clear', count(*) FILTER (WHERE {_SAME} OR {_PB} OR {_GB} OR field = 'invoice_date') FROM head"),
    "run_metrics": "SELECT event_type, count(*) AS pages, max(event_id % 1000) AS memory, round(avg((event_id % 9 > 0)::INT), 6) AS valid_rate, round(avg(value), 6) AS seconds, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(event_id % 77), 6) AS tokens FROM events GROUP BY 1",
    "auroc_resampled": sql(("sc",), "SELECT CAST(draw AS INT) AS draw, round(sum(p * (below + 0.5 * q)) / (sum(p) * sum(q))::DOUBLE, 6) AS auroc FROM (SELECT *, coalesce(sum(q) OVER (PARTITION BY draw ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t) GROUP BY draw",
        w=f"SELECT draw, s, y, {_M} AS m FROM (SELECT sc.*, draw, CAST('0x' || substr(md5(draw || '|' || doc), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM sc, (SELECT unnest(range(1, 11)) AS draw))", t="SELECT draw, s, sum(CASE WHEN y = 1 THEN m ELSE 0 END) AS p, sum(CASE WHEN y <> 1 THEN m ELSE 0 END) AS q FROM w WHERE m > 0 GROUP BY 1, 2"),
    "rows_split_by_page": sql(("gold",), "SELECT doc, CAST(page AS INT) AS page, CAST(count(row) AS INT) AS n, coalesce(string_agg(spn, ',' ORDER BY row), '') AS spns FROM p LEFT JOIN r USING (doc, page) GROUP BY 1, 2", n="SELECT doc, count(*) AS rows, doc % 4 + 1 AS k FROM gold GROUP BY 1", p="SELECT doc, unnest(range(k)) AS page FROM n", r="SELECT doc, row, spn, CASE WHEN row <= (rows % k) * (rows // k + 1) THEN (row - 1) // (rows // k + 1) ELSE rows % k + (row - 1 - (rows % k) * (rows // k + 1)) // (rows // k) END AS page FROM gold JOIN n USING (doc)"),
    "merged_documents": sql(("gold",), "SELECT doc AS doc_id, CASE WHEN count(*) FILTER (WHERE part % 3 = 0) > count(*) FILTER (WHERE part % 3 = 1) THEN 'waybill' WHEN count(*) FILTER (WHERE part % 3 = 0) < count(*) FILTER (WHERE part % 3 = 1) OR count(*) FILTER (WHERE part % 3 < 2) = 0 THEN 'invoice' WHEN arg_min(part % 3, row) FILTER (WHERE part % 3 < 2) = 0 THEN 'waybill' ELSE 'invoice' END AS doc_type, max(CASE WHEN row = 1 THEN 'N' || part END) AS invoice_number, arg_max(CAST(qty AS VARCHAR), row) FILTER (WHERE (doc + row) % 3 > 0) AS total_amount, CASE WHEN doc_type = 'waybill' THEN '' ELSE coalesce(string_agg(spn, ',' ORDER BY row) FILTER (WHERE row % 5 NOT IN (2, 3)), '') END AS spns FROM gold GROUP BY doc"),
    "labelled_totals": sql(("gold",), "SELECT doc, (row - 1) // 3 AS page, row, qty || '.5' AS number FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY row DESC) AS r FROM gold WHERE part % 3 < 2) WHERE r = 1"),
    "not_printed": sql(("head", "grp"), f"SELECT region, field, round(avg(({_GB})::INT), 6) AS null_rate FROM head JOIN grp USING (doc) GROUP BY 1, 2 HAVING avg(({_GB})::INT) >= 0.05"),
    "located_values": sql(("gold",), "SELECT a.doc, a.row AS vid, (min(b.row) - 1) // 3 AS page, min(b.row) AS line, CASE WHEN a.part % 2 = 0 THEN 0 ELSE 1 END AS level, a.spn AS span FROM gold a JOIN gold b ON a.doc = b.doc AND a.part = b.part GROUP BY a.doc, a.row, a.part, a.spn"),
    "assigned_rows": sql(("gold",), "SELECT doc, count(*) AS lines, count(*) AS own FROM gold GROUP BY doc"),
    "resized_pages": "WITH p AS (SELECT p_partkey, (p_size * 37 + 20)::DOUBLE AS h, (p_partkey % 900 + 30)::DOUBLE AS w FROM part), n AS (SELECT *, greatest(round_even(h / 28, 0) * 28, 28) AS nh, greatest(round_even(w / 28, 0) * 28, 28) AS nw FROM p), r AS (SELECT p_partkey, CASE WHEN nh * nw > 600000 THEN greatest(floor(h / sqrt(h * w / 600000) / 28) * 28, 28) WHEN nh * nw < 3136 THEN ceil(h * sqrt(3136 / (h * w)) / 28) * 28 ELSE nh END AS h, CASE WHEN nh * nw > 600000 THEN greatest(floor(w / sqrt(h * w / 600000) / 28) * 28, 28) WHEN nh * nw < 3136 THEN ceil(w * sqrt(3136 / (h * w)) / 28) * 28 ELSE nw END AS w FROM n) SELECT p_partkey, h::BIGINT AS h, w::BIGINT AS w FROM r",
    "recorded_batches": sql(("gold",), "SELECT NOT (doc % 7 = 0 AND n > 1) AS ok, count(*) AS n FROM (SELECT doc, count(*) AS n FROM gold GROUP BY doc) GROUP BY 1"),
}
