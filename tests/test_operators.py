"""Operators that the catalogue does not reach, on small literal tables and files."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import similarity
from fieldloom.operators import calibration, clustering, decisions, integrity, json_pages, layout, matching, merging, rules, scoring, sharding
from fieldloom.sources import tables
from fieldloom.streaming import logs


def test_similarity():
    assert similarity.common_length("AGCAT", "GAC") == 2 and similarity.indel_similarity("", "") == 1.0
    assert similarity.indel_similarity("abcd", "bcde") == 0.75 and similarity.indel_similarity("a", "b") == 0.0


def test_salvage_and_spans():
    assert json_pages.salvage('{"a": {"b": 1}, "c": [1, 2], "d": "x') == '{"a": {"b": 1}, "c": [1, 2]}'
    assert json_pages.salvage('{"a": [{"q": "}"}, {"q": 2}, {"q"') == '{"a": [{"q": "}"}, {"q": 2}]}'
    assert json_pages.salvage('{"a": 1') is None and json_pages.salvage("[1]") is None and json_pages.salvage(None) is None
    assert json_pages.salvage('{"a": 1}') == '{"a": 1}'
    text = '{"h": {"n": "a\\"b", "n": 1.50}, "r": [["x", null], ["y'
    spans = {p: (text[a:b], ok) for p, a, b, ok in json_pages.value_spans(text)}
    assert spans == {"h.n": ("1.50", True), "r.0.0": ('"x"', True), "r.0.1": ("null", True), "r.1.0": ('"y', False)}


def test_json_columns(spark):
    raw = ['{"n": 1234.50, "s": "7, 8.0 \\" 9", "e": 1E+6}', '{"n": [1', "[1]", None, '{"n": NaN}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string")
    got = [r.j for r in df.select("i", json_pages.parse_page("t", "n string, s string, e string").alias("j")).orderBy("i").collect()]
    assert tuple(got[0]) == ("1234.50", '7, 8.0 " 9', "1E+6") and got[1:] == [None] * 4
    page = '{"dt": "invoice", "h": {"in": "5"}, "r": [["a", null, "c", "1.0"]], "pk": "single"}'
    bad = page.replace('"1.0"', '"1.0", "2"')
    df = spark.createDataFrame([(1, page), (2, bad)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", json_pages.expand_compact("t").alias("p")).collect()}
    assert got[1].line_items[0].quantity == "1.0" and got[1].line_items[0].customer_part_number is None and got[2] is None
    spans = spark.createDataFrame([(1, "a", 0, 4), (1, "b", 10, 12)], "k int, path string, start int, end int")
    toks = spark.createDataFrame([(1, 0, 2, -0.5), (1, 2, 5, -1.5), (1, 9, 11, float("-inf"))], "k int, start int, end int, lp double")
    got = {r.path: (r["min"], r["mean"], r["n"]) for r in json_pages.span_logprobs(spans, toks, "k").collect()}
    assert got == {"a": (-1.5, -1.0, 2), "b": (None, None, 1)}


def test_greedy_alignment(spark):
    a = spark.createDataFrame([(1, 1, "ABCDE"), (1, 2, "ABCDX"), (1, 3, ""), (1, 4, "zz")], "doc int, row long, k string")
    b = spark.createDataFrame([(1, 1, "ABCDX1"), (1, 2, "ABCDE"), (1, 3, ""), (1, 5, "q")], "doc int, row long, k string")
    got = sorted(map(tuple, matching.align_rows(a, b, "doc", "row", [F.col("k")], "k").collect()))
    assert (1, 1, 2, 1) in got and (1, 2, 1, 3) in got and (1, 3, 3, 1) in got and len(got) == 3
    c = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.95), (1, 2, 2, 0.9), (1, 2, 1, 0.1)], "doc int, l int, r int, s double")
    assert sorted((r.l, r.r) for r in matching.greedy_candidates(c, "doc", "l", "r", "s").collect()) == [(1, 2), (2, 1)]


def test_merge_pages(spark):
    cell = {"supplier_part_number": "A1", "customer_part_number": None, "purchase_order": None, "quantity": "2"}
    head = dict.fromkeys(cell, None) | {"supplier_part_number": "Part No"}
    pages = [
        ("d", 1, "invoice", {"invoice_number": None, "total_amount": "5"}, [cell, cell, head]), ("d", 2, "waybill", {"invoice_number": "X", "total_amount": "9"}, [cell, dict.fromkeys(cell, None)]),
        ("d", 3, "invoice", {"invoice_number": None, "total_amount": " "}, None), ("e", 1, None, None, None), ("w", 1, "waybill", {"invoice_number": "1", "total_amount": None}, [cell]),
    ]
    row = "struct<supplier_part_number:string,customer_part_number:string,purchase_order:string,quantity:string>"
    df = spark.createDataFrame(pages, f"doc_id string, page int, doc_type string, header struct<invoice_number:string,total_amount:string>, line_items array<{row}>")
    got = {r.doc_id: r for r in merging.merge_pages(df).collect()}
    assert got["d"].doc_type == "invoice" and got["d"].header.invoice_number is None and got["d"].header.total_amount == "9" and len(got["d"].line_items) == 3
    assert got["e"].doc_type == "invoice" and got["e"].line_items == [] and got["w"].doc_type == "waybill" and got["w"].line_items == []
    docs = spark.createDataFrame([("d", 3, list("abcdefg")), ("s", 2, ["x"])], "doc string, n int, items array<string>")
    assert sorted((r.doc, r.page, "".join(r.rows)) for r in merging.split_pages(docs, "doc", "n", "items").collect()) == [("d", 0, "abc"), ("d", 1, "de"), ("d", 2, "fg"), ("s", 0, "x"), ("s", 1, "")]


def test_totals_hints_and_print(spark):
    lines = spark.createDataFrame([("d", 1, 1, "Total 5.00"), ("d", 2, 1, "Subtotal 7"), ("d", 2, 2, "TOTAL: 1,200.50 EUR"), ("d", 2, 3, "Total pieces")], "doc string, page int, line int, text string")
    got = merging.labelled_totals(lines, "doc", "page", "line", "text", "(?i)total", "(?i)subtotal").collect()
    assert [(r.page, r.line, r.number) for r in got] == [(2, 2, "1,200.50")]
    cells = spark.createDataFrame([("inv", "a", None), ("inv", "a", "x"), ("inv", "b", "y"), ("inv", "b", "z")], "t string, f string, v string")
    assert [(r.f, r.null_rate) for r in merging.not_printed(cells, ["t", "f"], "v").collect()] == [("a", 0.5)]


def test_rules(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 0.2, True), ("a", None, 0.1, 0.9, True), (None, "b", 0.0, 0.9, False), (None, "b", 0.0, 0.9, True), ("a", "A ", 0.5, 0.9, True), (" ", None, 0.5, 0.5, True)], "o string, n string, p double, q double, s boolean")
    got = [r.d for r in df.select(rules.reread_decision("o", "n", "p", "q", "s").alias("d")).collect()]
    assert [(d.action, d.reason) for d in got] == [("keep", "not_better"), ("keep", "reread_blank"), ("keep", "fill_unsupported"), ("take", "filled"), ("take", "replaced"), ("keep", "both_blank")]
    nulls = df.select(rules.null_policy("o", "p", "q").alias("v")).collect()
    assert [r.v for r in nulls] == ["a", None, None, None, None, " "]


def test_taxonomy(spark):
    df = spark.createDataFrame([("5", None), (None, "5"), ("A-1", "a1"), ("1,000.0", "1000"), ("Bolt", "Nut"), ("AB123456", "AB123457"), ("zzz", "yyyyy"), (None, None)], "p string, g string").withColumn("sib", F.array(F.lit("bolt")))
    got = [r.c for r in df.select(scoring.classify_value("p", "g", "sib", F.lit(True)).alias("c")).collect()]
    assert got == ["false_fill", "missed", None, "normalization", "wrong_field", "misread", "other", None]
    df = spark.createDataFrame([("A-1", "a1"), ("A01", "AO1"), ("AB", "ABC"), ("AXC", "AYC"), ("ABCD", "XBC")], "p string, g string")
    assert [r.c for r in df.select(scoring.edit_class("p", "g").alias("c")).collect()] == ["punctuation_only", "glyph_confusion", "char_dropped_or_added", "other_substitution", "mixed"]


def test_layout(spark):
    boxes = spark.createDataFrame([("a", 50.0, 1.0, 60.0, 11.0), ("b", 5.0, 2.0, 15.0, 12.0), ("c", 1.0, 20.0, 9.0, 30.0)], "t string, x double, y0 double, x1 double, y1 double").withColumn("page", F.lit(1))
    lines = layout.reading_lines(boxes, ["page"], "x", "y0", "y1", "t")
    assert layout.page_text(lines, ["page"], "t").first().text == "b a\nc"
    df = spark.createDataFrame([([[0.0, 0.0], [10.0, 0.0], [10.0, 5.0], [0.0, 5.0]], 90, 100.0, 40.0)], "p array<array<double>>, a int, w double, h double")
    r = df.select(layout.unrotate("p", "a", "w", "h").alias("u"), layout.aabb("p").alias("b")).first()
    assert r.u[1] == [0.0, 30.0] and (r.b.x1, r.b.y1) == (10.0, 5.0)
    r = df.withColumn("b", layout.aabb("p")).select(layout.pad_box("b", 0.1, 0.5, "w", "h", 20.0).alias("q")).first().q
    assert (r.x0, r.y0, r.x1, r.y1) == (0.0, 0.0, 15.0, 12.5)
    with pytest.raises(Exception, match="multiple of 90"):
        df.withColumn("a", F.lit(45)).select(layout.unrotate("p", "a", "w", "h")).collect()


def test_sharding_and_decisions():
    assert sharding.balance([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sharding.quotas({"a": 1, "b": 10, "c": 10}, 9) == {"a": 1, "b": 4, "c": 4}
    assert decisions.prefer(0.1, {"over_nulls": 1, "false_fills": 2}, {"over_nulls": 1, "false_fills": 2})["take"]
    assert not decisions.prefer(math.nan, {"over_nulls": 1, "false_fills": 2}, {"over_nulls": 1, "false_fills": 2})["take"]
    assert not decisions.prefer(1, {"over_nulls": 1}, {"over_nulls": 1, "false_fills": 2})["take"]
    assert decisions.ship_rule(0.1, 0, {"g": 0.0}) and not decisions.ship_rule(0.1, 1) and not decisions.ship_rule(None, 0)
    assert decisions.choose_batch({1: {"memory": 1, "seconds": 9, "agreement": 1}, 8: {"memory": 5, "seconds": 3, "agreement": 1}, 4: {"memory": 2, "seconds": 4, "agreement": 1}}, 4) == 4
    assert calibration.assign_folds([("a", 10, 5), ("b", 5, 5), ("c", 5, 0), ("d", 2, 0)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert calibration.choose({"lr": 0.30, "gbm": 0.295}, "lr") == "lr" and calibration.choose({"lr": 0.30, "gbm": 0.28}, "lr") == "gbm"


def test_windows_and_sizes(spark):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate([3, 3, 5, 1, 9, 1])], "g string, o int, w int")
    assert [r.window for r in sharding.windows(df, "g", "o", "w", 6).orderBy("o").collect()] == [0, 0, 1, 1, 2, 3]
    got = spark.createDataFrame([(1,), (2,), (8,), (9,)], "n int").select(sharding.smaller_batch("n").alias("b")).collect()
    assert [r.b for r in got] == [0, 1, 4, 8]
    r = spark.createDataFrame([(1000, 2000), (10, 20)], "h int, w int").select(sharding.resized("h", "w", 1_000_000).alias("s")).collect()
    assert r[0].s.h * r[0].s.w <= 1_000_000 and r[1].s.h % 28 == 0 and r[1].s.h * r[1].s.w >= 3136


def test_portable_model(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), None if i % 50 == 0 else float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y int")
    m = calibration.fit_portable(df, ["a", "b"], "y")
    assert calibration.PortableModel.loads(m.dumps()) == m and m.coef[0] > 1 > 0 > m.coef[1]
    assert df.withColumn("p", m.probability()).where((F.col("p") > 0.5).cast("int") == F.col("y")).count() > 250
    one = calibration.fit_portable(df.where("y = 1"), ["a"], "y")
    assert one.coef == (0.0,) and one.intercept > 3


def test_clusters_and_threshold(spark):
    v = spark.createDataFrame([(i, [float(i % 2) * 10, float(i)]) for i in range(20)], "id int, v array<double>")
    out = clustering.assign_clusters(clustering.fit_clusters(v, "v", 2), v, "v")
    assert out.select("cluster").distinct().count() == 2
    a, b = (spark.createDataFrame([(float(x),) for x in xs], "d double") for xs in (range(100), range(90, 190)))
    r = clustering.calibrate_threshold(a, b, "d").first()
    assert abs(r.threshold - 94.05) < 1e-9 and r.fpr == 0.05 and r.tpr == 0.95


def test_sources(spark, tmp_path):
    gold = {"doc_id": "d1", "doc_type": "invoice", "header": {"invoice_number": "5"}, "line_items": [], "pages": ["p1"]}
    for s, n in (("a", "5"), ("b", "6")):
        (tmp_path / s).mkdir()
        (tmp_path / s / "d1.json").write_text(json.dumps(gold | {"header": {"invoice_number": n}}))
    assert [r.header.invoice_number for r in tables.gold_of(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()] == ["6"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"k": 1}\n\n{"k": 2}\n{"k": 3')
    assert sorted(r.k for r in tables.torn_jsonl(spark, str(log), "k int").collect()) == [1, 2]
    log.write_text('{"k": 1\n{"k": 2}\n')
    with pytest.raises(Exception, match="damaged"):
        tables.torn_jsonl(spark, str(log), "k int").collect()
    (tmp_path / "codes.txt").write_text("# list\nusd # dollar\nEUR\n\n")
    assert sorted(r.code for r in tables.codes(spark, str(tmp_path / "codes.txt")).collect()) == ["EUR", "USD"]
    (tmp_path / "img").mkdir()
    for n in ("inv_1_p1.png", "inv_1_p2.png", "wb.png"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted((r.doc_id, r.page) for r in tables.files(spark, str(tmp_path / "img")).collect()) == [("inv_1", 1), ("inv_1", 2), ("wb", 1)]
    want, got = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", 1), ("b", 0)], "k string, v int")
    assert {r.k: r.status for r in tables.cache_status(want, got, "k", F.col("v") > 0).collect()} == {"a": "valid", "b": "invalid", "c": "missing"}
    assert [r.k for r in tables.pending(want, got, "k").collect()] == ["c"]
    with pytest.raises(ValueError, match="not written"):
        tables.write_checked(got, str(tmp_path / "out"), integrity.check_ids(got, want, "k"))
    with pytest.raises(ValueError, match="hold values"):
        tables.write_numbers_csv(got, str(tmp_path / "csv"))
    assert len(tables.ids_digest(want, "k").first().digest) == 16
    assert tables.markdown([("a", None)], ["x", "y"]).splitlines()[2] == "| a |  |"


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"run": "r", "step": 1, "ts": "2024-01-01T00:00:00"}\n{"run": "r", "step": 2, "ts": "2024-01-01T00:10:00"}\n{"run": "r", "step": 3, "ts": "2024-01-01T03:00:00"}\n')
    schema = "run string, step long, ts timestamp"
    for _ in range(2):
        q = logs.append_once(logs.read_log(spark, str(src), schema), out, "step", str(tmp_path / "cp"))
        q.awaitTermination()
        (src / "2.json").write_text('{"run": "r", "step": 2, "ts": "2024-01-01T04:00:00"}\n{"run": "r", "step": 4, "ts": "2024-01-01T09:00:00"}\n')
    assert sorted(r.step for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    q = logs.highest_step(logs.read_log(spark, str(src), schema, files_at_once=1), "run", "step").writeStream.outputMode("update").format("memory").queryName("steps").trigger(availableNow=True).start()
    q.awaitTermination()
    assert (4, 2) in {(r.step, r.dropped) for r in spark.table("steps").collect()}
    w = logs.windowed(logs.read_log(spark, str(src), schema), "ts", ["run"], "step", "1 hour")
    q = w.writeStream.outputMode("append").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.table("hours").collect()) >= 3
