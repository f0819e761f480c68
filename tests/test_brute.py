"""Queries without SQL against plain Python, over whole small tables; salvage and keys on odd texts."""

import json
import random
from itertools import product

from pyspark.sql import functions as F

from fieldloom.operators import checks, json_pages, sharding
from fieldloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def cut_back(text):
    """The longest prefix that ends in a bracket and some brackets make an object."""
    try:
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        pass
    for end in range(len(text), 0, -1):
        if text[end - 1] not in "}]":
            continue
        for n in range(1, 5):
            for closers in product("}]", repeat=n):
                try:
                    if isinstance(json.loads(whole := text[:end] + "".join(closers)), dict):
                        return whole
                except ValueError:
                    continue
    return None


def test_salvage_against_every_cut():
    r = random.Random(4)

    def made(depth):
        kind = r.random()
        if depth > 2 or kind < 0.4:
            return r.choice([1, -2.5, True, None, "x", 'q"}]', "a\\", "[{"])
        return [made(depth + 1) for _ in range(r.randrange(3))] if kind < 0.7 else {f"k{i}": made(depth + 1) for i in range(r.randrange(3))}

    for _ in range(60):
        text = json.dumps({"a": made(0), "b": made(0)})
        for end in range(0, len(text) + 1, 3):
            assert json_pages.salvage(text[:end]) == cut_back(text[:end]), text[:end]


def test_a_closer_of_the_wrong_kind_is_malformed():
    assert json_pages.salvage('{"a":[{"b":1}],"c":{"d":[1}, "e') is None
    assert json_pages.salvage('{"a": [1]]') is None and json_pages.salvage("}{") is None and json_pages.salvage("") is None


def test_salvaged_json(spark):
    keys = {r.o_orderkey for r in table(spark, "orders")}
    got = catalogue.queries()["salvaged_json"](spark, SF).collect()
    assert {r.o_orderkey for r in got} == keys
    for r in got:
        rec = '{"k": {"id": %d}, "rows": [["a", 1], ["b", 2], ["c' % r.o_orderkey
        assert r.json == cut_back(rec[: r.o_orderkey % 40 + 8])


def test_doc_windows(spark):
    lines = {}
    for r in table(spark, "lineitem"):
        lines[r.l_orderkey] = lines.get(r.l_orderkey, 0) + 1
    want, state = {}, {}
    for key in sorted(lines):
        at, total = state.get(key % 16, (0, 0))
        want[key] = at
        total += lines[key]
        state[key % 16] = (at + 1, 0) if total >= 24 else (at, total)
    assert {r.l_orderkey: r.window for r in catalogue.queries()["doc_windows"](spark, SF).collect()} == want


def test_windows_of_any_weights(spark):
    r = random.Random(1)
    rows = [(g, i, r.choice((0, 0, 1, 5, 40))) for g in "ab" for i in range(40)]
    got = {(x.g, x.o): x.window for x in sharding.windows(spark.createDataFrame(rows, "g string, o int, w int"), "g", "o", "w", 7).collect()}
    state = {}
    for g, i, w in rows:
        at, total = state.get(g, (0, 0))
        assert got[g, i] == at
        state[g] = (at + 1, 0) if total + w >= 7 else (at, total + w)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_fuzzy_names(spark):
    parts = [(r.p_partkey, r.p_name, r.p_brand, r.p_size) for r in table(spark, "part")]
    best = {}
    for k, n, b, s in parts:
        for o, m, c, t in parts:
            short, long = sorted((len(n), len(m)))
            if k != o and (b, s) == (c, t) and short * 140 >= long * 60:
                ratio = 200 * common(n, m) / (len(n) + len(m))
                best[k] = max(best.get(k, 0), ratio)
    got = {r.p_partkey: r.ratio for r in catalogue.queries()["fuzzy_names"](spark, SF).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-3 for k in got)


def test_json_value_spans(spark):
    props = {r.event_id: r.props for r in table(spark, "events")}
    seen = {}
    for r in catalogue.queries()["json_value_spans"](spark, SF).collect():
        assert r.complete
        seen.setdefault(r.event_id, {})[r.path] = props[r.event_id][r.start : r.end]
    for key, text in props.items():
        assert {p: json.loads(v) for p, v in seen[key].items()} == json.loads(text)


def test_duplicate_keys_and_dates(spark):
    texts = ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 2}, "b": 0}', '{"x\\"y": 1, "z": "\\"x\\": 1,", "x\\"y": 2}', "{}", None, '{"a": [{"a": [1, {"a": 2}]}], "c": "}", "c": 1, "a": 1}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.k for r in df.select("i", checks.duplicate_keys("t").alias("k")).orderBy("i").collect()]
    assert got == [["a"], [], ['x\\"y'], [], None, ["a", "c"]]
    pairs = [("3 mar 71", None), ("3-Mar-71", "1971-03-03"), ("3-Mar-08", "2008-03-03"), ("03/04/20", "2020-04-03"), ("03/04/20", "2020-03-04"), ("2020-04-03", "2020-04-03"), ("2020-04-03 10:00", "2020-04-03"), ("20200403", "2020-04-03"), (None, "2020-04-03"), ("40/01/2020", "2020-01-40")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p string, g string")
    assert [r.m for r in df.select("i", checks.date_matches("p", "g").alias("m")).orderBy("i").collect()] == [False, True, True, True, True, False, True, True, False, False]
    assert df.select(F.sum(checks.item_like("p", "total").cast("int"))).first()[0] is not None
