"""Raking against plain numpy, the draw against the SQL."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fieldloom.llm import mixing as m
from fieldloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_marginals_meet_the_targets(spark):
    rng = np.random.default_rng(4)
    t = rng.integers(1, 1000, (3, 2, 4))
    goals = {"source": {"0": 0.2, "1": 0.5, "2": 0.3}, "lang": {"0": 0.6, "1": 0.4}, "topic": {str(k): 0.25 for k in range(4)}}
    rows = [(str(a), str(b), str(c), int(t[a, b, c])) for a, b, c in np.ndindex(*t.shape)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    out = m.rake(cells, goals, sweeps=12).toPandas()
    w = t / 1.0
    for _ in range(12):
        for axis, name in enumerate(m.DIMENSIONS):
            other = tuple(x for x in range(3) if x != axis)
            shape = [-1 if x == axis else 1 for x in range(3)]
            w = w * (np.array(list(goals[name].values())) / w.sum(axis=other)).reshape(shape)
    got = out.set_index(["source", "lang", "topic"]).weight
    for a, b, c in np.ndindex(*t.shape):
        assert abs(got[str(a), str(b), str(c)] - w[a, b, c]) < 1e-9
    for name, goal in goals.items():
        assert np.allclose(out.groupby(name).weight.sum(), list(goal.values()), atol=1e-4)
    assert abs((out.probability * out.tokens).sum() / out.tokens.sum() - m.BUDGET) < 0.02 and out.probability.max() <= 1


def test_query_matches_its_sql(spark):
    got = queries.op7_mixing(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op7_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert 0.3 < got.kept.mean() < 0.9


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "a b", "s", None), (2, "a b", "s", None), (3, "", None, "en"), (None, "x | y", "s", "en"), (5, "w " * 60_000, "s", "de")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, lang string, topic string")
    out = m.mix(docs).collect()
    assert len(out) == 6 and sorted(r.n_tokens for r in out) == [0, 0, 2, 2, 3, 60_000] and all(0 <= r.probability <= 1 for r in out)
    assert len({r.kept for r in out if r.doc_id == 2}) == 1
    assert m.draw(docs).columns == docs.columns
    assert m.mix(docs.limit(0)).count() == 0
    assert m.mix(docs.where("doc_id = 3")).count() == 1
    assert m.mix(docs, {"source": {"s": 1.0}, "lang": {}}).where(F.col("probability").isNull()).count() == 0


def test_report_of_the_fit(spark):
    rows = [("s%d" % (k % 3), "en" if k % 4 else "de", "t%d" % (k // 12), 100 + 7 * k) for k in range(24)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long").groupBy("source", "lang", "topic").agg({"tokens": "sum"}).toDF("source", "lang", "topic", "tokens")
    targets = {"source": {"s0": 2.0, "s1": 1.0, "s2": 1.0}, "lang": {"en": 1.0, "de": 1.0}}
    raked = m.rake(cells, targets, sweeps=6, budget=0.3)
    report = m.fit_report(raked, targets).collect()
    assert {(r.dimension, r.value): round(r.target, 6) for r in report if r.dimension != "topic"} == {("source", "s0"): 0.5, ("source", "s1"): 0.25, ("source", "s2"): 0.25, ("lang", "en"): 0.5, ("lang", "de"): 0.5}
    assert all(abs(r.raked - r.target) < 0.02 for r in report)
    assert abs(m.expected_share(raked) - 0.3) < 1e-9
    tight = m.rake(cells, {"source": {"s0": 1.0}}, budget=0.9)  # more than there is
    assert m.expected_share(tight) < 0.9 and tight.where("probability > 1").count() == 0
    empty = m.rake(cells.limit(0))
    assert empty.count() == 0 and m.expected_share(empty) is None and m.fit_report(empty).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert m.draw(docs).count() == 0
