"""The descent against its optimality conditions, the features against sets, and held-out rows."""

import math
import re

import numpy as np
import xxhash

from fieldloom.llm import quality as q
from fieldloom.llm import queries
from fieldloom.llm._common import Numbered

SF = "/root/testdata/sf0.01"


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.sign(x @ rng.normal(size=5) + 0.3 * rng.normal(size=60))
    cost = np.full(60, 0.7)
    w, b, a = q.dual_coordinate_descent([(np.arange(5), r) for r in x], y, cost, 5, epochs=3000)
    assert np.allclose(w, (a * y) @ x) and np.isclose(b, (a * y).sum())
    primal = 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (x @ w + b))).sum()
    dual = a.sum() - 0.5 * (w @ w + b * b)
    assert abs(primal - dual) < 1e-3


def test_features_are_sets_of_ngrams_within_a_text():
    texts = ["A b a b", "", "!! x", "A b a b", "b"]
    feats, cuts = q.features(texts, Numbered(q._token_rows))
    sets = [set(feats[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert sets[0] == sets[3] and not sets[1] and len(sets[4]) == 1 and sets[4] < sets[0]
    toks = [re.findall(r"\w+|[^\w\s]+", t) for t in texts]
    words = [{*map(str.lower, t)} | {*zip(map(str.lower, t), map(str.lower, t[1:]))} for t in toks]
    assert [len(s) - max(0, len(t) - 2 and 1) * 0 for s, t in zip(words, toks)][1] == 0
    assert len(sets[2]) == len(words[2])


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(got[i], y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 80
    good = sum(r.predicted == y for r, y in held) / len(held)
    up, down = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])
    assert good > 0.95 and auc > 0.97, (good, auc)


def by_hand(text, model):
    """A text's score from the model's arrays, n-gram by n-gram."""
    m, odd, found = 2**64, 0x9E3779B97F4A7C15, set()

    def bucket(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % m
        return (x ^ (x >> 31)) % q.BUCKETS

    toks = re.findall(r"\w+|[^\w\s]+", text)
    h = [xxhash.xxh64_intdigest(t.lower()) for t in toks]
    shape = []
    for t in toks:
        word = t[0].isalnum() or t[0] == "_"
        digit = any(c.isdigit() and c.isdecimal() for c in t)
        shape.append((1 if t.islower() else 2 if t.isupper() and len(t) > 1 else 3 if t.istitle() else 5 if digit else 4) if word else 16 + xxhash.xxh32_intdigest(t))
    for i in range(len(toks)):
        found.add(bucket(h[i]))
        if i + 1 < len(toks):
            found.add(bucket((h[i] * odd + h[i + 1]) % m))
        if i + 2 < len(toks):
            found.add(bucket((((shape[i] * odd + shape[i + 1]) * odd + shape[i + 2]) + 7) % m))
    norm = sum(float(model.ratio[f]) ** 2 for f in found) ** 0.5
    dot = sum(float(model.ratio[f]) * float(model.weight[f]) for f in found)
    return 1 / (1 + math.exp(-(model.slope * (dot / norm + model.bias if norm else model.bias) + model.offset)))


def test_scores_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = q.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    some = docs.where("doc_id < 60")
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    for r in q.score(some, model).collect():
        assert abs(r.score - by_hand(texts[r.doc_id], model)) < 1e-5


def test_the_fit_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    one, two = q.learn(docs.repartition(1), labels, rows=80), q.learn(docs.repartition(5).union(docs.limit(9)), labels.repartition(3), rows=80)
    assert np.array_equal(one.weight, two.weight) and (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "GOOD text here" if i % 2 else "BAD!! BAD!!", 0.5) for i in range(60)] + [(60, None, 1.0), (61, "", 1.0), (None, "x", 1.0), (1, "good", 1.0), (62, "bad!! " * 50_000, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(60, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, text int")
    model = q.learn(docs, labels)
    out = q.score(docs, model).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r.score for r in out if r.doc_id not in (1, None)}
    assert by[3] > 0.9 > 0.1 > by[4] and by[60] == by[61] and by[62] < 0.5
    assert q.score(docs.limit(0), model).count() == 0
    none = q.learn(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, none).collect()} == {0.5}
