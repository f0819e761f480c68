"""Spaced seeds against brute force over all diagonals."""

import random
import re

import numpy as np

from fieldloom.llm import decontaminate as d

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute_span(equal):
    n, best = len(equal), (0, 0)
    for a in range(n):
        for b in range(a + 1, n + 1):
            if 5 * sum(equal[a:b]) >= 4 * (b - a) and b - a > best[1] - best[0]:
                best = (a, b)
    return best


def test_longest_span():
    r = random.Random(1)
    for _ in range(300):
        e = np.array([r.random() < 0.75 for _ in range(r.randrange(0, 30))], dtype=bool)
        a, b, m = d.longest_span(e)
        x, y = brute_span(e.tolist())
        assert (b - a, m) == (y - x, int(e[a:b].sum()))
        assert 5 * m >= 4 * (b - a)


def brute(docs, items):
    out = set()
    for i, t in docs:
        w = words(t)
        for j, p in items:
            q = words(p)
            if len(q) < 5:
                continue
            for s in range(-len(q) + 1, len(w)):
                lo, hi = max(0, -s), min(len(q), len(w) - s)
                e = np.array([w[s + k] == q[k] for k in range(lo, hi)], dtype=bool)
                if e.sum() >= 5 and (lambda x: x[1] - x[0])(d.longest_span(e)) >= min(d.MIN_SPAN, len(q)):
                    out.add((i, j))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(vocab, k=n))) for k, n in enumerate((5, 8, 14, 20, 30, 60, 3, 0))] + [(8, None)]
    docs = [(100, None), (101, ""), (102, "w1 w2")]
    for k in range(60):
        w = r.choices(vocab, k=r.randrange(5, 120))
        if k % 2:
            q = words(items[r.randrange(6)][1])
            for x in range(0, len(q), r.choice((6, 7, 9, 99))):
                if x and k % 3:
                    q[x] = "zz"
            at = r.randrange(len(w))
            w[at:at] = q if k % 5 else q[: len(q) // 2]
        docs.append((k, " ".join(w).upper() if k % 4 else ",  ".join(w)))
    for gap in (30, 60, 90, 130):  # several stretches of one document, near its start
        w = words(items[2][1]) + r.choices(vocab, k=gap) + words(items[3][1]) + r.choices(vocab, k=gap) + words(items[2][1])
        docs.append((200 + gap, " ".join(w)))
    docs += [(102, "another text of that id " + items[4][1])]
    docs += [docs[5], (None, items[5][1])]
    a = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id) for x in d.overlaps(a, b).collect()}
    assert got == brute(docs, items)
    flagged = {x.doc_id for x in d.report(a, b).collect() if x.contaminated}
    assert flagged == {i for i, _ in got} and d.report(a, b).count() == len(docs)
    kept = d.clean(a, b)
    assert kept.columns == a.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - flagged
    assert d.report(a.limit(0), b).count() == 0 and d.overlaps(a, b.limit(0)).count() == 0


def test_overlaps_are_those_of_the_whole_texts(spark):
    """Begin, span and matched against every diagonal of whole texts: an overlap with long
    changed stretches, several regions, text ids, ties and a very long document."""
    r = random.Random(8)
    vocab = [f"v{k}" for k in range(3000)]
    passage = r.choices(vocab, k=400)
    changed = passage[:170] + ["zz"] * 60 + passage[170 + 60 :]
    items = [("q-1", " ".join(passage)), ("q-2", " ".join(passage)), ("q-3", " ".join(r.choices(vocab, k=15)))]
    docs = [("a", " ".join(changed)), ("b", " ".join(["pad"] * 700 + changed + ["pad"] * 300)), ("c", " ".join(passage[:30] + ["x"] * 90 + words(items[2][1])))]
    docs += [("long", " ".join(r.choices(vocab, k=30_000) + passage)), ("c", "other row " + items[2][1]), ("b", " ".join(["pad"] * 700 + passage[:40]))]
    want = {}
    for i, t in docs:
        w = words(t)
        for j, p in items:
            q = words(p)
            for s in range(-len(q) + 1, len(w)) if len(w) < 2000 else (len(w) - len(q),):
                lo, hi = max(0, -s), min(len(q), len(w) - s)
                x, y, m = d.longest_span(np.array([w[s + k] == q[k] for k in range(lo, hi)], dtype=bool))
                if y - x >= d.MIN_SPAN:
                    best = want.get((i, j))
                    this = (y - x, m, -(s + lo + x))
                    want[i, j] = max(best or this, this)
    a = spark.createDataFrame(docs, "doc_id string, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = {(x.doc_id, x.item_id): (x.span, x.matched, -x.begin) for x in d.overlaps(a, b).collect()}
    assert got == want and got["a", "q-1"] == (400, 340, 0)
    assert {(x.doc_id, x.item_id, x.n_items) for x in d.report(a, b).collect()} == {("a", "q-1", 2), ("b", "q-1", 2), ("c", "q-1", 3), ("long", "q-1", 2)}


def test_shuffled_path_gives_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = sorted(map(tuple, d.report(docs, items).collect()))
    assert any(x[1] for x in want)
    monkeypatch.setattr(d, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(d, "MIN_BITS", 64)
    monkeypatch.setattr(d, "MAX_BITS", 64)
    assert sorted(map(tuple, d.report(docs, items).collect())) == want
