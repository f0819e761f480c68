"""Classes against brute force over all pairs; registers against the similarity they estimate."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import near_dedup as nd
from fieldloom.llm import queries
from fieldloom.llm._common import Numbered

SF = "/root/testdata/sf0.001"


def grams(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(docs):
    """class id by row number"""
    sets = [grams(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                same = len(sets[i] & sets[j])
                if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same) - 1e-9:
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(docs))]


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a = {k: int(rng.integers(1, 9)) for k in range(1, 60)}
    b = {k: int(rng.integers(1, 9)) for k in range(30, 90)}
    of = np.array([0] * len(a) + [1] * len(b))
    el = np.array([*a, *b], dtype=np.uint64) * np.uint64(7919)
    won = nd.prob_minhash(of, el, np.array([*a.values(), *b.values()]), 2, 6000)
    jp = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in {*a, *b}) for d in {*a} & {*b})
    assert abs((won[0] == won[1]).mean() - jp) < 0.02
    first = [(won[0] == np.uint64(k * 7919)).mean() for k in a]
    assert np.allclose(first, np.array([*a.values()]) / sum(a.values()), atol=0.01)


def test_shingles_are_counted_within_a_text():
    texts = ["a b c d e f a b c d e", "", "x y", "A b, c d e"]
    of, el, w = nd.shingles(*nd._tokens(texts, Numbered(nd._hashes)))
    assert np.bincount(of, minlength=4).tolist() == [6, 0, 1, 1] and w.max() == 2
    assert el[-1] in el[of == 0]


def make(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(900)]
    base = [r.choices(vocab, k=r.choice((3, 6, 40, 150))) for _ in range(12)]
    shared = r.choices(vocab, k=60)
    docs = []
    for k in range(n):
        w = list(base[r.randrange(12)])
        for _ in range(r.choice((0, 0, 1, 2, 4, 8))):
            w[r.randrange(len(w))] = r.choice(vocab)
        if k % 6 == 0:
            w = r.choices(vocab, k=25) + shared + r.choices(vocab, k=8)
        docs.append((k, " ".join(w) if k % 5 else ", ".join(w).upper()))
    return docs


ODD = [(900, None), (901, ""), (902, " .,"), (903, "one"), (904, "One!"), (None, "one two three four five six"), (7, "same id other text here now"), (905, "z " * 40_000)]


def test_classes_match_brute_force(spark):
    docs = make(1) + make(2)[:30] + ODD
    docs = [(d if d is None or i < 60 or d >= 900 or i >= 90 else d + 200, t) for i, (d, t) in enumerate(docs)] + [docs[3]]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string")
    want = brute(docs)
    got = sorted(((r.doc_id, r.class_id) for r in nd.classes(df).collect()), key=str)
    assert got == sorted([(d, c if t and re.search(r"\w", t) else d) for (d, t), c in zip(docs, want)], key=str)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    rows = sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None)
    expect = {(d, nd_text) for (d, nd_text), c in zip(((d, t or "") for d, t in docs), want) if d is not None and (d == c or c is None or not re.search(r"\w", nd_text))}
    assert rows == sorted(expect)
    assert nd.classes(df.limit(0)).count() == 0 and nd.keep_one(df.limit(0)).count() == 0


def test_divided_buckets_lose_no_class(spark, monkeypatch):
    docs = make(5, 80)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(nd, "PAIRS_PER_MEMBER", 0)
    assert {r.doc_id: r.class_id for r in nd.classes(df).collect()} == dict(zip((d for d, _ in docs), brute(docs)))


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(9)
    base = [f"q{k}" for k in range(300)]
    docs = []
    for k in range(400):
        w = list(base)
        for _ in range(3):
            w[r.randrange(300)] = f"e{k}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.class_id for x in nd.classes(df).collect()} == {0}


def repeated(seed, pairs=60):
    """Lone pairs of near copies, one of each with a line said a hundred times."""
    r, docs = random.Random(seed), []
    for k in range(pairs):
        w, line = [f"u{k}x{i}" for i in range(120)], [f"l{k}x{i}" for i in range(30)]
        near = list(w)
        near[r.randrange(5, 115)] = f"n{k}"
        docs += [(2 * k, " ".join(w + line * 100)), (2 * k + 1, " ".join(near + line * 2))]
    return docs


def test_pairs_with_other_repeat_counts_are_found(spark):
    docs = repeated(4)
    want = brute(docs)
    assert len(set(want)) == len(docs) // 2
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in nd.classes(df).collect()} == dict(zip((d for d, _ in docs), want))


def test_a_pair_is_found_whose_only_shared_band_is_crowded(spark, monkeypatch):
    docs = [(d, t) for d, t in repeated(7, 8)] + [(100 + k, " ".join(f"o{k}x{i}" for i in range(150))) for k in range(5)]
    real = nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda df: real(df).withColumn("bands", F.array(F.lit(1).cast("long"), F.col("doc_id") + 1000)))
    monkeypatch.setattr(nd, "PAIRS_PER_MEMBER", 0)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = dict(zip((d for d, _ in docs), brute(docs)))
    for members in (256, 1):  # with a block of one member, prefixes alone must find them
        monkeypatch.setattr(nd, "BLOCK_MEMBERS", members, raising=False)
        assert {x.doc_id: x.class_id for x in nd.classes(df).collect()} == want


def test_a_group_of_copies_near_and_less_near(spark, monkeypatch):
    """Members of one template, many of them linked to no other; single blocks, so that
    prefixes alone find what the hub does not reach."""
    r = random.Random(21)
    base = [f"t{k}" for k in range(130)]
    docs = []
    for k in range(260):
        w = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 5, 6, 8))):
            at = r.randrange(len(w))
            w[at : at + r.choice((0, 1, 1, 2))] = r.choice(([], [f"x{r.randrange(40)}"], [f"x{k}"]))
        docs.append((k, " ".join(w)))
    want = dict(zip((d for d, _ in docs), brute(docs)))
    assert 20 < len(set(want.values())) < 240
    monkeypatch.setattr(nd, "PAIRS_PER_MEMBER", 0)
    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 1)
    real = nd.signatures  # one bucket holds all, so that banding misses nothing
    monkeypatch.setattr(nd, "signatures", lambda df: real(df).withColumn("bands", F.array(F.lit(1).cast("long"))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: x.class_id for x in nd.classes(df).collect()} == want


def test_packing():
    x = np.array([0, 1, 2**40 - 1, 123456789012], np.uint64)
    assert nd.unpacked(nd._packed(x).tobytes()).tolist() == x.tolist()


def test_forest_spans_the_links(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_COLUMNS", 7)
    docs = make(3, 70)
    sets = [np.array(sorted({hash(g) % 2**40 for g in grams(t)}), np.uint64) for _, t in docs]
    up = list(range(len(docs)))
    for i, j in nd._forest(sets, 0.8):
        up = [up[i] if x == up[j] else x for x in up]
    assert sorted(up.count(x) for x in up) == sorted(brute(docs).count(c) for c in brute(docs))


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op2_near_dedup(spark, SF).collect()}
    assert got == dict(zip((d for d, _ in docs), brute(docs)))
