"""Counts and the base score against plain Python, the model against its definition."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from fieldloom.llm import lm
from fieldloom.llm import queries

SF = "/root/testdata/sf0.001"


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def plain(rows):
    held = [zlib.crc32(str(d if d is not None else "").encode()) % 7 == 2 for d, _ in rows]
    seen = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens(t))
    N, V = sum(seen.values()), len(seen)
    return [(d, h, len(tokens(t)), sum(w in seen for w in tokens(t)), N, sum(log10((seen[w] + 1) / (N + V + 1)) for w in tokens(t))) for (d, t), h in zip(rows, held)], seen


ODD = [(900, None), (901, ""), (902, "É é A a\x0b\x1cb\xa0c"), (903, "w " * 20_000), (904, "aa"), (904, "aa"), (905, " x ")]


@pytest.mark.parametrize("rows", [100_000, 3])
def test_base_score_and_counts(spark, monkeypatch, rows):
    monkeypatch.setattr(lm, "TABLE_ROWS", rows)
    monkeypatch.setattr(lm, "VOCABULARY", min(rows, 60))
    monkeypatch.setattr(lm, "COUNTER_ROWS", 500)
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, score string")
    got = sorted((tuple(r) for r in lm.score(df).collect()), key=lambda r: r[:3])
    want, _ = plain(data)
    for g, w in zip(got, sorted(want, key=lambda r: r[:3])):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and g[6] < 0
    assert len(got) == len(want)
    assert lm.score(df.limit(0)).count() == 0


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    v = lm.initial(rng.integers(1, 99, 7).astype(float), 4)
    v.R, v.Q = 3 * rng.normal(size=(7, 4)), 3 * rng.normal(size=(7, 4))
    one, two, z = lm.tables(v)
    p = np.exp(one[:, None, :] + two[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    direct = (v.R[3] @ v.C1 + v.R[5] @ v.C2) @ v.Q.T + v.b
    assert np.allclose(p[3, 5], np.exp(direct) / np.exp(direct).sum(), atol=1e-5)


def test_contexts_stop_at_texts():
    a, b, zz = 300, 301, lm.form_of(b"zz")
    _, ids, starts = lm.numbered(["a b zz", "", "b"], lm.Classes({b"a": a, b"b": b}))
    assert ids.tolist() == [a, b, zz, 0, 0, b, 0] and 1 <= zz <= lm.FORMS
    c1, c2 = lm.contexts(ids, starts)
    assert c1.tolist() == [0, a, b, zz, 0, 0, b] and c2.tolist() == [0, 0, a, b, 0, 0, 0]


def test_scores_by_hand_whatever_the_partitions(spark, monkeypatch):
    """Each token's probability from the vectors themselves, class by class; several shards."""
    monkeypatch.setattr(lm, "VOCABULARY", 40)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3_000)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()] + ODD
    df = spark.createDataFrame(data, "doc_id long, text string")
    kept = {}
    real = lm.tables
    monkeypatch.setattr(lm, "tables", lambda v: kept.setdefault("v", v) and real(v))
    got = sorted(map(tuple, lm.score(df.repartition(1)).collect()), key=str)
    first = kept.pop("v")
    assert got == sorted(map(tuple, lm.score(df.repartition(6)).collect()), key=str)
    v = kept["v"]
    assert all(np.array_equal(getattr(v, n), getattr(first, n)) for n in ("R", "C1", "C2", "Q", "b"))
    _, seen = plain(data)
    words = sorted((w for w in seen if w is not None), key=lambda w: (-seen[w], w.encode()))
    number = {w: lm.FIRST_WORD + i for i, w in enumerate(words[:40])}
    form = {w: lm.form_of(w.encode()) for w in words[40:]}
    tokens_of, types_of = Counter(), Counter()
    for w, f in form.items():
        tokens_of[f] += seen[w]
        types_of[f] += 1
    want = {}
    for d, t in data:
        c1 = c2 = 0
        total = 0.0
        for w in tokens(t)[:400] if d != 903 else []:
            k = 0 if w is None else number.get(w) or lm.form_of(w.encode())
            x = (v.R[c1] @ v.C1 + v.R[c2] @ v.C2).astype(np.float64) @ v.Q.T + v.b
            total += (x[k] - np.log(np.exp(x - x.max()).sum()) - x.max()) / np.log(10)
            if 0 < k < lm.FIRST_WORD:
                total += log10((seen[w] + 1) / (tokens_of[k] + types_of[k] + 1))
            c1, c2 = k, c1
        want[d, t] = total
    by = {g[0]: g[6] for g in got if g[0] != 904}
    checked = [abs(by[d] - want[d, t]) <= 1e-3 + 1e-4 * abs(want[d, t]) for d, t in data if d not in (903, 904) and len(tokens(t)) <= 400]
    assert len(checked) > 25 and all(checked)


def test_training_finds_a_pattern():
    seq = np.array([2, 3, 4, 2, 3, 4] * 4000)
    counts = np.array([1.0, 1.0, 8000, 8000, 8000])
    t = lm.Trainer(lm.initial(counts), counts, 1)
    c1, c2 = np.roll(seq, 1), np.roll(seq, 2)
    for _ in range(3):
        for a in range(0, len(seq), lm.BATCH):
            t.step(c1[a : a + lm.BATCH], c2[a : a + lm.BATCH], seq[a : a + lm.BATCH])
    one, two, z = lm.tables(t.v)
    assert np.exp(one[2, 3] + two[4, 3] - z[2, 4]) > 0.8


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = queries.op10_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) > 90
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_steps_and_scores_are_in_single_precision_and_without_a_call_a_text():
    """What a step costs: no sort of eight-byte numbers, no exponentials of double ones."""
    counts = np.arange(1.0, 400.0)
    trainer = lm.Trainer(lm.initial(counts), counts, 1)
    assert trainer.noise_log.dtype == np.float32
    x = np.array([-1e6, -3, 0, 3, 1e6], np.float32)
    got = lm._falling(x)
    assert got.dtype == np.float32 and np.allclose(got, 1 / (1 + np.exp(np.clip(x.astype(float), -30, 30))), rtol=1e-6)
    target, at = np.zeros((400, 3), np.float32), np.array([399, 0, 399, 7])
    lm._add_rows(target, at, np.ones((4, 3), np.float32))
    assert target[399].tolist() == [2, 2, 2] and target[0].tolist() == target[7].tolist() == [1, 1, 1] and target.sum() == 12
    assert lm._inner(np.array([0, 3, 4, 6])).tolist() == [True, True, False, False, True, False]
