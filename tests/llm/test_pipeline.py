"""The pipeline's rows against its stages done by brute force on a small table."""

import hashlib
import re
from types import SimpleNamespace

import numpy as np

import __spark_entry__
import corpus_pipeline
from fieldloom.llm import _common, decontaminate, language, mixing, near_dedup, pii
from fieldloom.llm._common import table

from .test_near_dedup import brute as brute_classes
from .test_pii_tokens import brute as brute_pii
from .test_pii_tokens import brute_more

SF = "/root/testdata/sf0.001"


def test_rows_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # the language model is fitted once; all else is done anew
    lang = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    left = [i for i in sorted(rows) if lang[i].lang_pred != "und" and lang[i].score >= 0.5]
    assert len(left) > 0.95 * len(rows)
    ids = brute_classes([(i, rows[i].text) for i in left])
    left = [i for i, c in zip(left, ids) if i == c]
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        w = np.array(re.findall(r"\w+", text.lower()))
        for q in map(np.array, items):
            for s in range(-len(q) + 1, len(w)):
                lo, hi = max(0, -s), min(len(q), len(w) - s)
                same = w[s + lo : s + hi] == q[lo:hi]
                if same.sum() >= 10:
                    a, b, _ = decontaminate.longest_span(same)
                    if b - a >= min(decontaminate.MIN_SPAN, len(q)):
                        return True
        return False

    left = [i for i in left if not leaks(rows[i].text)]

    def redacted(text):
        out, at = "", 0
        for a, b, kind in sorted((a, b, k) for k, a, b in brute_pii(text) + brute_more(text)):
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        return out + text[at:]

    texts = {i: redacted(rows[i].text) for i in left}
    t = {}
    key = {i: (rows[i].source, rows[i].lang, next((n for n, p in mixing.TOPICS if re.search(p, texts[i])), mixing.OTHER)) for i in left}
    for i in left:
        t[key[i]] = t.get(key[i], 0) + len(texts[i].split())
    cells = sorted(t)
    total = float(sum(t.values()))
    w = np.array([float(t[c]) for c in cells])
    for _ in range(mixing.SWEEPS):
        for d in range(3):
            names = sorted({c[d] for c in cells})
            goal = np.array([sum(t[c] for c in cells if c[d] == n) ** mixing.FLATTEN for n in names])
            goal /= goal.sum()
            at = np.array([names.index(c[d]) for c in cells])
            w = w * (goal / np.bincount(at, w))[at]
    w /= w.sum()
    ratio, size, k = w * total / [t[c] for c in cells], np.array([t[c] for c in cells]), mixing.BUDGET
    for _ in range(mixing.ROUNDS):
        full = k * ratio >= 1
        k = max(k, (total * mixing.BUDGET - size[full].sum()) / (total * w[~full].sum()))
    p = dict(zip(cells, np.minimum(k * ratio, 1)))
    draw = {i: int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:8], 16) / 2**32 for i in left}
    want = {i: texts[i] for i in left if draw[i] < p[key[i]]}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_registered_and_shaped():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "pii", "mixing"]
    found = __spark_entry__.queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {k if k == "pipeline" else k.split("_")[0] for k in found}


def test_empty_and_extra_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15)], docs.schema)
    one = near_dedup.keep_one(odd)
    assert sorted(r.doc_id for r in one.collect()) == [1, 2, 3]
    assert pii.find(odd).count() == 4


def test_null_ids_and_very_long_texts_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("lang = 'en' AND n_chars > 300").limit(40)
    long = spark.createDataFrame([(None, "and the of with it " * 20_000, "en", "s", 380_000), (10**6, None, None, None, None)], docs.schema)
    left = some.unionByName(long)
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, SF)
    rows = left.collect()
    assert [len(r.text) for r in rows if r.doc_id is None] == [380_000] and all(r.text is not None for r in rows)
    assert corpus_pipeline.STAGES[4][1](spark, left, SF).columns == docs.columns


def test_workers_hold_small_batches_and_give_memory_back(spark, monkeypatch):
    """Batches of whole texts are small where they are read, and a task's end frees them."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    for module in (near_dedup, decontaminate):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, real=real: seen.setdefault(tag, int(spark.conf.get(name))) and real(df, tag))
    before = spark.conf.get(name)
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    assert decontaminate.clean(near_dedup.keep_one(docs), items).count() > 0
    assert all(seen[tag] <= 1_000 for tag in ("signatures", "sets", "links", "regions"))
    assert spark.conf.get(name) == before
    released = []
    monkeypatch.setattr(_common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: released.append(1)))
    whole = _common.gives_back(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(whole) == 2 and not released
    assert list(whole) == [3] and released == [1]


def test_the_driver_gives_memory_back_as_stages_run(spark, monkeypatch):
    report = _common.driver_gives_back(spark)
    assert report is None or "rim" in report
    calls, real = [], _common.driver_gives_back
    monkeypatch.setattr(_common, "driver_gives_back", lambda session: calls.append(1) or real(session))
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name in ("near_dedup", "decontaminate", "mixing"):
        before = len(calls)
        dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
        assert len(calls) > before
    before = len(calls)
    _common.kept(docs, "stage")  # what ends each stage of run()
    assert len(calls) == before + 1
