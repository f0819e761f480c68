"""The field against enumeration of all label paths, and its accuracy on held-out rows."""

from itertools import product

import numpy as np

from fieldloom.llm import language as lg
from fieldloom.llm import queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    scores, trans = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3))
    gamma, pairs = lg.forward_backward(scores, trans, lengths)
    want, want_pairs, at = np.zeros_like(gamma), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(product(range(3), repeat=n))
        w = np.exp([sum(scores[at + i, p[i]] for i in range(n)) + sum(trans[p[i], p[i + 1]] for i in range(n - 1)) for p in paths])
        for p, x in zip(paths, w / w.sum()):
            for i in range(n):
                want[at + i, p[i]] += x
            for i in range(n - 1):
                want_pairs[p[i], p[i + 1]] += x
        at += n
    assert np.allclose(gamma, want) and np.allclose(pairs, want_pairs)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["abc", "é", "longerword", "abc"]
    feats, cuts = lg.features(words)
    for k, w in enumerate(words):
        alone, _ = lg.features([w])
        assert sorted(feats[cuts[k] : cuts[k + 1]]) == sorted(alone)


def test_held_out_accuracy_and_contract(spark):
    got = queries.op4_language(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98


def test_words():
    assert lg.words_of("½ Ⅷ ² ① 12 _") == [] and lg.words_of("नमस्ते x²y") == ["नमस्ते", "x", "y"]
    assert lg.words_of("Été d'ÄB_c3d") == ["été", "d", "äb", "c", "d"]
    r = np.random.default_rng(5)
    for _ in range(300):
        text = "".join(chr(c) for c in r.choice([*range(32, 0x2B0), *range(0x2010, 0x205F), 0x300, 0x370, 0x3B1, 0x2168, 0x915], 40) if chr(c) != "\u2028")
        assert lg.words_of(text) == lg._LETTERS(text.lower())


def by_paths(field, words):
    """Language and score of a text, from the sum over all label paths."""
    L, n = len(field.labels), len(words)
    e = np.zeros((n, L))
    for i, w in enumerate(words):
        e[i] = field.lexicon_weights[field.lexicon.get(w, -1)]
        for f in lg.features([w])[0]:
            e[i] += field.weights[f]
    mass, total = np.zeros(L), 0.0
    for p in product(range(L), repeat=n):
        x = np.exp(sum(e[i, p[i]] for i in range(n)) + sum(field.transitions[p[i], p[i + 1]] for i in range(n - 1)))
        total += x
        for i in range(n):
            mass[p[i]] += x * len(words[i])
    mass = mass / total / sum(map(len, words))
    return field.labels[int(mass.argmax())], mass.max()


def test_predictions_against_all_label_paths(spark):
    r = np.random.default_rng(2)
    en, de, fr = "the and of that with".split(), "der und ist nicht ein".split(), "les des une dans pour".split()
    field = lg.fit([(lang, [str(w) for w in r.permutation(v)] * 6) for lang, v in (("en", en), ("de", de), ("fr", fr)) for _ in range(9)], steps=30)
    texts = [[str(w) for w in r.choice(en + de + fr + ["mix", "xu"], r.integers(1, 6))] for _ in range(25)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for x in lg.predict(df, field).collect():
        name, score = by_paths(field, texts[x.doc_id])
        assert x.lang_pred == name and abs(x.score - score) < 1e-4


def test_rows_are_judged_one_by_one(spark):
    en, de = "the and of that with this was for".split(), "der und ist nicht ein auch werden eine".split()
    rows = [(i, " ".join(w), lang, [i]) for i in range(30) for w, lang in ((en, "en"), (de, "de"))] + [(3, "12 34", "en", [0]), (None, None, None, None), (None, "the and", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more array<int>")
    kept = lg.keep_known(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, [r for r in docs.collect() if r.text and r.text != "12 34"]))
    rare = lg.training_rows(docs.where("doc_id % 4 <> 2 AND text <> '12 34'"), rows=2)
    assert {r.lang for r in rare.collect()} == {"en", "de"}


def test_switches_and_odd_rows(spark):
    en, de = "the and of that with this was for".split(), "der und ist nicht ein auch werden eine".split()
    rows = [(i, " ".join(np.random.default_rng(i).permutation(w)), lang) for i in range(80) for w, lang in ((en, "en"), (de, "de"))]
    docs = spark.createDataFrame([(2 * i + (lang == "de"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    field = lg.learn(docs)
    odd = [(1, " ".join(en + de)), (2, None), (3, ""), (4, "12 34 _ ! ½"), (5, "the " * 30_000), (5, "the"), (None, "und nicht")]
    df = spark.createDataFrame([(i, t, 1.0, "zz") for i, t in odd], "doc_id long, text string, score double, lang_pred string")
    out = lg.predict(df, field, words=True).collect()
    assert len(out) == len(odd)
    by = {(r.doc_id, len(r.labels)): r for r in out}
    assert list(by[1, 16].labels) == ["en"] * 8 + ["de"] * 8
    assert [(by[k, 0].lang_pred, by[k, 0].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert by[5, 30_000].lang_pred == by[5, 1].lang_pred == "en" and by[None, 2].lang_pred == "de"
    assert lg.predict(df.limit(0), field).count() == 0
    assert lg.learn(docs.limit(0)).labels == [] and lg.predict(df, lg.learn(docs.limit(0))).where("lang_pred = 'und'").count() == len(odd)
