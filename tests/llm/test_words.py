"""Words as stretches of bytes against the same by plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import _words as w
from fieldloom.llm import lm

random.seed(1)
SIGNS = "aB Z\x00\t\n_é ÉİΣσςẞ漢字😀  -9퟿٣²\x1c\x0b"
ODD = ["", "a", "", " ", "\x00", "a\x00 a", " ".join(n * "x" for n in (8, 16, 17, 16, 9, 17)) + "\x00", "é", "aΣ", "Σ", ""]
TEXTS = ODD + ["".join(random.choices(SIGNS, k=random.randint(0, 60))) for _ in range(500)]


@pytest.mark.parametrize("texts", [TEXTS, ODD, [""], [" ", ""], []])
def test_words_are_those_of_plain_python(texts):
    by_space = w.by_ascii_space(pa.array(["not this"] + texts, pa.string()).slice(1))
    by_letters = w.by_letters(texts)
    for got, want in ((by_space, [t.encode().lower().split() for t in texts]), (by_letters, [[x.encode() for x in re.findall(r"[^\W_]+", t.lower())] for t in texts])):
        flat = [x for ws in want for x in ws]
        assert np.diff(got.cut).tolist() == [len(ws) for ws in want]
        assert got.bytes_of(np.arange(len(flat))) == got.column(np.arange(len(flat))).to_pylist() == flat


def test_places_and_counts_also_of_words_of_one_hash(monkeypatch):
    got = w.by_ascii_space(pa.array(TEXTS))
    flat = got.bytes_of(np.arange(len(got.start)))
    known = list(dict.fromkeys(flat))[::2]
    for hashed in (w.hashed, lambda a, b: (a & np.uint64(3)) << np.uint64(50)):
        monkeypatch.setattr(w, "hashed", hashed)
        for some in (known, []):
            assert w.Lookup(some)(got, got.odd()).tolist() == [{x: i for i, x in enumerate(some)}.get(x, -1) for x in flat]
        seen = w.Tally()
        for texts in (TEXTS[:100], [""], TEXTS[100:]):
            seen.add(w.by_ascii_space(pa.array(texts)))
        names, n = seen.columns()
        assert len(names) == len(set(flat)) and dict(zip(names.to_pylist(), n.to_pylist())) == Counter(flat)


def test_forms_are_found_for_all_words_at_once():
    found = w.by_ascii_space(pa.array(TEXTS))
    which = np.arange(len(found.start))[::-1]
    assert lm.forms_of(found, which).tolist() == [lm.form_of(x) for x in found.bytes_of(which)]
    words = {x: lm.FIRST_WORD + i for i, x in enumerate([b"a", b"\x00", 17 * b"x"])}
    _, ids, starts = lm.numbered(TEXTS, lm.Classes(words, [b"9"]))
    want = [[*(words.get(x) or lm.form_of(x) for x in t.encode().lower().split()), lm.END] for t in TEXTS]
    assert ids.tolist() == [i for t in want for i in t] and np.diff(starts).tolist() == [len(t) for t in want]


def test_a_word_costs_no_object():
    """Numbering and counting a text of 200,000 words makes no call or object for each."""
    import sys

    column, calls = pa.array(["a bb ccc 9d " * 50_000]), Counter()
    classes = lm.Classes({b"a": lm.FIRST_WORD})
    lm.numbered(column, classes)
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        lm.numbered(column, classes)
        seen = w.Tally()
        seen.add(w.by_ascii_space(column))
    finally:
        sys.setprofile(None)
    assert len(seen) == 4 and sum(calls.values()) < 1_000
