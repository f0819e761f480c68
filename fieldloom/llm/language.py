"""Language of words in code-switched text: a linear-chain conditional random field.

Words are the positions, languages the labels. A word's emission scores come from
hashed affixes, character n-grams and the word itself looked up in a learned lexicon;
learned transitions say how likely the language changes. Forward-backward gives each
word's label probabilities, and a text's language is the one with the most of them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._common import Numbered, crc_mod, driver_gives_back, gives_back, keyed_text, mix64, slices, starts_of

#: Labelled rows of each language at most for the fit (a bounded sample, lowest crc32 of
#: the id first); their texts are used whole.
FIT_ROWS = 1_000
#: Hash buckets of the n-gram features; words in the lexicon at most.
BUCKETS, LEXICON = 1 << 16, 20_000
#: Gradient steps, sequences drawn for each, words in one, step size and L2.
STEPS, DRAWN, SEQUENCE, STEP, L2 = 240, 256, 24, 0.5, 1e-6
UNKNOWN = "und"

#: A word: a letter, then letters and combining marks. Where every character is one of the
#: plain ranges, which hold no marks and no numerals but digits, the faster pattern says the same.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_PLAIN = re.compile(r"[\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u02af\u2010-\u2027\u2030-\u205e]*").fullmatch
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case; the same in fitting and in prediction."""
    text = text.lower()
    return (_RUNS if _PLAIN(text) else _LETTERS)(text)


@dataclass
class Field:
    """A fitted field; all that a worker needs (under 3 MB)."""

    labels: list[str]
    weights: np.ndarray  # (BUCKETS, L): affixes and n-grams
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray  # (LEXICON + 1, L); the last row is for other words
    transitions: np.ndarray  # (L, L)

    def emissions(self, words: list[str]) -> np.ndarray:
        feats, cut = features(words)
        sums = np.add.reduceat(self.weights[feats], cut[:-1], axis=0) if len(words) else np.zeros((0, len(self.labels)), np.float32)
        rows = [self.lexicon.get(w, -1) for w in words]
        return (sums + self.lexicon_weights[rows]).astype(np.float32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the features of each word (never none), and the cuts between words.

    Affixes of one to three letters are the n-grams that touch a boundary mark."""
    text = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at, out, pos = np.arange(len(codes)), [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n == 1:
            fit = np.flatnonzero(codes > 3)
        else:
            fit = np.flatnonzero(at[: len(h)] + n <= ends[: len(h)])
        out.append((mix64(h[fit] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64))
        pos.append(fit)
    pos, out = np.concatenate(pos), np.concatenate(out)
    of = np.searchsorted(starts_of(sizes), pos, side="right") - 1
    order = np.argsort(of, kind="stable")
    return out[order], starts_of(np.bincount(of, minlength=len(words)))


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each position, and expected transitions, over sequences
    laid end to end. Sequences run side by side, one step of all of them at a time.

    A zero length gives no rows."""
    L = transitions.shape[0]
    if not L:
        return scores, np.zeros((0, 0))
    starts = starts_of(lengths)[:-1]
    order = np.argsort(-lengths, kind="stable")
    starts, lens = starts[order], lengths[order]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    t = np.exp(transitions - transitions.max())
    steps = int(lens[0]) if len(lens) else 0
    live = [int(k) for k in np.searchsorted(-lens, -np.arange(steps), side="left")]
    alpha, beta = np.empty((len(scores), L), e.dtype), np.ones((len(scores), L), e.dtype)
    for s in range(steps):
        at = starts[: live[s]] + s
        a = e[at] if s == 0 else (alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for s in range(steps - 1, 0, -1):
        at = starts[: live[s]] + s
        b = (beta[at] * e[at]) @ t.T
        beta[at - 1] = b / b.sum(axis=1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    later = np.ones(len(scores), bool)
    later[starts[lens > 0]] = False
    at = np.flatnonzero(later)
    right = beta[at] * e[at]
    norm = ((alpha[at - 1] @ t) * right).sum(axis=1)
    pairs = t * (alpha[at - 1].T @ (right / norm[:, None])) if len(at) else np.zeros((L, L))
    return gamma, pairs


def training_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """(lang, words) of the labelled rows to fit on, whole texts: non-null lang and text, not
    held out, of each language the ``rows`` lowest by crc32 of the id, so that none is missing."""
    usable = docs.where((crc_mod(F.col("doc_id"), modulus) != held_out) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("c", "__id"))
    ids = usable.select("lang", crc.alias("c"), F.col("doc_id").alias("__id")).withColumn("place", place).where(F.col("place") <= rows).select("__id").distinct()
    picked = usable.select("doc_id", "text", "lang").join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("lang", "text")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], ["lang", "words"])

    return picked.mapInArrow(run, "lang string, words array<string>").orderBy("lang", "words")


def fit(rows: Iterable[tuple[str, list[str]]], seed: int = 11, steps: int = STEPS) -> Field:
    """Fit by gradient steps on the log likelihood of sequences that switch language: each
    is a run of one text's words, or of two texts' words one after the other, drawn from
    all runs of whole texts. Words are kept as numbers."""
    number: dict[str, int] = defaultdict(count().__next__)
    texts: list[tuple[str, np.ndarray]] = []
    for lang, words in rows:
        texts.append((lang, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
    labels = sorted({lang for lang, _ in texts})
    vocabulary = list(number)
    seen_in = np.zeros(len(vocabulary), np.int64)
    for _, ids in texts:
        seen_in[np.unique(ids)] += 1
    often = sorted(np.flatnonzero(seen_in > 1).tolist(), key=lambda i: (-seen_in[i], vocabulary[i]))[:LEXICON]
    lexicon = {vocabulary[i]: k for k, i in enumerate(often)}
    in_lexicon = np.full(len(vocabulary), len(lexicon), np.int64)
    in_lexicon[often] = np.arange(len(often))
    field = Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), lexicon, np.zeros((len(lexicon) + 1, len(labels)), np.float32), np.eye(len(labels), dtype=np.float32))
    by_label = [[ids[i : i + SEQUENCE] for lang, ids in texts if lang == name for i in range(0, len(ids), SEQUENCE)] for name in labels]
    if len(labels) < 2 or not all(by_label):
        return field
    rng = np.random.default_rng(seed)
    squared = [np.full(x.shape, 1e-2, np.float32) for x in (field.weights, field.lexicon_weights, field.transitions)]
    for _ in range(steps):
        # every label weighs alike, however many rows it has
        first, second = rng.integers(0, len(labels), (2, DRAWN))
        parts, gold, lengths = [], [], []
        for a, b in zip(first.tolist(), second.tolist()):
            left = by_label[a][rng.integers(len(by_label[a]))]
            right = by_label[b][rng.integers(len(by_label[b]))] if rng.random() < 0.5 else left[:0]
            right = right[: 1 + int(rng.integers(len(right)))] if len(right) else right
            parts += [left, right]
            gold += [a] * len(left) + [b] * len(right)
            lengths.append(len(left) + len(right))
        gold, lengths = np.array(gold), np.array(lengths)
        used, where = np.unique(np.concatenate(parts), return_inverse=True)
        flat, cut = features([vocabulary[i] for i in used])
        emissions = np.add.reduceat(field.weights[flat], cut[:-1], axis=0) + field.lexicon_weights[in_lexicon[used]]
        gamma, pairs = forward_backward(emissions[where].astype(np.float64), field.transitions.astype(np.float64), lengths)
        gap = -gamma
        gap[np.arange(len(gold)), gold] += 1
        by_word = np.zeros((len(used), len(labels)))
        np.add.at(by_word, where, gap)
        starts = np.zeros(len(gold), bool)
        starts[starts_of(lengths)[:-1]] = True
        inner = np.flatnonzero(~starts)
        seen = np.zeros_like(pairs)
        np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
        g = np.zeros_like(field.weights)
        np.add.at(g, flat, np.repeat(by_word, np.diff(cut), axis=0).astype(np.float32))
        gl = np.zeros_like(field.lexicon_weights)
        np.add.at(gl, in_lexicon[used], by_word.astype(np.float32))
        for x, grad, sq in zip((field.weights, field.lexicon_weights, field.transitions), (g / DRAWN, gl / DRAWN, ((seen - pairs) / DRAWN).astype(np.float32)), squared):
            grad = grad - L2 * x
            sq += grad * grad
            x += STEP * grad / np.sqrt(sq)
    return field


def predict(docs: DataFrame, field: Field, words: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score[, labels]) of every whole text, however long.

    ``score`` is the share of the predicted language in the letters' label
    probabilities; ``labels`` lists each word's language. Null text, or one without a
    letter: ``und``, 0. Ties go to the language first in the alphabet. Repeated rows give
    repeated rows; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in slices(batches):
            names, score, each, cut = labeller(batch.column(1).to_pylist())
            out = [batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())]
            if words:
                out.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(each(), pa.string())))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "lang_pred", "score", "labels"][: len(out)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed_text(docs).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + ", labels array<string>" * words)


class Labeller:
    """A field and the emissions of the words a worker has met."""

    def __init__(self, model: Field):
        self.model = model
        self.numbered = Numbered(lambda new: np.hstack([model.emissions(new), np.array([[len(w)] for w in new], np.float32)]))

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, Callable[[], list[str]], np.ndarray]:
        """(language and score of each text; a function that lists its words' languages,
        and where each text's begin in it)."""
        model, L = self.model, len(self.model.labels)
        found = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in found], dtype=np.int64)
        ids = self.numbered([w for ws in found for w in ws])
        rows = self.numbered.rows[ids] if len(ids) else np.zeros((0, L + 1), np.float32)
        gamma, _ = forward_backward(rows[:, :L], model.transitions, lengths)
        mass = np.zeros((len(lengths), L))
        if len(ids) and L:
            some = np.flatnonzero(lengths)
            mass[some] = np.add.reduceat(gamma * rows[:, L:], starts_of(lengths)[some], axis=0)
        total = mass.sum(axis=1)
        known = total > 0
        best = mass.argmax(axis=1) if L else np.zeros(len(mass), int)
        score = np.where(known, mass.max(axis=1, initial=0) / np.where(known, total, 1), 0.0)
        names = [model.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        each = lambda: [model.labels[k] for k in gamma.argmax(axis=1)] if L else []
        return names, np.minimum(score, 1.0), each, starts_of(lengths) if L else np.zeros(len(lengths) + 1, int)


def learn(docs: DataFrame) -> Field:
    """Fit on the bounded sample of ``docs`` (doc_id, text, lang)."""
    field = fit((r.lang, r.words) for r in training_rows(docs).toLocalIterator())
    driver_gives_back(docs.sparkSession)
    return field


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is known with at least ``least``. Rows are
    judged one by one, also where they share an id."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            names, score, _, _ = labeller([t or "" for t in texts])
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
