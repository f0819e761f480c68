"""Text quality by naive Bayes support vectors.

n-gram indicators are scaled by the classes' log-count ratio, and a linear model with
hinge loss is fitted on them by dual coordinate descent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import Numbered, crc_mod, keyed_text, mix64, slices, starts_of

#: Labelled rows at most for the fit (a bounded sample: lowest crc32 of the id first).
FIT_ROWS = 6_000
#: Hash buckets of the n-grams; smoothing of the log-count ratios; cost; passes.
BUCKETS, SMOOTH, COST, EPOCHS = 1 << 18, 1.0, 1.0, 12

_TOKENS = re.compile(r"\w+|[^\w\s]+").findall
_NO_DIGIT = re.compile(r"\D+").fullmatch


@dataclass
class Model:
    ratio: np.ndarray  # (BUCKETS,) log-count ratios
    weight: np.ndarray  # (BUCKETS,) of the scaled, normalised indicators
    bias: float
    slope: float  # of the margin's logistic curve
    offset: float


def _token_rows(words: list[str]) -> np.ndarray:
    """For each token its hash and its shape: case of its letters, digits, or the mark itself."""
    out = np.empty((len(words), 2), np.uint64)
    for k, w in enumerate(words):
        if w[0].isalnum() or w[0] == "_":
            shape = 1 if w.islower() else 2 if w.isupper() and len(w) > 1 else 3 if w.istitle() else 4 if _NO_DIGIT(w) else 5
        else:
            shape = 16 + xxhash.xxh32_intdigest(w)
        out[k] = xxhash.xxh64_intdigest(w.lower()), shape
    return out


def features(texts: list[str], numbered: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bucket numbers of each text, and the cuts between texts: words, pairs of
    words and triples of shapes. A text without tokens has none."""
    found = [_TOKENS(t) for t in texts]
    starts = starts_of(np.array([len(w) for w in found], dtype=np.int64))
    ids = numbered([w for ws in found for w in ws])
    if not len(ids):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h, shape = numbered.rows[ids, 0], numbered.rows[ids, 1]
    of = np.repeat(np.arange(len(texts)), np.diff(starts))
    two, three = np.flatnonzero(of[:-1] == of[1:]), np.flatnonzero(of[:-2] == of[2:])
    odd = np.uint64(0x9E3779B97F4A7C15)
    grams = np.concatenate((h, h[two] * odd + h[two + 1], (shape[three] * odd + shape[three + 1]) * odd + shape[three + 2] + np.uint64(7)))
    keys = np.concatenate((of, of[two], of[three])) * BUCKETS + (mix64(grams) % np.uint64(BUCKETS)).astype(np.int64)
    keys = np.unique(keys)
    return keys % BUCKETS, starts_of(np.bincount(keys // BUCKETS, minlength=len(texts)))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[cuts[1:]] - total[cuts[:-1]]


def margins(feats: np.ndarray, cuts: np.ndarray, model: Model) -> np.ndarray:
    r = model.ratio[feats].astype(np.float64)
    norm = np.sqrt(_sums(r * r, cuts))
    dot = _sums(r * model.weight[feats], cuts)
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0) + model.bias


def scores(margin: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -500, 500)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float, np.ndarray]:
    """Hinge loss with L2: (weights, bias, dual variables). ``rows`` are (columns, values);
    the bias is a column of ones."""
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    curve = np.array([v @ v + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + b) - 1
            new = min(max(alpha[i] - slope / curve[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                b += step
                alpha[i] = new
    return w, b, alpha


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with the targets drawn in as Platt does."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, p = np.stack([margin, np.ones_like(margin)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        hess = (x * (q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        p = p - np.linalg.solve(hess, x.T @ (q - t) + 1e-3 * (p - [1.0, 0.0]))
    return float(max(p[0], 1e-3)), float(p[1])


def fit(rows: list[tuple[int, np.ndarray]]) -> Model:
    """``rows``: (label, distinct bucket numbers). With one class or none, a model that
    says the share of label 1 (0.5 without rows)."""
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    flat = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0)
    if not len(y) or abs(y.sum()) == len(y):
        flat.offset = float(np.log(((y > 0).sum() + 1) / ((y <= 0).sum() + 1)))
        return flat
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for label, feats in rows:
        (p if label else q)[feats] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    scaled = []
    for _, feats in rows:
        v = ratio[feats]
        scaled.append((feats, v / max(np.sqrt(v @ v), 1e-12)))
    share = (y > 0).mean()
    cost = np.where(y > 0, COST / (2 * share), COST / (2 * (1 - share)))
    # the curve is fitted on margins of rows that the weights did not see
    fold, outer = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        inner = np.flatnonzero(fold != k)
        w, b, _ = dual_coordinate_descent([scaled[i] for i in inner], y[inner], cost[inner], BUCKETS, 4)
        for i in np.flatnonzero(fold == k):
            outer[i] = w[scaled[i][0]] @ scaled[i][1] + b
    w, b, _ = dual_coordinate_descent(scaled, y, cost, BUCKETS)
    slope, offset = _logistic(outer, y)
    return Model(ratio.astype(np.float32), w.astype(np.float32), b, slope, offset)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, rows: int = FIT_ROWS) -> Model:
    """Fit on labels.quality of rows that are not held out, and have a document and a label.

    A bounded sample of ids (``rows`` of them, lowest crc32 first), whole texts. An id that
    is labelled twice counts as 1 if one label says so; of two texts of one id the first in
    order is read."""
    usable = labels.select("doc_id", "quality").where((crc_mod(F.col("doc_id"), modulus) != held_out) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = usable.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("label")).orderBy(crc, "doc_id").limit(rows)
    found = keyed_text(docs).join(F.broadcast(picked), "doc_id")
    texts = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(_token_rows)
        for batch in slices(batches):
            feats, cuts = features(batch.column(1).to_pylist(), numbered)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feats, pa.int32()))], ["label", "feats"])

    found = texts.mapInArrow(run, "label int, feats array<int>").toArrow()
    lists = [x.values.to_numpy() if len(x.values) else np.empty(0, np.int32) for x in found.column(1)]
    order = sorted(range(len(lists)), key=lambda i: (len(lists[i]), lists[i].tobytes()))  # whatever order rows come in
    return fit([(found.column(0)[i].as_py(), lists[i]) for i in order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text, 0 to 1, higher where label 1 is likelier.

    Null and empty texts get the score of a text without n-grams. Only doc_id and text
    are read; repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, numbered = shared.value, Numbered(_token_rows)
        for batch in slices(batches):
            feats, cuts = features(batch.column(1).to_pylist(), numbered)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(margins(feats, cuts, model), model))], ["doc_id", "score"])

    return keyed_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
