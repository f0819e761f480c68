"""Language-model scores: a log-bilinear neural model trained with noise contrast.

The next word's score is bilinear in its vector and in a prediction made from the vectors
of the two words before it. Training texts are dealt to shards of about SHARD_TOKENS by a
hash of the row, whatever partitions they come in; each shard is trained on in the order of
its rows' hashes with noise-contrastive estimation, starting from the same vectors, and the
results are averaged by the words they saw, in whole numbers, so that the model does not
depend on how the table is split. Scoring is by matrix products over the model's classes,
normalised exactly: with two context words there are K * K contexts, so their normalisers
are computed once.

A class is one of the most frequent words, the end of a text, or one of FORMS classes of
rarer words of like form (their last two bytes, and whether they hold a digit). Every word
of the corpus is in the vocabulary: a rarer word's probability is its class's times its
share of the class, by add-one counts with one share left for words never seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import crc_mod, keyed_text, materialize, slices, starts_of
from fieldloom.llm._words import Lookup, Tally, Words, by_ascii_space, of_column

#: Words of the neural vocabulary, length of the vectors, noise words shared by a batch,
#: positions in a batch, step of the descent.
VOCABULARY, DIMENSIONS, NOISE, BATCH, STEP = 767, 24, 64, 2048, 0.08
#: Classes of rarer words; tokens of a training shard, and those whose contexts are laid out
#: at once; the unit of the averages.
FORMS, SHARD_TOKENS, CHUNK_TOKENS, UNIT = 256, 4_000_000, 250_000, 1 << 20
#: Frequent words broadcast with their counts (a table of at most this many rows); the
#: counts of rarer ones are joined.
TABLE_ROWS = 100_000
#: Distinct words that a task holds before it passes its counts on.
COUNTER_ROWS = 600_000

END, FIRST_WORD = 0, 1 + FORMS  # class numbers: the end, then the forms, then the words
_LOG10 = float(np.log(10.0))


@dataclass
class Vectors:
    """R: context words, C1 and C2: the last and the one before it, Q: next words, b: bias."""

    R: np.ndarray
    C1: np.ndarray
    C2: np.ndarray
    Q: np.ndarray
    b: np.ndarray


_A_DIGIT = re.compile(rb"[0-9]").search


def form_of(word: bytes) -> int:
    """The class of a word that is not among the frequent ones."""
    return 1 + zlib.crc32(word[-2:] + (b"9" if _A_DIGIT(word) else b"a")) % FORMS


@cache
def _forms() -> np.ndarray:
    """form_of by (a digit or not, the last byte but one, the last), words of one byte last."""
    ends = [*(bytes((x, y)) for x in range(256) for y in range(256)), *(bytes((y,)) for y in range(256))]
    return np.array([[1 + zlib.crc32(e + mark) % FORMS for e in ends] for mark in (b"a", b"9")], dtype=np.int64)


def forms_of(words: Words, which: np.ndarray) -> np.ndarray:
    """:func:`form_of` some of the words."""
    data, last, size = words.data, words.start[which] + words.size[which] - 1, words.size[which]
    digits = np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)
    first = words.start[which]
    digit = digits[last] - digits[first] + ((data[first] >= 48) & (data[first] <= 57)) > 0
    before = np.where(size > 1, data[last - (size > 1)].astype(np.int64), 256)
    return _forms()[digit.view(np.int8), before << 8 | data[last]]


class Classes:
    """Class numbers of words: those given, and the forms of all others. Of ``more`` words only
    the places are told."""

    def __init__(self, words: dict[bytes, int], more: list[bytes] | tuple = ()):
        self.lookup = Lookup([*words, *more])
        self.number = np.array([*words.values(), *[-1] * (len(more) + 1)], dtype=np.int64)

    def __call__(self, words: Words) -> np.ndarray:
        words.place = self.lookup(words, words.odd())
        ids = self.number[words.place]
        rare = np.flatnonzero(ids < 0)
        ids[rare] = forms_of(words, rare)
        return ids


def _counts(training: DataFrame) -> DataFrame:
    """(word, c) over the training texts; each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tally()
        for batch in slices(batches):
            seen.add(by_ascii_space(batch.column(0)))
            if len(seen) > 2 * COUNTER_ROWS:
                seen.merge()
                if len(seen) > COUNTER_ROWS:
                    yield pa.RecordBatch.from_arrays(list(seen.columns()), ["word", "c"])
                    seen.clear()
        if len(seen):
            yield pa.RecordBatch.from_arrays(list(seen.columns()), ["word", "c"])

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def initial(counts: np.ndarray, dims: int = DIMENSIONS, seed: int = 3) -> Vectors:
    """Small random vectors; the bias says the words' frequencies."""
    rng, k = np.random.default_rng(seed), len(counts)
    share = (counts + 1) / (counts + 1).sum()
    draw = lambda n: rng.normal(0, 0.1, (n, dims)).astype(np.float32)
    return Vectors(draw(k), np.eye(dims, dtype=np.float32), 0.5 * np.eye(dims, dtype=np.float32), draw(k), np.log(share).astype(np.float32))


def _sums(at: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of each of ``k`` classes the sum of its rows, added in double precision."""
    dims = rows.shape[-1]
    flat = _flat(k, dims).take(at.ravel(), axis=0)
    return np.bincount(flat.ravel(), rows.ravel(), k * dims).astype(np.float32).reshape(k, dims)


@lru_cache(4)
def _flat(k: int, dims: int) -> np.ndarray:
    return np.arange(k * dims).reshape(k, dims)


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    target += _sums(at, rows, len(target))


def _falling(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """1 / (1 + exp(x)), in x's single precision."""
    x = np.clip(x, np.float32(-30), np.float32(30), out=out)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.divide(np.float32(1), x, out=x)


class Trainer:
    """Noise-contrastive estimation on batches; the model's scores are taken as normalised,
    as is usual, and one set of noise words serves a batch. Steps are scaled as in Adagrad."""

    def __init__(self, start: Vectors, counts: np.ndarray, seed: int):
        self.v = Vectors(*(x.copy() for x in (start.R, start.C1, start.C2, start.Q, start.b)))
        self.rng, share = np.random.default_rng(seed), (counts + 1) / (counts + 1).sum()
        self.edges, self.noise_log = np.cumsum(share), np.log(share * NOISE).astype(np.float32)
        self.sq = {n: np.full(len(counts), 0.1, np.float32) for n in ("R", "Q", "b")} | {n: np.float32(1.0) for n in ("C1", "C2")}
        self.room: np.ndarray | None = None  # of a batch's noise scores, used again

    def step(self, c1: np.ndarray, c2: np.ndarray, w: np.ndarray) -> None:
        v, n, dims = self.v, len(w), self.v.R.shape[1]
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(NOISE)), len(self.edges) - 1)
        both, C = np.stack((c1, c2), axis=1), np.concatenate((v.C1, v.C2))
        r = v.R.take(both.ravel(), axis=0).reshape(n, 2 * dims)
        guess = r @ C
        own, minus, offset = v.Q.take(w, axis=0), -v.Q.take(noise, axis=0), v.b - self.noise_log
        gt = _falling(np.einsum("ij,ij->i", guess, own) + offset.take(w))  # 1 - p(data)
        if self.room is None or len(self.room) < n:
            self.room = np.empty((n, NOISE), np.float32)
        gf = np.matmul(guess, minus.T, out=self.room[:n])
        gf -= offset.take(noise)
        gf = _falling(gf, out=gf)  # p(data), which noise is to lower
        own *= gt[:, None]
        own += gf @ minus
        into = own
        gq, gn = gt[:, None] * guess, -(guess.T @ gf).T
        at = np.concatenate((w, noise))
        self._rows("Q", _sums(at, np.concatenate((gq, gn)), len(v.b)))
        g = np.bincount(at, np.concatenate((gt, -(np.ones(n, np.float32) @ gf))), len(v.b)).astype(np.float32)
        self.sq["b"] += g * g
        v.b += STEP * g / np.sqrt(self.sq["b"])
        back, turned = into @ C.T, r.T @ into
        for name, g in (("C1", turned[:dims]), ("C2", turned[dims:])):
            self.sq[name] += np.float32((g * g).mean())
            setattr(v, name, getattr(v, name) + STEP * g / np.sqrt(self.sq[name]))
        self._rows("R", _sums(both, back.reshape(2 * n, dims), len(v.b)))

    def learn(self, ids: np.ndarray, starts: np.ndarray) -> None:
        """One pass over whole texts, in an order of the trainer's own."""
        c1, c2 = contexts(ids, starts)
        order = self.rng.permutation(len(ids))
        for a in range(0, len(ids), BATCH):
            at = order[a : a + BATCH]
            self.step(c1[at], c2[at], ids[at])

    def _rows(self, name: str, g: np.ndarray) -> None:
        x, sq = getattr(self.v, name), self.sq[name]
        sq += np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        x += (np.float32(STEP) / np.sqrt(sq))[:, None] * g


def numbered(texts: pa.Array | list[str], classes: Classes) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the texts; classes of all tokens (each text's words, then its end) in one
    array; and where each text starts in it."""
    words = by_ascii_space(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    starts = words.cut + np.arange(len(words.cut))
    ids = np.full(int(starts[-1]), END, dtype=np.int64)
    ids[_inner(starts)] = classes(words)
    return words, ids, starts


def _inner(starts: np.ndarray) -> np.ndarray:
    """True at the tokens that are words, False at each text's end."""
    inner = np.ones(int(starts[-1]), bool)
    inner[starts[1:] - 1] = False
    return inner


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class before each token and the one before that; the end stands before a text."""
    c1, c2 = np.empty_like(ids), np.empty_like(ids)
    c1[1:], c2[2:] = ids[:-1], ids[:-2]
    c1[starts[:-1]] = END
    c2[starts[:-1]] = END
    second = starts[:-1] + 1
    c2[second[second < starts[1:]]] = END
    return c1, c2


def _train(training: DataFrame, start: Vectors, counts: np.ndarray, words: dict[bytes, int], shards: int) -> Vectors:
    """One pass over all training texts, shard by shard; results are averaged."""
    spark = training.sparkSession
    known = spark.sparkContext.broadcast(Classes(words))
    shared = spark.sparkContext.broadcast((start, counts))
    k, dims = start.R.shape

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = known.value
        for batch in slices(batches):
            _, ids, starts = numbered(batch.column(1), classes)
            at = (starts * 2).astype(np.int64)
            body = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at), pa.py_buffer(ids.astype(np.uint16))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), body], ["h", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for shard, h, ids in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows.setdefault(shard, []).append((h, ids))
        for shard, found in sorted(rows.items()):
            start, counts = shared.value
            trainer, seen, part, size = Trainer(start, counts, shard), 0, [], 0
            for _, ids in (*sorted(found), (0, None)):
                if ids is not None:
                    part.append(np.frombuffer(ids, np.uint16))
                    size += len(part[-1])
                if part and (ids is None or size >= CHUNK_TOKENS):
                    trainer.learn(np.concatenate(part).astype(np.int64), starts_of(np.array([len(x) for x in part])))
                    seen, part, size = seen + size, [], 0
            v = trainer.v
            vectors = np.concatenate((v.R, v.C1, v.C2, v.Q, np.pad(v.b[:, None], ((0, 0), (0, dims - 1)))))
            whole = np.round(vectors.astype(np.float64) * UNIT).astype(np.int64) * seen
            cut = pa.array(np.arange(len(whole) + 1) * dims, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole), dtype=np.int32)), pa.array(np.full(len(whole), seen, dtype=np.int64)), pa.ListArray.from_arrays(cut, pa.array(whole.ravel()))], ["row", "seen", "vec"])

    dealt = training.select(F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(number, "h long, ids binary")
    dealt = dealt.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "ids").repartitionById(shards, "shard")
    parts = dealt.mapInArrow(run, "row int, seen long, vec array<long>")
    sums = parts.groupBy("row").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("vec")[i]).alias(f"x{i}") for i in range(dims)])
    got = sums.toPandas().sort_values("row")
    if got.empty:
        return start
    rows = (got[[f"x{i}" for i in range(dims)]].to_numpy() / UNIT / got[["seen"]].to_numpy()).astype(np.float32)
    R, C1, C2, Q, b = np.split(rows, np.cumsum([k, dims, dims, k]))
    return Vectors(R, C1, C2, Q, np.ascontiguousarray(b[:, 0]))


def tables(v: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word, next word) and (word before, next word) parts of the scores, natural
    logarithms with the bias in the first, and the normaliser of every context."""
    one = (v.R @ v.C1) @ v.Q.T + v.b
    two = (v.R @ v.C2) @ v.Q.T
    e1, e2 = np.exp(one - one.max(axis=1, keepdims=True)), np.exp(two - two.max(axis=1, keepdims=True))
    z = np.log(e1.astype(np.float64) @ e2.T.astype(np.float64)) + one.max(axis=1)[:, None] + two.max(axis=1)[None, :]
    return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)


def _form_counts(counts: DataFrame, words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each form, of the words that are not frequent."""
    shared = counts.sparkSession.sparkContext.broadcast(Lookup(list(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, types, known = np.zeros(FIRST_WORD, np.int64), np.zeros(FIRST_WORD, np.int64), shared.value
        for batch in batches:
            found = of_column(batch.column(0))
            rare = np.flatnonzero(known(found, found.odd()) < 0)
            at = forms_of(found, rare)
            tokens += np.bincount(at, batch.column(1).to_numpy()[rare], FIRST_WORD).astype(np.int64)
            types += np.bincount(at, minlength=FIRST_WORD)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FIRST_WORD, dtype=np.int32)), pa.array(tokens), pa.array(types)], ["form", "tokens", "types"])

    made = counts.select("word", "c").mapInArrow(run, "form int, tokens long, types long").groupBy("form").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toPandas()
    tokens, types = np.zeros(FIRST_WORD, np.int64), np.zeros(FIRST_WORD, np.int64)
    tokens[made["form"].to_numpy()], types[made["form"].to_numpy()] = made["tokens"].to_numpy(), made["types"].to_numpy()
    return tokens, types


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Null text counts as empty: one token, the end. Repeated rows are each scored (and
    each trained on); very long texts are read whole. Of words that are equally frequent the
    lower ones by bytes are the frequent ones. With nothing to train on, counts are zero and
    every token is unknown. Only doc_id and text are read.
    """
    texts = keyed_text(docs).withColumn("held_out", crc_mod(F.col("doc_id"), modulus) == held_out)
    spark, training = docs.sparkSession, texts.where(~F.col("held_out"))
    counts = materialize(_counts(training), "counts")
    total = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    ends = training.count()
    V, N = total.v + (ends > 0), (total.n or 0) + ends
    top = [(bytes(r.word), r.c) for r in counts.orderBy(F.desc("c"), "word").limit(TABLE_ROWS).toLocalIterator()]
    words = {w: FIRST_WORD + i for i, (w, _) in enumerate(top[:VOCABULARY])}
    tokens, types = _form_counts(counts, words)
    class_counts = np.concatenate((tokens.astype(np.float64), [float(c) for _, c in top[:VOCABULARY]]))
    class_counts[END] = ends
    one, two, z = tables(_train(training, initial(class_counts), class_counts, words, max(1, -(-N // SHARD_TOKENS))))
    # what a token adds to its class's probability: a rare word's share, less its own count
    share = np.zeros(len(class_counts))
    share[1:FIRST_WORD] = -np.log10(tokens[1:] + types[1:] + 1)
    share[FIRST_WORD:] = -np.log10(class_counts[FIRST_WORD:] + 1)
    # a word's logarithm by its place in the table; the last is for those that are not in it
    logs = np.append(np.log10(np.array([c for _, c in top], dtype=np.float64) + 1), np.nan)
    shared = spark.sparkContext.broadcast((Classes(words, [w for w, _ in top[VOCABULARY:]]), logs, one, two, z, share))
    base_log, end_log = float(np.log10(N + V + 1)), float(np.log10(ends + 1))
    complete = total.v <= TABLE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, logs, one, two, z, share = shared.value
        K = len(one)
        for batch in slices(batches):
            found, ids, starts = numbered(batch.column(1), classes)
            c1, c2 = contexts(ids, starts)
            nat = (one.take(c1 * K + ids).astype(np.float64) + two.take(c2 * K + ids) - z.take(c1 * K + c2)) / _LOG10 + share[ids]
            model = np.add.reduceat(nat, starts[:-1])
            inner, log = _inner(starts), np.zeros(len(ids))
            log[inner] = logs[found.place]
            unknown = np.isnan(log)
            log[unknown] = 0
            n, own, missing = np.diff(starts), np.add.reduceat(log, starts[:-1]), np.add.reduceat(unknown, starts[:-1], dtype=np.int64)
            n_known = n - 1 - missing + (ends > 0)
            none = complete or not unknown.any()
            missed = found.column(np.empty(0, np.int64) if none else np.flatnonzero(found.place < 0))
            lists = pa.ListArray.from_arrays(pa.array(starts_of(missing * (not none)), pa.int32()), missed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n), pa.array(n_known, pa.int64()), pa.array(own + end_log - n * base_log), pa.array(model + own), lists],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "missed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    first = texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, missed array<binary>")
    first = materialize(first.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words outside the table: their counts by a join, added up for each row
    word = first.select("row", F.explode("missed").alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    found = word.join(counts, "word")
    more = found.groupBy("row").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("x")).alias("base_score"),
        (F.col("score") + zero("x")).alias("score"),
    )
