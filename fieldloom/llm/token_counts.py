"""Token counts by a two-tier lookup of pre-token lengths.

A byte-level BPE never merges across pre-tokens, so a text's count is the sum of
its pre-tokens' counts. Tier one is a table of frequent pre-tokens, broadcast;
tier two a cache that each worker fills by encoding what it misses. Pre-tokens
are never shuffled.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fieldloom.llm._common import keyed_text, slices

#: The published split rule of this byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bounds. TABLE_ROWS entries of at most KEY_CHARS characters are broadcast (under
#: 8 MB); SAMPLE_ROWS documents choose them, which changes speed, never counts.
TABLE_ROWS, KEY_CHARS, SAMPLE_ROWS, CACHE_ROWS = 32_768, 48, 8_192, 400_000


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


class Lengths(dict):
    """Pre-token to token count: the broadcast table, then what was encoded here."""

    def __init__(self, path: str, table: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__(table)
        self.path, self.table = path, table
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        self.split_specials = regex.compile("|".join(map(regex.escape, self.specials))).split if self.specials else None
        self.find = regex.compile(PATTERN).findall
        self.odd = regex.compile(ODD).search

    def learn(self, tokens) -> None:
        if len(self) > CACHE_ROWS:
            self.clear()
            self.update(self.table)
        if missing := [t for t in tokens if t not in self]:
            self.update(zip(missing, (len(e.ids) for e in self.tokenizer.encode_batch(missing, add_special_tokens=False))))

    def counts(self, texts: list[str]) -> list[int]:
        found, extra = [], []
        for text in texts:
            more = 0
            if self.odd(text):  # characters that the library's own splitter may class otherwise
                found.append([])
                extra.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            if self.specials and any(s in text for s in self.specials):
                pieces = self.split_specials(text)
                more = len(pieces) - 1
                tokens = [t for piece in pieces for t in self.find(piece)]
            else:
                tokens = self.find(text)
            found.append(tokens)
            extra.append(more)
        self.learn(set().union(*found))
        get = self.__getitem__
        out = [sum(map(get, tokens)) + more for tokens, more in zip(found, extra)]
        return out


#: Outside these blocks, Unicode versions differ over what is a letter or a number; a
#: text with such a character is encoded whole by the library.
ODD = r"[^\x00-\u0557\u0590-\u088e\u0890-\u0c5b\u0d00-\u208e\u20a0-\ua7cd\uac00-\uffff\U0001F000-\U0001FAFF]"

_OF_WORKER: dict[str, Lengths] = {}


def _lengths(path: str, key: str, table: dict[str, int]) -> Lengths:
    """One cache for a worker process and query, kept from task to task."""
    if key not in _OF_WORKER:
        _OF_WORKER.clear()
        _OF_WORKER[key] = Lengths(path, table)
    return _OF_WORKER[key]


def frequent(docs: DataFrame, path: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The pre-tokens most frequent in a bounded sample of ``docs``, with their counts."""
    total = docs.count()
    if not total:
        return {}
    sample = keyed_text(docs).sample(False, min(1.0, SAMPLE_ROWS / total), 7).select("text").repartition(8)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(PATTERN).findall, Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(find(text))
        best = [(t, n) for t, n in seen.most_common(rows) if len(t) <= KEY_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["token", "n"])

    seen: Counter = Counter()
    for r in sample.mapInArrow(top, "token string, n long").toLocalIterator():
        seen[r.token] += r.n
    lengths = Lengths(path, {})
    chosen = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:rows]]
    lengths.learn(chosen)
    return {t: lengths[t] for t in chosen}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text.

    The library's special strings inside a text count as it counts them by
    default (one token each). Null text: 0 bytes and 0 tokens. Repeated rows give
    repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    path = path or default_path()
    shared, key = spark.sparkContext.broadcast(frequent(docs, path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path, key, shared.value)
        for batch in slices(batches):
            texts = batch.column(1)
            n = pa.array(lengths.counts(texts.to_pylist()), pa.int64())
            n_bytes = pa.compute.cast(pa.compute.binary_length(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pa.array(np.asarray(n) > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed_text(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

