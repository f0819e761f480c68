"""Benchmark decontamination by spaced seeds.

A mask picks some of the token positions under it and ignores the others, so that a
substituted token under an ignored position leaves the seed as it was. Seeds of the
test passages and of the documents are joined by hash; around the hits the overlap is
verified token by token on the hit's diagonal, substitutions allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm._common import TEXT_ROWS, Numbered, batches_of, by_ids, gives_back, materialize, mix64, slices, starts_of

#: Offsets of the token positions that each mask keeps (five each).
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 2, 5, 6), (0, 2, 3, 5, 8), (0, 1, 4, 6, 7))
#: An overlap counts from MIN_SPAN tokens (or the whole passage, if that is shorter) of
#: which at least MIN_SHARE are equal.
MIN_SPAN, MIN_SHARE_FIFTHS = 12, 4
#: Hits nearer than GAP tokens form one region. As many tokens as the longest passage has
#: go with it on either side, so that a passage is verified on the whole of its diagonal.
GAP = 48
#: Bits of the seed filter: 512 for each seed, within these bounds (at most 16 MB).
MIN_BITS, MAX_BITS = 1 << 20, 1 << 27
#: Test seeds up to this number are broadcast (24 bytes each), beyond it joined by a shuffle.
BROADCAST_SEEDS = 1_000_000

_WORDS = re.compile(r"\w+").findall


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _tokens(texts: list[str], numbered: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in one array, and where each text starts."""
    found = [_WORDS(t.lower()) for t in texts]
    starts = starts_of(np.array([len(w) for w in found], dtype=np.int64))
    ids = numbered([w for ws in found for w in ws])
    return (numbered.rows[ids] if len(ids) else np.empty(0, np.uint64)), starts


def _seeds(tokens: np.ndarray, starts: np.ndarray, masks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: positions where it fits inside one text, and the seed hashes there."""
    ends = np.repeat(starts[1:], np.diff(starts))
    for k, mask in enumerate(masks):
        at = np.flatnonzero(np.arange(len(tokens)) + mask[-1] < ends)
        h = np.full(len(at), k + 1, dtype=np.uint64)
        for o in mask:
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + o]
        yield at, mix64(h)


def _seed_rows(items: DataFrame, masks) -> DataFrame:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(_hashes)
        for batch in slices(batches):
            tokens, starts = _tokens(batch.column(1).to_pylist(), numbered)
            for at, h in _seeds(tokens, starts, masks):
                of = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(of)), pa.array((at - starts[of]).astype(np.int32))], ["hash", "item_id", "at"])

    return items.mapInArrow(run, f"hash long, item_id {items.schema['item_id'].dataType.simpleString()}, at int").distinct()


def _token_rows(items: DataFrame) -> DataFrame:
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(_hashes)
        for batch in slices(batches):
            tokens, starts = _tokens(batch.column(1).to_pylist(), numbered)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "passage"])

    return items.mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, passage array<long>")


def _filter(seeds: DataFrame, n: int) -> np.ndarray:
    """A bit for each of two halves of a seed's hash. Rows to the driver: one for 64 bits."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (512 * max(n, 1) - 1).bit_length()))
    halves = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("h")
    at = F.col("h").bitwiseAND(bits - 1)
    words = seeds.select(halves).select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast((h & {bits - 1}) & 63 as int))").alias("b"))
    out = np.zeros(bits >> 6, dtype=np.uint64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r.w] = np.int64(r.b).view(np.uint64)
    return out.view(np.uint8)


def _in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    def has(x: np.ndarray) -> np.ndarray:
        x = x & np.uint64(8 * len(bits) - 1)
        return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1)

    maybe = np.flatnonzero(has(h))
    return maybe[has(h[maybe] >> np.uint64(32)) == 1]


def _regions(docs: DataFrame, shared, masks, margin: int) -> DataFrame:
    """Stretches of documents around possible hits, with the hits in them."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, bits = Numbered(_hashes), shared.value
        for batch in slices(batches):
            tokens, starts = _tokens(batch.column(1).to_pylist(), numbered)
            at, hs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for where, h in _seeds(tokens, starts, masks):
                hit = _in_filter(h, bits)
                at.append(where[hit])
                hs.append(h[hit])
            at, hs = np.concatenate(at), np.concatenate(hs)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, hs = at[order], hs[order]
            of = np.searchsorted(starts, at, side="right") - 1
            first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > GAP) | (np.diff(of) > 0))))
            last = np.concatenate((first[1:], [len(at)]))
            doc = of[first]
            lo = np.maximum(at[first] - margin, starts[doc])
            hi = np.minimum(at[last - 1] + margin, starts[doc + 1])
            cut = pa.array(starts_of(last - first), pa.int32())
            hits = pa.StructArray.from_arrays([pa.array(hs.view(np.int64)), pa.array((at - np.repeat(lo, last - first)).astype(np.int32))], ["hash", "pos"])
            row = np.array([xxhash.xxh3_64_intdigest(tokens[starts[i] : starts[i + 1]].tobytes()) for i in doc.tolist()], np.uint64)
            body = np.concatenate([tokens[a:b] for a, b in zip(lo, hi)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(row.view(np.int64)),  # tells rows of one doc_id apart
                    pa.array((at[first] - starts[doc]).astype(np.int32)),  # margins of two regions may begin alike
                    pa.array((lo - starts[doc]).astype(np.int32)),
                    pa.ListArray.from_arrays(cut, hits),
                    pa.ListArray.from_arrays(pa.array(starts_of(hi - lo), pa.int32()), pa.array(body)),
                ],
                ["doc_id", "row", "region", "begin", "hits", "stretch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, row long, region int, begin int, hits array<struct<hash:long,pos:int>>, stretch array<long>")


def longest_span(equal: np.ndarray, fifths: int = MIN_SHARE_FIFTHS) -> tuple[int, int, int]:
    """(start, end, matches) of the longest run with at least fifths/5 of it equal."""
    total = np.concatenate(([0], np.cumsum(np.where(equal, 5 - fifths, -fifths))))
    lows = np.minimum.accumulate(total)  # a start is only worth trying at a new low
    highs = np.maximum.accumulate(total[::-1])[::-1]
    best, i, j, n = (0, 0), 0, 0, len(total)
    while i < n and j < n:
        if highs[j] >= lows[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
    a, b = best
    return a, b, int(equal[a:b].sum())


def overlaps(docs: DataFrame, items: DataFrame, masks=MASKS, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, item_id, begin, span, matched): verified overlaps, the longest for each
    document and test passage. ``begin`` is the token of the document it starts at.

    Tokens are the words of the lower-cased text. Passages under five tokens and null or
    empty texts have no seeds and match nothing; a repeated row counts once. Very long texts
    are read whole, and a passage is held against all of the document that it may cover. Of
    overlaps of one length the one with more equal tokens counts, then the first. Ids may be
    of any type that can be ordered; only (doc_id, text) and (item_id, text) are read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    seeds = materialize(_seed_rows(items, masks), "seeds")
    n = seeds.count()
    small = F.broadcast if n <= BROADCAST_SEEDS else (lambda df: df)
    shared = spark.sparkContext.broadcast(_filter(seeds, n))
    passages = materialize(_token_rows(items), "passages")
    longest = passages.agg(F.max(F.size("passage"))).first()[0] or 0
    with batches_of(spark, TEXT_ROWS):
        regions = materialize(_regions(docs, shared, masks, longest), "regions")
    hits = regions.select("doc_id", "row", "region", "begin", F.explode("hits").alias("hit")).select("doc_id", "row", "region", "begin", "hit.*")
    found = hits.join(small(seeds), "hash").select("doc_id", "row", "region", "item_id", (F.col("pos") - F.col("at")).alias("shift"), (F.col("begin") + F.col("pos") - F.col("at")).alias("diagonal"))
    # a diagonal is verified once, whichever of its regions it was hit in
    found = found.groupBy("doc_id", "row", "item_id", "diagonal").agg(F.min(F.struct("region", "shift")).alias("at")).select("doc_id", "row", "item_id", "at.*")
    each = found.alias("f").join(regions.alias("r"), F.expr("f.doc_id <=> r.doc_id and f.row = r.row and f.region = r.region"))
    each = each.select("r.doc_id", "item_id", "begin", "shift", "stretch")
    each = each.alias("e").join(small(passages).alias("i"), F.expr("e.item_id <=> i.item_id"))
    each = each.select("doc_id", "e.item_id", "begin", "shift", "stretch", "passage")

    @gives_back
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            shifts, begins = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            for i, shift in enumerate(shifts):
                text = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                passage = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
                lo, hi = max(0, -shift), min(len(passage), len(text) - shift)
                if lo >= hi:  # another row of the same doc_id
                    continue
                a, b, same = longest_span(text[lo + shift : hi + shift] == passage[lo:hi])
                if b - a >= min(min_span, len(passage)):
                    kept.append(i)
                    rows.append((begins[i] + shift + lo + a, b - a, same))
            at = pa.array(kept, pa.int64())
            cols = [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cols], ["doc_id", "item_id", "begin", "span", "matched"])

    ids = [f"{c} {d.schema[c].dataType.simpleString()}" for d, c in ((docs, "doc_id"), (items, "item_id"))]
    checked = each.mapInArrow(verify, f"{', '.join(ids)}, begin int, span int, matched int")
    best = F.max_by(F.struct("begin", "span", "matched"), F.struct("span", "matched", -F.col("begin"))).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document row: doc_id, contaminated, n_items, and the longest
    overlap (item_id, span, matched; nulls where clean; ties to the lower item_id)."""
    best = F.min_by(F.struct("item_id", "span", "matched"), F.struct(-F.col("span"), -F.col("matched"), "item_id"))
    by_doc = overlaps(docs, items).groupBy("doc_id").agg(F.count("*").alias("n_items"), best.alias("best"))
    both = docs.select("doc_id").alias("d").join(by_doc.alias("o"), F.expr("d.doc_id <=> o.doc_id"), "left")
    return both.select(
        "d.doc_id", F.col("best").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "best.item_id", "best.span", "best.matched"
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, without those that hold a test passage."""
    found = overlaps(docs, items).select("doc_id")
    with batches_of(docs.sparkSession, TEXT_ROWS):
        return by_ids(docs, found, keep=False)
