"""Near-duplicate classes by ProbMinHash, banding and verification.

Each distinct text (its sequence of words) is a node. Its distinct five-word shingles, all
of weight one (links are decided by the sets, so how often a shingle occurs must not
count), arrive as Poisson processes; every register keeps the shingle that arrives first,
so that two texts agree on a register with the probability Jaccard similarity of their
shingles, at equal weights that of the sets. An element stops as soon as its next arrival
comes after the last register was settled. Bands of registers give buckets; texts of a bucket are
linked if the Jaccard similarity of their shingle sets, computed exactly, is 0.8 or more;
classes are the connected components of the links.

Buckets are never expanded into all their pairs. First every member meets its bucket's hub,
the member that shares most buckets with others; after those links, only members of
different components meet. Where that would be more than PAIRS_PER_MEMBER pairs a member,
blocks of the bucket are linked first, so that copies of one text become one component, and
the members of all such buckets meet by prefixes: of two sets that are similar enough, the
first common element, rarest first, stands so early in both that what follows it can still
make up the similarity. How early, says at the same time which sizes a partner may have;
members only meet on an element if each has a size that the other allows. No pair of a
bucket is left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from fieldloom.llm._common import TEXT_ROWS, Numbered, batches_of, by_ids, gives_back, materialize, mix64, slices, starts_of

WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair agrees on no band of five with probability 7e-6.
BANDS, ROWS = 30, 5
PAIRS_PER_MEMBER = 2
#: Members and elements in a block of a crowded bucket, elements compared at once.
BLOCK_MEMBERS, BLOCK_ELEMENTS, BLOCK_COLUMNS = 256, 2_000_000, 20_000
#: Classes of set sizes between a size and ``similarity`` times it.
SIZE_CLASSES = 12
#: Bits of the filter that holds the repeated buckets (16 MB whatever the table's size).
FILTER_BITS = 1 << 27

_WORDS = re.compile(r"\w+").findall
_LOW40 = np.uint64((1 << 40) - 1)


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _tokens(texts: list[str | None], numbered: Numbered) -> tuple[np.ndarray, np.ndarray]:
    found = [_WORDS(t.lower()) if t else [] for t in texts]
    starts = starts_of(np.array([len(w) for w in found], dtype=np.int64))
    ids = numbered([w for ws in found for w in ws])
    return (numbered.rows[ids] if len(ids) else np.empty(0, np.uint64)), starts


def _keys(tokens: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """128 bits of each word sequence; null where there is no word."""
    return [xxhash.xxh3_128_digest(tokens[a:b].tobytes()) if b > a else None for a, b in zip(starts.tolist(), starts[1:].tolist())]


def shingles(tokens: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (text number, 40-bit hash, weight), in order. A
    text of fewer words is one shingle."""
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    at = np.flatnonzero(np.arange(len(tokens)) + words <= np.repeat(starts[1:], sizes))
    h = np.zeros(len(at), np.uint64)
    for k in range(words):
        h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at + k]
    of = np.searchsorted(starts, at, side="right") - 1
    few = np.array([xxhash.xxh64_intdigest(tokens[starts[i] : starts[i + 1]].tobytes()) for i in short], dtype=np.uint64)
    keys = np.concatenate((of, short)).astype(np.uint64) << np.uint64(40) | mix64(np.concatenate((h, few))) & _LOW40
    keys, weight = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(40)).astype(np.int64), keys & _LOW40, weight


def prob_minhash(of: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """(texts, registers) of winning elements, 0 for texts without any."""
    arrival, winner = np.full(texts * registers, np.inf), np.zeros(texts * registers, np.uint64)
    alone = np.bincount(of, minlength=texts) == 1  # its one element wins every register
    for i in np.flatnonzero(alone[of]):
        winner[of[i] * registers : (of[i] + 1) * registers] = element[i]
    live = np.flatnonzero(~alone[of])
    of, element, rate = of[live], element[live], np.asarray(weight, np.float64)[live]
    time = np.zeros(len(of))
    step = 0
    while len(of):
        step += 1
        r = mix64(element * np.uint64(0xD1342543DE82EF95) + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = of * registers + (mix64(r ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, slot, time)
        won = arrival[slot] == time
        winner[slot[won]] = element[won]
        last = arrival.reshape(texts, registers).max(axis=1)
        live = np.flatnonzero(time < last[of])
        of, element, rate, time = of[live], element[live], rate[live], time[live]
    return winner.reshape(texts, registers)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, bands): key null for a text without words; bands one long each."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(_hashes)
        for batch in slices(batches):
            tokens, starts = _tokens(batch.column(1).to_pylist(), numbered)
            of, element, _ = shingles(tokens, starts)
            n = batch.num_rows
            won = prob_minhash(of, element, np.ones(len(of)), n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((n, 1), np.uint64)
            for k in range(ROWS):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + won[:, :, k])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(h.view(np.int64).ravel()))
            size = pa.array(np.bincount(of, minlength=n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_keys(tokens, starts), pa.binary()), size, bands], ["doc_id", "key", "size", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, key binary, size int, bands array<long>")


def _packed(elements: np.ndarray) -> np.ndarray:
    """Five bytes for each 40-bit element."""
    return np.ascontiguousarray(elements).view(np.uint8).reshape(-1, 8)[:, :5].ravel()


def unpacked(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return raw.view(np.uint64).ravel()


def _bits(hashes: DataFrame) -> np.ndarray:
    """A filter of fixed size with a bit for each row (one long). To the driver: a row for
    64 bits at most."""
    h = F.col(hashes.columns[0]).bitwiseAND(FILTER_BITS - 1).alias("h")
    words = hashes.select(h).groupBy(F.shiftright("h", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS >> 6, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return bits.view(np.uint8)


def _hits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (FILTER_BITS - 1)
    return np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _sets(docs: DataFrame, nodes: DataFrame, involved: DataFrame) -> DataFrame:
    """(key, elements): sorted shingle hashes, packed, of the nodes involved, from their
    documents, which are picked by a filter, so that no text is shuffled."""
    ids = nodes.join(involved, "key", "left_semi").select(F.xxhash64("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(_bits(ids))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered, bits = Numbered(_hashes), shared.value
        for whole in batches:
            picked = whole.take(pa.array(_hits(bits, whole.column(0).to_numpy())))
            for batch in slices([picked]):
                tokens, starts = _tokens(batch.column(1).to_pylist(), numbered)
                of, element, _ = shingles(tokens, starts)
                cuts = starts_of(np.bincount(of, minlength=batch.num_rows)) * 5
                body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(_packed(element))])
                yield pa.RecordBatch.from_arrays([pa.array(_keys(tokens, starts), pa.binary()), body], ["key", "elements"])

    found = docs.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(run, "key binary, elements binary").where("key IS NOT NULL")
    return found.dropDuplicates(["key"])


def _verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, sets: DataFrame | None = None) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets are at least that similar."""
    pairs = materialize(pairs, "pairs")
    if sets is None:
        involved = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        with batches_of(docs.sparkSession, TEXT_ROWS):
            sets = materialize(_sets(docs, nodes, involved), "sets")
    left, right = (sets.select(F.col("key").alias(k), F.col("elements").alias(f"s{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                z = np.sort(np.concatenate((unpacked(x), unpacked(y))), kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                if same >= similarity * (len(z) - same) - 1e-9:
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    with batches_of(docs.sparkSession, TEXT_ROWS):
        return materialize(both.mapInArrow(run, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the least key of each node's component, by contracting every node to
    its least neighbour until no edge is left; the number of rounds is logarithmic."""
    edges = edges.where("a <> b")
    labels = None
    while not edges.isEmpty():
        ways = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = materialize(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("m")), "least")
        new = least.select(F.col("key").alias("old"), F.col("m").alias("to"))
        if labels is None:
            labels = least.select("key", F.col("m").alias("label"))
        else:
            labels = labels.join(new, labels["label"] == new["old"], "left").select("key", F.coalesce("to", "label").alias("label"))
        labels = materialize(labels, "labels")
        a, b = new.toDF("a", "na"), new.toDF("b", "nb")
        edges = edges.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b")).where("a <> b").distinct()
        edges = materialize(edges, "contracted")
    return labels if labels is not None else edges.select(F.col("a").alias("key"), F.col("b").alias("label"))


def _similar_sizes(a: str, b: str, similarity: float):
    return F.least(a, b) >= F.greatest(a, b) * similarity - 1e-9


def _joined(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """The labels (key, label) after more edges; only the new edges, between the components
    there were, are contracted."""
    if labels is None:
        return components(edges)
    of = lambda c: (F.col(c) == F.col(f"k{c}"), labels.toDF(f"k{c}", f"l{c}"))
    ends = edges
    for c in "ab":
        on, named = of(c)
        ends = ends.join(named, on, "left").withColumn(c, F.coalesce(f"l{c}", c)).select("a", "b")
    more = components(materialize(ends.where("a <> b").distinct(), "ends"))
    old = labels.join(more.toDF("old", "to"), F.col("label") == F.col("old"), "left").select("key", F.coalesce("to", "label").alias("label"))
    return materialize(old.unionByName(more.join(labels, "key", "left_anti")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("label", "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (bucket, key, size, comp, ...) of buckets with more than one component, with
    the bucket's largest component and how many pairs between components it has."""
    per = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    n = F.sum("n")
    facts = per.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), n.alias("n"), ((n * n - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"), F.count("*").alias("comps"))
    return rows.join(facts.where("comps > 1").drop("comps"), "bucket")


def _between(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs between different components of a bucket; the largest one only meets the others."""
    a = rows.where("comp <> big").select("bucket", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("na"))
    b = rows.select("bucket", F.col("key").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("nb"), "big")
    met = a.join(b, "bucket").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("big")) | (F.col("a") < F.col("b"))) & _similar_sizes("na", "nb", similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, from all their intersections."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    of = np.repeat(np.arange(n), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[at] > 1
    of, at = of[often], np.unique(at[often], return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    same = np.zeros((n, n), np.float32)
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, BLOCK_COLUMNS):
        lo, hi = np.searchsorted(at, (a, a + BLOCK_COLUMNS))
        has = np.zeros((n, BLOCK_COLUMNS), np.float32)
        has[of[lo:hi], at[lo:hi] - a] = 1
        same += has @ has.T
    linked = same >= similarity * (sizes[:, None] + sizes[None, :] - same.astype(np.float64)) - 1e-9
    new, out = np.ones(n, bool), []
    for root in range(n):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & new).tolist()
            new[found] = False
            out += [(i, j) for j in found]
            todo += found
    return out


def _block_links(many: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links inside blocks of the buckets, a spanning forest of each block."""
    facts = many.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("size") / BLOCK_ELEMENTS)).alias("blocks"))
    dealt = many.join(facts, "bucket").select("key", "bucket", F.pmod(F.xxhash64("key", "bucket"), "blocks").alias("block"))

    def link(found: pa.Table) -> pa.Table:
        keys = found.column("key").combine_chunks()
        pairs = _forest([unpacked(x) for x in found.column("elements").to_pylist()], similarity)
        a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
        return pa.table({"a": keys.take(a), "b": keys.take(b)})

    links = dealt.join(sets, "key").groupBy("bucket", "block").applyInArrow(link, "a binary, b binary")
    return materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "blocks")


def _size_class(size, similarity: float):
    return F.floor(F.log(size.cast("double")) * (SIZE_CLASSES / -math.log(similarity)) + 1e-9).cast("int")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, size, bucket, most): the elements of each set, rarest first, at which a similar
    enough set may first agree with it, as buckets, and the greatest size such a set may
    have. With ``at`` elements before it, at most size - at are common, so that the sizes
    of both add up to (1 + similarity) / similarity times that at most. Elements of one
    set alone are left out."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [unpacked(x).view(np.int64) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(lists)), sizes))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(flat)], ["key", "size", "bucket"])

    each = sets.select("key", "elements").mapInArrow(run, "key binary, size int, bucket long")
    often = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(often, "bucket")
    # elements of one set alone come first in its order, and are only counted
    rare = shared.groupBy("key").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "bucket"))).alias("all"))
    place = F.posexplode(F.slice("all", F.lit(1), F.greatest(F.floor(F.col("size") * (1 - similarity) + 1e-6).cast("int") + 1 - (F.col("size") - F.size("all")), F.lit(0))))
    placed = rare.select("key", "size", (F.col("size") - F.size("all")).alias("alone"), place.alias("i", "e"))
    most = F.floor((1 + similarity) / similarity * (F.col("size") - F.col("alone") - F.col("i")) - F.col("size") + 1e-6).cast("int")
    return placed.select("key", "size", "e.bucket", F.least(most, F.floor(F.col("size") / similarity + 1e-6).cast("int")).alias("most"))


def _meeting(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs between different components that agree on an element of both prefixes and
    have sizes that each other's place of it allows; of each element's largest component
    only the others are sought."""
    home = rows.select("bucket", F.col("key").alias("b"), F.col("comp").alias("cb"), F.col("size").alias("nb"), F.col("most").alias("mb"), "big", _size_class(F.col("size"), similarity).alias("class"))
    least = F.greatest(F.ceil(F.col("size") * similarity - 1e-6).cast("int"), F.lit(1))
    seek = rows.where((F.col("comp") != F.col("big")) & (F.col("most") >= least))
    seek = seek.select("bucket", F.col("key").alias("a"), F.col("comp").alias("ca"), F.col("size").alias("na"), F.col("most").alias("ma"), F.explode(F.sequence(_size_class(least, similarity), _size_class(F.col("most"), similarity))).alias("class"))
    met = seek.join(home, ["bucket", "class"]).where("ca <> cb AND (cb = big OR a < b) AND nb <= ma AND na <= mb").where(_similar_sizes("na", "nb", similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _repeated(nodes: DataFrame) -> DataFrame:
    """(key, size, bucket, n): the buckets of more than one node. Their counts make a filter
    of fixed size, so that the many buckets of one node are not shuffled with their keys."""
    counts = nodes.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    counts = materialize(counts, "repeated")
    shared = nodes.sparkSession.sparkContext.broadcast(_bits(counts.select("bucket")))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            bands = batch.column(2)
            flat = bands.flatten().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), np.diff(bands.offsets.to_numpy()))
            hit = _hits(bits, flat)
            rows = pa.array(of[hit])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(flat[hit])], ["key", "size", "bucket"])

    return nodes.select("key", "size", "bands").mapInArrow(run, "key binary, size int, bucket long").join(counts, "bucket")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, class_id): class_id is the least doc_id of the class.

    Words are those of the lower-cased text; texts of the same words are copies. A text
    without words (null, empty) is a class of its own under its own id. Repeated rows fall
    into one class; only doc_id and text are read.
    """
    with batches_of(docs.sparkSession, TEXT_ROWS):
        found = materialize(signatures(docs), "signatures")
    some = found.where("key IS NOT NULL")
    nodes = materialize(some.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")), "nodes")
    rows = materialize(_repeated(nodes), "buckets")
    reach = rows.groupBy("key").agg(F.sum("n").alias("reach"))
    hubs = rows.join(reach, "key").groupBy("bucket").agg(F.max_by(F.struct("key", "size"), F.struct("reach", "key")).alias("head"))
    star = rows.join(hubs, "bucket").where((F.col("key") != F.col("head.key")) & _similar_sizes("size", "head.size", similarity))
    star = materialize(star.select(F.least("head.key", "key").alias("a"), F.greatest("head.key", "key").alias("b")).distinct(), "star")
    labels = _joined(None, _verify(star, docs, nodes, similarity))
    # between components: buckets of few such pairs as they are, the members of others by prefixes
    mixed = materialize(_mixed(_labelled(rows.select("bucket", "key", "size"), labels)), "mixed")
    crowded = F.col("pairs") > PAIRS_PER_MEMBER * F.col("n")
    many, few = mixed.where(crowded).select("bucket", "key", "size"), mixed.where(~crowded)
    if not many.isEmpty():
        with batches_of(docs.sparkSession, TEXT_ROWS):
            sets = materialize(_sets(docs, nodes, many.select("key").distinct()), "crowd")
        labels = _joined(labels, _block_links(many, sets, similarity))
        finer = materialize(_mixed(_labelled(_prefixes(sets, similarity), labels)), "finer")
        pairs = _meeting(finer, similarity).join(star, ["a", "b"], "left_anti")
        labels = _joined(labels, _verify(pairs, docs, nodes, similarity, sets))
        few = materialize(_mixed(_labelled(few.select("bucket", "key", "size"), labels)), "few")
    pairs = _between(few, similarity).join(star, ["a", "b"], "left_anti")
    labels = _joined(labels, _verify(pairs, docs, nodes, similarity))
    least = _labelled(nodes.select("key", "doc_id"), labels)
    heads = materialize(least.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "heads")
    of_key = materialize(least.join(heads, "comp").select("key", "class_id"), "classes")
    named = some.select("doc_id", "key").join(of_key, "key").select("doc_id", "key", "class_id")
    return named.unionByName(found.where("key IS NULL").select("doc_id", "key", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, of which each class keeps the one with the least doc_id
    (one row of it, should the row be repeated)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbered = Numbered(_hashes)
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            keys = pa.array(_keys(*_tokens(batch.column(at).to_pylist(), numbered)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "__key"])

    found = materialize(classes(docs, similarity), "classes")
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():  # an id tells a row
        return by_ids(docs, found.where(~first).select("doc_id"), keep=False)
    kept = found.where(first)
    kept = materialize(kept.groupBy("doc_id", "key").count(), "kept").toDF("__id", "__k", "__n")
    keyed = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__key", BinaryType())]))
    out = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__key").eqNullSafe(F.col("__k")))
    if not kept.where("__n > 1").isEmpty():  # repeated rows: one of them stays
        out = out.where("__n = 1").unionByName(out.where("__n > 1").dropDuplicates(["__id", "__k"]))
    return out.select(*docs.columns)
