"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a worker tokenises at once. Bounds a worker's memory
#: whatever the rows of an Arrow batch hold; one text is never cut.
CHUNK_CHARS = 1_500_000
#: Words a worker keeps numbered before it starts afresh.
MAX_WORDS = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session has none and all runs on one machine (tests), a temporary one
    is set; on a cluster that is an error, as its machines would not share it.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage,
    survives the loss of executors, and is compressed, unlike checkpoint()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldloom/{tag}-{uuid.uuid4().hex}"
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    driver_gives_back(spark)
    return spark.read.schema(df.schema).parquet(path)


_written: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was materialized in it. What is to outlast it has to be
    written before the end by other means, or around it."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Whole texts in an Arrow batch (some 2 MB): both sides of the pipe hold one batch and more.
TEXT_ROWS = 1_000


def gives_back(run: Callable) -> Callable:
    """``run`` for mapInArrow, at whose end its memory goes back to the system. Workers are
    used again, and what the allocators keep of one task would add up with the executor's."""

    @wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _system_gets_back()

    return whole


def _system_gets_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def driver_gives_back(spark: SparkSession) -> str | None:
    """Free memory of the driver's Python and of its JVM outside the heap goes back to the system.
    What the JVM's compilers take for a query's generated code stays with the allocator
    otherwise, and adds up over the queries of a long run. The JVM's report; None where it
    cannot do that (the command is there on Linux since Java 17.0.9)."""
    _system_gets_back()
    try:
        jvm, gateway = spark._jvm, spark.sparkContext._gateway

        def array(kind, *values):
            made = gateway.new_array(kind, len(values))
            for i, value in enumerate(values):
                made[i] = value
            return made

        # the server's own class is not open to reflection, its interface is
        named, kinds = jvm.java.lang.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(named, kinds)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return str(invoke.invoke(server, array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))))
    except Exception:  # another JVM or allocator: nothing to give back
        return None


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run within, where rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Like :func:`materialize`, but no scratch around it deletes it."""
    held, _written[:] = _written[:], []
    try:
        return materialize(df, tag)
    finally:
        _written[:] = held


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` begins like it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def crc_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def keyed_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only (doc_id, text, ...): extra columns, whatever their names, stay out.
    A null text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``budget`` bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0), dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // budget
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


#: Ids up to this number are broadcast to filter by (under 64 MB), beyond it shuffled.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """The rows of ``docs`` whose doc_id is (``keep``) or is not in ``ids`` (one column)."""
    ids = materialize(ids.toDF("__id").distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi" if keep else "left_anti")


class Numbered:
    """Numbers words as they come and keeps, for each number, what ``derive``
    makes of the new words (a list) as rows of one array."""

    def __init__(self, derive: Callable[[list], np.ndarray], limit: int = MAX_WORDS):
        self.derive, self.limit = derive, limit
        self._reset()

    def _reset(self):
        self.ids: dict = defaultdict(count().__next__)
        self.known, self.rows = 0, None

    def __call__(self, words: list) -> np.ndarray:
        """Row numbers of the words; ``rows`` is valid for them until the next call."""
        if len(self.ids) > self.limit:
            self._reset()
        out = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.ids) > self.known:
            fresh = list(self.ids)[self.known :]
            made = self.derive(fresh)
            size = self.known + len(fresh)
            if self.rows is None or size > len(self.rows):
                room = np.zeros((max(2 * size, 4096), *made.shape[1:]), dtype=made.dtype)
                if self.known:
                    room[: self.known] = self.rows[: self.known]
                self.rows = room
            self.rows[self.known : size] = made
            self.known = size
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))
