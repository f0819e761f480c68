"""A plain function over the rows of each group, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in an Arrow batch of results; one group's are never cut.
OUT_ROWS = 10_000


def per_group(df: DataFrame, key: str, func: Callable[[object, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``func(key, rows)`` gives rows of ``schema`` for each group; its rows are tuples of the
    other columns, in no order. Groups are sorted side by side and read one after the other:
    a small one costs no call or frame of its own, and memory holds one at a time."""
    names = [key, *[c for c in df.columns if c != key]]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.types)], kinds.names)

        cells = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
        out: list[tuple] = []
        for k, rows in groupby(cells, itemgetter(0)):
            out += func(k, [r[1:] for r in rows])
            if len(out) >= OUT_ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    return df.select(*names).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
