"""Append-only logs as streams: idempotent appends, resume, repair, windows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_log(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).format(fmt).load(folder)


def windowed(df: DataFrame, ts: str, by: Sequence[str], value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in event-time windows; rows later than the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = df.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(df: DataFrame, ts: str, by: Sequence[str], gap: str, late: str = "10 minutes") -> DataFrame:
    out = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(df: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def highest_step(df: DataFrame, by: str, step: str) -> DataFrame:
    """(by, step, dropped) after each batch of a log: a step that is not above the last kept one
    takes back the kept ones from there on (last writer wins)."""
    kind = df.schema[by].dataType.simpleString()

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, dropped = state.get if state.exists else (0, 0)
        for pdf in batches:
            for s in pdf[step]:
                if s <= last:
                    dropped += int(last - s + 1)
                last = int(s)
        state.update((last, dropped))
        yield pd.DataFrame({by: [key[0]], "step": [last], "dropped": [dropped]})

    return df.groupBy(by).applyInPandasWithState(walk, f"{by} {kind}, step long, dropped long", "last long, dropped long", "update", GroupStateTimeout.NoTimeout)


def append_once(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the sink does not have yet; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # nothing written so far
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
