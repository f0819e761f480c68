"""Balanced shards, batches, windows and cost estimates."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def balance(sizes: Sequence[tuple[object, int]], k: int) -> dict[object, int]:
    """Longest first to the least loaded shard, ties to the lowest. For run plans of a few
    thousand units, made on the driver; data are dealt by :func:`deal`."""
    shards, out = [(0, i) for i in range(k)], {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        load, shard = heapq.heappop(shards)
        heapq.heappush(shards, (load + size, shard))
        out[name] = shard
    return out


def deal(df: DataFrame, by: Sequence[str], size: str, order: str, k: int) -> DataFrame:
    """Shards for large tables: ranked by size in each group and dealt back and forth."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(size), order)) - 1
    lane = r % (2 * k)
    return df.withColumn("shard", F.when(lane < k, lane).otherwise(2 * k - 1 - lane))


def batches(df: DataFrame, by: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in the given order."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size))


def windows(df: DataFrame, by: str, order: str, weight: str, least: int) -> DataFrame:
    """Adds ``window``: consecutive rows until their weight reaches ``least``, then the next
    one starts. The count resets, so a group is walked in order; only its keys and weights
    go to Python."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in (by, order, weight)}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        total = np.cumsum(pdf[weight].to_numpy())
        starts, base = [0], 0
        while (end := int(np.searchsorted(total[starts[-1] :], base + least)) + starts[-1]) < len(total) - 1:
            base = total[end]
            starts.append(end + 1)
        return pdf.assign(window=np.searchsorted(np.array(starts), np.arange(len(pdf)), side="right") - 1)

    schema = ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", window int"
    return df.select(by, order, weight).groupBy(by).applyInPandas(walk, schema)


def smaller_batch(n) -> Column:
    """The largest power of two below n (0 for n of 1 or less)."""
    v = F.col(n) if isinstance(n, str) else n
    return F.when(v > 1, F.pow(F.lit(2.0), F.floor(F.log2((v - 1).cast("double")) + 1e-12))).otherwise(0).cast("int")


def resized(height, width, most: int, factor: int = 28, least: int = 3136) -> Column:
    """struct(h, w): sides rounded to multiples of ``factor`` (half to even) with the area in bounds."""
    h, w = (F.col(x) if isinstance(x, str) else x for x in (height, width))
    near = lambda v: F.greatest(F.bround(v.cast("double") / factor) * factor, F.lit(float(factor)))
    area = near(h) * near(w)
    down, up = F.sqrt(h * w / most), F.sqrt(F.lit(float(least)) / (h * w))
    side = lambda v: F.when(area > most, F.greatest(F.floor(v / down / factor) * factor, F.lit(factor))).when(area < least, F.ceil(v * up / factor) * factor).otherwise(near(v)).cast("long")
    return F.struct(side(h).alias("h"), side(w).alias("w"))


def seconds_per_page(prefill: Column, rate: Column, tokens: Column) -> Column:
    return prefill + F.try_divide(tokens.cast("double"), rate.cast("double"))


def token_budget(lines: DataFrame, by: Sequence[str], order: str, text: str, budget: int) -> DataFrame:
    """Whole lines in order until their cost (a quarter of the characters, rounded up, and one)
    goes over the budget; nothing after the first that does."""
    cost = F.ceil(F.char_length(text) / 4) + 1
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("__used", F.sum(cost).over(w)).where(F.col("__used") <= budget).drop("__used")


def quotas(available: dict[str, int], total: int) -> dict[str, int]:
    """Water filling: as even as what is available allows, remainders to the first by name."""
    out, left = dict.fromkeys(available, 0), min(total, sum(available.values()))
    while left:
        open_ = sorted(k for k in available if out[k] < available[k])
        share = max(1, left // len(open_))
        for k in open_:
            take = min(share, available[k] - out[k], left)
            out[k] += take
            left -= take
    return out


def quota_sample(df: DataFrame, stratum: str, order: Sequence[Column], quota: int) -> DataFrame:
    """At most ``quota`` rows of each stratum, the first in a deterministic order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("__r") <= quota).drop("__r")


def seeded_order(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """A permutation fixed by seed and epoch."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(epoch)), key)

