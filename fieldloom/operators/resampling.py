"""Bootstrap intervals and rank statistics.

A draw's multiplicities come from hashes of (draw, unit), so that a resample needs neither a
collected index matrix nor an order of the units: draws are exploded on the units' sufficient
statistics and added up with map-side partial sums, one row a draw and group in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.dates import bound


def multiplicity(draw, unit) -> Column:
    """Poisson(1) weight from 32 bits of an MD5; the same in any engine with MD5. The bits
    are held against the cumulative probabilities as they stand, as eight hex digits."""
    text = F.concat(draw.cast("string"), F.lit("|"), unit.cast("string"))
    # fixed values: cumulative probabilities of a Poisson variable with mean 1
    cuts = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    edges = F.array(*[F.lit(f"{math.ceil(c * 2**32):08x}") for c in cuts])
    return bound(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(8)), lambda u: F.size(F.filter(edges, lambda e: e <= u)))


def draws(units: DataFrame, unit: str, sums: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, draw, sums): resampled sums of each unit's statistics."""
    each = units.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    each = each.withColumn("__m", multiplicity(F.col("draw"), F.col(unit))).where("__m > 0")
    return each.groupBy(*by, "draw").agg(*[F.sum(F.col("__m") * F.col(s)).alias(s) for s in sums])


def intervals(drawn: DataFrame, metrics: Mapping[str, Column], by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(by, metric, lo, hi): percentile intervals; draws where a ratio has no denominator are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])).alias("m")
    q = [F.percentile("value", F.lit(p)).alias(n) for n, p in (("lo", alpha / 2), ("hi", 1 - alpha / 2))]
    return drawn.select(*by, each).select(*by, "m.*").groupBy(*by, "metric").agg(*q)


def paired_delta(units: DataFrame, unit: str, a: tuple[str, str], b: tuple[str, str], n: int, alpha: float = 0.05) -> DataFrame:
    """One row: the difference of two ratios of sums on the same resamples: lo, hi, and the
    share of draws at or under zero."""
    cols = sorted({*a, *b})
    drawn = draws(units, unit, cols, n)
    delta = F.try_divide(F.col(b[0]).cast("double"), F.col(b[1]).cast("double")) - F.try_divide(F.col(a[0]).cast("double"), F.col(a[1]).cast("double"))
    return drawn.select(delta.alias("delta")).agg(
        F.percentile("delta", F.lit(alpha / 2)).alias("lo"), F.percentile("delta", F.lit(1 - alpha / 2)).alias("hi"), F.avg((F.col("delta") <= 0).cast("double")).alias("share_not_better")
    )


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, auroc): ties count a half; null where a class is missing. Rows are added up to one
    for each score before the running sum."""
    ties = df.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = ties.withColumn("below", below).groupBy(*by).agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("w"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return s.select(*by, F.try_divide(F.col("w").cast("double"), (F.col("np") * F.col("nq")).cast("double")).alias("auroc"))


def wilson(k, n, z: float = 1.959963984540054) -> Column:
    """struct(lo, hi); (0, 1) without trials."""
    k, n = k.cast("double"), n.cast("double")
    centre = F.try_divide(k + z * z / 2, n + z * z)
    half = F.try_divide(z * F.sqrt(F.try_divide(k * (n - k), n) + z * z / 4), n + z * z)
    return F.struct(F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0).alias("lo"), F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0).alias("hi"))


def corrected_share(flagged, fpr, tpr) -> Column:
    """Share behind a flagged share, null unless the flag is better than chance."""
    return F.when(tpr > fpr, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (flagged - fpr) / (tpr - fpr))))


def ks_distance(df: DataFrame, x: str, first: Column) -> DataFrame:
    """One row: the largest gap between two samples' distribution functions."""
    per = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(first.cast("long")).alias("a"), F.sum((~first).cast("long")).alias("b"))
    w, every = W.orderBy(x), W.partitionBy()
    gap = F.abs(F.try_divide(F.sum("a").over(w).cast("double"), F.sum("a").over(every).cast("double")) - F.try_divide(F.sum("b").over(w).cast("double"), F.sum("b").over(every).cast("double")))
    return per.select(gap.alias("g")).agg(F.max("g").alias("ks"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rho) with average ranks of ties."""
    for c in (x, y):
        low, n = F.rank().over(W.partitionBy(*by).orderBy(c)), F.count("*").over(W.partitionBy(*by, c))
        df = df.withColumn(f"__r_{c}", low + (n - 1) / 2)
    return df.groupBy(*by).agg(F.corr(f"__r_{x}", f"__r_{y}").alias("rho"))


def least_squares(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def log_loss(p, y, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))
