"""Clusters of signatures, agreement of labelings, distances to reference centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def euclid(a, b) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    parts = F.zip_with(x, y, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double")))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))


def fit_clusters(df: DataFrame, features: str, k: int, seed: int = 42) -> KMeansModel:
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster", maxIter=40).fit(df.withColumn("__v", array_to_vector(features)))


def assign_clusters(model: KMeansModel, df: DataFrame, features: str) -> DataFrame:
    return model.transform(df.withColumn("__v", array_to_vector(features))).drop("__v")


def centres(df: DataFrame, by: Sequence[str], features: str, n: int) -> DataFrame:
    """(by, centre): component means of arrays of ``n`` numbers."""
    return df.groupBy(*by).agg(F.array(*[F.avg(F.col(features)[i].cast("double")) for i in range(n)]).alias("centre"))


def nearest_centre(df: DataFrame, features: str, reference: DataFrame, label: str) -> DataFrame:
    """Adds ``nearest`` and ``distance``. ``reference`` (label, centre) is a fitted model of
    few rows and is gathered into one broadcast array."""
    one = reference.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "centre"))).alias("__refs"))
    dist = F.transform("__refs", lambda r: F.struct(euclid(F.col(features), r["centre"]).alias("distance"), r["label"].alias("label")))
    return df.join(F.broadcast(one)).withColumn("__n", F.array_min(dist)).withColumns({"nearest": F.col("__n.label"), "distance": F.col("__n.distance")}).drop("__n", "__refs")


def agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: adjusted Rand index, purity and coverage from the contingency table."""
    t = df.groupBy(label, cluster).agg(F.count("*").alias("n"))
    pairs = lambda x: F.sum(x * (x - 1) / 2)
    n = F.col("n")
    inner = t.agg(pairs(n).alias("ij"), F.sum("n").alias("total"))
    rows = t.groupBy(label).agg(F.sum("n").alias("s"), F.max("n").alias("m")).agg(pairs(F.col("s")).alias("a"), F.sum("m").alias("covered"))
    cols = t.groupBy(cluster).agg(F.sum("n").alias("s"), F.max("n").alias("m")).agg(pairs(F.col("s")).alias("b"), F.sum("m").alias("pure"))
    all3 = inner.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0))
    return all3.select(ari.alias("ari"), (F.col("pure") / F.col("total")).alias("purity"), (F.col("covered") / F.col("total")).alias("coverage"))


def calibrate_threshold(seen: DataFrame, unseen: DataFrame, distance: str, q: float = 0.95) -> DataFrame:
    """One row: the quantile of seen distances, and how many of each lie beyond it."""
    t = seen.agg(F.percentile(distance, F.lit(q)).alias("threshold"))
    over = lambda df, n: df.join(F.broadcast(t)).agg(F.avg((F.col(distance) > F.col("threshold")).cast("double")).alias(n))
    return t.join(F.broadcast(over(seen, "fpr"))).join(F.broadcast(over(unseen, "tpr")))
