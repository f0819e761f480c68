"""Calibration curves, thresholds and review flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ties(df: DataFrame, conf: str, correct: str, by: Sequence[str]) -> DataFrame:
    """One row for each score, with how many rows and right ones have it or a higher one."""
    per = df.where(F.col(conf).isNotNull() & ~F.isnan(F.col(conf).cast("double"))).groupBy(*by, conf).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("long")).alias("k"))
    w = W.partitionBy(*by).orderBy(F.desc(conf))
    return per.select(*by, F.col(conf).alias("tau"), F.sum("n").over(w).alias("accepted"), F.sum("k").over(w).alias("right")).withColumn("precision", F.col("right") / F.col("accepted"))


def select_tau(df: DataFrame, conf: str, correct: str, target: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, tau): the lowest threshold whose accepted rows are right often enough; tie groups
    stay whole, and all thresholds are tried, as precision is not monotone."""
    return _ties(df, conf, correct, by).groupBy(*by).agg(F.min(F.when(F.col("precision") >= target, F.col("tau"))).alias("tau"))


def nested_accept(df: DataFrame, conf: str, correct: str, fold: str, folds: Sequence[int], target: float) -> DataFrame:
    """Adds ``accept``: a fold's threshold is chosen on the other folds only."""
    others = df.withColumn("__for", F.explode(F.array(*[F.lit(k) for k in folds]))).where(F.col(fold) != F.col("__for"))
    tau = select_tau(others, conf, correct, target, ["__for"])
    both = df.join(F.broadcast(tau), F.col(fold) == F.col("__for"), "left")
    return both.withColumn("accept", F.coalesce(F.col(conf) >= F.col("tau"), F.lit(False))).drop("__for", "tau")


def precision_at_coverage(df: DataFrame, conf: str, correct: str, least: float) -> DataFrame:
    """One row: the best precision that accepts at least that share, ties to the larger set."""
    t = _ties(df, conf, correct, ()).withColumn("coverage", F.col("accepted") / F.max("accepted").over(W.partitionBy()))
    return t.where(F.col("coverage") >= least).agg(F.max_by(F.struct("tau", "precision", "coverage"), F.struct("precision", "accepted")).alias("b")).select("b.*")


def reliability(df: DataFrame, p: str, y: str, bins: int = 15, mass: bool = False, tie: str | None = None) -> DataFrame:
    """(bin, n, mean_p, rate) in bins of equal width (an edge belongs to the upper one) or
    equal mass (the first ones larger)."""
    b = F.ntile(bins).over(W.orderBy(p, *([tie] if tie else []))) - 1 if mass else F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", b).groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def ece(bins: DataFrame) -> DataFrame:
    """One row: the mean gap between said and seen, weighted by rows."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def coverage_curve(df: DataFrame, conf: str, correct: str, tie: str, points: int = 50) -> DataFrame:
    """(point, k, accuracy): accuracy of the most confident share at evenly spaced points."""
    w = W.orderBy(F.desc(conf), tie)
    run = df.select(F.row_number().over(w).alias("k"), F.avg(F.col(correct).cast("double")).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("accuracy"), F.count("*").over(W.partitionBy()).alias("n"))
    at = df.sparkSession.range(1, points + 1).select(F.col("id").cast("int").alias("point"))
    total = df.agg(F.count("*").alias("n"))
    wanted = at.join(F.broadcast(total)).select("point", F.greatest(F.lit(1), F.bround(F.col("point") * F.col("n") / points)).cast("int").alias("k"))
    return run.join(F.broadcast(wanted), "k").select("point", "k", "accuracy")


def review_counts(df: DataFrame, accept: str, correct: str, doc: str) -> DataFrame:
    """One row: precision of the accepted, recall of errors by review, share reviewed, and the
    share of documents accepted whole."""
    a, c = F.col(accept), F.col(correct).cast("boolean")
    per = df.groupBy(doc).agg(F.count_if(a).alias("acc"), F.count_if(a & c).alias("acc_right"), F.count_if(~c).alias("wrong"), F.count_if(~a & ~c).alias("wrong_seen"), F.count("*").alias("n"))
    s = per.agg(*[F.sum(x).alias(x) for x in ("acc", "acc_right", "wrong", "wrong_seen", "n")], F.avg((F.col("acc") == F.col("n")).cast("double")).alias("docs_accepted"))
    d = lambda x, y: F.try_divide(F.col(x).cast("double"), F.col(y).cast("double"))
    return s.select(d("acc_right", "acc").alias("precision"), d("wrong_seen", "wrong").alias("error_recall"), (1 - d("acc", "n")).alias("review_rate"), "docs_accepted")


def flags(df: DataFrame, kind: str, p: str, emitted: str, taus: Mapping[str, float | None]) -> Column:
    """unscored, accept or review; a kind without a threshold is always reviewed."""
    tau = F.lit(None).cast("double")
    for k, t in taus.items():
        tau = F.when(F.col(kind) == k, F.lit(t).cast("double")).otherwise(tau)
    return F.when(~F.col(emitted), "unscored").when(F.coalesce(F.col(p) >= tau, F.lit(False)), "accept").otherwise("review")


def doc_features(df: DataFrame, doc: str, p: str, cuts: Sequence[float] = (0.5, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Aggregates of a document's field probabilities."""
    low = [F.count_if(F.col(p) < c).alias(f"below_{round(100 * c)}") for c in cuts]
    return df.groupBy(doc).agg(F.count("*").alias("n"), F.min(p).alias("min_p"), F.avg(p).alias("mean_p"), F.sum(1 - F.col(p)).alias("expected_errors"), *low)
