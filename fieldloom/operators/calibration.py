"""Calibrated probabilities: portable logistic models, cross-fitting by grouped folds."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PortableModel:
    """Fill values, population means and deviations, coefficients: enough to score in SQL."""

    features: tuple[str, ...]
    fill: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def loads(text: str) -> PortableModel:
        d = json.loads(text)
        return PortableModel(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})

    def standard(self) -> Column:
        return F.array(*[(F.coalesce(F.col(f).cast("double"), F.lit(x)) - m) / s for f, x, m, s in zip(self.features, self.fill, self.mean, self.scale)])

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for f, x, m, s, c in zip(self.features, self.fill, self.mean, self.scale, self.coef):
            z = z + (F.coalesce(F.col(f).cast("double"), F.lit(x)) - m) / s * c
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(700.0)), F.lit(-700.0))))


def fit_portable(df: DataFrame, features: Sequence[str], label: str) -> PortableModel:
    """Mean imputation, standardisation by population deviation, L2 logistic regression with
    unit cost; the prior if a class has fewer than two rows."""
    n = len(features)
    aggs = [F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")]
    for i, f in enumerate(features):
        aggs += [F.coalesce(F.avg(f), F.lit(0.0)).alias(f"m{i}")]
    s = df.agg(*aggs).first()
    means = [float(s[f"m{i}"]) for i in range(n)]
    d = df.agg(*[F.stddev_pop(F.coalesce(F.col(f).cast("double"), F.lit(m))).alias(f"d{i}") for i, (f, m) in enumerate(zip(features, means))]).first()
    scale = [float(x) if x else 1.0 for x in d]
    blank = PortableModel(tuple(features), tuple(means), tuple(means), tuple(scale), (0.0,) * n, 0.0)
    rows, up = s["n"], s["p"] or 0
    if min(up, rows - up) < 2:
        import math

        return PortableModel(blank.features, blank.fill, blank.mean, blank.scale, blank.coef, math.log((up + 0.5) / (rows - up + 0.5)))
    model = LogisticRegression(regParam=1 / rows, standardization=False, featuresCol="__v", labelCol="__y", maxIter=200, tol=1e-8).fit(
        df.select(array_to_vector(blank.standard()).alias("__v"), F.col(label).cast("double").alias("__y"))
    )
    return PortableModel(blank.features, blank.fill, blank.mean, blank.scale, tuple(map(float, model.coefficients)), float(model.intercept))


def cross_fit(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence[int], fit: Callable = fit_portable) -> DataFrame:
    """Adds ``p``: each fold is scored by a model fitted on the others."""
    p = F.lit(None).cast("double")
    for k in folds:
        model = fit(df.where(F.col(fold) != k), features, label)
        p = F.when(F.col(fold) == k, model.probability()).otherwise(p)
    return df.withColumn("p", p)


def assign_folds(groups: Sequence[tuple[object, int, int]], k: int) -> dict[object, int]:
    """Groups (name, rows, positives) to folds, largest first, where the positives and then the
    rows are fewest. Made on the driver from one row a group."""
    load = [[0, 0] for _ in range(k)]
    out = {}
    for name, n, pos in sorted(groups, key=lambda g: (-g[1], str(g[0]))):
        i = min(range(k), key=lambda j: (load[j][1] + pos if pos else load[j][0] + n, load[j][0], j))
        load[i][0] += n
        load[i][1] += pos
        out[name] = i
    return out


def choose(losses: dict[str, float], default: str, margin: float = 0.01) -> str:
    """The default unless another one's loss is lower by more than the margin."""
    best = min(losses, key=lambda k: (losses[k], k))
    return best if losses[default] - losses[best] > margin else default
