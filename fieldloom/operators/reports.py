"""Compositions: labels of cells, run metrics, ladders of rules, paired comparisons."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import awb_key, is_blank, same_value
from fieldloom.operators import resampling


def label_cells(pred: DataFrame, gold: DataFrame, keys: Sequence[str], same: Callable[[str, str], Column]) -> DataFrame:
    """Adds ``correct`` and ``gold_null`` to predicted cells; a cell without a gold one is neither."""
    g = gold.select(*keys, F.col("value").alias("__g"), F.lit(True).alias("__in"))
    both = pred.join(g, list(keys), "left")
    inside = F.coalesce(F.col("__in"), F.lit(False))
    return both.withColumns({"correct": inside & same("value", "__g"), "gold_null": inside & is_blank("__g")}).drop("__g", "__in")


def cross_link(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of each side have a partner by key on the other, and how many
    keys more than one row shares."""
    ka, kb = (x.where(~is_blank(key)).select(awb_key(key).alias("k")) for x in (a, b))
    na, nb = ka.groupBy("k").agg(F.count("*").alias("na")), kb.groupBy("k").agg(F.count("*").alias("nb"))
    both = na.join(nb, "k", "full_outer")
    return both.agg(
        F.coalesce(F.sum(F.when(F.col("nb").isNotNull(), F.col("na"))), F.lit(0)).alias("a_linked"), F.coalesce(F.sum(F.when(F.col("na").isNotNull(), F.col("nb"))), F.lit(0)).alias("b_linked"),
        F.count_if(F.col("na") > 1).alias("a_shared"), F.count_if(F.col("nb") > 1).alias("b_shared"),
    )


def run_metrics(pages: DataFrame, by: Sequence[str], valid: str, seconds: str, memory: str, tokens: str) -> DataFrame:
    """Validity, mean and 95th percentile of time, most memory, mean tokens of a run's pages."""
    return pages.groupBy(*by).agg(
        F.count("*").alias("pages"), F.avg(F.col(valid).cast("double")).alias("valid_rate"), F.avg(seconds).alias("seconds"), F.percentile(seconds, F.lit(0.95)).alias("p95"), F.max(memory).alias("memory"), F.avg(tokens).alias("tokens")
    )


def rank_runs(scores: DataFrame) -> DataFrame:
    """Runs by overall score, fewer false fills, then name."""
    return scores.orderBy(F.desc("overall"), F.asc("false_fills"), F.asc("run"))


def auroc_draws(df: DataFrame, score: str, label: str, doc: str, n: int) -> DataFrame:
    """(draw, auroc) on documents drawn again; draws with one class have none."""
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__m", resampling.multiplicity(F.col("draw"), F.col(doc))).where("__m > 0")
    ties = each.groupBy("draw", score).agg(F.sum(F.when(F.col(label) == 1, F.col("__m")).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) != 1, F.col("__m")).otherwise(0)).alias("q"))
    w = resampling.W.partitionBy("draw").orderBy(score).rowsBetween(resampling.W.unboundedPreceding, -1)
    ties = ties.withColumn("below", F.coalesce(F.sum("q").over(w), F.lit(0)))
    s = ties.groupBy("draw").agg(F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))).alias("w"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return s.select("draw", F.try_divide(F.col("w").cast("double"), (F.col("np") * F.col("nq")).cast("double")).alias("auroc"))


def ladder(df: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]], score: Callable[[DataFrame], DataFrame], leave_one_out: bool = False) -> DataFrame:
    """(step, scores) after each step on top of those before, or with each one left out."""
    out, now = score(df).withColumn("step", F.lit("none")), df
    names = list(steps)
    for name in names:
        if leave_one_out:
            now = df
            for other in names:
                now = now if other == name else steps[other](now)
        else:
            now = steps[name](now)
        out = out.unionByName(score(now).withColumn("step", F.lit(name)))
    return out


def cell_changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(field, filled, cleared, altered): what a step did to the cells."""
    both = before.select(*keys, F.col("value").alias("b")).join(after.select(*keys, F.col("value").alias("a")), list(keys), "full_outer")
    return both.groupBy("field").agg(
        F.count_if(is_blank("b") & ~is_blank("a")).alias("filled"), F.count_if(~is_blank("b") & is_blank("a")).alias("cleared"), F.count_if(~is_blank("b") & ~is_blank("a") & ~same_value("a", "b")).alias("altered")
    )


def oracle_fill(pred: DataFrame, gold: DataFrame, keys: Sequence[str], where: Column) -> DataFrame:
    """Predicted cells with gold in its place where ``where`` holds: an upper bound."""
    g = gold.select(*keys, F.col("value").alias("__g"))
    return pred.join(g, list(keys), "left").withColumn("value", F.when(where, F.col("__g")).otherwise(F.col("value"))).drop("__g")


def replayed_batches(pages: DataFrame, batch: str, members: str, page: str) -> DataFrame:
    """(batch, members, ok): whether all pages of a recorded batch say the same members, and
    every member is there."""
    m = F.array_sort(F.col(members))
    seen = pages.groupBy(batch).agg(F.count_distinct(F.to_json(m)).alias("versions"), F.any_value(m).alias("members"), F.array_sort(F.collect_set(page)).alias("pages"))
    return seen.select(batch, "members", ((F.col("versions") == 1) & (F.col("members") == F.col("pages"))).alias("ok"))


def leaves(df: DataFrame, key: str, nested: Mapping[str, Column]) -> DataFrame:
    """(key, path, value): named leaves as rows, for comparing runs cell by cell."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), v.cast("string").alias("value")) for p, v in nested.items()])).alias("l")
    return df.select(key, each).select(key, "l.*")


def flag_report(df: DataFrame, flagged: str, wrong: str) -> DataFrame:
    """One row: recall and precision of a flag on what is wrong, and its false alarms with interval."""
    f, w = F.col(flagged), F.col(wrong)
    s = df.agg(F.count_if(f & w).alias("tp"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & w).alias("fn"), F.count_if(~f & ~w).alias("tn"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return s.select("*", rate("tp", "fn").alias("recall"), rate("tp", "fp").alias("precision"), resampling.wilson(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_alarms"))
