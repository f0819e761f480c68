"""Checks that fail closed: each returns what is wrong; an empty or all-ok result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.dates import bound

from fieldloom.functions.text import is_blank


def check_ids(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, extra and duplicate ids; one shuffle by id."""
    f = found.groupBy(key).agg(F.count("*").alias("n"))
    e = expected.select(key).distinct().withColumn("want", F.lit(1))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return f.join(e, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def check_partition(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """One row: whether the parts hold each id of the whole exactly once."""
    bad = check_ids(parts, whole, key)
    return bad.agg(*[F.count_if(F.col("problem") == p).alias(p) for p in ("missing", "extra", "duplicate")]).withColumn("ok", F.expr("missing + extra + duplicate = 0"))


def split_leaks(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups on more than one side of a split; a null group leaks by definition."""
    return df.groupBy(group).agg(F.count_distinct(side).alias("sides"), F.count("*").alias("n")).where((F.col("sides") > 1) | F.col(group).isNull())


def same_facts(runs: DataFrame, facts: Sequence[str]) -> DataFrame:
    """(fact, values, ok): whether all runs agree; a null is a value of its own."""
    n = F.array(*[F.struct(F.lit(f).alias("fact"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in facts])
    return runs.select(F.explode(n).alias("x")).select("x.*").groupBy("fact").agg(F.count_distinct("value").alias("values")).withColumn("ok", F.col("values") == 1)


def no_synthesis(out: DataFrame, arms: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cells of an output that hold a value which no arm has in that slot."""
    known = arms[0].select(*keys, "value")
    for a in arms[1:]:
        known = known.unionByName(a.select(*keys, "value"))
    return out.where(~is_blank("value")).join(known.distinct(), [*keys, "value"], "left_anti")


def leaked_values(texts: DataFrame, text: str, values: DataFrame, value: str, least: int = 4) -> DataFrame:
    """Values of a table that occur as whole strings in another's column."""
    kept = values.where((F.char_length(value) >= least) & ~F.col(value).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return texts.select(F.col(text).alias(value)).distinct().join(kept.select(value).distinct(), value)


#: Heads of passages up to this number are broadcast (under 100 MB), beyond it shuffled.
BROADCAST_HEADS = 1_000_000


def contained(docs: DataFrame, doc: str, text: str, passages: DataFrame, item: str, words: int = 6) -> DataFrame:
    """(doc, item): passages that a text holds word for word. Blocked by the passage's first
    words: a hash for every run of words of a text meets the passages' heads, carrying the
    document's key only; the texts of the hits are fetched for the exact test. Passages
    under ``words`` words are not looked for."""
    split = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), " ")
    padded = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), F.lit(" "))
    head = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])

    def heads(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - words)
        return bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.array_distinct(F.transform(at, lambda i: head(h, i))))

    p = passages.select(item, F.col(text).alias("__p"), bound(split(F.col(text)), lambda w: F.when(F.size(w) >= words, head(F.transform(F.slice(w, 1, words), lambda x: F.xxhash64(x)), F.lit(0)))).alias("__h")).where("__h IS NOT NULL")
    few = F.broadcast if p.count() <= BROADCAST_HEADS else (lambda df: df)
    d = docs.select(doc, F.explode(bound(split(F.col(text)), lambda w: F.when(F.size(w) >= words, heads(w)))).alias("__h"))
    hits = d.join(few(p.select(item, "__h")), "__h").select(doc, item).distinct()
    both = docs.select(doc, text).join(hits, doc).join(few(p.select(item, "__p")), item)
    return both.where(F.contains(padded(F.col(text)), padded(F.col("__p")))).select(doc, item).distinct()


def step_problems(df: DataFrame, by: Sequence[str], step: str, order: str) -> DataFrame:
    """(by, gaps, duplicates): of a log whose steps must be 1..n once each, in order."""
    w = W.partitionBy(*by).orderBy(order)
    df = df.withColumn("__back", F.coalesce(F.lag(step).over(w), F.lit(0)))
    return df.groupBy(*by).agg(F.count_if(F.col(step) > F.col("__back") + 1).alias("gaps"), (F.count(step) - F.count_distinct(step)).alias("duplicates"), F.count_if(F.col(step) <= F.col("__back")).alias("backwards"))


def repair_log(df: DataFrame, by: Sequence[str], step: str, order: str) -> DataFrame:
    """Last writer wins: a row stays unless a later one has its step or a lower one."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    return df.withColumn("__next", F.min(step).over(w)).where(F.col("__next").isNull() | (F.col("__next") > F.col(step))).drop("__next")


def failed_checks(checks: Sequence[tuple[str, object]]):
    """Array of the names of the predicates that do not hold (null counts as failed)."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]), lambda x: x.isNotNull())
