"""Checks of values, documents and runs: shapes and codes, date formats, ids, settings, keys."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.dates import bound
from fieldloom.functions.text import SPACE, c, is_blank, strip

#: The formats in which a date counts as the same day printed otherwise.
FORMATS = (
    "d/M/yyyy", "M/d/yyyy", "d.M.yyyy", "d-M-yyyy", "M-d-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d-MMM-yy", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd",
    "d/M/yy", "M/d/yy", "d.M.yy", "MMM d yyyy", "MMMM d yyyy",
)


def date_matches(pred, gold) -> Column:
    """Whether a prediction is the gold ISO date printed otherwise: in one of the formats, or
    with a time after it. The identical text is no match. Two-digit years are 1969 to 2068."""
    g = c(gold)

    def found(p: Column) -> Column:
        out = p.startswith(g)
        for f in FORMATS:
            day = F.try_to_date(p, f)
            if not f.endswith("yyyy") and "yyyy" not in f:
                day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
            out = out | F.coalesce(F.date_format(day, "yyyy-MM-dd") == g, F.lit(False))
        return out & (p != g)

    return F.coalesce(bound(F.initcap(F.lower(strip(pred))), found), F.lit(False))


def value_flags(kind: str, value, codes: Iterable[str] = ()) -> Column:
    """Array of flags of one value: a currency or an airport that is not among ``codes``, a
    waybill number of the wrong shape. Blank values are never flagged."""
    v = F.upper(F.regexp_replace(c(value), SPACE, ""))
    bad = {
        "currency": ("currency_not_iso4217", lambda: ~v.isin(*codes)),
        "airport": ("airport_not_iata", lambda: ~v.isin(*codes)),
        "awb": ("awb_bad_shape", lambda: ~v.rlike(r"^[0-9]{3}-[0-9]{8}$")),
        "hawb": ("hawb_bad_shape", lambda: ~v.rlike(r"^[A-Z]{2}[0-9]{8}$")),
    }
    none = F.array().cast("array<string>")
    if kind not in bad:
        return none
    name, wrong = bad[kind]
    return F.when(~is_blank(value) & wrong(), F.array(F.lit(name))).otherwise(none)


def doc_flags(fields: Mapping[str, tuple[str, Column, Iterable[str]]]) -> Column:
    """Map of field to its flags, of the fields that have any."""
    entries = F.array(*[F.struct(F.lit(f).alias("k"), value_flags(kind, v, codes).alias("v")) for f, (kind, v, codes) in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: F.size(e["v"]) > 0))


def repaired(value, pattern: str) -> Column:
    """struct(value, repaired): null for what does not have the pattern; an impossible date
    that has it stays. Doing it twice changes nothing."""
    bad = c(value).isNotNull() & ~c(value).rlike(pattern)
    return F.struct(F.when(~bad, c(value)).alias("value"), F.coalesce(bad, F.lit(False)).alias("repaired"))


def names_columns(text, families: Mapping[str, str], least: int = 2) -> Column:
    """Whether a line names that many column families."""
    low = F.lower(c(text))
    return sum((low.rlike(p).cast("int") for p in families.values()), F.lit(0)) >= least


def item_like(text, totals: str, tokens: int = 4, numbers: int = 2) -> Column:
    """A line of so many tokens, so many of them numbers, that is no totals line."""
    parts = F.filter(F.split(c(text), r"\s+"), lambda t: t != "")
    return ~F.lower(c(text)).rlike(totals) & (F.size(parts) >= tokens) & (F.size(F.filter(parts, lambda t: t.rlike(r"^[-+(]?[0-9][0-9.,]*[)%]?$"))) >= numbers)


def repeated_values(values) -> Column:
    """Whether a value that is not blank stands twice in an array."""
    v = F.filter(c(values), lambda x: ~is_blank(x))
    return F.size(F.array_distinct(v)) < F.size(v)


def coverage(ids: DataFrame, key: str, groups: str, expected: DataFrame, required: Sequence[object]) -> DataFrame:
    """One row: groups that are missing, ids in more than one group, ids missing from all and
    ids that nobody expects."""
    per = ids.groupBy(key).agg(F.count_distinct(groups).alias("n"))
    both = per.withColumn("__a", F.lit(1)).join(expected.select(key).distinct().withColumn("__e", F.lit(1)), key, "full_outer")
    counts = both.agg(F.count_if(F.col("n") > 1).alias("several"), F.count_if(F.col("__a").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unexpected"))
    found = ids.agg(F.collect_set(F.when(F.col(groups).isin(*required), F.col(groups))).alias("f"))
    absent = found.select(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), "f")).alias("absent_groups"))
    return absent.withColumn("__k", F.lit(0)).join(counts.withColumn("__k", F.lit(0)), "__k").drop("__k")


def settings_agree(runs: DataFrame, run: str, setting: str, value: str) -> DataFrame:
    """(setting, values, agree): a setting agrees if all runs have one value of it."""
    n, total = F.count_distinct(value), F.count_distinct(run)
    every = runs.agg(total.alias("__n"))
    per = runs.groupBy(setting).agg(n.alias("values"), total.alias("__have"), F.count_if(F.col(value).isNull()).alias("__null"))
    return per.withColumn("__k", F.lit(0)).join(F.broadcast(every.withColumn("__k", F.lit(0))), "__k").select(setting, "values", ((F.col("values") == 1) & (F.col("__have") == F.col("__n")) & (F.col("__null") == 0)).alias("agree"))


def refusals(runs: DataFrame, run: str, checks: Mapping[str, Column]) -> DataFrame:
    """(run, reasons): all the reasons why a run cannot be used again, none left out."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return runs.select(run, failed.alias("reasons"))


def duplicate_keys(text) -> Column:
    """The keys that an object in JSON names more than once at its top level, in order; up to
    four levels below it are passed over, whose keys hold no brackets."""
    t = c(text)
    bare = F.regexp_replace(t, r'("(?:[^"\\]|\\.)*+"\s*:)|"(?:[^"\\]|\\.)*+"', "$1")  # string values go
    inner = F.regexp_replace(F.regexp_replace(bare, r"^\s*\{|\}\s*$", ""), r"\{[^{}]*\}|\[[^\[\]]*\]", "0")
    for _ in range(3):
        inner = F.regexp_replace(inner, r"\{[^{}]*\}|\[[^\[\]]*\]", "0")
    return bound(F.regexp_extract_all(inner, F.lit(r'"((?:[^"\\]|\\.)*+)"\s*:'), F.lit(1)), lambda k: F.filter(F.array_distinct(k), lambda x: F.size(F.filter(k, lambda y: y == x)) > 1))


def key_structure(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, signature): the sorted keys of an output, the same for runs of one structure."""
    return rows.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(key)), ",").alias("signature"))


def same_again(first: DataFrame, second: DataFrame, volatile: Sequence[str] = ()) -> DataFrame:
    """One row: rows of each reading that the other does not have, volatile columns aside."""
    a, b = first.drop(*volatile), second.select(first.columns).drop(*volatile)
    only = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n)).withColumn("__k", F.lit(0))
    return only(a, b, "only_first").join(only(b, a, "only_second"), "__k").drop("__k")


def merged_shards(shards: DataFrame, order: DataFrame, key: str, shard: str, setting: str) -> tuple[DataFrame, DataFrame]:
    """The rows of all shards in the canonical order (key, place), and one row of checks:
    settings that differ, keys in two shards, keys missing."""
    placed = shards.join(order, key).orderBy("place")
    per = shards.groupBy(key).agg(F.count_distinct(shard).alias("n"))
    missing = order.join(per, key, "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("several"))
    checks = missing.withColumn("__k", F.lit(0)).join(shards.agg(F.count_distinct(setting).alias("settings")).withColumn("__k", F.lit(0)), "__k").drop("__k")
    return placed, checks


def token_ends(tokens: DataFrame, by: str, order: str, length: str, total: str) -> DataFrame:
    """Adds ``end``: how far each token reaches, never back and never past the text."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return tokens.withColumn("end", F.least(F.max(length).over(w), F.col(total)))
