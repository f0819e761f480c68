"""Scores from the cell table: micro averages, slices, confusion, taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.numbers import lenient_number
from fieldloom.functions.text import alnum_key, is_blank, is_misread

HEADER_WEIGHT, ITEMS_WEIGHT, DOCS_WEIGHT = 0.4, 0.4, 0.2


def rate(a, b, scale: float = 1.0) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.try_divide(x.cast("double") * scale, y.cast("double"))


def slices(df: DataFrame, flags: Mapping[str, Column], keep_all: bool = True) -> DataFrame:
    """A row for each (overlapping) slice a document is in; null flags are in none."""
    names = [F.lit("all")] * keep_all
    names += [F.when(c, F.lit(f"{n}=yes")).when(~c, F.lit(f"{n}=no")) for n, c in flags.items()]
    return df.withColumn("slice", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def overall(docs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Micro-averaged scores of documents with counts header_right, header_cells, rows_full,
    rows_pred, rows_gold, fully: ratios of sums, never means of ratios. Without gold rows the
    header accuracy stands in for the rows."""
    cols = ("header_right", "header_cells", "rows_full", "rows_pred", "rows_gold", "fully")
    s = docs.groupBy(*by).agg(F.count("*").alias("docs"), *[F.sum(F.col(c).cast("long")).alias(c) for c in cols])
    p, r = rate("rows_full", "rows_pred"), rate("rows_full", "rows_gold")
    s = s.withColumns({"header_accuracy": rate("header_right", "header_cells"), "row_precision": p, "row_recall": r, "fully_correct": rate("fully", "docs")})
    s = s.withColumn("row_f1", rate(2 * F.col("rows_full"), F.col("rows_pred") + F.col("rows_gold")))
    items = F.when(F.col("rows_gold") > 0, F.coalesce("row_f1", F.lit(0.0))).otherwise(F.col("header_accuracy"))
    return s.withColumn("overall", HEADER_WEIGHT * F.col("header_accuracy") + ITEMS_WEIGHT * items + DOCS_WEIGHT * F.col("fully_correct"))


def null_confusion(cells: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """gold_null, pred_null, true_null, over_null, false_fill, precision and recall of nulls over
    several groupings in one pass (grouping sets)."""
    g, p = is_blank("gold"), is_blank("pred")
    every = sorted({c for s in sets for c in s})
    df = cells.withColumns({"gn": g.cast("int"), "pn": p.cast("int"), "tn": (g & p).cast("int"), "on": (~g & p).cast("int"), "ff": (g & ~p).cast("int")})
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every])
    out = grouped.agg(F.count("*").alias("cells"), *[F.sum(a).alias(b) for a, b in (("gn", "gold_null"), ("pn", "pred_null"), ("tn", "true_null"), ("on", "over_null"), ("ff", "false_fill"))])
    return out.withColumns({"null_precision": rate("true_null", "pred_null"), "null_recall": rate("true_null", "gold_null")})


def concentration(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """One row: total, and the share of the ``n`` keys with most rows (ties by key)."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), key).limit(n).agg(F.sum("n").alias("top"))
    return per.agg(F.sum("n").alias("total"), F.count("*").alias("keys")).join(F.broadcast(top)).withColumn("share", rate("top", "total"))


def top_groups(df: DataFrame, by: str, doc: str, cells: str, n: int = 6) -> DataFrame:
    """Rows, cells and distinct documents of the groups with most cells."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(cells).alias("cells"), F.count_distinct(doc).alias("docs")).orderBy(F.desc("cells"), by).limit(n)


def distribution(df: DataFrame, by: Sequence[str], x: str, quantiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """n, min, mean, max and linear quantiles."""
    q = [F.percentile(x, F.lit(v)).alias(f"p{round(100 * v)}") for v in quantiles]
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("min"), F.avg(x).alias("mean"), *q, F.max(x).alias("max"))


def round_up(x, multiple: int) -> Column:
    v = F.col(x) if isinstance(x, str) else x
    return (F.ceil(v / multiple) * multiple).cast("long")


def classify_value(pred: str, gold: str, siblings: str, supported: Column) -> Column:
    """What is wrong with a value, in order of precedence; null if the keys agree.
    ``siblings`` is an array of the other gold values of the document."""
    key = alnum_key(pred)
    na, nb = lenient_number(pred), lenient_number(gold)
    same_number = F.coalesce(F.abs(na - nb) < 0.005, F.lit(False))
    sibling = F.exists(siblings, lambda s: (alnum_key(s) == key) & (key != ""))
    return (
        F.when(is_blank(pred) & is_blank(gold), F.lit(None)).when(is_blank(gold), "false_fill").when(is_blank(pred), "missed").when(key == alnum_key(gold), F.lit(None))
        .when(~supported, "hallucination").when(same_number, "normalization").when(sibling, "wrong_field").when(is_misread(pred, gold), "misread").otherwise("other")
    )


def edit_class(pred: str, gold: str, glyphs: Sequence[str] = ("0O", "1I", "1L", "5S", "8B", "2Z", "6G")) -> Column:
    """punctuation_only, glyph_confusion, char_dropped_or_added, other_substitution or mixed."""
    a, b = F.upper(alnum_key(pred)), F.upper(alnum_key(gold))
    chars = lambda s: F.filter(F.split(s, ""), lambda x: x != "")
    pairs = F.filter(F.zip_with(chars(a), chars(b), lambda x, y: F.concat(F.least(x, y), F.greatest(x, y))), lambda p: F.substr(p, F.lit(1), F.lit(1)) != F.substr(p, F.lit(2), F.lit(1)))
    known = ["".join(sorted(g)) for g in glyphs]
    gap = F.abs(F.char_length(a) - F.char_length(b))
    return (
        F.when(a == b, "punctuation_only").when((gap == 0) & F.forall(pairs, lambda p: p.isin(*known)), "glyph_confusion")
        .when((gap > 0) & (F.levenshtein(a, b) == gap), "char_dropped_or_added").when(gap == 0, "other_substitution").otherwise("mixed")
    )


def split_merge(singles: DataFrame, others: DataFrame, doc: str, key: str, qty: str) -> DataFrame:
    """Rows of ``singles`` whose quantity is the sum of two or more rows of the same key on the
    other side."""
    sums = others.groupBy(doc, key).agg(F.sum(qty).alias("total"), F.count("*").alias("parts")).where("parts > 1")
    return singles.join(sums, [doc, key]).where(F.abs(F.col(qty) - F.col("total")) < 0.005)


def near_boundary(rank: str, n: str, k: int = 3) -> Column:
    """Whether a 0-based rank is among the first or last ``k``."""
    return (F.col(rank) < k) | (F.col(rank) >= F.col(n) - k)


def length_bucket(n: str) -> Column:
    return F.when(F.col(n) == 0, "0").when(F.col(n) <= 5, "1-5").when(F.col(n) <= 20, "6-20").when(F.col(n) <= 50, "21-50").otherwise("51+")


def column_state(n_filled: str, n_rows: str) -> Column:
    """printed, not_printed or mixed."""
    return F.when(F.col(n_filled) == 0, "not_printed").when(F.col(n_filled) == F.col(n_rows), "printed").otherwise("mixed")


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumns({"rank": F.row_number().over(w.orderBy(*order)) - 1, "n_in_group": F.count("*").over(w)})
