"""Conditional updates with value-free records of what changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import is_blank, same_value, shape_of


def fill_if_blank(target: str, source, when: Column) -> Column:
    """``source`` where ``target`` is blank, ``source`` is not and ``when`` holds."""
    s = F.col(source) if isinstance(source, str) else source
    return F.when(when & is_blank(target) & ~is_blank(s), s).otherwise(F.col(target))


def unique_match(text, pattern: str) -> Column:
    """The one distinct match of a pattern, null if there are none or several."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), F.lit(0)))
    return F.when(F.size(found) == 1, found[0])


def learn_exclusive_shapes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(shape, side): shapes that occur in exactly one of two columns. One aggregation."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("value")) for s in (a, b)])).alias("x")
    shaped = rows.select(sides).select("x.*").where(~is_blank("value")).select("side", shape_of("value").alias("shape"))
    return shaped.groupBy("shape").agg(F.min("side").alias("side"), F.max("side").alias("other")).where("side = other").select("shape", "side")


def swap_by_shape(rows: DataFrame, a: str, b: str, shapes: DataFrame) -> DataFrame:
    """A lone value whose shape belongs to the other column moves there; two that point across
    change places. Adds ``change``: moved_to_<b>, moved_to_<a>, swapped or null.

    ``shapes`` is a learned artifact of bounded size and is broadcast."""
    look = lambda name: F.broadcast(shapes.select(F.col("shape").alias(f"__shape_{name}"), F.col("side").alias(f"__side_{name}")))
    df = rows
    for x in (a, b):
        df = df.join(look(x), shape_of(F.col(x)) == F.col(f"__shape_{x}"), "left")
    ea, eb = is_blank(a), is_blank(b)
    across_a, across_b = F.coalesce(F.col(f"__side_{a}") == b, F.lit(False)), F.coalesce(F.col(f"__side_{b}") == a, F.lit(False))
    to_b, to_a, swap = ~ea & eb & across_a, ~eb & ea & across_b, ~ea & ~eb & across_a & across_b
    change = F.when(to_b, f"moved_to_{b}").when(to_a, f"moved_to_{a}").when(swap, "swapped")
    new_a = F.when(to_b, F.lit(None)).when(to_a | swap, F.col(b)).otherwise(F.col(a))
    new_b = F.when(to_a, F.lit(None)).when(to_b | swap, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"change": change, a: new_a, b: new_b}).select(*rows.columns, "change")


def records(df: DataFrame, doc: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(doc, rule, field): one record for each rule (name, field, whether it changed the row)."""
    each = F.array(*[F.when(hit, F.struct(F.lit(n).alias("rule"), F.lit(f).alias("field"))) for n, f, hit in rules])
    return df.select(doc, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("r")).select(doc, "r.*")


def effect(before_ok, after_ok) -> Column:
    """fixed, broken or neutral."""
    b, a = (F.col(x) if isinstance(x, str) else x for x in (before_ok, after_ok))
    return F.when(~b & a, "fixed").when(b & ~a, "broken").otherwise("neutral")


def null_policy(value: str, p_correct: str, p_null: str) -> Column:
    """The value, or null where P(null) exceeds P(correct); blanks stay."""
    return F.when(~is_blank(value) & (F.col(p_null) > F.col(p_correct)), F.lit(None)).otherwise(F.col(value))


def filled(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that were filled or altered (there must be none after a null policy)."""
    both = before.select(*keys, F.col("value").alias("b")).join(after.select(*keys, F.col("value").alias("a")), list(keys))
    return both.where(~is_blank("a") & ~same_value("a", "b"))


def reread_decision(old: str, new: str, p_old: str, p_new: str, supported: str, margin: float = 0.1, fill_least: float = 0.5) -> Column:
    """struct(action, reason) of a second reading: replaced only if more confident by a margin,
    a blank filled only if the text supports it."""
    gain = F.col(p_new) - F.col(p_old)
    reason = (
        F.when(is_blank(new) & is_blank(old), "both_blank").when(is_blank(new), "reread_blank").when(F.col(p_new).isNull() | F.isnan(p_new), "reread_unscored")
        .when(is_blank(old) & ~F.col(supported), "fill_unsupported").when(is_blank(old) & (F.col(p_new) < fill_least), "fill_unsure").when(is_blank(old), "filled")
        .when(same_value(old, new), "same").when(F.col(p_old).isNull() | F.isnan(p_old), "old_unscored").when(gain > margin, "replaced").otherwise("not_better")
    )
    return F.struct(F.when(reason.isin("filled", "replaced"), "take").otherwise("keep").alias("action"), reason.alias("reason"))


def select_slot(a, b, p_a, p_b) -> Column:
    """The value of the arm with the strictly higher probability, ties to the second; a value
    that only one arm has is kept from a half up. Never anything that no arm has."""
    va, vb, pa, pb = (F.col(x) if isinstance(x, str) else x for x in (a, b, p_a, p_b))
    only_a, only_b = ~is_blank(va) & is_blank(vb), is_blank(va) & ~is_blank(vb)
    return F.when(only_a, F.when(pa >= 0.5, va)).when(only_b, F.when(pb >= 0.5, vb)).when(is_blank(va) & is_blank(vb), F.lit(None)).when(pa > pb, va).otherwise(vb)
