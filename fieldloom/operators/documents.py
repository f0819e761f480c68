"""Whole documents: normalised records, tags, readings of numbers, runs over lines, recall levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.dates import bound
from fieldloom.functions.numbers import normalize_value
from fieldloom.functions.text import c, id_key, is_blank, same_value
from fieldloom.operators import resampling


def normalized(df: DataFrame, header: str, fields: Mapping[str, str], items: str, row_fields: Mapping[str, str], order=None) -> DataFrame:
    """The records with their header and every row normalised by kind, and ``flags``: a map
    of path (header.<field>, line_items.<row>.<field>) to the flag, of what was flagged."""
    head = {f: normalize_value(k, F.col(f"{header}.{f}"), order) for f, k in fields.items()}
    rows = F.transform(items, lambda r: F.struct(*[normalize_value(k, r[f], order).alias(f) for f, k in row_fields.items()]))
    df = df.withColumns({"__h": F.struct(*[v.alias(f) for f, v in head.items()]), "__r": rows})
    flag = lambda path, v: F.struct(path.alias("path"), v["flag"].alias("flag"))
    found = [F.array(*[flag(F.lit(f"header.{f}"), F.col("__h")[f]) for f in fields])]
    each = F.transform("__r", lambda r, i: F.array(*[flag(F.concat(F.lit("line_items."), i.cast("string"), F.lit(f".{f}")), r[f]) for f in row_fields]))
    flags = F.map_from_entries(F.filter(F.concat(*found, F.flatten(each)), lambda e: e["flag"].isNotNull()))
    return df.withColumns(
        {header: F.struct(*[F.col("__h")[f]["value"].alias(f) for f in fields]), items: F.transform("__r", lambda r: F.struct(*[r[f]["value"].alias(f) for f in row_fields])), "flags": flags}
    ).drop("__h", "__r")


def number_readings(text) -> Column:
    """Array of the numbers that a printed one may mean: usually one, none if it is no number
    in any convention, two for one dot before three digits. Digits, dots and commas only."""

    def read(s: Column) -> Column:
        parts, marks = F.split(s, "[.,]"), F.translate(s, "0123456789", "")
        n, whole = F.char_length(marks), F.array_join(parts, "")
        point, first = F.right(marks, F.lit(1)), F.left(marks, F.lit(1))
        digits = F.forall(parts, lambda p: p != "")
        thousands = F.char_length(parts[0]).between(1, 3) & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.char_length(p) == 3)
        last = F.element_at(parts, -1)
        decimal = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ""), F.lit("."), last)
        alike = F.replace(marks, first, F.lit("")) == ""
        mixed = (n > 1) & ~alike & (F.char_length(F.replace(marks, point, F.lit(""))) == n - 1)
        none = F.lit(None).cast("string")
        one = F.when(n == 0, whole).when(mixed, decimal).when(alike & (first == ",") & thousands, whole).when((n == 1) & (first == ","), decimal).when((n == 1), decimal).when(alike & thousands & (n > 1), whole)
        two = F.when((n == 1) & (first == ".") & thousands, whole).otherwise(none)
        return F.when(digits, F.transform(F.array_compact(F.array(one, two)), lambda v: v.cast("double"))).otherwise(F.array().cast("array<double>"))

    return bound(c(text), read)


def repaired_readings(text) -> Column:
    """What a number means whose separators were misread: groups of three, then two digits
    after the last separator, in whatever separators; only where no convention reads it so."""
    s = c(text)
    digits = F.translate(s, ".,", "")
    value = (digits.try_cast("double")) / 100
    fits = s.rlike(r"^[0-9]{1,3}([.,][0-9]{3})+[.,][0-9]{2}$")
    return F.when(fits & ~F.array_contains(number_readings(s), value), F.array(value)).otherwise(F.array().cast("array<double>"))


def tags(cells: DataFrame, doc: str, field: str, value: str, not_printed: Sequence[str], absent: Sequence[str]) -> DataFrame:
    """(doc, illegible, absent): documents with a null that the print explains by no rule, and
    those with a null in a field whose line may be missing."""
    null = is_blank(value)
    return cells.groupBy(doc).agg(F.bool_or(null & ~F.col(field).isin(*not_printed)).alias("illegible"), F.bool_or(null & F.col(field).isin(*absent)).alias("absent"))


def flagged_path(path, folders: Sequence[str], suffixes: Sequence[str]) -> Column:
    """folder, suffix or null: why a path is not allowed."""
    p = F.lower(c(path))
    inside = F.lit(False)
    for f in folders:
        inside = inside | p.startswith(f"{f}/") | F.contains(p, F.lit(f"/{f}/"))
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | p.endswith(s)
    return F.when(inside, "folder").when(ends, "suffix")


def fold_meta(docs: DataFrame, folds: DataFrame, doc: str, group: str, fold: int) -> DataFrame:
    """Documents of one fold, with ``unseen``: whether none of the other folds has their group."""
    both = docs.join(folds, doc)
    others = both.where(F.col("fold") != fold).select(group).distinct().withColumn("__seen", F.lit(True))
    return both.where(F.col("fold") == fold).join(others, group, "left").withColumn("unseen", F.col("__seen").isNull()).drop("__seen")


def with_null(items, at, field: str) -> Column:
    """The rows with exactly one value nulled: ``field`` of the row at index ``at``."""
    return F.transform(c(items), lambda r, i: F.when(i == at, r.withField(field, F.lit(None).cast("string"))).otherwise(r))


def agreement(a: DataFrame, b: DataFrame, doc: str, row: str, fields: Sequence[str]) -> DataFrame:
    """(doc, row, field, agree, row_share, doc_share): two arms' cells on aligned rows, with
    the shares that agree in the row and in the document."""
    right = b.select(doc, row, *[F.col(f).cast("string").alias(f"__{f}") for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), same_value(F.col(f).cast("string"), f"__{f}").alias("agree")) for f in fields])).alias("x")
    cells = a.join(right, [doc, row]).select(doc, row, each).select(doc, row, "x.*")
    share = F.avg(F.col("agree").cast("double"))
    return cells.withColumns({"row_share": share.over(W.partitionBy(doc, row)), "doc_share": share.over(W.partitionBy(doc))})


def half_sample_interval(df: DataFrame, key: str, statistic, draws: int) -> DataFrame:
    """(lo, hi) of a statistic (a function of a table with ``draw`` to rows of (draw, x)) by
    half samples without replacement, rescaled about the whole sample's value by sqrt(m / n):
    a row is in a draw by a bit of the hash of both."""
    bit = resampling.multiplicity(F.col("draw"), F.col(key)) > 0
    each = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).where(bit)
    whole = statistic(df.withColumn("draw", F.lit(0))).first()
    centre = float(whole["x"])
    sizes = each.groupBy("draw").agg(F.count("*").alias("m"))
    n = df.count()
    scaled = statistic(each).join(sizes, "draw").select((F.lit(centre) + (F.col("x") - centre) * F.sqrt(F.col("m") / F.lit(float(max(n, 1))))).alias("x"))
    return scaled.agg(F.percentile("x", F.lit(0.025)).alias("lo"), F.percentile("x", F.lit(0.975)).alias("hi")).withColumn("x", F.lit(centre))


def cause_cube(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by every combination of the keys (``(all)`` where a key is added up)."""
    out = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("(none)")).alias(k) for k in keys]).cube(*keys).agg(F.count("*").alias("n"))
    return out.select(*[F.coalesce(k, F.lit("(all)")).alias(k) for k in keys], "n")


def groups_with_all(df: DataFrame, group: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Groups in which every one of the kinds occurs, with how often."""
    return df.groupBy(group).agg(F.count_distinct(F.when(F.col(kind).isin(*kinds), F.col(kind))).alias("k"), F.count("*").alias("n")).where(F.col("k") == len(set(kinds))).select(group, "n")


def line_crossing_runs(words: DataFrame, by: Sequence[str], line: str, place: str, word: str, longest: int = 4) -> DataFrame:
    """(by, first_line, last_line, run): keys of runs of two to ``longest`` words that cross a
    line break."""
    w = W.partitionBy(*by).orderBy(line, place)
    ahead = [F.struct(F.lead(line, k).over(w).alias("l"), F.lead(word, k).over(w).alias("w")) for k in range(1, longest)]
    df = words.select(*by, F.col(line).alias("first_line"), F.col(word).alias("__w"), F.array(*ahead).alias("__a"))
    runs = [F.struct(F.col("__a")[k - 2]["l"].alias("last_line"), F.concat(F.col("__w"), *[F.col("__a")[j]["w"] for j in range(k - 1)]).alias("run")) for k in range(2, longest + 1)]
    each = df.select(*by, "first_line", F.explode(F.array(*runs)).alias("r")).select(*by, "first_line", "r.*")
    return each.where("last_line > first_line AND run IS NOT NULL").withColumn("run", id_key("run"))


def recall_levels(df: DataFrame, levels: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, level_1, ...): shares found at each level or one before it."""
    cols, so_far = [], F.lit(False)
    for i, hit in enumerate(levels, 1):
        so_far = so_far | F.coalesce(hit, F.lit(False))
        cols.append(F.avg(so_far.cast("double")).alias(f"level_{i}"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *cols)


def choose_threshold(scores: DataFrame, score: str, positive: str, grid: Sequence[float], most: float = 0.01) -> DataFrame:
    """One row: the smallest threshold of the grid that at most that share of the negatives
    reaches, and the share of the positives that do."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in grid])).alias("t")
    per = scores.select(score, positive, t).groupBy("t").agg(
        F.avg(F.when(~F.col(positive), (F.col(score) >= F.col("t")).cast("double"))).alias("false_rate"), F.avg(F.when(F.col(positive), (F.col(score) >= F.col("t")).cast("double"))).alias("found")
    )
    return per.where(F.col("false_rate") <= most).agg(F.min_by(F.struct("t", "false_rate", "found"), "t").alias("b")).select("b.*")


def restoring_rule(saved: DataFrame, base: DataFrame, variants: Mapping[str, DataFrame], keys: Sequence[str], doc: str) -> DataFrame:
    """(doc, rules): documents whose saved cells differ from the base, and the single rules
    that restore them."""
    rows = lambda df, n: df.select(*keys, F.col("value").alias(n))
    both = rows(saved, "s").join(rows(base, "b"), list(keys), "full_outer")
    for name, df in variants.items():
        both = both.join(rows(df, f"v_{name}"), list(keys), "full_outer")
    per = both.groupBy(doc).agg((~F.bool_and(same_value("s", "b"))).alias("differs"), *[F.bool_and(same_value("s", f"v_{n}")).alias(f"ok_{n}") for n in variants]).where("differs")
    return per.select(doc, F.array_compact(F.array(*[F.when(F.col(f"ok_{n}"), F.lit(n)) for n in variants])).alias("rules"))


def recomposed(cells: DataFrame, by: Sequence[str], field: str, right: str) -> DataFrame:
    """(by, headline, recomposed, agree): the share of right cells, once from all cells and
    once from the fields' shares weighed by their cells."""
    per = cells.groupBy(*by, field).agg(F.count("*").alias("n"), F.avg(F.col(right).cast("double")).alias("p"))
    parts = per.groupBy(*by).agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("recomposed"))
    whole = cells.groupBy(*by).agg(F.avg(F.col(right).cast("double")).alias("headline"))
    return whole.join(parts, list(by)).withColumn("agree", F.abs(F.col("headline") - F.col("recomposed")) < 1e-9)


def keyed(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, entries): a map of key to value; of a key that repeats the greatest value counts."""
    per = df.groupBy(by, key).agg(F.max(value).alias("__v"))
    return per.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v")))).alias("entries"))
