"""Pages of a document merged in page order: votes, first and last values, rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.functions.text import blank_to_null, is_blank, is_header_row


def vote(df: DataFrame, doc: str, page: str, kind: str, allowed: Sequence[str]) -> DataFrame:
    """(doc, winner, votes): the most frequent allowed kind, ties to the earliest page."""
    tally = df.where(F.col(kind).isin(*allowed)).groupBy(doc, kind).agg(F.count("*").alias("n"), F.min(page).alias("first"))
    return tally.groupBy(doc).agg(F.max_by(kind, F.struct("n", -F.col("first"))).alias("winner"), F.sum("n").alias("votes"))


def first_value(value: str, page: str, first_page: Column) -> Column:
    """The first page's value, blank or not."""
    return F.max(F.when(F.col(page) == first_page, F.col(value)))


def last_value(value: str, page: str) -> Column:
    """The value of the last page that has one."""
    kept = F.struct(F.col(page).alias("p"), F.col(value).alias("v"))
    return F.max(F.when(~is_blank(value), kept))["v"]


def disagreement(df: DataFrame, doc: str, value: str) -> DataFrame:
    """(doc, n_values, disagree): distinct values over pages, white space and case aside."""
    key = F.regexp_replace(F.lower(blank_to_null(value)), r"(?U)\s", "")
    return df.groupBy(doc).agg(F.count_distinct(key).alias("n_values")).withColumn("disagree", F.col("n_values") > 1)


def merge_headers(df: DataFrame, doc: str, page: str, identity: Sequence[str], totals: Sequence[str], hints: Mapping[str, Column] | None = None) -> DataFrame:
    """One row a document: identity fields from the first page, totals from the last page that
    has a value, or from a hinted page that has one; pages that hold an ignored identity value."""
    w = W.partitionBy(doc)
    df = df.withColumn("__first", F.min(page).over(w))
    out = []
    for f in identity:
        out.append(first_value(f, page, F.col("__first")).alias(f))
        later = F.count_if((F.col(page) > F.col("__first")) & ~is_blank(f))
        blank = F.max(F.when(F.col(page) == F.col("__first"), is_blank(f).cast("int"))) == 1
        out.append((F.when(blank, later).otherwise(0)).alias(f"{f}_ignored"))
    for f in totals:
        value = last_value(f, page)
        if hints and f in hints:
            value = F.coalesce(F.max(F.when((F.col(page) == hints[f]) & ~is_blank(f), F.col(f))), value)
        out.append(value.alias(f))
    return df.groupBy(doc).agg(*out)


def kept_rows(rows: DataFrame, doc: str, page: str, idx: str, fields: Sequence[str], drop_null: bool = True, drop_headers: bool = True) -> DataFrame:
    """Rows of all pages in merged order (``row``), without repeated column heads and rows
    that are blank throughout; page and idx say where each came from."""
    keep = F.lit(True)
    if drop_headers:
        keep = keep & ~is_header_row(*fields)
    if drop_null:
        some = ~is_blank(fields[0])
        for f in fields[1:]:
            some = some | ~is_blank(f)
        keep = keep & some
    return rows.where(keep).withColumn("row", F.row_number().over(W.partitionBy(doc).orderBy(page, idx)) - 1)


def merge_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """Nested pages (doc_type, header struct, line_items array of struct; a null header is a
    page that failed) to one document: vote, first page's identity, last totals, rows in
    order; waybills have no rows; a document of failed pages is an invoice of nulls."""
    types = ("invoice", "waybill")
    header = pages.schema["header"].dataType
    totals = [f for f in header.names if f in TOTALS]
    identity = [f for f in header.names if f not in TOTALS]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), "doc_type", "header", "line_items")))
    grouped = pages.groupBy(doc).agg(ordered.alias("p"))
    kinds = F.filter(F.transform("p", lambda x: x["doc_type"]), lambda k: k.isin(*types))
    count = lambda kind: F.size(F.filter(kinds, lambda x: x == kind))
    n = {k: count(k) for k in types}
    kind = F.when(F.size(kinds) == 0, "invoice").when(n["invoice"] == n["waybill"], F.try_element_at(kinds, F.lit(1))).when(n["invoice"] > n["waybill"], "invoice").otherwise("waybill")
    named = [F.col("p")[0]["header"][f].alias(f) for f in identity]
    last = lambda f: F.try_element_at(F.filter(F.transform("p", lambda x: x["header"][f]), lambda v: ~is_blank(v)), F.lit(-1))
    named += [last(f).alias(f) for f in totals]
    rows = F.flatten(F.transform("p", lambda x: F.coalesce(x["line_items"], F.array().cast(pages.schema["line_items"].dataType))))
    fields = pages.schema["line_items"].dataType.elementType.names

    def keep(r: Column) -> Column:
        some = ~is_blank(r[fields[0]])
        for f in fields[1:]:
            some = some | ~is_blank(r[f])
        return some & ~is_header_row(*[r[f] for f in fields])

    rows = F.filter(rows, keep)
    none = F.array().cast(pages.schema["line_items"].dataType)
    return grouped.select(doc, kind.alias("doc_type"), F.struct(*named).alias("header"), F.when(kind == "waybill", none).otherwise(rows).alias("line_items"))


#: Fields taken from the last page that has them.
TOTALS = frozenset({"total_amount", "pieces", "gross_weight_kg"})


def split_pages(docs: DataFrame, doc: str, n_pages: str, items: str) -> DataFrame:
    """The inverse: (doc, page, rows) with the rows in contiguous chunks, the first ones one
    longer where they do not divide evenly."""
    each = docs.select(doc, F.explode(F.sequence(F.lit(0), F.col(n_pages) - 1)).alias("page"), n_pages, items)
    n, k = F.size(items), F.col(n_pages)
    base, extra = F.floor(n / k).cast("int"), n % k
    start = F.col("page") * base + F.least("page", extra)
    size = base + F.when(F.col("page") < extra, 1).otherwise(0)
    return each.select(doc, "page", F.slice(items, start.cast("int") + 1, size.cast("int")).alias("rows"))


def not_printed(cells: DataFrame, by: Sequence[str], value: str, threshold: float = 0.10) -> DataFrame:
    """Groups (document type, field) whose share of blank values reaches the threshold."""
    rate = F.avg(is_blank(value).cast("double")).alias("null_rate")
    return cells.groupBy(*by).agg(rate).where(F.col("null_rate") >= threshold)


def labelled_totals(lines: DataFrame, doc: str, page: str, line: str, text: str, label: str, exclude: str) -> DataFrame:
    """(doc, page, line, number): of each document the bottom-most line on the last page that
    matches the label, not the exclusion, and has a number after the label."""
    number = F.regexp_extract(F.col(text), rf"(?:{label})[^0-9]*(-?[0-9][0-9.,]*[0-9]|-?[0-9])", 1)
    hit = lines.where(F.col(text).rlike(label) & ~F.col(text).rlike(exclude)).withColumn("number", number).where("number <> ''")
    return hit.groupBy(doc).agg(F.max(F.struct(page, line, "number")).alias("t")).select(doc, "t.*")
