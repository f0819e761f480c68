"""Printed dates to ISO, only where exactly one reading is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import c, collapse, is_blank

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def bound(x: Column, then) -> Column:
    """``then`` of ``x``, which is computed once however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(x), then), 1)


def month_number(x) -> Column:
    """1 to 12 from a printed month name or its first three or more letters, else null."""

    def of(w: Column) -> Column:
        out = F.lit(None).cast("int")
        for k in range(12, 0, -1):
            out = F.when(F.lit(MONTHS[k - 1]).startswith(w), k).otherwise(out)
        return F.when(F.char_length(w) >= 3, out)

    return bound(F.lower(c(x)), of)


def iso(y, m, d) -> Column:
    """ISO text of a valid date, else null; year 0 is none."""
    made = F.concat_ws("-", *[F.lpad(c(v).cast("string"), n, "0") for v, n in ((y, 4), (m, 2), (d, 2))])
    return F.when((c(y).try_cast("int") > 0) & c(m).isNotNull() & made.try_cast("date").isNotNull(), made)


def parts_of(x) -> Column:
    """A printed date in pieces: runs of digits, of ASCII letters, and of what stands between."""
    return F.regexp_extract_all(collapse(x), F.lit("[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0))


def _digits(part: Column, least: int, most: int) -> Column:
    return part.rlike(f"^[0-9]{{{least},{most}}}$")


def _made_of(part: Column, chars: str) -> Column:
    return F.translate(part, chars, "") == ""


def _read(t: Column) -> Column:
    """The distinct valid ISO readings of a date in pieces, day first before month first."""
    one, s1, two, s2, year, end = (F.get(t, F.lit(k)) for k in range(6))
    n = F.size(t)
    same = s1 == s2
    plain = (n == 5) & same & _digits(one, 1, 2) & _digits(two, 1, 2) & _digits(year, 4, 4) & s1.isin("/", ".", "-")
    sorted_ = (n == 5) & same & (s1 == "-") & _digits(one, 4, 4) & _digits(two, 2, 2) & _digits(year, 2, 2)
    # a point may end the month's name, before what parts it from the year
    after_name = F.when(s2.startswith("."), F.substr(s2, F.lit(2))).otherwise(s2)
    named = (n == 5) & _digits(one, 1, 2) & _digits(year, 4, 4) & _made_of(s1, " -") & (after_name != "") & _made_of(after_name, " ,-") & F.char_length(two).between(3, 9)
    lead = (n >= 5) & _digits(two, 1, 2) & F.char_length(one).between(3, 9) & s1.isin(" ", ". ")
    last = F.when((n == 6) & F.lower(s2).isin("st", "nd", "rd", "th") & year.isin(" ", ", "), end).when((n == 5) & s2.isin(" ", ", "), year)
    lead = lead & _digits(last, 4, 4)
    found = F.array(
        F.when(sorted_, iso(one, two, year)),
        F.when(plain, iso(year, two, one)),
        F.when(plain & (s1 != "."), iso(year, one, two)),
        F.when(named, iso(year, month_number(two), one)),
        F.when(lead, iso(last, month_number(one), two)),
    )
    return F.array_distinct(F.array_compact(found))


def readings(x) -> Column:
    """The distinct valid ISO readings of a printed date, day first before month first."""
    return F.coalesce(bound(parts_of(x), _read), F.array().cast("array<string>"))


def normalize_date(x, order=None) -> Column:
    """struct(value, flag): ISO where one reading is valid; where two are, the one that
    ``order`` (a column of 'dmy' / 'mdy' / null) picks, flagged; else the text as it was,
    flagged. Digits never change."""
    order = F.lit(None).cast("string") if order is None else c(order)

    def chosen(found: Column) -> Column:
        one, two = F.size(found) == 1, (F.size(found) == 2) & order.isin("dmy", "mdy")
        value = F.when(one, found[0]).when(two, F.when(order == "dmy", found[0]).otherwise(found[1])).otherwise(c(x))
        flag = F.when(one, F.lit(None)).when(two, "date_order_inferred").when(F.size(found) > 1, "date_ambiguous").otherwise("date_unparsed")
        return F.struct(value.alias("value"), flag.cast("string").alias("flag"))

    return bound(readings(x), chosen)


def infer_order(df: DataFrame, group: str, raw: str) -> DataFrame:
    """(group, date_order): dmy or mdy where all one-sided evidence of the group agrees."""
    one, s1, two, s2, year = (F.get("t", F.lit(k)) for k in range(5))
    plain = (F.size("t") == 5) & (s1 == s2) & s1.isin("/", "-") & _digits(one, 1, 2) & _digits(two, 1, 2) & _digits(year, 4, 4)
    read = df.select(group, parts_of(raw).alias("t")).where(plain)
    day, month = iso(year, two, one), iso(year, one, two)
    seen = read.select(group, (day.isNotNull() & month.isNull()).alias("d"), (day.isNull() & month.isNotNull()).alias("m"))
    votes = df.select(group, F.lit(False).alias("d"), F.lit(False).alias("m")).distinct().unionByName(seen).groupBy(group).agg(F.bool_or("d").alias("d"), F.bool_or("m").alias("m"))
    return votes.select(group, F.when(F.col("d") & ~F.col("m"), "dmy").when(F.col("m") & ~F.col("d"), "mdy").alias("date_order"))


def not_iso(x) -> Column:
    """Not blank, and no real ISO date."""
    return ~is_blank(x) & F.coalesce(~c(x).rlike(ISO) | F.try_to_date(c(x), "yyyy-MM-dd").isNull(), F.lit(True))


def forms_in(x) -> Column:
    """All ISO dates that a text holds, both readings of ambiguous ones, in order, once each."""
    numeric = F.regexp_extract_all(c(x), F.lit(r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{1,2}([/.-])\d{1,2}\1\d{4})(?!\d)"), F.lit(0))
    named = F.regexp_extract_all(c(x), F.lit(r"\b(?:\d{1,2}[ -]+[A-Za-z]{3,9}\.?[ ,-]+\d{4}|[A-Za-z]{3,9}\.? +\d{1,2}(?:st|nd|rd|th)?,? +\d{4})\b"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(F.concat(numeric, named), readings)))
