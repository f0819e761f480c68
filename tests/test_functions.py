"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import dates, numbers, text


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn("x").alias("y")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "07/07/2019": ("2019-07-07", None), "30/09/2018": ("2018-09-30", None), "08/11/2017": ("08/11/2017", "date_ambiguous"), "08.11.2017": ("2017-11-08", None), "9-17-2020": ("2020-09-17", None),
        "30/02/2019": ("30/02/2019", "date_unparsed"), "2019-00-10": ("2019-00-10", "date_unparsed"), " 2018-12-24 ": ("2018-12-24", None), "2-Octo. 2015": ("2015-10-02", None), "11 jul,1999": ("1999-07-11", None),
        "Dec 2nd, 2016": ("2016-12-02", None), "august. 9 2001": ("2001-08-09", None), "28/02/1900": ("1900-02-28", None), "6/7-2011": ("6/7-2011", "date_unparsed"), "?": ("?", "date_unparsed"), "": ("", "date_unparsed"),
        "4 Ju 2012": ("4 Ju 2012", "date_unparsed"), "0000-01-01": ("0000-01-01", "date_unparsed"), "12 Marching 2014": ("12 Marching 2014", "date_unparsed"), "1/2/3/2004": ("1/2/3/2004", "date_unparsed"),
    }
    got = run(spark, dates.normalize_date, list(cases))
    assert {k: (g.value, g.flag) for k, g in zip(cases, got)} == cases
    us = run(spark, lambda x: dates.normalize_date(x, F.lit("mdy")), ["02/10/2021", "27/10/2021"])
    assert [(g.value, g.flag) for g in us] == [("2021-02-10", "date_order_inferred"), ("2021-10-27", None)]
    df = spark.createDataFrame([("k", "14-03-2010"), ("k", "02-03-2010"), ("l", "03-14-2010"), ("l", "14-03-2010"), ("m", "14.03.2010"), ("n", None), ("o", "3-14-2010")], "g string, x string")
    assert {r.g: r.date_order for r in dates.infer_order(df, "g", "x").collect()} == {"k": "dmy", "l": None, "m": None, "n": None, "o": "mdy"}
    assert run(spark, dates.not_iso, ["2018-12-24", "2018-02-30", " ", None, "24/12/2018"]) == [False, True, False, False, True]
    assert run(spark, dates.forms_in, ["by 02/10/2021 or 6 June 2014, 2018-12-24"])[0] == ["2021-10-02", "2021-02-10", "2018-12-24", "2014-06-06"]
    assert run(spark, dates.month_number, ["Nov", "novem", "no", "may", "mayo", None]) == [11, 11, None, 5, None, None]


@pytest.mark.parametrize(
    "raw, value, flag",
    [
        ("7.901,25", "7901.25", None), ("CHF 7,901.25", "7901.25", None), ("7'901.25", "7901.25", None), ("GBP7.901,25", "7901.25", None), ("7 901,25", "7901.25", "number_decimal_comma"),
        ("8,765", "8765", "number_comma_thousands"), ("31,4", "31.4", "number_decimal_comma"), ("8.765", "8.765", "number_dot_three_decimals"), ("8.765.432", "8765432", None), ("-9", "-9", None), ("kg -3,5", "-3.5", "number_decimal_comma"),
        ("9,87,654", "9,87,654", "number_unparsed"), ("98 76", "98 76", "number_unparsed"), ("9 876 543", "9876543", None), ("9 876 543,2", "9876543.2", "number_decimal_comma"), ("2 b 3", "2 b 3", "number_unparsed"), ("some", "some", "number_unparsed"),
        ("40 bottles", "40 bottles", "number_unparsed"), ("003.30", "003.30", None), ("", "", "number_unparsed"), ("1,2.3,4", "1,2.3,4", "number_unparsed"), ("5..6", "5..6", "number_unparsed"), ("1,234.567,8", "1,234.567,8", "number_unparsed"),
        ("12345.678", "12345.678", None), ("6 ct no", "6", None), ("6 a b", "6 a b", "number_unparsed"), ("4/5", "4/5", "number_unparsed"),
    ],
)
def test_numbers(spark, raw, value, flag):
    got = run(spark, numbers.normalize_number, [raw])[0]
    assert (got.value, got.flag) == (value, flag)


def test_codes_keys_and_shapes(spark):
    assert [(g.value, g.flag) for g in run(spark, lambda x: numbers.normalize_code(x, True), ["osl oslo", "osl", "oslo", " cdg/paris"])] == [
        ("OSL", "airport_city_stripped"), ("OSL", None), ("OSLO", None), ("CDG", "airport_city_stripped")]
    assert run(spark, text.is_blank, [None, "", "  \t", "x", " ", " x "]) == [True, True, True, False, True, False]
    assert run(spark, text.shape_of, ["AB-12/é", "٣x"]) == ["AA-99/é", "9A"]
    assert run(spark, text.alnum_key, ["A-b C_1"]) == ["abc1"] and run(spark, text.id_key, [" a b "]) == ["AB"]
    assert run(spark, text.is_label_only, ["Qty Nr", "SKU77", "supplier's ref", "", None, "gasket"]) == [True, False, True, False, False, False]
    assert run(spark, text.mask, ["order 12-34 now"]) == ["order <5> now"]
    assert run(spark, lambda x: text.cap_cells(F.split(x, ","), 7, "|"), ["ab,cd,efg", "abcdefghij,k", ""]) == [["ab", "cd"], ["abcdefg"], [""]]
    assert run(spark, numbers.mawb_check, ["020-1234567 5", "020-12345676", "12", None]) == ["pass", "fail", "uncheckable", "uncheckable"]
    assert run(spark, numbers.plain_digits, ["1234.50", "1E+6", "1.5e-3", "-12e1", "x", "1e99", "0.10"]) == ["1234.50", "1000000", "0.0015", "-120", None, None, "0.10"]
    assert run(spark, numbers.plain_number, ["1,234.5", "nan", "inf", "x", None]) == [1234.5, None, None, None, None]
    assert run(spark, numbers.lenient_number, ["USD 1.234,50", "7", "a"]) == [1234.5, 7.0, None]


def test_same_and_misread(spark):
    df = spark.createDataFrame([("1,000", "1000.004"), ("1", "1.01"), (None, " "), ("", "x"), ("ab", "A B"), ("x-1", "x1")], "a string, b string")
    got = df.select(*[numbers.same(k, "a", "b").alias(k) for k in ("num", "id", "name")], text.is_misread("a", "b").alias("m")).collect()
    assert [r.num for r in got] == [True, False, True, False, False, False]
    assert [r.id for r in got] == [False, False, True, False, True, False]
    assert [r.name for r in got] == [False, False, True, False, True, True]
    assert [r.m for r in got] == [False, True, False, False, True, True]
