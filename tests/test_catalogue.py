"""Every registered query against its SQL; those without SQL run and give rows."""

import math
from datetime import date, datetime

import duckdb
import pytest

from fieldloom.plans import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, datetime):
        return x.isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if x is not None and type(x).__name__ == "Decimal":
        return round(float(x), 5)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got, name
    if sql := catalogue.oracle_sql().get(name):
        rel = con.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        want = rows(rel.columns, rel.fetchall())
        assert len(got) == len(want) and got == want, (got[:3], want[:3])
