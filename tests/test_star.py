"""Every query on star-schema tables, and on games derived from them, against the same query in SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from dugout.plans import derived, derived_studies, star

QUERIES, SQL = {**star.QUERIES, **derived.QUERIES, **derived_studies.QUERIES}, {**star.SQL, **derived.SQL, **derived_studies.SQL}
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as con:
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
        yield con


def plain(value):
    if isinstance(value, decimal.Decimal | float):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, tables, name):
    df = QUERIES[name](spark, SMALL)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        r = tables.execute(SQL[name])
        assert got == table([c[0] for c in r.description], r.fetchall())
