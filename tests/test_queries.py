"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from seriesforge.queries import QUERIES

from .conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return v if v is None else ("NaN" if v != v else round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    r = duck.sql(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert columns == sorted(names)
    assert rows == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
