"""Queries over series whose events share times, against SQL."""

import duckdb
import pytest

import __spark_entry__

from .test_queries import plain

NAMES = ["over_time_short_step", "over_time_sum", "over_time_avg", "over_time_count", "over_time_stddev", "over_time_quantile", "over_time_min_max", "range_deriv", "native_histogram_over_time"]


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Three users have an event of each kind in every half hour of two days, in the same millisecond."""
    folder = tmp_path_factory.mktemp("crowded")
    duckdb.sql(f"""COPY (SELECT k * 6 + u * 2 + t AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(k * 30) AS ts, u AS user_id, ['click', 'view'][t + 1] AS event_type, 1.0 + k % 7 + u / 4 AS value, '' AS props
        FROM range(96) a(k), range(3) b(u), range(2) c(t)) TO '{folder}/events.parquet'""")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_all_events_of_a_time_count(spark, crowded, name):
    df = __spark_entry__.queries()[name](spark, str(crowded))
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{crowded}/events.parquet' ORDER BY event_id; SET threads = 1")
    cursor = c.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert rows == sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in cursor.fetchall()), key=str) and rows


def test_one_time_only(spark, tmp_path):
    """Rates over samples of one time are not numbers that anything can be said of; they do not fail."""
    duckdb.sql(f"COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01 12:00:00' AS ts, k AS user_id, 'click' AS event_type, 1.0 + k AS value, '' AS props FROM range(3) a(k)) TO '{tmp_path}/events.parquet'")
    for name in ("range_rate", "range_irate", "range_delta", "range_changes_resets"):
        assert len(__spark_entry__.queries()[name](spark, str(tmp_path)).collect()) == (0 if name == "range_irate" else 1)
