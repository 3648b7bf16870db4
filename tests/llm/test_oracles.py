"""Queries with SQL against DuckDB: on the smallest tables, and on a table with planted links and odd vectors."""

import duckdb
import numpy as np
import pytest

from seriesforge.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same(spark, name, folder, table):
    df = QUERIES[name](spark, folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'/*.parquet' if folder != SF else ''}')")
    r = c.sql(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    rows = sorted((tuple(x[n] for n in names) for x in df.collect()), key=str)
    assert rows == sorted(r.fetchall(), key=str)
    return rows


@pytest.mark.parametrize(("name", "table"), [("op4_int8_embedding_dedup", "embeddings"), ("op8_suffix_dedup", "documents")])
def test_matches_sql(spark, name, table):
    assert same(spark, name, SF, table)


def test_planted_links_match_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 24))
    v = np.concatenate([base, base[:12] + 0.2 * rng.normal(size=(12, 24)), base[:1] + 0.33 * rng.normal(size=(50, 24)), base[5:8], 2 * base[8:9]]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] + [1.0] * 23), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = same(spark, "op4_int8_embedding_dedup", str(tmp_path), "embeddings")
    assert sum(not r[3] for r in rows) > 20
