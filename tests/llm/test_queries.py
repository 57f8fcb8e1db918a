import os

import duckdb
import pytest

from lakeloom.llm import queries

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want and want
