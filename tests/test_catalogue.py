import datetime
import decimal
import math
import os

import duckdb
import pytest

from lakeloom import catalogue

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cur = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == want


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.filter_conj(spark, SF)._jdf.queryExecution().toString()
    assert "IsNotNull(l_returnflag), GreaterThanOrEqual(l_quan" in plan.split("PushedFilters:")[1]
    schema = plan.split("ReadSchema: ")[1]
    assert "l_discount" in schema and "l_extendedprice" not in schema and "l_comment" not in schema
