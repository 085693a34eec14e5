"""Every query that has SQL gives the same rows as DuckDB does, with the driver's contract for names and types."""

import math

import duckdb
import pytest

from causeway.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    con = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in con.description]
    kinds = {c[0]: str(c[1]) for c in con.description}
    want = con.fetchall()
    assert sorted(got.columns) == sorted(names)
    same = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}
    for c, kind in got.dtypes:
        assert same.get(kinds[c], kinds[c]) == kind, (c, kinds[c], kind)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want)


def test_queries_without_sql_run(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).count() > 0, name
