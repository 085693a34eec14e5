import duckdb
import pytest


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Asserts that a registered query and its SQL give the same rows."""
    from causeway.llm import queries

    def check(name):
        got = queries.queries()[name](spark, sf_dir)
        con = duck.execute(queries.oracle_sql()[name])
        names = sorted(x[0] for x in con.description)
        want = con.fetchall()
        order = [[x[0] for x in con.description].index(n) for n in names]
        assert sorted(got.columns) == names
        key = lambda r: tuple((x is None, str(x)) for x in r)
        assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(
            (tuple(r[i] for i in order) for r in want), key=key
        )

    return check
