import duckdb
import pytest

from tidelog.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    key = lambda r: tuple((v is None, str(type(v)), v) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLE_SQL:
        return
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
