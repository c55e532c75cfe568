import datetime

import duckdb
import pytest

from tidegraph import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        db.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return db


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.collect()), key=key)
    assert got
    if name not in catalog.SQL:
        return
    result = con.execute(catalog.SQL[name])
    assert [d[0] for d in result.description] == df.columns
    want = sorted(result.fetchall(), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) <= 1.000001e-6 for x, y in zip(a, b)), (a, b)
