"""Every query of the reference's operators against its SQL."""

import duckdb
import pytest

from cinnabar.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(norm(r[k]) for k in at) for r in data), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
