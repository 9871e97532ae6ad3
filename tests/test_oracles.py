"""Every registered query with an oracle, against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from cardspark.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        path = f"{SF}/{f}" if os.path.isfile(f"{SF}/{f}") else f"{SF}/{f}/*.parquet"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    return c


def rows(names, data):
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
