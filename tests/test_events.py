"""Queries over events and streams on tables that the given ones are unlike: times to the microsecond at a window's edge, folders of files."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from cardspark.plans import queries

from .test_oracles import SF, rows


def agrees(spark, folder, name):
    duck = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}" if os.path.isfile(f"{folder}/{f}") else f"{folder}/{f}/*.parquet"
        duck.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}'")
    got = queries.QUERIES[name](spark, str(folder))
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    found, wanted = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, want.fetchall())
    assert found == wanted and wanted


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Rounded to ms, the second of two hits is just within the first one's window, or just out of it; cut to ms, it is the other way round."""
    d, start = tmp_path_factory.mktemp("edges"), datetime(2024, 1, 1)
    gaps = [timedelta(minutes=1), timedelta(hours=1), timedelta(days=1), timedelta(days=8)]
    at = []
    for i in range(9):
        for j, gap in enumerate(gaps):
            for a, b in ((999_600, 999_400), (999_400, 999_600), (500, 499), (499, 500)):
                k = len(at)
                at += [(k * 9 + i, 90 * k + j), (k * 9 + 9 + i, 90 * k + j)]
                at[-2] += (start + timedelta(days=20 * k, microseconds=a),)
                at[-1] += (start + timedelta(days=20 * k, microseconds=b) + gap - timedelta(milliseconds=0 if a > b else 1),)
    for k, (a, b) in enumerate(((999_600, 999_400), (999_400, 999_600), (500, 499), (499, 500))):  # W6: online and active, then two checks offline, some days apart
        e, u, first = 84_000 + 84 * k, 50_000 + k, start + timedelta(microseconds=a)
        at += [(e, u, start), (e + 7, u, first), (e + 14, u, start + timedelta(days=3, microseconds=b))]
    spark.createDataFrame([(e, t, u, "view", 1.0, "{}") for e, u, t in at], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["w1_rate_limit_sliding", "w3_rate_policies", "w6_offline_grace", "st3_stream_rate_limit"])
def test_times_count_as_the_nearest_ms(spark, edges, name):
    agrees(spark, edges, name)


@pytest.mark.parametrize(("table", "name"), [("events", "st3_stream_rate_limit"), ("conversations", "st2_stream_questions"), ("documents", "st6_stream_cards")])
def test_streams_read_tables_that_are_folders(spark, tmp_path, table, name):
    spark.read.parquet(f"{SF}/{table}.parquet").repartition(2).write.parquet(f"{tmp_path}/{table}.parquet")
    agrees(spark, tmp_path, name)
