"""Folds over sorted rows against plain Python."""

import random

import pytest

from cardspark.functions import ordered
from cardspark.operators import cards as C
from cardspark.operators import usage as U


@pytest.mark.parametrize("hot", [10**6, 700, 0])
def test_fixed_windows_of_a_hot_key(spark, hot):
    """By a fold, by doubled jumps, and some keys one way and some the other."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(200_000), i) for i in range(3000)]
    want, open_ = {}, {}
    for k, ms, i in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        a, n = open_.get(k, (None, 0))
        open_[k] = (a, n + 1) if a is not None and ms - a < 1000 else (ms, 1)
        want[i] = open_[k]
    df = spark.createDataFrame(rows, "k long, ms long, id long")
    got = U.rate_limit_fixed(df, 2, 1000, hot=hot).collect()
    assert {r.id: (r.anchor, r.n) for r in got} == want and all(r.allowed == (r.n <= 2) for r in got)
    assert U.rate_limit_fixed(df.where("false"), 2, 1000, hot=hot).count() == 0


def test_a_hot_key_is_cut(spark):
    """The ranges of the order cut a key of nearly all rows, and places and carried values go on over their borders."""
    df = spark.range(20_000).selectExpr("case when id % 100 = 0 then id else 7 end as k", "id * 7919 % 20011 as ms", "case when id % 997 = 0 then id end as v").repartition(8)
    rows = ordered.numbered(df, ["k", "ms"], ranges=8)
    assert rows.where("k = 7").select("part").distinct().count() > 1
    got = rows.orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(20_000)) and [(r.k, r.ms) for r in got] == sorted((r.k, r.ms) for r in got)
    for forward in (True, False):
        carried, want = {r.pos: r.v for r in ordered.filled(rows, "v", forward).collect()}, None
        for r in got if forward else reversed(got):
            want = r.v if r.v is not None else want
            assert carried[r.pos] == want


def test_names_of_a_large_project(spark):
    names = ["A", "a", "a 2", "A", None, "b", "a 3", "a"]
    rows = [("p", i, i, names[i % 8]) for i in range(800)] + [("q", 0, 900, "a")]
    used, want = set(), {900: "a"}
    for _, _, i, name in rows[:-1]:
        got, k = name, 2
        while name is not None and got.lower() in used:
            got, k = f"{name} {k}", k + 1
        used.add(got and got.lower())
        want[i] = got
    df = spark.createDataFrame(rows, "project_id string, place long, card_id long, name string")
    assert {r.card_id: r.filename for r in C.unique_filenames(df).collect()} == want
