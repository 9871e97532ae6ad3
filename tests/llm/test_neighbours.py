"""Neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from cardspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, q long, v string"


def rows_of(n=1500, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[40:90] = x[7]  # a large group of equal vectors
    rows = [(i, x[i].tolist(), 0, 1, "v") for i in range(n)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 0, 1, ""), (n + 20, [0.0] * d, 0, 1, ""), (n + 40, [nan] * d, 0, 1, ""), (n + 60, [inf] + [0.0] * (d - 1), 0, 1, ""), (n + 80, [None] + [1.0] * (d - 1), 0, 1, ""), (None, x[3].tolist(), 0, 1, ""), rows[20], rows[20]]
    return rows, x


def brute(x, ids, q, k):
    s = x.astype(np.float64) @ x[q].astype(np.float64)
    order = sorted((-round(s[i], 12), ids[i]) for i in range(len(ids)) if ids[i] != ids[q])
    return [i for _, i in order[:k]]


def run(spark, rows, k=20, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_recall_and_ties(spark):
    rows, x = rows_of()
    got = run(spark, rows)
    ids = list(range(len(x)))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 21)) and all(i != q for _, i, _ in found)
        for _, i, s in found:
            assert abs(s - float(x[q].astype(np.float64) @ x[i].astype(np.float64))) < 1e-12
        hits += len({i for _, i, _ in found} & set(brute(x, ids, q, 20)))
    assert hits / (20 * len(got)) >= 0.9
    assert [i for _, i, _ in got[40]] == [7, *range(41, 60)]
    assert got == run(spark, rows, block=100)


def test_few_rows_are_all_candidates(spark):
    rows, x = rows_of()
    got = run(spark, rows[:15])
    assert [i for _, i, _ in got[0]] == brute(x[:15], list(range(15)), 0, 20)
    assert run(spark, []) == {} and run(spark, [(0, [1.0, 2.0], 0, 1, "")]) == {}


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 30))
    y = neighbours.rotate(x, 3)
    assert y.shape == (5, 32) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_embeddings(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in df.collect()}
    ids, x = list(rows), np.array(list(rows.values()), np.float64)
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in ids if i % 20 == 0]
    assert set(got) == set(asked)
    hits = sum(len(got[q] & set(brute(x, ids, ids.index(q), 20))) for q in asked)
    print(sf, hits / sum(map(len, got.values())))
    assert hits >= 0.95 * sum(map(len, got.values())) and all(len(v) == min(20, len(ids) - 1) for v in got.values())


def test_doubles_and_lengths(spark):
    """Doubles keep their digits; vectors of another length are searched among themselves."""
    tiny = 2.0**-40
    rows = [(0, [1.0, 1.0]), (1, [1.0, tiny]), (2, [1.0, 0.0]), (3, [1.0, 2 * tiny]), (20, [1.0, 0.0, 0.0]), (21, [5.0, 1.0, 0.0]), (22, [1e300, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 3, 1 + 2 * tiny), (0, 1, 1 + tiny), (0, 2, 1.0), (20, 22, 1e300), (20, 21, 5.0)]


def test_joint_buckets_select():
    """Probes go by the sum of projections, and the share of all vectors that they look at falls as these become more."""
    shares, rng = [], np.random.default_rng(1)
    for n in (1000, 10_000, 100_000):
        x = rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x[:40] @ x.T
        s[np.arange(40), np.arange(40)] = -2
        top = np.argsort(-s, axis=1)[:, :20]
        polytopes, probes = neighbours.fit(x[:40], np.repeat(np.arange(40), 20), x[top.ravel()], n)
        seen = np.zeros((40, n), bool)
        for t in range(neighbours.TABLES):
            at, want = neighbours.codes(x, t, polytopes), neighbours.probed(x[:40], t, polytopes, probes)
            assert all(len(set(w)) == len(w) for w in want.tolist()) and (want[:, 0] == at[:40]).all()
            for i in range(40):
                seen[i] |= np.isin(at, want[i])
        assert np.take_along_axis(seen, top, 1).mean() >= 0.9
        shares.append(seen.mean())
    print(shares)
    assert shares[0] > 1.3 * shares[1] and shares[1] > 1.3 * shares[2] and shares[2] < 0.15


def test_probes_against_all_joint_buckets():
    """The best sums of three polytopes, against all of them listed."""
    x = np.random.default_rng(2).normal(size=(5, 8))
    polytopes = neighbours.layout(10, 8)
    assert polytopes == [4, 4, 2]
    a, b, c = neighbours._sides(x, 3, polytopes)
    sums = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(5, -1)
    got = neighbours.probed(x, 3, polytopes, 100)
    assert all(len(set(row)) == 100 for row in got.tolist())
    assert np.allclose(np.take_along_axis(sums, got, 1), -np.sort(-sums, axis=1)[:, :100])


def test_blocks_give_nothing_under_a_floor():
    """A query's floor from the blocks that came first keeps worse classes of another block in; without one, k + 1 come out."""
    x = np.eye(4)
    a = pa.table({"c": [1, 2, 3, 4], "v": x.tolist(), "codes": [[0]] * 4})
    ask = lambda floor: pa.table({"q": [9], "v": [[4.0, 3.0, 2.0, 1.0]], "codes": [[0]], "floor": [floor]})
    got = lambda floor: sorted(neighbours._block(a, ask(floor), 2).column("c").to_pylist())
    assert got(-np.inf) == [1, 2, 3] and got(3.0) == [1, 2] and got(9.0) == []


def test_each_query_has_a_home_in_each_table(spark):
    """Just one group a table holds a query's best bucket, however many groups its probes are in."""
    x = np.random.default_rng(4).normal(size=(30, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, v array<double>")
    rows = neighbours._hash(df, "q", 3, {16: (neighbours.layout(6, 16), 20, 3)}, search=True).collect()
    assert len(rows) > 3 * 30 and sorted((r.q, r.t) for r in rows if r.home) == [(i, t) for i in range(30) for t in range(3)]
    for r in rows:
        assert r.home == (neighbours.codes(neighbours._unit(x[r.q : r.q + 1]), r.t, neighbours.layout(6, 16))[0] >> 3 == r.g)
