"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table's hash joins the nearest signed axes of several rotations, so that buckets stay small however many vectors there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

TABLES = 8
BUCKET = 4  # vectors of one joint bucket, about
RECALL = 0.97  # of the sampled queries' nearest vectors, that the number of probes is fitted to
SAMPLE = 128  # queries, of each length of vectors, that it is fitted on
LENGTHS = 16  # lengths of vectors that are fitted, the commonest first; vectors of other lengths share one bucket
MOST_PROBES = 2048  # joint buckets of a table that a query looks at; where it takes more, buckets are made larger
BLOCK = 4096  # vectors, and queries, of one group of buckets that meet in one task
SEED = 11
NEAR = 1e-9  # block scores this near to the k-th may be it


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, t: int, seed: int = SEED) -> np.ndarray:
    """The t-th pseudo-rotation: three rounds of seeded signs and a transform, rows padded to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng([seed, t, d])
    for _ in range(3):
        y = hadamard(y * signs.choice([-1.0, 1.0], d))
    return y


def layout(bits: int, width: int) -> list[int]:
    """Polytopes whose joint buckets are told apart by so many bits: whole ones, and one of fewer axes for what is left."""
    whole = 1 + max(0, width - 1).bit_length()
    return [whole] * (bits // whole) + [bits % whole] * (bits % whole > 0)


def _sides(x: np.ndarray, t: int, polytopes: list[int]) -> list[np.ndarray]:
    """Of each polytope of table t the projections of the rows on its signed axes."""
    out = []
    for j, bits in enumerate(polytopes):
        y = rotate(x, 64 * t + j)[:, : 1 << (bits - 1)]
        out.append(np.concatenate([y, -y], axis=1))
    return out


def codes(x: np.ndarray, t: int, polytopes: list[int]) -> np.ndarray:
    """The joint bucket of each row in table t: its nearest signed axis of every polytope."""
    code = np.zeros(len(x), np.int64)
    for bits, side in zip(polytopes, _sides(x, t, polytopes), strict=True):
        code = (code << bits) | side.argmax(axis=1)
    return code


def probed(x: np.ndarray, t: int, polytopes: list[int], probes: int) -> np.ndarray:
    """Per row the `probes` joint buckets of table t whose axes' projections have the largest sums, best first."""
    code, score = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for bits, side in zip(polytopes, _sides(x, t, polytopes), strict=True):
        best = np.argsort(-side, axis=1, kind="stable")[:, :probes]
        # of two descending lists, the i-th with the j-th is among the first n sums only if (i + 1)(j + 1) <= n
        i, j = np.nonzero(np.outer(np.arange(1, code.shape[1] + 1), np.arange(1, best.shape[1] + 1)) <= probes)
        sums = score[:, i] + np.take_along_axis(side, best, 1)[:, j]
        first = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        score = np.take_along_axis(sums, first, 1)
        code = np.take_along_axis((code[:, i] << bits) | best[:, j], first, 1)
    return code


def fit(asked: np.ndarray, of: np.ndarray, found: np.ndarray, rows: int, tables: int = TABLES, bucket: int = BUCKET, recall: float = RECALL) -> tuple[list[int], int]:
    """Polytopes and probes of a table by which asked[of[i]] meets found[i], for a share of `recall` of all i.

    Buckets are as many as leave some `bucket` of the rows in each; where MOST_PROBES of them do not suffice, half as many.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / bucket)))
    while bits and len(of):
        polytopes = layout(bits, asked.shape[1])
        rank = np.full(len(of), MOST_PROBES)
        for t in range(tables):
            hit = probed(asked, t, polytopes, MOST_PROBES)[of] == codes(found, t, polytopes)[:, None]
            rank = np.minimum(rank, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
        need = int(np.sort(rank)[math.ceil(recall * len(rank)) - 1])
        if need < MOST_PROBES:
            return polytopes, need + 1
        bits -= 1
    return [], 1


def _matrix(col) -> np.ndarray:
    """A list column without nulls, rows of one length, in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash(df: DataFrame, key: str, tables: int, plan: dict[int, tuple[list[int], int, int]], search: bool) -> DataFrame:
    """df(key, v) -> key, v, n, t, g, codes, home: a row per table and group of joint buckets that the vector is in, or probes; home: the group of the best bucket."""

    def run(batches):
        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(n).tolist():
                polytopes, probes, inner = plan.get(size, ([], 1, 0))
                probes = probes if search else 1
                rows = batch.filter(pa.array(n == size))
                step = max(1, min(2048, 500_000 // (probes * tables)))
                for i in range(0, rows.num_rows, step):
                    part = rows.slice(i, step)
                    x = _unit(_matrix(part.column(1)))
                    found = np.stack([probed(x, t, polytopes, probes) if search else codes(x, t, polytopes)[:, None] for t in range(tables)], axis=1)
                    best = found[:, :, 0] >> inner
                    found = np.sort(found, axis=2)
                    r, t, _ = np.indices(found.shape)
                    r, t, code = r.ravel(), t.ravel(), found.ravel()
                    g = code >> inner
                    cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1]) | (g[1:] != g[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(code)).astype(np.int32)), pa.array(code))
                    at = pa.array(r[cut])
                    own = [part.column(0).take(at), part.column(1).take(at)]
                    for j in range(0, len(cut), 4096):
                        yield pa.RecordBatch.from_arrays(
                            [c.slice(j, 4096) for c in [*own, pa.array(np.full(len(cut), size, np.int32)), pa.array(t[cut].astype(np.int32)), pa.array(g[cut]), lists, pa.array(g[cut] == best[r[cut], t[cut]])]],
                            names=[key, "v", "n", "t", "g", "codes", "home"],
                        )

    return df.select(key, "v").mapInArrow(run, f"{key} bigint, v array<double>, n int, t int, g bigint, codes array<bigint>, home boolean")


def _exact(classes: DataFrame, asked: dict[int, np.ndarray], k: int) -> DataFrame:
    """n, i, v: the k + 1 classes nearest to the i-th of the few asked vectors of length n, against all rows."""

    def run(batches):
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            n = pc.list_value_length(batch.column(0)).to_numpy()
            for size in set(np.unique(n).tolist()) & set(asked):
                x = _matrix(batch.filter(pa.array(n == size)).column(0))
                for i, s in enumerate(asked[size] @ x.T):
                    top = np.argsort(-s, kind="stable")[: k + 1]
                    rows = best.get((size, i), []) + [(float(s[j]), x[j]) for j in top]
                    best[size, i] = sorted(rows, key=lambda r: -r[0])[: k + 1]
        for (size, i), rows in best.items():
            cols = pa.array([size] * len(rows), pa.int32()), pa.array([i] * len(rows), pa.int32()), pa.array([s for s, _ in rows]), pa.array([v.tolist() for _, v in rows])
            yield pa.RecordBatch.from_arrays(list(cols), names=["n", "i", "s", "v"])

    order = Window.partitionBy("n", "i").orderBy(F.desc("s"), "v")
    rows = classes.select("v").mapInArrow(run, "n int, i int, s double, v array<double>")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("n", "i", "v")


def _plan(classes: DataFrame, asked: DataFrame, k: int, tables: int, bucket: int, recall: float, block: int) -> dict[int, tuple[list[int], int, int]]:
    """Of the commonest lengths of vectors: polytopes, probes, and the bits of a joint bucket that tell it apart within its group."""
    common = {r.n: r.rows for r in classes.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(LENGTHS).collect()}
    some = Window.partitionBy("n").orderBy(F.xxhash64("q"), "q")
    drawn = asked.select("q", "v", F.size("v").alias("n")).where(F.col("n").isin(list(common))).withColumn("r", F.row_number().over(some)).where(F.col("r") <= SAMPLE)
    sample: dict[int, list] = {}
    for r in drawn.orderBy("n", "r").collect():
        sample.setdefault(r.n, []).append(r.v)
    vectors = {n: np.array(v, np.float64) for n, v in sample.items()}
    near: dict[int, list] = {}
    for r in _exact(classes, vectors, k).collect() if vectors else []:
        if r.v != sample[r.n][r.i]:
            near.setdefault(r.n, []).append((r.i, r.v))
    plan = {}
    for n, found in near.items():
        of, v = np.array([i for i, _ in found]), np.array([v for _, v in found], np.float64)
        polytopes, probes = fit(_unit(vectors[n]), of, _unit(v), common[n], tables, bucket, recall)
        plan[n] = polytopes, probes, max(0, sum(polytopes) - max(0, math.floor(math.log2(common[n] / block))))
    return plan


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, bucket: int = BUCKET, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vectors(vec_id, embedding, ...), queries(vec_id, embedding, ...) -> query_id, rank, vec_id, score.

    Each query's k nearest found, by largest inner product of the original vectors in double precision, its own vec_id left
    out; ties to the smaller vec_id. Vectors null, zero, or with null or non-finite components take no part; vectors of
    another length are no candidates of a query. Equal vectors are one class that keeps its k + 1 smallest ids, all that a
    result can show, so a vector that a third of the rows share costs one candidate. Repeated rows are one. A table's hash is
    the nearest signed axis of several polytopes, as many as leave some `bucket` vectors in a joint bucket; every vector is in
    every table, and a query probes joint buckets by the sum of its projections on their axes. How many is fitted: a seeded
    draw of at most SAMPLE queries is searched against all rows, and the probes are the fewest by which a share of `recall` of
    their nearest is met. Neighbouring buckets make a group, which is cut into blocks; each block of queries meets each block
    of vectors, so no task depends on a bucket's size; no candidate is dropped. The groups of the queries' best buckets come first: their
    (k + 1)-th best is a floor for what the blocks of all other groups give out, which else gave k + 1 a block. If a query's buckets hold fewer than k others,
    all rows are its candidates. Scores by blocks only choose; whatever comes near the k-th is scored again, component by
    component, so results agree between runs. Empty tables give no rows.
    """
    ok = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    few = Window.partitionBy("v").orderBy("vec_id")
    smallest = ok(vectors).distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    classes = stash(smallest.groupBy("v").agg(F.min("vec_id").alias("c"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = stash(ok(queries).distinct().withColumnRenamed("vec_id", "q"))
    plan = _plan(classes, asked, k, tables, bucket, recall, block)
    index, probe = _hash(classes, "c", tables, plan, search=False), _hash(asked, "q", tables, plan, search=True)
    at = ["n", "t", "g"]
    parts = lambda df, name: df.groupBy(*at).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    cuts = stash(parts(index, "ni").join(parts(probe, "np"), at))
    one = lambda df, key, own, other, mine, theirs, *more: df.join(cuts, at).select(
        key, "v", "codes", *more, *at, F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs)
    )
    left, right = one(index, "c", "ni", "np", "bi", "bp"), one(probe, "q", "np", "ni", "bp", "bi", "home")
    keys = [*at, "bi", "bp"]
    meet = lambda rows: left.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(lambda a, b: _block(a, b, k), "q bigint, c bigint, score double")
    one_each = lambda df: df.groupBy("q", "c").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    first = stash(one_each(meet(right.where("home").drop("home").withColumn("floor", F.lit(float("-inf"))))))
    floors = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k + 1).select("q", F.col("score").alias("floor"))
    far = right.where("not home").drop("home").join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    pairs = one_each(first.unionByName(meet(far)))
    limit = F.nth_value("score", k + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    top = pairs.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("score") >= F.col("limit") - NEAR * (1 + F.abs("limit"))))
    return _ranked(stash(top.select("q", "c")), classes, asked, k)


def _block(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    """The k + 1 best classes of each query of a block, of those in the buckets that it probes, and those that come near; none under the query's floor."""
    none = pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not len(a) or not len(b):
        return none
    ids, of = a.column("c").to_numpy(), a.column("codes").combine_chunks().flatten().to_numpy()
    order = np.lexsort((ids, of))
    ids, x = ids[order], _matrix(a.column("v"))[order]
    buckets, first = np.unique(of[order], return_index=True)
    last = np.append(first[1:], len(ids))
    q, y, floor = b.column("q").to_numpy(), _matrix(b.column("v")), b.column("floor").to_numpy()
    asks = b.column("codes").combine_chunks()
    who, wants = np.repeat(np.arange(len(q)), pc.list_value_length(asks).to_numpy()), asks.flatten().to_numpy()
    at = np.minimum(np.searchsorted(buckets, wants), len(buckets) - 1)
    who, at = who[buckets[at] == wants], at[buckets[at] == wants]
    m = min(k + 1, len(ids))
    out = []
    for i in range(0, len(q), 512):
        s = np.full((min(512, len(q) - i), len(ids)), -np.inf)
        here = (who >= i) & (who < i + 512)
        rows, to = who[here] - i, at[here]
        rows, to = rows[np.argsort(to, kind="stable")], np.sort(to)
        met, start = np.unique(to, return_index=True)
        for u, some in zip(met.tolist(), np.split(rows, start[1:]), strict=False):
            s[some, first[u] : last[u]] = y[i + some] @ x[first[u] : last[u]].T
        limit = np.maximum(np.partition(s, len(ids) - m, axis=1)[:, len(ids) - m], floor[i : i + 512])
        least = np.where(limit > -np.inf, limit - NEAR * (1 + np.abs(limit)), limit)
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        out.append((q[i : i + 512][r], ids[c], s[r, c]))
    return pa.table({n: np.concatenate([o[j] for o in out]) for j, n in enumerate(("q", "c", "score"))})


def _ranked(found: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Classes to ids with their scores, the query's own left out; queries with too few candidates get all rows."""
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    wide = classes.select("c", F.col("v").alias("w"), "ids")
    rows = found.join(wide, "c").join(asked.select("q", "v"), "q").select("q", dot.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> q")
    enough = rows.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("q")
    short = stash(asked.join(enough, "q", "left_anti"))
    if not short.isEmpty():
        parts = 64  # each such query meets all rows in so many blocks
        dealt = wide.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts)))
        rest = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).join(dealt, ["part"]).where(F.size("v") == F.size("w"))
        rows = rows.join(enough, "q").unionByName(rest.select("q", dot.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> q"))
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")
