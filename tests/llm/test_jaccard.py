"""The set similarity join against comparing all pairs."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from cardspark.llm import jaccard, queries, simhash

from .fixtures import documents, empty, frame, same

LIMIT = Fraction(9, 10)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, shingle, limit):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and common * limit.denominator >= limit.numerator * (len(a) + len(sets[j]) - common):
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(least.get(top(i), key), key)
    return [(key, len(sets[i]), least.get(top(i))) for i, (key, _) in enumerate(rows)]


def mixture(seed=3):
    """Texts of all sizes with copies that are changed more and more, so that many pairs lie at the limit."""
    rng = random.Random(seed)
    rows = [r[:2] for r in documents(n=60) if len(r[1] or "") < 20_000]
    key = 5000
    for n in (3, 8, 11, 12, 20, 21, 40, 100, 300, 900):
        for _ in range(3):
            w = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for k in range(12):
                x = list(w)
                for _ in range(rng.randrange(0, 1 + n // 25)):
                    x[rng.randrange(len(x))] = "Changed"
                x = x + [f"more{k}"] * rng.randrange(0, 1 + n // 12)
                rows.append((key, " ".join(x)))
                key += 1
            w = x
    rows += [(None, rows[-1][1] + " end"), (None, rows[-5][1]), (key, rows[-9][1].upper()), rows[-3], (7, rows[-20][1]), (None, "quite alone and without any number"), (None, "quite alone and without any number")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shingle", "similarity", "tile", "group", "few"), [(3, 0.9, 4096, 400_000, 10**6), (3, 0.9, 6, 500, 0), (5, 0.8, 4096, 400_000, 10**6), (1, 0.5, 64, 2000, 0)])
def test_against_all_pairs(spark, monkeypatch, shingle, similarity, tile, group, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rows = mixture()
    df = frame(spark, [(*r, "en", "s", 1, 1, "l", "s", "k") for r in rows]).repartition(5)
    got = jaccard.jaccard_components(df, shingle, similarity, tile, group)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    same([tuple(r) for r in got.collect()], brute(rows, shingle, Fraction(similarity).limit_denominator(1000)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_given_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r) for r in queries.op11_jaccard_join(spark, f"/root/testdata/{sf}").collect()], brute(rows, 3, LIMIT))


def test_pairs_at_the_limit_share_a_tile():
    """Random pairs that just reach the limit agree in a part of their band, and their bits admit them; others mostly don't."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(3000):
        i, d = int(rng.integers(9, 400)), 0
        while i * 10 >= 9 * (i + d + 1):
            d += 1
        some = rng.integers(0, 2**63, i + d, dtype=np.int64).astype(np.uint64)
        k = int(rng.integers(0, d + 1))
        pair = [np.sort(np.concatenate([some[:i], x])) for x in (some[i : i + k], some[i + k :])]
        values, cuts = np.concatenate(pair), np.array([0, len(pair[0]), len(pair[0]) + len(pair[1])])
        keys, at = jaccard.tile_keys(values, cuts, LIMIT)
        bits = jaccard.signatures(values, cuts)
        n = np.diff(cuts)
        assert d == 0 or set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())
        assert jaccard.admitted(n[0], n[1:], bits[0], bits[1:], LIMIT).all()
        far = np.sort(rng.integers(0, 2**63, n[0], dtype=np.int64).astype(np.uint64))
        met += jaccard.admitted(n[0], n[:1], bits[0], jaccard.signatures(far, np.array([0, n[0]])), LIMIT).sum()
    assert met == 0


def test_intersections():
    values, cuts = simhash.shingle_sets(["a b c d e f", "b c d e f g", "x y", ""], 3)
    assert jaccard.intersections(values, cuts)(0, np.array([0, 1, 2])).tolist() == [4, 3, 0]


def test_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0
