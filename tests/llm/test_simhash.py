"""SimHash against brute force."""

import re

import numpy as np
import pytest
import xxhash

from cardspark.llm import simhash

from .fixtures import documents, empty, frame, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, ids, near):
    """Smallest id reachable, over all pairs."""
    root = {f: min((i for i, g in zip(ids, prints) if g == f and i is not None), default=None) for f in prints}
    fs = [f for f in root if root[f] is not None]
    comp = {f: root[f] for f in fs}
    changed = True
    while changed:
        changed = False
        for f in fs:
            for g in fs:
                if (f ^ g).bit_count() <= near and comp[g] > comp[f]:
                    comp[g] = comp[f]
                    changed = True
    return [comp.get(f) for f in prints]


def test_contract(spark):
    rows = documents()
    prints = [fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute(prints, [r[0] for r in rows], 2))]
    got = simhash.near_duplicates(frame(spark))
    same([(r.doc_id, r.f, r.component_id) for r in got.select("doc_id", simhash.hex16(got.f0).alias("f"), "component_id").collect()], want)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("node", [4, 64, 2048])
def test_links_lose_none_and_hot_nodes_split(spark, node):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    f = {int(c) for c in centre}
    for c in centre:
        for _ in range(60):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            f.add(x)
    f = sorted(f)
    df = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(f)], "f0 long, id long")
    edges = simhash.links(df, 2, max(2, node // 16), node)
    got = {r.id: r.root for r in simhash.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(f))] == brute(f, list(range(len(f))), 2)


def test_each_pair_meets_once_on_the_way_down(spark):
    rng = np.random.default_rng(5)
    f = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64) << np.uint64(1)]
    f = sorted({*f, *[x ^ 3 << 61 for x in f], *[x ^ 1 << 63 ^ 1 << 50 for x in f]})
    df = spark.createDataFrame([(0, 0, i, simhash._signed(x)) for i, x in enumerate(f)], "p long, used int, id long, f0 long")
    near = {(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2}
    for cuts in ((5,), (2, 3, 9), (4, 4, 4, 4, 48)):
        rows, depth = df, 0
        for cut in cuts:
            rows, depth = simhash._down(rows, depth, cut, 2), depth + cut
        got = rows.collect()
        homes = {}
        for r in got:
            if r.used == 0:
                assert r.p % (1 << 64) == f[r.id] >> (64 - depth)
                homes.setdefault(r.p, []).append(r.id)
        assert sum(map(len, homes.values())) == len(f)
        met = [(max(r.id, h), min(r.id, h)) for r in got if r.used for h in homes.get(r.p, ())]
        met += [(i, j) for h in homes.values() for i in h for j in h if j < i]
        assert len(met) == len(set(met)) and near <= set(met)


def test_search_prunes_nothing_near():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**63, 300, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ np.uint64(5), f ^ np.uint64(1 << 40)]))
    f = f[np.argsort(simhash._gray_rank(f))]
    q, c = simhash.search(f, 3)
    d = np.bitwise_count(f[:, None] ^ f[None, :])
    assert set(zip(q.tolist(), c.tolist())) == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if d[i, j] <= 3}


def test_sampled_masks_find_similar_pairs(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(500)])
    rows = []
    for i in range(40):
        w = rng.choice(words, 300)
        v = w.copy()
        v[rng.integers(0, 300, 4)] = "edit"  # about 20 of 296 five-word shingles
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 14, 4, 41, 0.8)
    comp = {r.doc_id: r.component_id for r in got.collect()}
    assert sum(comp[2 * i] == comp[2 * i + 1] for i in range(40)) >= 36
    assert len(set(comp.values())) >= 40


def close_pairs(pairs, rng):
    """Pairs of random texts with some words changed, and the Jaccard similarity of their five-word shingles."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for i in range(pairs):
        w = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        v = list(w)
        for k in rng.choice(300, rng.integers(6, 10), replace=False):
            v[k] = "edit"
        a, b = shingles(w), shingles(v)
        yield (2 * i, " ".join(w)), (2 * i + 1, " ".join(v)), len(a & b) / len(a | b)


def test_pairs_just_over_the_similarity_are_found_and_none_under_it(spark):
    made = [x for x in close_pairs(900, np.random.default_rng(4)) if 0.75 <= x[2] < 0.83]
    df = spark.createDataFrame([r for x in made for r in x[:2]], "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 26, 4, 64, 0.8).collect()}
    over = [comp[a[0]] == comp[b[0]] for a, b, j in made if j >= 0.8]
    under = [comp[a[0]] == comp[b[0]] for a, b, j in made if j < 0.8]
    assert len(over) > 100 and len(under) > 100
    assert sum(over) >= 0.98 * len(over) and not any(under)


def test_a_group_over_the_cap_is_compared_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**62, (4, 40))
    sets = [sorted({int(x) for x in np.where(rng.random(40) < 0.08, rng.integers(0, 2**62, 40), base[i % 4])}) for i in range(120)]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sets)], "root long, id long, h array<long>")
    want = list(range(120))
    for _ in range(120):
        for i in range(120):
            for j in range(i):
                if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])):
                    want[i] = want[j] = min(want[i], want[j])
        if all(want[want[i]] == want[i] for i in range(120)):
            break
    for cap in (700, 10**6):
        got = {r.id: r.root for r in simhash.components(simhash.verified(df, 0.8, cap)).collect()}
        assert [got.get(i, i) for i in range(120)] == want


@pytest.mark.parametrize("node", [40, 8192])
def test_hot_nodes_of_sampled_masks_lose_no_pair(spark, node):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**63, (5, 2), dtype=np.uint64)
    f = {tuple(map(int, c)) for c in centre}
    for c in centre:
        for _ in range(60):
            x = [int(v) for v in c]
            for k in (0, 1):
                for b in rng.choice(64, rng.integers(1, 9), replace=False):
                    x[k] ^= 1 << int(b)
            f.add(tuple(x))
    f = sorted(f)
    masks, far = simhash.sampled_masks(4, 2), 18
    df = spark.createDataFrame([(*map(simhash._signed, x), i) for i, x in enumerate(f)], "f0 long, f1 long, id long")
    got = {r.id: r.root for r in simhash.components(simhash.meet(df, 2, 64, far, masks, node)).collect()}
    close = [(i, j) for i in range(len(f)) for j in range(i) if sum((a ^ b).bit_count() for a, b in zip(f[i], f[j])) <= far and any((f[i][k % 2] ^ f[j][k % 2]) & m == 0 for k, m in enumerate(masks))]
    want = list(range(len(f)))
    for _ in f:
        for i, j in close:
            want[i] = want[j] = min(want[i], want[j])
    assert [got.get(i, i) for i in range(len(f))] == want and len(set(want)) >= 5


def test_components_raise_where_they_are_not_settled(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(df).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(df, 1)


def test_visitors_count_in_a_crowded_node(spark):
    """One fingerprint two nodes before a run of very many: its visitors are cut with it, and no link is lost."""
    rng = np.random.default_rng(9)
    base = 0b11 << 62
    many = {base | int(x) for x in rng.integers(0, 1 << 40, 6000, dtype=np.uint64)}
    lone = [(min(many) ^ (1 << 62)), (max(many) ^ (1 << 63) ^ 1)]
    f = [*sorted(many), *(x for x in lone if x not in many)]
    df = spark.createDataFrame([(simhash._signed(x), i) for i, x in enumerate(f)], "f0 long, id long")
    most = 2500  # over the 2,081 that can be within two bits of one
    sizes = [r.n for d in simhash._nodes(df, 2, 512, most) for r in d.selectExpr("size(rows) n").collect()]
    assert sizes and max(sizes) <= most
    edges = [(r.a, r.b) for r in simhash.links(df, 2, 512, most).collect()]
    a = np.array(f, np.uint64)
    want_a, want_b = [], []
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 2) + i + 1
        want_a += [i] * len(near)
        want_b += near.tolist()
    label = lambda x, y: simhash.spanning(len(f), np.array(x, int), np.array(y, int)).tolist()
    assert label(*zip(*edges)) == label(want_a, want_b) and len(want_a) >= 2
