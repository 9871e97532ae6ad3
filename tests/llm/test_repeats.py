"""Repeated strings against counting all windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cardspark.llm import repeats

SCHEMA = "doc_id long, text string, id string, n long, row string, k1 string"


def documents(length, seed=0, n=40):
    rng = random.Random(seed)
    line = lambda k: "".join(rng.choice("abcdeéf \n") for _ in range(k))
    passages = [line(length * f // 10) for f in (9, 11, 15, 30, 60)]
    out = []
    for i in range(n):
        parts = [line(rng.randrange(0, 3 * length))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            parts += [p, line(rng.randrange(0, length))]
        out.append((i, "".join(parts)))
    for i in range(8):  # near copies
        t = list(out[3][1] + passages[3])
        for _ in range(3):
            t[rng.randrange(len(t))] = "#"
        out.append((100 + i, "".join(t)))
    out += [(200, None), (201, ""), (202, "ab" * 2 * length), (203, out[5][1]), (204, out[5][1]), out[6], out[6], (None, out[7][1]), (205, line(length - 1)), (206, "x" * (length + 1)), (207, passages[4] + "!" + passages[4]), (-3, passages[1])]
    few = line(length * 8 // 10)  # a repeat too short to be removed, and no other
    out += [(300 + i, line(length // 2) + few + line(length // 3)) for i in range(3)]
    return [(*r, "en", 1, "h", "k") for r in out]


def brute(rows, length, keep):
    where = defaultdict(list)
    key = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    data = [(r[1] or "").encode() for r in rows]
    for i, d in enumerate(data):
        for s in range(len(d) - length + 1):
            where[d[s : s + length]].append((i, s))
    hit = [np.zeros(len(d), bool) for d in data]
    for at in where.values():
        if keep == "first":
            first = min((key(i), s) for i, s in at)
            at = [(i, s) for i, s in at if (key(i), s) != first]
        elif len(at) == 1:
            continue
        for i, s in at:
            hit[i][s : s + length] = True
    return data, hit


@pytest.mark.parametrize(("length", "short", "group", "keep"), [(60, 45, 8192, "none"), (60, 60, 8192, "first"), (60, 45, 4, "none"), (60, 45, 4, "first"), (60, 45, 12, "none"), (400, 280, 8192, "none")])
def test_against_all_windows(spark, length, short, group, keep):
    rows = documents(length)
    df = spark.createDataFrame(rows, SCHEMA)
    out = repeats.remove_spans(repeats.repeated_spans(df, length, keep, group, short))
    assert out.columns == [*df.columns, "_spans", *["_short"] * (short < length), "_kept"]
    got = out.collect()
    data, hit = brute(rows, length, keep)
    runs = lambda h: int((np.diff(np.concatenate([[0], h.astype(int)])) == 1).sum())
    want = sorted((r[0] is not None, r[0] or 0, len(d), int(h.sum()), runs(h), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~h])).hexdigest()) for r, d, h in zip(rows, data, hit))
    assert sorted((r.doc_id is not None, r.doc_id or 0, len((r.text or "").encode()), sum(x.b - x.a for x in r._spans), len(r._spans), hashlib.sha256(bytes(r._kept)).hexdigest()) for r in got) == want
    if short < length:
        data, hit = brute(rows, short, keep)
        assert sorted((r.doc_id is not None, r.doc_id or 0, sum(x.b - x.a for x in r._short), len(r._short)) for r in got) == sorted((r[0] is not None, r[0] or 0, int(h.sum()), runs(h)) for r, h in zip(rows, hit))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_given_documents(spark, sf):
    """The registered query against all windows of the given texts."""
    from cardspark.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    data, hit = brute(rows, 400, "none")
    want = sorted((r[0], len(d), int(h.sum()), int((np.diff(np.concatenate([[0], h.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~h])).hexdigest()) for r, d, h in zip(rows, data, hit))
    got = queries.op10_repeats(spark, f"/root/testdata/{sf}").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want


def test_factor_arrays_decide(spark, monkeypatch):
    """Every group's runs come from the two arrays: with arrays that know no factor, nothing is removed but whole copies."""
    rows = documents(60)
    group = repeats._group_spans((60,), False)
    seen = []
    real = repeats.previous_factors
    monkeypatch.setattr(repeats, "previous_factors", lambda p, c: seen.append(len(p)) or real(p, c))
    text = [(r[1] or "").encode() for r in rows]
    doc, pos, lo, hi, h = repeats.anchors(text, 60)
    order = np.argsort(h.view(np.int64), kind="stable")
    doc, pos, lo, hi, h = (x[order] for x in (doc, pos, lo, hi, h))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, doc, doc, pos, lo, hi, h.view(np.int64))] + [pa.array([text[d][a : b + 60] for d, a, b in zip(doc, lo, hi)])], names=["k1", "k2", "who", "pos", "lo", "hi", "h", "bytes"])
    found = list(group(iter([batch])))
    assert sum(x.num_rows for x in found) > 100 and len(seen) > 20
    monkeypatch.setattr(repeats, "previous_factors", lambda p, c: np.full(len(p), -1))
    assert not list(group(iter([batch])))


def test_empty(spark):
    assert repeats.repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_previous_factors():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        position, common = rng.permutation(n), rng.integers(-1, 6, n)
        common[0] = -1
        want = []
        for i in range(n):
            best = -1
            for j in range(n):
                if position[j] < position[i]:
                    best = max(best, min(common[min(i, j) + 1 : max(i, j) + 1]))
            want.append(best)
        assert repeats.previous_factors(position, common).tolist() == want
