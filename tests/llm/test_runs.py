"""Runs of words against a quadratic search."""

import hashlib
import random
import re
import zlib

import numpy as np

from cardspark.llm import queries, runs

from .fixtures import documents, empty, frame, same


def brute_runs(s, least):
    """All maximal stretches of each period, those of smallest period kept."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = q
        while i < len(s):
            if s[i] != s[i - q]:
                i += 1
                continue
            a = i
            while i < len(s) and s[i] == s[i - q]:
                i += 1
            start, n = a - q, i - a + q
            if n >= max(least, 2 * q):
                found.setdefault((start, n), q)  # periods rise, so the first is the smallest
    return sorted((a, n, q) for (a, n), q in found.items() if not any(all(s[x] == s[x - p] for x in range(a + p, a + n)) for p in range(1, q)))


def brute(rows, plant=True):
    out = []
    for key, text in rows:
        w = re.findall(r"[^ \t-\r]+", text or "")
        n, h = len(w), zlib.crc32(str(key).encode())
        if plant and key is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        r = sorted(brute_runs(w, 12), key=lambda x: (x[0], x[2]))
        gone = {i for a, m, q in r for i in range(a + q, a + m)}
        best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None,) * 3
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in r)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((key, len(r), *best, 1000 * best[1] // best[2] if r else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_all_runs():
    rng = random.Random(0)
    for k in range(1500):
        n, letters = rng.randrange(0, 60), rng.randrange(1, 5)
        s = [rng.randrange(letters) for _ in range(n)]
        if k % 3 == 0 and n > 4:  # powers of a short word, spoilt in places
            root = s[: rng.randrange(1, n // 2)]
            s = [root[i % len(root)] if rng.random() < 0.97 else 9 for i in range(n)]
        least = rng.choice([2, 4, 12])
        assert sorted(runs.runs(s, least)) == brute_runs(s, least), (s, least)


def test_stretches_hold_all_runs():
    rng = random.Random(1)
    for _ in range(600):
        w = [b"%d" % rng.randrange(40) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 4)):
            if len(w) > 3:
                a = rng.randrange(len(w) - 2)
                root = w[a : a + rng.randrange(1, 12)]
                w[a:a] = root * rng.randrange(1, 6) + root[: rng.randrange(len(root))]
        assert runs.text_runs(w) == sorted(brute_runs(w, 12), key=lambda r: (r[0], r[2]))


def test_squares_are_primitive_and_amortised():
    """Each recoloured segment gives one distance at most, so their number stays near the number of words."""
    rng = random.Random(2)
    s = [rng.randrange(3) for _ in range(40)] * 50
    found = list(runs.squares(s))
    assert all(s[i - d + 1 : i + 1] == s[i - 2 * d + 1 : i - d + 1] for i, d in found)
    assert len(found) < len(s) * np.log2(len(s))


def test_against_brute_force(spark):
    rows = [r for r in documents(n=150) if len(r[1] or "") < 20_000]
    loop = "to be or not to be that is the question "
    rows += [(2000 + i, t, *rows[0][2:]) for i, t in enumerate([loop * 7, "x " * 30, "a b " * 5 + "c " * 12, "Ä b\tÄ b\n" * 3, loop * 2 + "and " + loop, ("p q r s t u v w " * 2 + "z ") * 3])]
    found = runs.periodic_runs(frame(spark, rows))
    assert found.columns == ["doc_id", "runs", "collapsed"]
    same([tuple(r) for r in runs.digests(found).collect()], brute([r[:2] for r in rows], plant=False))


def test_query_on_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()], brute(rows))


def test_long_text(spark):
    text = " ".join(str(i % 977) for i in range(60_000))
    assert [tuple(x) for x in runs.periodic_runs(frame(spark, [(1, text, *[None] * 7)])).first().runs] == [(0, 60_000, 977)]


def test_empty(spark):
    assert runs.periodic_runs(empty(spark)).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    rows = [(None, None, *[None] * 7), (1, "", *[None] * 7), (2, " \n", *[None] * 7)]
    same([tuple(r)[1:] for r in runs.digests(runs.periodic_runs(frame(spark, rows))).collect()], [(0, None, None, None, None, nothing, nothing)] * 3)
