"""The Katz model against a dictionary version, and that its probabilities sum to one."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardspark.llm import katz

from .fixtures import documents, empty, frame, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "</s>"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Brute:
    def __init__(self, rows):
        self.c, self.b, self.ctx = Counter(), Counter(), Counter()
        for i, t in rows:
            if not held(i):
                w = tokens(t)
                self.c.update(w)
                self.b.update(zip(["<s>", *w], w))
                self.ctx.update(["<s>", *w[:-1]])
        self.n = sum(self.c.values())
        of = lambda counts: katz.good_turing([sum(1 for x in counts.values() if x == r) for r in range(1, 8)])
        self.dw, self.dp = of(self.c), of(self.b)
        self.after = defaultdict(dict)
        for (h, w), n in self.b.items():
            self.after[h][w] = n
        self.rest = 1 - sum(self.cut(n, self.dw) for n in self.c.values()) / self.n if self.n else 1.0

    @staticmethod
    def cut(n, d):
        return d[n] if n < len(d) else n - katz.LEAST

    def own(self, w):
        return self.cut(self.c[w], self.dw) / self.n if self.c[w] else self.rest

    def prob(self, h, w):
        if not self.ctx[h]:
            return self.own(w)
        if w in self.after[h]:
            return self.cut(self.after[h][w], self.dp) / self.ctx[h]
        left = sum(n - self.cut(n, self.dp) for n in self.after[h].values()) / self.ctx[h]
        return left / (1 - sum(map(self.own, self.after[h]))) * self.own(w)

    def row(self, i, t):
        w = tokens(t)
        base = sum(math.log10((self.c[x] + 0.1) / (self.n + 0.1 * (len(self.c) + 1))) for x in w)
        return (i, held(i), len(w), sum(self.c[x] > 0 for x in w), self.n, round(base, 6), round(sum(math.log10(self.prob(h, x)) for h, x in zip(["<s>", *w], w)), 6))


def zipf(n=300, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(0, 80)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [2000, 10_000_000])
def test_against_dictionaries(spark, chunk):
    for rows, df in ((zipf(), spark.createDataFrame(zipf(), "doc_id long, text string")), ([r[:2] for r in documents()], frame(spark))):
        want = Brute(rows)
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in katz.score(df, chunk=chunk).collect()]
        same(got, [want.row(*r) for r in rows])


def test_probabilities_sum_to_one():
    model = Brute(zipf())
    assert (model.dw[1:6] < range(1, 6)).all()
    for h in ["<s>", "w1", "w2", *list(model.ctx)[:40], "never seen"]:
        assert abs(sum(model.prob(h, w) for w in model.c) + model.prob(h, "unknown") - 1) < 1e-9


def test_good_turing():
    n = [1e6 / r**2.5 for r in range(1, 7)]
    d = katz.good_turing(n)
    assert abs(sum((r - d[r]) * n[r - 1] for r in range(1, 6)) - n[0]) < 1e-3  # the mass of kinds seen once
    for uneven in ([51146, 14744, 5459, 2720, 2557, 1132], [206637, 32233, 5107, 1903, 2578, 674], [3, 0, 1, 0, 0, 0], [0] * 6, [5, 5, 5, 5, 5, 5]):
        d = katz.good_turing(uneven)
        kept = [d[r] / r for r in range(1, 6)]
        assert d[0] == 0 and all(0 < a < b < 1 for a, b in zip(kept, kept[1:])), uneven
    # by Katz's formula over smoothed counts of counts, not one half off each count
    n = [51146, 14744, 5459, 2720, 2557, 1132]
    slope, level = np.polyfit(np.log(range(1, 7)), np.log(n), 1)
    smooth = {r: math.exp(level) * r**slope for r in range(1, 7)}
    top = 6 * smooth[6] / smooth[1]
    want = [r * ((r + 1) * smooth[r + 1] / (r * smooth[r]) - top) / (1 - top) for r in range(1, 6)]
    assert np.allclose(katz.good_turing(n)[1:6], want) and abs(want[0] - 0.5) > 0.05


def test_without_training_rows(spark):
    rows = [(i, "some words") for i in range(200) if held(i)]
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all((r.train_tokens, r.n_known, r.score, r.base_score) == (0, 0, 0.0, 0.0) for r in got)
    assert katz.score(empty(spark)).count() == 0
