"""The toxicity network: gradients, held-out accuracy, rows."""

import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from cardspark.llm import queries, toxicity

from .fixtures import documents, empty, frame, same


def corpus(n, seed=0):
    rng = random.Random(seed)
    syllables = ["the", "on", "er", "ti", "re", "and", "shi", "wh"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        w = [word() for _ in range(rng.randrange(20, 300))]
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = "vequ" + rng.choice(syllables) + rng.choice("abcdefgh")
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def plain_logit(p, w, h, sig):
    """One window through both directions and the attention, a word at a time."""
    states = [[], []]
    for k, (d, words) in enumerate((("f", w), ("b", w[::-1]))):
        s = np.zeros(h)
        for x in words:
            a, u = x @ p[f"x{d}"] + p[f"c{d}"], s @ p[f"h{d}"]
            z, r = sig(a[:h] + u[:h]), sig(a[h : 2 * h] + u[h : 2 * h])
            s = (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :]) + z * s
            states[k].append(s)
    both = [np.concatenate(x) for x in zip(states[0], states[1][::-1])]
    if not both:
        return float(p["bias"][0])
    e = np.exp(np.array([x @ p["att"] for x in both]) - max(x @ p["att"] for x in both))
    return float(sum(a * x for a, x in zip(e / e.sum(), both)) @ p["out"] + p["bias"][0])


def test_gradients_are_those_of_differences():
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Tokens(["one two three Vier fünf", None, "a b " * 40])
    doc, at, mask = t.windows()
    y = np.array([1.0, 0.0, 1.0, 0.0, 1.0, 0.0])[: len(doc)]
    keep = np.ones(len(t.word), np.float64)
    net.inputs = lambda t, keep=None: np.concatenate([net.p["word"][t.word], np.add.reduceat(net.p["char"][t.char], t.first, axis=0) / t.length[:, None]], axis=1)
    _, g = net.gradients(t, at, mask, y, keep)
    rng = np.random.default_rng(0)
    for name in net.p:
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-5)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            old = net.p[name].ravel()[i]
            loss = []
            for e in (1e-3, -1e-3):
                net.p[name].ravel()[i] = old + e
                loss.append(net.gradients(t, at, mask, y, keep)[0])
            net.p[name].ravel()[i] = old
            want = (loss[0] - loss[1]) / 2e-3
            assert abs(want - g[name].ravel()[i]) < 1e-4 + 0.02 * abs(want), name


def test_windows_overlap_and_cover():
    t = toxicity.Tokens(["w " * n for n in (0, 1, 31, 32, 33, 48, 49, 500)])
    doc, at, mask = t.windows()
    for d, n in enumerate((0, 1, 31, 32, 33, 48, 49, 500)):
        seen = at[doc == d][mask[doc == d]] - t.cuts[d]
        assert sorted(set(seen.tolist())) == list(range(n))
    assert (doc == 7).sum() == -(-(500 - 32) // 16) + 1


def test_joined_tokens_are_the_same():
    texts = ["one two", None, "", "Drei vier fünf", "a b c " * 50]
    a, b = toxicity.Tokens(texts), toxicity.Tokens.joined(texts, 2)
    for n in ("word", "char", "length", "first", "cuts"):
        assert getattr(a, n).tolist() == getattr(b, n).tolist()


def test_held_out_accuracy(spark):
    rows = corpus(500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 60 and [i for i in got if got[i].held_out] and {i for i in got if got[i].held_out} == set(out)
    y = {i: v for i, _, v in rows}
    assert np.mean([got[i].predicted == y[i] for i in out]) >= 0.9
    assert all(got[i].predicted == int(got[i].score >= 0.3) for i in got)


def test_one_long_text_takes_no_room(spark):
    """A labelled text that is too long to learn from, first in the draw or not, changes nothing for the others."""
    rows = corpus(200)
    frames = [spark.createDataFrame([(i, "long " * 10_000 if i in long else t) for i, t, _ in rows], "doc_id long, text string") for long in (range(0, 200, 40), ())]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    kept = labels.where(~F.col("doc_id").isin(list(range(0, 200, 40))))
    a, b = toxicity.fit(frames[0], labels, size=400_000), toxicity.fit(frames[1], kept, size=400_000)
    assert a is not None and all((a.p[k] == b.p[k]).all() for k in a.p) and (a.scale, a.shift) == (b.scale, b.shift)


def test_scores_are_those_of_a_plain_forward_pass():
    """Each text's score against a network written out word by word, over all windows."""
    net = toxicity.train([t for _, t, _ in corpus(60)], [y for *_, y in corpus(60)], steps=5)
    p, h = net.p, toxicity.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    texts = ["", None, "one", "w1 w2 " * 40, corpus(3)[1][1], corpus(3)[0][1]]
    for text, got in zip(texts, net.scores(texts), strict=True):
        t, best = toxicity.Tokens([text]), -np.inf
        x = [np.concatenate([p["word"][t.word[i]], p["char"][t.char[t.first[i] : t.first[i] + t.length[i]]].mean(axis=0)]) for i in range(len(t.word))]
        for a in range(0, max(1, len(x) - toxicity.SPAN + toxicity.STEP), toxicity.STEP):
            w = x[a : a + toxicity.SPAN]
            best = max(best, plain_logit(p, w, h, sig))
        assert abs(sig(net.scale * best + net.shift) - got) < 1e-4, text


def test_held_out_documents_of_the_given_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.op4_toxicity(spark, d).join(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert docs.count() == 1000
    assert np.mean([r.predicted for r in rows if r.toxic]) >= 0.5 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.05


def test_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = toxicity.judge(frame(spark), labels).collect()
    same([(r.doc_id,) for r in got], [(r[0],) for r in rows])
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.judge(empty(spark), labels).count() == 0
    none = toxicity.judge(frame(spark), labels.where("false")).collect()
    assert len(none) == len(rows) and {r.predicted for r in none} == {0}
