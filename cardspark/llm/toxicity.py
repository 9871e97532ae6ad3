"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rolling

SPAN, STEP = 32, 16  # words of a window, and from one window to the next
HIDDEN, DIM = 8, 8
WORD_BITS, CHAR_BITS = 14, 13
SAMPLE = 1500  # labelled documents of each class that are learned from at most
SAMPLE_BYTES = 8_000_000  # of their texts that are learned from at most, in the order of the draw
STEPS, MOST_STEPS = 40, 2000  # of training: in a round at least, and in all
PART = 1_000_000  # bytes scored at once
CUT = 0.3


class Tokens:
    """Words of some texts as numbers: bucket of each word, buckets of each character trigram, and where they belong."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() + b" " for t in texts]
        b = np.frombuffer(b"".join(raw), np.uint8)
        b = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint8)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        b = np.where(space, 32, b).astype(np.uint8)
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        start = np.flatnonzero(edge == -1)
        end = np.flatnonzero(edge == 1)
        self.word = (rolling.slice_hashes(rolling.prefix_sums(b), start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        x = b.astype(np.uint32)
        left, right = np.concatenate([[32], x[:-1]]), np.concatenate([x[1:], [32]])
        tri = ((left << np.uint32(16)) | (x << np.uint32(8)) | right).astype(np.uint64)
        self.char = (rolling.mixed(tri) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)[~space]
        self.first = np.concatenate([[0], np.cumsum(end - start)[:-1]]).astype(np.int64) if len(start) else np.zeros(0, np.int64)
        self.length = (end - start).astype(np.int64)
        bounds = np.cumsum([len(r) for r in raw])
        self.cuts = np.concatenate([[0], np.searchsorted(start, bounds)]).astype(np.int64)

    @classmethod
    def joined(cls, texts: list[str | None], size: int = 100) -> Tokens:
        """As Tokens(texts), made from a few texts at a time, so that byte arrays stay small."""
        parts = [cls(texts[i : i + size]) for i in range(0, len(texts), size)]
        out = cls.__new__(cls)
        out.word, out.char, out.length = (np.concatenate([getattr(p, n) for p in parts]) for n in ("word", "char", "length"))
        out.first = np.cumsum(out.length) - out.length
        ends = np.cumsum([p.cuts[-1] for p in parts])
        out.cuts = np.concatenate([[0], *[p.cuts[1:] + e - p.cuts[-1] for p, e in zip(parts, ends)]]).astype(np.int64)
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word numbers, mask) of all overlapping windows; a document without words has an empty one."""
        n = np.diff(self.cuts)
        m = np.maximum(1, -(-np.maximum(0, n - SPAN) // STEP) + 1)
        doc = np.repeat(np.arange(len(n)), m)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(m) - m, m)
        at = self.cuts[doc][:, None] + k[:, None] * STEP + np.arange(SPAN)
        mask = at < self.cuts[doc + 1][:, None]
        return doc, np.where(mask, at, 0), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        g = lambda *s, scale=0.3: (rng.normal(size=s) * scale).astype(np.float32)
        self.p = {"word": g(1 << WORD_BITS, DIM, scale=0.05), "char": g(1 << CHAR_BITS, DIM), "att": g(2 * HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": g(2 * DIM, 3 * HIDDEN), f"h{d}": g(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, t: Tokens, keep: np.ndarray | None = None) -> np.ndarray:
        """Per word its word vector beside the mean of its character trigrams' vectors; keep: words whose own vector shows."""
        if not len(t.word):
            return np.zeros((1, 2 * DIM), np.float32)
        chars = np.add.reduceat(self.p["char"][t.char], t.first, axis=0) / t.length[:, None].astype(np.float32)
        own = self.p["word"][t.word]
        return np.concatenate([own if keep is None else own * keep[:, None], chars], axis=1).astype(np.float32)

    def _run(self, d: str, xs: np.ndarray, at: np.ndarray, mask: np.ndarray, trace: list | None) -> np.ndarray:
        """Hidden states of one direction, (window, step, hidden)."""
        m, n = at.shape
        h, u = np.zeros((m, HIDDEN), np.float32), self.p[f"h{d}"]
        out = np.zeros((m, n, HIDDEN), np.float32)
        for s in range(n) if d == "f" else range(n - 1, -1, -1):
            x, hu, on = xs[at[:, s]], h @ u, mask[:, s, None]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            new = np.where(on, (1 - z) * c + z * h, h)
            if trace is not None:
                trace.append((s, h, z, r, c, hu[:, 2 * HIDDEN :], on))
            h = new
            out[:, s] = h
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, traces: dict | None = None):
        hs = []
        for d in "fb":
            trace = None if traces is None else traces.setdefault(d, [])
            hs.append(self._run(d, x @ self.p[f"x{d}"] + self.p[f"c{d}"], at, mask, trace))
        h = np.concatenate(hs, axis=2)
        a = np.where(mask, h @ self.p["att"], -1e9)
        a = np.exp(a - a.max(axis=1, keepdims=True)) * mask
        a /= np.maximum(a.sum(axis=1, keepdims=True), 1e-9)
        pooled = (a[:, :, None] * h).sum(axis=1)
        return pooled @ self.p["out"] + self.p["bias"][0], h, a, pooled

    def gradients(self, t: Tokens, at: np.ndarray, mask: np.ndarray, y: np.ndarray, keep: np.ndarray):
        """Loss and gradients of the mean log loss over windows."""
        traces: dict = {}
        x = self.inputs(t, keep)
        logit, h, a, pooled = self.forward(x, at, mask, traces)
        p = _sigmoid(logit)
        loss = -np.mean(np.log(np.where(y > 0, p, 1 - p) + 1e-9))
        dl = ((p - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": dl.sum(keepdims=True)}
        dp = dl[:, None] * self.p["out"]
        da = (h * dp[:, None, :]).sum(axis=2)
        ds = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["att"] = np.einsum("ms,msh->h", ds, h)
        dh_all = a[:, :, None] * dp[:, None, :] + ds[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, own = self.p[f"h{d}"], dh_all[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            du, dh = np.zeros_like(u), np.zeros((len(at), HIDDEN), np.float32)
            dpre = np.zeros((*at.shape, 3 * HIDDEN), np.float32)
            for s, before, z, r, c, hn, on in reversed(traces[d]):
                dh = dh + own[:, s]
                live = dh * on
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (before - c) * z * (1 - z)
                dr = dc * hn * r * (1 - r)
                pre = np.concatenate([dz, dr, dc], axis=1)
                rec = np.concatenate([dz, dr, dc * r], axis=1)
                du += before.T @ rec
                dh = np.where(on, live * z, dh) + rec @ u.T
                dpre[:, s] = pre
            g[f"h{d}"], g[f"c{d}"] = du, dpre.sum(axis=(0, 1))
            flat = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(flat, at[mask], dpre[mask])
            g[f"x{d}"] = x.T @ flat
            dx += flat @ self.p[f"x{d}"].T
        g["word"], g["char"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["char"])
        if len(t.word):
            np.add.at(g["word"], t.word, dx[:, :DIM] * keep[:, None])
            np.add.at(g["char"], t.char, np.repeat(dx[:, DIM:] / t.length[:, None].astype(np.float32), t.length, axis=0))
        return loss, g

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit among each text's windows."""
        t = Tokens(texts)
        doc, at, mask = t.windows()
        x, out = self.inputs(t), np.full(len(texts), -np.inf)
        for i in range(0, len(doc), 8192):
            np.maximum.at(out, doc[i : i + 8192], self.forward(x, at[i : i + 8192], mask[i : i + 8192])[0])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.scale * self.logits(texts) + self.shift).astype(np.float64)


def _take(t: Tokens, at: np.ndarray, mask: np.ndarray) -> tuple[Tokens, np.ndarray]:
    """The words of some windows alone, and the windows renumbered."""
    ids, inverse = np.unique(at[mask], return_inverse=True)
    part = Tokens.__new__(Tokens)
    part.word, part.length = t.word[ids], t.length[ids]
    part.first = np.concatenate([[0], np.cumsum(part.length)[:-1]]).astype(np.int64)
    part.char = t.char[np.repeat(t.first[ids] - part.first, part.length) + np.arange(part.length.sum())]
    new = np.zeros_like(at)
    new[mask] = inverse
    return part, new


def train(texts: list[str], toxic: list[int], steps: int = STEPS, patience: int = 3, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network | None:
    """A network fitted to labelled texts; None if a class is missing.

    A label holds for a text, not for each window: a toxic text teaches by its few windows that look most toxic so far (at
    first by how much likelier their trigrams' documents are toxic), a clean one by those and by random ones. A fifth of the
    texts of each class is held back: rounds of some `steps` steps go on until its loss has not fallen for `patience` rounds,
    and the network with the least is taken. The same texts set the line from logits to scores.
    """
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    t = Tokens.joined(texts)
    doc, at, mask = t.windows()
    back = np.zeros(len(y), bool)
    for c in (0, 1):
        of = rng.permutation(np.flatnonzero(y == c))
        back[of[: len(of) // 5]] = True
    owner = np.repeat(np.arange(len(y)), np.diff(t.cuts))
    df = np.zeros((2, 1 << CHAR_BITS))
    pairs = np.unique(np.repeat(owner, t.length) << CHAR_BITS | t.char)
    pairs = pairs[~back[pairs >> CHAR_BITS]]
    np.add.at(df, (y[pairs >> CHAR_BITS], pairs & (1 << CHAR_BITS) - 1), 1)
    learn = y[~back]
    odds = np.log((df[1] + 1) / (learn.sum() + 2)) - np.log((df[0] + 1) / ((1 - learn).sum() + 2))
    word = np.add.reduceat(odds[t.char], t.first) / np.sqrt(t.length) if len(t.word) else np.zeros(1)
    value = np.where(mask, word[at], -np.inf).max(axis=1)
    net = Network(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, kept, stale = 0, None, 0
    judged = back if back.any() else ~back
    while stale < patience and step < MOST_STEPS:
        order = np.lexsort((-value, doc))
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = order[rank < 2]
        some = rng.permutation(np.flatnonzero((y[doc] == 0) & ~back[doc]))[: len(learn)]
        chosen = np.unique(np.concatenate([top[~back[doc[top]]], some]))
        end = step + max(steps, 2 * -(-len(chosen) // batch))
        while step < end:
            for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // batch)):
                words, places = _take(t, at[part], mask[part])
                _, g = net.gradients(words, places, mask[part], y[doc[part]], (rng.random(len(words.word)) < 0.5).astype(np.float32))
                step += 1
                for k, d in g.items():
                    first[k] = 0.9 * first[k] + 0.1 * d
                    second[k] = 0.99 * second[k] + 0.01 * d * d
                    net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        x = net.inputs(t)
        value = np.concatenate([net.forward(x, at[i : i + 8192], mask[i : i + 8192])[0] for i in range(0, len(doc), 8192)])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, value)
        net.scale, net.shift = _line(best, y)
        loss = _losses(net.scale * best + net.shift, y)
        loss = (loss * judged * np.where(y > 0, 0.5 / (y * judged).sum(), 0.5 / ((1 - y) * judged).sum())).sum()
        if kept is None or loss < kept[0] - 1e-3:
            kept, stale = (loss, {k: v.copy() for k, v in net.p.items()}, best), 0
        else:
            stale += 1
    _, net.p, best = kept
    net.scale, net.shift = _line(best[judged], y[judged])
    return net


def _losses(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.where(y > 0, -z, z))


def _line(best: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The scores of whole texts: a logistic line through the labels, clean texts weighing some six times toxic ones."""
    scale, shift, weight = 1.0, 0.0, np.where(y > 0, 0.15 / y.sum(), 0.85 / (1 - y).sum())
    mean, size = best.mean(), best.std() + 1e-6
    z = (best - mean) / size
    for _ in range(500):
        e = (_sigmoid(scale * z + shift) - y) * weight
        scale, shift = float(scale - 0.5 * ((e * z).sum() + 0.01 * scale)), float(shift - 0.5 * e.sum())
    return scale / size, shift - scale * mean / size


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Network | None:
    """The network of docs(doc_id, text) and labels(doc_id, toxic), from rows whose crc32(doc_id) mod 4 is not 2.

    A seeded draw of at most `sample` documents a class is learned from, whole texts, until they make up `size` bytes: what the
    driver holds is bounded. A text of over a twentieth of that teaches nothing and takes no room from the others.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where(_remainder(F.col("_id")) != 2)
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    draw = lambda y: known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    ids = F.broadcast(draw(1).unionByName(draw(0)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_id"))
    # sizes first: of at most 2 * sample rows, which of them fit
    order = [F.xxhash64("_id"), F.xxhash64("text"), F.col("_id")]
    sizes = rows.select("_id", *[c.alias(f"o{i}") for i, c in enumerate(order[:2])], F.octet_length("text").alias("n")).where(F.col("n") <= size // 20).orderBy("o0", "o1", "_id").limit(2 * sample)
    total = F.sum("n").over(Window.orderBy("o0", "o1", "_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.broadcast(sizes.withColumn("total", total).where(F.col("total") <= size).select("_id", "o1").distinct())
    rows = rows.withColumn("o1", order[1]).join(fits, ["_id", "o1"])
    rows = rows.orderBy(F.xxhash64("_id"), "o1").limit(2 * sample).select("text", "_y").collect()
    return train([r["text"] for r in rows], [r["_y"] for r in rows])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, score: the highest over all overlapping windows of the whole text; a row per row.

    Null and empty texts have one empty window. Without a network all scores are 0. Only the text is looked at: equal texts
    get equal scores; no rows give none.
    """
    if net is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # of a size that the parameters above fix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + PART)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1).to_pylist()))], names=["doc_id", "score"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, toxic) -> doc_id, held_out, score, predicted; a row per row of docs.

    Null and empty texts are scored as an empty window; all windows of a text, of any length, are made at once, with some 40
    bytes a word. Of labels only 0 and 1 of rows with a doc_id count; of several for one doc_id, 1. Without labels of both
    classes all scores are 0. Rows with a null doc_id are held out or not as an empty id is. Equal texts get equal scores, no
    rows give none, other columns are not read.
    """
    rows = score(docs, fit(docs, labels, sample))
    return rows.select("doc_id", (_remainder(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
