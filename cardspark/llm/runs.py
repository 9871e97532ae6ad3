"""Periodic runs of words: a suffix automaton with link-cut access.

The states of the automaton of a text's words stand for the strings that end at the same places; suffix links make them a
tree, in which the path from a prefix's state to the root holds all its suffixes. Appending a word is an access: the path
of the new prefix is recoloured with its end, and what it is recoloured from are segments whose strings all ended last at one
earlier place. If that place is no farther away than the segment's longest string is long, a square ends here: its period is
the distance. A period found so is primitive, and each square of smallest period is found when its last word is appended; it is
extended to a run as far as the period lasts. The automaton is built before the accesses, so the tree stands still: the
preferred paths of the link-cut tree are kept as stacks of coloured segments on heavy paths, and need no rotations.

Only stretches that can hold a run go into an automaton: a run of 12 words or more, and of two periods or more, lies under
windows of 6 words that recur within it, so a stretch without any such windows is left out beforehand.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import let, words

LEAST = 12  # words of a run, at least
WINDOW = LEAST // 2  # of a run the part that recurs is half of it, at least


def automaton(s: list[int]) -> tuple[array, array, array]:
    """The suffix automaton of a sequence: longest length and suffix link of each state, and each prefix's state."""
    length, link, code, to = (array("i", [x]) for x in (0, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}  # arcs of a state beside its first
    where = array("i")
    last = 0
    for n, c in enumerate(s, 1):
        new = len(length)
        length.append(n)
        link.append(0)
        code.append(-1)
        to.append(-1)
        p = last
        q = -1
        while p >= 0:
            if code[p] == c:
                q = to[p]
                break
            if code[p] < 0:
                code[p], to[p] = c, new
            else:
                arcs = more.get(p)
                if arcs is None:
                    more[p] = {c: new}
                elif c in arcs:
                    q = arcs[c]
                    break
                else:
                    arcs[c] = new
            p = link[p]
        if q >= 0:
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                code.append(code[q])
                to.append(to[q])
                if q in more:
                    more[twin] = more[q].copy()
                while p >= 0:
                    if code[p] == c:
                        if to[p] != q:
                            break
                        to[p] = twin
                    else:
                        arcs = more.get(p)
                        if arcs is None or arcs.get(c) != q:
                            break
                        arcs[c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        where.append(new)
    return length, link, where


def heavy_paths(length: array, link: array) -> array:
    """Of each state the first state, from the root, of its heavy path in the tree of suffix links."""
    order = np.argsort(np.frombuffer(length, np.int32), kind="stable").tolist()
    size, heavy, most = array("i", [1]) * len(order), array("i", [-1]) * len(order), array("i", [0]) * len(order)
    for v in reversed(order):
        p = link[v]
        if p >= 0:
            size[p] += size[v]
            if size[v] > most[p]:
                most[p], heavy[p] = size[v], v
    head = array("i", range(len(order)))
    for v in order:
        p = link[v]
        if p >= 0 and heavy[p] == v:
            head[v] = head[p]
    return head


def squares(s: list[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of squares, one at least of each run that ends there, in order of their ends; all periods are primitive."""
    length, link, where = automaton(s)
    head = heavy_paths(length, link)
    segments: dict[int, list[tuple[int, int]]] = {}  # by heavy path: (longest string, last end), the segment nearest to the root last
    for i, v in enumerate(where):
        while v > 0:
            top, size, low = head[v], length[v], 0
            path = segments.get(top)
            if path is None:
                segments[top] = [(size, i)]
            else:
                while path and path[-1][0] <= size:
                    low, end = path.pop()
                    if i - end <= low:
                        yield i, i - end
                if path and low != size and i - path[-1][1] <= size:  # a segment that goes on below
                    yield i, i - path[-1][1]
                path.append((size, i))
            v = link[top]


def runs(s: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence: of smallest period, two periods long and `least`, extended as far as the period lasts."""
    out, known = [], {}  # the last place of the latest run of each period
    for i, d in squares(s):
        if known.get(d, -1) >= i:
            continue
        a, b = i - d, i + 1
        while a >= d and s[a] == s[a - d]:
            a -= 1
        while b < len(s) and s[b] == s[b - d]:
            b += 1
        known[d] = b - 1
        start = a + 1 - d
        if b - start >= max(least, 2 * d):
            out.append((start, b - start, d))
    return out


def stretches(h: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches a..b of words, given by hashes, outside of which no word lies in a run: all is under windows that recur in the stretch."""
    n = len(h) - window + 1
    if n < 2:
        return []
    odd = np.array([rolling._M], np.uint64) ** np.arange(window, dtype=np.uint64)
    key = rolling.mixed(sum((h[k : k + n] * odd[k] for k in range(window)), np.zeros(n, np.uint64)))
    at = np.argsort(key, kind="stable")
    twice = key[at[1:]] == key[at[:-1]]
    if not twice.any():
        return []
    part = np.zeros(n, np.int64)
    left = n
    while True:
        hit = np.zeros(n, bool)
        hit[at[1:][twice]] = hit[at[:-1][twice]] = True
        cover = np.cumsum(np.bincount(np.flatnonzero(hit), minlength=len(h) + 1) - np.bincount(np.flatnonzero(hit) + window, minlength=len(h) + 1)[: len(h) + 1]) > 0
        edge = np.diff(np.concatenate([[False], cover[: len(h)], [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if hit.sum() == left or not len(starts):
            return list(zip(starts.tolist(), ends.tolist()))
        left = hit.sum()
        at = np.flatnonzero(hit)
        part = np.searchsorted(starts, at, side="right")
        order = np.lexsort((at, key[at], part))
        at, part = at[order], part[order]
        twice = (key[at[1:]] == key[at[:-1]]) & (part[1:] == part[:-1])
        if not twice.any():
            return []


def text_runs(w: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of a text's words, by start and period."""
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    out = []
    for a, b in stretches(h, least // 2):
        codes: dict[bytes, int] = {}
        out += [(a + start, n, d) for start, n, d in runs([codes.setdefault(x, len(codes)) for x in w[a:b]], least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by spaces."""
    if not found:
        return b" ".join(w)
    gone = np.zeros(len(w), bool)
    for start, n, d in found:
        gone[start + d : start + n] = True
    return b" ".join(w[i] for i in np.flatnonzero(~gone).tolist())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, runs: array<struct<start, length, period>> of words, by start and period, and collapsed: the
    text's words, joined by spaces, without those that any run holds after its first period. A row per row.

    Words are runs of characters other than ASCII white space; null, empty and blank texts have none, no runs and an empty
    text. Whole texts, one at a time: some 40 bytes a word, and 200 for each word of a stretch that recurs. Repeated rows get
    equal results, no rows give none, other columns are not read.
    """
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found, texts = [], []
                for t in part.column(1):
                    w = (t.as_py() or "").encode().split()
                    r = text_runs(w, least)
                    found.append([dict(zip(("start", "length", "period"), x)) for x in r])
                    texts.append(collapsed(w, r))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text, or, where the crc32 h of the id ends in 0 and it has n words, those words with all from a = h/10 % n on repeating
    the next 1 + (n - a) / (3 + h/10 % 8) of them. Null ids leave the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def of(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    return F.when((h % 10 == 0) & (F.size(words(text)) > 0), let(words(text), of)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Rows of periodic_runs() as doc_id, n_runs, the longest run (ties: smallest start, then period) and digests."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = found.withColumn("_best", F.when(F.size("runs") > 0, best))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    n, q = -F.col("_best.n"), F.col("_best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), n.alias("length"), q.alias("period"), F.expr("-1000 * _best.n div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
