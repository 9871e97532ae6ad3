"""Suffix-array dedup: longest-previous-factor arrays over anchored suffixes.

Spark deals the suffixes out by anchors: of every window of `short` bytes the position of its smallest k-gram hash. Equal
windows have equal k-grams there, so a repeat always shows among the suffixes of one anchor. In a task, the suffixes that
start at an anchor are sorted; those that start s bytes before it follow by sorting one byte further at a time, as suffix
arrays are induced. Each step gives the order of those suffixes and the common prefixes of neighbours; from the previous and
next smaller positions in that order come the longest previous factor of each suffix and, mirrored, the longest next one. A
string that starts at a suffix is a repeat if one of the two is as long as it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import stash

LENGTH = 400
SHORT = 280  # bytes of shorter repeats that are reported, not removed: some 50 words
GRAM = 32
GROUP = 20_000  # different contexts of one anchor whose suffixes meet in one task
BUNDLE = 8_000  # suffixes sorted at once
PART = 1_000_000  # bytes looked at at once


def anchors(text: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document number, position, first window, last window, hash) of each anchor; positions count within the document."""
    sizes = np.array([len(t) for t in text], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(text), np.uint8)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    n, w = len(data) - gram + 1, length - gram + 1
    if n < w:
        return none
    sums = rolling.prefix_sums(data)
    at = np.arange(n)
    h = rolling.slice_hashes(sums, at, at + gram)
    key = (h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    pad = -n % w
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - w + 1)
    doc = np.repeat(np.arange(len(text)), sizes)[: len(start)]
    inside = start + length <= ends[doc]
    start, doc = start[inside], doc[inside]
    if not len(start):
        return none
    pos = (np.minimum(down[start], up[start + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    begin = (ends - sizes)[doc[first]]
    return doc[first], pos[first] - begin, start[first] - begin, start[last] - begin, h[pos[first]]


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi], both ends included."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
        step *= 2
    j = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), values.dtype)
    for level in np.unique(j):
        m = j == level
        out[m] = np.minimum(levels[level][lo[m]], levels[level][hi[m] - (1 << level) + 1])
    return out


def previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors: of each suffix, in suffix order, the longest common prefix with one at a smaller position.

    common[i] is the common prefix with the suffix before, -1 at the start of a class. Previous and next smaller positions
    are found by jumping: a neighbour at a larger position hands over to its own neighbour.
    """
    n = len(position)
    best = np.full(n, -1, np.int64)
    for p, c in ((position, common), (position[::-1], np.concatenate([[-1], common[:0:-1]]))):
        link, depth = np.arange(n) - 1, c.astype(np.int64)
        while True:
            far = np.flatnonzero((depth >= 0) & (p[np.maximum(link, 0)] >= p))
            far = far[link[far] >= 0]
            if not len(far):
                break
            depth[far], link[far] = np.minimum(depth[far], depth[link[far]]), link[link[far]]
        found = np.where(link >= 0, depth, -1)
        best = np.maximum(best, found if p is position else found[::-1])
    return best


def covered(group, right, right_n, left, left_n, least, position, lengths: tuple[int, ...], keep_first: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, of each anchored suffix the fewest and most bytes before the anchor at which a repeat of that length starts; -1: none.

    right, left: matrices of the bytes from the anchor on, and before it (nearest first), with the numbers that count.
    Windows start least..left_n bytes before the anchor. keep_first: only windows that occur at a smaller position too.
    """
    n, short = len(group), min(lengths)
    out = [(np.full(n, -1, np.int64), np.full(n, -1, np.int64)) for _ in lengths]
    keys = np.concatenate([np.asarray(group, ">u4").view(np.uint8).reshape(n, 4), right], axis=1)
    idx = np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")
    other = right[idx[1:]] != right[idx[:-1]]
    lcp = np.where(other.any(axis=1), other.argmax(axis=1), right.shape[1])
    lcp = np.minimum(np.minimum(lcp, right_n[idx[1:]]), right_n[idx[:-1]])
    lcp = np.concatenate([[-1], np.where(group[idx[1:]] == group[idx[:-1]], lcp, -1)]).astype(np.int64)
    for s in range(left.shape[1] + 1):
        near = np.maximum(lcp, np.concatenate([lcp[1:], [-1]]))
        stay = (left_n[idx] >= s) & (near + left_n[idx] >= short)
        if not stay.all():
            k = np.flatnonzero(stay)
            if len(k) < 2:
                break
            lcp = np.concatenate([[-1], np.minimum.reduceat(lcp, k[:-1] + 1)[: len(k) - 1] if k[-1] == len(lcp) - 1 else np.minimum.reduceat(lcp[: k[-1] + 1], k[:-1] + 1)])
            idx = idx[k]
        if s:
            byte = left[idx, s - 1]
            if ((byte[1:] != byte[:-1]) & (lcp[1:] >= 0)).any():
                key = np.cumsum(lcp < 0) * 256 + byte
                order = np.argsort(key, kind="stable")
                same = key[order[1:]] == key[order[:-1]]
                new = np.full(len(order), -1, np.int64)
                a, b = order[:-1][same] + 1, order[1:][same]
                new[1:][same] = _range_min(lcp, a, b)
                idx, lcp = idx[order], new
        if lcp.max() + s < short:
            continue
        factor = previous_factors(position[idx], lcp)
        if not keep_first:
            factor = np.maximum(factor, previous_factors(-position[idx], lcp))
        for (low, high), length in zip(out, lengths):
            who = idx[(factor + s >= length) & (least[idx] <= s)]
            low[who] = np.where(low[who] < 0, s, low[who])
            high[who] = s
    return out


def _contexts(length: int):
    """Rows (k1, k2, text, marks) -> one row per anchor with the bytes around it that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, who, text, marks = (c[i] for c in batch.columns)
                data = text.as_py()
                m = marks.values
                pos, lo, hi, h, n = (m.field(f).to_numpy() for f in ("pos", "lo", "hi", "h", "n"))
                for j in range(0, len(pos), 4096):
                    cut = slice(j, j + 4096)
                    bytes_ = [data[a : b + length] for a, b in zip(lo[cut].tolist(), hi[cut].tolist())]
                    rep = lambda x, t: pa.array(np.full(len(bytes_), x), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [rep(k1.as_py(), pa.int64()), rep(k2.as_py(), pa.int64()), rep(who.as_py(), pa.int64()), pa.array(pos[cut]), pa.array(lo[cut]), pa.array(hi[cut]), pa.array(h[cut]), pa.array(n[cut]), pa.array(bytes_, pa.binary())],
                        names=["k1", "k2", "who", "pos", "lo", "hi", "h", "n", "bytes"],
                    )

    return run


def _group_spans(lengths: tuple[int, ...], keep_first: bool):
    """Rows sorted by anchor -> (k1, k2, size, start, end): runs of repeats of `size` bytes or more."""
    short, length = min(lengths), max(lengths)

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        k1, k2, who, pos, lo, hi, h = (t.column(c).to_numpy() for c in ("k1", "k2", "who", "pos", "lo", "hi", "h"))
        # a document's row may be there more than once
        _, one = np.unique(np.stack([h, k1, k2, pos.astype(np.int64)]), axis=1, return_index=True)
        one.sort()
        k1, k2, who, pos, lo, hi, h = (x[one] for x in (k1, k2, who, pos, lo, hi, h))
        bytes_ = t.column("bytes").take(pa.array(one)).to_pylist()
        before = pos - lo
        right, left = np.zeros((len(one), length), np.uint8), np.zeros((len(one), short - GRAM), np.uint8)
        for i, (x, b) in enumerate(zip(bytes_, before.tolist())):
            a = np.frombuffer(x, np.uint8)
            right[i, : len(a) - b] = a[b:]
            left[i, :b] = a[:b][::-1]
        position = np.empty(len(one), np.int64)
        position[np.lexsort((pos, k2, k1, who))] = np.arange(len(one))
        after = np.array([len(x) for x in bytes_], np.int64) - before
        found = covered(np.unique(h, return_inverse=True)[1], right, after, left, before.astype(np.int64), (pos - hi).astype(np.int64), position, lengths, keep_first)
        parts = []
        for size, (low, high) in zip(lengths, found):
            hit = np.flatnonzero(high >= 0)
            parts.append((k1[hit], k2[hit], np.full(len(hit), size), pos[hit] - high[hit], pos[hit] - low[hit] + size))
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k1", "k2", "size", "a", "b"]) if len(columns[0]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < BUNDLE:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if end and (out := solve(t.slice(0, end))) is not None:
                yield out
            held, n = t.slice(end).combine_chunks().to_batches(), len(h) - end
        if held and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _windows(lengths: tuple[int, ...]):
    """Contexts -> one row per window: its size, its offset to the anchor and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                k1, k2, who, pos, lo, hi, h, x = (c[i].as_py() for c in batch.columns)
                data = np.frombuffer(x, np.uint8)
                sums, turned = rolling.prefix_sums(data), rolling.prefix_sums(data ^ np.uint8(0x5A))
                for size in lengths:
                    at = np.arange(min(hi - lo, len(x) - size) + 1)
                    n = len(at)
                    rep = lambda v: pa.array(np.full(n, v, np.int64))  # noqa: B023, E731
                    hashes = [pa.array(rolling.slice_hashes(y, at, at + size).view(np.int64)) for y in (sums, turned)]
                    yield pa.RecordBatch.from_arrays([rep(h), rep(size), pa.array((at + lo - pos).astype(np.int64)), *hashes, rep(k1), rep(k2), pa.array((at + lo).astype(np.int64)), rep(who)], names=["h", "size", "off", "w1", "w2", "k1", "k2", "s", "who"])

    return run


_RUNS = "k1 bigint, k2 bigint, size bigint, a bigint, b bigint"
_CONTEXT = ["k1", "k2", "who", "pos", "lo", "hi", "h", "bytes"]


def _runs(around: DataFrame, lengths: tuple[int, ...], first: bool, group: int) -> DataFrame:
    """Contexts (k1, k2, who, pos, lo, hi, h, n, bytes) of shared anchors -> runs of repeats (k1, k2, size, a, b)."""
    solve = lambda df: df.select(*_CONTEXT).repartition("h").sortWithinPartitions("h").mapInArrow(_group_spans(lengths, first), _RUNS)
    # an anchor that many contexts share: equal contexts are one, all of which but perhaps the first is a repeat
    crowded = around.where(F.col("n") > group)
    crowded = crowded.select("*", *[F.xxhash64(F.lit(k), F.col("pos") - F.col("lo"), "bytes").alias(f"c{k}") for k in (1, 2)])
    key = ["h", "c1", "c2"]
    here = F.struct("who", "k1", "k2", "pos")
    alike = stash(crowded.groupBy(*key).agg(F.count("*").alias("m"), F.min(here).alias("first")))
    if alike.isEmpty():
        return solve(around)
    sizes = stash(alike.groupBy("h").agg(F.count("*").alias("d")))
    whole = crowded.join(alike.where("m > 1"), key).where(here != F.col("first") if first else F.lit(True))
    whole = whole.select("k1", "k2", F.col("lo").cast("long").alias("a"), (F.col("lo") + F.octet_length("bytes")).cast("long").alias("b"), F.explode(F.array(*[F.lit(x).cast("long") for x in lengths])).alias("size"))
    runs = whole.where("b - a >= size").select("k1", "k2", "size", "a", "b")
    ones = crowded.join(alike, key).where(here == F.col("first")).join(sizes, "h")
    few = around.where(F.col("n") <= group).select(*_CONTEXT).unionByName(ones.where(F.col("d") <= group).select(*_CONTEXT))
    runs = runs.unionByName(solve(few))
    # an anchor of still more different contexts, as around a passage that very many texts share: windows are told apart by
    # 128 bits and counted before they move; those of a kind have a factor as long as they are
    windows = ones.where(F.col("d") > group).select(*_CONTEXT).mapInArrow(_windows(lengths), "h bigint, size bigint, off bigint, w1 bigint, w2 bigint, k1 bigint, k2 bigint, s bigint, who bigint")
    kind, spot = ["h", "size", "off", "w1", "w2"], F.struct("who", "k1", "k2", "s")
    counted = stash(windows.groupBy(*kind).agg(F.count("*").alias("m"), F.min(spot).alias("first")).where("m > 1"))
    again = windows.join(counted, kind).where(spot != F.col("first") if first else F.lit(True))
    return runs.unionByName(again.select("k1", "k2", "size", F.col("s").alias("a"), (F.col("s") + F.col("size")).alias("b")))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", group: int = GROUP, short: int | None = None) -> DataFrame:
    """All columns of docs(doc_id, text, ...) plus `_spans`: removed runs array<struct<a,b>> of byte offsets, merged, in order;
    and, with `short`, `_short`: the same for repeats of that many bytes, fewer than `length`.

    Texts count as UTF-8 bytes. keep "none": each byte of a string of `length` bytes that starts anywhere else too, in the
    same document or another; "first": only later copies, where documents stand in order of doc_id (null first) and rows
    with equal doc_id and text are one. Null, empty and short texts have no runs; equal rows get equal runs; no rows give
    none; other columns pass through, whatever their names but those two. Documents with equal texts are one class before
    any search, so a large group of copies costs one text; so are equal contexts of an anchor that over `group` share.
    A text is looked at with some 100 bytes of working memory a byte.
    """
    short = length if short is None else short
    lengths = (length,) if short == length else (length, short)
    base = docs.select(F.struct(*docs.columns).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    slim = base.select("k1", "k2", "id", F.octet_length("text").cast("long").alias("n"))
    classes = slim.groupBy("k1", "k2").agg(F.min("id").alias("who"), F.count("*").alias("copies"), F.max("n").alias("n"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = 0
            sizes = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(), dtype=np.int64)
            while i < batch.num_rows:
                done = sizes[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(sizes, done + PART)))
                text = batch.column(2).slice(i, j - i).to_pylist()
                doc, pos, lo, hi, h = anchors(text, short)
                k1, k2 = (batch.column(c).to_numpy()[i:j][doc] for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), *[pa.array(x.astype(np.int32)) for x in (pos, lo, hi)], pa.array(h.view(np.int64))], names=["k1", "k2", "pos", "lo", "hi", "h"])
                i = j

    long_ = base.where(F.octet_length("text") >= short).select("k1", "k2", F.col("text").cast("binary").alias("text"))
    marks = stash(long_.mapInArrow(find, "k1 bigint, k2 bigint, pos int, lo int, hi int, h bigint").distinct())
    # written first: the join then reads two plain shuffles, and Spark can split a hot anchor's
    common = stash(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    lists = marks.join(common, "h").groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "lo", "hi", "h", "n")).alias("marks"))
    lists = lists.join(classes.select("k1", "k2", "who"), ["k1", "k2"])
    chosen = base.select("k1", "k2", "id", F.col("text").cast("binary").alias("text")).join(lists, ["k1", "k2"]).where("id = who")
    around = stash(chosen.select("k1", "k2", "who", "text", "marks").mapInArrow(_contexts(length), "k1 bigint, k2 bigint, who bigint, pos int, lo int, hi int, h bigint, n bigint, bytes binary"))
    first = keep == "first"
    of_size = [F.sort_array(F.collect_set(F.when(F.col("size") == x, F.struct("a", "b")))).alias(f"r{i}") for i, x in enumerate(lengths)]
    found = _runs(around, lengths, first, group).groupBy("k1", "k2").agg(*of_size).select("k1", "k2", *[_merged(f"r{i}").alias(f"r{i}") for i in range(len(lengths))])
    copied = classes.where((F.col("copies") > 1) & (F.col("n") >= short)).select("k1", "k2", F.col("who").alias("keeper"), F.col("n").alias("len"))
    rows = base.drop("text").join(found.join(copied, ["k1", "k2"], "full"), ["k1", "k2"], "left")
    is_copy = F.col("len").isNotNull() & (F.col("id") != F.col("keeper") if first else F.lit(True))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("len").alias("b")))
    own = [F.coalesce(f"r{i}", F.array().cast("array<struct<a:bigint,b:bigint>>")) for i in range(len(lengths))]
    return rows.select("row.*", *[F.when(is_copy & (F.col("len") >= x), whole).otherwise(r).alias(n) for r, n, x in zip(own, ("_spans", "_short"), lengths)])


def _merged(col: str):
    """Sorted runs with those that touch joined."""
    kind = "array<struct<a:bigint,b:bigint>>"
    acc = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("open"))
    step = lambda s, x: F.when(s["open"].isNull(), F.struct(s["done"].alias("done"), x.alias("open"))).otherwise(
        F.when(x["a"] <= s["open"]["b"], F.struct(s["done"].alias("done"), F.struct(s["open"]["a"].alias("a"), F.greatest(s["open"]["b"], x["b"]).alias("b")).alias("open")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), x.alias("open")))
    )
    return F.aggregate(col, acc, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def remove_spans(spanned: DataFrame) -> DataFrame:
    """Adds `_kept`: the bytes outside the runs, as binary."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(data)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_spans", lambda x: x["b"]))
    ends = F.concat(F.transform("_spans", lambda x: x["a"]), F.array(n.cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))))
    return spanned.withColumn("_kept", F.when(F.size("_spans") == 0, data).otherwise(F.unhex(F.array_join(pieces, ""))))
