"""SimHash near-dedup: a hierarchical index of fingerprints in Gray order.

A node of the index is a run of the Gray order whose fingerprints share their first bits: a mask and a bit pattern. The upper
nodes are rows that Spark deals out. A query goes to every upper node whose shared bits differ from its own in no more places
than are allowed, and carries what it has used up; a node that holds too many fingerprints is cut by further bits, and its
queries go down to those of its children that the differences so far still allow. Below such a node fingerprints are sorted
by Gray rank, runs of them factor the bits they share into nodes of two more levels, and a search prunes whole runs whose
accumulated differences exceed the limit. (`meet` searches the same trees below sampled masks, for a similarity of shingles.)
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import ascii_lower, let, stash, words

NODE = 512  # fingerprints below one upper node, about
MOST = 16384  # of one that is not cut further, visitors from other nodes counted
CUT = 4  # further bits by which a larger one is cut
LEAF, FAN = 8, 8
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: Column, n: int) -> Column:
    """XXH64 (seed 42) of each n-word shingle, repeats included; fewer words: of them all; none: empty."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.concat_ws(" ", *[w[i + k] for k in range(n)])))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(F.coalesce(text, F.lit("")))), of)


#: Of each byte its bits, the first one first, as eight bytes of one word: sums of up to 255 of them count all eight at once.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _majorities(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Per run h[cuts[i]:cuts[i+1]] the 64 bits that are 1 in over half of it."""
    n = np.diff(cuts)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        pieces = -(-n[full] // 255)
        first = np.cumsum(pieces) - pieces
        at = np.repeat(cuts[:-1][full], pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
        sums = np.add.reduceat(SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)], at, axis=0)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, f0: 64-bit fingerprints of the XXH64 of all shingles, repeats included.

    Null, empty and blank texts have fingerprint zero. Whole texts count; a batch of rows is cut where its hashes are many.
    """
    rows = docs.select("doc_id", shingle_hashes(F.col("text"), shingle).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            offsets = col.offsets.to_numpy().astype(np.int64)
            values = col.values.to_numpy(zero_copy_only=False).view(np.uint64)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 250_000)) - 1)
                j = min(j, batch.num_rows)
                out = _majorities(values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out.view(np.int64))], names=["doc_id", "f0"])
                i = j

    return rows.mapInArrow(run, "doc_id bigint, f0 bigint")


def shingle_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the distinct hashes of its n-word shingles, in order (fewer words: one of them all), end to end; and their borders."""
    h, cuts = rolling.word_hashes(texts)
    odd = [np.uint64(pow(MIX[0], k, 1 << 64)) for k in range(n)]
    m = max(0, len(h) - n + 1)
    x = rolling.mixed(sum((h[k : k + m] * odd[k] for k in range(n)), np.zeros(m, np.uint64)))
    sets = []
    for a, b in itertools.pairwise(cuts.tolist()):
        if b - a >= n:
            sets.append(np.unique(x[a : b - n + 1]))
        else:
            sets.append(rolling.mixed(sum((h[a + k : a + k + 1] * odd[k] for k in range(b - a)), np.zeros(1, np.uint64))) if b > a else h[:0])
    return np.concatenate([h[:0], *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _names(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    out = np.zeros(len(cuts) - 1, np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if len(full):
        out[full] = rolling.mixed(np.add.reduceat(rolling.mixed(values ^ np.uint64(MIX[1])), cuts[:-1][full]))
    return out


def _parts(batch: pa.RecordBatch, column: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some bytes of a column of texts; one text is never cut."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield batch.slice(at, to - at)
        at = to


def set_fingerprints(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, f0..f(width-1), s: fingerprints of the set of shingles, each of hashes mixed anew, and the set's hash.

    Null, empty and blank texts have zeros. Whole texts count, some at a time.
    """
    names = ["doc_id", *[f"f{k}" for k in range(width)], "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                values, cuts = shingle_sets(part.column(1).to_pylist(), shingle)
                out = []
                for k in range(width):
                    words_ = rolling.mixed(values ^ np.uint64(MIX[(k - 1) % 3] + k)) if k else values
                    out.append(np.concatenate([_majorities(words_[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i]) for i, j in _runs_of(cuts)] or [np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x.view(np.int64)) for x in [*out, _names(values, cuts)]]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def _runs_of(cuts: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Sets i..j with some `most` hashes together; one set is never cut."""
    i = 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most)) - 1)
        yield i, min(j, len(cuts) - 1)
        i = j


def sampled_masks(count: int, width: int, seed: int = 5) -> list[int]:
    """Masks of `width` seeded random bits each."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(64, width, replace=False)) for _ in range(count)]


def masks_for(similarity: float, width: int = 1, recall: float = 0.998, bits: int = 12) -> list[int]:
    """Sampled masks, mask k for word k % width, as many as it takes that a pair of the given shingle similarity (Jaccard)
    agrees under one of them with probability `recall`.

    Bits differ independently, each with the angle's probability; the number of rows plays no part.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = [math.comb(64, d) * p**d * (1 - p) ** (64 - d) for d in range(65)]
    agree = [math.comb(64 - d, bits) / math.comb(64, bits) for d in range(65)]
    each = 1
    while sum(c * (1 - a) ** each for c, a in zip(chance, agree, strict=True)) ** width > 1 - recall:
        each += 1
    return sampled_masks(each * width, bits)


def _gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _level(pattern: np.ndarray, mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes over runs of `size` children: the shared pattern and its mask, and each run's first child."""
    first = np.arange(0, len(pattern), size)
    both = np.bitwise_and.reduceat(mask, first)
    same = ~(np.bitwise_or.reduceat(pattern, first) ^ np.bitwise_and.reduceat(pattern, first))
    return np.bitwise_and.reduceat(pattern, first), both & same, first


def search(f: np.ndarray, differences: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j): asked[i] and f[j] at that many differing bits at most; f is in Gray order. Without asked: f[i] and f[j], i < j."""
    levels = [(f, np.full(len(f), ~np.uint64(0)), np.arange(len(f)))]
    for size in (LEAF, FAN):
        p, m, first = _level(levels[-1][0], levels[-1][1], size)
        levels.append((p, m, first))
    own = asked is None
    asked = f if own else asked
    out_q, out_c = [], []
    for q0 in range(0, len(asked), 256):
        q = np.repeat(np.arange(q0, min(q0 + 256, len(asked))), len(levels[2][0]))
        c = np.tile(np.arange(len(levels[2][0])), min(256, len(asked) - q0))
        for depth in (2, 1, 0):  # differences add up on the way down: a child's mask holds its parent's
            p, m, _ = levels[depth]
            near = np.bitwise_count((asked[q] ^ p[c]) & m[c]) <= differences
            q, c = q[near], c[near]
            if depth:
                fan = FAN if depth == 2 else LEAF
                n = len(levels[depth - 1][0])
                c = (c[:, None] * fan + np.arange(fan)).ravel()
                q = np.repeat(q, fan)
                ok = c < n
                q, c = q[ok], c[ok]
        if own:
            ok = q < c
            q, c = q[ok], c[ok]
        out_q.append(q)
        out_c.append(c)
    return np.concatenate([np.zeros(0, int), *out_q]), np.concatenate([np.zeros(0, int), *out_c])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node that links reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    return label


def _stars(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, child) for each member of a part but the one of the smallest id, its root: nodes that hold the same members return the same edges."""
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, label, ids)
    root = root[label]
    other = np.flatnonzero(root != ids)
    return root[other], ids[other]


def _flips(bits: int, most: int) -> list[int]:
    """All patterns of `bits` bits with up to `most` ones."""
    return [sum(1 << b for b in some) for k in range(most + 1) for some in itertools.combinations(range(bits), k)]


def _down(rows: DataFrame, depth: int, cut: int, near: int) -> DataFrame:
    """rows(p, used, id, f0), of nodes at a depth -> the same of their children, `cut` bits deeper.

    A row whose own node it is (used = 0, p its own bits) is dealt into its own child, and visits earlier ones; a visitor goes to
    whatever children its differences so far allow. Of two fingerprints the later one visits, so each pair meets once.
    """
    bits = F.shiftrightunsigned("f0", 64 - depth - cut).bitwiseAND(F.lit((1 << cut) - 1))
    flips = F.explode(F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(x.bit_count()).alias("k")) for x in _flips(cut, near)]))
    turned = F.col("bits").bitwiseXOR(F.col("flip.x"))
    rows = rows.select("p", "used", "id", "f0", bits.alias("bits"), flips.alias("flip"))
    rows = rows.where((F.col("used") + F.col("flip.k") <= near) & ((F.col("used") > 0) | (turned <= F.col("bits"))))
    return rows.select(F.shiftleft("p", cut).bitwiseOR(turned).alias("p"), (F.col("used") + F.col("flip.k")).alias("used"), "id", "f0")


def _nodes(prints: DataFrame, near: int, node: int, most: int) -> list[DataFrame]:
    """prints(f0, id) -> by depth of cut, the rows (id, f0, own) of each node that has fingerprints of its own, as one list.

    The upper nodes are as deep as gives some `node` fingerprints each, and half of `most` with those that visit. A node whose own
    and visiting rows are over `most` is cut further, both sides alike, at last to a single fingerprint, which no more than the
    fingerprints within `near` bits of it can visit.
    """
    count = max(1, prints.count())
    visits = lambda d: sum(math.comb(d, k) for k in range(near + 1)) / 2
    depth = next((d for d in range(60) if count <= node << d and count * max(1, visits(d)) <= (most << d) / 2), 60)
    rows = prints.select(F.lit(0).cast("long").alias("p"), F.lit(0).alias("used"), "id", "f0")
    rows, at, done = _down(rows, 0, depth, near) if depth else rows, depth, []
    own = (F.col("used") == 0).cast("int")  # the last step of two patterns alike: the node's own fingerprint
    while True:
        sizes = stash(rows.groupBy("p").agg(F.sum(own).alias("n"), F.count("*").alias("all")).where((F.col("n") > 0) & (F.col("all") > 1)).select("p", "all"))
        fits = sizes.where((F.col("all") <= most) | F.lit(at >= 64)).select("p")
        done.append(rows.join(fits, "p").groupBy("p").agg(F.collect_list(F.struct("id", "f0", own.alias("own"))).alias("rows")).select("rows"))
        crowded = sizes.where(F.col("all") > most).select("p")
        if at >= 64 or crowded.isEmpty():
            return done
        cut = min(CUT, 64 - at)
        rows = stash(_down(rows.join(crowded, "p"), at, cut, near))
        at += cut


def links(prints: DataFrame, near: int, node: int = NODE, most: int = MOST) -> DataFrame:
    """prints(f0, id), one row per fingerprint -> edges (a, b) that connect whatever is at `near` differing bits or fewer.

    No link is lost. A node's pairs stay in its task: it returns at most one edge a fingerprint or visitor.
    """
    done = functools.reduce(DataFrame.unionByName, _nodes(prints, near, node, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            cuts = col.offsets.to_numpy()
            ids, f, own = col.values.field("id").to_numpy(), col.values.field("f0").to_numpy().view(np.uint64), col.values.field("own").to_numpy() > 0
            a, b = [ids[:0]], [ids[:0]]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                here = np.flatnonzero(own[i:j]) + i
                here = here[np.argsort(_gray_rank(f[here]), kind="stable")]
                from_ = np.flatnonzero(~own[i:j]) + i
                q, c = search(f[here], near)
                v, d = search(f[here], near, f[from_])
                who = ids[np.concatenate([here, from_])]
                label = spanning(len(who), np.concatenate([q, v + len(here)]), np.concatenate([c, d]))
                root, child = _stars(who, label)
                a.append(root)
                b.append(child)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return done.mapInArrow(run, "a bigint, b bigint")


def _small_pairs(cuts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs within each node of 2 to `most` members, nodes being runs of rows: (row, later row, node), some at a time."""
    n = np.diff(cuts)
    for size in np.unique(n[(n > 1) & (n <= most)]):
        i, j = np.triu_indices(int(size), 1)
        nodes = np.flatnonzero(n == size)
        for some in np.array_split(nodes, -(-len(nodes) * len(i) // 1_000_000)):
            at = cuts[some][:, None]
            yield (at + i).ravel(), (at + j).ravel(), np.repeat(some, len(i))


def meet(prints: DataFrame, width: int, near: int, far: int, masks: list[int], node: int = 8192) -> DataFrame:
    """prints(f0.., id) -> edges (a, b) that connect whatever differs in `far` bits at most, in `near` bits of the word that a
    mask is of, and agrees under that mask; mask k is of word k % width. A node's pairs stay in its task: it returns at most
    one edge a fingerprint. A node over `node` fingerprints is dealt out in blocks that lose no pair."""
    words_ = [f"f{k}" for k in range(width)]
    keys = [F.struct(F.lit(k).alias("m"), F.col(words_[k % width]).bitwiseAND(F.lit(_signed(m))).alias("p")) for k, m in enumerate(masks)]
    rows = prints.select("id", *words_, F.explode(F.array(*keys)).alias("k")).select("k.m", "k.p", "id", *words_, F.lit(1).alias("weight"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(1)
            cuts = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.field("id").to_numpy()
            f = np.stack([col.values.field(w).to_numpy().view(np.uint64) for w in words_])
            of = batch.column(0).to_numpy() % width
            a, b = [ids[:0]], [ids[:0]]
            n = np.diff(cuts)
            pairs = [(cuts[:0], cuts[:0])]
            for q, c, node in _small_pairs(cuts, LEAF * FAN):  # nodes that are one run of leaves
                ok = np.bitwise_count(f[of[node], q] ^ f[of[node], c]) <= near
                q, c = q[ok], c[ok]
                ok = sum(np.bitwise_count(f[k][q] ^ f[k][c]).astype(np.int32) for k in range(width)) <= far
                pairs.append((q[ok], c[ok]))
            label = spanning(len(ids), *map(np.concatenate, zip(*pairs)))
            root, child = _stars(ids, label)
            a.append(root)
            b.append(child)
            for g in np.flatnonzero(n > LEAF * FAN):
                i, j, w = cuts[g], cuts[g + 1], of[g]
                order = np.argsort(_gray_rank(f[w, i:j]), kind="stable") + i
                x, who = f[:, order], ids[order]
                q, c = search(x[w], near)
                ok = sum(np.bitwise_count(x[k][q] ^ x[k][c]).astype(np.int32) for k in range(width)) <= far
                label = spanning(j - i, q[ok], c[ok])
                root, child = _stars(who, label)
                a.append(root)
                b.append(child)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def pack(df: DataFrame, by: list[str]) -> DataFrame:
        packed = df.groupBy(*by).agg(F.collect_list(F.struct("id", *words_)).alias("members")).where(F.size("members") > 1)
        return packed.select("m", "members").mapInArrow(run, "a bigint, b bigint")

    return dealt(rows, ["m", "p"], node, pack)


def dealt(rows: DataFrame, keys: list[str], cap: int, pack) -> DataFrame:
    """rows(keys.., id, weight, ...) -> edges (a, b) that connect in each group whatever pack(rows, keys) links in it.

    A group over the cap is dealt out in blocks. First each block is linked by itself; then the rows that are not connected to
    the group's largest part meet all blocks, so that every pair of two parts is in one block with its like. Such a group costs a
    copy of its rows for each block of what stays unconnected, so one of copies of one text costs two.
    """
    sizes = rows.groupBy(*keys).agg(F.sum("weight").alias("_n"))
    hot = stash(sizes.where(F.col("_n") > cap).select(*keys, F.ceil(F.col("_n") * 2 / cap).cast("int").alias("_k")))
    if hot.isEmpty():
        return pack(rows, keys)
    of = rows.join(F.broadcast(hot), keys, "left")
    first = stash(pack(of.withColumn("_b", F.pmod(F.xxhash64("id"), F.coalesce("_k", F.lit(1)))), [*keys, "_b"]))
    part = stash(of.where("_k is not null").join(components(first).withColumnRenamed("root", "_r"), "id", "left").withColumn("_r", F.coalesce("_r", "id")))
    parts = part.groupBy(*keys, "_r").agg(F.sum("weight").alias("_w"))
    main = parts.groupBy(*keys).agg(F.max_by("_r", F.struct("_w", "_r")).alias("_main"))
    rest = part.join(F.broadcast(main), keys).withColumn("_open", F.col("_r") != F.col("_main"))
    j = F.ceil(F.sum(F.when(F.col("_open"), F.col("weight"))) * 2 / cap).cast("int")
    rest = rest.join(F.broadcast(stash(rest.groupBy(*keys).agg(j.alias("_j")).where("_j > 0"))), keys)
    cell = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    mine, other = F.pmod(F.xxhash64("id", F.lit(1)), F.col("_j")), F.pmod(F.xxhash64("id"), F.col("_k"))
    down = F.transform(F.sequence(F.lit(0), F.col("_j") - 1), lambda x: cell(x, other))
    across = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda y: cell(mine, y))
    cells = rest.withColumn("_c", F.explode(F.when(F.col("_open"), F.array_union(down, across)).otherwise(down)))
    return first.unionByName(pack(cells.withColumns({"_x": F.col("_c.x"), "_y": F.col("_c.y")}), [*keys, "_x", "_y"]))


def alike(cuts: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect the sets values[cuts[i]:cuts[i+1]], none empty, whose Jaccard similarity is reached.

    A walk: each set reached is compared with all that are not, so the members of a group of copies are compared once.
    """
    n = np.diff(cuts)
    code = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(len(values), bool)
    left, flat, a, b, todo = np.arange(len(n)), code, [], [], []

    def drop(gone: np.ndarray) -> None:
        nonlocal left, flat
        flat, left = flat[np.repeat(~gone, n[left])], left[~gone]

    while len(left):
        if not todo:
            todo.append(left[0])
            drop(np.arange(len(left)) == 0)
            continue
        x = todo.pop()
        mine = code[cuts[x] : cuts[x + 1]]
        mark[mine] = True
        common = np.add.reduceat(mark[flat], np.cumsum(n[left]) - n[left], dtype=np.int64)
        mark[mine] = False
        hit = common + 1e-9 >= similarity * (n[x] + n[left] - common)
        if hit.any():
            todo.extend(left[hit])
            a.append(np.full(hit.sum(), x))
            b.append(left[hit])
            drop(hit)
    return np.concatenate([np.zeros(0, int), *a]), np.concatenate([np.zeros(0, int), *b])


def _sets(n: int):
    """Rows (root, id, s, text) -> root, id, s, h: distinct shingles; rows whose set is another than s names go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 3):
                values, cuts = shingle_sets(part.column(3).to_pylist(), n)
                same = pa.array(_names(values, cuts).view(np.int64) == part.column(2).to_numpy())
                h = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], h], names=["root", "id", "s", "h"]).filter(same)

    return run


def verified(sets: DataFrame, similarity: float, cap: int = 1_000_000) -> DataFrame:
    """sets(root, id, h: distinct shingles) -> edges (a, b) that connect, among equal roots, whatever reaches the similarity."""
    rows = sets.where(F.size("h") > 0).withColumn("weight", F.size("h") + 50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            cuts = col.offsets.to_numpy()
            ids, h = col.values.field("id").to_numpy(), col.values.field("h")
            at, values = h.offsets.to_numpy(), h.values.to_numpy()
            a, b = [ids[:0]], [ids[:0]]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = alike(at[i : j + 1] - at[i], values[at[i] : at[j]], similarity)
                a.append(ids[i + x])
                b.append(ids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def pack(df: DataFrame, by: list[str]) -> DataFrame:
        packed = df.groupBy(*by).agg(F.collect_list(F.struct("id", "h")).alias("members")).where(F.size("members") > 1)
        return packed.select("members").mapInArrow(run, "a bigint, b bigint")

    return dealt(rows, ["root"], cap, pack)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (id, root): of every id in an edge the smallest id that links reach.

    Rounds of large-star and small-star steps, each written to the shared folder, until nothing changes; an error if they don't end.
    """
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v"))  # larger neighbours to the least
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("w").alias("v")), F.struct(F.col("v").alias("u"), F.col("w").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = stash(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, near: int = 2, width: int = 1, far: int | None = None, similarity: float | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, f0.., component_id; a row per row.

    Fingerprints link at `near` or fewer differing bits of f0; component_id is the smallest doc_id reachable. Without
    `similarity` the search is exact. With it, the sets of shingles decide: masks are sampled to find pairs of that similarity,
    `far` or fewer of the bits of all `width` words apart, and whatever they connect is compared shingle by shingle, so no link
    is under the similarity.
    Equal fingerprints (with `similarity`: equal sets) are one class before any search, so exact copies cost one row. Null and
    empty texts have fingerprint zero and are one class. Rows with a null doc_id get their class's component (null if no other
    id is in it). Repeated rows get equal results; no rows give no rows; other columns are not read.
    """
    words_ = [f"f{k}" for k in range(width)]
    exact = similarity is None
    if exact and (width != 1 or far is not None):
        raise ValueError("width and far go with a similarity")
    of_class = words_ if exact else [*words_, "s"]
    prints = stash(fingerprints(docs, shingle) if exact else set_fingerprints(docs, shingle, width))
    classes = stash(prints.groupBy(*of_class).agg(F.min("doc_id").alias("id")))
    known, far = classes.where("id is not null"), 64 * width if far is None else far
    if exact:
        roots = components(links(known, near))
    else:
        found = known.select("id", "s").join(components(meet(known, width, near, far, masks_for(similarity, width))), "id")
        found = stash(found.select("id", "s", "root"))
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(found, "id").select("root", "id", "s", "text")
        sets = texts.mapInArrow(_sets(shingle), "root bigint, id bigint, s bigint, h array<bigint>")
        roots = components(verified(stash(sets.dropDuplicates(["id", "s"]).drop("s")), similarity))
    of = classes.join(roots, "id", "left").select(*of_class, F.coalesce("root", "id").alias("component_id"))
    return prints.join(of, of_class).drop("s")


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")
