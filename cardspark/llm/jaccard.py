"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Sets of n-word shingles whose Jaccard similarity reaches a limit are of similar size, so sets are put into bands of sizes, and
a pair is looked for in the band of its smaller set. A band's sizes bound how many elements such a pair may differ in; cut by
hash into one more parts than that, the two sets agree in one part entirely. Sets that agree in a part of their band are a
tile. In a tile, bitmap signatures (the parity of the elements hashed to each bit) are compared: two sets differ in as many
elements as their bitmaps in bits, at least, which bounds the overlap from above. What a tile's bounds admit is connected;
then, among the sets so connected, sorted arrays are intersected exactly, again only where sizes and bit counts admit it.

Equal sets are one class before any search. A tile or a connected group returns edges that connect what it links, not all
pairs; one that is too large for a task is dealt out in blocks that lose no pair (`simhash.dealt`).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import stash
from .simhash import MIX, _names, _parts, _small_pairs, _stars, components, dealt, shingle_sets, spanning

BITS = 1024  # of a signature in a tile
TILE = 4096  # sets of a tile that one task compares
SMALL = 16  # sets of a tile all pairs of which are compared at once
FEW = 1_000_000  # hashes of texts that are broadcast, 8 bytes each; more are joined by a shuffle
GROUP = 400_000  # shingles of a connected group that one task intersects


def bands(limit: Fraction, largest: int) -> list[int]:
    """Borders of bands of sizes, the first that of the smallest set of a pair that is not equal; each is a quarter wider."""
    p, q = limit.numerator, limit.denominator
    edges = [-(-p // (q - p))]
    while edges[-1] <= largest:  # a set's largest partner is in the next band at most
        edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4, (edges[-1] - 1) * q // p + 1))
    return edges


def tiles_of(n: np.ndarray, limit: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which sets, band, parts) of sets of n elements: the band of each set, and the one below where a partner may be in it."""
    edges = np.array(bands(limit, int(n.max(initial=0))), np.int64)
    most = edges[1:] - 1  # of the smaller set
    larger = most * limit.denominator // limit.numerator
    # sets of a and b elements with an overlap of limit * union differ in (1 - limit) / (1 + limit) * (a + b) elements at most
    parts = (most + larger) * (limit.denominator - limit.numerator) // (limit.denominator + limit.numerator) + 1
    band = np.searchsorted(edges, n, side="right") - 1
    own = np.flatnonzero(band >= 0)
    yield own, band[own], parts[band[own]]
    low = np.flatnonzero(band >= 1)
    low = low[n[low] <= larger[band[low] - 1]]
    yield low, band[low] - 1, parts[band[low] - 1]


def tile_keys(values: np.ndarray, cuts: np.ndarray, limit: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tiles of sets values[cuts[i]:cuts[i+1]], end to end, and the borders of each set's."""
    n = np.diff(cuts)
    sums, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for who, band, parts in tiles_of(n, limit):
        if not len(who):
            continue
        size = n[who]
        at = np.repeat(cuts[who] - np.cumsum(size) + size, size) + np.arange(size.sum())
        x = rolling.mixed(values[at] ^ np.uint64(MIX[2]))
        first = np.cumsum(parts) - parts
        part = np.repeat(first, size) + ((x >> np.uint64(32)) * np.repeat(parts, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(parts.sum(), np.uint64)
        np.add.at(total, part, rolling.mixed(x))
        place = np.repeat(band << 32, parts) + np.arange(parts.sum()) - np.repeat(first, parts)
        sums.append(rolling.mixed(total ^ rolling.mixed(place.astype(np.uint64) + np.uint64(MIX[0]))))
        owners.append(np.repeat(who, parts))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(sums)[order], np.searchsorted(owner[order], np.arange(len(n) + 1))


def signatures(values: np.ndarray, cuts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Per set the parity bitmap of its elements, as a row of 64-bit words."""
    n = np.diff(cuts)
    place = (rolling.mixed(values ^ np.uint64(MIX[1])) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(n)), n) * bits + place, minlength=len(n) * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(n), bits), axis=1).view(np.uint64) if len(n) else np.zeros((0, bits // 64), np.uint64)


def admitted(n, sizes: np.ndarray, bits: np.ndarray, others: np.ndarray, limit: Fraction) -> np.ndarray:
    """Which of the other sets may reach the limit: by sizes, and by the overlap that differing bits leave, (a + b - differing) / 2 at most."""
    p, q = limit.numerator, limit.denominator
    differ = np.bitwise_count(others ^ bits).sum(axis=1, dtype=np.int64)
    return (np.minimum(n, sizes) * q >= np.maximum(n, sizes) * p) & (differ * (p + q) <= (n + sizes) * (q - p))


def linked(sizes: np.ndarray, bits: np.ndarray, limit: Fraction, overlap=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that connect all sets between which there is a path of pairs that bounds admit and whose overlap(i, others), if given, reaches the limit.

    A walk: each set reached is compared with all that are not, so copies are compared once.
    """
    left, todo, a, b = np.arange(len(sizes)), [], [], []
    while len(left):
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
            continue
        x = todo.pop()
        hit = admitted(sizes[x], sizes[left], bits[x], bits[left], limit)
        if overlap is not None and hit.any():
            near = np.flatnonzero(hit)
            common = overlap(x, left[near])
            hit[near] = common * limit.denominator >= limit.numerator * (sizes[x] + sizes[left[near]] - common)
        if hit.any():
            todo.extend(left[hit].tolist())
            a.append(np.full(hit.sum(), x))
            b.append(left[hit])
            left = left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def intersections(values: np.ndarray, cuts: np.ndarray):
    """overlap(i, others): sizes of the intersections of a sorted array with others, by binary search."""

    def overlap(i: int, others: np.ndarray) -> np.ndarray:
        mine = values[cuts[i] : cuts[i + 1]]
        n = cuts[others + 1] - cuts[others]
        flat = values[np.repeat(cuts[others] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        return np.add.reduceat(found, np.cumsum(n) - n, dtype=np.int64)

    return overlap


def _fraction(similarity: float) -> Fraction:
    limit = Fraction(similarity).limit_denominator(1000)
    if not 0 < limit < 1:
        raise ValueError("similarity must lie between 0 and 1")
    return limit


def set_rows(docs: DataFrame, shingle: int, limit: Fraction) -> DataFrame:
    """docs(doc_id, text) -> doc_id, t: a hash of the text, n, s1, s2: size and hash of its set of shingles, tiles: keys of its
    tiles, bits: its signature; written to the shared folder."""
    names = ["doc_id", "t", "n", "s1", "s2", "tiles", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                values, cuts = shingle_sets(part.column(2).to_pylist(), shingle)
                keys, at = tile_keys(values, cuts, limit)
                tiles = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
                bits = pa.array([r.tobytes() for r in signatures(values, cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.diff(cuts)), *_both_names(values, cuts), tiles, bits], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    return stash(rows.mapInArrow(run, "doc_id bigint, t bigint, n bigint, s1 bigint, s2 bigint, tiles array<bigint>, bits binary"))


def _both_names(values: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    return [pa.array(_names(x, cuts).view(np.int64)) for x in (values, values * np.uint64(MIX[2]) + np.uint64(1))]


def _edges(limit: Fraction, exact: bool):
    """Groups of members (id, n, bits[, h]) -> edges (a, b) that connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            cuts = col.offsets.to_numpy()
            m = {f.name: col.values.field(f.name) for f in col.type.value_type}
            ids = m["id"].to_numpy()
            if exact:
                at, values = m["h"].offsets.to_numpy().astype(np.int64), m["h"].values.to_numpy().view(np.uint64)
                n = np.diff(at)
            else:
                n, bits = m["n"].to_numpy(), np.frombuffer(b"".join(m["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
            a, b = [ids[:0]], [ids[:0]]
            if not exact:  # small tiles, all at once
                few = [(q[ok], c[ok]) for q, c, _ in _small_pairs(cuts, SMALL) for ok in [admitted(n[q], n[c], bits[q], bits[c], limit)]]
                root, child = _stars(ids, spanning(len(ids), *map(np.concatenate, zip((cuts[:0], cuts[:0]), *few))))
                a.append(root)
                b.append(child)
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if not exact and j - i <= SMALL:
                    continue
                if exact:
                    inner = at[i : j + 1] - at[i]
                    mine = values[at[i] : at[j]]
                    wide = max(BITS, 1 << int(np.diff(inner).max() // 4).bit_length())  # bits that tell large sets apart
                    bits_ = np.concatenate([signatures(mine[inner[x] : inner[y]], inner[x : y + 1] - inner[x], wide) for x, y in _some(inner, wide)])
                    x, y = linked(n[i:j], bits_, limit, intersections(mine, inner))
                else:
                    x, y = linked(n[i:j], bits[i:j], limit)
                a.append(ids[i + x])
                b.append(ids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def _some(cuts: np.ndarray, wide: int) -> Iterator[tuple[int, int]]:
    """Sets i..j, few enough that their bits can be counted at once."""
    step = max(1, 4_000_000 // wide)
    for i in range(0, len(cuts) - 1, step):
        yield i, min(i + step, len(cuts) - 1)


def _packed(columns: list[str], limit: Fraction, exact: bool):
    def pack(df: DataFrame, by: list[str]) -> DataFrame:
        groups = df.groupBy(*by).agg(F.collect_list(F.struct(*columns)).alias("members")).where(F.size("members") > 1)
        return groups.select("members").mapInArrow(_edges(limit, exact), "a bigint, b bigint")

    return pack


def _sets(shingle: int):
    """Rows (root, id, s1, s2, text) -> root, id, h: distinct shingles, sorted; rows whose set is another than s1 and s2 name go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 4):
                values, cuts = shingle_sets(part.column(4).to_pylist(), shingle)
                same = np.all([x.to_numpy() == y.to_numpy() for x, y in zip(_both_names(values, cuts), part.columns[2:4])], axis=0)
                h = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], h], names=["root", "id", "h"]).filter(pa.array(same))

    return run


def jaccard_components(docs: DataFrame, shingle: int = 3, similarity: float = 0.9, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id; a row per row.

    Documents link where the Jaccard similarity of their sets of distinct `shingle`-word shingles (A-Z in lower case; fewer
    words: the whole sequence as one) reaches the similarity, equality included; all links count. component_id is the smallest
    doc_id that links reach. Null, empty and blank texts have empty sets and link with nothing. Rows with a null doc_id get the
    smallest doc_id of their component, null if there is none; rows with one doc_id and different texts are different documents
    (of one number). Repeated rows get equal results, no rows give none, other columns are not read. Shingles are told apart by
    64 bits, sets by 128. A task holds the shingles of some megabyte of texts, or of one text that is longer.
    """
    limit = _fraction(similarity)
    rows = set_rows(docs, shingle, limit)
    some = rows.where("n > 0")
    # equal sets are one row, put together before they are shuffled; its number is drawn when it is written
    named = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("x")
    classes = some.groupBy("s1", "s2").agg(named, *[F.first(c).alias(c) for c in ("n", "tiles", "bits")])
    classes = stash(classes.select(F.monotonically_increasing_id().alias("id"), "s1", "s2", F.col("x.doc_id").alias("doc"), F.col("x.t").alias("t"), "n", "tiles", "bits"))
    asked = classes.select("id", F.explode("tiles").alias("tile"))
    shared = stash(asked.groupBy("tile").agg(F.count("*").alias("m")).where("m > 1").select("tile"))
    meeting = asked.join(shared, "tile").join(classes.select("id", "n", "bits"), "id").withColumn("weight", F.lit(1))
    near = components(dealt(stash(meeting), ["tile"], tile, _packed(["id", "n", "bits"], limit, False)))
    found = stash(classes.select("id", "s1", "s2", "doc", "t").join(near, "id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"), "text")
    if found.count() <= FEW:  # texts that are in no tile stay where they are
        texts = texts.join(F.broadcast(found.select("t").distinct()), "t", "left_semi")
    texts = texts.join(found.withColumnsRenamed({"doc": "_doc", "t": "_t"}), (F.col("t") == F.col("_t")) & F.col("doc").eqNullSafe(F.col("_doc")))
    sets = texts.select("root", "id", "s1", "s2", "text").mapInArrow(_sets(shingle), "root bigint, id bigint, h array<bigint>")
    sets = stash(sets.groupBy("id").agg(F.first("root").alias("root"), F.first("h").alias("h")).withColumn("weight", F.size("h") + 50))
    roots = components(dealt(sets, ["root"], group, _packed(["id", "h"], limit, True)))
    linked_ = stash(classes.select("id", "doc").join(roots, "id"))
    least = stash(linked_.groupBy("root").agg(F.min("doc").alias("least")))
    of = classes.select("id", "s1", "s2", "doc").join(linked_.join(least, "root").select("id", "least"), "id", "left")
    of = stash(of.select("s1", "s2", F.coalesce("least", "doc").alias("component_id")))
    full = some.select("doc_id", "n", "s1", "s2").join(of, ["s1", "s2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
