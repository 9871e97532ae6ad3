"""LM scoring: a Katz backoff bigram model with Good-Turing discounts and exactly normalised backoff weights.

Documents are counted in chunks. A chunk sends each bucket (a range of hashes) one packed list of the distinct words and word
pairs it has there, with their training counts; the bucket adds up, and answers every chunk with the totals in the chunk's
order. So a shuffle moves some six bytes a distinct n-gram of a chunk, not a row a token. The buckets' totals are kept as
these answers, in the shared folder, not as a table from which a text that was not counted could be scored. With them a chunk scores its tokens: a seen pair by its
discounted count, an unseen one by its context's backoff weight times the word's own probability; the weights of contexts
that unseen pairs need are summed from all buckets' pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import stash

CHUNK = 5_000_000  # bytes of text that are counted at once
DISCOUNTED = 5  # counts up to this are discounted by Good-Turing
LEAST = 0.01  # what larger counts give up, so that every context can back off
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
HIGH = ~np.uint64(0xFF)


def pack(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    width = x.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes(), 1) if len(x) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """56 bits of a word pair."""
    return rolling.mixed(context * np.uint64(0x9E3779B97F4A7C15) + rolling.mixed(word)) & HIGH


class Chunk:
    """Tokens of some documents: hashes, the documents' borders, which of them train, and the distinct words and pairs."""

    def __init__(self, tokens: np.ndarray, cuts: np.ndarray, train: np.ndarray):
        self.cuts, self.train = cuts, train
        self.words, self.word = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
        self.word = self.word[:-1].astype(np.int64)
        before = np.concatenate([[START], tokens[:-1]])
        before[cuts[:-1]] = START
        self.before = np.searchsorted(self.words, before)
        self.pairs, first, self.pair = np.unique(pair_hash(before, tokens), return_index=True, return_inverse=True)
        self.pair_context, self.pair_word = self.before[first], self.word[first]
        self.taught = np.repeat(train, np.diff(cuts))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of words and of pairs; which words stand in documents that do not train."""
        words = np.bincount(self.word[self.taught], minlength=len(self.words)).astype(np.uint32)
        words[np.searchsorted(self.words, START)] = self.train.sum()
        asked = np.zeros(len(self.words), bool)
        asked[self.before[~self.taught]] = True
        return words, np.bincount(self.pair[self.taught], minlength=len(self.pairs)).astype(np.uint32), asked


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, A-Z in lower case, and one END each; and the texts' borders."""
    h, cuts = rolling.word_hashes(texts)
    return np.insert(h, cuts[1:], END), cuts + np.arange(len(cuts))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bytes, pa.Array, Chunk]]:
    """(number, checksum, doc_ids, chunk) of rows (doc_id, held_out, text); numbers are the same whenever the table is read."""
    number = TaskContext.get().partitionId() << 32
    ids, hold, tokens, cuts, size = [], [], [], [np.zeros(1, np.int64)], 0

    def made():
        nonlocal number
        id_ = pa.concat_arrays(ids)
        t = np.concatenate(tokens)
        number += 1
        return number, hashlib.sha256(t.tobytes()).digest(), id_, Chunk(t, np.concatenate(cuts), ~np.concatenate(hold))

    for batch in batches:
        at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(), dtype=np.int64)
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + max(1, most // 5))))
            part = batch.slice(at, to - at)
            t, c = tokens_of(part.column(2).to_pylist())
            ids.append(part.column(0))
            hold.append(part.column(1).to_numpy(zero_copy_only=False))
            tokens.append(t)
            cuts.append(c[1:] + cuts[-1][-1])
            size += sizes[to - 1] - (sizes[at - 1] if at else 0)
            at = to
            if size >= most:
                yield made()
                ids, hold, tokens, cuts, size = [], [], [], [np.zeros(1, np.int64)], 0
    if ids:
        yield made()


def _borders(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among sorted hashes."""
    which = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(buckets + 1).astype(np.uint64))


def _ask(buckets: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, check, _, c in _chunks(batches, most):
            words, pairs, asked = c.counts()
            a, b = _borders(c.words, buckets), _borders(c.pairs, buckets)
            rows = [
                (number, check, k, pack_sorted(c.words[a[k] : a[k + 1]]), pack(words[a[k] : a[k + 1]]), pack(asked[a[k] : a[k + 1]].astype(np.uint8)), pack_sorted(c.pairs[b[k] : b[k + 1]]), pack(pairs[b[k] : b[k + 1]]))
                for k in range(buckets)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["chunk", "sum", "bucket", "w", "wn", "wa", "p", "pn"])

    return run


_ASKED = "chunk bigint, sum binary, bucket bigint, w binary, wn binary, wa binary, p binary, pn binary"
_ANSWERED = "chunk bigint, sum binary, bucket bigint, wn binary, wa binary, pn binary, own binary, counted array<bigint>"


def _answer(t: pa.Table) -> pa.Table:
    """The totals of one bucket, to each chunk in its order. A bucket is one group, held whole by its task."""
    t = t.sort_by("chunk")
    w, p = [unpack_sorted(x) for x in t.column("w").to_pylist()], [unpack_sorted(x) for x in t.column("p").to_pylist()]
    wn, pn = [np.concatenate([unpack(x, np.uint32) for x in t.column(c).to_pylist()]) for c in ("wn", "pn")]
    wa = np.concatenate([unpack(x, np.uint8) for x in t.column("wa").to_pylist()])
    words, at = np.unique(np.concatenate(w), return_inverse=True)
    total = np.bincount(at, weights=wn, minlength=len(words)).astype(np.uint32)
    asked = (np.bincount(at, weights=wa, minlength=len(words)) > 0).astype(np.uint8)
    pairs, pat = np.unique(np.concatenate(p), return_inverse=True)
    ptotal = np.bincount(pat, weights=pn, minlength=len(pairs)).astype(np.uint32)
    # of the chunks that teach a pair, the first owns it
    own = np.zeros(len(pat), np.uint8)
    taught = np.flatnonzero(pn)
    own[taught[np.unique(pat[taught], return_index=True)[1]]] = 1
    real = total[words != START]
    hist = lambda n: np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1:].tolist()
    counted = [int(real.sum(dtype=np.int64)), int((real > 0).sum()), *hist(real), *hist(ptotal)]
    ws, ps = np.cumsum([0, *map(len, w)]), np.cumsum([0, *map(len, p)])
    rows = [(c, s, b, pack(total[at[ws[i] : ws[i + 1]]]), pack(asked[at[ws[i] : ws[i + 1]]]), pack(ptotal[pat[ps[i] : ps[i + 1]]]), pack(own[ps[i] : ps[i + 1]]), None) for i, (c, s, b) in enumerate(zip(t.column("chunk").to_pylist(), t.column("sum").to_pylist(), t.column("bucket").to_pylist()))]
    rows.append((-1, b"", rows[0][2], None, None, None, None, counted))
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table({n: pa.array(x, k) for n, x, k in zip(("chunk", "sum", "bucket", "wn", "wa", "pn", "own", "counted"), zip(*rows), kinds)})


def good_turing(n: list[int], k: int = DISCOUNTED) -> np.ndarray:
    """What remains of counts 0..k+1, from n[r - 1], the number of kinds seen r times, r up to k + 1.

    Katz's discounts, under which what is taken from counts up to k is the mass of kinds seen once. The counts of counts are
    first smoothed by a line through their logarithms over log r, since single ones are uneven (a fifth one above the fourth
    gives no discount). The line falls by 1.05 or more, as Good and Turing's estimate needs to be below each count; by 2 where
    fewer than two counts of counts are above zero. Larger counts give up LEAST, so that no context is left without mass for
    what it has not shown.
    """
    r = np.arange(k + 2, dtype=float)
    seen = np.array(n[: k + 1], float)
    some = np.flatnonzero(seen) + 1
    slope = min(-1.05, np.polyfit(np.log(some), np.log(seen[some - 1]), 1)[0]) if len(some) > 1 else -2.0
    top = (k + 1.0) ** (1 + slope)
    out = r - LEAST
    out[0] = 0
    few = r[1 : k + 1]
    out[1 : k + 1] = few * ((1 + 1 / few) ** (1 + slope) - top) / (1 - top)
    return out


def discounted(count: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(count < len(table), table[np.minimum(count, len(table) - 1)], count - LEAST)


class Model:
    """The small part: totals and discounts. A word's own probability; unknown words are one class that has the rest."""

    def __init__(self, counted: list[int]):
        h = DISCOUNTED + 2
        self.n, self.v = counted[0], counted[1]
        self.word, self.pair = good_turing(counted[2 : 2 + h]), good_turing(counted[2 + h :])
        kinds = np.array(counted[2 : 2 + h], float)
        taken = (np.arange(1, h) - self.word[1:]) @ kinds[: h - 1] + LEAST * kinds[h - 1]
        self.unknown = taken / self.n if self.n else 1.0

    def own(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.word) / max(1, self.n), self.unknown)


def _score(model: Model, number: int, ids: pa.Array, c: Chunk, words: np.ndarray, asked: np.ndarray, pairs: np.ndarray, own: np.ndarray) -> pa.Table:
    """Rows of a chunk's documents, and one row of the chunk's share in the sums of contexts that others ask for."""
    p = model.own(words)
    known = words[c.word] > 0
    seen = pairs[c.pair] > 0
    context = words[c.before].astype(float)
    logp = np.log10(p[c.word])
    # recursion over the order: the pair's own estimate, else the context's weight (added later) times the word's
    here = np.where(seen, np.log10(np.maximum(discounted(pairs[c.pair], model.pair), 1e-300) / np.maximum(context, 1)), logp)
    back = ~seen & (context > 0)
    base = np.log10((words[c.word] + 0.1) / (model.n + 0.1 * (model.v + 1)))
    cuts = c.cuts[:-1]
    sums = [np.add.reduceat(x, cuts) for x in (here, base, known.astype(np.int64))]
    doc = np.repeat(np.arange(len(cuts)), np.diff(c.cuts))
    key, n = np.unique(doc[back] * len(c.words) + c.before[back], return_counts=True)
    lists = np.searchsorted(key // len(c.words), np.arange(len(cuts) + 1))
    hashes = c.words[key % len(c.words)].view(np.int64)
    mine = np.flatnonzero(own.astype(bool) & asked.astype(bool)[c.pair_context])
    at = c.pair_context[mine]
    count = pairs[mine].astype(float)
    left = np.bincount(at, weights=(count - discounted(pairs[mine], model.pair)) / words[at], minlength=len(c.words))
    shown = np.bincount(at, weights=p[c.pair_word[mine]], minlength=len(c.words))
    which = np.flatnonzero(np.bincount(at, minlength=len(c.words)))
    one = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(len(cuts) + 1, np.int32), [len(x)]]).astype(np.int32)), pa.array(x, kind))
    per = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([lists, [lists[-1]]]).astype(np.int32)), pa.array(x, kind))
    row = lambda x, last, kind: pa.array([*x.tolist(), last], kind)
    return pa.table({
        "chunk": pa.array(np.full(len(cuts) + 1, number)), "row": row(np.arange(len(cuts)), -1, pa.int32()), "doc_id": pa.concat_arrays([ids.cast(pa.int64()), pa.array([None], pa.int64())]),
        "held_out": row(~c.train, None, pa.bool_()), "n_tokens": row(np.diff(c.cuts), 0, pa.int64()), "n_known": row(sums[2], 0, pa.int64()),
        "base_score": row(sums[1], 0.0, pa.float64()), "score": row(sums[0], 0.0, pa.float64()),
        "contexts": per(hashes, pa.int64()), "times": per(n, pa.int64()),
        "h": one(c.words[which].view(np.int64), pa.int64()), "left": one(left[which], pa.float64()), "shown": one(shown[which], pa.float64()),
    })


_SCORED = "chunk bigint, row int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, contexts array<bigint>, times array<bigint>, h array<bigint>, left array<double>, shown array<double>"


def _parcel(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per chunk with all that scoring needs: tokens as numbers of the chunk's words."""
        for number, check, ids, c in _chunks(batches, most):
            ids_, null = ids.fill_null(0).to_numpy().astype(np.int64), np.array(ids.is_null().to_pylist(), np.uint8)
            cells = [number, check, pack(ids_), pack(null), pack(c.cuts), pack(c.train.astype(np.uint8)), pack_sorted(c.words), pack(c.word.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in cells], names=["chunk", "sum", "ids", "nulls", "cuts", "train", "words", "word"])

    return run


def score(docs: DataFrame, rereadable: bool = False, chunk: int = CHUNK) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row per row.

    Rows whose crc32(doc_id) mod 10 is 0 are held out, all others train; a null doc_id counts as an empty one (held out).
    Null and empty texts are one end token. Whole texts are scored; repeated rows each count in training and get equal
    scores; without training rows all scores are 0; no rows give no rows; other columns are not read. docs is read twice and
    must give the same rows in the same order (rereadable: a plain table); otherwise it is first written to the shared folder.
    A common word costs one entry a chunk and bucket, however often it stands; nothing is kept per token.
    """
    spark = docs.sparkSession
    hold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hold.alias("held_out"), "text")
    if not rereadable:
        rows = stash(rows)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.mapInArrow(_ask(buckets, chunk), _ASKED)
    answers = stash(asked.groupBy("bucket").applyInArrow(_answer, _ANSWERED))
    totals = answers.where("chunk = -1").select(F.posexplode("counted").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()
    if not totals:
        return spark.createDataFrame([], "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    model = Model([r["n"] for r in totals])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        cell = {n: a.column(n)[0].as_py() for n in a.column_names}
        b = b.sort_by("bucket")
        if len(b) != buckets or set(b.column("sum").to_pylist()) != {cell["sum"]}:
            raise ValueError("docs gave other rows when read again; pass rereadable=False")
        words = unpack_sorted(cell["words"])
        c = Chunk(words[unpack(cell["word"], np.uint32)], unpack(cell["cuts"], np.int64), unpack(cell["train"], np.uint8).astype(bool))
        ids = pa.array(unpack(cell["ids"], np.int64), mask=unpack(cell["nulls"], np.uint8).astype(bool))
        got = {n: np.concatenate([unpack(x, k) for x in b.column(n).to_pylist()]) for n, k in (("wn", np.uint32), ("wa", np.uint8), ("pn", np.uint32), ("own", np.uint8))}
        return _score(model, cell["chunk"], ids, c, got["wn"], got["wa"], got["pn"], got["own"])

    parcels = rows.mapInArrow(_parcel(chunk), "chunk bigint, sum binary, ids binary, nulls binary, cuts binary, train binary, words binary, word binary")
    scored = stash(parcels.groupBy("chunk").cogroup(answers.where("chunk >= 0").drop("counted").groupBy("chunk")).applyInArrow(meet, _SCORED))
    sums = scored.where("row = -1").select(F.explode(F.arrays_zip("h", "left", "shown")).alias("x")).select("x.*")
    # of words that training never showed as a context, none are asked for
    weights = sums.groupBy("h").agg((F.log10(F.sum("left")) - F.log10(1 - F.sum("shown"))).alias("weight"))
    need = scored.where("row >= 0 and size(contexts) > 0").select("chunk", "row", F.explode(F.arrays_zip("contexts", "times")).alias("x")).select("chunk", "row", F.col("x.contexts").alias("h"), F.col("x.times").alias("times"))
    more = need.join(weights, "h").groupBy("chunk", "row").agg(F.sum(F.col("weight") * F.col("times")).alias("more"))
    return scored.where("row >= 0").join(more, ["chunk", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
    )
