"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers cut the same bytes: a byte-level BPE (A) and a sentencepiece model (B). Their tokens are lists of byte offsets
at which tokens end. Where the tokens are one to one, both lists agree at a fixed shift of their indices: on that diagonal a
run is skipped by probing with doubled and then halved steps. Where they part, the smaller offset moves on until the two
meet again; that is an irregular group, and the diagonal is shifted by what it holds more on one side.

Documents are dealt with in blocks. A block keeps its documents' links as numbers in a dictionary of the pairs of ids that it
holds, so what Spark shuffles to count pairs over the corpus, and to bring the counts back, is a row a pair and block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPLIT, _Spec, byte_letters
from .common import stash

PART = 250_000  # bytes of text that are tokenized at once
BLOCK = 8_000_000  # bytes of text of one block


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Runs (i, j, n): tokens i..i+n of A and j..j+n of B end together, one by one; a and b are the sorted ends."""
    starts_a, starts_b, lengths = [], [], []
    i = j = 0
    last_a, last_b = len(a), len(b)
    while i < last_a and j < last_b:
        x, y = a[i], b[j]
        if x != y:  # an irregular group: the side that lags moves on
            while x != y:
                if x < y:
                    i += 1
                    if i == last_a:
                        return starts_a, starts_b, lengths
                    x = a[i]
                else:
                    j += 1
                    if j == last_b:
                        return starts_a, starts_b, lengths
                    y = b[j]
        shift, first, step = j - i, i, 1
        i += 1
        while i + step <= last_a and i + step + shift <= last_b and a[i : i + step] == b[i + shift : i + step + shift]:
            i += step
            step += step
        while step > 1:
            step >>= 1
            if i + step <= last_a and i + step + shift <= last_b and a[i : i + step] == b[i + shift : i + step + shift]:
                i += step
        starts_a.append(first)
        starts_b.append(first + shift)
        lengths.append(i - first)
        j = i + shift
    return starts_a, starts_b, lengths


@dataclass
class Aligned:
    """Some texts' tokens, end to end: ids, per text the first token of either side and the first link, and per link the tokens that end together."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    cut: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray


class Aligner:
    def __init__(self, byte_spec: bytes, piece_spec: bytes):
        """byte_spec: the tokenizers library's JSON of a byte-level BPE; piece_spec: a sentencepiece model."""
        d = json.loads(byte_spec)
        letters = byte_letters()
        vocab, special = d["model"]["vocab"], {t["content"] for t in d.get("added_tokens", ())}
        spelled = {t: i for t, i in vocab.items() if t not in special}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in spelled.items()}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in d["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids must follow the order of the merges")
        self.a = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_spec)
        bytes_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for t, i in ranks.items():
            bytes_a[i] = t
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = len(bytes_a), len(bytes_b)
        self.bytes = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.lengths = tuple(pc.binary_length(x).to_numpy().astype(np.int64) for x in self.bytes)
        self.written = pa.array([f"{i}{mark}".encode() for size, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(size)], pa.large_binary())

    def _tokens(self, texts: list[str]) -> list[list[list[int]]]:
        return [[self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1) if texts else []]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, Aligned]:
        """Which texts have tokens, and the alignment of those. Null and empty texts, and those that one side does not spell, have none."""
        full = np.array([bool(t) for t in texts], bool)
        some = [" " + texts[i] for i in np.flatnonzero(full)]
        sides = self._tokens([t[1:] for t in some])
        raw = [t.encode() for t in some]
        same = np.ones(len(raw), bool)
        ids = []
        for tokens, spelled in zip(sides, self.bytes, strict=True):
            flat = np.fromiter((x for t in tokens for x in t), np.int64, sum(map(len, tokens)))
            cuts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
            joined = spelled.take(pa.array(flat))
            at = _offsets(joined)
            data = memoryview(joined.buffers()[2] or b"").cast("B")
            same &= np.array([data[at[x] : at[y]] == r for x, y, r in zip(cuts[:-1], cuts[1:], raw)], bool)
            ids.append((flat, cuts))
        kept, cut = [], []
        for flat, cuts in ids:
            n = np.diff(cuts)
            kept.append(flat[np.repeat(same, n)])
            cut.append(np.concatenate([[0], np.cumsum(n[same])]).astype(np.int64))
        ends = [np.cumsum(size[x]) for size, x in zip(self.lengths, kept, strict=True)]
        i, j, n = (np.array(x, np.int64) for x in common_ends(*(e.tolist() for e in ends)))
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end_a, end_b = np.repeat(i, n) + within, np.repeat(j, n) + within
        full[full] = same
        return full, Aligned(*kept, *cut, np.searchsorted(end_a, cut[0]), end_a, end_b)

    def groups(self, x: Aligned) -> Iterator[memoryview]:
        """Of each text with tokens its groups, as `a1,a2|b1;a3|b2,b3`."""
        of_a = np.repeat(np.arange(len(x.end_a)), np.diff(x.end_a, prepend=-1))
        of_b = np.repeat(np.arange(len(x.end_b)), np.diff(x.end_b, prepend=-1))
        seq = np.empty(len(x.a) + len(x.b), np.int64)
        a, b = x.a.copy(), x.b + 2 * self.size_a
        a[x.end_a] += self.size_a
        b[x.end_b] += self.size_b
        seq[np.arange(len(a)) + np.concatenate([[0], x.end_b + 1])[of_a]] = a
        seq[np.arange(len(b)) + x.end_a[of_b] + 1] = b
        joined = self.written.take(pa.array(seq))
        at = _offsets(joined)[x.cut_a + x.cut_b]
        data = memoryview(joined.buffers()[2] or b"").cast("B")
        return (data[s : e - 1] for s, e in zip(at[:-1], at[1:]))


def _offsets(x: pa.LargeBinaryArray) -> np.ndarray:
    return np.frombuffer(x.buffers()[1], np.int64, len(x) + 1) if len(x) else np.zeros(1, np.int64)


class _Both:
    """Both tokenizer files, of sizes that the vocabularies fix, sent once to each executor; compiled once a worker."""

    ready: dict[tuple, Aligner] = {}

    def __init__(self, spark, byte_path: str, piece_path: str):
        self.a, self.b = _Spec(spark, byte_path), _Spec(spark, piece_path)

    def aligner(self) -> Aligner:
        key = self.a.id, self.b.id
        if key not in self.ready:
            self.ready.clear()
            self.ready[key] = Aligner(self.a.value, self.b.value)
        return self.ready[key]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some PART bytes of text; one text is never cut."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART)))
        yield batch.slice(at, to - at)
        at = to


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, groups: the alignment as text; null where a text has no tokens. A row per row."""
    both = _Both(docs.sparkSession, byte_path, piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = both.aligner()
        for batch in batches:
            for part in _parts(batch):
                full, x = of.align(part.column(1).to_pylist())
                found = of.groups(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes(next(found)).decode() if f else None for f in full], pa.string())], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, groups string")


_DOC = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_NUMBERS = [c.split()[0] for c in _DOC.split(", ")[1:5]]
_BLOCK = "block bigint, " + ", ".join(f"{c} array<{t}>" for c, t in (x.split() for x in _DOC.split(", "))) + ", links binary, pairs array<bigint>, counts array<bigint>"


class _Block:
    """Documents of one block: their numbers, and their links as places in the dictionary of the block's pairs."""

    def __init__(self):
        self.docs: dict[str, list] = {c.split()[0]: [] for c in _DOC.split(", ")}
        self.pairs: list[np.ndarray] = []
        self.size = 0

    def add(self, of: Aligner, part: pa.RecordBatch) -> None:
        full, x = of.align(part.column(1).to_pylist())
        found = (hashlib.sha256(g).hexdigest() for g in of.groups(x))
        self.docs["doc_id"] += part.column(0).to_pylist()
        for name, cut in zip(_NUMBERS, (x.cut_a, x.cut_b, x.cut, x.cut)):
            n = np.zeros(len(full), np.int64)
            n[full] = np.diff(cut)
            self.docs[name].append(n)
        self.docs["groups_sha256"] += [next(found) if f else "" for f in full]
        self.pairs.append(x.a[x.end_a] << 32 | x.b[x.end_b])
        self.size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0

    def row(self, number: int) -> pa.RecordBatch:
        known = pa.array(np.concatenate(self.pairs)).dictionary_encode()
        at = known.indices.to_numpy()
        at = at.astype(np.uint16 if len(known.dictionary) <= 1 << 16 else np.uint32)
        columns = [pa.array([number], pa.int64())]
        for name, values in self.docs.items():
            columns.append(pa.array([np.concatenate(values) if name in _NUMBERS else values], pa.list_(pa.string() if name == "groups_sha256" else pa.int64())))
        counts = np.bincount(at, minlength=len(known.dictionary))
        columns += [pa.array([at.tobytes()], pa.binary()), pa.array([known.dictionary.to_numpy()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])


def blocks(docs: DataFrame, byte_path: str, piece_path: str, size: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per block of some `size` bytes of text (one text is never cut), written to the shared folder."""
    both = _Both(docs.sparkSession, byte_path, piece_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = both.aligner()
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for part in _parts(batch):
                block.add(of, part)
                if block.size >= size:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.pairs:
            yield block.row(number)

    return stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK))


def link_counts(blocks_: DataFrame) -> DataFrame:
    """Blocks -> (pair, n, best): of each linked pair of ids, a * 2^32 + b, its links over the corpus and whether no pair of the same b has more."""
    rows = blocks_.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF)))  # as many rows as A has ids, at most
    return stash(rows.withColumn("best", F.col("n") == most))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their pairs' counts -> documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            docs = {c.split()[0]: row[c.split()[0]].values for c in _DOC.split(", ")}
            k, n, best = (row["known"].values.field(f).to_numpy(zero_copy_only=False) if row["known"].is_valid else np.zeros(0, np.int64) for f in ("k", "n", "best"))
            count, top = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            count[k], top[k] = n, best
            at = np.frombuffer(row["links"].as_py(), np.uint16 if len(k) <= 1 << 16 else np.uint32)
            links = docs["n_links"].to_numpy()
            cut = np.concatenate([[0], np.cumsum(links)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at])])[cut]) for x in (top, count)]
            yield pa.RecordBatch.from_arrays([*docs.values(), *map(pa.array, sums)], names=[*docs, "n_best", "count_sum"])


def align(docs: DataFrame, byte_path: str, piece_path: str, size: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; a row per row.

    A encodes space + text, B the text, both without special tokens (their strings are plain text). Groups are cut where
    tokens of both end; a link is a pair of tokens that end together; n_best and count_sum compare a document's links with
    the links of the whole corpus. Null and empty texts, and texts that one side does not spell to the byte, have zeros and
    an empty digest. Whole texts of any length: a block is some `size` bytes, or one text that is longer. Repeated rows
    count as often as they are there and get equal results; ties are all best; no rows give none; other columns are not read.
    """
    made = blocks(docs, byte_path, piece_path, size)
    counts = link_counts(made)
    asked = made.select("block", F.posexplode("pairs").alias("k", "pair")).join(counts, "pair")
    known = asked.groupBy("block").agg(F.collect_list(F.struct("k", "n", "best")).alias("known"))
    return made.drop("pairs", "counts").join(known, "block", "left").mapInArrow(_totals, _DOC + ", n_best bigint, count_sum bigint")
