"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens: a state is "the last token was x", an arc is a token allowed next. It begins with the bytes, every
arc allowed. Each merge (u, v) -> w, in order, is a gadget: the new state w copies what the state v has lost so far, then
the state u loses its arcs to v and to all tokens that begin with v and were merged no earlier. Tokens are numbered along the
tree of their left parts, later merges first, so that those tokens are one range of numbers; the arcs a state has lost are
sorted disjoint ranges. All gadgets are compiled before the first text; an arc is then looked up in the state's ranges.
Exactly one path spells a word: its labels are the word's tokens. Where two tokens could go on, the walk takes the longest
and turns back where no arc leads on.
"""

from __future__ import annotations

import itertools
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The published pattern of byte-level BPE by which texts are split beforehand (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same in plain classes, for texts of Latin-1 alone: letters, numbers and white space of it.
LETTER, NUMBER, SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPLIT_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
KEPT_WORDS, KEPT_ARCS = 300_000, 500_000
PART = 2_000_000  # bytes of text at once


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Ids of words, worked out when first asked for."""

    def __init__(self, path):
        self.path = path

    def __missing__(self, w: str) -> bytes:
        ids = array("I", self.path(w.encode())).tobytes()
        if len(w) < 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[w] = ids
        return ids


class Automaton:
    def __init__(self, spec: bytes):
        """spec: the tokenizers library's JSON of a byte-level BPE."""
        d = json.loads(spec)
        letters = byte_letters()
        raw = lambda t: bytes(map(letters.__getitem__, t))
        vocab = d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        plain = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        labels = {i: raw(t) if i in plain else t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in (m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"])]
        size = max(labels, default=-1) + 1
        self._number(size, plain, merges)
        self._gadgets(size, plain, merges)
        self._index(size, plain)
        self.label = pa.array([labels.get(i, b"") for i in range(size)], pa.binary())
        self.words = Words(self.path)
        self.known: dict[int, bool] = {}  # arcs looked up lately
        self.split = regex.compile(SPLIT)
        self.split_latin = re.compile(SPLIT_LATIN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _number(self, size: int, plain: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        """Numbers of the tokens along the tree of left parts; below a token, what was merged later comes first."""
        below: dict[int, list[int]] = {}
        rank = {}
        for r, (u, _, w) in enumerate(merges):
            if w not in rank:
                rank[w] = r
                below.setdefault(u, []).append(w)
        self.at, end, n = [0] * size, [0] * size, 0
        todo = [i for i in plain if i not in rank]
        while todo:
            x = todo.pop()
            if x < 0:
                end[~x] = n
                continue
            self.at[x] = n
            n += 1
            todo.append(~x)
            todo += below.get(x, ())  # the last one is taken first
        #: of each token: ranks of the merges that it is the left part of, and where their tokens' numbers end
        self.ranks = {x: [rank[w] for w in ws] for x, ws in below.items()}
        self.ends = {x: [end[w] for w in ws] for x, ws in below.items()}

    def _range(self, r: int, v: int) -> tuple[int, int]:
        """Numbers of v and of the tokens that begin with it and were merged by merge r at the earliest."""
        ranks = self.ranks.get(v, ())
        k = bisect_left(ranks, r)
        return self.at[v], self.ends[v][k] if k < len(ranks) else self.at[v] + 1

    def _gadgets(self, size: int, plain: dict[int, bytes], merges: list[tuple[int, int, int]]) -> None:
        """Successive gadgets; then the ranges of all states, one after the other, in one table."""
        lost: list[list[int]] = [[] for _ in range(size)]
        made, seen = {i for i, x in plain.items() if len(x) == 1}, set()
        #: tokens that merging their own bytes yields
        self.live = set(made)
        for r, (u, v, w) in enumerate(merges):
            if (u, v) in seen:
                continue
            seen.add((u, v))
            if w not in made:
                made.add(w)
                if u in self.live and v in self.live and not bisect_right(lost[u], self.at[v]) & 1:
                    self.live.add(w)
                lost[w] = lost[v].copy()
            low, high = self._range(r, v)
            of = lost[u]
            i, j = bisect_left(of, low), bisect_right(of, high)
            of[i:j] = [low] * (not i & 1) + [high] * (not j & 1)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in lost])]).tolist()
        self.table = array("i", itertools.chain.from_iterable(lost))

    def _index(self, size: int, plain: dict[int, bytes]) -> None:
        """A tree of the live tokens' bytes, to find the longest token at a place, and of each token the longest one that it begins with."""
        self.step: dict[int, int] = {}
        token = [-1]
        self.shorter, self.length = [-1] * size, [0] * size
        for i in sorted(self.live, key=lambda i: len(plain[i])):
            self.length[i] = len(plain[i])
            at = 0
            for b in plain[i]:
                if token[at] >= 0:
                    self.shorter[i] = token[at]
                to = self.step.get(at << 8 | b)
                if to is None:
                    to = self.step[at << 8 | b] = len(token)
                    token.append(-1)
                at = to
            token[at] = i
        self.token = token

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after token x has an arc y."""
        a = self.first[x]
        return not (bisect_right(self.table, self.at[y], a, self.first[x + 1]) - a) & 1

    def path(self, word: bytes) -> list[int]:
        """The labels of the one path that spells the word."""
        n, at, out, last = len(word), 0, [], -1
        step, token, shorter, length, known = self.step, self.token, self.shorter, self.length, self.known
        dead = None  # places from which no arc led on
        view = memoryview(word) if n > 256 else word  # a slice of a view copies nothing
        while at < n:
            node, y = 0, -1
            for b in view[at:] if at else view:
                node = step.get(node << 8 | b)
                if node is None:
                    break
                if token[node] >= 0:
                    y = token[node]
            while True:
                while y >= 0:
                    if last < 0 or (ok := known.get(last << 20 | y)):
                        if dead is None or not dead[at + length[y]]:
                            break
                    elif ok is None:
                        if len(known) > KEPT_ARCS:
                            known.clear()
                        known[last << 20 | y] = self.arc(last, y)
                        continue
                    y = shorter[y]
                if y >= 0:
                    break
                if last < 0:
                    raise ValueError(f"no tokens spell {word!r}")
                dead = dead or bytearray(n + 1)
                dead[at] = 1
                y = out.pop()
                at -= length[y]
                last = out[-1] if out else -1
                y = shorter[y]
            out.append(y)
            at += length[y]
            last = y
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.specials and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode(p) for p in parts if p)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            split = self.split_latin
        except UnicodeEncodeError:
            split = self.split
        return b"".join(map(self.words.__getitem__, split.findall(text)))

    def decode(self, ids: list[bytes]) -> pa.Array:
        """The arc labels of each entry's ids, as text."""
        n = np.array([len(x) // 4 for x in ids], np.int64)
        data = self.label.cast(pa.large_binary()).take(pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
        cuts = np.frombuffer(data.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(n)])] if len(data) else np.zeros(len(ids) + 1, np.int64)
        out = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(cuts), data.buffers()[2]) if len(data) else pa.array([""] * len(ids), pa.large_string())
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids that spell no UTF-8
            raw = memoryview(data.buffers()[2] or b"")
            out = pa.array([str(raw[a:b], "utf-8", "replace") for a, b in itertools.pairwise(cuts.tolist())], pa.large_string())
        return out


_compiled: dict[int, Automaton] = {}


def _automaton(spec) -> Automaton:
    """Compiled once a worker."""
    if spec.id not in _compiled:
        _compiled.clear()
        _compiled[spec.id] = Automaton(spec.value)
    return _compiled[spec.id]


class _Spec:
    """The tokenizer file's bytes, of a size that the vocabulary fixes, sent once to each executor."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            self.sent = spark.sparkContext.broadcast(f.read())

    @property
    def id(self):
        return self.sent._path if self.sent._path else id(self.sent)

    @property
    def value(self):
        return self.sent.value


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some PART bytes of a column; one value is never cut."""
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART)))
        yield batch.slice(at, to - at)
        at = to


def _encoded(a: Automaton, part: pa.RecordBatch) -> tuple[list[bytes], pa.RecordBatch]:
    ids = [a.encode(t) if t else b"" for t in part.column(1).to_pylist()]
    return ids, pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_tokens, ids: packed little-endian unsigned 32-bit integers; a row per row.

    Whole texts; null and empty texts have no ids; special tokens written in a text become their ids. Rows are independent:
    repeated rows get equal results, no rows give none, other columns are not read. A task holds some PART bytes of text at
    once, or one text that is longer, with its words and ids.
    """
    spec = _Spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(spec)
        for batch in batches:
            for part in _parts(batch, 1):
                yield _encoded(a, part)[1]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows of encode() with `decoded`, the text that their ids spell (null ids: empty; bytes that are no UTF-8: U+FFFD)."""
    spec = _Spec(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(spec)
        for batch in batches:
            for part in _parts(batch, 2):
                texts = a.decode([x or b"" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)), in one pass over the texts."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(spec)
        for batch in batches:
            for part in _parts(batch, 1):
                ids, rows = _encoded(a, part)
                yield pa.RecordBatch.from_arrays([*rows.columns, a.decode(ids).cast(pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
