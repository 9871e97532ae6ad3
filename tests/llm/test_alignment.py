"""The alignment of two tokenizers against the libraries and plain sets of offsets."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cardspark.llm import alignment, queries
from cardspark.llm.bpe import byte_letters

from .fixtures import documents, empty, frame, same

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = byte_letters()
    word = {i: t for t, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(letters[c] for c in word[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])

    def ends(side):
        out, n = {}, 0
        for k, (_, t) in enumerate(side):
            n += len(t)
            out[n] = k
        return out

    def run(rows):
        found, count = [], Counter()
        for key, text in rows:
            x, y = tokens(text)
            p, q = ends(x), ends(y)
            both = sorted(set(p) & set(q))
            links = [(x[p[e]][0], y[q[e]][0]) for e in both]
            count.update(links)
            groups, i, j = [], 0, 0
            for e in both:
                groups.append(",".join(str(t) for t, _ in x[i : p[e] + 1]) + "|" + ",".join(str(t) for t, _ in y[j : q[e] + 1]))
                i, j = p[e] + 1, q[e] + 1
            found.append((key, len(x), len(y), links, ";".join(groups)))
        most = {}
        for (_, t), n in count.items():
            most[t] = max(most.get(t, 0), n)
        return [(k, n, m, len(ls), len(ls), hashlib.sha256(g.encode()).hexdigest() if ls else "", sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls)) for k, n, m, ls, g in found]

    return run


ODD = ["a▁b", "\x00 a", "  two  spaces \n\n\t", "<|endoftext|> and <s> </s> <unk>", "日本語のテキスト 🙂", "a" * 5000, " ", "\n", "ﬁ ½ é", "x y", "é", " " * 40 + "x" + " " * 9]


def test_against_the_libraries(spark, brute):
    rows = documents() + [(1000 + i, t, "en", "s", 1, 1, "l", "s", "k") for i, t in enumerate(ODD)]
    got = alignment.align(frame(spark, rows).repartition(5), BYTE, PIECE, size=4000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    same([tuple(r) for r in got.collect()], brute([r[:2] for r in rows]))


def test_query_on_given_documents(spark, brute):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same([tuple(r) for r in queries.op13_alignment(spark, "/root/testdata/sf0.001").collect()], brute(rows))


def test_texts(spark):
    rows = [r for r in documents() if r[0] is not None]
    texts = {r.doc_id: r.groups for r in alignment.aligned_texts(frame(spark, rows), BYTE, PIECE).collect()}
    digests = {r.doc_id: r.groups_sha256 for r in alignment.align(frame(spark, rows), BYTE, PIECE).collect()}
    assert {k: hashlib.sha256(v.encode()).hexdigest() if v is not None else "" for k, v in texts.items()} == digests


def test_empty(spark):
    assert alignment.align(empty(spark), BYTE, PIECE).count() == 0
    assert alignment.align(frame(spark, [(1, None, *[None] * 7)]), BYTE, PIECE).collect()[0][1:] == (0, 0, 0, 0, "", 0, 0)


def test_runs_of_common_ends():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randrange(0, 60)
        a = sorted({*rng.sample(range(1, n + 1), rng.randrange(0, n + 1))}) if n else []
        b = sorted({*(x for x in a if rng.random() < 0.9), *rng.sample(range(1, n + 1), rng.randrange(0, n // 4 + 1))}) if n else []
        runs = list(zip(*alignment.common_ends(a, b)))
        assert [a[i + k] for i, _, m in runs for k in range(m)] == [b[j + k] for _, j, m in runs for k in range(m)] == sorted({*a} & {*b})
        assert all(i + m >= len(a) or j + m >= len(b) or a[i + m] != b[j + m] for i, j, m in runs)  # runs are as long as they can be
