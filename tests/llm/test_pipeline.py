"""Each stage of the pipeline against a brute-force version of it, on what the stage before kept."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from cardspark.llm import mixing, quality

from .test_native_rules import WORD, measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
COMMON = "This long line stands in a good many of the documents, word for word"


def corpus():
    rng = random.Random(5)
    vocab = [f"{a}{b}" for a in ("th", "on", "er", "rea", "wh", "st") for b in ("e", "ing", "ly", "ou", "a", "nd")]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) + str(rng.randrange(30)) * (rng.random() < 0.2) for _ in range(rng.randrange(30, 120))]
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        if i % 5 == 0:
            lines.insert(1, COMMON)
        rows.append((i, "\n".join(lines), "en", f"src{i % 5 if i % 2 else 0}"))
    for i in range(40):  # near and exact copies
        w = rows[i][1].split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = "edit"
        rows.append((200 + i, " ".join(w), "en", "src1"))
    rows += [(300 + i, " | ".join(rng.choice(vocab) for _ in range(40)), "en", "src2") for i in range(20)]
    rows += [(400, "a b c d e f " * 50, "en", "src1"), (401, None, "en", None), (402, "", "en", "src1")]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(301, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    out.append([tuple(r) for r in docs.collect()])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
        out.append([tuple(r) for r in docs.collect()])
    last = corpus_pipeline.run(spark, str(folder))
    assert sorted((r.doc_id, r.ids_sha256) for r in last.collect()) == sorted((r[0], r[3]) for r in out[5])
    return out


def buckets(text):
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    n = quality.BUCKETS
    w = WORD.findall(text.lower())
    pair = lambda a, b: h(b, h(a)) % n
    return [h(x) % n for x in w] + [n + pair(a, b) for a, b in zip(w, w[1:])] + [2 * n + pair(a[-1], b[0]) for a, b in zip(w, w[1:])]


def test_quality_stage(stages):
    rows = stages[0]
    raw, target = Counter(), Counter()
    for r in rows:
        b = buckets(r[1] or "")
        raw.update(b)
        if r[0] < 150 and r[0] % 2 == 0:
            target.update(b)
    n, a = quality.BUCKETS, quality.SMOOTHING
    total = lambda c, k: sum(v for b, v in c.items() if b // n == k)
    sums = [(total(raw, k), total(target, k)) for k in range(3)]

    def llr(text):
        b = buckets(text)
        p = lambda x: (raw[x] + a) / (sums[x // n][0] + a * n)
        return sum(math.log((target[x] + quality.PRIOR * p(x)) / (sums[x // n][1] + quality.PRIOR)) - math.log(p(x)) for x in b) / len(b) if b else 0.0

    def kept(text):
        w = measures(text)
        return w[0] >= 10 and 100 * w[4] <= 20 * w[0] and llr(text or "") >= quality.THRESHOLD

    assert sorted(stages[1]) == sorted(r for r in rows if kept(r[1]))
    assert {r[0] for r in stages[1]} >= set(range(150)) and not {r[0] for r in stages[1]} & set(range(300, 403))


def test_line_stage(stages):
    ids = {}
    for r in stages[1]:
        for line in r[1].split("\n"):
            ids.setdefault(line.strip().lower(), set()).add(r[0])
    want = []
    for r in stages[1]:
        t = "\n".join(x for x in r[1].split("\n") if len(x.strip()) < 40 or len(ids[x.strip().lower()]) < 5 or max(ids[x.strip().lower()]) == r[0])
        want.append((r[0], t, r[2], r[3], len(t)))
    assert sorted(stages[2]) == sorted(want) and sum(COMMON in r[1] for r in stages[2]) == 1


def test_near_duplicate_stage_links_what_shares_its_shingles(stages):
    def shingles(text):
        w = WORD.findall(text.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} - {()}

    sets = {r[0]: shingles(r[1]) for r in stages[2]}
    comp = {i: i for i in sets}
    close = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    for _ in sets:
        for i, j in close:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert sorted(stages[3]) == sorted(r for r in stages[2] if r[0] in set(comp.values()))


def test_mix_stage(stages, spark):
    rows = stages[3]
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.shares(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    copies = Counter(r[0] for r in stages[4])
    for r in rows:
        t, size = taken[r[0]]
        assert size == len(WORD.findall(r[1])) and copies.get(r[0], 0) == math.ceil(t / size) <= 3
    assert set(stages[4]) <= set(rows)


def test_bpe_stage(stages):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages[4]:
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids, "<u4").tobytes()
        want.append((r[0], len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
    assert sorted((a, b, bytes(c), d, e) for a, b, c, d, e in stages[5]) == sorted(want)


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, tmp_path):
    """Columns named as the operators' own come out as they went in; empty documents and labels give no error."""
    names = ["_n", "_q", "_lines", "_copy", "_taken", "n", "copy", "rest"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    kept = [r for r in corpus() if r[0] < 60 or r[0] in (401, 402)]
    full = spark.createDataFrame([(*r, *[f"{c}{r[0]}" for c in names]) for r in kept], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        got = stage(spark, full, str(tmp_path))
        assert got.columns == full.columns, name
        rows = got.collect()
        assert len({r.doc_id for r in rows}) > 10 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names), name
        assert stage(spark, full.limit(0), str(tmp_path)).count() == 0, name
        if k == 1:
            assert [(r.text, r.n_chars) for r in rows if r.doc_id == 401] == [(None, 0)]
    assert corpus_pipeline.STAGES[4][1](spark, full.limit(0), str(tmp_path)).count() == 0
