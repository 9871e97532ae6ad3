"""Quality rules, line dedup and mixing against plain Python."""

import random
import re
from collections import Counter, defaultdict

from cardspark.llm import line_dedup, mixing, quality

from .fixtures import documents, empty, frame, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    rows = [r for r in documents() if r[0] != 125]
    got = quality.quality_rules(frame(spark, rows), spark.createDataFrame([(1,), (1,), (2,), (None,)], "doc_id long"))
    assert set(got.columns) == {*frame(spark).columns, "_q"}
    out = got.select("doc_id", "text", "_q.*").collect()
    same([(r.doc_id, r.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out], [(r[0], r[1], *measures(r[1])) for r in rows])
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_long_repeats(spark):
    text = "a b c d e f " * 20000
    r = quality.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long")).select("_q.*").first()
    assert (r.n_words, r.n_repeat_words, r.llr, r.kept) == (120000, 120000, 0.0, False)


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(2)
    vocab = [f"word{chr(97 + i)}" for i in range(26)]
    prose = [(i, " ".join(rng.choice(vocab) for _ in range(200))) for i in range(80)]
    junk = [(100 + i, " | ".join(rng.choice(vocab) for _ in range(100))) for i in range(40)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, docs.where("doc_id < 40").select("doc_id")).select("doc_id", "_q.kept").collect()}
    assert [i for i, _ in prose if not got[i]] == [] and [i for i, _ in junk if got[i]] == []


def test_line_dedup(spark):
    rows = documents()
    ids = defaultdict(set)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    of = lambda r: -(2**63) if r[0] is None else r[0]
    for r in rows:
        for line in (r[1] or "").split("\n"):
            ids[key(line)].add(of(r))
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(ids[key(x)]) < 5 or max(ids[key(x)]) == of(r)]
        want.append((r[0], r[1], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.drop_common_lines(frame(spark)).select("doc_id", "text", "_lines.n_lines", "_lines.n_dropped", "_lines.kept_text").collect()
    same(got, want)
    assert any(r[3] for r in want)


def plan(sizes):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = {s: rest * w[s] / sum(w[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, t in free.items() if t > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else free[s] for s in order}
        capped |= over


def test_mixing(spark):
    rows = documents()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = plan(sizes)
    run = lambda: mixing.shares(frame(spark), block=4, shard_words=100).collect()
    got = run()
    assert len(got) == len(rows)
    same(got, run())
    taken = Counter()
    for r in got:
        assert abs(r.target - want[r._s]) < 1e-6 and r.source_size == sizes[r._s] and 0 <= r.taken <= 3 * r.size
        taken[r._s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 4 * 2 * (sizes[s] / 100 + 2)
    full = mixing.mix(frame(spark), block=4, shard_words=100)
    assert full.columns == [*frame(spark).columns, "_taken"]
    same([(r.doc_id, r._taken) for r in full.collect()], [(r.doc_id, r.taken) for r in got])


def test_sainte_lague_is_by_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 24.0, "d": 3.0, "e": 0.0, "f": 1000.0}
    q = sorted(((-v / (2 * k + 1), -v, p) for p, v in votes.items() if v for k in range(200)))[:37]
    want = Counter(p for *_, p in q)
    df = spark.createDataFrame([(p, v, 37) for p, v in votes.items()], "p string, v double, n long")
    got = mixing.sainte_lague(df, [], "v", "n", "p", "seats")
    assert {r.p: r.seats for r in got.collect()} == {p: want[p] for p in votes}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.quality_rules(empty(spark), none).count() == 0
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
