"""Cards, exports, limits and sessions against small cases and plain folds."""

import json
import random
import re
from datetime import datetime

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from cardspark.operators import cards as C
from cardspark.operators import entitlement as E
from cardspark.operators import notes, review
from cardspark.operators import sessions as Se
from cardspark.operators import usage as U
from cardspark.plans.tables import read


def test_scan_objects():
    assert C.scan_objects('{"a":1}{"b":2}') == ([{"a": 1}, {"b": 2}], "")
    assert C.scan_objects('[{"a":"}\\"{"},{"b"') == ([{"a": '}"{'}], '{"b"')
    assert C.scan_objects("{bad}{\"c\":3}") == ([{"c": 3}], "")


def test_parse_cards(spark):
    card = {"title": "A title", "summary": "s", "details": "long enough details", "tags": ["t"], "type": "tech_principle", "language": "en", "confidence": 0.4}
    odd = card | {"type": "nope", "confidence": 5, "tags": "oops", "language": "xx"}
    whole = json.dumps([card, odd])
    rows = [(1, "p", whole), (2, "p", f"```json\n{whole}\n```"), (3, "p", whole[:-20]), (4, "p", "no json"), (5, "p", f"<think>[1]</think>{whole}"), (6, "p", json.dumps([card | {"title": "x"}])), (7, "p", None)]
    got = {}
    for r in C.parse_cards(spark.createDataFrame(rows, "request_id int, project_id string, raw string")).orderBy("seq").collect():
        got.setdefault(r.request_id, []).append(r)
    assert [len(got[i]) for i in (1, 2, 3, 5)] == [2, 2, 1, 2]
    assert got[4][0].issues == ["not an array"] == got[7][0].issues and got[6][0].card is None and "title" in got[6][0].issues[0]
    c = got[1][1].card
    assert (c.type, c.confidence, c.tags, c.language) == ("domain_fact", 1.0, [], "zh")


def keywords(text):
    out = set(re.findall("[a-z0-9]{2,}", text.lower()))
    for run in re.findall("[一-鿿]+", text):
        out |= {c for c in run if c not in "的 了 在 我 是 和 与".split()} | {run[i : i + 2] for i in range(len(run) - 1)}
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_dedup_cards_is_the_greedy_fold(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(14)] + ["缓存", "存层", "架构"]
    rows = [(i, f"p{i % 3}", " ".join(rng.sample(vocab, rng.randrange(0, 6))), " ".join(rng.sample(vocab, 2))) for i in range(90)]
    want = set()
    for p in ("p0", "p1", "p2"):
        kept = []
        for i, q, t, s in rows:
            k = keywords(t + s)
            if q == p and not any(k and o and len(k & o) / min(len(k), len(o)) > 0.65 for o in kept):
                kept.append(k)
                want.add(i)
    df = spark.createDataFrame(rows, "card_id long, project_id string, title string, summary string")
    assert {r.card_id for r in C.dedup_cards(df).collect()} == want
    same = spark.createDataFrame([(1, "p", "缓存架构设计", "x"), (2, "p", "缓存架构设计", "x"), (3, "p", "数据库索引", "y")], "card_id long, project_id string, title string, summary string")
    assert {r.card_id for r in C.dedup_cards(same).collect()} == {1, 3}


@pytest.mark.parametrize("parts", [1, 7])
def test_dedup_cards_follows_a_long_chain(spark, parts):
    rows = [(i, "p", " ".join(f"w{k}" for k in range(i, i + 5)), f"w{i + 5}") for i in range(300)]  # over 0.65 with the one before only
    df = spark.createDataFrame([*rows, (300, "q", "w1 w2 w3 w4 w5", "w6")], "card_id long, project_id string, title string, summary string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.card_id for r in C.dedup_cards(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    kept = []
    for i, _, t, u in rows:
        k = keywords(t + u)
        if not any(len(k & o) / min(len(k), len(o)) > 0.65 for _, o in kept):
            kept.append((i, k))
    assert got == {i for i, _ in kept} | {300}


def test_overlapping_pairs_meet_by_blocks_not_by_common_words(spark):
    """Cards that share common words only: what moves grows with cards and blocks, not with pairs; blocks of any size find the same pairs."""
    rng = random.Random(5)
    sets = [sorted({f"c{k}" for k in rng.sample(range(30), 9)} | {f"r{i // 2}x{k}" for k in range(20 if i % 100 < 2 else 6)}) for i in range(600)]
    df = spark.createDataFrame([(i % 3 // 2, i, k) for i, k in enumerate(sets)], "project_id int, o long, k array<string>")
    want = {(i, j) for j in range(600) for i in range(j) if i % 3 // 2 == j % 3 // 2 and len({*sets[i]} & {*sets[j]}) / min(len(sets[i]), len(sets[j])) > 0.65}
    for block in (8192, 100):
        pairs = C.overlapping_pairs(df, block=block)
        got = [(r.early, r.late) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want and want


@pytest.mark.parametrize("block", [40, 150, 1 << 16])
def test_dedup_cards_settles_block_by_block_and_writes_no_pairs(spark, monkeypatch, block):
    """Blocks of any size keep what the greedy fold keeps, and what is written grows with cards, not with the many pairs that overlap."""
    rng = random.Random(11)
    rows = [(i, f"p{i % 5 // 4}", " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 9))), "") for i in range(400)]
    words = [(p, {*t.split()}) for _, p, t, _ in rows]
    near = lambda a, b: len(a & b) / min(len(a), len(b)) > 0.65
    want, pairs = [], 0
    for i, (p, k) in enumerate(words):
        want += [i] if not any(q == p and near(k, o) for q, o in (words[j] for j in want)) else []
        pairs += sum(q == p and near(k, o) for q, o in words[:i])
    moved, write = [], C.written

    def counted(df):
        out = write(df)
        moved.append(out.count())
        return out

    monkeypatch.setattr(C, "written", counted)
    df = spark.createDataFrame(rows, "card_id long, project_id string, title string, summary string")
    assert sorted(r.card_id for r in C.dedup_cards(df, block=block).collect()) == want
    assert sum(moved) < 4 * len(rows) < pairs


def test_overlaps_of_sets_are_exact():
    """Few candidates at a time or many, few sets by all pairs or many: the same as comparing all."""
    rng = random.Random(4)
    sets = [sorted({f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.choice((2, 6, 40, 300)))}) for _ in range(300)]
    near = lambda a, b: len({*a} & {*b}) / min(len(a), len(b)) > 0.65
    t = pa.table({"o": list(range(300)), "t": [" ".join(k) for k in sets]})
    early, late = C._sets(t.slice(0, 150), t.slice(150))
    want = [any(near(a, b) for a in sets[:150]) for b in sets[150:]]
    assert all(C._covered(early, late, 0.65, most).tolist() == want for most in (1, 50, 1 << 19)) and 0 < sum(want) < 150
    kept = []
    for k in sets:
        kept.append(k if not any(o and near(k, o) for o in kept) else None)
    assert all(C._stays(*C._sets(t), 0.65, few).tolist() == [k is not None for k in kept] for few in (1, 20, 128))


def test_cards_move_without_whole_texts(spark, tmp_path):
    """Where the labels are too many to be broadcast, what the join shuffles of a document is the parts that are asked for."""
    text = "A title\n" + "x" * 3000
    spark.createDataFrame([(1, text, "en", "src0", 9), (2, "no line end", "de", "src1", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    cards = read(spark, str(tmp_path), "cards")
    assert sorted((r.card_id, r.title, r.summary, r.details) for r in cards.collect()) == [(1, "A title", text[:200], text[:2000]), (2,) + ("no line end",) * 3]
    plan = cards.select("card_id", "title", "summary")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert plan.index(join) < plan.index("substring(text") and "2000" not in plan


def test_dedup_cards_keeps_the_first_of_many_copies(spark):
    rows = [(i, "p", "one two three four", "five six") for i in range(2000)] + [(3000, None, "one two three four", "five six"), (3001, None, "one two three four", "five six")]
    df = spark.createDataFrame(rows, "card_id long, project_id string, title string, summary string")
    assert {r.card_id for r in C.dedup_cards(df).collect()} == {0, 3000, 3001}


def test_unique_filenames(spark):
    titles = ["卡片", "卡片 2", "卡片", "A", "a", "A", "a 2"]
    df = spark.createDataFrame([(i, "p", i, t) for i, t in enumerate(titles)], "card_id int, project_id string, place int, name string")
    got = {r.card_id: r.filename for r in C.unique_filenames(df).collect()}
    used, want = set(), []
    for t in titles:
        name, i = t, 2
        while name.lower() in used:
            name, i = f"{t} {i}", i + 1
        used.add(name.lower())
        want.append(name)
    assert [got[i] for i in range(len(titles))] == want


def test_exports_take_important_cards_from_three_on(spark):
    rows = [(i, "two", "domain_fact", i < 2) for i in range(26)] + [(100 + i, "three", "domain_fact", i < 3) for i in range(26)]
    got = C.select_export(spark.createDataFrame(rows, "card_id int, project_id string, type string, is_important boolean")).groupBy("project_id").count().collect()
    assert dict(map(tuple, got)) == {"two": 25, "three": 3}


def test_note_status(spark):
    notes_ = spark.createDataFrame([("p", str(i), ms) for i, ms in enumerate((1, 1, 10_500, 11_000, 5_000))], "project_id string, source_ref string, mtime_ms long")
    prior = spark.createDataFrame([("p", "1", None), ("p", "2", 10), ("p", "3", 10), ("p", "4", 10)], "project_id string, source_ref string, source_mtime long")
    got = {r.source_ref: r.status for r in C.note_status(notes_, prior).collect()}
    assert [got[str(i)] for i in range(5)] == ["new", "changed", "unchanged", "changed", "unchanged"]


def test_note_markdown(spark):
    df = spark.createDataFrame([(1, "t: x", "tt", "S", " D ", ["a b", "#c", "tt"], True, False, "P")], "card_id int, title string, type string, summary string, details string, tags array<string>, is_important boolean, user_verified boolean, project string")
    text = notes.note_markdown(df, "ns", "tool").first().content
    assert text.startswith('---\ntitle: "t: x"\ntype: tt\nimportant: true\nverified: false\nproject: P\ntags:\n  - ns\n  - tt\n  - a-b\n  - c\n')
    assert text.endswith("card_id: 1\n---\n\n# t: x\n\n> [!question] S\n\nD\n")


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, s * 1000, i) for i, s in enumerate((0, 40, 70, 110, 131))], "k int, ms long, id long")
    got = {r.id: r.anchor for r in U.rate_limit_fixed(df, 2, 60_000).collect()}
    assert [got[i] // 1000 for i in range(5)] == [0, 0, 70, 70, 131]


def test_sliding_counts_refused_hits(spark):
    rng = random.Random(0)
    rows = [(rng.randrange(3), rng.randrange(300), i) for i in range(200)]
    got = {r.id: (r.n, r.allowed, r.remaining) for r in U.rate_limit_sliding(spark.createDataFrame(rows, "k int, ms long, id long"), 3, 50).collect()}
    for k, ms, i in rows:
        n = sum(1 for a, b, j in rows if a == k and ms - 50 < b and (b, j) <= (ms, i))
        assert got[i] == (n, n <= 3, max(0, 3 - n))


def test_quota(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), t, t, rng.random() < 0.7) for t in range(80)]
    got = {r.id: (r.allowed, r.remaining) for r in U.quota_replay(spark.createDataFrame(rows, "user_id int, ms long, id long, ok boolean"), 10).collect()}
    used = {0: 0, 1: 0}
    for u, _, i, ok in rows:
        allowed = used[u] < 10
        used[u] += allowed and ok
        assert got[i] == (allowed, 10 - used[u])


def test_offline_grace(spark):
    day = E.DAY_MS
    cases = [[0, 3], [0, 10], [0, 5, 0], [0, 9, 1], [0, 4]]
    rows = []
    for u, days in enumerate(cases):
        rows.append((u, 0, 0, True, "active"))
        rows += [(u, i + 1, 1000 + d * day, False, None) for i, d in enumerate(days)]
    got = {(r.user_id, r.seq): r.days_left for r in E.offline_grace(spark.createDataFrame(rows, "user_id int, seq int, clock_ms long, online boolean, status string")).collect()}
    assert [got[u, len(d)] for u, d in enumerate(cases)] == [4, 0, 2, 0, 3] and got[0, 1] == 7 and got[0, 0] is None


def test_licences(spark):
    ts = datetime.fromisoformat
    rows = [(1, 1, "expired", ts("2024-05-01"), ts("2024-01-01"), None), (2, 1, "active", ts("2023-01-01"), ts("2023-01-01"), None), (3, 2, "active", None, ts("2023-01-01"), ts("2023-06-01")), (4, 2, "pending", ts("2025-01-01"), ts("2023-01-01"), None)]
    df = spark.createDataFrame(rows, "id int, user_id int, status string, activated_at timestamp, created_at timestamp, expires_at timestamp")
    got = {r.user_id: (r.id, r.claim) for r in E.best_licence(df, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert got == {1: (2, "active"), 2: (3, "expired")}


def test_dedup_segments(spark):
    rows = [(1, i, s * 1000, t) for i, (s, t) in enumerate([(0, "a"), (3, "a"), (5, "a"), (6, "b"), (7, "a"), (8, "a")])]
    got = Se.dedup_segments(spark.createDataFrame(rows, "session_id int, seq int, ms long, text string")).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, False, True, True, True, False]


def test_surveys_without_user_stay(spark):
    df = spark.createDataFrame([(1, None, "p", "d", 1), (2, None, "p", "d", 2), (3, "u", "p", "d", 3), (4, "u", "p", "d", 4), (5, "u", "p", "e", 5)], "id int, user_id string, project_id string, meeting_date string, submitted_at int")
    assert [r.accepted for r in E.dedup_surveys(df).orderBy("id").collect()] == [True, True, True, False, True]


def test_reviews():
    s = review.Schedule()
    due = []
    for g in (1, 2, 3, 4):
        x = review.Schedule()
        x.review(0, g)
        due.append(x.due)
    assert due == sorted(due)
    ms = 0
    for g in (3, 3, 3, 9, 1, 3, 3):
        s.review(ms, g)
        ms = s.due
    assert (s.reps, s.lapses, s.state) == (6, 1, "review") and s.due > s.last and 1 <= s.d <= 10


def test_replies_are_parsed_in_slices():
    """A task holds the cards of REPLIES replies, however many a batch has."""

    class Frame:
        dtypes = [("request_id", "int"), ("project_id", "string"), ("raw", "string")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    card = json.dumps([{"title": "A title", "summary": "s", "details": "long enough details"}])
    n = 2 * C.REPLIES + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(["p"] * n), pa.array([card] * n)], names=["request_id", "project_id", "raw"])
    got = list(C.parse_cards(Frame())(iter([batch])))
    assert [b.num_rows for b in got] == [C.REPLIES, C.REPLIES, 1] and [x for b in got for x in b.column(0).to_pylist()] == list(range(n))
