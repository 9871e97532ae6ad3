"""The kept index: batches, reruns, removals, compaction, and a search that skips, against plain Python."""

import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cardspark.operators import retrieval
from cardspark.operators.card_index import CardIndex, card_tokens
from cardspark.streaming import jobs

KIND = "card_id long, title string, summary string, details string, tags array<string>, scope string, updated_at long, removed boolean"
WEIGHTS = (3, 2, 1, 2)


def card(i, title, scope="=p", at=0, removed=False, details="d", tags=("x",)):
    return (i, title, f"about {title}", details, list(tags), scope, at, removed)


def counts(c):
    out, n = Counter(), 0
    for w, text in zip(WEIGHTS, (c[1], c[2], c[3], " ".join(c[4]))):
        for t in re.findall(r"[a-z0-9]+", text.lower()):
            out[t] += w
            n += 1
    return out, n


def brute(cards, tokens, scopes, k):
    of = {c[0]: counts(c) for c in cards}
    mean, score = sum(n for _, n in of.values()) / len(of), {}
    for t in tokens:
        df = sum(t in f for f, _ in of.values())
        idf = math.log((len(of) - df + 0.5) / (df + 0.5)) if df else 0
        for c in cards:
            f, n = of[c[0]]
            if t in f and (scopes is None or c[5] in scopes):
                score[c[0]] = score.get(c[0], 0) + (idf if idf > 0 else 1e-6) * f[t] * 2.2 / (f[t] + 1.2 * (0.25 + 0.75 * n / mean))
    return sorted(((round(-s, 6), i) for i, s in score.items()))[:k]


def found(index, spark, tokens, scopes, k):
    q = spark.createDataFrame([(1, list(tokens), list(scopes or []))], "query_id long, tokens array<string>, scopes array<string>")
    return sorted((round(-r.bm25, 6), r.card_id) for r in index.search(q, k, scoped=scopes is not None).collect())


def same(a, b):
    assert [i for _, i in a] == [i for _, i in b]
    assert all(abs(x - y) < 2e-6 for (x, _), (y, _) in zip(a, b))


def test_batches(spark, tmp_path):
    index = CardIndex(spark, str(tmp_path), part=4, seeds=1)
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    assert index.manifest() is None
    with pytest.raises(ValueError):
        index.cards()
    assert index.commit(1, frame([card(1, "alpha"), card(2, "beta"), card(3, "gamma", scope=None)]))
    assert index.commit(2, frame([card(1, "alpha"), card(2, "old", at=1), card(2, "delta", at=2), card(3, "x", removed=True), card(9, "y", removed=True)]))
    titles = lambda: {(r.card_id, r.token) for r in index.postings().where("f >= 3").collect()}
    assert titles() == {(1, "alpha"), (2, "delta")}  # card 1 is as it was, so it is not written again
    assert [r.segment for r in index.cards().orderBy("card_id").collect()] == ["segment-1", "segment-2"]
    before = index.manifest()
    assert not index.commit(2, frame([card(1, "other")])) and index.manifest() == before  # a batch that runs again
    os.makedirs(tmp_path / "segment-3")  # what a writer that died left is not there
    (tmp_path / "segment-3" / "junk").write_text("x")
    assert titles() == {(1, "alpha"), (2, "delta")}
    index.commit(3, frame([card(2, "delta"), card(5, "alpha")]), snapshot=True)
    assert titles() == {(2, "delta"), (5, "alpha")}
    index.commit(4, frame([]))
    assert titles() == {(2, "delta"), (5, "alpha")} and index.manifest()["n"] == 2
    index.commit(5, frame([card(2, "delta", scope="*")]))  # moved to another scope
    same(found(index, spark, ["delta"], ["*"], 9), brute([card(2, "delta", scope="*"), card(5, "alpha")], ["delta"], ["*"], 9))
    index.compact()
    assert len(index.manifest()["segments"]) == 1 and titles() == {(2, "delta"), (5, "alpha")}
    assert not index.commit(5, frame([card(2, "again")]))


def test_vectors_that_do_not_land_are_tried_again(spark, tmp_path):
    index = CardIndex(spark, str(tmp_path))
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    asked = []

    def embed(known):
        def run(changed):
            asked.append({r.card_id for r in changed.select("card_id").collect()})
            return changed.select("card_id", F.when(F.col("card_id").isin(known), F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"))

        return run

    rows = [card(1, "alpha"), card(2, "beta")]
    index.commit(1, frame(rows), embed=embed([1]))
    assert {r.card_id: r.hash is None for r in index.cards().collect()} == {1: False, 2: True}
    index.commit(2, frame(rows), embed=embed([1, 2]))
    index.commit(3, frame(rows), embed=embed([]))
    assert asked == [{1, 2}, {2}, set()] and {r.card_id for r in index.vectors().collect()} == {1, 2}
    index.commit(4, frame([card(1, "changed")]), embed=embed([]))
    assert {r.card_id for r in index.vectors().collect()} == {2}


def test_search_against_all_cards(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(rng.choice(words[: rng.choice((5, 20, 60))]) for _ in range(n))
    cards = {i: card(i, pick(3), rng.choice(["=a", "=b", "*"]), details=pick(rng.randrange(1, 30))) for i in range(300)}
    index = CardIndex(spark, str(tmp_path), part=8, seeds=2)
    index.commit(1, spark.createDataFrame(list(cards.values()), KIND))
    for batch in range(2, 5):
        for i in rng.sample(range(350), 60):
            cards[i] = card(i, pick(3), rng.choice(["=a", "=b", "*"]), details=pick(9))
        gone = rng.sample(sorted(cards), 20)
        index.commit(batch, spark.createDataFrame([*cards.values(), *(card(i, "", at=1, removed=True) for i in gone)], KIND))
        for i in gone:
            del cards[i]
    m = index.manifest()
    assert m["n"] == len(cards) and m["total"] == sum(counts(c)[1] for c in cards.values())
    asked = [(tokens, scopes) for tokens in (["w1", "w2", "w50"], ["w0"], ["w59", "w58", "absent"], [f"w{i}" for i in range(40)]) for scopes in (["=a", "*"], ["=c"])]
    q = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "query_id long, tokens array<string>, scopes array<string>")
    for k, scoped in ((1, True), (10, True), (500, True), (10, False)):
        got = {}
        for r in index.search(q, k, scoped).collect():
            got.setdefault(r.query_id, []).append((round(-r.bm25, 6), r.card_id))
        for i, (tokens, scopes) in enumerate(asked):
            same(sorted(got.get(i, [])), brute(list(cards.values()), tokens, scopes if scoped else None, k))


def test_search_skips_parts(spark, tmp_path, monkeypatch):
    """One part holds all cards that can be among the best: of the others only the heads are read."""
    rows = [card(i, "plain", "*", details="filler " * 40) for i in range(2000)] + [card(5000 + i, "plain plain plain", "=hot", details="plain") for i in range(20)]
    rows += [card(9000 + i, "other", "*") for i in range(3000)]
    index = CardIndex(spark, str(tmp_path), seeds=1)
    index.commit(1, spark.createDataFrame(rows, KIND))
    seen = []
    real = CardIndex._scored
    monkeypatch.setattr(CardIndex, "_scored", lambda self, blocks, asked, on, parts, *rest: seen.append(parts.count()) or real(self, blocks, asked, on, parts, *rest))
    got = found(index, spark, ["plain"], ["*", "=hot"], 10)
    assert {i for _, i in got} == set(range(5000, 5010)) and seen == [1, 1]


def test_stream(spark, tmp_path):
    index = CardIndex(spark, str(tmp_path / "i"))
    for rows in ([card(1, "alpha"), card(2, "beta")], [card(2, "gamma", at=1), card(1, "alpha", at=1, removed=True)]):
        spark.createDataFrame(rows, KIND).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_index(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), index, str(tmp_path / "ck")).awaitTermination()
    assert {(r.card_id, r.token) for r in index.postings().where("f >= 3").collect()} == {(2, "gamma")}


def test_marks_are_folded(spark):
    words = ["Élan", "naïve", "Ångström", "Ώρα", "йод", "Việt", "été", "ß", "ŁÓDŹ", "ﬁ"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(F.array_join(retrieval.index_tokens(F.col("w")), " ")).collect()] == ["elan", "naive", "angstrom", "ωρα", "иод", "viet", "ete", "ß", "łodz", "ﬁ"]


def test_search_meets_blocks_where_they_are_read(spark, tmp_path):
    """The asked tokens go to the tasks that read blocks; else the queries' one task could get all blocks and their hits."""
    index = CardIndex(spark, f"{tmp_path}/index")
    index.commit(1, spark.createDataFrame([card(i, f"alpha w{i}") for i in range(30)], KIND))
    q = spark.createDataFrame([(1, ["alpha", "w3"], ["=p"])], "query_id long, tokens array<string>, scopes array<string>").coalesce(1)
    plan = index.search(q, 5)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join Inner.*\(token#", x)]
    assert sum("rightHint=(strategy=broadcast)" in x for x in joins) >= 3  # heads, seeds, the rest


def test_search_shuffles_no_row_a_query_and_card(spark, tmp_path):
    """Scores are summed where a part's blocks meet the queries; whole cards, not rows a token, move when postings are made."""
    index = CardIndex(spark, f"{tmp_path}/index")
    index.commit(1, spark.createDataFrame([card(i, f"alpha w{i}") for i in range(30)], KIND))
    q = spark.createDataFrame([(1, ["alpha", "w3"], ["=p"])], "query_id long, tokens array<string>, scopes array<string>")
    plan = index.search(q, 5, scoped=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"Aggregate \[query_id#\d+L?, card_id#", plan)
    cards = spark.createDataFrame([card(1, "beta beta", details=None, tags=()), card(2, "", details="", tags=())], KIND)
    rows = card_tokens(cards.withColumn("summary", F.lit("beta x")), "intended", ["scope"])
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.card_id: (r.scope, r.len, {(x.token, x.f, x.tf) for x in r.tokens}) for r in rows.collect()}
    assert got == {1: ("=p", 4, {("beta", 8.0, 3), ("x", 2.0, 1)}), 2: ("=p", 2, {("beta", 2.0, 1), ("x", 2.0, 1)})}
