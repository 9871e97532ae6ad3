"""Files in and out; streams equal their batch twins."""

import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from cardspark.functions import plugs
from cardspark.operators import questions as Q
from cardspark.operators import review
from cardspark.operators import usage as U
from cardspark.sources import io as S
from cardspark.streaming import jobs, state


def test_scan_notes(spark, tmp_path):
    for name, text in {"note1.md": "# one", "sub/note2.MD": "two", ".obsidian/x.md": "no", ".trash/y.md": "no", "image.png": "no", "empty.md": "", "a/b/c/d/e/f/g/h/i/deep.md": "no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.rel_path: (r.size_kb, r.raw) for r in S.scan_notes(spark, f"file:{tmp_path}").collect()}
    assert got == {"note1.md": (1, "# one"), "sub/note2.MD": (1, "two")}


def test_scan_many_notes(spark, tmp_path):
    """Small files share a task however many they are, also where the root is spelled file:/// (F22); a store's notes are the same."""
    want = {}
    for folder, n in (("", 3), ("a b%20/é", 300), ("_drafts", 2), ("1/2/3/4/5/6/7/8", 1), ("1/2/3/4/5/6/7/8/9", 1), ("a/node_modules", 1), ("a/.x", 1)):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (tmp_path / folder / f"n{i}.md").write_bytes(b"x" * (i + 1) + b"\xff\n")
            want[f"{folder}/n{i}.md".lstrip("/")] = i + 3
    for name, size in (("least.md", 0), ("most.md", 2**20), ("more.md", 2**20 + 1), (".hidden.md", 1), ("n.txt", 1)):
        (tmp_path / name).write_bytes(b"y" * size)
    want = {k: v for k, v in want.items() if "8/9" not in k and "node" not in k and "/.x" not in k} | {"most.md": 2**20}
    rows = S.scan_notes(spark, f"file://{tmp_path}/", most=None)
    got = {r.rel_path: (r.size, r.raw, r.mtime_ms) for r in rows.withColumn("raw", F.hex("raw")).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(bytes.fromhex(v[1]) == (tmp_path / k).read_bytes() and v[2] == (tmp_path / k).stat().st_mtime_ns // 10**6 for k, v in got.items())
    assert rows.rdd.getNumPartitions() <= 2
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.notes.link./in", f"file://{tmp_path}")
    stored = S.scan_notes(spark, "viewfs://notes/in", most=None).withColumn("raw", F.hex("raw"))
    assert {r.rel_path: (r.size, r.raw, r.mtime_ms) for r in stored.collect()} == {k: v for k, v in got.items() if not k.startswith("_")}
    assert [r.rel_path for r in S.scan_notes(spark, str(tmp_path), most=2).collect()] == sorted(want)[:2]


def test_files_of_given_names(spark, tmp_path):
    (tmp_path / "mine.md").write_text("stay")
    files = spark.createDataFrame([("a/b.md", "one"), ("c.md", None), ("a/b2.md", "é\n")], "rel_path string, content string")
    for _ in range(2):  # a second run writes the same
        S.write_files(files, f"file:{tmp_path}")
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"mine.md": "stay", "a/b.md": "one", "c.md": "", "a/b2.md": "é\n"}


def test_archives(spark):
    def pack(files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)
        return b.getvalue()

    deck = {f"ppt/slides/slide{i}.xml": f"<a:t>slide</a:t><a:t>{i} words</a:t>" for i in (1, 2, 10)}
    rows = [("a.zip", pack({"x.md": "hi", "y.exe": "no"})), ("b.pptx", pack(deck)), ("c.pptx", pack({"ppt/slides/slide1.xml": ""})), ("d.zip", b"junk")]
    got = {r.path: r for r in S.archive_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.zip"].text == "### x.md\nhi\n" and got["b.pptx"].text == "slide 1 words\nslide 10 words\nslide 2 words"
    assert got["c.pptx"].error and got["d.zip"].error


def test_speech_events_and_segments(spark, tmp_path):
    events = [("listening", None), ("interim", "ab"), ("interim", "abc"), ("endpoint", None), ("interim", "abcdef"), ("final", "abcdefg")]
    lines = [json.dumps({"session_id": "s", "seq": i, "ts": f"2024-01-01T00:00:{i:02d}Z", "type": t, "text": x}) for i, (t, x) in enumerate(events)] + ["not json", "{}"]
    (tmp_path / "e.json").write_text("\n".join(lines))
    rows = S.speech_events(spark, str(tmp_path))
    assert rows.count() == 6 and {r.role for r in rows.collect()} == {"self"}
    timed = rows.withColumn("ms", F.unix_millis("ts"))
    want = [(3, "abc"), (5, "defg")]
    assert sorted((r.seq, r.text) for r in state.fold_batch(timed, "session_id", state.Segmenter).collect()) == want
    stream = S.speech_events(spark, str(tmp_path), streaming=True).withColumn("ms", F.unix_millis("ts"))
    got = jobs.run_once(state.fold_stream(stream, "session_id", state.Segmenter, "1 second"))
    assert sorted((r.seq, r.text) for r in got.collect()) == want


def test_pause_commits():
    s = state.Segmenter()
    out = [s.take(ms, i, k, t) for i, (ms, k, t) in enumerate([(0, "listening", None), (0, "interim", "one"), (2000, "interim", "one two"), (2100, "listening", None), (2200, "interim", "three")])]
    assert [x for o in out for x in o] + s.close() == [(1, "one"), (3, " two"), (4, "three")]


def test_stream_limits_equal_batch(spark, tmp_path):
    rows = [(i % 3, i, BASE + i * 7919 % 5000) for i in range(200)]
    spark.createDataFrame(rows, "k int, id long, ms long").withColumn("ts", F.timestamp_millis("ms")).write.parquet(str(tmp_path / "hits"))
    df = spark.read.parquet(str(tmp_path / "hits"))
    want = {r.id: r.n for r in U.rate_limit_sliding(df, 3, 500).collect()}
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "hits")).select("ts", "k", "ms", F.col("id").alias("seq"), F.lit(3).alias("most"), F.lit(500).alias("window_ms"))
    got = {r.seq: r.n for r in jobs.run_once(state.fold_stream(s, "k", state.Limiter, "1 hour")).collect()}
    assert got == want


def test_stream_questions_equal_batch(spark, tmp_path):
    said = ["what is your stack", "and how about scaling", "plain words here", "tell me about it", "and how about scaling", "and how about scaling", "ok so why", "那缓存呢"]
    spark.createDataFrame([(k, i, BASE + i * 5000, t) for k in range(3) for i, t in enumerate(said[k:])], "session_id int, seq int, ms long, text string").withColumn("ts", F.timestamp_millis("ms")).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    want = {(r.session_id, r.seq): (r.q_type, r.q_text) for r in Q.classify_session(df).collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = {(r.session_id, r.seq): (r.q_type, r.q_text) for r in jobs.run_once(jobs.stream_questions(stream)).collect()}
    assert got == want


def chunked(text, size):
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def test_reader_gives_cards_as_they_close():
    card = lambda t: json.dumps({"title": t, "details": "long enough details"})
    text = "<think>{}</think>[" + card("aa") + "," + card("bb") + "," + card("aa") + ',{"tit'
    r = state.CardReader()
    out = [x for i, c in enumerate(chunked(text, 7)) for x in r.take(i, i, c, False)]
    assert [t for _, t, _ in out] == ["aa", "bb"]
    assert r.close() == []


def test_chunks_do_not_matter():
    """Every way to cut a reply gives what the whole one gives, and the last chunk tries to close what is open, once."""
    card = lambda t, **k: json.dumps({"title": t, "details": 'a "quoted} {" \\\\ text', **k}, ensure_ascii=False)
    replies = {
        f"[{card('aa')},{card('bb')},{card('aa')}]": ["aa", "bb"],
        card("aa") + card("cc")[:-1]: ["aa", "cc"],  # the closing brace is missing
        card("aa") + card("cc")[:-9]: ["aa"],  # more is missing
        "<thi" + card("aa") + "<THINK x=1>{" + card("no") + "</think>" + card("bb"): ["aa", "bb"],
        card("aa", tags=["<think>"])[:20] + "<think>x{</think>" + card("aa", tags=["<think>"])[20:]: ["aa"],  # the tag in the string opens a block that never ends, so it is text at the end
        "<think>" + card("aa"): ["aa"],  # a block that never ends is read at the end
        "<think" + card("aa"): ["aa"],
        "<think a>} { </think" + card("bb"): [],
        "{bad}" + card("aa") + '{"x": {"y": "{"}}' + card("bb"): ["aa", "bb"],
        "}}" + card("aa") + "<": ["aa"],
        "": [],
        "plain < text": [],
    }
    for text, want in replies.items():
        for size in (1, 2, 3, 5, 7, 11, 10**6):
            r, out = state.CardReader(), []
            parts = chunked(text, size)
            for i, c in enumerate(parts):
                r2 = state.CardReader()
                r2.load(r.dump())
                r = r2
                out += r.take(i, i, c, i == len(parts) - 1)
            assert [t for _, t, _ in out] == want and r.over, (text, size)


def test_each_character_is_read_once(monkeypatch):
    """A long reply in small chunks: what is kept between them is the open object, not what is done."""
    r, text = state.CardReader(), "".join(json.dumps({"title": f"t{i}", "details": "x" * 50}) for i in range(300))
    for i, c in enumerate(chunked(text, 5)):
        r.take(i, i, c, False)
        assert sum(map(len, r.scan.parts)) < 100 and len(r.scan.held) < 8
    assert len(r.titles) == 300


def test_packs_give_what_their_chunks_give():
    """A row of many chunks is told apart again: each card comes with the seq of the chunk in which its object closes."""
    card = lambda t: json.dumps({"title": t, "details": "long enough details é"}, ensure_ascii=False)
    text = "<think>{}</think>[" + card("aa") + ", <t" + card("bb") + "," + card("aa") + ', ' + "<think> " + card("cc")[:-1] + " "
    parts = re.split("(?<= )", text)
    one, want = state.CardReader(), []
    for i, c in enumerate(parts):
        want += one.take(5, 10 + i, c, i == len(parts) - 1)
    assert [t for _, t, _ in want] == ["aa", "bb", "cc"] and want[0][0] < want[1][0] < 9 + len(parts)
    for size in (1, 2, 3, 7, 100):
        r, out = state.CardReader(), []
        for at in range(0, len(parts), size):
            pack = parts[at : at + size]
            out += r.take(5, 10 + at, "".join(pack), at + size >= len(parts), [len(c) for c in pack])
        assert out == want and r.over and r.seq == one.seq, size


def run_all(stream, spark, root):
    """A stream to its end, in memory: its rows and how many states are left."""
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(stream.schema).parquet(f"{root}/out"), left[-1]


BASE = 10**12  # a time after the epoch, at which watermarks begin


def feed(spark, root, kind, *batches, base=BASE):
    """A stream of files, one batch each, with event times from ms after the base."""
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{root}/in").withColumn("ms", F.col("ms") + base).withColumn("ts", F.timestamp_millis("ms"))


def test_states_end(spark, tmp_path):
    """Once the watermark is past them, no state of these keys is left: windows run out, sessions stop or fall silent."""
    hits = feed(spark, tmp_path / "a", "k int, seq long, ms long, most int, window_ms long", [(i % 5, i, i * 10, 3, 500) for i in range(50)], [(9, 99, 10**7, 3, 500)], [(9, 100, 2 * 10**7, 3, 500)])
    rows, left = run_all(state.fold_stream(hits, "k", state.Limiter, "1 second"), spark, tmp_path / "a")
    assert rows.count() == 52 and left <= 1
    said = "session_id int, seq long, ms long, text string, stop boolean"
    talk = feed(spark, tmp_path / "b", said, [(k, 1, 1000 * k, "what is it", False) for k in range(4)], [(k, 2, 5000, "", True) for k in range(3)])
    rows, left = run_all(jobs.stream_questions(talk, watermark="1 minute"), spark, tmp_path / "b")
    assert rows.count() == 4 and left == 1  # the one that has not stopped
    silent = feed(spark, tmp_path / "c", said, [(1, 1, 0, "what is it", False)], [(2, 2, 10**8, "what is it", False)], [(2, 3, 10**8 + 1, "and how", False)])
    rows, left = run_all(jobs.stream_questions(silent, watermark="1 minute"), spark, tmp_path / "c")
    assert left == 1
    kind = "request_id int, seq long, ms long, chunk string, last boolean"
    text = json.dumps({"title": "aa", "details": "long enough details"})
    replies = feed(spark, tmp_path / "d", kind, [(1, 1, 1, text[:30], False), (2, 1, 1, text, True)], [(1, 2, 2, text[30:-1], True)])
    rows, left = run_all(state.fold_stream(replies, "request_id", state.CardReader, "1 second"), spark, tmp_path / "d")
    assert {(r.request_id, r.seq, r.title) for r in rows.collect()} == {(1, 2, "aa"), (2, 1, "aa")} and left == 0


@pytest.mark.parametrize("buckets", [1, 5])
def test_keys_that_share_a_call_keep_their_own_states(spark, tmp_path, buckets):
    """Many short replies over three batches and a key of null: what each key on its own gives, with no more calls and states than buckets; silent ones end."""
    card = lambda t: json.dumps({"title": t, "details": "long enough details"})
    kind = "request_id int, seq long, ms long, chunk string, last boolean, sizes array<int>"
    whole = [(k if k < 39 else None, 3 * i, i * 10_000 + k, c, i == 2, [5, 6, len(c) - 11]) for k in range(40) for i, c in enumerate((card(f"a{k}") + card("bb")[:20], card("bb")[20:] + card(f"c{k}")[:30], card(f"c{k}")[30:]))]
    want = state.fold_batch(spark.createDataFrame(whole, kind), "request_id", state.CardReader)
    silent = (77, 0, 0, card("aa")[:-1], False, [4, 4, 43])
    cuts = [[r for r in whole if a <= r[2] < a + 10_000] for a in (0, 10_000, 20_000)]
    for cut in ([*cuts[0], silent], cuts[1], cuts[2], [(78, 0, 2 * state.IDLE_MS, card("zz"), True, None)], [(79, 0, 2 * state.IDLE_MS + 1, "", True, None)]):
        stream = state.fold_stream(feed(spark, tmp_path, kind, cut), "request_id", state.CardReader, "1 minute", buckets=buckets)
        got, left = run_all(stream, spark, tmp_path)
        assert left <= buckets
    end = [(77, 2, "aa", "domain_fact"), (78, 0, "zz", "domain_fact")]
    assert sorted(map(tuple, got.where("request_id is not null").collect())) == sorted([*map(tuple, want.where("request_id is not null").collect()), *end]) and left == 0
    assert got.where("request_id is null").count() == want.where("request_id is null").count() == 3
    assert dict(got.dtypes)["request_id"] == "int"


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    """ST1: a stream that is stopped in mid-session and started again commits what the batch fold does, pauses included."""
    rng = random.Random(7)
    rows = {k: [] for k in range(6)}
    for k, out in rows.items():
        text, ms = "", 0
        for i in range(40):
            ms += rng.choice((100, 400, 1400, 1500, 2500))
            kind = rng.choice(("listening", "interim", "interim", "interim", "final", "endpoint"))
            text = text + f" w{i}" if kind in ("interim", "final") else ""
            out.append((k, i, ms, kind, text))
        out.append((k, 99, ms + 5000, "stop", None))
    rows[9] = [(9, 0, 10**7, "listening", None), (9, 1, 2 * 10**7, "listening", None)]
    kind = "session_id int, seq long, ms long, type string, text string"
    whole = [r for x in rows.values() for r in x]
    want = state.fold_batch(spark.createDataFrame(whole, kind), "session_id", state.Segmenter)
    cuts = [[r for r in whole if a <= r[2] < b] for a, b in ((0, 20_000), (20_000, 40_000), (40_000, 10**9))]
    for cut in cuts:  # each run of the stream ends, and the next goes on from its checkpoint
        got, left = run_all(state.fold_stream(feed(spark, tmp_path, kind, cut), "session_id", state.Segmenter, "0 seconds"), spark, tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and left <= 1


def test_two_halves_of_reviews_are_one(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((BASE + rng.randrange(10**10), i, rng.randrange(12), rng.randrange(0, 5)) for i in range(300))
    kind = "ms long, seq long, card_id int, rating int"
    want = {r.card_id: r for r in review.review_cards(spark.createDataFrame(rows, kind)).collect()}
    review.review_cards(spark.createDataFrame(rows[:150], kind)).write.parquet(str(tmp_path / "known"))
    late = feed(spark, tmp_path, kind, rows[150:220], rows[220:], base=0)
    got, _ = run_all(jobs.stream_reviews(late, spark.read.parquet(str(tmp_path / "known")), "30 days"), spark, tmp_path)
    last = {r.card_id: r for r in got.orderBy("seq").sort("last_review", "reps").collect()}
    assert got.count() == 150
    for k, r in last.items():
        assert (r.state, r.reps, r.lapses, r.last_review, r.due) == tuple(want[k][c] for c in ("state", "reps", "lapses", "last_review", "due"))
        assert abs(r.stability - want[k].stability) < 1e-4 and abs(r.difficulty - want[k].difficulty) < 1e-4


def test_write_notes_keeps_other_files(spark, tmp_path):
    (tmp_path / "mine.txt").write_text("stay")
    S.write_notes(spark.createDataFrame([("p", "n1", "text\nmore")], "project string, filename string, content string"), str(tmp_path))
    assert (tmp_path / "mine.txt").read_text() == "stay"
    files = list((tmp_path / "project=p" / "filename=n1").glob("part-*"))
    assert [f.read_text() for f in files] == ["text\nmore\n"]


def test_plugs(spark):
    df = spark.createDataFrame([(1, "some words"), (2, ""), (3, "some words")], "id int, t string")
    got = {r.id: r.embedding for r in plugs.embed_passages(df, "id", "t", plugs.hashing_embedder(16), prefix="").collect()}
    assert got[2] is None and got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-9
    assert {r.raw for r in plugs.ask(df, "id", "t", lambda ts: [t.upper() for t in ts]).collect()} == {"SOME WORDS", ""}


def test_folds_give_no_empty_frames(spark, monkeypatch):
    """A key without rows to give out makes no frame, and a key's rows are taken in order of ms and seq, nulls last."""
    taken = []

    class Probe(state.Step):
        columns, output = ("ms", "seq", "text"), "seq long, text string"

        def take(self, *row):
            taken.append(row)
            return [(row[1], row[2])] if row[2] == "x" else []

    class Frame:  # what fold_stream hands to Spark, kept
        def withWatermark(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, run, *_):
            self.run = run
            return self

    class State:
        exists = hasTimedOut = False

        def update(self, _):
            pass

    import pandas as pd

    frame = Frame()
    monkeypatch.setattr(state, "_schema", lambda *_: "k long, seq long, text string")
    run = state.fold_stream(frame, "k", Probe, "0 seconds").run
    part = lambda *rows: pd.DataFrame(rows, columns=["ms", "seq", "text"])
    assert list(run((1,), iter([part((2, 1, "a"))]), State())) == []
    taken.clear()
    (got,) = run((1,), iter([part((2, 1, "a"), (None, 0, "b")), part((1, 5, "x"), (2, 0, None))]), State())
    assert got.values.tolist() == [[1, 5, "x"]] and [r[2] for r in taken] == ["x", None, "a", "b"]
