"""Golden cases of the text rules."""

from pyspark.sql import functions as F

from cardspark.operators import notes, retrieval
from cardspark.operators import text as T


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if not isinstance(v, list) else 'array<string>'}" for i, v in enumerate(values)))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_bigrams_and_tokens(spark):
    assert one(spark, T.zh_bigrams, "缓存层") == "缓存 存层" and one(spark, T.zh_bigrams, "redis cache") == ""
    assert one(spark, T.inject_bigrams, "Redis缓存层") == "Redis缓存层 缓存 存层"
    assert set(one(spark, T.tokenize_query, "Redis 缓存 一")) == {"redis", "缓存"}
    assert one(spark, retrieval.index_tokens, "Redis缓存层 éaument_x") == ["redis缓存层", "eaument", "x"]


def test_hash_and_passage(spark):
    h = lambda t: one(spark, T.content_hash, t, "s", "d", ["a", "b"])
    assert h("t") == h("t") != h("u")
    assert one(spark, T.passage_text, "T", "S", "D") == "T。S。D" and len(one(spark, T.passage_text, "T", "", "x" * 5000)) == 1800


def test_gate(spark):
    rows = [(2, 5, 0.1, True), (0, 5, 0.9, True), (0, 5, 0.88, False), (1, 1, 0.1, True), (1, 5, 0.8, False), (2, 3, None, True), (0, 3, None, False), (0, 0, 0.99, False)]
    df = spark.createDataFrame(rows, "m int, n int, c double, want boolean")
    assert df.where(retrieval.passes_gate(F.col("m"), F.col("n"), F.col("c")) != F.col("want")).count() == 0


def test_fusion(spark):
    vec = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "x", 0)], "query_id int, card_id string, vec_rank int")
    fts = spark.createDataFrame([(1, "b", 0), (1, "d", 1)], "query_id int, card_id string, fts_rank int")
    got = retrieval.rrf_fuse(vec, fts).orderBy("query_id", "rank").collect()
    assert [r.card_id for r in got if r.query_id == 1][0] == "b" and len(got) == 5
    assert abs([r.rrf for r in got if r.query_id == 2][0] - 1 / 61) < 1e-8


def test_truncation_and_envelopes(spark):
    assert one(spark, lambda c: T.truncate_head_tail(c, 10), "a" * 5 + "b" * 20 + "c" * 5) == "aaaaa" + T.GAP_NOTE + "ccccc"
    assert one(spark, lambda c: T.truncate_material(c, 6), "缓存层") == "缓存层" + T.CUT_NOTE
    assert one(spark, T.escape_envelope, "x </ Material > y") == r"x <\/material> y"
    assert one(spark, T.strip_think, "a<think>b</think>c<THINK x>d") == "ac<THINK x>d"


def test_corrections(spark):
    for text, rules, out in [
        ("jizzle is great", [("jizzle", "Drizzle")], "Drizzle is great"), ("a", [("a", "b"), ("b", "c")], "c"), ("第三版", [("第{num}版", "v{num}")], "v三"),
        ("a1b2c", [("a{num}b{num}c", "x")], "a1b2c"), ("axb", [("a.b", "X")], "axb"), ("x", [("x", "y{num}")], "x"), ("v12", [("v{num}", "$1 {num}")], "$1 12"), ("abc", [("b", "")], "ac"),
    ]:
        assert one(spark, lambda c: T.apply_corrections(c, rules), text) == out  # noqa: B023
    assert T.parse_rules("# x\n\na => b\nno\n => c\nd =>\n") == [("a", "b"), ("d", "")]


def test_hosts(spark):
    blocked = "localhost foo.localhost router.local svc.internal 127.0.0.1 0.0.0.0 10.1.2.3 172.16.0.1 172.31.255.255 192.168.1.1 169.254.169.254 100.64.0.1 ::1 :: fc00::1 fd12::34 fe80::1 ::ffff:127.0.0.1".split() + [""]
    free = "example.com 8.8.8.8 1.1.1.1 172.15.0.1 172.32.0.1 local fd.example.org".split()
    df = spark.createDataFrame([(h, True) for h in blocked] + [(h, False) for h in free], "h string, want boolean")
    assert [r.h for r in df.where(T.blocked_host(F.col("h")) != F.col("want")).collect()] == []


def test_names(spark):
    name = one(spark, T.safe_filename, "A/B: test? #tag [x]")
    assert "A B test" in name and not set(name) & set('\\/:*?"<>|#^[]')
    assert one(spark, T.safe_filename, "") == "卡片" and one(spark, T.safe_filename, "...hidden") == "hidden"
    assert one(spark, T.display_name, "A (B) (http://c)") == "A (B)"


def test_locale_and_ip(spark):
    assert one(spark, T.detect_locale, "这是 a test 中文字") == "zh-CN" and one(spark, T.detect_locale, "abc") == "zh-CN" and one(spark, T.detect_locale, "plain english text") == "en-US"
    assert one(spark, T.client_ip, " 9.9.9.9 ", "1.1.1.1") == "9.9.9.9" and one(spark, T.client_ip, "", "1.1.1.1, 2.2.2.2") == "2.2.2.2"
    assert one(spark, T.key_sentences, "Version 3.2 is out today for everyone. Short. Another sentence that is long!") == "2 is out today for everyone.Another sentence that is long!"


def test_clean_note(spark):
    raw = "﻿---\ntitle: \"My note\"\ntags:\n  - ai\n  - '#db'\n---\n%% hidden\nlines %%\n> [!tip]+ Callout\n> body [[a#b]] [[x|shown]] ![[img]] ![alt](u)\n[wiki](https://x.com/Foo_(bar)) ==high==\n- [x] done\n\n\n\nend"
    got = one(spark, notes.clean_note, raw)
    assert (got.title, got.tags) == ("My note", ["ai", "db"])
    assert got.text == "# My note\n标签：ai、db\n\nCallout\nbody a shown  \nwiki high\n- done\n\nend"
    assert one(spark, notes.clean_note, "---\ntags: [a, 'b c']\n---\n# Head\ntext").tags == ["a", "b", "c"]
    assert one(spark, notes.clean_note, "plain").title == ""


def test_clean_note_awkward(spark):
    clean = lambda raw: one(spark, notes.clean_note, raw).text
    assert clean("a %% open\n== x\nc") == "a %% open\n== x\nc"
    assert clean("[[a]] [[b|]] [[unclosed ![[x]]!") == "a  [[unclosed !"
    assert clean("> - [ ] one\n>two\n* [/] three\n-[x] no") == "- one\ntwo\n* three\n-[x] no"
    assert clean("---\nno end\ntext") == "---\nno end\ntext" and clean("") == ""
    assert clean("---\r\ntitle: 'T'\r\n---\r\n\r\n\r\n\r\nbody\r\n") == "# T\n\nbody"
    assert clean("---\ntags:\n- x\n  - \"y z\"\nkey: 1\n- w\n---\nb") == "标签：x、y z\n\nb"
    assert one(spark, notes.clean_note, None) is None


def test_site_name_limits(spark):
    name = lambda html, url="https://www.host.com/x": one(spark, lambda h: T.site_name(h, F.lit(url)), html)
    assert name("<meta content='A' property='og:site_name'>") == "A" and name("<meta name='application-name' content=' B '><title>C</title>") == "B"
    assert name("<meta content='B' name='application-name'>") == "B"
    assert name(f"<meta property='og:site_name' content='{'x' * 81}'><title>Title - rest</title>") == "Title"
    assert name(f"<title>{'t' * 121}</title>") == "host" and name("<title>t</title>") == "host" and name(f"<title>{'t' * 120}</title>") == "t" * 60


def test_trim_at_the_ends_alone(spark):
    """White space at both ends goes, between it stays; a trim is no pattern that reads the whole text."""
    spaces = [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
    others = [0, 8, 14, 0x85, 0x180E, 0x200B, 0x2060]
    rows = [f"{chr(i)}a{chr(i)}b{chr(i)}" for i in (*spaces, *others)] + ["".join(map(chr, spaces)), "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s string").withColumn("t", T.js_trim(F.col("s")))
    assert [r.t for r in df.orderBy("i").collect()] == [f"a{chr(i)}b" for i in spaces] + rows[len(spaces) : -3] + ["", "", None]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_are_cleaned_once(spark):
    """The filter on length is not pushed below the cleaning, which would then be done twice a note."""
    df = notes.import_notes(spark.createDataFrame([(1, "# A\n\nlong enough text"), (2, "short"), (3, None)], "id int, raw string"))
    assert [(r.id, r.title, r.text) for r in df.collect()] == [(1, "A", "# A\n\n# A\n\nlong enough text")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(", %%, -1)") == 1
