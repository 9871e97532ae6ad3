"""URL rules against plain Python, mined rules against counting."""

import random
import re
from collections import Counter
from itertools import combinations

from cardspark.llm import url_rules

from .fixtures import same

SCHEMA = "page_id long, url string, html string, host string, tokens string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:n], rest[n:]
    n = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:n]


def fixed(host, path):
    hits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(hits)[1:] if hits else (None, None)


def urls(n=400):
    rng = random.Random(4)
    out = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1", "a://b://c.com/x", "http://com/", "http://x.com", "http://xcom/", "http://x.com?/a#b", "http://x.net#/fr/", "http://ÄB.Net/fr/\nx?q"]
    for _ in range(n):
        host = rng.choice(["www.", "", "m."]) + rng.choice(["a.", "b.", ""]) + "example." + rng.choice(["com", "net", "org"])
        out.append(f"https://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randrange(999)}{rng.choice(['', '/', '.html', '?page=2&ref=x', '#top'])}")
    return out


def test_fixed_rules_and_rows(spark):
    rows = [(i, u, None, "h", "t") for i, u in enumerate(urls())] + [(None, "http://a.net/es/", None, "h", "t")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = url_rules.judge(df)
    assert got.columns == [*df.columns, "_url"]
    out = got.select("page_id", "url", "_url.*").collect()
    want = []
    for i, u, *_ in rows:
        host, path = parts(u)
        want.append((i, u, host, path, fixed(host, path)[0]))
    same([(r.page_id, r.url, r.host, r.path, r.rule) for r in out], want)
    for r in out:
        assert r.verdict == (fixed(r.host, r.path)[1] or r.verdict) and r.verdict in ("allow", "block")
        if r.mined:
            assert r.confidence >= url_rules.MIN_CONFIDENCE
    assert any(r.mined for r in out)
    assert url_rules.judge(df.where("false")).count() == 0


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(500):
        t = sorted(rng.sample("abcdefg", rng.randrange(1, 5)))
        rows.append((t, "block" if "c" in t and rng.random() < 0.95 else "allow"))
    support = lambda s, v=None: sum(1 for t, w in rows if s <= set(t) and v in (None, w))
    rules = {}
    for n in (1, 2, 3):
        for s in combinations("abcdefg", n):
            for v in ("allow", "block"):
                both = support(set(s), v)
                if both >= 25 and both / support(set(s)) >= 0.8:
                    rules[s, v] = both / support(set(s))
    want = [(s, v, c) for (s, v), c in rules.items() if not any(rules.get((tuple(x for x in s if x != y), v), 0) >= c for y in s)]
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8, 3)
    same([(tuple(r.left), r.verdict, r.confidence) for r in got.collect()], want)


def plain_tokens(url):
    host, path = parts(url)
    plain = lambda x: re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
    labels = host.split(".")
    query = re.search(r"\?([^#]*)", url or "")
    out = {"host:" + ".".join(labels[i:]) for i in range(len(labels))} | {"path:" + x for x in plain(path).split("/") if x}
    return frozenset(out | {"key:" + x.split("=")[0] for x in plain(query[1]).split("&") if x} if query else out)


def test_mined_verdicts_are_those_of_counting(spark):
    rows = [(i, u, None, "h", "t") for i, u in enumerate(urls(900))]
    known = [(plain_tokens(u), v) for _, u, *_ in rows if (v := fixed(*parts(u))[1])]
    alone, both = Counter(), Counter()
    for t, v in known:
        for n in (1, 2, 3):
            for s in combinations(sorted(t), n):
                alone[s] += 1
                both[s, v] += 1
    least = max(url_rules.MIN_SUPPORT * len(known), url_rules.MIN_PAGES)
    rules = {(s, v): n / alone[s] for (s, v), n in both.items() if n >= least and n / alone[s] >= url_rules.MIN_CONFIDENCE}
    best = [(c, both[s, v] / len(known), len(s), " ".join(s), v, set(s)) for (s, v), c in rules.items() if not any(rules.get((tuple(x for x in s if x != y), v), 0) >= c for y in s)]
    want = []
    for i, u, *_ in rows:
        hit = None if fixed(*parts(u))[1] else max((b for b in best if b[5] <= plain_tokens(u)), key=lambda b: b[:5], default=None)
        want.append((i, fixed(*parts(u))[1] or (hit[4] if hit else "allow"), hit[3] if hit else None))
    got = url_rules.judge(spark.createDataFrame(rows, SCHEMA)).select("page_id", "_url.verdict", "_url.mined").collect()
    same([tuple(r) for r in got], want)
    assert sum(w[2] is not None for w in want) > 100


def test_tokens_that_go_together_cost_one(spark):
    many = [f"path:{i:02d}" for i in range(40)]
    rows = [(sorted([*many, "key:x"] if i % 2 else many), "block") for i in range(60)] + [(["path:z"], "allow")] * 40
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"))
    same([(tuple(r.left), r.verdict, r.confidence) for r in got.collect()], [((x,), "block", 1.0) for x in [*many, "key:x"]] + [(("path:z",), "allow", 1.0)])
