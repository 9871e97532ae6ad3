"""Documents with the awkward cases: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, line string, _s string, key string"


def documents(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["the", "of", "Tion", "ÄRGER", "ing", "and", "re", "x|y", "$$", "erst", "ñu", "fin."]
    line = "  A passage that Many documents share, to the letter ÄÖ  "
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) + str(rng.randrange(40)) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            text += "\n" + (line if i % 2 else line.upper().replace("ÄÖ", "ÄÖ")) + "\n" + text[:20] + "\n" + text[:20]
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None))
    rows += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \n\t ", "en", ""), (n + 3, "one", "en", "s1"), (None, rows[3][1], "en", "s2"), (None, None, None, None)]
    rows += [rows[5], rows[5], (n + 4, rows[7][1], "en", "s0"), (n + 5, "w " * 30000, "en", "s3"), (-7, "one", "de", "S1")]
    words = rows[8][1].split()
    if len(words) > 4:
        rows.append((n + 6, " ".join(words[:-1] + ["changed"]), "en", "s0"))
    return [(*r, len(r[1] or ""), 1, "line", "s", "k") for r in rows]


def frame(spark, rows=None, **how):
    return spark.createDataFrame(documents(**how) if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((x is not None, x if not isinstance(x, float) else round(x, 9)) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
