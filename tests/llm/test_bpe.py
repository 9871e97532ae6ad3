"""The automaton against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cardspark.llm import bpe

from .fixtures import documents, empty, frame, same

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, "rb") as f:
        return bpe.Automaton(f.read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def ids(automaton, text):
    import numpy as np

    return np.frombuffer(automaton.encode(text), "<u4").tolist()


def test_paths_are_the_librarys(automaton, theirs):
    rng = random.Random(1)
    texts = ["a" * n for n in range(1, 40)] + ["aaaab" * 9, "    x", "\n\n \t", "it's we'LL they've", "<|endoftext|>a<|endoftext|>", "x <|endoftext|> y", "Äöü 123456 ½ ¼x", "日本語テキスト", "🙂🙃 family 👨‍👩‍👧", "\x1c\x1d a\x85b c　d", "é" * 30]
    alphabet = "aaaabbcdeehinorstu  .,'\n0129ßéñ-=_*#" + "\t 中́"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("ethan ionsr") for _ in range(60)) for _ in range(1000)]
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert ids(automaton, t) == e.ids, t
        assert automaton.decode([automaton.encode(t)])[0].as_py() == theirs.decode(e.ids, skip_special_tokens=False)


def test_ids_that_are_no_text(automaton, theirs):
    rng = random.Random(2)
    for _ in range(200):
        some = [rng.randrange(256) for _ in range(6)]
        import numpy as np

        assert automaton.decode([np.array(some, "<u4").tobytes()])[0].as_py() == theirs.decode(some, skip_special_tokens=False)


def test_arcs_are_compiled_before_the_first_text(automaton):
    """Every state's lost arcs are sorted disjoint ranges, and an arc is missing just where a merge crosses the border."""
    assert automaton.first[-1] == len(automaton.table) > 1000
    rng = random.Random(4)
    live = sorted(automaton.live)
    for x in rng.sample(live, 300):
        borders = automaton.table[automaton.first[x] : automaton.first[x + 1]]
        assert list(borders) == sorted(set(borders)) and len(borders) % 2 == 0
    labels = automaton.label.to_pylist()
    seen = {True: 0, False: 0}
    for _ in range(4000):
        x, y = rng.choice(live), rng.choice(live)
        both = automaton.path(labels[x] + labels[y])
        assert automaton.arc(x, y) == (both == [x, y])
        seen[automaton.arc(x, y)] += 1
    assert min(seen.values()) > 100


def test_long_word(automaton, theirs):
    t = "abcx" * 20000
    assert ids(automaton, t) == theirs.encode(t).ids


def test_rows(spark, theirs):
    import hashlib

    import numpy as np

    rows = documents()
    want = []
    for r in rows:
        e = theirs.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    same(bpe.digests(bpe.decode(bpe.encode(frame(spark), PATH), PATH)).collect(), want)
    same(bpe.digests(bpe.round_trip(frame(spark), PATH)).collect(), want)
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0
