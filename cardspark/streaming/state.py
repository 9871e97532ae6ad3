"""Stateful streams by key (ST1, ST2, ST3, ST6), each with a batch twin that folds the same steps over ordered rows.

A step class holds one key's state: `take(row)` returns the rows that an input row makes, `close()` those that are due after a
pause or at the end, `dump()` and `load()` turn the state to and from a string. `over` says that a row has ended the key;
`until()` is the event time in ms from which the state is of no more use. Streams drop a state then, so that they hold only
keys that live; batch twins start anew at the same rows.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.folds import fold_sorted
from ..operators.cards import check_card
from ..operators.review import Schedule

IDLE_MS = 3_600_000  # a session without rows for so long has ended


class Step:
    columns: tuple[str, ...] = ()  # read, in order; the first two are ms and seq
    more: tuple[str, ...] = ()  # read after them, if they are there
    output = ""
    pause_ms = 0

    over = False

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    def load(self, text: str) -> None:
        self.__dict__.update(json.loads(text))

    def take(self, *row) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> list[tuple]:
        return []

    def until(self) -> int | None:
        return None


class _Life:
    """A key's steps, one after the other: a step that is over, or whose time has run out when a row comes, makes room for a new one."""

    def __init__(self, step: type[Step]):
        self.step, self.now = step, None

    def take(self, *row) -> list[tuple]:
        out = []
        if self.now and (end := self.now.until()) is not None and row[0] >= end:
            out, self.now = self.now.close(), None
        self.now = self.now or self.step()
        out += self.now.take(*row)
        if self.now.over:
            self.now = None
        return out

    def close(self) -> list[tuple]:
        return self.now.close() if self.now else []


class Segmenter(Step):
    """ST1: cumulative interim and final texts to segments; the pending tail is committed by a final, an endpoint, a pause, or a new sub-session."""

    columns, output, pause_ms = ("ms", "seq", "type", "text"), "seq long, text string", 1500

    def __init__(self):
        self.interim, self.done, self.at, self.seq, self.armed, self.begun, self.last = "", 0, 0, 0, False, False, 0

    def _tail(self, text: str, seq: int) -> list[tuple]:
        part = text[self.done :]
        return [(seq, part)] if part.strip() else []

    def _commit(self, seq: int) -> list[tuple]:
        out = self._tail(self.interim, seq)
        self.done, self.armed = (len(self.interim) if out else self.done), False
        return out

    def take(self, ms, seq, kind, text):
        out = self._commit(self.seq) if self.armed and ms - self.at >= self.pause_ms else []
        if kind == "listening":
            out += self._commit(seq) if self.begun else []
            self.interim, self.done, self.armed, self.begun = "", 0, False, True
        elif kind == "interim":
            self.interim, self.at, self.seq, self.armed = text or "", int(ms), int(seq), bool(text)
        elif kind == "final":
            out += self._tail(text or "", seq)
            self.interim, self.done, self.armed = "", 0, False
        elif kind in ("endpoint", "stop"):
            out += self._commit(seq)
            self.over = kind == "stop"
        self.last = int(ms)
        return out

    def close(self):
        return self._commit(self.seq) if self.armed else []

    def until(self):
        return self.last + IDLE_MS


class Limiter(Step):
    """ST3: hits in a sliding window, refused ones too. The state is the window's hits; it ends with the window of the last one."""

    columns, output = ("ms", "seq", "most", "window_ms"), "seq long, n long, allowed boolean"

    def __init__(self):
        self.hits, self.window = [], 0

    def take(self, ms, seq, most, window_ms):
        self.hits = [x for x in self.hits if x > ms - window_ms] + [int(ms)]
        self.window = int(window_ms)
        return [(seq, len(self.hits), len(self.hits) <= most)]

    def until(self):
        return self.hits[-1] + self.window


class ObjectScanner:
    """Outermost {..} objects of a text that comes in chunks, each character read once: what is kept between chunks is where the
    scan stands (in a think block, in an object and how deep, in a string, after a backslash) and the open object's text.

    Think blocks go; while one is open nothing is read on, so that its braces are not taken for objects.
    """

    _open, _close = re.compile(r"(?i)<think"), re.compile(r"(?i)</think>")
    _cut = re.compile(r"(?i)<(?:t(?:h(?:i(?:n)?)?)?)?$"), re.compile(r"(?i)<(?:/(?:t(?:h(?:i(?:n(?:k)?)?)?)?)?)?$")
    _outside, _inside, _quoted = re.compile(r"\{"), re.compile(r'["{}]'), re.compile(r'["\\]')

    def __init__(self):
        self.held, self.tag, self.think = "", False, []  # the end of a chunk that may begin a tag; in an opening tag; the open block
        self.depth, self.quoted, self.escaped, self.parts = 0, False, False, []

    def feed(self, text: str) -> list[tuple]:
        """The objects that close in the text, each with how far into it."""
        before = len(self.held)
        text, self.held, at, found = self.held + text, "", 0, []
        while at < len(text):
            if self.tag:  # from `<think` to `>`
                end = text.find(">", at)
                self.think.append(text[at:] if end < 0 else text[at : end + 1])
                self.tag, at = end < 0, len(text) if end < 0 else end + 1
            elif self.think:
                m = self._close.search(text, at)
                if m:
                    self.think, at = [], m.end()
                    continue
                cut = self._cut[1].search(text, at)
                self.think.append(text[at : cut.start() if cut else len(text)])
                self.held, at = text[cut.start() :] if cut else "", len(text)
            else:
                m = self._open.search(text, at)
                cut = None if m else self._cut[0].search(text, at)
                stop = m.start() if m else cut.start() if cut else len(text)
                found += [(o, at + end - before) for o, end in self._scan(text[at:stop])]
                if m:
                    self.tag, self.think, at = True, [m.group()], m.end()
                else:
                    self.held, at = text[stop:], len(text)
        return found

    def _scan(self, text: str) -> list[tuple]:
        found, at, start = [], 0, 0
        while at < len(text):
            if self.escaped:
                self.escaped, at = False, at + 1
                continue
            m = (self._quoted if self.quoted else self._inside if self.depth else self._outside).search(text, at)
            if not m:
                break
            c, at = m.group(), m.end()
            if c == "\\":
                self.escaped = True
            elif c == '"':
                self.quoted = not self.quoted
            elif c == "{":
                start = start if self.depth else m.start()
                self.depth += 1
            else:
                self.depth -= 1
                if not self.depth:
                    try:
                        found.append((json.loads("".join(self.parts) + text[start:at]), at))
                    except ValueError:
                        pass
                    self.parts = []
        if self.depth:
            self.parts.append(text[start:])
        return found

    def close(self) -> list:
        """The end: what was held back counts as text, and an object that is still open is tried once with a closing brace."""
        rest, self.held, self.tag, self.think = "".join(self.think) + self.held, "", False, []
        return [o for o, _ in self._scan(rest + "}")]


class CardReader(Step):
    """ST6: chunks of a reply to cards, each as soon as its object closes; a title counts once; the last chunk is marked and closes the reply.

    A row may be a pack of chunks that came together: seq is the first one's, chunk all texts as one, and `sizes` their lengths. It is
    scanned as one text, since cuts make no difference to what is found; where an object ends tells its chunk.
    """

    columns, more, output = ("ms", "seq", "chunk", "last"), ("sizes",), "seq long, title string, type string"

    def __init__(self):
        self.scan, self.titles, self.at, self.seq = ObjectScanner(), {}, 0, 0

    def dump(self):
        return json.dumps([self.scan.__dict__, list(self.titles), self.at, self.seq])

    def load(self, text):
        scan, titles, self.at, self.seq = json.loads(text)
        self.scan.__dict__.update(scan)
        self.titles = dict.fromkeys(titles)

    def _cards(self, objects: list[tuple]) -> list[tuple]:
        out = []
        for o, seq in objects:
            card, _ = check_card(o)
            if card and card["title"] not in self.titles:
                self.titles[card["title"]] = None
                out.append((seq, card["title"], card["type"]))
        return out

    def take(self, ms, seq, chunk, last, sizes=None):
        found, ends = self.scan.feed(chunk or ""), [] if sizes is None else list(accumulate(sizes[:-1]))
        self.at, self.seq, self.over = int(ms), int(seq) + len(ends), bool(last)
        return self._cards([(o, int(seq) + bisect_left(ends, end)) for o, end in found]) + (self.close() if last else [])

    def close(self):
        return self._cards([(o, self.seq) for o in self.scan.close()])

    def until(self):
        return self.at + IDLE_MS


class Asker(Step):
    """ST2's memory: the last accepted segment (repeats within four seconds are dropped) and the last question's text, until the session stops."""

    columns, output = ("ms", "seq", "said", "text", "q_type", "q_text", "p_type", "p_text", "follows", "stop"), "seq long, q_type string, q_text string"

    def __init__(self):
        self.prior, self.said, self.at, self.last = "", None, 0, 0

    def take(self, ms, seq, said, text, q_type, q_text, p_type, p_text, follows, stop):
        self.last, self.over = int(ms), bool(stop)
        if stop or (said == self.said and ms - self.at < 4000):
            return []
        self.said, self.at = said, int(ms)
        if self.prior:
            q_type, q_text = ("follow_up", f"{self.prior}，{text}"[:200]) if follows else (p_type, p_text)
        if q_type:
            self.prior = q_text[:100]
        return [(seq, q_type or None, q_text or None)]

    def until(self):
        return self.last + IDLE_MS


class Reviewer(Step):
    """ST7: a card's schedule after each review; it goes on from the schedule that the first row brings along, if any."""

    columns = ("ms", "seq", "rating", "known")
    output = "seq long, state string, stability double, difficulty double, reps long, lapses long, last_review long, due long"

    def __init__(self):
        self.schedule = None

    def dump(self):
        return json.dumps({k: v for k, v in self.schedule.__dict__.items() if k != "w"})

    def load(self, text):
        self.schedule = Schedule()
        self.schedule.__dict__.update(json.loads(text))

    def take(self, ms, seq, rating, known):
        if self.schedule is None:
            self.schedule = Schedule()
            if known:
                k = json.loads(known)
                self.schedule.__dict__.update({"state": k["state"], "s": k["stability"], "d": k["difficulty"], "reps": k["reps"], "lapses": k["lapses"], "last": k.get("last_review"), "due": k.get("due")})
        self.schedule.review(int(ms), rating)
        return [(seq, *self.schedule.row())]


def _schema(df: DataFrame, key: str, step: type[Step]) -> str:
    return f"{key} {dict(df.dtypes)[key]}, {step.output}"


def _columns(df: DataFrame, step: type[Step]) -> list[str]:
    return [*step.columns, *[c for c in step.more if c in df.columns]]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def fold_batch(df: DataFrame, key: str, step: type[Step]) -> DataFrame:
    """The batch twin: each key's rows in order of ms and seq."""
    return fold_sorted(df, key, ["ms", "seq"], _columns(df, step), lambda: _Life(step), _schema(df, key, step))


def fold_stream(df: DataFrame, key: str, step: type[Step], watermark: str, ts: str = "ts", buckets: int | None = None) -> DataFrame:
    """The stream: state per key as a string; where a step waits for a pause, an event-time timer stands for it, and another
    one drops the state when it is of no more use.

    df needs the event time ts; rows of a key are taken in order within each micro-batch; late rows are dropped.
    Where keys are many and soon over, a call a key costs more than its rows: with `buckets`, keys of a hash share a call, a state
    string (of those that live) and a timer. Their number stays for the life of a checkpoint.
    """
    schema = _schema(df, key, step)
    ends = step.until is not Step.until or step.pause_ms > 0
    columns = _columns(df, step)

    def due(now: Step) -> int | None:
        times = [now.at + step.pause_ms] if step.pause_ms and now.armed else []
        return min(times + [end for end in [now.until()] if end is not None], default=None) if ends else None

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark, lives, rows = state.getCurrentWatermarkMs() if ends else 0, defaultdict(lambda: _Life(step)), defaultdict(list)
        if state.exists:
            for name, text in json.loads(state.get[0]) if buckets else [(k[0], state.get[0])]:
                lives[name].now = step()
                lives[name].now.load(text)
        for part in () if state.hasTimedOut else parts:
            names = part[key].tolist() if buckets else [k[0]] * len(part)
            for name, *row in zip(names, *(part[c].tolist() for c in columns), strict=True):
                rows[name].append([None if x is None or (not isinstance(x, np.ndarray) and x != x) else x for x in row])
        out = []
        for name, own in rows.items():
            for row in sorted(own, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)):  # ms and seq, nulls last
                out += [(name, *r) for r in lives[name].take(*row)]
        for name, life in lives.items():
            if name not in rows and (state.hasTimedOut and not buckets or (at := due(life.now)) is not None and at < mark):
                out += [(name, *r) for r in life.close()]  # after a pause, or at the end
                end = life.now.until()
                life.now = None if end is not None and end <= mark else life.now
        left = {name: life.now for name, life in lives.items() if life.now is not None}
        if left:
            texts = [(name, now.dump()) for name, now in left.items()]
            state.update((json.dumps(texts) if buckets else texts[0][1],))
            times = [at for now in left.values() if (at := due(now)) is not None]
            if times:
                state.setTimeoutTimestamp(max(min(times), mark + 1))
        elif state.exists:
            state.remove()
        if out:  # most keys have none when their time is over, and a frame costs as much as a key's rows
            yield pd.DataFrame(out, columns=_names(schema))

    kind = GroupStateTimeout.EventTimeTimeout if ends else GroupStateTimeout.NoTimeout
    timed = df.withWatermark(ts, watermark)
    if not buckets:
        return timed.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", kind)
    timed = timed.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_bucket"), F.col(key).cast("string").alias(key), ts, *[c for c in columns if c != ts])
    out = timed.groupBy("_bucket").applyInPandasWithState(run, f"{key} string, {step.output}", "state string", "append", kind)
    return out.withColumn(key, F.col(key).cast(dict(df.dtypes)[key]))
