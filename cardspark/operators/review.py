"""Spaced repetition (ST7): the published FSRS-6 equations, folded over each card's reviews in order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.folds import fold_sorted

#: The default weights published with FSRS-6.
WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
MINUTE = 60_000
DAY = 86_400_000
SCHEMA = "card_id {kind}, state string, stability double, difficulty double, reps long, lapses long, last_review long, due long"


class Schedule:
    """One card: state, stability, difficulty and when it is due (all times in ms)."""

    def __init__(self, w=WEIGHTS, retention: float = 0.9):
        self.w, self.retention = w, retention
        self.c = -w[20]
        self.f = 0.9 ** (1 / self.c) - 1
        self.state, self.s, self.d, self.reps, self.lapses, self.last, self.due = "new", 0.0, 0.0, 0, 0, None, None

    def _difficulty0(self, g: int) -> float:
        return min(10.0, max(1.0, self.w[4] - math.exp(self.w[5] * (g - 1)) + 1))

    def _interval(self) -> int:
        return min(36500, max(1, round(self.s / self.f * (self.retention ** (1 / self.c) - 1))))

    def review(self, ms: int, g: int) -> None:
        """g: 1 again, 2 hard, 3 good, 4 easy; anything else is refused."""
        if g not in (1, 2, 3, 4):
            return
        w = self.w
        if self.state == "new":
            self.s, self.d = w[g - 1], self._difficulty0(g)
        else:
            days = max(0, (ms - self.last) // DAY)
            r = (1 + self.f * days / self.s) ** self.c
            if days == 0:
                grow = math.exp(w[17] * (g - 3 + w[18])) * self.s ** -w[19]
                self.s *= max(1.0, grow) if g >= 3 else grow
            elif g == 1:
                self.s = min(self.s, w[11] * self.d ** -w[12] * ((self.s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - r)))
            else:
                self.s *= 1 + math.exp(w[8]) * (11 - self.d) * self.s ** -w[9] * (math.exp(w[10] * (1 - r)) - 1) * (w[15] if g == 2 else w[16] if g == 4 else 1)
            step = self.d - w[6] * (g - 3) * (10 - self.d) / 9
            self.d = min(10.0, max(1.0, w[7] * self._difficulty0(4) + (1 - w[7]) * step))
        self.s = max(self.s, 0.001)
        if g == 1:
            self.lapses += self.state == "review"
            self.state = "relearning" if self.state in ("review", "relearning") else "learning"
            self.due = ms + (10 if self.state == "relearning" else 1) * MINUTE
        elif self.state in ("new", "learning", "relearning") and g < 4 and (g == 2 or self.state == "new"):
            self.state = "relearning" if self.state == "relearning" else "learning"
            self.due = ms + (10 if g == 3 else 6) * MINUTE
        else:
            self.state = "review"
            self.due = ms + self._interval() * DAY
        self.reps += 1
        self.last = ms

    def row(self, digits: int = 6) -> tuple:
        return self.state, round(self.s, digits), round(self.d, digits), self.reps, self.lapses, self.last, self.due


class _Reviews:
    """A card's schedule, given out after its last review."""

    def __init__(self, w, digits):
        self.schedule, self.digits = Schedule(w), digits

    def take(self, ms: int, rating: int) -> list[tuple]:
        self.schedule.review(ms, rating)
        return []

    def close(self) -> list[tuple]:
        return [self.schedule.row(self.digits)]


def review_cards(reviews: DataFrame, w=WEIGHTS, digits: int = 6) -> DataFrame:
    """reviews(card_id, ms, seq, rating) -> a schedule per card; a stream that goes on from it asks for more digits."""
    kind = dict(reviews.dtypes)["card_id"]

    return fold_sorted(reviews, "card_id", ["ms", "seq"], ["ms", "rating"], lambda: _Reviews(w, digits), SCHEMA.format(kind=kind))
