"""Rate limits, quota and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_sorted
from ..functions.ordered import filled, numbered
from ..sources.shared import written


def rate_limit_sliding(hits: DataFrame, most: Column | int, window_ms: int, key: str = "k") -> DataFrame:
    """hits(k, ms, id) with n (hits of the key in the window, rejected ones too), allowed and remaining."""
    most = most if isinstance(most, Column) else F.lit(most)
    w = Window.partitionBy(key).orderBy("ms").rangeBetween(-(window_ms - 1), 0)
    same = Window.partitionBy(key, "ms")
    later = F.count("*").over(same) - F.row_number().over(same.orderBy("id"))  # hits of the same instant that come after
    n = F.count("*").over(w) - later
    return hits.withColumn("n", n).withColumn("allowed", F.col("n") <= most).withColumn("remaining", F.greatest(F.lit(0), most - F.col("n")))


class _Anchored:
    """The window that is open: its first hit and how many it has had."""

    def __init__(self, window_ms: int):
        self.window_ms, self.anchor, self.n = window_ms, None, 0

    def take(self, ms: int, id_: int) -> list[tuple]:
        if self.anchor is None or ms - self.anchor >= self.window_ms:
            self.anchor, self.n = ms, 0
        self.n += 1
        return [(id_, self.anchor, self.n)]

    def close(self) -> list[tuple]:
        return []


def _fixed_by_jumps(hits: DataFrame, window_ms: int, key: str) -> DataFrame:
    """W2 for keys with very many hits: each hit points to the first one a window later; the windows' anchors are what the key's
    first hit reaches by these pointers, whose jumps double in rounds. No task holds a key."""
    rows = numbered(hits.select(F.col(key).alias("_k"), "ms", "id"), ["_k", "ms", "id"])
    both = rows.select("_k", F.col("ms").alias("t"), F.lit(1).alias("hit"), F.col("pos").alias("of")).unionByName(rows.select("_k", (F.col("ms") + window_ms).alias("t"), F.lit(0).alias("hit"), F.col("pos").alias("of")))
    next_ = filled(numbered(both, ["_k", "t", "hit", "of"]).withColumn("to", F.when(F.col("hit") == 1, F.struct("_k", "of"))), "to", forward=False)
    jump = written(next_.where((F.col("hit") == 0) & F.col("to._k").eqNullSafe(F.col("_k"))).select(F.col("of").alias("pos"), F.col("to.of").alias("to")))
    anchors = written(rows.groupBy("_k").agg(F.min("pos").alias("pos")).select("pos"))
    while True:
        more = written(anchors.join(jump, "pos").select(F.col("to").alias("pos")))
        if more.isEmpty():
            break
        anchors = written(anchors.unionByName(more))
        jump = written(jump.join(jump.select(F.col("pos").alias("to"), F.col("to").alias("_far")), "to").select("pos", F.col("_far").alias("to")))
    rows = rows.join(anchors.withColumn("_a", F.lit(True)), "pos", "left").withColumn("a", F.when(F.col("_a"), F.struct("pos", "ms")))
    return filled(rows, "a", forward=True).select(F.col("_k").alias(key), "id", F.col("a.ms").alias("anchor"), (F.col("pos") - F.col("a.pos") + 1).cast("int").alias("n"))


def rate_limit_fixed(hits: DataFrame, most: int, window_ms: int, key: str = "k", hot: int = 200_000) -> DataFrame:
    """As W1, with windows anchored at a key's first hit; the next starts at the first hit beyond.

    A fold over each key's hits in order; keys of over `hot` hits, which would hold up a task, go by doubled jumps instead."""
    crowded = written(hits.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(F.col(key).alias("_c")))
    fold = lambda df: fold_sorted(df, key, ["ms", "id"], ["ms", "id"], lambda: _Anchored(window_ms), f"{key} {dict(hits.dtypes)[key]}, id bigint, anchor bigint, n int")
    if crowded.isEmpty():
        out = fold(hits)
    else:
        same = F.col(key).eqNullSafe(F.col("_c"))
        out = fold(hits.join(crowded, same, "left_anti")).unionByName(_fixed_by_jumps(hits.join(crowded, same, "left_semi"), window_ms, key))
    return out.withColumn("allowed", F.col("n") <= most).withColumn("remaining", F.greatest(F.lit(0), most - F.col("n")))


#: route, most, window in ms, counted by.
POLICIES = [
    ("signup", 5, 60_000, "ip"), ("login", 10, 60_000, "ip"), ("refresh", 60, 3_600_000, "ip"), ("logout", 20, 60_000, "ip"), ("activate", 3, 3_600_000, "user"),
    ("status", 60, 3_600_000, "user"), ("unbind", 5, 86_400_000, "user"), ("survey", 3, 3_600_000, "user"), ("extract", 10, 60_000, "user"),
]


def rate_policies(hits: DataFrame, policies=POLICIES) -> DataFrame:
    """hits(route, ip, user, ms, id), each under its route's policy; a route's window is its own."""
    rows = [
        rate_limit_sliding(hits.where(F.col("route") == r).withColumn("k", F.concat_ws(":", "route", by)), most, ms) for r, most, ms, by in policies
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def quota_replay(calls: DataFrame, quota: int = 100) -> DataFrame:
    """calls(user_id, ms, id, ok): a call is let through while successes before it are under the quota; a failure gives its unit back."""
    before = Window.partitionBy("user_id").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.lit(quota), F.coalesce(F.sum(F.col("ok").cast("int")).over(before), F.lit(0)))
    rows = calls.withColumn("used", used).withColumn("allowed", F.col("used") < quota)
    return rows.withColumn("remaining", quota - F.col("used") - (F.col("allowed") & F.col("ok")).cast("int"))


def usage_report(calls: DataFrame) -> DataFrame:
    """calls(user_id, vendor, model, day, ok, tokens)"""
    return calls.groupBy("user_id", "vendor", "model", "day").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"))


def retention(rows: DataFrame, now: Column, days: int = 90, ts: str = "ts") -> DataFrame:
    """U4: rows of the last days."""
    return rows.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


VENDORS = ("anthropic", "openai", "deepseek")


def validate_calls(calls: DataFrame, vendors=VENDORS) -> DataFrame:
    """V2: calls(prompt, vendor, model, max_tokens) with defaults, and reasons joined by `; ` (empty: fine)."""
    vendor, tokens = F.coalesce("vendor", F.lit(vendors[0])), F.coalesce("max_tokens", F.lit(4000))
    rules = [
        (F.length(F.coalesce("prompt", F.lit(""))).between(1, 200_000), "prompt: 1 to 200000 characters"), (vendor.isin(*vendors), "vendor: unknown"),
        (F.length(F.coalesce("model", F.lit(""))) <= 50, "model: 50 characters at most"), (tokens.between(1, 8000), "max_tokens: 1 to 8000"),
    ]
    return calls.withColumns({"vendor": vendor, "max_tokens": tokens, "reasons": F.concat_ws("; ", *[F.when(~ok, why) for ok, why in rules])})
