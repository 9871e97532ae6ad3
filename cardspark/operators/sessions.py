"""Sessions: transcripts, answers, speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import js_trim


def dedup_segments(segments: DataFrame, gap_ms: int = 4000) -> DataFrame:
    """D3: segments(session_id, seq, ms, text) with accepted: false if equal to the last accepted one less than the gap before.

    Only a segment of the text before can be refused, so rows fall into runs of one text along the session, and each run is
    folded alone: a run's accepted rows are those at least a gap after the last accepted.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    rows = segments.withColumn("_new", (~F.col("text").eqNullSafe(F.lag("text").over(order))).cast("int")).withColumn("_run", F.sum("_new").over(order))
    runs = rows.groupBy("session_id", "_run").agg(F.array_sort(F.collect_list(F.struct("seq", "ms"))).alias("x"))
    zero = F.struct(F.lit(None).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ok"))

    def step(acc, x):
        take = acc["at"].isNull() | (x["ms"] - acc["at"] >= gap_ms)
        return F.struct(F.when(take, x["ms"]).otherwise(acc["at"]).alias("at"), F.when(take, F.concat(acc["ok"], F.array(x["seq"].cast("long")))).otherwise(acc["ok"]).alias("ok"))

    kept = runs.select("session_id", F.explode(F.aggregate("x", zero, step)["ok"]).alias("seq")).withColumn("accepted", F.lit(True))
    return segments.join(kept, ["session_id", "seq"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def session_transcripts(segments: DataFrame, title: str, least: int = 50) -> DataFrame:
    """A session's accepted segments in order under a header line, kept from 50 characters on."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    rows = segments.groupBy("session_id").agg(text.alias("t")).where(F.length(js_trim(F.col("t"))) >= least)
    return rows.select("session_id", F.concat(F.lit(title), F.lit("\n"), F.col("t")).alias("raw_content"))


def answer_guard(deltas: DataFrame) -> DataFrame:
    """deltas(session_id, seq, kind, request_id, delta, ok) -> the newest request's text and status per session and request.

    A row counts only if no newer request had begun before it.
    """
    run = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = deltas.withColumn("_top", F.max("request_id").over(run)).where("request_id = _top")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    ends = F.max(F.when(F.col("kind") == "done", F.col("ok").cast("int")))
    out = rows.groupBy("session_id", "request_id").agg(text.alias("text"), ends.alias("_end"))
    status = F.when(F.col("_end").isNull(), "open").when(F.col("_end") == 1, "done").when(F.col("text") == "", "error").otherwise("partial")
    return out.withColumn("status", status).drop("_end")


def speech_endpoints(frames: DataFrame, loud: float = 0.008, silence: float = 0.9) -> DataFrame:
    """frames(session_id, seq, rms, seconds) where an utterance ends: after speech, the first frame that completes the silence."""
    run = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("_speech", F.col("rms") > loud).withColumn("_isle", F.sum(F.col("_speech").cast("int")).over(run))
    isle = Window.partitionBy("session_id", "_isle").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    quiet = F.round(F.sum(F.when(F.col("_speech"), 0.0).otherwise(F.col("seconds"))).over(isle), 6)
    rows = rows.withColumn("_q", quiet).withColumn("_own", F.when(F.col("_speech"), 0.0).otherwise(F.col("seconds")))
    return rows.where((F.col("_isle") > 0) & (F.col("_q") >= silence) & (F.round(F.col("_q") - F.col("_own"), 6) < silence)).select("session_id", "seq")


def speaker_labels(segments: DataFrame, prints: DataFrame, self_from: float = 0.70, other_to: float = 0.55) -> DataFrame:
    """segments(id, user_id, embedding) against prints(user_id, print): self, speaker or unknown."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    rows = segments.join(prints, "user_id", "left")
    sim = F.when((norm("embedding") > 1e-6) & (norm("print") > 1e-6), F.round(dot("embedding", "print") / (norm("embedding") * norm("print")), 6))
    return rows.select("id", "user_id", sim.alias("similarity")).withColumn("label", F.when(F.col("similarity") >= self_from, "self").when(F.col("similarity") <= other_to, "speaker").otherwise("unknown"))
