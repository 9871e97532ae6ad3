"""Streams over tables (ST2 to ST5) and the runner that queries use."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import questions as Q
from ..operators.card_index import CardIndex
from ..operators.text import apply_corrections, js_trim
from ..sources.shared import shared_dir
from . import state


def run_once(stream: DataFrame) -> DataFrame:
    """All that is there now through the stream, appended to a table in the shared folder."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def question_rows(segments: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """The stateless half of ST2: what was said, its text after T6's corrections, what that is on its own and after a question, and whether it may follow."""
    rows = segments.withColumn("said", js_trim(F.coalesce(F.col("text"), F.lit("")))).withColumn("text", js_trim(apply_corrections(F.col("said"), list(rules))))
    own, after = Q.classify_segment(F.col("text")), Q.standalone(F.col("text"))
    stop = F.coalesce(F.col("stop"), F.lit(False)) if "stop" in segments.columns else F.lit(False)
    rows = rows.withColumns({"q_type": own["type"], "q_text": own["text"], "p_type": after["type"], "p_text": after["text"], "stop": stop})
    return rows.withColumn("follows", (F.length("text") >= 2) & Q.is_follow_up(F.col("text")))


def stream_questions(segments: DataFrame, rules: list[tuple[str, str]] = (), watermark: str = "1 minute") -> DataFrame:
    """ST2: segments(session_id, seq, ms, ts, text[, stop]) -> questions as they come: D3, then T6 by the rules (those of when the
    stream starts), then Q6. A row marked stop ends its session; so does an hour without rows."""
    return state.fold_stream(question_rows(segments, rules), "session_id", state.Asker, watermark)


def batch_questions(segments: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """The batch twin of ST2, for sessions without stop rows."""
    return state.fold_batch(question_rows(segments, rules), "session_id", state.Asker)


def stream_reviews(reviews: DataFrame, known: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST7: reviews(card_id, ms, seq, ts, rating) -> each card's schedule after each review. Schedules of known(card_id, state,
    stability, difficulty, reps, lapses, last_review, due), a table of `review_cards`, are gone on with: a stream-static join
    brings them along, and a card's first row loads its."""
    rows = reviews.join(known.select("card_id", F.to_json(F.struct("state", "stability", "difficulty", "reps", "lapses", "last_review", "due")).alias("known")), "card_id", "left")
    return state.fold_stream(rows, "card_id", state.Reviewer, watermark)


def stream_usage(calls: DataFrame, watermark: str = "1 day") -> DataFrame:
    """ST4: calls(ts, user_id, ok, tokens) -> sums by user and day, given out once the watermark has passed the day."""
    w = F.window("ts", "1 day")
    rows = calls.withWatermark("ts", watermark).groupBy(w, "user_id").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.sum(F.when(F.col("ok"), F.col("tokens")).otherwise(0)).alias("tokens"))
    return rows.select(F.col("window.start").alias("day"), "user_id", "calls", "ok", "tokens")


def stream_index(stream: DataFrame, index: CardIndex, checkpoint: str, embed: Callable[[DataFrame], DataFrame] | None = None):
    """ST5: a stream of changes(card_id, title, summary, details, tags, scope[, updated_at][, removed]) kept in an index.

    A micro-batch is committed as a whole under its number; one that Spark runs again after a failure changes nothing.
    """
    take = lambda batch, number: index.commit(number + 1, batch, embed=embed)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
