"""Which segments of a session are questions (Q1 to Q8): cue patterns, and windows along the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regexes as R
from .text import js_trim

_ANY = lambda cues: "|".join(cues)


def has_han(c: Column) -> Column:
    return c.rlike(R.HAN)


def is_interrogative(c: Column) -> Column:
    """Q1: a question mark at the end, a tag, a wh-word, an inversion, or a Chinese cue."""
    han = c.rlike(f"({_ANY(R.ZH_TAIL)})[?？]?\\z") | c.rlike(_ANY(R.ZH_A_NOT_A + R.ZH_OPINION + R.ZH_WH + R.ZH_SCENARIO))
    return (
        c.rlike(rf"[?？]{R.SPACE}*\z")
        | c.rlike(rf"(?i),{R.SPACE}*({R.EN_TAG}){R.SPACE}*\??\z")
        | c.rlike(rf"(?i){R.BEFORE}({R.EN_WH}){R.AFTER}")
        | c.rlike(rf"(?i){R.BEFORE}({R.EN_AUX})\s+({R.EN_SUBJECT}){R.AFTER}")
        | (has_han(c) & han)
    )


def leads_with_imperative(c: Column) -> Column:
    """Q2: a directive leads the sentence, perhaps after polite words."""
    zh = rf"^(?:{_ANY(R.ZH_LEAD_PREFIX)}|[{R.SPACES}，,])*({_ANY(R.ZH_LEAD)})"
    return c.rlike(rf"(?i)^\s*(?:{R.EN_LEAD_PREFIX})?({_ANY(R.EN_LEAD)}){R.AFTER}") | (has_han(c) & c.rlike(zh))


def is_imperative(c: Column) -> Column:
    """Q2: a directive leads or stands anywhere."""
    lead = c.rlike(rf"(?i)^\s*(?:{R.EN_LEAD_PREFIX})?({_ANY(R.EN_LEAD)}){R.AFTER}")
    return lead | c.rlike(rf"(?i){R.BEFORE}({_ANY(R.EN_IMPERATIVE)}){R.AFTER}") | (has_han(c) & c.rlike(_ANY(R.ZH_IMPERATIVE)))


def is_self_statement(c: Column) -> Column:
    """Q3: the speaker speaks of themselves and asks nothing."""
    return c.rlike(f"^({_ANY(R.SELF_LEAD)})") & ~c.rlike(_ANY(R.OTHER_SIDE)) & ~is_interrogative(c)


def is_contentless(c: Column) -> Column:
    rest = F.regexp_replace(c, f"[{R.FILLERS}{R.SPACES}，,。!！?？]", "")
    return has_han(c) & (F.length(rest) <= 1)


def is_follow_up(c: Column) -> Column:
    """Q4: refers back, and is short enough to lean on the question before."""
    strong = c.rlike(f"^[{R.SPACES}，,]*({_ANY(R.ZH_FOLLOW)})") | c.rlike(rf"(?i)^\s*({_ANY(R.EN_FOLLOW)}){R.AFTER}")
    short = (F.length(c) <= 18) | (F.regexp_count(c, F.lit(f"[^{R.SPACES}]+")) <= 5)
    return (strong | c.rlike(f"^({_ANY(R.FOLLOW_BARE)})") | is_contentless(c)) & (short | (strong & (F.length(c) <= 32)))


def _cap(c: Column) -> Column:
    return F.when(has_han(c), F.substring(c, 1, 200)).otherwise(F.array_join(F.slice(F.split(c, f"{R.SPACE}+"), 1, 40), " "))


def standalone(c: Column) -> Column:
    """Q5 without what came before: struct (type, text) of the first sentence that needs an answer, else null."""
    kind = lambda s: F.when(is_self_statement(s), None).when(leads_with_imperative(s), "imperative").when(is_interrogative(s), "interrogative").when(is_imperative(s), "imperative")
    parts = F.filter(F.transform(F.split(c, "[。！!\n]+"), js_trim), lambda x: x != "")
    found = F.filter(F.transform(parts, lambda s: F.struct(kind(s).alias("type"), _cap(s).alias("text"))), lambda x: x["type"].isNotNull())
    return F.when(F.length(c) >= 2, F.get(found, F.lit(0)))


def classify_segment(text: Column, prior: Column | None = None) -> Column:
    """Q5: struct (type, text); null where no answer is needed."""
    s = js_trim(F.coalesce(text, F.lit("")))
    if prior is None:
        return F.when(~is_contentless(s), standalone(s))
    has = F.coalesce(prior, F.lit("")) != ""
    follow = F.struct(F.lit("follow_up").alias("type"), F.substring(F.concat(prior, F.lit("，"), s), 1, 200).alias("text"))
    return F.when((F.length(s) >= 2) & has & is_follow_up(s), follow).when(has | ~is_contentless(s), standalone(s))


def classify_session(df: DataFrame, session: str = "session_id", seq: str = "seq", text: str = "text") -> DataFrame:
    """Q6: adds q_type and q_text; a follow-up carries the text of the questions it follows.

    All by windows along the session: whether a question came before, which run of follow-ups a row belongs to, and the
    first 35 texts of the run (more cannot reach the 100 characters that are carried).
    """
    order = Window.partitionBy(session).orderBy(seq)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_s", js_trim(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn("_p", standalone(F.col("_s"))).withColumn("_fu", (F.length("_s") >= 2) & is_follow_up(F.col("_s")))
    rows = rows.withColumn("_alone", F.when(~is_contentless(F.col("_s")), F.col("_p")))
    rows = rows.withColumn("_has", F.coalesce(F.max(F.col("_alone").isNotNull()).over(before), F.lit(False)))
    rows = rows.withColumn("q_type", F.when(F.col("_has") & F.col("_fu"), "follow_up").when(F.col("_has"), F.col("_p.type")).otherwise(F.col("_alone.type")))
    own = F.when(F.col("q_type") == "follow_up", F.col("_s")).when(F.col("q_type").isNotNull(), F.when(F.col("_has"), F.col("_p.text")).otherwise(F.col("_alone.text")))
    rows = rows.withColumn("_own", own).withColumn("_run", F.sum((F.col("q_type") != "follow_up").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(session, "_run").orderBy(seq)
    rows = rows.withColumn("_n", F.count("_own").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.collect_list(F.when(F.col("_n") <= 35, F.col("_own"))).over(run.rowsBetween(Window.unboundedPreceding, -1))
    prior = F.substring(F.array_join(texts, "，"), 1, 100)
    rows = rows.withColumn("q_text", F.when(F.col("q_type") == "follow_up", F.substring(F.concat(prior, F.lit("，"), F.col("_s")), 1, 200)).otherwise(F.col("_own")))
    return rows.drop("_s", "_p", "_fu", "_alone", "_has", "_own", "_run", "_n")


def ambiguous_queue(df: DataFrame, q_type: str = "q_type", text: str = "text") -> DataFrame:
    """Q7: segments that no rule took, of eight characters or more; the first 300 go to an outside step."""
    t = js_trim(F.col(text))
    return df.where(F.col(q_type).isNull() & (F.length(t) >= 8)).withColumn("ask", F.substring(t, 1, 300))


def route_segment(role: Column, system: Column, gate: Column) -> Column:
    """Q8: the other side's segments are classified where that side can be heard apart; the rest is shown only."""
    return F.when((F.coalesce(role, F.lit("self")) == "speaker") & (system | gate), "classify").otherwise("display")
