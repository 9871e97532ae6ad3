"""Licences, devices, sessions of users, surveys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import claim_of

DAY_MS = 86_400_000


def best_licence(licences: DataFrame, now: Column) -> DataFrame:
    """licences(id, user_id, status, activated_at, created_at, expires_at) -> one a user, active before expired before others, then the latest."""
    claim = claim_of(F.col("status"), F.col("expires_at"), now)
    rank = F.when(claim == "active", 2).when(claim == "expired", 1).otherwise(0)
    w = Window.partitionBy("user_id").orderBy(F.desc("_rank"), F.coalesce("activated_at", "created_at").desc_nulls_last(), F.desc("id"))
    rows = licences.where("user_id is not null").withColumn("claim", claim).withColumn("_rank", rank)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def device_recognised(requests: DataFrame, licences: DataFrame, devices: DataFrame, now: Column) -> DataFrame:
    """requests(user_id, device_id) with the user's claim and whether the device is known."""
    best = best_licence(licences, now).select("user_id", "claim")
    known = devices.select("user_id", "device_id", F.lit(True).alias("known")).distinct()
    return requests.join(best, "user_id", "left").join(known, ["user_id", "device_id"], "left").withColumns({"claim": F.coalesce("claim", F.lit("none")), "known": F.coalesce("known", F.lit(False))})


def token_reuse(presentations: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """presentations(id, ts, token), tokens(token, family, revoked, expires_at) -> outcome of each, and revoked families.

    A revoked token revokes its family from then on; revoked is tested before expiry; an unknown token is not_found.
    """
    rows = presentations.join(tokens, "token", "left")
    families = rows.where("revoked").groupBy("family").agg(F.min("ts").alias("reused_at"), F.count("*").alias("times"))
    rows = rows.join(families.select("family", "reused_at"), "family", "left")
    outcome = F.when(F.col("revoked").isNull(), "not_found").when(F.col("revoked"), "reuse").when(F.col("reused_at") < F.col("ts"), "family_revoked").when(F.col("expires_at") <= F.col("ts"), "expired").otherwise("ok")
    return rows.withColumn("outcome", outcome).select("id", "token", "outcome"), families


def overlimit_devices(devices: DataFrame, now_ms: int, cap: int = 2, days: int = 90) -> DataFrame:
    """A10: devices(user_id, device_id, last_seen_ms): per user active and stale counts, and whether active ones exceed the cap."""
    active = F.col("last_seen_ms") > now_ms - days * DAY_MS
    return devices.groupBy("user_id").agg(F.count_if(active).alias("active"), F.count_if(~active).alias("stale")).withColumn("over", F.col("active") > cap)


def offline_grace(checks: DataFrame, days: int = 7) -> DataFrame:
    """checks(user_id, seq, clock_ms, online, status) with days_left of grace at each offline check (null when online or never active).

    The clock counts as its running maximum, so turning it back gains nothing; an online check ends a stretch.
    """
    run = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = checks.withColumn("now_ms", F.max("clock_ms").over(run)).withColumn("stretch", F.sum(F.col("online").cast("int")).over(run))
    rows = rows.withColumn("known", F.last(F.when(F.col("online"), F.col("status")), ignorenulls=True).over(run))
    since = F.min(F.when(~F.col("online"), F.col("now_ms"))).over(Window.partitionBy("user_id", "stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    left = F.greatest(F.lit(0), days - F.floor((F.col("now_ms") - since) / DAY_MS))
    return rows.withColumn("days_left", F.when(~F.col("online") & (F.col("known") == "active"), left)).drop("now_ms", "stretch", "known")


def anonymise_users(gone: DataFrame, surveys: DataFrame, *owned: DataFrame) -> list[DataFrame]:
    """Of users that leave, surveys lose the name, rows of other tables go."""
    hit = gone.select("user_id", F.lit(1).alias("_g")).distinct()
    kept = surveys.join(hit, "user_id", "left").withColumn("user_id", F.when(F.col("_g").isNull(), F.col("user_id"))).select(surveys.columns)
    return [kept, *[t.join(gone, "user_id", "left_anti") for t in owned]]


def dedup_surveys(surveys: DataFrame) -> DataFrame:
    """Adds accepted: the first of a user, project and date; surveys without user never collide."""
    w = Window.partitionBy("user_id", "project_id", "meeting_date").orderBy("submitted_at", "id")
    return surveys.withColumn("accepted", F.col("user_id").isNull() | (F.row_number().over(w) == 1))


def survey_report(surveys: DataFrame) -> DataFrame:
    """Counts and shares of each answer to the three questions."""
    rows = surveys.select(F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).alias("answer")) for q in ("outcome", "card_helpful", "will_use_next")])).alias("x")).select("x.*")
    counts = rows.groupBy("question", "answer").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("question")), 6))


def validate_surveys(surveys: DataFrame, outcomes, helpful, again) -> DataFrame:
    """V1: adds reasons, joined by `; ` (empty: fine)."""
    some = lambda c: F.coalesce(c, F.lit(""))
    rules = [
        (some("project_id").rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"), "project_id: a uuid"), (some("meeting_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), "meeting_date: YYYY-MM-DD"),
        (F.col("company_name_hash").isNull() | F.col("company_name_hash").rlike(r"^[0-9a-f]{64}\z"), "company_name_hash: 64 hex digits"), (some("outcome").isin(*outcomes), "outcome: unknown"),
        (some("card_helpful").isin(*helpful), "card_helpful: unknown"), (some("will_use_next").isin(*again), "will_use_next: unknown"), (F.length(some("free_text")) <= 500, "free_text: 500 characters at most"),
    ]
    return surveys.withColumn("reasons", F.concat_ws("; ", *[F.when(~ok, why) for ok, why in rules]))
