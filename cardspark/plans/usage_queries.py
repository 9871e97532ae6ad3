"""Registered queries and oracles: limits, quota, licences, sessions, surveys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entitlement as E
from ..operators import sessions as Se
from ..operators import usage as U
from .tables import read, using

QUERIES, ORACLES = {}, {}
DAY = 86_400_000


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _sliding(most, window, key="k", rows="hits"):
    return f"select a.*, (select count(*) from {rows} b where b.{key} = a.{key} and b.ms > a.ms - {window} and (b.ms < a.ms or (b.ms = a.ms and b.id <= a.id))) as n, {most} as most from {rows} a"


@query(using("hits") + f"select id, n, n <= 3 as allowed, greatest(0, 3 - n) as remaining from ({_sliding(3, DAY)})")
def w1_rate_limit_sliding(spark, d):
    return U.rate_limit_sliding(read(spark, d, "hits"), 3, DAY).select("id", "n", "allowed", "remaining")


@query("with recursive " + using("hits").removeprefix("with ") + f""", o as (select k, id, ms, row_number() over (partition by k order by ms, id) as rn from hits),
  r as (select k, id, ms, rn, ms as anchor, 1 as n from o where rn = 1 union all select o.k, o.id, o.ms, o.rn, case when o.ms - r.anchor >= {DAY} then o.ms else r.anchor end, case when o.ms - r.anchor >= {DAY} then 1 else r.n + 1 end from r join o on o.k = r.k and o.rn = r.rn + 1)
  select id, n, n <= 3 as allowed, greatest(0, 3 - n) as remaining from r""")
def w2_rate_limit_fixed(spark, d):
    return U.rate_limit_fixed(read(spark, d, "hits"), 3, DAY).select("id", "n", "allowed", "remaining")


_ROUTE = "case id % 9 " + " ".join(f"when {i} then '{r}'" for i, (r, *_) in enumerate(U.POLICIES)) + " end"
_ROUTED = f"select id, ms, {_ROUTE} as route, 'ip' || cast(k % 10 as varchar(9)) as ip, cast(k % 10 as varchar(9)) as user, case id % 9 {' '.join(f'when {i} then {m}' for i, (_, m, _w, _b) in enumerate(U.POLICIES))} end as most, case id % 9 {' '.join(f'when {i} then {w}' for i, (_, _m, w, _b) in enumerate(U.POLICIES))} end as win from hits".replace(" as user", ' as "user"')


@query(using("hits") + f""", h as ({_ROUTED}) select a.id, a.route, count(*) as n, count(*) <= a.most as allowed, greatest(0, a.most - count(*)) as remaining from h a join h b on b.route = a.route and b.ip = a.ip and b.ms > a.ms - a.win and (b.ms < a.ms or (b.ms = a.ms and b.id <= a.id)) group by a.id, a.route, a.most""")
def w3_rate_policies(spark, d):
    rows = spark.sql(_ROUTED.replace("from hits", "from {hits}").replace('"user"', "`user`"), hits=read(spark, d, "hits")).drop("most", "win")
    return U.rate_policies(rows).select("id", "route", "n", "allowed", "remaining")


@query(using("calls") + "select id, least(10, coalesce(s, 0)) as used, coalesce(s, 0) < 10 as allowed, 10 - least(10, coalesce(s, 0)) - case when coalesce(s, 0) < 10 and ok then 1 else 0 end as remaining from (select *, cast(sum(cast(ok as int)) over (partition by user_id order by ms, id rows between unbounded preceding and 1 preceding) as bigint) as s from calls)")
def w4_quota_replay(spark, d):
    return U.quota_replay(read(spark, d, "calls"), 10).select("id", "used", "allowed", "remaining")


@query(using("calls") + "select user_id, vendor, model, cast(day as varchar(10)) as day, count(*) as calls, count(*) filter (ok) as ok, count(*) filter (not ok) as failed, cast(sum(case when ok then tokens else 0 end) as bigint) as tokens from calls group by user_id, vendor, model, day")
def a8_usage_report(spark, d):
    return U.usage_report(read(spark, d, "calls")).withColumn("day", F.col("day").cast("string"))


@query("select event_id from events where ts >= (select max(ts) from events) - interval 10 day")
def u4_retention(spark, d):
    e = read(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    return U.retention(e.join(F.broadcast(last)), F.col("last"), 10).select("event_id")


_CALL = "select event_id, case when event_id % 7 = 0 then '' else event_type end as prompt, case event_id % 4 when 0 then 'other' when 1 then 'openai' end as vendor, case when event_id % 5 = 0 then '{long}' else 'm' end as model, case when event_id % 3 = 0 then user_id * 100 end as max_tokens from events".replace("{long}", "m" * 60)


@query(f"with c as ({_CALL}) select event_id, coalesce(vendor, 'anthropic') as vendor, coalesce(max_tokens, 4000) as max_tokens, concat_ws('; ', case when length(prompt) not between 1 and 200000 then 'prompt: 1 to 200000 characters' end, case when coalesce(vendor, 'anthropic') = 'other' then 'vendor: unknown' end, case when length(model) > 50 then 'model: 50 characters at most' end, case when coalesce(max_tokens, 4000) not between 1 and 8000 then 'max_tokens: 1 to 8000' end) as reasons from c")
def v2_validate_calls(spark, d):
    return U.validate_calls(spark.sql(_CALL.replace("from events", "from {events}"), events=read(spark, d, "events"))).select("event_id", "vendor", "max_tokens", "reasons")


_CLAIM = "case when expires_at <= timestamp '1998-01-01' then 'expired' when status = 'active' then 'active' when status = 'expired' then 'expired' else 'none' end"
_BEST = using("licences", "devices") + f", c as (select *, {_CLAIM} as claim from licences), b as (select * from (select *, row_number() over (partition by user_id order by case claim when 'active' then 2 when 'expired' then 1 else 0 end desc, coalesce(activated_at, created_at) desc, id desc) as n from c) where n = 1)"


def _now():
    return F.lit("1998-01-01").cast("timestamp_ntz")


@query(_BEST + " select user_id, id, claim from b")
def w5_best_licence(spark, d):
    return E.best_licence(read(spark, d, "licences"), _now()).select("user_id", "id", "claim")


@query(_BEST + ", q as (select c_custkey as user_id, c_custkey % 7 as device_id from customer) select q.user_id, q.device_id, coalesce(claim, 'none') as claim, d.user_id is not null as known from q left join b on b.user_id = q.user_id left join devices d on d.user_id = q.user_id and d.device_id = q.device_id")
def j7_device_recognised(spark, d):
    q = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 7).alias("device_id"))
    return E.device_recognised(q, read(spark, d, "licences"), read(spark, d, "devices"), _now()).select("user_id", "device_id", "claim", "known")


_TOK = "select 't' || cast(c_custkey as varchar(20)) as token, c_custkey % 200 as family, c_custkey % 13 = 0 as revoked, 1000 + c_custkey * 5 as expires_at from customer"
_PRES = "select event_id as id, event_id as ts, 't' || cast(event_id * 31 % 1700 as varchar(20)) as token from events"


@query(f"with t as ({_TOK}), r as (select p.id, p.ts, p.token, family, revoked, expires_at from ({_PRES}) p left join t using (token)), f as (select family, min(ts) as reused from r where revoked group by family) select id, token, case when revoked is null then 'not_found' when revoked then 'reuse' when reused < ts then 'family_revoked' when expires_at <= ts then 'expired' else 'ok' end as outcome from r left join f using (family)")
def j8_token_reuse(spark, d):
    run = lambda q, t: spark.sql(q.replace(f"from {t}", f"from {{{t}}}"), **{t: read(spark, d, t)})
    return E.token_reuse(run(_PRES, "events"), run(_TOK, "customer"))[0]


_SEEN = 883_612_800_000


@query(using("devices") + f"select user_id, count(*) filter (last_seen_ms > {_SEEN - 800 * DAY}) as active, count(*) filter (last_seen_ms <= {_SEEN - 800 * DAY}) as stale, count(*) filter (last_seen_ms > {_SEEN - 800 * DAY}) > 2 as over from devices group by user_id")
def a10_overlimit_devices(spark, d):
    return E.overlimit_devices(read(spark, d, "devices"), _SEEN, days=800)


_CHECK = "select id, k as user_id, id as seq, ms - id % 7 * 18000000 as clock_ms, id % 4 = 0 as online, case id % 3 when 0 then 'active' else 'expired' end as status from hits"


@query(using("hits") + f""", c as ({_CHECK}), a as (select *, max(clock_ms) over w as now_ms, sum(cast(online as int)) over w as stretch, last_value(case when online then status end ignore nulls) over w as known from c window w as (partition by user_id order by seq rows unbounded preceding)),
  s as (select *, min(case when not online then now_ms end) over (partition by user_id, stretch order by seq rows unbounded preceding) as since from a)
  select id, coalesce(case when not online and known = 'active' then cast(greatest(0, 7 - floor((now_ms - since) / {DAY})) as bigint) end, -1) as days_left from s""")
def w6_offline_grace(spark, d):
    return E.offline_grace(spark.sql(_CHECK.replace("from hits", "from {hits}"), hits=read(spark, d, "hits"))).select("id", F.coalesce("days_left", F.lit(-1)).alias("days_left"))


_DELTA = "select k as session_id, id as seq, case id % 5 when 0 then 'start' when 4 then 'done' else 'delta' end as kind, floor(id / 300) - case when id % 11 = 0 then 1 else 0 end as request_id, event_type as delta, id % 2 = 0 as ok from hits"


@query(using("hits") + f""", c as ({_DELTA}), a as (select *, max(request_id) over (partition by session_id order by seq rows unbounded preceding) as top from c),
  g as (select session_id, request_id, coalesce(string_agg(delta, '' order by seq) filter (kind = 'delta'), '') as text, max(case when kind = 'done' then cast(ok as int) end) as e from a where request_id = top group by session_id, request_id)
  select session_id, cast(request_id as bigint) as request_id, text, case when e is null then 'open' when e = 1 then 'done' when text = '' then 'error' else 'partial' end as status from g""")
def w7_answer_guard(spark, d):
    return Se.answer_guard(spark.sql(_DELTA.replace("from hits", "from {hits}"), hits=read(spark, d, "hits"))).withColumn("request_id", F.col("request_id").cast("bigint"))


_FRAME = "select k as session_id, id as seq, case when id % 4 = 0 then 0.01 else 0.001 end as rms, 0.3 as seconds from hits"


@query(using("hits") + f""", f as ({_FRAME}), a as (select *, rms > 0.008 as speech, sum(cast(rms > 0.008 as int)) over (partition by session_id order by seq rows unbounded preceding) as isle from f),
  q as (select *, round(sum(case when speech then 0 else seconds end) over (partition by session_id, isle order by seq rows unbounded preceding), 6) as quiet from a)
  select session_id, seq from q where isle > 0 and quiet >= 0.9 and round(quiet - case when speech then 0 else seconds end, 6) < 0.9""")
def w9_speech_endpoints(spark, d):
    frames = spark.sql(_FRAME.replace("from hits", "from {hits}"), hits=read(spark, d, "hits")).withColumns({"rms": F.col("rms").cast("double"), "seconds": F.col("seconds").cast("double")})
    return Se.speech_endpoints(frames)


_DOT = "list_sum(list_transform(list_zip(e.embedding, p.embedding), lambda x: cast(x[1] as double) * cast(x[2] as double)))"
_N = "sqrt(list_sum(list_transform({0}, lambda x: cast(x as double) * cast(x as double))))"


@query(f"with p as (select e.* from embeddings e join (select label, min(vec_id) as m from embeddings where label % 4 <> 3 group by label) on vec_id = m), s as (select e.vec_id as id, e.label as user_id, round({_DOT} / ({_N.format('e.embedding')} * {_N.format('p.embedding')}), 6) as similarity from embeddings e left join p on p.label = e.label) select id, user_id, coalesce(similarity, -9) as similarity, case when similarity >= 0.2 then 'self' when similarity <= 0.05 then 'speaker' else 'unknown' end as label from s")
def w10_speaker_labels(spark, d):
    e = read(spark, d, "embeddings")
    first = e.where("label % 4 <> 3").groupBy(F.col("label").alias("user_id")).agg(F.min_by("embedding", "vec_id").alias("print"))
    return Se.speaker_labels(e.select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), "embedding"), first, 0.2, 0.05).withColumn("similarity", F.coalesce("similarity", F.lit(-9.0)))


_SEGMENT = "select k as session_id, id as seq, id * 700 as ms, event_type as text from hits"


@query("with recursive " + using("hits").removeprefix("with ") + f""", o as (select *, row_number() over (partition by session_id order by seq) as rn from ({_SEGMENT})),
  r as (select session_id, seq, rn, true as accepted, text as t, ms as at from o where rn = 1 union all select o.session_id, o.seq, o.rn, not (o.text = r.t and o.ms - r.at < 400000), case when o.text = r.t and o.ms - r.at < 400000 then r.t else o.text end, case when o.text = r.t and o.ms - r.at < 400000 then r.at else o.ms end from r join o on o.session_id = r.session_id and o.rn = r.rn + 1)
  select session_id, seq, accepted from r""")
def d3_dedup_segments(spark, d):
    return Se.dedup_segments(spark.sql(_SEGMENT.replace("from hits", "from {hits}"), hits=read(spark, d, "hits")), 400_000).select("session_id", "seq", "accepted")


@query(using("segments") + "select session_id, 'Session' || chr(10) || string_agg(text, chr(10) order by seq) as raw_content from segments group by session_id having length(trim(string_agg(text, chr(10) order by seq))) >= 50")
def a7_session_transcripts(spark, d):
    return Se.session_transcripts(read(spark, d, "segments"), "Session")


@query(using("surveys") + "select id, user_id is null or row_number() over (partition by user_id, project_id, meeting_date order by submitted_at, id) = 1 as accepted from surveys")
def d4_dedup_surveys(spark, d):
    return E.dedup_surveys(read(spark, d, "surveys")).select("id", "accepted")


@query(using("surveys") + ", a as (" + " union all ".join(f"select '{q}' as question, {q} as answer from surveys" for q in ("outcome", "card_helpful", "will_use_next")) + "), c as (select question, answer, count(*) as n from a group by question, answer) select question, answer, n, round(n / sum(n) over (partition by question), 6) as share from c")
def a9_survey_report(spark, d):
    return E.survey_report(read(spark, d, "surveys"))


_UUID = "substring(md5(cast(id as varchar(20))), 1, 8) || '-' || substring(md5(cast(id as varchar(20))), 1, 4) || '-4abc-8abc-' || substring(md5(cast(id as varchar(20))), 1, 12)"
_SURVEY = f"select id, case when id % 4 = 0 then 'p1' else {_UUID} end as project_id, case when id % 5 = 0 then '1.1.2024' else meeting_date end as meeting_date, case id % 3 when 0 then null when 1 then 'abc' else md5(outcome) || md5(outcome) end as company_name_hash, outcome, card_helpful, will_use_next, repeat('x', cast(id % 600 as int)) as free_text from surveys"


@query(using("surveys") + f""", s as ({_SURVEY}) select id, concat_ws('; ', case when not regexp_matches(project_id, '^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$') then 'project_id: a uuid' end, case when not regexp_matches(meeting_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then 'meeting_date: YYYY-MM-DD' end,
  case when company_name_hash is not null and not regexp_matches(company_name_hash, '^[0-9a-f]{{64}}$') then 'company_name_hash: 64 hex digits' end, case when outcome not in ('good', 'bad') then 'outcome: unknown' end, case when card_helpful not in ('yes') then 'card_helpful: unknown' end, case when will_use_next not in ('yes', 'no') then 'will_use_next: unknown' end, case when length(free_text) > 500 then 'free_text: 500 characters at most' end) as reasons from s""")
def v1_validate_surveys(spark, d):
    rows = spark.sql(_SURVEY.replace("from surveys", "from {surveys}"), surveys=read(spark, d, "surveys"))
    return E.validate_surveys(rows, ["good", "bad"], ["yes"], ["yes", "no"]).select("id", "reasons")


@query(using("surveys", "devices") + "select 'survey' as kind, coalesce(case when user_id % 5 <> 0 then user_id end, -1) as user_id, count(*) as n from surveys group by 2 union all select 'device', user_id, count(*) from devices where user_id % 5 <> 0 group by user_id")
def u5_anonymise_users(spark, d):
    s, dev = read(spark, d, "surveys"), read(spark, d, "devices")
    gone = s.select("user_id").unionByName(dev.select("user_id")).where("user_id % 5 = 0").distinct()
    kept, left = E.anonymise_users(gone, s, dev)
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.coalesce("user_id", F.lit(-1)).alias("user_id")).agg(F.count("*").alias("n"))
    return count(kept, "survey").unionByName(count(left, "device"))
