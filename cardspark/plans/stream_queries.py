"""Registered queries of notes, reviews, plugs and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import regexes as R
from ..operators import notes, review
from ..operators import retrieval as Re
from ..operators import text as T
from ..operators.card_index import CardIndex
from ..sources.shared import shared_dir, written
from ..streaming import jobs, state
from .tables import epoch_ms, read, using
from .text_queries import _POST, session_sql, trim

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _stream(spark, d, name):
    """A given table, a file or a folder of files, as a stream. A plain path would have to be a folder; a pattern may match either."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/{{{name}}}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


BASE = 1_700_000_000_000  # a time at which sessions made of numbered rows begin


_SPEECH = f"""select user_id as session_id, event_id as seq, {BASE} + event_id * 700 as ms, event_type || ' ' || props as text,
  case when event_id % 40 = 39 then 'stop' else case event_id % 5 when 0 then 'listening' when 1 then 'endpoint' when 2 then 'final' else 'interim' end end as type from {{events}}"""


#: Both what a pause commits before a row, and what the row commits; at the end, pauses that the last event time has passed.
@query(f"""with recursive e as (select *, row_number() over (partition by session_id order by seq) as rn from ({_SPEECH.format(events='events')})),
  r as (select distinct session_id, cast(0 as bigint) as rn, '' as interim, cast(0 as bigint) as done, cast(0 as bigint) as heard, cast(0 as bigint) as held, false as armed, false as begun, cast(0 as bigint) as last,
      cast(null as varchar) as before, cast(null as bigint) as before_seq, cast(null as varchar) as own, cast(null as bigint) as own_seq from e
    union all select session_id, rn, case when type = 'interim' then text when type = 'endpoint' then i else '' end, case when type = 'interim' then d when type = 'endpoint' then case when own is null then d else length(i) end else 0 end,
      case when type = 'interim' then ms else heard end, case when type = 'interim' then seq else held end, type = 'interim' and text <> '', type = 'listening' or (type <> 'stop' and b), ms, before, held, own, seq
    from (select *, case when type = 'final' and trim(substring(text, d + 1)) <> '' then substring(text, d + 1) when (type in ('endpoint', 'stop') or (type = 'listening' and b)) and trim(substring(i, d + 1)) <> '' then substring(i, d + 1) end as own
      from (select *, case when idle then '' else interim end as i, case when idle then 0 when before is null then done else length(interim) end as d, begun and not idle as b
        from (select *, case when paused and trim(substring(interim, done + 1)) <> '' then substring(interim, done + 1) end as before
          from (select e.session_id, e.rn, e.ms, e.seq, e.type, e.text, r.interim, r.done, r.heard, r.held, r.begun, r.armed and e.ms - r.heard >= 1500 as paused, r.last > 0 and e.ms - r.last >= {state.IDLE_MS} as idle
            from r join e on e.session_id = r.session_id and e.rn = r.rn + 1))))),
  ends as (select * from r where rn = (select max(rn) from e where e.session_id = r.session_id))
  select session_id, before_seq as seq, before as text from r where before is not null union all select session_id, own_seq, own from r where own is not null
  union all select session_id, held, substring(interim, done + 1) from ends where armed and trim(substring(interim, done + 1)) <> '' and heard + 1500 < (select max(ms) from e)""")
def st1_segment_speech(spark, d):
    rows = spark.sql(_SPEECH, events=_stream(spark, d, "events"))
    return jobs.run_once(state.fold_stream(rows.withColumn("ts", F.timestamp_millis("ms")), "session_id", state.Segmenter, "0 seconds"))


_RULES = "# heard wrongly\nin  =>  what in\nque => how que\n"
_SAID = f"""select conv_id as session_id, turn as seq, {BASE} + conv_id * 1000000 + turn * 1500 as ms, text from {{conversations}} where role = 'user'"""


@query(f"""with recursive o as (select *, row_number() over (partition by session_id order by seq) as rn from (select session_id, seq, ms, {trim('text')} as said from ({_SAID.format(conversations='conversations')}))),
  r as (select session_id, seq, rn, true as taken, said as t, ms as at from o where rn = 1 union all select o.session_id, o.seq, o.rn, not (o.said = r.t and o.ms - r.at < 4000), o.said, case when o.said = r.t and o.ms - r.at < 4000 then r.at else o.ms end from r join o on o.session_id = r.session_id and o.rn = r.rn + 1),
  {session_sql(f"select session_id as conv_id, seq, {trim('s')} as s from (select session_id, seq, replace(replace(t, 'in', 'what in'), 'que', 'how que') as s from r where taken)")}
  select conv_id as session_id, seq, q_type, case when q_type = 'follow_up' then substring(substring(prior, 1, 100) || '，' || s, 1, 200) else own end as q_text from g""")
def st2_stream_questions(spark, d):
    rows = spark.sql(_SAID, conversations=_stream(spark, d, "conversations")).withColumn("ts", F.timestamp_millis("ms"))
    return jobs.run_once(jobs.stream_questions(rows, T.parse_rules(_RULES)))


_LIMIT = "select a.user_id as k, a.event_id as seq, count(*) as n, count(*) <= 3 as allowed from events a join events b on b.user_id = a.user_id and epoch_ms(b.ts) > epoch_ms(a.ts) - 86400000 and (epoch_ms(b.ts) < epoch_ms(a.ts) or (epoch_ms(b.ts) = epoch_ms(a.ts) and b.event_id <= a.event_id)) group by a.user_id, a.event_id"


@query(_LIMIT)
def st3_stream_rate_limit(spark, d):
    rows = _stream(spark, d, "events").select("ts", F.col("user_id").alias("k"), F.col("event_id").alias("seq"), F.expr(epoch_ms("ts")).alias("ms"), F.lit(3).alias("most"), F.lit(86_400_000).alias("window_ms"))
    return jobs.run_once(state.fold_stream(rows, "k", state.Limiter, "1 day"))


@query("with a as (select cast(date_trunc('day', ts) as date) as day, user_id, event_id % 5 <> 0 as ok, cast(floor(value) as bigint) as tokens from events) select cast(day as varchar) as day, user_id, count(*) as calls, count(*) filter (ok) as ok, cast(sum(case when ok then tokens else 0 end) as bigint) as tokens from a where day < (select max(day) - 1 from a) group by day, user_id")
def st4_stream_usage(spark, d):
    rows = _stream(spark, d, "events").select("ts", "user_id", F.expr("event_id % 5 <> 0").alias("ok"), F.floor("value").alias("tokens"))
    days = jobs.run_once(jobs.stream_usage(rows)).withColumn("day", F.col("day").cast("date"))
    last = read(spark, d, "events").agg(F.date_sub(F.max("ts").cast("date"), 1).alias("last"))
    return days.join(F.broadcast(last), F.col("day") < F.col("last")).select(F.col("day").cast("string").alias("day"), "user_id", "calls", "ok", "tokens")


_CHANGES = """select card_id, case when card_id % 5 = 0 then 'Edited ' || title else title end as title, summary, details, tags, '=' || project_id as scope, 2 as updated_at, card_id % 7 = 0 as removed from {cards}
  union all select card_id, 'stale' as title, summary, details, tags, '=' || project_id as scope, 1 as updated_at, false as removed from {cards} where card_id % 11 = 0"""
_AFTER = using("cards").replace("cards as (", "first as (", 1) + f", changes as ({_CHANGES.format(cards='first')}), cards as (select * from changes where updated_at = 2 and not removed), {_POST}"


@query(_AFTER + f""", t as (select card_id, token, sum(case field {" ".join(f"when '{f}' then {v}" for f, v in zip(Re.FIELDS, Re.WEIGHTS["intended"]))} end * tf) as f, cast(sum(tf) as bigint) as tf from postings group by card_id, token)
  select card_id, token, cast(f as double) as f, tf, cast(sum(tf) over (partition by card_id) as bigint) as len from t""")
def st5_incremental_index(spark, d):
    """Two runs of one stream: all cards but some; then all, some of them edited, in two versions or removed. The index as it is then."""
    root = f"{shared_dir(spark)}/cards-{uuid.uuid4().hex}"
    cards = read(spark, d, "cards")
    changes = spark.sql(_CHANGES, cards=cards)
    first = cards.where("card_id % 3 <> 0").select("card_id", "title", "summary", "details", "tags", F.concat(F.lit("="), "project_id").alias("scope"), F.lit(0).alias("updated_at"), F.lit(False).alias("removed"))
    index = CardIndex(spark, f"{root}/index")
    for batch in (first, changes):
        batch.write.mode("append").parquet(f"{root}/changes")
        jobs.stream_index(spark.readStream.schema(batch.schema).parquet(f"{root}/changes"), index, f"{root}/state").awaitTermination()
    return index.postings()


PACK = 128  # chunks that come together
BUCKETS = 1 << 13  # of requests, that share a state
_THOUGHT = '<think>{"title": "not this one", "details": "thought of only"} hm </think> '


@query(f"""with c as (select *, length(title || summary || details || lang || source) - length(replace(title || summary || details || lang || source, ' ', '')) as spaces
    from (select doc_id, lang, source, split_part(text, chr(10), 1) as title, substring(text, 1, 200) as summary, substring(text, 1, 2000) as details from documents))
  select doc_id as request_id, spaces + case when doc_id % 4 = 3 then {_THOUGHT.count(' ')} else 0 end as seq, title, 'domain_fact' as type from c where length(title) between 2 and 100 and length(details) >= 10""")
def st6_stream_cards(spark, d):
    """Replies of one card, and its like once more, in chunks: whole, broken off in the second, broken off before the first one's last brace, and after a think block.

    A chunk ends after each space; some PACK of them come together, so that a reply is a few rows of the stream and not a row a word.
    """
    rows = _stream(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.substring("text", 1, 200).alias("summary"), F.substring("text", 1, 2000).alias("details"), F.array("lang", "source").alias("tags"))
    one, two = F.to_json(F.struct("title", "summary", "details", "tags")), F.to_json(F.struct("title", "summary", "details"))
    kind = F.col("doc_id") % 4
    reply = F.when(kind == 2, F.concat(F.lit("["), F.regexp_replace(one, r"\}$", ""))).otherwise(F.concat(F.when(kind == 3, _THOUGHT).otherwise(""), F.lit("["), one, F.lit(","), F.when(kind == 1, F.regexp_replace(two, '"\\}$', "")).otherwise(F.concat(two, F.lit("]")))))
    chunks = rows.select(F.col("doc_id").alias("request_id"), F.split(reply, "(?<= )").alias("chunks")).withColumn("n", F.size("chunks"))
    packs = chunks.select("request_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PACK))).alias("at"), "n", "chunks").withColumn("pack", F.slice("chunks", F.col("at") + 1, PACK))
    seq = F.col("at").cast("long")
    ms = BASE + seq
    told = packs.select("request_id", seq.alias("seq"), ms.alias("ms"), F.timestamp_millis(ms).alias("ts"), F.array_join("pack", "").alias("chunk"), (F.col("at") + PACK >= F.col("n")).alias("last"), F.transform("pack", lambda c: F.length(c)).alias("sizes"))
    return jobs.run_once(state.fold_stream(told, "request_id", state.CardReader, "1 minute", buckets=BUCKETS))


_W = review.WEIGHTS
_D0 = lambda g: f"least(10.0, greatest(1.0, {_W[4]} - exp({_W[5]} * ({g} - 1)) + 1))"
_FACTOR = f"(power(0.9, 1 / -{_W[20]}) - 1)"
_FSRS = f"""with recursive o as (select k, ms, cast(id % 6 as int) as g, row_number() over (partition by k order by ms, id) as rn from ({{hits}})),
  r as (select distinct k, cast(0 as bigint) as rn, 'new' as state, cast(0 as double) as s, cast(0 as double) as d, cast(0 as bigint) as reps, cast(0 as bigint) as lapses, cast(0 as bigint) as last from o
    union all select k, rn, case when not ok then state when g = 1 then case when state in ('review', 'relearning') then 'relearning' else 'learning' end
        when state <> 'review' and g < 4 and (g = 2 or state = 'new') then case when state = 'relearning' then state else 'learning' end else 'review' end,
      case when not ok then s else greatest(0.001, case when state = 'new' then case g when 1 then {_W[0]} when 2 then {_W[1]} when 3 then {_W[2]} else {_W[3]} end
        when days = 0 then s * case when g >= 3 then greatest(1.0, grow) else grow end
        when g = 1 then least(s, {_W[11]} * power(d, -{_W[12]}) * (power(s + 1, {_W[13]}) - 1) * exp({_W[14]} * (1 - kept)))
        else s * (1 + exp({_W[8]}) * (11 - d) * power(s, -{_W[9]}) * (exp({_W[10]} * (1 - kept)) - 1) * case g when 2 then {_W[15]} when 4 then {_W[16]} else 1 end) end) end,
      case when not ok then d when state = 'new' then {_D0('g')} else least(10.0, greatest(1.0, {_W[7]} * {_D0(4)} + (1 - {_W[7]}) * (d - {_W[6]} * (g - 3) * (10 - d) / 9))) end,
      reps + cast(ok as bigint), lapses + cast(ok and g = 1 and state = 'review' as bigint), case when ok then ms else last end
    from (select *, case when state <> 'new' then power(1 + {_FACTOR} * days / s, -{_W[20]}) end as kept, case when state <> 'new' then exp({_W[17]} * (g - 3 + {_W[18]})) * power(s, -{_W[19]}) end as grow
      from (select o.k, o.rn, o.ms, o.g, o.g between 1 and 4 as ok, r.state, cast(r.s as double) as s, cast(r.d as double) as d, r.reps, r.lapses, r.last, greatest(0, (o.ms - r.last) // 86400000) as days from r join o on o.k = r.k and o.rn = r.rn + 1)))
  select k as card_id, state, reps, lapses, round(s, 6) as stability, round(d, 6) as difficulty from r where rn = (select max(rn) from o where o.k = r.k)"""


@query(_FSRS.replace("{hits}", "select user_id as k, event_id as id, epoch_ms(ts) as ms from events"))
def st7_review_cards(spark, d):
    """The earlier half of the reviews as a table, the later half as a stream that goes on from it."""
    columns = [F.col("user_id").alias("card_id"), F.expr(epoch_ms("ts")).alias("ms"), F.col("event_id").alias("seq"), F.expr("cast(event_id % 6 as int)").alias("rating"), "ts"]
    rows = read(spark, d, "events").select(*columns)
    half = rows.agg(F.expr("timestamp_millis(cast((min(ms) + max(ms)) / 2 as bigint))")).first()[0]
    known = written(review.review_cards(rows.where(F.col("ts") < half), digits=15))
    late = jobs.run_once(jobs.stream_reviews(_stream(spark, d, "events").select(*columns).where(F.col("ts") >= half), known))
    last = late.groupBy("card_id").agg(F.max_by(F.struct("state", "reps", "lapses", "stability", "difficulty"), F.col("seq")).alias("x")).select("card_id", "x.*")
    rest = known.join(last, "card_id", "left_anti").select("card_id", "state", "reps", "lapses", F.round("stability", 6).alias("stability"), F.round("difficulty", 6).alias("difficulty"))
    return last.unionByName(rest)


@query(rf"""select doc_id, 'N ' || doc_id as title, 'a,b,' || lang as tags, {trim(r"'# N ' || doc_id || chr(10) || '标签：a、b、' || lang || chr(10) || chr(10) || '# H' || chr(10) || chr(10) || 'Call' || chr(10) || ' b t h' || chr(10) || '- ' || regexp_replace(regexp_replace(text, '(?s)%%.*?%%', '', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')")} as text from documents""")
def t7_clean_note(spark, d):
    raw = F.concat(F.lit("---\ntitle: 'N "), F.col("doc_id"), F.lit("'\ntags: [a, #b, "), F.col("lang"), F.lit("]\n---\n# H\n\n> [!note] Call\n> ![[x]] [[a|b]] [t](u_(v)) ==h==\n- [ ] "), F.col("text"))
    return notes.import_notes(read(spark, d, "documents").select("doc_id", raw.alias("raw"))).select("doc_id", "title", F.array_join("tags", ",").alias("tags"), "text")


_MARKS = notes.YAML_MARKS.replace("'", "''")
_YAML = lambda x: f"case when {x} = '' or translate({x}, '{_MARKS}', '') <> {x} or regexp_matches({x}, '^[?-]|^{R.SPACE}|{R.SPACE}$') then cast(to_json({x}) as varchar) else {x} end"


@query(using("cards") + f"""select card_id, array_to_string(['---', 'title: ' || {_YAML('title')}, 'type: ' || type, 'important: ' || is_important, 'verified: ' || user_verified, 'project: ' || {_YAML('project_id')}, 'tags:',
  '  - cards', '  - ' || type, '  - ' || {_YAML('tags[1]')}, '  - ' || {_YAML('tags[2]')}, 'generated_by: cardspark', 'card_id: ' || card_id, '---', '', '# ' || title, '', '> [!question] ' || summary, '', {trim('details')}, ''], chr(10)) as content from cards""")
def t24_note_markdown(spark, d):
    return notes.note_markdown(read(spark, d, "cards").withColumn("project", F.col("project_id")), "cards", "cardspark")
