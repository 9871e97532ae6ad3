"""Registered queries and oracles: cards, materials, notes, exports, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import text as T
from ..sources import io
from .tables import read, using
from .text_queries import _NAME, S, trim

QUERIES, ORACLES = {}, {}
_PRI = "case type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(C.TYPE_ORDER)) + " else 9 end"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query(using("cards") + "select card_id, project_id, type, title, array_to_string(tags, ',') as tags, confidence, is_important, coalesce(due_at, -1) as due_at from cards")
def io1_load_tables(spark, d):
    return read(spark, d, "cards").select("card_id", "project_id", "type", "title", F.array_join("tags", ",").alias("tags"), "confidence", "is_important", F.coalesce("due_at", F.lit(-1)).alias("due_at"))


_EXT = "case doc_id % 6 when 0 then '.md' when 1 then '.PY' when 2 then '.exe' when 3 then '.txt' when 4 then '' else '.json' end"
_FILES = f"select source as folder, case when doc_id % 7 = 0 then '.' else 'f' end || doc_id || {_EXT} as name, n_chars * 1000 as size, doc_id % 8 as depth, text as content from documents"


@query(rf"""with f as ({_FILES}), g as (select *, row_number() over (partition by folder order by name) as n from f where lower(regexp_extract(name, '\.([^./]+)$', 1)) in ({", ".join(f"'{x}'" for x in io.TEXT_EXTENSIONS)}) and name not like '.%' and depth <= 5 and size < 52428800)
  select folder, count(*) as n_files, string_agg('### ' || name || chr(10) || content || chr(10), '' order by n) as text from g where n <= 30 group by folder""")
def io3_select_files(spark, d):
    files = spark.sql(_FILES.replace("from documents", "from {documents}"), documents=read(spark, d, "documents"))
    return io.select_files(files)


@query(rf"""with c as (select *, row_number() over (partition by source order by doc_id desc, text) as n from documents), l as (select source, string_agg(split_part(text, chr(10), 1), chr(10) order by n) as log from c where n <= 30 group by source),
  f as (select source, 'f' || doc_id || '.md' as path, text, row_number() over (partition by source order by 'f' || doc_id || '.md') as n from documents where strlen(text) < 50000),
  b as (select source, string_agg('### ' || path || chr(10) || substring(text, 1, 8000), chr(10) order by n) as blobs from f where n <= 10 group by source),
  t as (select r.source as repo, '# ' || r.source || chr(10) || 'about' || chr(10) || 'en' || chr(10) || 'readme' || chr(10) || chr(10) || log || coalesce(chr(10) || chr(10) || blobs, '') as text from (select distinct source from documents) r left join l using (source) left join b using (source))
  select repo, case when strlen(text) <= 5242880 then text else substring(text, 1, 5242880) || chr(10) || chr(10) || '[内容过长，已截断]' end as text from t""")
def io5_repo_digest(spark, d):
    docs = read(spark, d, "documents")
    repos = docs.select(F.col("source").alias("repo")).distinct().withColumns({"description": F.lit("about"), "language": F.lit("en"), "readme": F.lit("readme")})
    commits = docs.select(F.col("source").alias("repo"), F.col("doc_id").alias("at"), F.col("text").alias("message"))
    files = docs.select(F.col("source").alias("repo"), F.concat(F.lit("f"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))
    return io.repo_digest(repos, commits, files)


_TARGET = "select user_id as u, event_id % 3 as dev, min(event_id) as first_seen, max(event_id) as last_seen from events where event_id % 2 = 0 group by user_id, event_id % 3"
_UPDATES = "select user_id as u, event_id % 3 as dev, min(event_id) as first_seen, max(event_id) as last_seen from events where event_id % 2 = 1 group by user_id, event_id % 3"


@query(f"select coalesce(t.u, n.u) as u, coalesce(t.dev, n.dev) as dev, coalesce(t.first_seen, n.first_seen) as first_seen, coalesce(n.last_seen, t.last_seen) as last_seen from ({_TARGET}) t full join ({_UPDATES}) n on t.u = n.u and t.dev = n.dev")
def io8_upsert(spark, d):
    e = read(spark, d, "events")
    run = lambda q: spark.sql(q.replace("from events", "from {events}"), events=e)
    return io.upsert(run(_TARGET), run(_UPDATES), ["u", "dev"], keep=["first_seen"])


@query(using("cards") + "select card_id from (select *, row_number() over (partition by project_id, title order by card_id) as n from cards) where n = 1")
def d1_dedup_titles(spark, d):
    return C.dedup_titles(read(spark, d, "cards")).select("card_id")


@query("with recursive " + using("cards").removeprefix("with ") + """, k as (select project_id, card_id, list_distinct(regexp_extract_all(lower(title || summary), '[a-z0-9]{2,}')) as k from cards),
  w as (select project_id, card_id, len(k) as n, unnest(k) as w from k),
  p as (select a.card_id as late, b.card_id as early from w a join w b on a.project_id = b.project_id and a.w = b.w and b.card_id < a.card_id group by a.card_id, b.card_id, a.n, b.n having count(*) / least(a.n, b.n) > 0.65),
  e as (select late, list(early) as before from p group by late),
  o as (select project_id, card_id, coalesce(before, cast([] as bigint[])) as before, row_number() over (partition by project_id order by card_id) as rn from cards left join e on late = card_id),
  r as (select distinct project_id, cast(0 as bigint) as rn, cast(null as bigint) as card_id, cast([] as bigint[]) as kept, false as stays from o
    union all select o.project_id, o.rn, o.card_id, case when list_has_any(r.kept, o.before) then r.kept else list_append(r.kept, o.card_id) end, not list_has_any(r.kept, o.before) from r join o on o.project_id = r.project_id and o.rn = r.rn + 1)
  select card_id, project_id from r where stays""")
def d2_dedup_cards(spark, d):
    return C.dedup_cards(read(spark, d, "cards")).select("card_id", "project_id")


@query(using("notes") + """, r as (select project_id, 'folder' as kind, folder as name, count(*) as n from notes group by project_id, folder union all
  select project_id, 'tag', t, count(*) from (select project_id, unnest(list_distinct(tags)) as t from notes) group by project_id, t) select *, row_number() over (partition by project_id, kind order by n desc, name) as place from r""")
def a1_scope_facets(spark, d):
    return C.scope_facets(read(spark, d, "notes"))


@query(using("notes") + "select project_id, count(*) as total, count(*) filter (status = 'new') as new, count(*) filter (status = 'changed') as changed, count(*) filter (status = 'unchanged') as unchanged from notes group by project_id")
def a2_scan_summary(spark, d):
    return C.scan_summary(read(spark, d, "notes"))


@query(using("cards") + "select project_id, type, count(*) as n from cards group by project_id, type")
def a3_type_counts(spark, d):
    return C.type_counts(read(spark, d, "cards"))


@query(using("cards") + "select project_id, least(25, case when count(*) filter (is_important) >= 3 then count(*) filter (is_important) else count(*) end) as auto, count(*) as all, count(*) filter (is_important) as important from cards group by project_id".replace("as all", 'as "all"'))
def a4_export_counts(spark, d):
    return C.export_counts(read(spark, d, "cards"))


_PROFILE, _APPLICATION = {"notes": ["obsidian", "text"], "code": ["github"]}, {"site": ["company_url", "company"], "files": ["file", "zip"], "talks": ["meeting"]}
_COVER = lambda kinds: " + ".join(f"cast(list_has_any(have, [{', '.join(repr(x) for x in k)}]) as int)" for k in kinds.values())


@query(using("materials", "projects") + f", h as (select project_id, list_distinct(list_concat(list(type), list(category))) as have from materials group by project_id), p as (select id, is_profile, coalesce(have, cast([] as varchar[])) as have from projects left join h on id = project_id) select id, case when is_profile then {_COVER(_PROFILE)} else {_COVER(_APPLICATION)} end as covered, case when is_profile then 2 else 3 end as total from p")
def a5_material_coverage(spark, d):
    return C.material_coverage(read(spark, d, "materials"), read(spark, d, "projects"), _PROFILE, _APPLICATION)


def _env(x):
    return trim(f"regexp_replace({x}, '[<>\"]', '', 'g')")


_PROMPT = 12_000
_CUT = f"case when length(raw_content) <= {_PROMPT} then raw_content else substring(raw_content, 1, {_PROMPT // 2}) || chr(10) || '[…素材中段已省略…]' || chr(10) || right(raw_content, {_PROMPT // 2}) end"


@query(using("materials", "projects") + rf""", e as (select project_id, uploaded_at, id, '<material type="' || {_env('type')} || '" ref="' || {_env('source_ref')} || '">' || chr(10) || regexp_replace({_CUT}, '(?i)<{S}*/{S}*material{S}*>', '<\\/material>', 'g') || chr(10) || '</material>' as t from materials where category = 'project')
  select project_id, 'role: ' || split_part(any_value(target_role), chr(10), 1) || chr(10) || 'jd: ' || any_value(jd_text) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by uploaded_at, e.id) as prompt from e join projects p on p.id = project_id group by project_id""")
def a6_prompt_assembly(spark, d):
    return C.prompt_assembly(read(spark, d, "materials"), read(spark, d, "projects"), limit=_PROMPT)


_K1 = {"oldest": "created_at, ", "confidence_desc": "confidence desc, ", "important": "is_important desc, ", "review": "coalesce(due_at, 0), "}


@query(using("cards") + "select card_id, " + ", ".join(f"row_number() over (partition by project_id order by {o} created_at desc, card_id) as {k}" for k, o in _K1.items()) + " from cards")
def k1_sort_cards(spark, d):
    rows = read(spark, d, "cards")
    for k in _K1:
        rows = C.sort_cards(rows, k).withColumnRenamed("place", k)
    return rows.select("card_id", *_K1)


_SELECT = using("cards", "projects") + f", s as (select *, row_number() over (partition by project_id order by {_PRI}, card_id) as place from (select *, count(*) filter (is_important) over (partition by project_id) as imp from cards) where imp < 3 or is_important), x as (select * from s where place <= 25)"


@query(_SELECT + " select card_id, project_id, place from x")
def k2_select_export(spark, d):
    return C.select_export(read(spark, d, "cards")).select("card_id", "project_id", "place")


@query(using("cards") + "select card_id, row_number() over (partition by project_id order by due_at nulls first, card_id) as place from cards where due_at is null or due_at <= 500")
def k3_due_cards(spark, d):
    return C.due_cards(read(spark, d, "cards"), 500).select("card_id", "place")


@query(using("projects", "materials") + """, p as (select id, row_number() over (order by updated_at desc, id) as place from projects where not is_profile)
  select p.id as project_id, p.place as project_place, m.id as material, row_number() over (partition by p.id order by uploaded_at desc, m.id) as place from p left join materials m on m.project_id = p.id""")
def k4_project_list(spark, d):
    p = C.project_list(read(spark, d, "projects")).select(F.col("id").alias("project_id"), F.col("place").alias("project_place"))
    return p.join(C.material_list(read(spark, d, "materials")).select("project_id", F.col("id").alias("material"), "place"), "project_id", "left").withColumn("place", F.coalesce("place", F.lit(1)))


@query(using("cards") + "select card_id, row_number() over (partition by project_id order by confidence desc, created_at desc, card_id) as place from cards where type = 'data_metric'")
def k5_filter_library(spark, d):
    return C.sort_cards(read(spark, d, "cards").where("type = 'data_metric'"), "confidence_desc").select("card_id", "place")


@query(using("notes") + "select id from notes where folder in ('dir1', 'dir2') and list_has_any(tags, ['github', 'obsidian', 'file']) and status <> 'unchanged'")
def k6_filter_notes(spark, d):
    return C.filter_notes(read(spark, d, "notes"), ["dir1", "dir2"], ["github", "obsidian", "file"], True).select("id")


@query(_SELECT + """, c as (select *, case when row_number() over (partition by project_id, type order by place) = 1 then '## ' || type || chr(10) || chr(10) else '' end || '### ' || case when is_important then '★ ' else '' end || title || chr(10) || '> ' || summary || chr(10) || chr(10) || details || chr(10) || chr(10) || '*关键词：' || array_to_string(tags, ' · ') || '*' || chr(10) as t from x)
  select project_id, '# ' || any_value(name) || ' · 会议备忘录' || chr(10) || '**会议主题：** ' || split_part(any_value(target_role), chr(10), 1) || '    **生成日期：** 2026年1月1日' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg(t, chr(10) order by place) || chr(10) || '---' || chr(10) || '*共 ' || count(*) || ' 张卡片 · cardspark*' as sheet
  from c join projects on id = project_id group by project_id""")
def k7_cheat_sheet(spark, d):
    return C.cheat_sheet(read(spark, d, "cards"), read(spark, d, "projects"), "2026年1月1日", "cardspark")


@query(_SELECT + f""", t as (select project_id, type, {_PRI} as p, '## ' || type || chr(10) || string_agg('- ' || case when is_important then '★ ' else '' end || '[[n' || card_id || ']]', chr(10) order by place) || chr(10) as b, count(*) as n from x group by project_id, type)
  select project_id, '# ' || any_value(name) || ' · 会议卡片索引' || chr(10) || '**会议主题：** ' || split_part(any_value(target_role), chr(10), 1) || chr(10) || chr(10) || '共 ' || sum(n) || ' 张卡片。' || chr(10) || chr(10) || string_agg(b, chr(10) order by p) as note from t join projects on id = project_id group by project_id""")
def k8_index_note(spark, d):
    rows = C.select_export(read(spark, d, "cards")).withColumn("filename", F.concat(F.lit("n"), "card_id"))
    return C.index_note(rows, read(spark, d, "projects"))


_TAKEN = "case when card_id % 4 = 0 then 'Note' when card_id % 4 = 1 then 'note ' || (2 + card_id % 3) else t end"


@query("with recursive " + using("cards").removeprefix("with ") + f""", n as (select project_id, card_id, coalesce(nullif({_NAME}, ''), '卡片') as name from (select project_id, card_id, {_TAKEN} as t from (select *, title as t from cards))),
  o as (select *, lower(name) as low, row_number() over (partition by project_id order by card_id) as rn from n),
  r as (select distinct project_id, cast(0 as bigint) as rn, cast(null as bigint) as card_id, cast(null as varchar) as filename, cast([] as varchar[]) as used from o
    union all select project_id, rn, card_id, name || suffix, list_append(used, low || suffix) from (select o.project_id, o.rn, o.card_id, o.name, o.low, r.used,
      case when list_contains(r.used, o.low) then ' ' || list_filter(range(2, len(r.used) + 3), lambda k: not list_contains(r.used, o.low || ' ' || k))[1] else '' end as suffix from r join o on o.project_id = r.project_id and o.rn = r.rn + 1))
  select project_id, card_id, filename from r where rn > 0""")
def w8_unique_filenames(spark, d):
    """All cards of each project, many of which have one name, and some the names that those get."""
    rows = read(spark, d, "cards").withColumn("t", F.col("title"))
    return C.unique_filenames(rows.select("project_id", "card_id", F.col("card_id").alias("place"), T.safe_filename(F.expr(_TAKEN)).alias("name")))


@query(using("notes") + ", p as (select * from materials where id % 4 <> 0) select n.id, case when p.id is null then 'new' when p.source_mtime is null or floor(n.mtime_ms / 1000) > p.source_mtime then 'changed' else 'unchanged' end as status from notes n left join p on p.project_id = n.project_id and p.source_ref = n.source_ref")
def j2_note_status(spark, d):
    notes = read(spark, d, "notes").drop("status")
    return C.note_status(notes, read(spark, d, "materials").where("id % 4 <> 0")).select("id", "status")


_HASH = "select card_id, sha1(title || summary) as hash from cards"
_STATE = "select card_id, case when card_id % 3 = 0 then null else sha1(title || case when card_id % 4 = 0 then 'old' else summary end) end as content_hash from cards where card_id % 5 <> 0"


def _state(spark, d):
    cards = read(spark, d, "cards")
    run = lambda q: spark.sql(q.replace("from cards", "from {cards}"), cards=cards)
    return run(_HASH), run(_STATE)


@query(using("cards") + f"select h.card_id from ({_HASH}) h left join ({_STATE}) s using (card_id) where hash is distinct from content_hash")
def j3_changed_cards(spark, d):
    return C.changed_cards(*_state(spark, d)).select("card_id")


@query(using("cards") + "select card_id from cards where card_id % 5 = 0")
def j4_unindexed_cards(spark, d):
    return C.unindexed_cards(*_state(spark, d)).select("card_id")


@query(using("projects", "materials", "cards") + "select 'project' as kind, id as project_id, count(*) as n, count(case when parent_project_id <> 'src0' then 1 end) as parents from projects where id not in ('src0', 'src1') group by id union all select 'material', project_id, count(*), 0 from materials where project_id not in ('src0', 'src1') group by project_id union all select 'card', project_id, count(*), 0 from cards where project_id not in ('src0', 'src1') group by project_id")
def j5_cascade_delete(spark, d):
    p, m, c = C.cascade_delete(read(spark, d, "projects"), read(spark, d, "materials"), read(spark, d, "cards"), spark.createDataFrame([("src0",), ("src1",)], "id string"))
    count = lambda df, kind, key, extra: df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("project_id")).agg(F.count("*").alias("n"), extra.alias("parents"))
    zero = F.sum(F.lit(0)).cast("bigint")
    return count(p, "project", "id", F.count("parent_project_id")).unionByName(count(m, "material", "project_id", zero)).unionByName(count(c, "card", "project_id", zero))


@query(using("materials", "cards") + "select sha256(card_id || '|copy') as card_id, case when m.id is not null then sha256(m.id || '|copy') end as material, false as verified, title from cards c left join (select id from materials where project_id = 'src2') m on c.source_material_id = m.id where c.project_id = 'src2'")
def j6_clone_project(spark, d):
    m = read(spark, d, "materials")
    return C.clone_project(m, read(spark, d, "cards"), "src2", "copy")[1].select("card_id", F.col("source_material_id").alias("material"), F.col("user_verified").alias("verified"), "title")


@query(using("cards") + "select card_id from cards where card_id % 13 <> 1 and project_id not in (select project_id from cards where card_id % 13 = 1) union all select card_id from cards where card_id % 13 = 1")
def u1_replace_cards(spark, d):
    c = read(spark, d, "cards")
    return C.replace_cards(c.where("card_id % 13 <> 1"), c.where("card_id % 13 = 1")).select("card_id")


@query(using("cards") + "select card_id, is_important or card_id % 6 = 0 as is_important, case when card_id % 6 = 0 then 9 else created_at end as updated_at from cards")
def u2_batch_flags(spark, d):
    c = read(spark, d, "cards").withColumnRenamed("created_at", "updated_at")
    return C.batch_flags(c, c.where("card_id % 6 = 0").select("card_id"), "is_important", True, 9).select("card_id", "is_important", "updated_at")


@query(using("cards") + f"select card_id, case when card_id % 4 = 0 then substring({trim('details')}, 1, 100) else title end as title, case when card_id % 4 = 0 and card_id % 8 <> 0 then substring({trim('details')}, 1, 300) else summary end as summary, details from cards")
def u3_edit_cards(spark, d):
    c = read(spark, d, "cards")
    patches = c.where("card_id % 4 = 0").select("card_id", F.col("details").alias("title"), F.expr("case when card_id % 8 <> 0 then details end").alias("summary"), F.lit(None).cast("string").alias("details"))
    return C.edit_cards(c, patches).select("card_id", "title", "summary", "details")


@query(using("materials") + "select id, case when type = 'company_url' and category = 'project' then 'company' else category end as category from materials")
def u6_backfill_category(spark, d):
    return C.backfill_category(read(spark, d, "materials")).select("id", "category")


_ISSUES = "concat_ws('; ', case when coalesce(length(title), 0) between 2 and 100 then null else 'title: 2 to 100 characters' end, case when length(summary) <= 300 then null else 'summary: 0 to 300 characters' end, case when coalesce(length(details), 0) between 10 and 2000 then null else 'details: 10 to 2000 characters' end)"


@query(using("cards") + f", a as (select *, {_ISSUES} as issues from cards) select card_id as request_id, 0 as seq, case when issues = '' then title end as title, case when issues = '' then type end as type, issues from a union all select card_id, 1, null, null, 'title: 2 to 100 characters; details: 10 to 2000 characters' from a")
def t12_parse_cards(spark, d):
    body = F.concat(F.lit("<think>x</think>```json\n["), F.to_json(F.struct("title", "summary", "details", "tags", "type", "confidence")), F.lit(",{\"title\": 1}"), F.when(F.col("card_id") % 3 == 0, ",{\"tit").otherwise("]"))
    return C.parse_cards(read(spark, d, "cards").select(F.col("card_id").alias("request_id"), "project_id", body.alias("raw"))).select("request_id", "seq", "card.title", "card.type", F.array_join("issues", "; ").alias("issues"))


@query("with a as (select page_id, length(html) as h from pages) select page_id, case when h >= 500 then 'static' when page_id % 2 = 0 then 'render' when page_id % 9 = 0 then 'too_short' else 'rendered' end as route from a")
def v3_fetch_route(spark, d):
    rendered = F.expr("case when page_id % 2 = 0 then null when page_id % 9 = 0 then 'x' else repeat('x', 60) end")
    return read(spark, d, "pages").select("page_id", T.fetch_route(F.col("html"), rendered).alias("route"))
