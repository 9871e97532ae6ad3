"""Registered queries and oracles: text rules, questions, retrieval."""

from __future__ import annotations

from hashlib import sha1

from pyspark.sql import functions as F

from ..functions import regexes as R
from ..operators import questions as Q
from ..operators import retrieval as Re
from ..operators import text as T
from ..operators.card_index import CardIndex
from ..sources.shared import shared_dir
from .tables import read, using

QUERIES, ORACLES = {}, {}
S = R.SPACE


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def word(x: str) -> str:
    return rf"(^|[^A-Za-z0-9_])({x})($|[^A-Za-z0-9_])"


@query("""select doc_id, case when strlen(text) <= 3000 then text else substring(text, 1, 3000) || chr(10) || chr(10) || '[内容过长，已截断]' end as out from documents""")
def t1_truncate_material(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate_material(F.col("text"), 3000).alias("out"))


@query("""select doc_id, case when length(text) <= 800 then text else substring(text, 1, 400) || chr(10) || '[…素材中段已省略…]' || chr(10) || right(text, 400) end as out from documents""")
def t2_truncate_head_tail(spark, d):
    return read(spark, d, "documents").select("doc_id", T.truncate_head_tail(F.col("text"), 800).alias("out"))


@query(rf"""select page_id, regexp_replace(replace(html, '</p>', '</ Material >'), '(?i)<{S}*/{S}*material{S}*>', '<\\/material>', 'g') as body, {trim('''regexp_replace(html, '[<>"]', '', 'g')''')} as attr from pages""")
def t3_escape_envelope(spark, d):
    html = F.replace(F.col("html"), F.lit("</p>"), F.lit("</ Material >"))
    return read(spark, d, "pages").select("page_id", T.escape_envelope(html).alias("body"), T.escape_attribute(F.col("html")).alias("attr"))


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
_PLAIN = "regexp_replace(regexp_replace(case when regexp_matches(h, '(?is)<(article|main)[^>]*>.*</(article|main)>') then regexp_extract(h, '(?is)<(?:article|main)[^>]*>(.*)</(?:article|main)>', 1) else h end, '<[^>]+>', ' ', 'g'), '" + S + "{2,}', chr(10), 'g')"


@query(f"with a as (select page_id, {_STRIPPED} as h from pages) select page_id, {trim(_PLAIN)} as out from a")
def t4_strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("out"))


def _attr(name):
    return rf"""regexp_extract(m, '(?i)\s{name}=["'']([^"'']*)["'']', 1)"""


@query(rf"""with a as (select page_id, url, regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1) as t0,
    list_filter(list_transform(regexp_extract_all(html, '(?i)<meta\s[^>]*>'), lambda m: {{'p': lower({_attr('property')}), 'n': lower({_attr('name')}), 'c': {_attr('content')}}}), lambda x: length(x.c) between 1 and {T.SITE_CHARS}) as ms from pages),
  b as (select *, nullif({trim("list_filter(ms, lambda x: x.p = 'og:site_name')[1].c")}, '') as m0, nullif({trim("list_filter(ms, lambda x: x.n = 'application-name')[1].c")}, '') as m1,
    nullif({trim(rf"string_split_regex(nullif({trim(f'case when length(t0) <= {T.TITLE_CHARS} then t0 end')}, ''), '\s*[-|–—·]\s*')[1]")}, '') as t, regexp_replace(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1), '^www\.', '') as h from a)
  select page_id, coalesce(m0, m1, case when length(t) > 1 then substring(t, 1, 60) end, substring(split_part(h, '.', 1), 1, 40)) as site from b""")
def t5_site_name(spark, d):
    return read(spark, d, "pages").select("page_id", T.site_name(F.col("html"), F.col("url")).alias("site"))


RULES = T.parse_rules("# fixes\nthe => THE\n\nTHE on => theon\n a{num}b{num} => x\ntt => \nen{num} => n\ng => g.$\n")


@query("""select conv_id, turn, replace(replace(replace(regexp_replace(replace(text, 'the', 'THE'), 'x^', '', 'g'), 'THE on', 'theon'), 'tt', ''), 'g', 'g.$') as out from conversations""".replace("replace(replace(replace(regexp", "replace(regexp_replace(replace(replace(regexp").replace("'tt', '')", "'tt', ''), 'en([0-9０-９零一二三四五六七八九十百千万两]+)', 'n', 'g')"))
def t6_apply_corrections(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.apply_corrections(F.col("text"), RULES).alias("out"))


@query(using("materials") + "select id, case when contains(source_ref, '/') then split_part(source_ref, '/', 1) else '' end as folder from materials")
def t8_note_folder(spark, d):
    return read(spark, d, "materials").select("id", T.note_folder(F.col("source_ref")).alias("folder"))


_ZH = "translate(text, 'aeiou', '缓存层高并')"


@query(rf"""with a as (select conv_id, turn, {_ZH} as t, regexp_extract_all({_ZH}, '({R.HAN}{{2,}})', 1) as runs from conversations),
  b as (select conv_id, turn, t, array_to_string(flatten(list_transform(runs, lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))), ' ') as g from a)
  select conv_id, turn, g as bigrams, case when g = '' then t else t || ' ' || g end as indexed from b""")
def t9_zh_bigrams(spark, d):
    t = F.translate("text", "aeiou", "缓存层高并")
    return read(spark, d, "conversations").select("conv_id", "turn", T.zh_bigrams(t).alias("bigrams"), T.inject_bigrams(t).alias("indexed"))


@query("select item_id, w.token, w.at from (select item_id, unnest(list_transform(list_distinct(x), lambda t: {'token': t, 'at': list_position(list_filter(x, lambda y, i: list_position(x, y) = i), t)})) as w from (select item_id, regexp_extract_all(lower(text), '([a-z0-9]{3,})', 1) as x from benchmark))")
def t10_tokenize_query(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(T.tokenize_query(F.col("text"))).alias("i", "token")).select("item_id", "token", (F.col("i") + 1).alias("at"))


_TH = "replace(replace(text, 'ing', '<think>'), 'and', '</think>')"


@query(rf"with a as (select conv_id, turn, regexp_replace({_TH}, '(?is)<think[^>]*>.*?</think>', '', 'g') as out from conversations) select conv_id, turn, out, regexp_matches(out, '(?i)<think[^>]*>') as open from a")
def t11_strip_think(spark, d):
    t = F.replace(F.replace("text", F.lit("ing"), F.lit("<think>")), F.lit("and"), F.lit("</think>"))
    return read(spark, d, "conversations").select("conv_id", "turn", T.strip_think(t).alias("out"), T.open_think(t).alias("open"))


@query(using("cards") + "select card_id, substring(array_to_string(list_filter([title, summary, details], lambda x: x <> ''), '。'), 1, 1800) as passage from cards")
def t14_passage_text(spark, d):
    return read(spark, d, "cards").select("card_id", T.passage_text(F.col("title"), F.col("summary"), F.col("details")).alias("passage"))


@query(using("cards") + "select card_id, sha1(concat_ws(chr(1), title, summary, details, array_to_string(tags, ','))) as hash from cards")
def t15_content_hash(spark, d):
    return read(spark, d, "cards").select("card_id", T.content_hash(F.col("title"), F.col("summary"), F.col("details"), F.col("tags")).alias("hash"))


@query(rf"""with a as (select conv_id, turn, text, list_filter(list_transform(regexp_extract_all(text, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: {trim('x')}), lambda x: length(x) >= 15) as k from conversations)
  select conv_id, turn, case when len(k) > 0 then array_to_string(k[1:2], '') else substring(text, 1, 80) || '…' end as out from a""")
def t16_key_sentences(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.key_sentences(F.col("text")).alias("out"))


@query(rf"""with a as (select conv_id, turn, len(regexp_extract_all(right({_ZH}, 500), '{R.HAN}')) as z, len(regexp_extract_all(right({_ZH}, 500), '[a-zA-Z]')) as l from conversations)
  select conv_id, turn, case when z + l < 5 or z / greatest(1, z + l) >= 0.3 then 'zh-CN' else 'en-US' end as locale from a""")
def t17_detect_locale(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.detect_locale(F.translate("text", "aeiou", "缓存层高并")).alias("locale"))


_HOST = """case page_id % 9 when 0 then cast(page_id % 256 as varchar(9)) || '.' || cast(page_id * 7 % 256 as varchar(9)) || '.1.1' when 1 then '172.' || cast(page_id % 40 as varchar(9)) || '.0.1' when 2 then '::ffff:10.0.0.' || cast(page_id % 9 as varchar(9))
  when 3 then '[fd' || cast(page_id as varchar(9)) || '::1]' when 4 then '100.' || cast(page_id % 200 as varchar(9)) || '.0.1' when 5 then 'x' || cast(page_id as varchar(9)) || '.local' when 6 then ' LocalHost ' when 7 then '2001:db8::' || cast(page_id as varchar(9)) else regexp_extract(url, '://([^/?#]*)', 1) end"""


@query(rf"""with a as (select page_id, regexp_replace(lower(trim({_HOST})), '^\[|\]$', '', 'g') as h from pages),
  b as (select page_id, h, case when h like '::ffff:%' then substring(h, 8) else h end as v from a),
  c as (select page_id, h, v, regexp_matches(v, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') as four, try_cast(split_part(v, '.', 1) as int) as p, try_cast(split_part(v, '.', 2) as int) as q from b)
  select page_id, h in ('', 'localhost') or regexp_matches(h, '\.(localhost|local|internal)$') or case when four then p in (0, 10, 127) or p >= 224 or (p = 169 and q = 254) or (p = 192 and q = 168) or (p = 172 and q between 16 and 31) or (p = 100 and q between 64 and 127)
    else contains(h, ':') and (h in ('::', '::1') or regexp_matches(h, '^(fc|fd|fe80)')) end as blocked from c""")
def t18_blocked_host(spark, d):
    return read(spark, d, "pages").select("page_id", T.blocked_host(F.expr(_HOST)).alias("blocked"))


_FWD = "case when page_id % 4 = 0 then null when page_id % 4 = 1 then ' , ' else 'a' || cast(page_id as varchar(9)) || ', b' || cast(page_id % 7 as varchar(9)) || ' , ' end"


@query(f"with a as (select page_id, case when page_id % 5 = 0 then ' t ' end as t, {_FWD} as f from pages) select page_id, coalesce(nullif(trim(t), ''), list_filter(list_transform(string_split(coalesce(f, ''), ','), lambda x: trim(x)), lambda x: x <> '')[-1], 'unknown') as ip from a")
def t19_client_ip(spark, d):
    return read(spark, d, "pages").select("page_id", T.client_ip(F.expr("case when page_id % 5 = 0 then ' t ' end"), F.expr(_FWD)).alias("ip"))


_KEY = "case when doc_id % 3 = 0 then 'CS' || substring(upper(md5(cast(doc_id as varchar(20)))), 1, 30) when doc_id % 3 = 1 then 'CS' || substring(translate(upper(md5(cast(doc_id as varchar(20)))), '01', 'XY'), 1, 30) else lang end"


@query(f"with a as (select doc_id, {_KEY} as k from documents) select doc_id, case when length(k) = 32 then substring(k, 1, 8) || '****' || right(k, 4) else k end as masked, length(k) = 32 and regexp_matches(k, '^CS[{T.KEY_LETTERS}]+$') as valid from a")
def t20_licence_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", F.expr(_KEY).alias("k")).select("doc_id", T.mask_key(F.col("k")).alias("masked"), T.valid_key(F.col("k"), "CS").alias("valid"))


@query("select o_orderkey, case when o_orderdate <= timestamp '1996-01-01' then 'expired' when o_orderstatus = 'O' then 'active' when o_orderstatus = 'F' then 'expired' else 'none' end as claim from orders")
def t21_claim_of(spark, d):
    status = F.expr("case o_orderstatus when 'O' then 'active' when 'F' then 'expired' else 'pending' end")
    return read(spark, d, "orders").select("o_orderkey", T.claim_of(status, F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("claim"))


@query(f"with a as (select c_custkey, case when c_custkey % 9 = 0 then '  ' else ' ' || c_name || ' ' end as n from customer) select c_custkey, case when {trim('n')} <> '' then sha256(lower({trim('n')})) end as hash from a")
def t22_company_hash(spark, d):
    return read(spark, d, "customer").select("c_custkey", T.company_hash(F.expr("case when c_custkey % 9 = 0 then '  ' else ' ' || c_name || ' ' end")).alias("hash"))


_NAME = rf"""{trim(rf"substring({trim(rf"regexp_replace(regexp_replace(regexp_replace(t, '[\\/:*?" + '"' + rf"<>|#^\[\]]', ' ', 'g'), '{S}+', ' ', 'g'), '^[.{R.SPACES}]+', '')")}, 1, 80)")}"""


@query(f"with a as (select doc_id, case when doc_id % 50 = 0 then '...' when doc_id % 3 = 0 then '.A/B: ' || text else text end as t from documents) select doc_id, coalesce(nullif({_NAME}, ''), '卡片') as name from a")
def t23_safe_filename(spark, d):
    return read(spark, d, "documents").select("doc_id", T.safe_filename(F.expr("case when doc_id % 50 = 0 then '...' when doc_id % 3 = 0 then '.A/B: ' || text else text end")).alias("name"))


@query(using("materials") + r"select id, case when contains(source_ref, ' (') then regexp_extract(source_ref, '(?s)^(.*) \(', 1) else source_ref end as name from materials")
def t25_display_name(spark, d):
    return read(spark, d, "materials").select("id", T.display_name(F.col("source_ref")).alias("name"))


@query(f"select doc_id, replace(substring(text, 1, 50), chr(10), ' ') as ref from documents where length({trim('text')}) >= 10")
def t26_text_material(spark, d):
    return read(spark, d, "documents").select("doc_id", T.text_material_ref(F.col("text")).alias("ref")).where("ref is not null")


# Questions, on the sentences of turns; the data has no Chinese, so the oracles hold the English cues.
_SENT = rf"select conv_id, turn, i, s from (select conv_id, turn, unnest(range(1, len(p) + 1)) as i, unnest(p) as s from (select conv_id, turn, list_filter(list_transform(string_split(text, '. '), lambda x: {trim('x')}), lambda x: x <> '') as p from conversations))"


def _sentences(spark, d):
    parts = F.filter(F.transform(F.split("text", r"\. "), T.js_trim), lambda x: x != "")
    return read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("i", "s")).withColumn("i", (F.col("i") + 1).cast("bigint"))


def sql_interrogative(s):
    return rf"(regexp_matches({s}, '[?？]{S}*$') or regexp_matches({s}, '(?i),{S}*({R.EN_TAG}){S}*\??$') or regexp_matches({s}, '(?i){word(R.EN_WH.replace(chr(39), chr(39) * 2))}') or regexp_matches({s}, '(?i){word(rf'({R.EN_AUX})\s+({R.EN_SUBJECT})')}'))"


def sql_lead(s):
    return rf"regexp_matches({s}, '(?i)^\s*(?:{R.EN_LEAD_PREFIX})?({'|'.join(R.EN_LEAD)})($|[^A-Za-z0-9_])')"


def sql_imperative(s):
    return rf"({sql_lead(s)} or regexp_matches({s}, '(?i){word('|'.join(R.EN_IMPERATIVE).replace(chr(39), chr(39) * 2))}'))"


def sql_strong(s):
    return rf"regexp_matches({s}, '(?i)^\s*({'|'.join(R.EN_FOLLOW)})($|[^A-Za-z0-9_])')"


def sql_follow(s):
    return rf"({sql_strong(s)} and (length({s}) <= 32 or len(regexp_extract_all({s}, '[^{R.SPACES}]+')) <= 5))"


def sql_standalone(s, what):
    kind = f"case when {sql_lead('x')} then 'imperative' when {sql_interrogative('x')} then 'interrogative' when {sql_imperative('x')} then 'imperative' end"
    found = f"list_filter(list_transform(list_filter(list_transform(string_split_regex({s}, '[。！!\\n]+'), lambda x: {trim('x')}), lambda x: x <> ''), lambda x: {{'type': {kind}, 'text': array_to_string(string_split_regex(x, '{S}+')[1:40], ' ')}}), lambda y: y.type is not null)"
    return f"case when length({s}) >= 2 then ({found})[1].{what} end"


@query(f"select conv_id, turn, i, {sql_interrogative('s')} as hit from ({_SENT})")
def q1_is_interrogative(spark, d):
    return _sentences(spark, d).select("conv_id", "turn", "i", Q.is_interrogative(F.col("s")).alias("hit"))


@query(f"select conv_id, turn, i, {sql_imperative('s')} as hit, {sql_lead('s')} as leads from ({_SENT})")
def q2_is_imperative(spark, d):
    return _sentences(spark, d).select("conv_id", "turn", "i", Q.is_imperative(F.col("s")).alias("hit"), Q.leads_with_imperative(F.col("s")).alias("leads"))


_STARTS, _HOLDS = (" or ".join(f"{f}(s, '{w}')" for w in cues) for f, cues in (("starts_with", R.SELF_LEAD), ("contains", R.OTHER_SIDE)))


@query(f"select conv_id, turn, i, ({_STARTS}) and not ({_HOLDS}) and not {sql_interrogative('s')} as hit from ({_SENT})")
def q3_is_self_statement(spark, d):
    return _sentences(spark, d).select("conv_id", "turn", "i", Q.is_self_statement(F.col("s")).alias("hit"))


@query(f"select conv_id, turn, i, {sql_follow('s')} as hit from ({_SENT})")
def q4_is_follow_up(spark, d):
    return _sentences(spark, d).select("conv_id", "turn", "i", Q.is_follow_up(F.col("s")).alias("hit"))


@query(f"with a as (select conv_id, turn, {trim('text')} as s from conversations) select conv_id, turn, {sql_standalone('s', 'type')} as q_type, {sql_standalone('s', 'text')} as q_text from a")
def q5_classify_segment(spark, d):
    c = Q.classify_segment(F.col("text"))
    return read(spark, d, "conversations").select("conv_id", "turn", c["type"].alias("q_type"), c["text"].alias("q_text"))


def session_sql(source: str) -> str:
    """CTEs of Q6 over source(conv_id, seq, s); the last is g."""
    return f"""s as (select conv_id, seq, s from ({source})),
  a as (select *, {sql_standalone('s', 'type')} as p_type, {sql_standalone('s', 'text')} as p_text, length(s) >= 2 and {sql_follow('s')} as fu from s),
  b as (select *, coalesce(bool_or(p_type is not null) over (partition by conv_id order by seq rows between unbounded preceding and 1 preceding), false) as has from a),
  c as (select *, case when has and fu then 'follow_up' else p_type end as q_type from b),
  e as (select *, case when q_type = 'follow_up' then s else p_text end as own, sum(case when q_type <> 'follow_up' then 1 end) over (partition by conv_id order by seq) as run from c),
  g as (select *, string_agg(own, '，') over (partition by conv_id, run order by seq rows between unbounded preceding and 1 preceding) as prior from e)"""


_SESSION = "with " + session_sql(f"select conv_id, turn * 100000 + i as seq, s from ({_SENT})")


@query(_SESSION + " select conv_id, seq, q_type, case when q_type = 'follow_up' then substring(substring(prior, 1, 100) || '，' || s, 1, 200) else own end as q_text from g")
def q6_classify_session(spark, d):
    rows = _sentences(spark, d).select("conv_id", (F.col("turn") * 100000 + F.col("i")).alias("seq"), "s")
    return Q.classify_session(rows, "conv_id", "seq", "s").select("conv_id", "seq", "q_type", "q_text")


@query(_SESSION + " select conv_id, seq, substring(s, 1, 300) as ask from g where q_type is null and length(s) >= 8")
def q7_ambiguous_queue(spark, d):
    rows = _sentences(spark, d).select("conv_id", (F.col("turn") * 100000 + F.col("i")).alias("seq"), "s")
    return Q.ambiguous_queue(Q.classify_session(rows, "conv_id", "seq", "s"), text="s").select("conv_id", "seq", "ask")


@query("select conv_id, turn, case when role = 'user' and (conv_id % 2 = 0 or turn % 3 = 0) then 'classify' else 'display' end as route from conversations")
def q8_route_segment(spark, d):
    role = F.expr("case role when 'user' then 'speaker' when 'assistant' then 'self' end")
    return read(spark, d, "conversations").select("conv_id", "turn", Q.route_segment(role, F.expr("conv_id % 2 = 0"), F.expr("turn % 3 = 0")).alias("route"))


# Retrieval.
_TOKENS = rf"list_filter(string_split_regex(strip_accents(lower({{}})), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: x <> '')"
_POST = "postings as (" + " union all ".join(f"select card_id, '{f}' as field, token, count(*) as tf from (select card_id, unnest({_TOKENS.format(c).replace('{{', '{').replace('}}', '}')}) as token from cards) group by card_id, token" for f, c in zip(Re.FIELDS, ("title", "summary", "details", "array_to_string(tags, ' ')"))) + ")"


def _bm25(weights):
    w = " ".join(f"when '{f}' then {v}" for f, v in zip(Re.FIELDS, Re.WEIGHTS[weights]))
    return f"""{_POST}, dfs as (select token, count(distinct card_id) as df from postings group by token), lens as (select card_id, sum(tf) as len from postings group by card_id),
  tot as (select (select count(*) from cards) as n, (select sum(len) from lens) / (select count(*) from cards) as al),
  qt as (select distinct query_id, unnest(regexp_extract_all(lower(text), '([a-z0-9]{{3,}})', 1)) as token from queries),
  wf as (select card_id, token, sum(case field {w} end * tf) as f from postings group by card_id, token),
  scored as (select query_id, wf.card_id, round(sum(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))), 6) as bm25
    from wf join qt using (token) join dfs using (token) join lens on lens.card_id = wf.card_id cross join tot group by query_id, wf.card_id)"""


def _index(spark, d, shared=True):
    """The index of a data folder's cards, with their vectors, kept in the shared folder; made when these files are first searched."""
    files = [spark.read.parquet(f"{d}/{t}.parquet").select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct() for t in ("documents", "embeddings")]
    stamp = files[0].unionByName(files[1]).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    index = CardIndex(spark, f"{shared_dir(spark)}/index-{sha1(f'{d} {stamp} {shared}'.encode()).hexdigest()}")
    if index.manifest() is None:
        cards, v = read(spark, d, "cards"), read(spark, d, "embeddings")
        scopes = Re.card_scopes(cards, read(spark, d, "projects") if shared else None)
        vectors = v.select(F.col("vec_id").alias("card_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        index.commit(1, cards.join(scopes, "card_id"), embed=(lambda changed: vectors.join(changed, "card_id", "left_semi")) if shared else None)
    return index


def _q(spark, d):
    return read(spark, d, "queries").withColumn("tokens", T.tokenize_query(F.col("text")))


@query(using("cards") + f", {_POST} select * from postings")
def r1_build_postings(spark, d):
    return Re.build_postings(read(spark, d, "cards"))


@query(using("cards", "queries") + f", {_bm25('intended')} select query_id, rank, card_id, bm25 from (select *, row_number() over (partition by query_id order by bm25 desc, card_id) - 1 as rank from scored) where rank < 64")
def r2_bm25_topk(spark, d):
    return Re.top_k(_index(spark, d).search(_q(spark, d), 64, scoped=False), "bm25", "rank").select("query_id", "rank", "card_id", "bm25")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: cast(x[1] as double) * cast(x[2] as double)))"
_COS = f"{_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')})"
_NEAR = f"select a.vec_id as query_id, b.vec_id as card_id, round({_COS}, 6) as cosine from embeddings a, embeddings b where a.vec_id % 25 = 0"


@query(f"select query_id, rank, card_id, cosine from (select *, row_number() over (partition by query_id order by cosine desc, card_id) - 1 as rank from ({_NEAR})) where rank < 64")
def r3_vector_topk(spark, d):
    all_ = F.lit("*")
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("card_id"), "embedding", all_.alias("scope"))
    q = v.where("card_id % 25 = 0").select(F.col("card_id").alias("query_id"), F.col("embedding").alias("vector"), F.array(all_).alias("scopes"))
    return Re.top_k(Re.nearest(q, v), "cosine", "rank").select("query_id", "rank", "card_id", "cosine")


_ARMS = f"""{_bm25('intended')}, prof as (select id from projects where is_profile),
  see as (select s.* from scored s join queries q using (query_id) join cards c on c.card_id = s.card_id where c.project_id = q.project_id or c.project_id in (select id from prof)),
  fts as (select * from (select query_id, card_id, bm25, row_number() over (partition by query_id order by bm25 desc, card_id) - 1 as fts_rank from see) where fts_rank < 64),
  near as (select q.query_id, b.vec_id as card_id, round({_COS}, 6) as cosine from queries q join embeddings a on a.vec_id = q.query_id cross join embeddings b join cards c on c.card_id = b.vec_id where c.project_id = q.project_id or c.project_id in (select id from prof)),
  vec as (select * from (select *, row_number() over (partition by query_id order by cosine desc, card_id) - 1 as vec_rank from near) where vec_rank < 64),
  fused as (select coalesce(v.query_id, f.query_id) as query_id, coalesce(v.card_id, f.card_id) as card_id, cosine, vec_rank, fts_rank,
    round(coalesce(1 / (61.0 + vec_rank), 0) + coalesce(1 / (61.0 + fts_rank), 0), 9) as rrf from vec v full join fts f on v.query_id = f.query_id and v.card_id = f.card_id),
  best as (select *, row_number() over (partition by query_id order by rrf desc, vec_rank nulls last, fts_rank nulls last, card_id) - 1 as rank from fused)"""
_HITS = using("cards", "projects", "queries") + f""", {_ARMS}, top as (select b.*, len(list_filter(list_distinct(regexp_extract_all(lower(q.text), '([a-z0-9]{{3,}})', 1)), lambda t: contains(lower(concat_ws(' ', title, summary, details, array_to_string(tags, ' '))), t))) as matched,
  len(list_distinct(regexp_extract_all(lower(q.text), '([a-z0-9]{{3,}})', 1))) as n from best b join cards c on c.card_id = b.card_id join queries q on q.query_id = b.query_id where rank < 5),
  hits as (select query_id, rank, card_id, rrf, vec_rank, fts_rank, matched, not first_value(n > 0 and (matched >= least(2, n) or coalesce(cosine, 0) >= 0.9)) over (partition by query_id order by rank) as low_confidence from top)"""


def _hits(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return Re.meeting_search(read(spark, d, "queries").join(v, "query_id", "left"), read(spark, d, "cards"), _index(spark, d))


@query(using("cards", "projects", "queries") + f", {_ARMS} select query_id, rank, card_id, rrf from best")
def r4_rrf_fuse(spark, d):
    index, v = _index(spark, d), read(spark, d, "embeddings")
    q = _q(spark, d).withColumn("scopes", Re.query_scopes(F.col("project_id")))
    asked = q.join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")
    vec = Re.top_k(Re.nearest(asked, index.vectors()), "cosine", "vec_rank")
    return Re.rrf_fuse(vec, Re.top_k(index.search(q), "bm25", "fts_rank")).select("query_id", "rank", "card_id", "rrf")


@query("select event_id, coalesce(n > 0 and (m >= least(2, n) or coalesce(c, 0) >= 0.9), false) as passes from (select event_id, event_id % 4 as m, user_id % 6 as n, case when event_id % 3 = 0 then null else value / 100 end as c from events)")
def r5_passes_gate(spark, d):
    return read(spark, d, "events").select("event_id", Re.passes_gate(F.expr("event_id % 4"), F.expr("user_id % 6"), F.expr("case when event_id % 3 = 0 then null else value / 100 end")).alias("passes"))


@query(_HITS + " select query_id, rank, card_id, rrf, coalesce(vec_rank, -1) as vec_rank, coalesce(fts_rank, -1) as fts_rank, matched, low_confidence from hits")
def r6_meeting_search(spark, d):
    return _hits(spark, d).na.fill(-1, ["vec_rank", "fts_rank"])


_BLANK = "select -1 - cast(substr(id, 4) as int) as query_id, id as project_id, ' ' as text from projects"


@query(using("cards", "queries", "projects") + f""", {_bm25('intended')}, blank as ({_BLANK})
  select query_id, rank, card_id, bm25 from (select s.*, row_number() over (partition by query_id order by bm25 desc, s.card_id) - 1 as rank from scored s join queries q using (query_id) join cards c on c.card_id = s.card_id and c.project_id = q.project_id) where rank < 10
  union all select query_id, row_number() over (partition by query_id order by created_at desc, card_id) - 1 as rank, card_id, null as bm25 from blank join cards using (project_id)""")
def r7_card_search(spark, d):
    blank = spark.sql(_BLANK.replace("from projects", "from {projects}"), projects=read(spark, d, "projects"))
    return Re.card_search(read(spark, d, "queries").unionByName(blank), read(spark, d, "cards"), _index(spark, d, shared=False))


@query(_HITS + " select query_id, string_agg(substring('卡片' || (rank + 1) || '【' || title || '】' || summary || ' ' || details, 1, 600), chr(10) order by rank) as context from hits join cards using (card_id) where rank < 3 group by query_id")
def r8_answer_context(spark, d):
    return Re.answer_context(_hits(spark, d), read(spark, d, "cards"))


@query(_HITS + """, w as (select query_id, rank, p, x from (select query_id, rank, unnest(range(len(l))) as p, unnest(l) as x from (select query_id, rank, list_concat(list_filter(tags, lambda t: length(t) >= 2), list_filter(string_split_regex(title, '[ ,，、·]+'), lambda t: length(t) >= 2)) as l from hits join cards using (card_id) where rank < 3))),
  f as (select query_id, x, min(rank * 100000 + p) as o from w group by query_id, x) select query_id, array_to_string(list(x order by o)[1:50], '|') as words from f group by query_id""")
def r9_context_words(spark, d):
    return Re.context_words(_hits(spark, d), read(spark, d, "cards")).select("query_id", F.array_join("words", "|").alias("words"))


@query(using("cards", "queries") + """, t as (select query_id, project_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]{3,})', 1)) as tokens from queries),
  s as (select query_id, card_id, list_sum(list_transform(tokens, lambda x: case when contains(lower(concat_ws(' ', title, summary, array_to_string(tags, ' '))), x) then 2 else 0 end + case when contains(lower(details), x) then 1 else 0 end)) as points from t join cards using (project_id))
  select query_id, card_id, cast(points as int) as points, rank from (select *, row_number() over (partition by query_id order by points desc, card_id) - 1 as rank from s where points > 0) where rank < 4""")
def r10_keyword_score(spark, d):
    return Re.keyword_score(read(spark, d, "queries"), read(spark, d, "cards"))


@query(_HITS + ", t as (select query_id, min(rank) as rank from (select q.query_id, h.rank from queries q join cards c on c.project_id = q.project_id left join hits h on h.query_id = q.query_id and h.card_id = c.card_id) group by query_id) select count(*) as n, round(avg(case when coalesce(rank, 1000000) < 3 then 1.0 else 0 end), 6) as hit_at_k, round(avg(coalesce(1.0 / (rank + 1), 0)), 6) as mrr from t")
def r11_retrieval_eval(spark, d):
    cards, q = read(spark, d, "cards").select("card_id", "project_id"), read(spark, d, "queries").select("query_id", F.col("project_id").alias("own"))
    hits = _hits(spark, d).join(cards, "card_id").join(q, "query_id").select("query_id", "rank", (F.col("project_id") == F.col("own")).alias("right"))
    return Re.retrieval_eval(q.join(cards, F.col("project_id") == F.col("own"), "left_semi"), hits)


@query(using("cards", "projects") + "select p.id as project_id, card_id from projects p join cards c on c.project_id = p.id or c.project_id in (select id from projects where is_profile)")
def j1_search_scope(spark, d):
    return Re.search_scope(read(spark, d, "cards"), read(spark, d, "projects"))


@query(_HITS + " select query_id, rank, h.card_id, title from hits h join cards c on c.card_id = h.card_id")
def j9_hydrate_hits(spark, d):
    return Re.hydrate_hits(_hits(spark, d), read(spark, d, "cards")).select("query_id", "rank", "card_id", "title")
