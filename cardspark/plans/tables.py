"""The operators' input tables, made from the given ones by SQL that Spark and the oracle engine share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TYPES = ("result_impact", "data_metric", "difficulty_solution", "decision_tradeoff", "tech_principle", "process_method", "domain_fact")
_TYPE = "case doc_id % 7 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES)) + " end"
_MATERIAL = "case doc_id % 7 when 0 then 'text' when 1 then 'file' when 2 then 'github' when 3 then 'company_url' when 4 then 'obsidian' when 5 then 'zip' else 'meeting' end"

#: {array}, {ms} .. {end}: spelled differently by the two engines.
SQL = {
    "cards": f"""select d.doc_id as card_id, source as project_id, {_TYPE} as type, split_part(text, chr(10), 1) as title, substring(text, 1, 200) as summary,
      substring(text, 1, 2000) as details, {{array}}(lang, source) as tags, lang as language, cast(d.doc_id % 101 as double) / 100 as confidence,
      coalesce(l.quality, 0) = 1 and d.doc_id % 3 = 0 as is_important, coalesce(l.toxic, 0) = 1 as user_verified, d.doc_id as source_material_id, d.doc_id * 7919 % 100003 as created_at,
      case when d.doc_id % 4 = 0 then null else d.doc_id * 31 % 1009 end as due_at
      from documents d left join labels l on d.doc_id = l.doc_id""".replace("doc_id %", "d.doc_id %").replace("d.d.", "d."),
    "materials": f"""select doc_id as id, source as project_id, {_MATERIAL} as type, case when doc_id % 3 = 0 then 'company' else 'project' end as category,
      case when doc_id % 3 = 0 then 'Company ' || lang || ' (x) (https://' || source || ')' else source || '/dir' || cast(doc_id % 4 as varchar(9)) || '/note' || cast(doc_id as varchar(20)) || '.md' end as source_ref,
      text as raw_content, case when doc_id % 5 = 0 then null else doc_id % 977 end as source_mtime, doc_id * 104729 % 1000003 as uploaded_at from documents""",
    "projects": """select source as id, source in ('src0', 'src7') as is_profile, 'Project ' || source as name, 'Role of ' || source || chr(10) || 'more' as target_role,
      'jd ' || source as jd_text, max(doc_id) as updated_at, case when source = 'src3' then 'src0' end as parent_project_id from documents group by source""",
    "segments": "select conv_id as session_id, turn as seq, case role when 'user' then 'speaker' when 'assistant' then 'self' else role end as role, text from conversations where role <> 'system'",
    "queries": "select item_id as query_id, 'src' || cast(item_id % 20 as varchar(9)) as project_id, text from benchmark",
    "notes": """select id, project_id, source_ref, case when source_ref like '%/%' then split_part(source_ref, '/', 2) else '' end as folder, {array}(type, category, type) as tags,
      case id % 3 when 0 then 'new' when 1 then 'changed' else 'unchanged' end as status, (coalesce(source_mtime, 5) + id % 3 - 1) * 1000 + 500 as mtime_ms from materials""",
    "licences": """select o_orderkey as id, o_custkey as user_id, case o_orderstatus when 'O' then 'active' when 'F' then 'expired' else 'pending' end as status,
      case when o_orderkey % 3 = 0 then null else o_orderdate end as activated_at, o_orderdate as created_at, o_orderdate + interval 365 day as expires_at from orders""",
    "devices": "select o_custkey as user_id, o_orderkey % 5 as device_id, max({ms}cast(o_orderdate as timestamp){end}) as last_seen_ms from orders group by o_custkey, o_orderkey % 5",
    "surveys": """select event_id as id, case when event_id % 6 = 0 then null else user_id % 40 end as user_id, 'p' || cast(user_id % 3 as varchar(9)) as project_id, cast(cast(ts as date) as varchar(10)) as meeting_date,
      event_id as submitted_at, case event_id % 4 when 0 then 'good' when 1 then 'bad' else 'open' end as outcome, case event_id % 3 when 0 then 'yes' else 'no' end as card_helpful, case event_id % 5 when 0 then 'no' else 'yes' end as will_use_next from events""",
    "calls": """select event_id as id, user_id, case user_id % 3 when 0 then 'anthropic' when 1 then 'openai' else 'deepseek' end as vendor, event_type as model, cast(ts as date) as day, event_id % 5 <> 0 as ok,
      cast(floor(value) as bigint) as tokens, {ms}ts{end} as ms from events""",
    "hits": "select event_id as id, user_id as k, {ms}ts{end} as ms, event_type, value from events",
}


def epoch_ms(ts: str) -> str:
    """A time in whole ms, the nearest, half away from zero, as the oracle engine's function of that name; unix_millis would cut microseconds off."""
    return f"((unix_micros({ts}) + if(unix_micros({ts}) < 0, -500, 500)) div 1000)"


def spark_sql(name: str) -> str:
    return re.sub(r"\{ms\}(.*?)\{end\}", lambda m: epoch_ms(m[1]), SQL[name]).format(array="array")


def duck_sql(name: str) -> str:
    return SQL[name].format(array="list_value", ms="epoch_ms(", end=")")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """IO1: a given table, or one of the tables above."""
    if name not in SQL:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return df.withColumn("ts", df["ts"].cast("timestamp")) if name == "events" else df
    sources = [t for t in ("documents", "labels", "conversations", "benchmark", "events", "materials", "orders") if f"from {t}" in SQL[name] or f"join {t}" in SQL[name]]
    sql, tables = spark_sql(name), {t: read(spark, sf_dir, t) for t in sources}
    if name == "cards":  # texts are cut below the join with labels, which may shuffle them
        cuts = dict(re.findall(r"(\w+\(text, [^)]*(?:\(\d+\)[^)]*)?\)) as (\w+)", sql))
        tables["documents"] = tables["documents"].selectExpr("doc_id", "source", "lang", *[f"{cut} as {c}" for cut, c in cuts.items()])
        for cut, c in cuts.items():
            sql = sql.replace(f"{cut} as {c}", c)
    for t in sources:
        sql = sql.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
    return spark.sql(sql, **tables)


def using(*names: str) -> str:
    """A WITH clause of these tables for the oracle engine."""
    names = ("materials", *[n for n in names if n != "materials"]) if "notes" in names else names
    return "with " + ", ".join(f"{n} as ({duck_sql(n)})" for n in names) + " "
