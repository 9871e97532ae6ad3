"""Registered queries of files and replies: the given tables are written out, then read by the operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import cards as C
from ..sources import io as S
from ..sources.shared import shared_dir
from .tables import read, using

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


_PATH = """case when doc_id % 5 = 0 then '.trash/' when doc_id % 13 = 0 then '1/2/3/4/5/6/7/8/9/' else source || '/' end || 'note' || doc_id || case when doc_id % 7 = 0 then '.MD' when doc_id % 11 = 0 then '.txt' else '.md' end"""


@query(f"select rel_path, n as size, cast(greatest(1, round(n / 1024.0)) as int) as size_kb, text as raw from (select {_PATH} as rel_path, strlen(text) as n, doc_id, text from documents) where n between 1 and 1048576 and doc_id % 5 <> 0 and doc_id % 13 <> 0 and (doc_id % 7 = 0 or doc_id % 11 <> 0)")
def io2_scan_notes(spark, d):
    """Each document as a file: notes, and files that are none, lie too deep or in the bin."""
    folder = _folder(spark)
    S.write_files(read(spark, d, "documents").select(F.expr(_PATH).alias("rel_path"), F.col("text").alias("content")), folder)
    return S.scan_notes(spark, folder, most=None).select("rel_path", "size", "size_kb", "raw")


@query("select cast(conv_id as varchar) as session_id, turn as seq, 'final' as type, text, case when turn % 2 = 0 then role else 'self' end as role from conversations where turn % 5 <> 4")
def io6_speech_events(spark, d):
    """Turns as lines of JSON; those without a type are dropped, those without a role are one's own."""
    rows = read(spark, d, "conversations")
    event = F.struct(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 != 4, "final").alias("type"), "text", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("role")
    )
    path = _folder(spark)
    rows.select(F.to_json(event).alias("value")).write.text(path)
    return S.speech_events(spark, path).select("session_id", "seq", "type", "text", "role")


@query("select source as project, lang || '.md' as filename, cast(sum(length(replace(replace(coalesce(text, ''), chr(10), ''), chr(13), ''))) as bigint) as chars from documents group by source, lang")
def io7_write_notes(spark, d):
    """Documents written as notes, by project and language, and read again."""
    path = _folder(spark)
    notes = read(spark, d, "documents").select(F.col("source").alias("project"), F.concat("lang", F.lit(".md")).alias("filename"), F.coalesce("text", F.lit("")).alias("content"))
    S.write_notes(notes.repartition("project", "filename"), path)
    return spark.read.text(path).groupBy("project", "filename").agg(F.sum(F.length("value")).alias("chars"))


@query(using("cards") + """select card_id, cast(2 as bigint) as n_objects, title, '{"half": "' as rest from cards""")
def t13_scan_objects(spark, d):
    """Two whole objects and an unfinished one in each reply, with other text between."""
    first, second = F.to_json(F.struct("title")), F.to_json(F.struct("summary"))
    replies = read(spark, d, "cards").select("card_id", F.concat(F.lit("text } "), first, F.lit(" and "), second, F.lit('{"half": "')).alias("reply"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [C.scan_objects(r) for r in part["reply"]]
            yield pd.DataFrame({"card_id": part["card_id"], "n_objects": [len(o) for o, _ in found], "title": [o[0].get("title") if o else None for o, _ in found], "rest": [r for _, r in found]})

    return replies.mapInPandas(run, "card_id bigint, n_objects bigint, title string, rest string")
