"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, stash


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of docs(doc_id, text, ...) plus `_lines`: struct(n_lines, n_dropped, kept_text).

    A line's key is the line stripped of white space, A-Z lower-cased. Keys of min_chars code points or more found in
    min_docs documents or more lose all their lines, except in the largest doc_id that holds them; the rest is joined by \\n.
    Null and empty texts are one empty line. Rows that share a doc_id are one document; a null doc_id counts as one
    document smaller than all. Equal rows get equal results; other columns pass through; no rows give no rows.
    Whole texts of any length: a line is a row, and a text's lines come together in one row again. Of equal keys in one
    document all lines count as one occurrence, and stay or go together.
    Keys are held as two 64-bit hashes. Distinct documents are counted by (key, document), so one common key spreads.
    """
    base = docs.select(F.struct(*docs.columns).alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h"))
    key = ascii_lower(F.btrim("line", F.lit(WS)))
    lines = (
        base.select("id", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars)
        .select("id", "h", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "h", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))
    )
    # written first: the join then reads two plain shuffles, and Spark can split a hot key's
    common = stash(lines.groupBy("k1", "k2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("k1", "k2", "keep"))
    drops = lines.join(common, ["k1", "k2"]).where("id <> keep").groupBy("id", "h").agg(F.collect_set("pos").alias("drop"))
    rows = base.select("row", "id", "h").join(drops, ["id", "h"], "left").select("row", "drop", F.split(F.coalesce("row.text", F.lit("")), "\n").alias("split"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.col("split")[i]), "\n"))
    found = F.struct(F.size("split").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text"))
    return rows.select("row.*", found.alias("_lines"))
