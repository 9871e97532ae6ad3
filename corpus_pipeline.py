"""A corpus pipeline of five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardspark.llm import bpe, line_dedup, mixing, quality, simhash
from cardspark.llm.common import shared_dir, table

#: Stages that draw and break ties by seeded hashes have no SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


#: What the operators read of a document; a stage carries all other columns, whatever their names, in one struct.
READ = ["doc_id", "text", "source"]


def _packed(docs: DataFrame) -> DataFrame:
    other = [c for c in docs.columns if c not in READ]
    return docs.select(*READ, (F.struct(*other) if other else F.lit(0)).alias("rest"))


def _columns(names: list[str], **new: Column) -> list[Column]:
    """The named columns of packed rows, those in `new` replaced."""
    return [new.get(c, F.col(c) if c in READ else F.col("rest")[c]).alias(c) for c in names]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and very short texts fail the fixed rules and go; texts count whole, however long. Equal texts, and so repeated
    rows, are judged alike. Without labels there is no trusted target, and the fixed rules alone decide; no documents give none.
    """
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0")
    return quality.quality_rules(_packed(docs), trusted).where("_q.kept").select(_columns(docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are common to many; n_chars counts what is left.

    All documents stay, those left empty too; a null text stays null, with n_chars 0. Of a common line the largest doc_id keeps
    its occurrences; rows that share a doc_id are one document and keep them alike. No documents give none.
    """
    text = F.col("_lines.kept_text")
    new = {"text": F.when(F.col("text").isNotNull(), text), "n_chars": F.length(text).cast("long")}
    return line_dedup.drop_common_lines(_packed(docs)).select(_columns(docs.columns, **new))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that links of a similarity (Jaccard, five-word shingles) of 0.8 connect.

    Rows that repeat a doc_id are one document: the row with the smallest hash stays. Rows without doc_id all stay. Texts
    without words are one group; texts count whole, however long. No documents give none.
    """
    groups = simhash.near_duplicates(docs, shingle=5, near=26, width=4, far=64, similarity=0.8)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*_columns(docs.columns)))
    kept = _packed(docs).join(keep, "doc_id").withColumn("n", F.row_number().over(one)).where("n = 1").select(_columns(docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it takes in part stays whole.

    Null and empty texts have no words, so none is taken of them and they go; a null source is a source, the last. Repeated rows
    each count; ties are drawn by seeded hashes. No documents give none.
    """
    size = mixing.number_of_words(F.col("text"))
    rows = mixing.mix(_packed(docs)).where("_taken > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / size).cast("int")))).select(_columns(docs.columns))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and of the text that they decode to.

    A row per row, repeated ones too; null texts count as empty, which have no tokens; texts are encoded whole, however long.
    Nothing depends on an order, so there are no ties. No documents give no rows.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.round_trip(docs, path)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mix_stage),
    ("BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
