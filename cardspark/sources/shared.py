"""Steps written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session, as in tests, gets one of its own; a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_cardspark_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark._cardspark_dir = tempfile.mkdtemp(prefix="cardspark-")
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows, written as a Parquet table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
