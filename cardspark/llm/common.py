"""Small helpers shared by the operators: tables, words, materialised steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, written

#: The rows, written to the shared folder and read again.
stash = written
__all__ = ["UPPER", "WS", "WS_RE", "ascii_lower", "let", "shared_dir", "stash", "table", "words"]

#: White space of all contracts: space and tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is (pure ASCII strings take the fast built-in)."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """Runs of characters other than white space, as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS_RE), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]
