"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import shared_dir, shared_table

__all__ = ["shared_dir", "shared_table"]

#: White space of every word contract: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of an Arrow batch, about; one value for all operators, so it doesn't matter who sets it last.
BATCH_BYTES = 1 << 19


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes: a batch of very long texts still fits a worker.

    A session that has a bound of its own keeps it; Spark's is 64 MB.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their columns renamed out of an operator's way, and the new name of each."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def restored(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns under their own names again."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def held_out(doc_id: Column, divisor: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == value, F.lit(False))


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A broadcast hint where a count shows at most ``max_rows`` rows; else left to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
