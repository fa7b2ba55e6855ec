"""Reading the corpus tables, and small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of `documents`.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keyed_or_broadcast(small: DataFrame, rows: int, limit: int, row_bytes: int = 16, limit_bytes: int = 64 << 20) -> DataFrame:
    """`small` with a broadcast hint while its counted rows are within `limit` and,
    at `row_bytes` each, within `limit_bytes`; beyond it Spark joins by shuffling."""
    return F.broadcast(small) if rows <= limit and rows * row_bytes <= limit_bytes else small


def bounded_batches(docs: DataFrame, most: str = "8m") -> DataFrame:
    """`docs`, with the session's Arrow batches held to `most` bytes (a smaller
    setting stays), so that a worker's memory does not follow the length of texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = docs.sparkSession.conf
    if conf.get(key, "64m") in ("67108864b", "64m", "67108864"):
        conf.set(key, most)
    return docs
