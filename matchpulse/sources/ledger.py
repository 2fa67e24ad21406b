"""Writes that survive a repeat: a batch's files count once its number stands in the ledger, and only once.

A streaming query hands a batch to its sink again when it was lost before the query had noted it. Each try writes
its own files; one line (query, batch, attempt) in the ledger then publishes them. Readers take the rows of published
attempts only, so a batch that came twice, or a try that died half-way, changes nothing.

Below the root: ``rows/query=.../batch=.../attempt=...`` and ``ledger/query=.../batch=...``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

KEYS = ["query", "batch", "attempt"]
LEDGER = "attempt string, query string, batch bigint"


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{root}/ledger")
    except AnalysisException:  # nothing published yet
        return spark.createDataFrame([], LEDGER)


def published(spark: SparkSession, root: str, query: str, batch: int) -> bool:
    held = _ledger(spark, root).filter((F.col("query") == query) & (F.col("batch") == batch))
    return not held.isEmpty()


def publish(df: DataFrame, root: str, query: str, batch: int) -> bool:
    """Write a batch unless it is there already; whether it was written now.

    One driver runs a query, so two tries of one batch follow one another.
    """
    spark = df.sparkSession
    if published(spark, root, query, batch):
        return False
    attempt = str(uuid.uuid4())
    df.write.parquet(f"{root}/rows/query={query}/batch={batch}/attempt={attempt}")
    line = spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
    line.write.mode("overwrite").parquet(f"{root}/ledger/query={query}/batch={batch}")
    return True


def read(spark: SparkSession, root: str, schema: str, query: str | None = None) -> DataFrame:
    """The rows of all published batches with their query and batch; ``schema`` is that of the rows."""
    try:
        rows = spark.read.schema(f"{schema}, query string, batch bigint, attempt string").parquet(f"{root}/rows")
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, query string, batch bigint")
    if query is not None:
        rows = rows.filter(F.col("query") == query)
    return rows.join(_ledger(spark, root), KEYS, "left_semi").drop("attempt")


def each_message_once(rows: DataFrame, position: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """Rows without repeats of a message, for logs that hold a message twice (a producer or sink that tried again)."""
    return rows.dropDuplicates(list(position))


def each_live_message_once(rows: DataFrame, at: str, within: str, position: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """The same on a stream, for repeats that come ``within`` a time; the state forgets older positions."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(list(position))


def to_ledger(writer: DataStreamWriter, root: str, query: str) -> DataStreamWriter:
    """Let a stream writer publish its batches in a ledger."""

    def sink(df: DataFrame, batch: int) -> None:
        publish(df, root, query, batch)

    return writer.foreachBatch(sink)
