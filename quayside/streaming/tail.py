"""Follows the stored ledger: each event reaches the follower once, and only new files are read.

Structured Streaming keeps the position. What a follower has taken over is checked to continue exactly where it
stopped, so a repeated, changed or lost event stops it instead of passing unnoticed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quayside.contracts import EVENT_SCHEMA
from quayside.errors import DataFailure
from quayside.sources.ledger_table import STORED_SCHEMA


def require_continuation(positions: DataFrame, batch: DataFrame) -> None:
    """Every scope of ``batch`` must go on with the number after its newest one in ``positions``."""
    have = positions.groupBy("scope").agg(F.max("sequence").alias("_have"))
    new = batch.groupBy("scope").agg(
        F.min("sequence").alias("_first"),
        F.max("sequence").alias("_last"),
        F.count(F.lit(1)).alias("_events"),
        F.count_distinct("sequence").alias("_numbers"),
    )
    joined = new.join(have, "scope", "left")
    broken = (
        (F.col("_first") != F.coalesce(F.col("_have"), F.lit(0)) + 1)
        | (F.col("_events") != F.col("_numbers"))
        | (F.col("_last") - F.col("_first") + 1 != F.col("_numbers"))
    )
    if not joined.where(broken).isEmpty():
        raise DataFailure("AUDIT_CORRUPTION", "New events do not continue the ones seen.", "CONFIGURATION")


def seen_events(spark: SparkSession, target: str) -> DataFrame:
    """Everything a follower has taken over so far."""
    return spark.read.schema(EVENT_SCHEMA).parquet(f"{target}/events/batch=*")


def positions(spark: SparkSession, target: str, before: int) -> DataFrame:
    """Newest sequence per scope, of all that was taken over ahead of batch ``before``: one row per scope, as the batch
    ahead of it left them. The events stay unread."""
    schema = StructType([StructField("scope", StringType()), StructField("sequence", LongType())])
    if before == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{target}/positions/batch={before - 1}")


def follow(spark: SparkSession, ledger_path: str, target: str, checkpoint: str) -> StreamingQuery:
    """Take over all events that arrived since the last call.

    Each batch writes its events, and all scopes' positions anew from those of the batch before. A batch that is
    repeated after a failure replaces its own folders, so nothing is taken over twice.
    """

    def take_over(batch: DataFrame, number: int) -> None:
        have = positions(batch.sparkSession, target, number)
        require_continuation(have, batch)
        batch.write.mode("overwrite").parquet(f"{target}/events/batch={number}")
        newest = batch.select("scope", "sequence").unionByName(have).groupBy("scope").agg(F.max("sequence").alias("sequence"))
        newest.write.mode("overwrite").parquet(f"{target}/positions/batch={number}")

    stored = spark.readStream.schema(STORED_SCHEMA).parquet(ledger_path)
    events = stored.where(F.col("kind") == "event").select(*EVENT_SCHEMA.names)
    return (
        events.writeStream.foreachBatch(take_over)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
