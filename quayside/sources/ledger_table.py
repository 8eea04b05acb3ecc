"""The stored event ledger: an append-only Parquet table with an index that every commit keeps up.

Rows are laid out by a shard, a hash of their key, and by kind. Small scopes share shards, so many of them do not become
as many folders. One write holds all three kinds of a commit, so they become visible together:

* ``event``: the events, by scope, sorted by scope and sequence inside each file, so that a read of one scope opens one
  shard and skips row groups by their statistics.
* ``position``: each scope's newest sequence number after the commit. The newest of several is the largest, so commits
  of different scopes never get in each other's way, and ``compact`` may replace many by one at any time.
* ``intent``: the outbox events once more, dealt by the intent they belong to.

A commit opens positions of the shards it touches and no event. One writer per scope is assumed;
``operators.ledger.integrity`` finds violations.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quayside.contracts import EVENT_SCHEMA
from quayside.operators.ledger import assign_sequence, suffix
from quayside.session import discard_files

STRETCH = 1 << 20  # sequence numbers of a shard that one task writes
STORED_SCHEMA = StructType([*EVENT_SCHEMA.fields, StructField("shard", StringType()), StructField("kind", StringType())])


def shard_of(key: Column) -> Column:
    """One of 256 shards."""
    return F.substring(F.sha2(key, 256), 1, 2)


def stored(spark: SparkSession, path: str, kind: str, shards: list[str] | None = None) -> DataFrame:
    """Rows of one kind, of all shards or of some; both filters choose folders."""
    rows = spark.read.schema(STORED_SCHEMA).parquet(path).where(F.col("kind") == kind)
    return rows if shards is None else rows.where(F.col("shard").isin(shards))


def create(spark: SparkSession, path: str) -> None:
    """An empty ledger; fails where one exists."""
    spark.createDataFrame([], EVENT_SCHEMA).write.mode("errorifexists").parquet(path)


def touched_shards(rows: DataFrame, key: str) -> list[str]:
    """The shards of the keys of ``rows``: 256 at most."""
    return [row["shard"] for row in rows.select(shard_of(F.col(key)).alias("shard")).distinct().collect()]


def positions(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """Each scope's newest sequence number, from the index alone."""
    return stored(spark, path, "position", shards).groupBy("scope").agg(F.max("sequence").alias("sequence"))


def intents(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """The outbox events, by the shards of their intents."""
    return stored(spark, path, "intent", shards).drop("shard", "kind")


def append(spark: SparkSession, path: str, batch: DataFrame, order: str) -> None:
    """Number ``batch`` behind the committed events of its scopes and append it as one commit.

    What is committed is known from the positions of the touched shards. Each shard's rows are written by few tasks,
    split by stretches of the sequence, so that a commit adds few files and a large scope is still written in parallel.
    """
    committed = positions(spark, path, touched_shards(batch, "scope"))
    numbered = assign_sequence(committed, batch, F.col(order)).select(*EVENT_SCHEMA.names)
    by_scope = shard_of(F.col("scope")).alias("shard")
    newest = numbered.groupBy("scope").agg(F.max("sequence").alias("sequence"))
    rows = (
        numbered.select("*", by_scope, F.lit("event").alias("kind"))
        .unionByName(newest.select("*", by_scope, F.lit("position").alias("kind")), allowMissingColumns=True)
        .unionByName(
            numbered.where(F.col("entity_type") == "outbox").select(
                "*", shard_of(F.col("entity_id")).alias("shard"), F.lit("intent").alias("kind")
            )
        )
    )
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    (
        rows.repartition("shard", "kind", F.floor(F.col("sequence") / STRETCH))
        .sortWithinPartitions("shard", "kind", "scope", "sequence")
        .write.partitionBy("shard", "kind")
        .mode("append")
        .parquet(path)
    )


def compact(spark: SparkSession, path: str) -> int:
    """Replaces the position files by one per shard and returns how many there were. Until the old ones are gone the
    new ones only repeat them, so a reader or writer at any moment sees the same positions."""
    rows = stored(spark, path, "position").select("_metadata.file_path").distinct().collect()
    old = [row["file_path"] for row in rows if "/kind=position/" in row["file_path"]]
    newest = positions(spark, path).select("*", shard_of(F.col("scope")).alias("shard"), F.lit("position").alias("kind"))
    full = spark.createDataFrame([], STORED_SCHEMA).unionByName(newest, allowMissingColumns=True)
    _write(full, path)
    discard_files(spark, path, old)
    spark.catalog.refreshByPath(path)
    return len(old)


def read(spark: SparkSession, path: str, scope: str | None = None, after: int = 0) -> DataFrame:
    """Committed events, or the suffix of one scope behind ``after``. Both filters reach the scan."""
    events = stored(spark, path, "event")
    if scope is not None:
        shard = hashlib.sha256(scope.encode()).hexdigest()[:2]
        events = events.where((F.col("shard") == shard) & (F.col("scope") == scope))
    if after:
        events = events.where(F.col("sequence") > after)
    return events.drop("shard", "kind")


def read_in_order(spark: SparkSession, path: str, scope: str, after: int = 0) -> DataFrame:
    """The suffix of one scope, sorted by sequence."""
    return read(spark, path, scope, after).orderBy("sequence")


def read_behind(spark: SparkSession, path: str, marks: DataFrame) -> DataFrame:
    """Committed events behind each scope's mark (``scope``, ``sequence``); scopes without a mark come whole.

    A scope whose position is not beyond its mark has nothing new, so only the shards of the others are opened, and
    inside those the scan skips what lies at or below the smallest mark.
    """
    seen = marks.select("scope", F.col("sequence").alias("_seen"))
    grown = (
        positions(spark, path)
        .join(seen, "scope", "left")
        .select("scope", "sequence", F.coalesce("_seen", F.lit(0)).alias("_seen"))
        .where(F.col("sequence") > F.col("_seen"))
    )
    # One row per shard.
    bounds = grown.groupBy(shard_of(F.col("scope")).alias("shard")).agg(F.min("_seen").alias("least")).collect()
    events = stored(spark, path, "event", [row["shard"] for row in bounds]).where(
        F.col("sequence") > min((row["least"] for row in bounds), default=0)
    )
    return suffix(events, grown.select("scope", F.col("_seen").alias("sequence")), "inner").drop("shard", "kind")
