"""Exactly-once side-effect intents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.errors import DataFailure
from quayside.functions.digest import composite_id, dataset_digest, proof_fingerprint
from quayside.functions.text import OPERATION_ID, full_match
from quayside.operators import ordered

PENDING = "PENDING_DISPATCH"


def with_effect_id(intents: DataFrame) -> DataFrame:
    """Adds the identity of an intent and whether its operation name is allowed."""
    return intents.withColumns(
        {
            "effect_id": composite_id(
                scope=F.col("scope"), node=F.col("node_id"), operation=F.col("operation")
            ),
            "valid_operation": full_match(F.col("operation"), OPERATION_ID),
        }
    )


def actions(existing: DataFrame, incoming: DataFrame, order: Column, carried: Sequence[str] = ()) -> DataFrame:
    """What each incoming intent does, taken in ``order`` (a LONG from 0 up): ``insert`` for a new identity,
    ``conflict`` where the identity exists for other content, ``refresh`` where a pending intent only points
    to another output reference, and ``noop``.

    Both frames: effect_id, payload_digest, output_reference; ``existing`` also has its status, and ``sequence`` where it
    holds several records of an identity, of which the newest counts. Existing rows take part ahead of the incoming ones
    of their identity, so nothing is joined and an identity may occur any number of times. The result keeps the columns
    ``carried`` of ``incoming``.

    Rows are shuffled once, by identity; only identities that are too large for one task are cut into segments.
    """
    columns = ["effect_id", "payload_digest", "output_reference"]
    arriving = incoming.select(
        *columns, F.lit(PENDING).alias("status"), order.cast("long").alias("_at"), order.cast("long").alias("arrival"), *carried
    )
    stored = existing.select(*columns, "status", _stored_place(existing).alias("_at"))
    large = ordered.crowded(existing.select("effect_id").unionAll(incoming.select("effect_id")), ["effect_id"])
    if large is None:
        held = _held(arriving.unionByName(stored, allowMissingColumns=True))
    else:
        newest = F.max_by(F.struct(*stored.columns), "_at")
        first = stored.where(large).groupBy("effect_id").agg(newest.alias("_newest")).select("_newest.*")
        held = _held(arriving.where(~large).unionByName(stored.where(~large), allowMissingColumns=True)).unionByName(
            _held_in_segments(arriving.where(large).unionByName(first, allowMissingColumns=True))
        )
    same = F.col("payload_digest") == F.col("_held.payload_digest")
    moved = ~F.col("output_reference").eqNullSafe(F.col("_stored.output_reference"))
    action = (
        F.when(~same, "conflict")
        .when(F.col("_stored").isNull(), "insert")
        .when((F.col("_held.status") == PENDING) & moved, "refresh")
        .otherwise("noop")
    )
    return held.where(F.col("arrival").isNotNull() & same.isNotNull()).select(
        "arrival", *columns, *carried, action.alias("action")
    )


def _stored_place(existing: DataFrame) -> Column:
    """A place in the order, below 0."""
    return F.col("sequence") - F.lit(1 << 62) if "sequence" in existing.columns else F.lit(-1).cast("long")


def _held(rows: DataFrame) -> DataFrame:
    """Rows with ``_held``, the content that holds their identity, and ``_stored``, the reference that the row for the
    same content before them left."""
    by_identity = Window.partitionBy("effect_id").orderBy("_at")
    so_far = by_identity.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = by_identity.rowsBetween(Window.unboundedPreceding, -1)
    holder = F.struct("payload_digest", "status")
    newest = F.last(F.when(F.col("_at") < 0, holder), ignorenulls=True).over(so_far)
    held = rows.withColumn("_held", F.coalesce(newest, F.first(holder).over(so_far)))
    same = F.col("payload_digest") == F.col("_held.payload_digest")
    return held.withColumn("_stored", F.last(F.when(same, F.struct("output_reference")), ignorenulls=True).over(ahead))


def _held_in_segments(rows: DataFrame) -> DataFrame:
    """The same for identities of any size that have one stored row at most."""
    held = ordered.first_value(rows, ["effect_id"], F.col("_at"), F.struct("payload_digest", "status"), "_held")
    same = F.col("payload_digest") == F.col("_held.payload_digest")
    # Only intents for the same content touch the stored reference, so each looks at the one before it.
    before = ordered.previous(held.where(same), ["effect_id"], F.col("_at"), F.struct("output_reference"), "_stored")
    return before.unionByName(held.where(~same), allowMissingColumns=True)


def new_intents(decided: DataFrame) -> DataFrame:
    """Rows to append as OUTBOX_COMMITTED."""
    return decided.where(F.col("action") == "insert").drop("action").withColumn("status", F.lit(PENDING))


def refreshed(decided: DataFrame) -> DataFrame:
    """Rows to append as OUTBOX_REFERENCE_REFRESHED; the newest event of an identity holds its reference."""
    return decided.where(F.col("action") == "refresh").drop("action").withColumn("status", F.lit(PENDING))


def conflicts(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action") == "conflict").drop("action")


def require_no_conflict(decided: DataFrame) -> None:
    """A conflict fails the batch before anything is appended."""
    if not conflicts(decided).isEmpty():
        raise DataFailure("SIDE_EFFECT_CONFLICT", "An intent exists for different content.", "BUSINESS")


def receipts_valid(receipts: DataFrame, intents: DataFrame) -> DataFrame:
    """A receipt counts only while its intent exists with an equal digest."""
    stored = intents.select("scope", "effect_id", F.col("payload_digest").alias("_stored"))
    return receipts.join(stored, ["scope", "effect_id"], "left").select(
        "scope",
        "effect_id",
        "digest",
        F.coalesce(F.col("_stored") == F.col("digest"), F.lit(False)).alias("valid"),
    )


def dataset_intent(
    frame: DataFrame, scope: str, node_id: str, operation: str, enabled: bool = True
) -> DataFrame:
    """One intent over a whole dataset, identified by content; no row where intents are switched off."""
    proof = dataset_digest(frame)
    intent = proof.select(
        F.lit(scope).alias("scope"),
        F.lit(node_id).alias("node_id"),
        F.lit(operation).alias("operation"),
        proof_fingerprint(frame.schema.simpleString()).alias("payload_digest"),
        "row_count",
        F.lit(PENDING).alias("status"),
    )
    return with_effect_id(intent).where(F.lit(enabled) & F.col("valid_operation")).drop("valid_operation")
