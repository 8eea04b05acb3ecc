"""Side-effect intents committed to the stored event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import ledger, outbox
from quayside.session import materialize, scratch_path
from quayside.sources import ledger_table

_PAYLOAD = "scope STRING, node_id STRING, operation STRING, payload_digest STRING, output_reference STRING, status STRING"
_EVENTS = {"insert": "OUTBOX_COMMITTED", "refresh": "OUTBOX_REFERENCE_REFRESHED"}


def stored_intents(events: DataFrame) -> DataFrame:
    """The newest record of every committed intent: effect_id, payload_digest, output_reference, status."""
    newest = ledger.latest(events.where(F.col("entity_type") == "outbox"))
    return newest.select(F.col("entity_id").alias("effect_id"), F.from_json("payload", _PAYLOAD).alias("p")).select(
        "effect_id", "p.payload_digest", "p.output_reference", "p.status"
    )


def _records(events: DataFrame) -> DataFrame:
    """Every stored record of the committed intents, with its sequence number and its identity as bytes."""
    read = events.where(F.col("entity_type") == "outbox").select(
        F.unhex("entity_id").alias("effect_id"), "sequence", F.from_json("payload", _PAYLOAD).alias("p")
    )
    # What is no hash is the identity of no intent.
    return read.where(F.col("effect_id").isNotNull()).select(
        "effect_id", "sequence", "p.payload_digest", "p.output_reference", "p.status"
    )


def commit(spark: SparkSession, path: str, intents: DataFrame, order: str) -> dict[str, int]:
    """Decides what each intent does against what is stored, and appends it as one commit: new identities, and pending
    ones that point to another output. A replay appends nothing; a conflict fails the batch before anything is written.

    What is stored is read from the ledger's index of intents, and only from the shards of the batch's own intents.

    ``intents``: scope, node_id, operation, payload_digest, output_reference and the LONG column ``order``. Returns how
    many events of each kind were appended.
    """
    named = outbox.with_effect_id(intents).where("valid_operation").drop("valid_operation")
    shards = ledger_table.touched_shards(named, "effect_id")
    stored = _records(ledger_table.intents(spark, path, shards))
    carried = ["scope", "node_id", "operation"]
    # Identities are hashes, which take half the room as bytes.
    as_bytes = named.withColumn("effect_id", F.unhex("effect_id"))
    decided, counts = materialize(
        outbox.actions(stored, as_bytes, F.col(order), carried).where(F.col("action") != "noop"),
        scratch_path(spark, "outbox-decided"),
        **{action: F.count_if(F.col("action") == action) for action in (*_EVENTS, "conflict")},
    )
    if counts["conflict"]:
        outbox.require_no_conflict(decided)
    if not counts["insert"] and not counts["refresh"]:
        return counts
    kind = F.when(F.col("action") == "insert", _EVENTS["insert"]).otherwise(_EVENTS["refresh"])
    payload = F.to_json(
        F.struct("scope", "node_id", "operation", "payload_digest", "output_reference", F.lit(outbox.PENDING).alias("status"))
    )
    batch = decided.where(F.col("action").isin(*_EVENTS)).select(
        "scope",
        F.lit("outbox").alias("entity_type"),
        F.lower(F.hex("effect_id")).alias("entity_id"),
        F.lit(None).cast("string").alias("run_id"),
        "node_id",
        kind.alias("event_type"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        payload.alias("payload"),
        F.col("arrival").alias("_arrival"),
    )
    ledger_table.append(spark, path, batch, "_arrival")
    return counts
