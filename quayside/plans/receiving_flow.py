"""The whole batch: landed files in, published tables, receiving plan and one outbox intent out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quayside.errors import DataFailure
from quayside.operators import outbox, receiving
from quayside.sources import snapshots, xml


@dataclass(frozen=True)
class BatchRules:
    """Fixed defaults of the receiving batch."""

    max_quantity: int = 1_000_000
    max_rejects: int = 2
    min_accepted: int = 3
    max_files: int = xml.MAX_FILES
    max_file_bytes: int = xml.MAX_FILE_BYTES
    max_records_per_file: int = xml.MAX_RECORDS_PER_FILE


@dataclass(frozen=True)
class Batch:
    """Where one business key reads from and writes to."""

    scope: str
    run_id: str
    shipments: str
    products: str
    outputs: str
    rejects: str
    references: str
    attempt: int = 1
    rules: BatchRules = BatchRules()


def _landed(spark: SparkSession, batch: Batch, path: str, contract: str) -> DataFrame:
    rules = batch.rules
    return xml.read_xml(
        spark,
        path,
        contract,
        max_files=rules.max_files,
        max_file_bytes=rules.max_file_bytes,
        max_records=rules.max_records_per_file,
    )


def _input_proof(spark: SparkSession, batch: Batch) -> list[Any]:
    rules = batch.rules
    return [
        xml.file_set_digest(xml.bounded_files(spark, path, rules.max_files, rules.max_file_bytes), path).first()
        for path in (batch.shipments, batch.products)
    ]


def receive(spark: SparkSession, batch: Batch) -> tuple[dict[str, dict[str, Any]], DataFrame]:
    """References of everything published, and the intent over the receiving plan.

    Each step reads only published, proven data of the step before. Inputs that change meanwhile fail the
    batch before the plan is made visible.
    """
    proofs = snapshots.Proofs(spark)

    def publish(node: str, **outputs: tuple[DataFrame, str]) -> dict[str, dict[str, Any]]:
        return snapshots.publish(
            proofs, batch.references, batch.scope, batch.run_id, node, batch.attempt, outputs
        )

    before = _input_proof(spark, batch)
    landed = {
        **publish(
            "extract_shipments",
            shipments=(_landed(spark, batch, batch.shipments, "shipment_batch"), batch.outputs),
        ),
        **publish(
            "extract_products",
            products=(_landed(spark, batch, batch.products, "product_catalog"), batch.outputs),
        ),
    }
    lines, products = proofs.read(landed["shipments"]), proofs.read(landed["products"])
    receiving.require_catalog(products)
    with receiving.shared(receiving.classify(lines, products, batch.rules.max_quantity)) as classified:
        checked = publish(
            "validate_shipments",
            accepted=(receiving.accepted(classified), batch.outputs),
            rejects=(receiving.rejected(classified), batch.rejects),
        )
    receiving.require_quality(
        checked["rejects"]["row_count"],
        checked["accepted"]["row_count"],
        batch.rules.max_rejects,
        batch.rules.min_accepted,
    )
    accepted = proofs.read(checked["accepted"])
    receiving.require_no_overflow(accepted)
    if _input_proof(spark, batch) != before:
        raise DataFailure("INPUT_CHANGED", "An input changed while the batch ran.")
    plan = publish("plan_receipts", receiving_plan=(receiving.receiving_plan(accepted), batch.outputs))
    published = {**landed, **checked, **plan}
    intent = outbox.dataset_intent(
        proofs.read(plan["receiving_plan"]), batch.scope, "request_receipts", "inventory_receipt"
    )
    return published, intent


def control_row(spark: SparkSession, **values: Any) -> DataFrame:
    """A one-row notice or completion dataset, published like any other output."""
    return spark.createDataFrame([tuple(values.values())], list(values))
