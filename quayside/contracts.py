"""Fixed schemas and value sets that every operator agrees on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import LongType, StringType, StructField, StructType


def _strings(*names: str) -> StructType:
    return StructType([StructField(name, StringType()) for name in names])


# --- fixed values: table contracts -------------------------------------------------------------
LINE_KEY = ["shipment_id", "line_id"]
LINE_COLUMNS = ["shipment_id", "line_id", "sku", "warehouse_id", "quantity", "unit_of_measure"]
PRODUCT_COLUMNS = ["sku", "description", "unit_of_measure"]
PLAN_GROUPS = ["warehouse_id", "sku", "unit_of_measure"]

LINE_SCHEMA = _strings(*LINE_COLUMNS)
PRODUCT_SCHEMA = _strings(*PRODUCT_COLUMNS)
ACCEPTED_SCHEMA = StructType(
    [StructField(f.name, LongType() if f.name == "quantity" else f.dataType) for f in LINE_SCHEMA]
)
REJECT_SCHEMA = _strings(*LINE_COLUMNS, "reason")
PLAN_SCHEMA = StructType(
    [
        *_strings(*PLAN_GROUPS).fields,
        StructField("expected_units", LongType()),
        StructField("shipment_lines", LongType()),
    ]
)
EVENT_SCHEMA = StructType(
    [
        StructField("scope", StringType()),
        StructField("sequence", LongType()),
        *_strings(
            "entity_type", "entity_id", "run_id", "node_id", "event_type", "timestamp", "payload"
        ).fields,
    ]
)
ENTITY_KEY = ["scope", "entity_type", "entity_id"]

# --- fixed values: XML contracts ---------------------------------------------------------------
XML_NAMESPACE = "urn:example:supply-chain:canonical:1"
XML_VERSION = "1.0"


@dataclass(frozen=True)
class XmlContract:
    """Root element, record element and the ordered (element, column) pairs of one document kind."""

    name: str
    root: str
    record: str
    fields: tuple[tuple[str, str], ...]

    @property
    def schema(self) -> StructType:
        return _strings(*[column for _, column in self.fields])


XML_CONTRACTS = {
    contract.name: contract
    for contract in (
        XmlContract(
            "shipment_batch",
            "ShipmentBatch",
            "ShipmentLine",
            (
                ("shipmentId", "shipment_id"),
                ("lineId", "line_id"),
                ("sku", "sku"),
                ("warehouseId", "warehouse_id"),
                ("quantity", "quantity"),
                ("unitOfMeasure", "unit_of_measure"),
            ),
        ),
        XmlContract(
            "product_catalog",
            "ProductCatalog",
            "Product",
            (("sku", "sku"), ("description", "description"), ("unitOfMeasure", "unit_of_measure")),
        ),
    )
}

# --- fixed values: states ----------------------------------------------------------------------
SUCCESS_STATES = ["SUCCEEDED", "SKIPPED_ALREADY_SATISFIED"]
BAD_STATES = ["FAILED", "TIMED_OUT", "BLOCKED", "CANCELLED"]
TERMINAL_STATES = [*SUCCESS_STATES, *BAD_STATES, "SKIPPED_CONDITION"]
OPEN_RUN_STATES = ["RUNNING", "RECOVERY_REQUIRED"]
CLOSING_RUN_STATES = ["SUCCEEDED", "FAILED", "RECOVERY_REQUIRED"]
SAFE_STRATEGIES = ["natural", "overwrite", "merge", "deduplicate", "checkpoint"]
TRIGGERS = ["all_success", "any_success", "all_done", "any_failed", "any_timed_out"]
ERROR_CATEGORIES = [
    "BUSINESS",
    "INFRASTRUCTURE",
    "TIMEOUT",
    "CONFIGURATION",
    "DATA_QUALITY",
    "DEPENDENCY",
    "RETRYABLE_APPLICATION",
    "NON_RETRYABLE_APPLICATION",
]
MAX_LONG = 9223372036854775807
