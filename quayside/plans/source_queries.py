"""Registered queries that land derived rows as files and read them back through the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.contracts import (
    ACCEPTED_SCHEMA,
    LINE_SCHEMA,
    PRODUCT_SCHEMA,
    REJECT_SCHEMA,
    XML_NAMESPACE,
)
from quayside.functions.digest import dataset_digest
from quayside.operators import receiving, restart
from quayside.plans import derived
from quayside.plans.derived import with_tables
from quayside.plans.ledger_queries import digest_sql, short_digest_sql
from quayside.plans.receiving_queries import classified
from quayside.session import scratch_path
from quayside.sources import delimited, ledger_table, snapshots, xml

QUERIES = {}
ORACLES = {}

# The batch bounds of a single delivery do not apply to a whole test set.
UNBOUNDED_FILES = 1 << 31


def _landed_xml(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "xml")
    xml.write_xml(derived.lines(spark, sf_dir), path, "shipment_batch", max_records=2000)
    return path


def xml_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written as XML documents and read back through bounds, validation and parsing."""
    return xml.read_xml(spark, _landed_xml(spark, sf_dir), "shipment_batch", max_files=UNBOUNDED_FILES)


QUERIES["xml_intake"] = xml_intake
ORACLES["xml_intake"] = with_tables("SELECT * FROM lines", "lines")


def _landed_texts(spark: SparkSession, sf_dir: str) -> str:
    """All documents as text files, one per source and language, in the order of their ids."""
    path = scratch_path(spark, "texts")
    named = [F.coalesce(name, F.lit("none")).alias(name) for name in ("source", "lang")]
    texts = derived.table(spark, sf_dir, "documents").select(*named, "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    dealt = texts.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id", "value")
    dealt.drop("doc_id").write.partitionBy("source", "lang").text(path)
    return path


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sizes of the landed files."""
    return xml.file_statistics(_listed(spark, _landed_texts(spark, sf_dir)))


def file_set_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of the landed file set, in which a file goes by its folder: Spark makes up the rest of its name."""
    path = _landed_texts(spark, sf_dir)
    return xml.file_set_digest(_listed(spark, path).withColumn("path", F.regexp_replace("path", "/[^/]*$", "")), path)


QUERIES["file_statistics"] = file_statistics
QUERIES["file_set_fingerprint"] = file_set_fingerprint
derived.SQL["landed"] = """
    SELECT 'source=' || source || '/lang=' || lang AS path, strlen(content)::BIGINT AS length, sha256(content) AS sha256
    FROM (SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
                 string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id, coalesce(text, '')) AS content
          FROM documents GROUP BY ALL)"""
ORACLES["file_statistics"] = with_tables(
    "SELECT count(*) AS files, max(length) AS largest, sum(length)::BIGINT AS total_bytes FROM landed", "landed"
)
ORACLES["file_set_fingerprint"] = with_tables(short_digest_sql(["path", "length", "sha256"], "landed"), "landed")


def _document(case: Column) -> Column:
    """One shipment document per line item, broken in a way that depends on ``case``."""
    fields = F.concat(
        *[
            part
            for element, value in (
                ("shipmentId", F.concat(F.lit("ASN-"), F.col("l_orderkey"))),
                ("lineId", F.col("l_linenumber").cast("string")),
                ("sku", F.concat(F.lit("SKU-"), F.col("l_partkey"))),
                ("warehouseId", F.concat(F.lit("WH-"), F.col("l_suppkey"))),
                ("quantity", F.col("l_quantity").cast("long").cast("string")),
            )
            for part in (F.lit(f"<{element}>"), value, F.lit(f"</{element}>"))
        ],
    )
    unit = F.when(case == 1, "").when(case == 2, "<unitOfMeasure><b/></unitOfMeasure>").otherwise(
        "<unitOfMeasure>EA</unitOfMeasure>"
    )
    record = F.concat(
        F.when(case == 3, '<ShipmentLine id="1">').otherwise("<ShipmentLine>"), fields, unit, F.lit("</ShipmentLine>")
    )
    namespace = F.when(case == 4, F.lit("urn:other")).otherwise(XML_NAMESPACE)
    version = F.when(case == 5, "2.0").otherwise("1.0")
    body = F.when(case == 6, "").when(case == 7, F.concat(F.lit("stray"), record)).otherwise(record)
    return F.concat(
        F.when(case == 8, '<!DOCTYPE ShipmentBatch [<!ENTITY e "v">]>').otherwise(""),
        F.lit('<ShipmentBatch xmlns="'),
        namespace,
        F.lit('" schemaVersion="'),
        version,
        F.lit('">'),
        F.when(case == 9, F.concat(record, record, record)).otherwise(body),
        F.when(case == 10, "").otherwise("</ShipmentBatch>"),
    )


def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of broken document is classified; nothing but its code comes out."""
    item = derived.table(spark, sf_dir, "lineitem")
    documents = item.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        _document(F.col("l_partkey") % 12).cast("binary").alias("content"),
    )
    return xml.document_status(documents, "shipment_batch", max_records=2)


QUERIES["document_status"] = document_status
_STATUS = [
    "OK",
    "XML_STRUCTURE_MISMATCH",
    "XML_STRUCTURE_MISMATCH",
    "XML_STRUCTURE_MISMATCH",
    "XML_ENVELOPE_MISMATCH",
    "XML_ENVELOPE_MISMATCH",
    "EMPTY_XML_BATCH",
    "XML_STRUCTURE_MISMATCH",
    "UNSAFE_XML",
    "XML_RECORD_LIMIT",
    "MALFORMED_XML",
    "OK",
]
ORACLES["document_status"] = f"""
    SELECT l_orderkey, l_linenumber, l_partkey, {_STATUS}[l_partkey % 12 + 1] AS status,
           CASE WHEN l_partkey % 12 IN (0, 11) THEN 1 END AS records
    FROM lineitem"""


def csv_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written as CSV and read back against their contract."""
    path = scratch_path(spark, "csv")
    delimited.write_csv(derived.lines(spark, sf_dir), path)
    return delimited.read_csv(spark, path, LINE_SCHEMA)


QUERIES["csv_intake"] = csv_intake
ORACLES["csv_intake"] = with_tables("SELECT * FROM lines", "lines")


def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over sizes and contents of the landed files."""
    return delimited.source_digest(spark, _landed_texts(spark, sf_dir))


QUERIES["file_digest"] = file_digest
ORACLES["file_digest"] = with_tables(short_digest_sql(["length", "sha256"], "landed"), "landed")


def publish_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected lines published together; the visible references with their proofs."""
    base = scratch_path(spark, "artifacts")
    proofs = snapshots.Proofs(spark)
    with receiving.shared(classified(spark, sf_dir)) as held:
        snapshots.publish(
            proofs,
            f"{base}/references",
            "2024-01-02",
            "R1",
            "validate_shipments",
            1,
            {
                "accepted": (receiving.accepted(held), f"{base}/outputs"),
                "rejects": (receiving.rejected(held), f"{base}/rejects"),
            },
        )
    return snapshots.committed(spark, f"{base}/references").select(
        "scope", "run_id", "node_id", "attempt", "name", "version", "digest", "row_count", "schema"
    )


QUERIES["publish_outputs"] = publish_outputs


def _published_sql(name: str, source: str, schema: str, columns: list[str]) -> str:
    return (
        f"SELECT '2024-01-02' AS scope, 'R1' AS run_id, 'validate_shipments' AS node_id, 1::BIGINT AS attempt, "
        f"'{name}' AS name, 0::BIGINT AS version, sha256(row_count || '|' || '{schema}' || '|' || sum_0 || '|' "
        f"|| sum_1 || '|' || sum_2 || '|' || sum_3) AS digest, row_count, '{schema}' AS schema "
        f"FROM ({digest_sql(columns, source)})"
    )


ORACLES["publish_outputs"] = with_tables(
    _published_sql("accepted", "accepted", ACCEPTED_SCHEMA.simpleString(), ACCEPTED_SCHEMA.names)
    + " UNION ALL "
    + _published_sql(
        "rejects",
        "(SELECT * FROM classified WHERE reason IS NOT NULL)",
        REJECT_SCHEMA.simpleString(),
        REJECT_SCHEMA.names,
    ),
    "accepted",
)


def pinned_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of a catalog stays readable after a second, smaller one was written."""
    path = scratch_path(spark, "catalog")
    products = derived.catalog(spark, sf_dir)
    snapshots.write_version(products, path, 0)
    snapshots.write_version(products.where(F.length("sku") % 2 == 0), path, 1)
    return snapshots.read_version(spark, path, 0, PRODUCT_SCHEMA)


QUERIES["pinned_snapshot"] = pinned_snapshot
ORACLES["pinned_snapshot"] = with_tables("SELECT * FROM catalog", "catalog")


def validated_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read back through their validated reference."""
    path = scratch_path(spark, "lines")
    reference = snapshots.write_version(derived.lines(spark, sf_dir), path)
    return snapshots.Proofs(spark).read(reference)


QUERIES["validated_read"] = validated_read
ORACLES["validated_read"] = with_tables("SELECT * FROM lines", "lines")


def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger stored in two batches, numbered by the store, and read back whole."""
    path = scratch_path(spark, "ledger")
    ledger_table.create(spark, path)
    raw = derived.unsequenced_events(spark, sf_dir)
    middle = raw.agg(F.floor(F.max("event_id") / 2).alias("event_id")).first()["event_id"]
    ledger_table.append(spark, path, raw.where(F.col("event_id") <= middle), "event_id")
    ledger_table.append(spark, path, raw.where(F.col("event_id") > middle), "event_id")
    return ledger_table.read(spark, path)


QUERIES["ledger_append"] = ledger_append
ORACLES["ledger_append"] = with_tables(
    "SELECT scope, sequence, entity_type, entity_id, run_id, node_id, event_type, timestamp, payload FROM ledger",
    "ledger",
)


def input_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shipments' lines changed between two looks at the input. In the second look every line of unit
    CASE for SKU-7 and multiples of 7 has a new quantity and the ones of warehouse 3 are gone."""
    lines = derived.lines(spark, sf_dir)
    later = lines.where(F.col("warehouse_id") != "WH-3").withColumn(
        "quantity", F.when(F.col("unit_of_measure") == "CASE", "0").otherwise(F.col("quantity"))
    )
    return restart.changed_inputs(
        dataset_digest(lines, "shipment_id"), dataset_digest(later, "shipment_id"), ["shipment_id"]
    )


QUERIES["input_drift"] = input_drift
ORACLES["input_drift"] = with_tables(
    """SELECT shipment_id, CASE WHEN every THEN 'removed' ELSE 'changed' END AS change FROM (
         SELECT shipment_id, bool_and(warehouse_id = 'WH-3') AS every,
                bool_or(warehouse_id = 'WH-3' OR unit_of_measure = 'CASE') AS touched
         FROM lines GROUP BY shipment_id) WHERE touched""",
    "lines",
)
