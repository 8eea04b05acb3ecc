"""Registered queries over the derived shipment lines and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import missing, strict_quantity
from quayside.operators import receiving
from quayside.plans import derived
from quayside.plans.derived import with_tables

QUERIES = {}
ORACLES = {}


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receiving.classify(
        derived.lines(spark, sf_dir), derived.catalog(spark, sf_dir), derived.MAX_QUANTITY
    )


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values per field of the landed lines."""
    frame = derived.lines(spark, sf_dir)
    return frame.agg(
        F.count(F.lit(1)).alias("lines"),
        *[F.count_if(missing(name)).alias(f"missing_{name}") for name in frame.columns],
    )


QUERIES["missing_fields"] = missing_fields
_COLUMNS = ["shipment_id", "line_id", "sku", "warehouse_id", "quantity", "unit_of_measure"]
ORACLES["missing_fields"] = with_tables(
    "SELECT count(*) AS lines, "
    + ", ".join(f"count(*) FILTER (coalesce(trim({c}), '') = '') AS missing_{c}" for c in _COLUMNS)
    + " FROM lines",
    "lines",
)


def strict_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw quantity spelling with its strict value and frequency."""
    return (
        derived.lines(spark, sf_dir)
        .groupBy("quantity")
        .agg(F.count(F.lit(1)).alias("lines"))
        .withColumn("parsed_quantity", strict_quantity(F.col("quantity")))
    )


QUERIES["strict_quantity"] = strict_quantities
ORACLES["strict_quantity"] = with_tables(
    """SELECT quantity, count(*) AS lines,
              CASE WHEN regexp_full_match(quantity, '[0-9]{1,18}') THEN try_cast(quantity AS BIGINT) END
                  AS parsed_quantity
       FROM lines GROUP BY quantity""",
    "lines",
)

QUERIES["dedup_lines"] = lambda spark, sf_dir: receiving.dedup_lines(derived.lines(spark, sf_dir))
ORACLES["dedup_lines"] = with_tables("SELECT DISTINCT * FROM lines", "lines")

QUERIES["key_versions"] = lambda spark, sf_dir: receiving.key_versions(derived.lines(spark, sf_dir))
ORACLES["key_versions"] = with_tables("SELECT * FROM versions", "versions")

QUERIES["classify_lines"] = classified
ORACLES["classify_lines"] = with_tables("SELECT * FROM classified", "classified")

QUERIES["accepted_lines"] = lambda spark, sf_dir: receiving.accepted(classified(spark, sf_dir))
ORACLES["accepted_lines"] = with_tables("SELECT * FROM accepted", "accepted")

QUERIES["rejected_lines"] = lambda spark, sf_dir: receiving.rejected(classified(spark, sf_dir))
ORACLES["rejected_lines"] = with_tables(
    "SELECT * EXCLUDE (parsed_quantity) FROM classified WHERE reason IS NOT NULL", "classified"
)

QUERIES["reject_counts"] = lambda spark, sf_dir: receiving.reject_counts(classified(spark, sf_dir))
ORACLES["reject_counts"] = with_tables(
    "SELECT reason, count(*) AS rejects FROM classified WHERE reason IS NOT NULL GROUP BY reason",
    "classified",
)

QUERIES["catalog_check"] = lambda spark, sf_dir: receiving.catalog_check(derived.catalog(spark, sf_dir))
ORACLES["catalog_check"] = with_tables(
    """SELECT *, rows = skus AND incomplete = 0 AS valid FROM (
         SELECT count(*) AS rows, count(DISTINCT sku) AS skus,
                count(*) FILTER (coalesce(trim(sku), '') = '' OR coalesce(trim(description), '') = ''
                                 OR coalesce(trim(unit_of_measure), '') = '') AS incomplete FROM catalog)""",
    "catalog",
)

QUERIES["quality_gate"] = lambda spark, sf_dir: receiving.quality_gate(
    classified(spark, sf_dir), max_rejects=2, min_accepted=3
)
ORACLES["quality_gate"] = with_tables(
    """SELECT *, (rejects > 0)::INTEGER AS warnings, rejects <= 2 AND accepted >= 3 AS passed FROM (
         SELECT count(*) FILTER (reason IS NULL) AS accepted,
                count(*) FILTER (reason IS NOT NULL) AS rejects FROM classified)""",
    "classified",
)


def receiving_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines to receiving plan."""
    return receiving.receiving_plan(receiving.accepted(classified(spark, sf_dir)))


QUERIES["receiving_plan"] = receiving_plan
ORACLES["receiving_plan"] = with_tables("SELECT * FROM plan", "plan")


def plan_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan groups that stop fitting 64 bits once every unit counts 10^17 times."""
    accepted = receiving.accepted(classified(spark, sf_dir))
    scaled = accepted.withColumn("quantity", F.col("quantity") * F.lit(10**17))
    return receiving.overflowing_groups(scaled).withColumn("total_units", F.col("total_units").cast("string"))


QUERIES["plan_overflow"] = plan_overflow
ORACLES["plan_overflow"] = with_tables(
    """SELECT warehouse_id, sku, unit_of_measure, total_units::VARCHAR AS total_units, shipment_lines FROM (
         SELECT warehouse_id, sku, unit_of_measure, sum(quantity::HUGEINT * 100000000000000000) AS total_units,
                count(*) AS shipment_lines FROM accepted GROUP BY ALL)
       WHERE total_units > 9223372036854775807""",
    "accepted",
)
