"""Row quality of landed shipment lines and the receiving plan built from the accepted ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.contracts import LINE_COLUMNS, LINE_KEY, MAX_LONG, PLAN_GROUPS, PRODUCT_COLUMNS
from quayside.errors import DataFailure
from quayside.functions.text import long_or_null, missing, strict_quantity
from quayside.operators import ordered

SALTS = 64  # copies of a conflicting key's count that its rows are spread over


def dedup_lines(lines: DataFrame) -> DataFrame:
    """Exact retransmissions collapse to one row. Copies meet in the map-side half of the aggregate, and the
    shuffle hashes every column, so many copies or versions of one key do not meet in one task."""
    return lines.select(*LINE_COLUMNS).dropDuplicates()


def key_versions(lines: DataFrame) -> DataFrame:
    """Distinct rows with ``versions``, the number of distinct rows that share their line key (NULL = NULL).

    Rows are shuffled once, by key; those of keys too large for one task, be it by copies or versions, are told apart
    and counted by salts.
    """
    large = ordered.crowded(lines, LINE_KEY)
    if large is None:
        return _counted_by_key(lines)
    return _counted_by_key(lines.where(~large)).unionByName(_counted_by_salt(lines.where(large)))


def _counted_by_key(lines: DataFrame) -> DataFrame:
    """Dealt by their key, copies collapse, versions are counted and counts are looked up where the rows are. The key is
    a struct, so that NULL parts meet by plain equality and both sides of the join keep the one deal."""
    rest = [name for name in LINE_COLUMNS if name not in LINE_KEY]
    keyed = lines.select(F.struct(*LINE_KEY).alias("_key"), *rest).repartition("_key").dropDuplicates()
    several = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_versions")).where(F.col("_versions") > 1)
    return keyed.join(several.hint("shuffle_hash"), "_key", "left").select(
        *[F.col(f"_key.{name}" if name in LINE_KEY else name).alias(name) for name in LINE_COLUMNS],
        F.coalesce("_versions", F.lit(1)).alias("versions"),
    )


def _counted_by_salt(lines: DataFrame) -> DataFrame:
    """The same for keys with any number of rows.

    Rows are counted per key and salt first, with map-side partial sums, then per key, which keeps the set of its salts.
    Only keys of several versions go on to the join, once for each salt that occurs: at most as often as they have rows.
    The rows of one key, however many, meet their count in as many tasks as there are salts. A row that finds no count
    is the only one of its key.
    """
    rest = [name for name in LINE_COLUMNS if name not in LINE_KEY]
    salted = dedup_lines(lines).withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(SALTS)).cast("int"))
    several = conflicting_keys(salted)
    same = F.col("l._salt") == F.col("r._salt")
    for name in LINE_KEY:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return salted.alias("l").join(several.alias("r"), same, "left").select(
        *[F.col(f"l.{name}") for name in LINE_COLUMNS], F.coalesce("_versions", F.lit(1)).alias("versions")
    )


def conflicting_keys(salted: DataFrame) -> DataFrame:
    """Line keys of several distinct rows with their number, one row per ``_salt`` among those rows."""
    per_salt = salted.groupBy(*LINE_KEY, "_salt").agg(F.count(F.lit(1)).alias("_rows"))
    # A key has SALTS salts at most, so its list is short.
    per_key = per_salt.groupBy(*LINE_KEY).agg(
        F.sum("_rows").alias("_versions"), F.collect_list("_salt").alias("_salts")
    )
    return per_key.where(F.col("_versions") > 1).select(*LINE_KEY, "_versions", F.explode("_salts").alias("_salt"))


def catalog_check(products: DataFrame) -> DataFrame:
    """One row: catalog size, distinct SKUs, incomplete rows, and whether the catalog may be used."""
    incomplete = F.lit(False)
    for name in PRODUCT_COLUMNS:
        incomplete = incomplete | missing(name)
    return products.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("sku").alias("skus"),
        F.count_if(incomplete).alias("incomplete"),
    ).withColumn("valid", (F.col("rows") == F.col("skus")) & (F.col("incomplete") == 0))


def require_catalog(products: DataFrame) -> None:
    """Refuse a catalog with repeated SKUs or empty fields."""
    if not catalog_check(products).first()["valid"]:
        raise DataFailure("INVALID_DIMENSION", "Products need unique SKUs and filled fields.")


def reject_reason(quantity: Column, maximum: int) -> Column:
    """First rule a line breaks, NULL where it breaks none. The order of the rules is part of the contract."""
    unit, catalog_unit = F.col("unit_of_measure"), F.col("_catalog_unit")
    rules = [
        ("missing_shipment_key", missing("shipment_id") | missing("line_id")),
        ("conflicting_shipment_key", F.col("versions") != 1),
        ("invalid_quantity", ~F.coalesce(quantity.between(1, maximum), F.lit(False))),
        ("unknown_sku", catalog_unit.isNull()),
        ("missing_warehouse", missing("warehouse_id")),
        ("unit_mismatch", ~unit.eqNullSafe(catalog_unit)),
    ]
    return F.coalesce(*[F.when(broken, F.lit(reason)) for reason, broken in rules])


def classify(
    lines: DataFrame, products: DataFrame, maximum: int
) -> DataFrame:
    """Distinct lines with ``parsed_quantity`` and ``reason``.

    The catalog side carries no hint: Spark broadcasts it only while its size is below the session's
    threshold, and otherwise shuffles both sides, where AQE splits a hot SKU.
    """
    units = products.select("sku", F.col("unit_of_measure").alias("_catalog_unit"))
    return (
        key_versions(lines)
        .join(units, "sku", "left")
        .withColumn("parsed_quantity", strict_quantity(F.col("quantity")))
        .withColumn("reason", reject_reason(F.col("parsed_quantity"), maximum))
        .select(*LINE_COLUMNS, "parsed_quantity", "reason")
    )


def accepted(classified: DataFrame) -> DataFrame:
    """Lines that broke no rule, quantity as LONG."""
    columns = [F.col("parsed_quantity").alias(c) if c == "quantity" else F.col(c) for c in LINE_COLUMNS]
    return classified.where(F.col("reason").isNull()).select(*columns)


def rejected(classified: DataFrame) -> DataFrame:
    """Quarantined lines: the raw strings and the reason, one row per distinct version."""
    return classified.where(F.col("reason").isNotNull()).select(*LINE_COLUMNS, "reason")


@contextmanager
def shared(classified: DataFrame) -> Iterator[DataFrame]:
    """Keep one classification for several outputs and release it whatever happens."""
    held = classified.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def reject_counts(classified: DataFrame) -> DataFrame:
    """Rejects per reason."""
    return rejected(classified).groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"))


def quality_gate(classified: DataFrame, max_rejects: int, min_accepted: int) -> DataFrame:
    """One row: counters, the warning flag and whether the batch may go on."""
    counts = classified.agg(
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejects"),
    )
    return counts.select(
        "accepted",
        "rejects",
        (F.col("rejects") > 0).cast("int").alias("warnings"),
        ((F.col("rejects") <= max_rejects) & (F.col("accepted") >= min_accepted)).alias("passed"),
    )


def require_quality(rejects: int, accepted_rows: int, max_rejects: int, min_accepted: int) -> None:
    """The same gate over row counts already recorded with the published outputs: no rescan."""
    if rejects > max_rejects or accepted_rows < min_accepted:
        raise DataFailure("QUALITY_GATE_FAILED", "The batch misses its quality thresholds.")


def plan_totals(accepted_lines: DataFrame) -> DataFrame:
    """Exact units (decimal, cannot overflow) and line count per plan group."""
    return accepted_lines.groupBy(*PLAN_GROUPS).agg(
        F.sum(F.col("quantity").cast("decimal(38,0)")).alias("total_units"),
        F.count(F.lit(1)).alias("shipment_lines"),
    )


def overflowing_groups(accepted_lines: DataFrame) -> DataFrame:
    """Plan groups whose total does not fit a signed 64-bit number."""
    return plan_totals(accepted_lines).where(F.col("total_units") > F.lit(MAX_LONG).cast("decimal(38,0)"))


def require_no_overflow(accepted_lines: DataFrame) -> None:
    """Fail before anything is written."""
    if not overflowing_groups(accepted_lines).isEmpty():
        raise DataFailure("AGGREGATE_OVERFLOW", "A receiving plan total exceeds 64 bits.")


def receiving_plan(accepted_lines: DataFrame) -> DataFrame:
    """Units and lines per warehouse, SKU and unit. A total that does not fit fails the job, so a plan that
    is written without the check above still cannot hold a wrong number."""
    units = F.coalesce(
        long_or_null(F.col("total_units"), MAX_LONG),
        F.raise_error(F.lit("AGGREGATE_OVERFLOW")).cast("long"),
    )
    return plan_totals(accepted_lines).select(*PLAN_GROUPS, units.alias("expected_units"), "shipment_lines")
