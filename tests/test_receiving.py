from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quayside.contracts import LINE_SCHEMA, PRODUCT_SCHEMA
from quayside.errors import DataFailure
from quayside.operators import ordered, receiving

BASE = dict(
    shipment_id="ASN-TEST",
    line_id="1",
    sku="SKU-FILTER",
    warehouse_id="WH-ATL",
    quantity="1",
    unit_of_measure="EA",
)
CASES = [
    ({"shipment_id": "A", "quantity": "001"}, None),
    ({"shipment_id": "A", "quantity": "001"}, None),
    ({"shipment_id": "A", "line_id": "2", "quantity": "4"}, None),
    ({"shipment_id": "B", "quantity": "2"}, "conflicting_shipment_key"),
    ({"shipment_id": "B", "quantity": "3"}, "conflicting_shipment_key"),
    ({"shipment_id": "C", "sku": "SKU-UNKNOWN", "quantity": "5"}, "unknown_sku"),
    ({"shipment_id": "D", "quantity": None}, "invalid_quantity"),
    ({"shipment_id": "E", "quantity": "-1"}, "invalid_quantity"),
    ({"shipment_id": None, "quantity": "5"}, "missing_shipment_key"),
    ({"shipment_id": None, "quantity": "6"}, "missing_shipment_key"),
    ({"shipment_id": "", "quantity": "5"}, "missing_shipment_key"),
    ({"shipment_id": "F", "sku": None, "quantity": "5"}, "unknown_sku"),
    ({"shipment_id": "G", "quantity": "9" * 24}, "invalid_quantity"),
    ({"shipment_id": "H", "quantity": "0"}, "invalid_quantity"),
    ({"shipment_id": "I", "quantity": " 12"}, "invalid_quantity"),
    ({"shipment_id": "J", "line_id": ""}, "missing_shipment_key"),
    ({"shipment_id": "K", "warehouse_id": " "}, "missing_warehouse"),
    ({"shipment_id": "L", "unit_of_measure": "CASE"}, "unit_mismatch"),
    ({"shipment_id": "M", "unit_of_measure": None}, "unit_mismatch"),
    ({"shipment_id": "N", "quantity": "12\n"}, "invalid_quantity"),
    ({"shipment_id": "O", "quantity": "\uff11\uff12"}, "invalid_quantity"),
    ({"shipment_id": "P", "warehouse_id": "\t"}, "missing_warehouse"),
    ({"shipment_id": "Q", "warehouse_id": "\u00a0"}, "missing_warehouse"),
    ({"shipment_id": "R", "warehouse_id": "\u200b"}, None),
    ({"shipment_id": "S", "quantity": "1001"}, "invalid_quantity"),
    ({"shipment_id": "T", "quantity": "1000"}, None),
]


def lines(spark, rows):
    return spark.createDataFrame([tuple({**BASE, **row}.values()) for row in rows], LINE_SCHEMA)


def products(spark, *rows):
    rows = rows or [("SKU-FILTER", "Replacement air filters", "EA")]
    return spark.createDataFrame(list(rows), PRODUCT_SCHEMA)


def test_edge_rows(spark):
    frame = lines(spark, [row for row, _ in CASES])
    got = receiving.classify(frame, products(spark), 1000).collect()
    want = {tuple({**BASE, **row}.values()): reason for row, reason in CASES}
    assert {tuple(row)[:6]: row.reason for row in got} == want
    assert len(got) == len(want)
    accepted = {
        (r.shipment_id, r.line_id): r.quantity
        for r in receiving.accepted(receiving.classify(frame, products(spark), 1000)).collect()
    }
    assert accepted == {("A", "1"): 1, ("A", "2"): 4, ("R", "1"): 1, ("T", "1"): 1000}


def test_versions_of_a_null_key_count_together(spark):
    frame = lines(spark, [{"shipment_id": None, "quantity": str(i)} for i in range(5)])
    assert {r.versions for r in receiving.key_versions(frame).collect()} == {5}


@pytest.mark.parametrize(
    "bad",
    [
        [("S", "d", "EA"), ("S", "e", "EA")],
        [("S", "d", None)],
        [("S", " \t", "EA")],
        [(None, "d", "EA")],
    ],
)
def test_catalog_failures(spark, bad):
    with pytest.raises(DataFailure) as failure:
        receiving.require_catalog(products(spark, *bad))
    assert failure.value.code == "INVALID_DIMENSION"


def test_empty_catalog_is_allowed(spark):
    empty = spark.createDataFrame([], PRODUCT_SCHEMA)
    receiving.require_catalog(empty)
    got = receiving.classify(lines(spark, [{}]), empty, 1000).collect()
    assert [row.reason for row in got] == ["unknown_sku"]


def test_overflow_is_found_before_any_write(spark):
    rows = [{"shipment_id": f"A{i}", "quantity": "9" * 18} for i in range(10)]
    classified = receiving.classify(lines(spark, rows), products(spark), 10**18)
    accepted = receiving.accepted(classified)
    with pytest.raises(DataFailure) as failure:
        receiving.require_no_overflow(accepted)
    assert failure.value.code == "AGGREGATE_OVERFLOW"
    assert receiving.overflowing_groups(accepted).first().total_units == 10 * (10**18 - 1)
    with pytest.raises(Exception, match="AGGREGATE_OVERFLOW"):
        receiving.receiving_plan(accepted).collect()
    nine = accepted.where(F.col("shipment_id") != "A0")
    assert receiving.receiving_plan(nine).first().expected_units == 9 * (10**18 - 1)


def test_gate_is_strict(spark):
    receiving.require_quality(2, 3, max_rejects=2, min_accepted=3)
    for rejects, accepted in ((3, 3), (2, 2)):
        with pytest.raises(DataFailure, match="thresholds"):
            receiving.require_quality(rejects, accepted, max_rejects=2, min_accepted=3)
    frame = receiving.classify(lines(spark, [row for row, _ in CASES]), products(spark), 1000)
    gate = receiving.quality_gate(frame, 2, 3).first()
    assert (gate.accepted, gate.rejects, gate.warnings, gate.passed) == (4, 21, 1, False)


def test_shared_classification_is_released_on_failure(spark):
    frame = receiving.classify(lines(spark, [{}]), products(spark), 1000)
    with pytest.raises(RuntimeError, match="injected"):
        with receiving.shared(frame) as held:
            assert held.storageLevel.useMemory
            raise RuntimeError("injected")
    assert not frame.storageLevel.useMemory


def test_versions_need_no_window(spark):
    """Plan shape: rows are counted by hash aggregates, and one join brings the counts back."""
    plan = receiving.key_versions(lines(spark, [{}]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
    assert plan.count("Join") == 1


def test_conflicting_keys_meet_only_salts_that_occur(spark):
    """One key with most of the rows, several with two versions, and many plain ones."""
    rows = [(f"S{i}", "1", str(i)) for i in range(500)] + [("HOT", "1", str(i)) for i in range(700)]
    rows += [("S1", "1", "x"), ("S2", "1", "x"), (None, None, "1"), (None, None, "2")]
    lines = spark.createDataFrame(
        [(s, n, "SKU", "WH", q, "EA") for s, n, q in rows for _ in range(2)], LINE_SCHEMA
    ).repartition(5)
    found = receiving.key_versions(lines).groupBy("shipment_id", "versions").count().collect()
    versions = {r.shipment_id: (r.versions, r["count"]) for r in found}
    assert versions["HOT"] == (700, 700) and versions["S1"] == (2, 2) and versions[None] == (2, 2)
    assert sum(1 for v in versions.values() if v == (1, 1)) == 498
    salted = receiving.dedup_lines(lines).withColumn("_salt", F.pmod(F.xxhash64("quantity"), F.lit(receiving.SALTS)).cast("int"))
    joined = receiving.conflicting_keys(salted)
    assert joined.count() <= receiving.SALTS + 6 and joined.where("shipment_id = 'HOT'").count() <= receiving.SALTS


def test_versions_take_one_shuffle_but_for_large_keys(spark, monkeypatch):
    """Keys of more rows than one task sorts, by copies, versions or NULL keys, are counted by salts."""
    rows = [("A", "1", "s", "w", str(i % 40), "EA") for i in range(120)]
    rows += [("B", "1", "s", "w", "1", "EA")] * 90 + [(None, "1", "s", "w", str(i), None) for i in range(70)]
    rows += [(f"C{i}", "1", "s", "w", str(q), "EA") for i in range(60) for q in range(1 + i % 2)]
    frame = spark.createDataFrame(rows, LINE_SCHEMA)
    versions = {}
    for row in set(rows):
        versions[row[:2]] = versions.get(row[:2], 0) + 1
    expected = sorted((*map(str, row), versions[row[:2]]) for row in set(rows))

    def counted():
        got = receiving.key_versions(frame)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = sorted((*map(str, row[:6]), row.versions) for row in got.collect())
        return found, len(set(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)))

    assert counted() == (expected, 1)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 50)
    assert ordered.crowded(frame, ["shipment_id", "line_id"]) is not None
    got, shuffles = counted()
    assert got == expected and shuffles > 1
