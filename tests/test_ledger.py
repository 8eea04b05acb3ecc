from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quayside.errors import DataFailure, public_error
from quayside.operators import failures, ledger

EVENT = "scope string, sequence long, event_type string, status string, execution_uncertain boolean"


def moves(spark, *steps):
    rows = [("s", i + 1, kind, status, uncertain) for i, (kind, status, uncertain) in enumerate(steps)]
    return spark.createDataFrame(rows, EVENT).withColumns({"entity_type": F.lit("node"), "entity_id": F.lit("n")})


def flagged(frame):
    return [row.sequence for row in ledger.illegal_transitions(frame).orderBy("sequence").collect()]


def test_legal_life(spark):
    frame = moves(
        spark,
        ("NODE_CREATED", "PENDING", False),
        ("NODE_READY", "READY", False),
        ("REMOTE_RUN_SUBMITTED", "READY", False),
        ("ATTEMPT_CLAIMED", "RUNNING", False),
        ("ATTEMPT_FINISHED", "FAILED", False),
        ("RETRY_SCHEDULED", "READY", False),
        ("ATTEMPT_FINISHED", "TIMED_OUT", True),
        ("ATTEMPT_RECONCILED", "CANCELLED", False),
    )
    assert flagged(frame) == []


def test_illegal_moves(spark):
    frame = moves(
        spark,
        ("NODE_READY", "READY", False),  # no creation
        ("REMOTE_RUN_SUBMITTED", "RUNNING", False),  # may not change the status
        ("ATTEMPT_FINISHED", "SUCCEEDED", False),
        ("ATTEMPT_RECONCILED", "CANCELLED", False),  # finished and certain
        ("NODE_READY", "READY", False),  # cancelled is final
    )
    assert flagged(frame) == [1, 2, 4, 5]


def sequences(spark, **scopes):
    rows = [(scope, number) for scope, numbers in scopes.items() for number in numbers]
    return spark.createDataFrame(rows, "scope string, sequence long")


def test_integrity_and_gaps(spark):
    frame = sequences(spark, whole=[1, 2, 3], hole=[1, 4, 5, 9], twice=[1, 2, 2, 3], zero=[0, 1])
    report = {row.scope: row for row in ledger.integrity(frame).collect()}
    assert report["whole"].intact
    assert (report["hole"].missing, report["hole"].intact) == (5, False)
    assert (report["twice"].repeated, report["twice"].missing) == (1, 0)
    assert (report["zero"].invalid, report["zero"].missing) == (1, 0)
    gaps = {tuple(row) for row in ledger.sequence_gaps(frame).collect()}
    assert gaps == {("hole", 2, 3), ("hole", 6, 8)}
    with pytest.raises(DataFailure) as failure:
        ledger.require_intact(frame)
    assert failure.value.code == "AUDIT_CORRUPTION"


@pytest.mark.parametrize("spread", [3, 1 << 20])
def test_suffix_and_prefix_split_at_the_watermark(spark, monkeypatch, spread):
    monkeypatch.setattr(ledger, "SPREAD", spread)
    frame = sequences(spark, a=range(1, 20), b=range(1, 8), new=range(1, 5))
    marks = spark.createDataFrame([("a", 11), ("b", 0)], "scope string, sequence long")
    tail = {tuple(row) for row in ledger.suffix(frame, marks).collect()}
    assert tail == (
        {("a", n) for n in range(12, 20)} | {("b", n) for n in range(1, 8)} | {("new", n) for n in range(1, 5)}
    )
    proof = ledger.prefix_proof(frame, marks)
    assert {(row.scope, row.row_count) for row in proof.collect()} == {("a", 11)}
    grown = frame.unionAll(sequences(spark, a=[20]))
    assert ledger.changed_history(proof, ledger.prefix_proof(grown, marks)).isEmpty()
    lost = frame.where("sequence <> 5")
    assert [r.scope for r in ledger.changed_history(proof, ledger.prefix_proof(lost, marks)).collect()] == ["a"]


def test_batch_numbering_continues(spark):
    committed = sequences(spark, a=[1, 2, 3], idle=[1])
    batch = spark.createDataFrame([("a", 10), ("a", 5), ("b", 7)], "scope string, at long")
    got = {tuple(r) for r in ledger.assign_sequence(committed, batch, F.col("at")).select("scope", "at", "sequence").collect()}
    assert got == {("a", 5, 4), ("a", 10, 5), ("b", 7, 1)}


@pytest.mark.parametrize("segment", [10, 1 << 20])
def test_peak_usage_by_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(ledger.ordered, "SEGMENT_ROWS", segment)
    rng = random.Random(3)
    rows = []
    for group in "xy":
        for _ in range(60):
            start = rng.randrange(0, 50)
            rows.append((group, start, start + rng.randrange(0, 12), rng.randrange(1, 4)))
    frame = spark.createDataFrame(rows, "g string, started_us long, ended_us long, demand long")
    for row in ledger.peak_usage(frame, ["g"]).collect():
        load = {t: sum(d for g, s, e, d in rows if g == row.g and s <= t < e) for t in range(70)}
        assert row.peak == max(load.values())
        assert row.first_peak_us == min(t for t, used in load.items() if used == row.peak)


def test_latest_and_state_at(spark):
    frame = spark.createDataFrame(
        [("s", "node", "n", 1, "PENDING"), ("s", "node", "n", 2, "READY"), ("s", "run", "n", 3, "RUNNING")],
        "scope string, entity_type string, entity_id string, sequence long, status string",
    )
    assert {(r.entity_type, r.status) for r in ledger.latest(frame).collect()} == {("node", "READY"), ("run", "RUNNING")}
    assert {(r.entity_type, r.status) for r in ledger.state_at(frame, 1).collect()} == {("node", "PENDING")}


def test_public_events_show_only_listed_fields(spark):
    payload = json.dumps(
        {
            "status": "FAILED",
            "attempt": 2,
            "claim_id": "SENSITIVE",
            "outputs": {"x": {"path": "SENSITIVE"}},
            "business_run_key": "2024-01-02",
            "error": {"category": "TIMEOUT", "code": "LATE", "message": "SENSITIVE"},
        }
    )
    rows = [
        ("s", i, kind, "e", "r", "n", event, "t", payload)
        for i, (kind, event) in enumerate(
            [("node", "ATTEMPT_FINISHED"), ("node", "NODE_CREATED"), ("outbox", "OUTBOX_COMMITTED")]
        )
    ]
    frame = spark.createDataFrame(
        rows,
        "scope string, sequence long, entity_type string, entity_id string, run_id string, node_id string, "
        "event_type string, timestamp string, payload string",
    )
    shown = ledger.public_events(frame, include_run_key=False).collect()
    assert len(shown) == 1
    assert (shown[0].status, shown[0].error_category, shown[0].error_code) == ("FAILED", "TIMEOUT", "LATE")
    assert "SENSITIVE" not in str(shown) and "business_run_key" not in shown[0].asDict()
    assert ledger.public_events(frame).first().business_run_key == "2024-01-02"
    assert ledger.public_events(frame, replay_only=False).count() == 3


def test_redaction(spark):
    frame = spark.createDataFrame(
        [("DATA_QUALITY", "BAD_ROW", "SENSITIVE", True), ("DATA_QUALITY", "bad row", "SENSITIVE", None), (None, "X", "SENSITIVE", True)],
        "category string, code string, message string, retryable boolean",
    )
    rows = [tuple(r) for r in failures.redact_errors(frame).collect()]
    assert [(r[0], r[1], r[3]) for r in rows] == [
        ("DATA_QUALITY", "BAD_ROW", True),
        ("DATA_QUALITY", "APPLICATION_ERROR", False),
        ("INFRASTRUCTURE", "UNEXPECTED_ERROR", False),
    ]
    assert "SENSITIVE" not in str(rows)
    assert public_error(ValueError("SENSITIVE"))["code"] == "UNEXPECTED_ERROR"
    assert public_error(DataFailure("A_CODE", "SENSITIVE")) == {
        "category": "DATA_QUALITY",
        "code": "A_CODE",
        "message": "A_CODE (DATA_QUALITY)",
        "retryable": False,
    }


def test_run_summary(spark):
    frame = spark.createDataFrame(
        [
            ("s", "ok", "SUCCEEDED", 1, False, True),
            ("s", "ok", "FAILED", 2, False, False),
            ("s", "ok", "SKIPPED_CONDITION", 1, False, True),
            ("s", "bad", "BLOCKED", 1, False, True),
            ("s", "stuck", "FAILED", 1, True, True),
        ],
        "scope string, run_id string, status string, attempt long, execution_uncertain boolean, critical boolean",
    )
    rows = {row.run_id: row for row in ledger.run_summary(frame).collect()}
    assert {run: row.status for run, row in rows.items()} == {
        "ok": "SUCCEEDED",
        "bad": "FAILED",
        "stuck": "RECOVERY_REQUIRED",
    }
    ok = rows["ok"]
    assert (ok.total_nodes, ok.failed_nodes, ok.skipped_nodes, ok.retried_nodes) == (3, 1, 1, 1)
    assert {r.kind for r in ledger.control_notices(ledger.run_summary(frame)).where("run_id = 'bad'").collect()} == {
        "failure",
        "completed",
    }


def test_late_success_loses_its_outputs(spark):
    frame = spark.createDataFrame(
        [("ATTEMPT_FINISHED", "SUCCEEDED", 2, 1, "out", None, None, None), ("ATTEMPT_FINISHED", "SUCCEEDED", 1, 1, "out", None, None, None)],
        "event_type string, status string, ended_us long, deadline_us long, outputs string, retryable boolean, "
        "error_category string, error_code string",
    )
    late, good = ledger.late_success(frame).collect()
    assert (late.status, late.outputs, late.error_code, late.retryable) == ("TIMED_OUT", None, "DEADLINE_EXCEEDED", True)
    assert (good.status, good.outputs, good.error_code, good.retryable) == ("SUCCEEDED", "out", None, False)


def test_open_intervals_count_as_running(spark):
    rows = [("g", 10, 20, 1), ("g", 15, None, 1), ("g", 30, 40, 1), ("g", 35, 35, 5), ("g", None, 50, 7)]
    frame = spark.createDataFrame(rows, "g string, started_us long, ended_us long, demand long")
    row = ledger.peak_usage(frame.where("started_us is not null"), ["g"]).first()
    assert (row.peak, row.first_peak_us) == (2, 15)


def test_runs_and_outbox_entries_have_rules_of_their_own(spark):
    columns = "scope string, entity_type string, entity_id string, sequence long, event_type string, status string, execution_uncertain boolean"
    rows = [
        ("S", "run", "R", 1, "RUN_STARTED", "RUNNING", False),
        ("S", "node", "N", 2, "NODE_CREATED", "PENDING", False),
        ("S", "outbox", "O", 3, "OUTBOX_COMMITTED", "PENDING_DISPATCH", False),
        ("S", "outbox", "O", 4, "OUTBOX_REFERENCE_REFRESHED", "PENDING_DISPATCH", False),
        ("S", "run", "R", 5, "RUN_FINISHED", "RECOVERY_REQUIRED", False),
        ("S", "run", "R", 6, "RUN_RECONCILED", "FAILED", False),
        ("S", "run", "R", 7, "RUN_STARTED", "RUNNING", False),
        ("S", "outbox", "P", 8, "OUTBOX_REFERENCE_REFRESHED", "PENDING_DISPATCH", False),
        ("S", "lease", "L", 9, "TAKEN", "HELD", False),
        ("S", "node", "N", 10, "NODE_READY", None, False),
    ]
    found = ledger.illegal_transitions(spark.createDataFrame(rows, columns)).collect()
    assert sorted(r.sequence for r in found) == [7, 8, 9, 10]


def test_latest_keeps_null_keys_and_settles_ties(spark):
    rows = [
        (None, "node", "n", 1, "A"),
        (None, "node", "n", 2, "B"),
        ("s", "node", None, 5, "C"),
        ("s", "node", None, 4, "D"),
        (None, "run", None, 1, "E"),
        ("s", "node", "m", 3, "F"),
        ("s", "node", "m", 3, "G"),
        ("s", "node", "m", 3, "G"),
    ]
    schema = "scope string, entity_type string, entity_id string, sequence long, status string"
    found = [
        {(r.scope, r.entity_type, r.entity_id): r.status for r in ledger.latest(spark.createDataFrame(order, schema)).collect()}
        for order in (rows, rows[::-1])
    ]
    assert found[0] == found[1] and len(found[0]) == 4
    assert found[0][None, "node", "n"] == "B" and found[0]["s", "node", None] == "C" and found[0][None, "run", None] == "E"
    assert found[0]["s", "node", "m"] in ("F", "G")


def test_peak_usage_shuffles_three_times(spark):
    frame = spark.createDataFrame([("g", 1, 2, 1)], "g string, started_us long, ended_us long, demand long")
    plan = ledger.peak_usage(frame, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 4


def test_run_report_reads_the_ledger_once_for_all_uses_of_its_nodes(spark, monkeypatch, tmp_path):
    from quayside.operators import runs

    nodes = [("s", "r", n, state, 1, False, True) for n, state in (("a", "SUCCEEDED"), ("b", "FAILED"))]
    kinds = "scope string, run_id string, node_id string, status string, attempt long, execution_uncertain boolean, critical boolean"
    spark.createDataFrame(nodes, kinds).write.parquet(f"{tmp_path}/nodes")
    active = spark.createDataFrame([("s", "r", "a", 1.5), ("s", "r", "b", 2.0)], "scope string, run_id string, node_id string, active_seconds double")
    active.write.parquet(f"{tmp_path}/active")
    started = [("s", "r", "k", None, "normal", None, "2024-01-01T00:00:00+00:00", None)]
    described = spark.createDataFrame(
        started,
        "scope string, run_id string, business_run_key string, parent_run_id string, restart_mode string, rerun_reason string, "
        "started_at string, ended_at string",
    )
    edges, read = spark.createDataFrame([("a", "b")], "src string, dst string"), []
    plain = runs.critical_paths
    monkeypatch.setattr(runs, "critical_paths", lambda n, a, e: (read.extend(n.inputFiles() + a.inputFiles()), plain(n, a, e))[1])
    row = runs.run_report(
        described, spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/active"), edges,
        "2024-01-01T00:01:00+00:00",
    ).first()
    assert (row.critical_path_seconds, row.total_nodes, row.failed_nodes, row.status) == (3.5, 2, 1, "FAILED")
    assert read and not [file for file in read if str(tmp_path) in file]


def test_ledger_rows_are_numbered_before_they_get_their_texts(spark):
    from quayside.plans import derived

    plan = derived.events(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("claim_id") < plan.index("Window")
