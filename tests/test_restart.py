from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quayside.errors import DataFailure
from quayside.operators import credentials, ordered, outbox, restart

# --- outbox ------------------------------------------------------------------------------------


def play(existing, incoming):
    """One intent after the other against a dictionary."""
    store = {e: [d, r, s] for e, d, r, s in existing}
    result = {}
    for at, effect, digest, reference in sorted(incoming):
        held = store.get(effect)
        if held is None:
            store[effect] = [digest, reference, outbox.PENDING]
            result[at] = "insert"
        elif held[0] != digest:
            result[at] = "conflict"
        elif held[2] == outbox.PENDING and held[1] != reference:
            held[1] = reference
            result[at] = "refresh"
        else:
            result[at] = "noop"
    return result


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_actions_equal_one_by_one_application(spark, seed):
    rng = random.Random(seed)
    existing = [(f"e{i}", rng.choice("ab"), rng.choice("xyz"), rng.choice([outbox.PENDING, "DISPATCHED"])) for i in range(6)]
    incoming = [(at, f"e{rng.randrange(10)}", rng.choice("ab"), rng.choice("xyz")) for at in range(120)]
    columns = "effect_id string, payload_digest string, output_reference string"
    decided = outbox.actions(
        spark.createDataFrame(existing, f"{columns}, status string"),
        spark.createDataFrame(incoming, f"at long, {columns}"),
        F.col("at"),
    )
    assert {r.arrival: r.action for r in decided.collect()} == play(existing, incoming)
    assert outbox.new_intents(decided).count() + outbox.refreshed(decided).count() > 0
    with pytest.raises(DataFailure) as failure:
        outbox.require_no_conflict(decided)
    assert failure.value.code == "SIDE_EFFECT_CONFLICT"


def test_operation_names_and_identity(spark):
    names = ["inventory_receipt", "Bad", "a b", "1a", "a" * 64, "a" * 65, "x\n"]
    frame = spark.createDataFrame([("s", "n", name) for name in names], "scope string, node_id string, operation string")
    rows = outbox.with_effect_id(frame).collect()
    assert [r.valid_operation for r in rows] == [True, False, False, False, True, False, False]
    assert len({r.effect_id for r in rows}) == len(names)


def test_intent_can_be_switched_off(spark):
    frame = spark.createDataFrame([(1,)], "v long")
    assert outbox.dataset_intent(frame, "s", "n", "op", enabled=False).isEmpty()
    one = outbox.dataset_intent(frame, "s", "n", "op").first()
    two = outbox.dataset_intent(frame.unionAll(frame), "s", "n", "op").first()
    assert one.effect_id == two.effect_id and one.payload_digest != two.payload_digest


def test_receipts(spark):
    intents = spark.createDataFrame([("s", "e", "d")], "scope string, effect_id string, payload_digest string")
    receipts = spark.createDataFrame(
        [("s", "e", "d"), ("s", "e", "x"), ("s", "f", "d"), ("t", "e", "d")],
        "scope string, effect_id string, digest string",
    )
    got = {(r.scope, r.effect_id, r.digest): r.valid for r in outbox.receipts_valid(receipts, intents).collect()}
    assert [key for key, valid in got.items() if valid] == [("s", "e", "d")]


# --- fingerprints ------------------------------------------------------------------------------


def test_input_fingerprint_sensitivity(spark):
    definitions = spark.createDataFrame([("n", "code", 3)], "node_id string, code string, max_retries int")
    schema = "node_id string, dependency string, status string, output string, digest string, row_count long"

    def proof(code="code", retries=3, rows=(("n", "a", "SUCCEEDED", "o", "d", 1), ("n", "b", "SUCCEEDED", "o", "e", 1))):
        frame = definitions.withColumns({"code": F.lit(code), "max_retries": F.lit(retries)})
        return restart.input_fingerprints(frame, spark.createDataFrame(list(rows), schema), ["code", "node_id"]).first()[1]

    a, b = ("n", "a", "SUCCEEDED", "o", "d", 1), ("n", "b", "SUCCEEDED", "o", "e", 1)
    base = proof()
    assert proof(rows=(b, a)) == base
    assert proof(retries=9) == base
    assert proof(rows=(a, ("n", "b", "SKIPPED_ALREADY_SATISFIED", "o", "e", 1))) == base
    different = {
        proof(code="other"),
        proof(rows=(a,)),
        proof(rows=(a, ("n", "b", "FAILED", "o", "e", 1))),
        proof(rows=(a, ("n", "b", "SUCCEEDED", "o", "e", 2))),
        proof(rows=()),
    }
    assert base not in different and len(different) == 5


def test_parameters_stand_for_their_source(spark):
    schema = "node_id string, path string, value string, source_id string"
    parameters = spark.createDataFrame([("n", "rules.max", "5", None), ("n", "source", "ignored", "s")], schema)

    def proof(fingerprint):
        sources = spark.createDataFrame([("s", fingerprint)], "source_id string, fingerprint string")
        return restart.parameter_fingerprints(parameters, sources).first().fingerprint

    assert proof("a") == proof("a") != proof("b")


def test_changed_inputs(spark):
    schema = "k string, row_count long, sum_0 string, sum_1 string, sum_2 string, sum_3 string"
    before = spark.createDataFrame([(k, 1, "1", "2", "3", "4") for k in "abc"], schema)
    after = spark.createDataFrame([("a", 1, "1", "2", "3", "4"), ("b", 1, "1", "2", "3", "5"), ("d", 1, "1", "2", "3", "4")], schema)
    got = {r.k: r.change for r in restart.changed_inputs(before, after, ["k"]).collect()}
    assert got == {"b": "changed", "c": "removed", "d": "added"}


def test_invalidation_origins(spark):
    prior = spark.createDataFrame([("a", "SUCCEEDED"), ("b", "FAILED"), ("c", "SKIPPED_ALREADY_SATISFIED")], "node_id string, status string")
    extra = spark.createDataFrame([("a",)], "node_id string")

    def names(*args):
        return sorted(r.node_id for r in restart.invalidation_origins(prior, *args).collect())

    assert names("resume") == ["b"]
    assert names("force_restart", extra) == ["a", "b"]
    assert names("force_rerun") == ["a", "b", "c"]


# --- credential shapes -------------------------------------------------------------------------

TEXTS = [
    ("password = x", (1, 0, 0)),
    ("my.password: x and access_token=1", (2, 0, 0)),
    ("passwords = x", (0, 0, 0)),
    ("the token was lost", (0, 0, 0)),
    ('{"client_secret": "x"}', (1, 0, 0)),
    ("fs.azure.account.key.store.example = k", (0, 1, 0)),
    ("see https://user@host/path", (0, 0, 1)),
    ("see https://user:pw@host/path", (0, 0, 1)),
    ("see https://host/path?sig=1", (0, 0, 1)),
    ("see https://host/path?#x", (0, 0, 0)),
    ("see https://host/a@b", (0, 0, 0)),
    ("abfss://container@account/path", (0, 0, 0)),
    ("abfss://container:pw@account/path", (0, 0, 1)),
    ("abfs://container@account/path?sig=1", (0, 0, 1)),
]


def test_credential_shapes(spark):
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(TEXTS)], "id long, text string")
    found = {r.id: (r.secret_names, r.account_key_settings, r.credential_uris) for r in credentials.credential_scan(frame, "id", "text", "t").collect()}
    assert {i: found.get(i, (0, 0, 0)) for i in range(len(TEXTS))} == {i: want for i, (_, want) in enumerate(TEXTS)}


def test_null_conditions_refuse_reuse(spark):
    current = spark.createDataFrame(
        [(i, *values) for i, values in enumerate([(False, True), (None, True), (False, None)])],
        "node_id int, invalidated boolean, eligible boolean",
    ).selectExpr(
        "*", "'k' business_run_key", "'d' dag_id", "'1' dag_version", "array('1') compatible_versions",
        "'c' code_version", "'f' code_fingerprint", "'i' input_fingerprint", "'reuse_valid' policy",
        "'merge' strategy", "'cp' checkpoint_name",
    )
    prior = current.selectExpr(
        "node_id", "business_run_key", "dag_id", "dag_version", "code_version", "code_fingerprint", "input_fingerprint",
        "'SUCCEEDED' status", "false execution_uncertain", "'o' outputs_fingerprint", "true outputs_valid",
        "named_struct('name', 'cp', 'input_fingerprint', 'i', 'outputs_fingerprint', 'o') checkpoint",
    )
    found = {r.node_id: r.cause for r in restart.reuse_proof(current, prior).collect()}
    assert found == {0: None, 1: "invalidated", 2: "not_eligible"}
    for column in ("policy", "strategy"):
        lost = current.withColumn(column, F.lit(None).cast("string"))
        assert not any(r.reuse for r in restart.reuse_proof(lost, prior).collect())


def test_null_keys_meet(spark):
    proofs = spark.createDataFrame(
        [(None, 1, "a", "b", "c", "d"), ("x", 2, "a", "b", "c", "d")],
        "k string, row_count long, sum_0 string, sum_1 string, sum_2 string, sum_3 string",
    )
    assert restart.changed_inputs(proofs, proofs, ["k"]).count() == 0
    assert all(r.valid for r in restart.validate_references(proofs, proofs, ["k"]).collect())
    changed = restart.changed_inputs(proofs, proofs.where("k = 'x'"), ["k"]).collect()
    assert [(r.k, r.change) for r in changed] == [(None, "removed")]


def test_actions_on_stored_records_and_large_identities(spark, monkeypatch):
    """Several stored records of an identity count by their newest; identities beyond one task's rows go by segments."""
    rng = random.Random(9)
    incoming = [(at, f"e{rng.choice([0, 0, 0, *range(10)])}", rng.choice("ab"), rng.choice("xyz")) for at in range(200)]
    records = [(f"e{i % 6}", "ab"[i % 5 == 0], rng.choice("xyz"), rng.choice([outbox.PENDING, "DISPATCHED"]), i) for i in range(20)]
    newest = {row[0]: row[:4] for row in records}
    columns = "effect_id string, payload_digest string, output_reference string"
    stored = spark.createDataFrame(records, f"{columns}, status string, sequence long")
    batch = spark.createDataFrame(incoming, f"at long, {columns}")
    expected = play(list(newest.values()), incoming)
    decided = outbox.actions(stored, batch, F.col("at"))
    assert {r.arrival: r.action for r in decided.collect()} == expected
    plan = decided._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", 50)
    assert ordered.crowded(batch, ["effect_id"]) is not None
    for widths in ((1 << 20,), (16,)):
        monkeypatch.setattr(ordered.first_value, "__defaults__", (widths,))
        monkeypatch.setattr(ordered.previous, "__defaults__", (widths,))
        assert {r.arrival: r.action for r in outbox.actions(stored, batch, F.col("at")).collect()} == expected
