from __future__ import annotations

import hashlib
import re
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quayside.contracts import LINE_SCHEMA, PRODUCT_SCHEMA
from quayside.errors import DataFailure
from quayside.functions.digest import dataset_digest
from quayside.operators import ledger
from quayside.session import scratch_path
from quayside.sources import delimited, ledger_table, outbox_ledger, snapshots

HEADER = ",".join(LINE_SCHEMA.names)


@pytest.fixture
def base(spark):
    return scratch_path(spark, "test")


def code(action):
    with pytest.raises(DataFailure) as failure:
        action()
    return failure.value.code


# --- CSV ---------------------------------------------------------------------------------------


def test_csv_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\nA,1,, W ,007,""\n')
    (tmp_path / "b.csv").write_text(f'{HEADER}\n"B,C",2,s,w,1,EA\n')
    rows = {tuple(r) for r in delimited.read_csv(spark, str(tmp_path), LINE_SCHEMA).collect()}
    assert rows == {("A", "1", None, " W ", "007", None), ("B,C", "2", "s", "w", "1", "EA")}


def test_csv_header_must_match_in_order(spark, tmp_path):
    swapped = HEADER.replace("sku,warehouse_id", "warehouse_id,sku")
    (tmp_path / "a.csv").write_text(f"{swapped}\nA,1,s,w,1,EA\n")
    assert code(lambda: delimited.read_csv(spark, str(tmp_path), LINE_SCHEMA)) == "SOURCE_SCHEMA_MISMATCH"
    assert code(lambda: delimited.read_csv(spark, str(tmp_path / "no"), LINE_SCHEMA)) == "SOURCE_UNAVAILABLE"


@pytest.mark.parametrize("row", ["A,1,s,w,1", "A,1,s,w,1,EA,more"])
def test_csv_row_width(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text(f"{HEADER}\nA,1,s,w,1,EA\n{row}\n")
    frame = delimited.read_csv(spark, str(tmp_path), LINE_SCHEMA)
    assert code(lambda: delimited.require_well_formed(frame)) == "MALFORMED_SOURCE"


def test_csv_file_digest_follows_content(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(f"{HEADER}\nA,1,s,w,1,EA\n")
    before = delimited.source_digest(spark, str(path)).first()
    assert delimited.source_digest(spark, str(path)).first() == before
    path.write_text(f"{HEADER}\nA,1,s,w,2,EA\n")
    assert delimited.source_digest(spark, str(path)).first() != before


# --- digests and snapshots ---------------------------------------------------------------------


def numbers(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "value long")


def test_digest_is_a_multiset_proof(spark):
    def proof(*values):
        return dataset_digest(numbers(spark, *values)).first()

    assert proof(1, 2, 2) == proof(2, 1, 2)
    assert proof(1, 2) != proof(1, 2, 2)
    assert proof(1, None) != proof(1)
    empty = proof()
    assert (empty.row_count, empty.sum_0, empty.sum_3) == (0, "0", "0")


def test_digest_ignores_column_order(spark):
    frame = spark.createDataFrame([("a", 1)], "x string, y long")
    assert dataset_digest(frame).first() == dataset_digest(frame.select("y", "x")).first()


def test_digest_covers_the_whole_hash_and_the_names(spark):
    frame = spark.createDataFrame([(n, f"é{n}" if n % 3 else None) for n in range(50)], "n long, word string")
    hashes = []
    for n in range(50):
        word = f"é{n}".encode() if n % 3 else None
        text = f"1:n={len(str(n))}:{n},4:word=".encode() + (b"-" if word is None else b"%d:%s" % (len(word), word))
        hashes.append(hashlib.sha256(text).hexdigest())
    assert all(len(hash_) == 64 for hash_ in hashes)
    expected = [str(sum(int(hash_[16 * i : 16 * i + 16], 16) for hash_ in hashes)) for i in range(4)]
    got = dataset_digest(frame).first()
    assert [got.row_count, *(got[f"sum_{i}"] for i in range(4))] == [50, *expected]
    assert dataset_digest(frame.withColumnRenamed("word", "x")).first() != got


def test_reference_pins_identity_and_content(spark, base):
    first = snapshots.write_version(numbers(spark, 2, 1), f"{base}/one")
    second = snapshots.write_version(numbers(spark, 1, 2), f"{base}/two")
    assert first["digest"] == second["digest"] and first["table_id"] != second["table_id"]
    proofs = snapshots.Proofs(spark)
    assert proofs.validate(first)
    assert code(lambda: snapshots.write_version(numbers(spark, 3), f"{base}/one")) == "ARTIFACT_COLLISION"
    snapshots.write_version(numbers(spark, 3), f"{base}/one", 1)
    assert sorted(r.value for r in proofs.read(first).collect()) == [1, 2]
    assert not proofs.validate({**first, "table_id": second["table_id"]})
    assert not proofs.validate({**first, "row_count": 3})
    assert not proofs.validate({k: v for k, v in first.items() if k != "digest"})
    numbers(spark, 9).write.mode("append").parquet(f"{base}/two/version=0/data")
    assert not proofs.validate(second)
    shutil.rmtree(f"{base}/one")
    assert not proofs.validate(first)
    assert code(lambda: snapshots.Proofs(spark).read(first)) == "OUTPUT_INVALID"
    assert code(lambda: proofs.read({"scope": "s", "effect_id": "e"})) == "INVALID_ARTIFACT_READ"


def test_proof_cache_is_per_attempt_and_per_reference(spark, base, monkeypatch):
    calls = []
    real = snapshots.content_proof
    monkeypatch.setattr(snapshots, "content_proof", lambda frame: calls.append(1) or real(frame))
    proofs = snapshots.Proofs(spark)
    reference = snapshots.publish(
        proofs, f"{base}/refs", "s", "r", "n", 1, {"out": (numbers(spark, 1), f"{base}/out")}
    )["out"]
    assert len(calls) == 0
    assert proofs.validate(reference, use_cached=True) and proofs.read(reference).count() == 1
    assert len(calls) == 0
    assert proofs.validate(reference) and len(calls) == 1
    assert not proofs.validate({**reference, "digest": "changed"}, use_cached=True)
    proofs.clear()
    assert proofs.validate(reference, use_cached=True) and len(calls) == 3


def test_pinned_source(spark, base, monkeypatch):
    products = spark.createDataFrame([("S", "d", "EA")], PRODUCT_SCHEMA)
    snapshots.write_version(products, base, 0)
    assert snapshots.read_version(spark, base, 0, PRODUCT_SCHEMA).count() == 1
    assert code(lambda: snapshots.read_version(spark, base, 0, LINE_SCHEMA)) == "SOURCE_SCHEMA_MISMATCH"
    assert code(lambda: snapshots.read_version(spark, base, 5, PRODUCT_SCHEMA)) == "SOURCE_UNAVAILABLE"
    first = snapshots.pinned_fingerprint(spark, base, 0)
    snapshots.write_version(products.limit(0), base, 1)
    assert snapshots.latest_version(spark, base) == 1
    monkeypatch.setattr(snapshots, "content_proof", lambda frame: pytest.fail("rows were scanned"))
    assert snapshots.pinned_fingerprint(spark, base, 0) == first
    assert snapshots.pinned_fingerprint(spark, base, 1) != first
    assert snapshots.latest_version(spark, f"{base}-none") is None


@pytest.mark.parametrize("part", ["", "a/b", "a\\b", ".", ".."])
def test_unsafe_paths(part):
    assert code(lambda: snapshots.artifact_path("/b", "s", part, "n", 1, "x")) == "INVALID_ARTIFACT_PATH"


def test_outputs_appear_together_or_not_at_all(spark, base):
    proofs = snapshots.Proofs(spark)
    bad = numbers(spark, 1).select(F.raise_error(F.lit("stop")).cast("long").alias("value"))
    with pytest.raises(Exception, match="stop"):
        snapshots.publish(
            proofs,
            f"{base}/refs",
            "s",
            "r",
            "n",
            1,
            {"good": (numbers(spark, 1), f"{base}/out"), "bad": (bad, f"{base}/rejects")},
        )
    snapshots.publish(
        proofs,
        f"{base}/refs",
        "s",
        "r",
        "n",
        2,
        {"good": (numbers(spark, 1), f"{base}/out"), "bad": (numbers(spark), f"{base}/rejects")},
    )
    visible = snapshots.committed(spark, f"{base}/refs").collect()
    assert sorted((r.name, r.attempt, r.row_count) for r in visible) == [("bad", 2, 0), ("good", 2, 1)]
    verdicts = snapshots.audit(spark, [r.asDict() for r in visible])
    assert all(verdicts.values()) and len(verdicts) == 2


# --- stored ledger -----------------------------------------------------------------------------


def event_batch(spark, rows):
    """rows of (position, scope, entity, event_type, payload)"""
    return spark.createDataFrame(
        [(at, scope, "node", entity, "r", entity, kind, "t", payload) for at, scope, entity, kind, payload in rows],
        "at long, scope string, entity_type string, entity_id string, run_id string, node_id string, "
        "event_type string, timestamp string, payload string",
    )


def test_ledger_append_and_suffix(spark, base):
    ledger_table.create(spark, base)
    ledger_table.append(
        spark,
        base,
        event_batch(spark, [(0, "a", "n", "NODE_CREATED", "{}"), (1, "b", "n", "NODE_CREATED", "{}"), (2, "a", "m", "X", "{}")]),
        "at",
    )
    ledger_table.append(spark, base, event_batch(spark, [(0, "a", "n", "NODE_READY", "{}"), (1, "c", "n", "X", "{}")]), "at")
    events = ledger_table.read(spark, base)
    assert sorted((r.scope, r.sequence) for r in events.collect()) == [
        ("a", 1),
        ("a", 2),
        ("a", 3),
        ("b", 1),
        ("c", 1),
    ]
    ledger.require_intact(events)
    tail = ledger_table.read_in_order(spark, base, "a", after=1)
    assert [(r.sequence, r.event_type) for r in tail.collect()] == [(2, "X"), (3, "NODE_READY")]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert all("kind" in f and "shard" in f for f in scanned(tail)) and "GreaterThan(sequence,1)" in plan
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ledger_table.create(spark, base)


def scanned(frame):
    """The partition filters of every scan of a plan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)


def test_commits_open_no_events(spark, base):
    """What a commit knows of the past comes from positions, which compaction replaces by one per shard."""
    ledger_table.create(spark, base)
    for i in range(3):
        batch = [(n, scope, "e", "X", "{}") for n, scope in enumerate(["a", "b", "a"])]
        ledger_table.append(spark, base, event_batch(spark, batch), "at")
    held = ledger_table.positions(spark, base, ledger_table.touched_shards(event_batch(spark, [(0, "a", "e", "X", "{}")]), "scope"))
    assert all("position" in f and "shard" in f for f in scanned(held)) and scanned(held)
    assert {r.scope: r.sequence for r in held.collect()} == {"a": 6}
    names = ledger_table.stored(spark, base, "position").select("_metadata.file_path").distinct().collect()
    assert all("kind=position" in r.file_path for r in names) and len(names) == 6
    assert ledger_table.compact(spark, base) >= 6
    names = ledger_table.stored(spark, base, "position").select("_metadata.file_path").distinct().collect()
    assert len(names) == 2 and ledger_table.read(spark, base).count() == 9
    ledger_table.append(spark, base, event_batch(spark, [(0, "b", "e", "Y", "{}"), (1, "c", "e", "Y", "{}")]), "at")
    assert {r.scope: r.sequence for r in ledger_table.positions(spark, base).collect()} == {"a": 6, "b": 4, "c": 1}
    ledger.require_intact(ledger_table.read(spark, base))


def test_only_grown_shards_are_read_behind_marks(spark, base):
    ledger_table.create(spark, base)
    scopes = [f"s{i}" for i in range(30)]
    ledger_table.append(spark, base, event_batch(spark, [(i, s, "e", "X", "{}") for i, s in enumerate(scopes)]), "at")
    marks = spark.createDataFrame([(s, 1) for s in scopes[1:]], "scope string, sequence long")
    ledger_table.append(spark, base, event_batch(spark, [(0, "s7", "e", "Y", "{}"), (1, "s7", "e", "Z", "{}")]), "at")
    rest = ledger_table.read_behind(spark, base, marks)
    assert {(r.scope, r.sequence) for r in rest.collect()} == {("s0", 1), ("s7", 2), ("s7", 3)}
    everything = spark.createDataFrame([(s, 9) for s in scopes], "scope string, sequence long")
    assert ledger_table.read_behind(spark, base, everything).count() == 0
    behind_s7 = ledger_table.read_behind(spark, base, spark.createDataFrame([(s, 1) for s in scopes], marks.schema))
    plan = behind_s7._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(sequence,1)" in plan and {r.sequence for r in behind_s7.collect()} == {2, 3}


def intent_batch(spark, rows):
    return spark.createDataFrame(
        [("s", f"n{i}", "op", digest, ref, i) for i, digest, ref in rows],
        "scope string, node_id string, operation string, payload_digest string, output_reference string, arrival long",
    )


def test_intents_are_committed_once(spark, base):
    ledger_table.create(spark, base)
    first = intent_batch(spark, [(i, "d", "r") for i in range(5)])
    assert outbox_ledger.commit(spark, base, first, "arrival") == {"insert": 5, "refresh": 0, "conflict": 0}
    assert outbox_ledger.commit(spark, base, first, "arrival") == {"insert": 0, "refresh": 0, "conflict": 0}
    moved = intent_batch(spark, [(1, "d", "r2"), (7, "d", "r")])
    assert outbox_ledger.commit(spark, base, moved, "arrival") == {"insert": 1, "refresh": 1, "conflict": 0}
    assert code(lambda: outbox_ledger.commit(spark, base, intent_batch(spark, [(2, "other", "r")]), "arrival")) == "SIDE_EFFECT_CONFLICT"
    assert ledger_table.read(spark, base).count() == 7
    stored = outbox_ledger.stored_intents(ledger_table.intents(spark, base, ["00", "ff"]))
    assert all("intent" in f and "shard" in f for f in scanned(stored))
    assert outbox_ledger.stored_intents(ledger_table.intents(spark, base)).count() == 6


def test_many_references_are_audited_by_two_scans(spark, base, monkeypatch):
    references = [snapshots.write_version(numbers(spark, *range(i % 3)), f"{base}/a{i}") for i in range(6)]
    other = snapshots.write_version(spark.createDataFrame([("x", 1.5)], "a string, b double"), f"{base}/other")
    wrong = [
        {**references[1], "row_count": 7},
        {**references[2], "path": f"{base}/gone"},
        {**other, "table_id": "x"},
        {**references[3], "digest": None},
    ]
    verdicts = snapshots.audit(spark, [*references, other])
    assert all(verdicts.values()) and len(verdicts) == 7
    assert not any(snapshots.audit(spark, wrong).values())
    scans = []
    plain = snapshots.dataset_digest
    monkeypatch.setattr(snapshots, "dataset_digest", lambda *a: (scans.append(a), plain(*a))[1])
    assert len(snapshots.audit(spark, [*references, other])) == 7 and len(scans) == 2
    spark.range(1).write.mode("append").parquet(f"{base}/a4/version=0/data")
    assert [snapshots.audit(spark, references)[r["path"]] for r in references] == [True] * 4 + [False, True]


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    schema = StructType([StructField("a", StringType()), StructField("b", StringType())])
    (tmp_path / "x.csv").write_text('a,b\n"x ""y"" z","two\nlines"\n\\,"c,d"\n')
    rows = {tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "x.csv"), schema).collect()}
    assert rows == {('x "y" z', "two\nlines"), ("\\", "c,d")}
    frame = spark.createDataFrame([*rows, (None, 'q"')], schema)
    delimited.write_csv(frame, str(tmp_path / "out"))
    assert {tuple(r) for r in delimited.read_csv(spark, str(tmp_path / "out"), schema).collect()} == {*rows, (None, 'q"')}


def test_replays_leave_no_rows_behind(spark, base, monkeypatch):
    """What a commit keeps for itself is what it appends, with identities as bytes."""
    ledger_table.create(spark, base)
    kept = []
    plain = outbox_ledger.materialize
    monkeypatch.setattr(outbox_ledger, "materialize", lambda *a, **k: (kept.append(plain(*a, **k)), kept[-1])[1])
    for batch in ([(0, "p", "r"), (1, "p", "r")], [(0, "p", "r"), (1, "p", "r")], [(1, "p", "moved")]):
        outbox_ledger.commit(spark, base, intent_batch(spark, batch), "arrival")
    assert [dict(frame.dtypes)["effect_id"] for frame, _ in kept] == ["binary"] * 3
    assert [frame.count() for frame, _ in kept][1] == 0
    stored = outbox_ledger.stored_intents(ledger_table.intents(spark, base)).select("effect_id").collect()
    assert all(re.fullmatch("[0-9a-f]{64}", row.effect_id) for row in stored)
