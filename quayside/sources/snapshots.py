"""Immutable, versioned Parquet snapshots and the references that make them visible.

A snapshot lives in ``<path>/version=<n>/data`` next to a one-row manifest with its identity, schema and
content proof. Nothing is ever overwritten. A folder without a reference is an orphan of a failed attempt and
no reader sees it, because readers start from references.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quayside.errors import DataFailure
from quayside.functions.digest import SUMS, dataset_digest, proof_fingerprint
from quayside.functions.text import PATH_PART

REFERENCE_SCHEMA = StructType(
    [
        StructField("scope", StringType()),
        StructField("run_id", StringType()),
        StructField("node_id", StringType()),
        StructField("attempt", LongType()),
        StructField("name", StringType()),
        StructField("path", StringType()),
        StructField("version", LongType()),
        StructField("table_id", StringType()),
        StructField("digest", StringType()),
        StructField("row_count", LongType()),
        StructField("schema", StringType()),
    ]
)
_PLAIN = re.compile(PATH_PART.replace(r"\z", r"\Z"))
_IDENTITY = ["path", "version", "table_id", "digest", "row_count", "schema"]
_REFERENCE_ROW = StructType([f for f in REFERENCE_SCHEMA if f.name in _IDENTITY])
_MANIFEST_SCHEMA = StructType([f for f in REFERENCE_SCHEMA if f.name in _IDENTITY and f.name != "path"])


def _data(path: str, version: int) -> str:
    return f"{path}/version={version}/data"


def _manifest(path: str, version: int | str) -> str:
    return f"{path}/version={version}/manifest"


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def content_proof(frame: DataFrame) -> dict[str, Any]:
    """Row count, schema and fingerprint of a dataset: one aggregate, one row to the driver."""
    schema = frame.schema.simpleString()
    proof = dataset_digest(frame).select("row_count", proof_fingerprint(schema).alias("digest")).first()
    return {"digest": proof["digest"], "row_count": proof["row_count"], "schema": schema}


def artifact_path(base: str, scope: str, run_id: str, node_id: str, attempt: int, name: str) -> str:
    """Folder of one output of one attempt, below ``base``."""
    path = base.rstrip("/")
    for part in (scope, run_id, node_id, str(attempt), name):
        if not _PLAIN.fullmatch(part):
            raise DataFailure("INVALID_ARTIFACT_PATH", "A name does not fit into a path.", "CONFIGURATION")
        path += f"/{part}"
    return path


def _write_data(frame: DataFrame, path: str, version: int) -> None:
    try:
        frame.write.mode("errorifexists").parquet(_data(path, version))
    except AnalysisException as error:
        if error.getCondition() == "PATH_ALREADY_EXISTS":
            raise DataFailure("ARTIFACT_COLLISION", "This version exists already.", "CONFIGURATION") from None
        raise


def _write_manifest(spark: SparkSession, reference: dict[str, Any]) -> None:
    row = tuple(reference[name] for name in _MANIFEST_SCHEMA.names)
    spark.createDataFrame([row], _MANIFEST_SCHEMA).coalesce(1).write.mode("errorifexists").json(
        _manifest(reference["path"], reference["version"])
    )


def write_version(frame: DataFrame, path: str, version: int = 0) -> dict[str, Any]:
    """Write one version, read it back, prove it and return its reference. The manifest comes last."""
    spark = frame.sparkSession
    _write_data(frame, path, version)
    committed = spark.read.schema(frame.schema).parquet(_data(path, version))
    table_id = uuid.uuid4().hex if version == 0 else read_manifest(spark, path, 0)["table_id"]
    reference = {"path": path, "version": version, "table_id": table_id, **content_proof(committed)}
    _write_manifest(spark, reference)
    return reference


def _folder(path: Column) -> Column:
    """The part of a file's or folder's address below its file system, up to its version."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    return F.regexp_extract(bare, r"^(.*/version=[^/]*)(?:/.*)?$", 1)


def content_proofs(spark: SparkSession, versions: list[tuple[str, int, str]]) -> DataFrame:
    """``folder, digest, row_count, schema`` of many stored versions (path, version, schema) by one job: versions of one
    schema are one scan, whose rows are told apart by their file's path."""
    wanted = spark.createDataFrame(
        [(f"{path}/version={version}", schema) for path, version, schema in versions], "folder string, schema string"
    ).select(_folder(F.col("folder")).alias("folder"), "schema")
    by_schema: dict[str, list[str]] = {}
    for path, version, schema in versions:
        by_schema.setdefault(schema, []).append(_data(path, version))
    digests = []
    for schema, paths in by_schema.items():
        rows = spark.read.schema(_struct(schema)).parquet(*paths)
        digests.append(dataset_digest(rows.select("*", _folder(F.col("_metadata.file_path")).alias("_folder")), "_folder"))
    found = functools.reduce(DataFrame.unionByName, digests)
    # A version without rows has no row of its own.
    none = {"row_count": 0, **{f"sum_{i}": "0" for i in range(SUMS)}}
    joined = wanted.join(found, F.col("folder") == F.col("_folder"), "left").na.fill(none)
    return joined.select("folder", proof_fingerprint(F.col("schema")).alias("digest"), "row_count", "schema")


def _struct(schema: str) -> StructType:
    return StructType.fromDDL(schema.removeprefix("struct<").removesuffix(">"))


def read_manifest(spark: SparkSession, path: str, version: int) -> dict[str, Any] | None:
    """Identity and proof of a version without touching its data; None where it does not exist."""
    try:
        row = spark.read.schema(_MANIFEST_SCHEMA).json(_manifest(path, version)).first()
    except AnalysisException as error:
        if _absent(error):
            return None
        raise
    return row.asDict() if row else None


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest committed version."""
    try:
        manifests = spark.read.schema(_MANIFEST_SCHEMA).json(_manifest(path, "*"))
    except AnalysisException as error:
        if _absent(error):
            return None
        raise
    return manifests.agg(F.max("version")).first()[0]


def read_version(spark: SparkSession, path: str, version: int, schema: StructType) -> DataFrame:
    """A pinned version whose schema must equal ``schema``."""
    manifest = read_manifest(spark, path, version)
    if manifest is None:
        raise DataFailure("SOURCE_UNAVAILABLE", "No such snapshot.", "INFRASTRUCTURE", retryable=True)
    if manifest["schema"] != schema.simpleString():
        raise DataFailure("SOURCE_SCHEMA_MISMATCH", "The snapshot schema differs from its contract.")
    return spark.read.schema(schema).parquet(_data(path, version))


def pinned_fingerprint(spark: SparkSession, path: str, version: int) -> str:
    """Identity, version and schema of a pinned source; reads the manifest row only."""
    manifest = read_manifest(spark, path, version)
    if manifest is None:
        raise DataFailure("SOURCE_UNAVAILABLE", "No such snapshot.", "INFRASTRUCTURE", retryable=True)
    return _fingerprint([path, manifest["table_id"], version, manifest["schema"]])


def _fingerprint(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class Proofs:
    """Reference rows that this attempt has seen to be good. Asking without ``use_cached`` always looks again."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._good: set[tuple] = set()

    def clear(self) -> None:
        self._good = set()

    def remember(self, reference: dict[str, Any]) -> None:
        self._good.add(_row(reference))

    def validate(self, reference: dict[str, Any], use_cached: bool = False) -> bool:
        """Does what is stored now give the same reference row? Missing data gives none."""
        row = _row(reference)
        if None in row:
            return False
        if not use_cached:
            self._good.discard(row)
        if row not in self._good and stored_row(self.spark, reference) == row:
            self._good.add(row)
        return row in self._good

    def read(self, reference: dict[str, Any]) -> DataFrame:
        """The dataset behind a valid reference."""
        if "effect_id" in reference:
            raise DataFailure("INVALID_ARTIFACT_READ", "A receipt is not a dataset.", "CONFIGURATION")
        if not self.validate(reference, use_cached=True):
            raise DataFailure("OUTPUT_INVALID", "A committed artifact is missing or changed.")
        return self.spark.read.parquet(_data(reference["path"], reference["version"]))


def _row(reference: dict[str, Any]) -> tuple:
    return tuple(reference.get(name) for name in _IDENTITY)


def stored_row(spark: SparkSession, reference: dict[str, Any]) -> tuple | None:
    """The reference row of a version as its manifest and data give it now, None where either is missing."""
    path, version = reference["path"], reference["version"]
    manifest = read_manifest(spark, path, version)
    if manifest is None:
        return None
    try:
        spark.catalog.refreshByPath(_data(path, version))
        proof = content_proof(spark.read.parquet(_data(path, version)))
    except AnalysisException as error:
        if not _absent(error):
            raise
        return None
    return _row({"path": path, "version": version, "table_id": manifest["table_id"], **proof})


def publish(
    proofs: Proofs,
    references_path: str,
    scope: str,
    run_id: str,
    node_id: str,
    attempt: int,
    outputs: dict[str, tuple[DataFrame, str]],
) -> dict[str, dict[str, Any]]:
    """Write and prove every output ``name -> (frame, base folder)``, then make them visible together.

    Outputs are written side by side, and one job reads all of them back for their proofs. The commit point is one append
    of all reference rows. If any output fails, none is ever referenced.
    """
    spark = proofs.spark
    paths = {name: artifact_path(base, scope, run_id, node_id, attempt, name) for name, (_, base) in outputs.items()}
    _together(spark, [(_write_data, frame, paths[name], 0) for name, (frame, _) in outputs.items()])
    versions = [(paths[name], 0, frame.schema.simpleString()) for name, (frame, _) in outputs.items()]
    proven = {row["folder"]: row for row in content_proofs(spark, versions).collect()}
    references = {}
    for name, (frame, _) in outputs.items():
        folder = next(f for f in proven if f"{paths[name]}/version=0".endswith(f))
        proof = {"digest": proven[folder]["digest"], "row_count": proven[folder]["row_count"]}
        schema = frame.schema.simpleString()
        references[name] = {"path": paths[name], "version": 0, "table_id": uuid.uuid4().hex, **proof, "schema": schema}
    _together(spark, [(_write_manifest, spark, reference) for reference in references.values()])
    for reference in references.values():
        proofs.remember(reference)
    rows = [
        (scope, run_id, node_id, attempt, name, *[reference[field] for field in _IDENTITY])
        for name, reference in references.items()
    ]
    spark.createDataFrame(rows, REFERENCE_SCHEMA).coalesce(1).write.mode("append").parquet(references_path)
    return references


def _together(spark: SparkSession, calls: list[tuple]) -> None:
    """Runs a few jobs side by side; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(max_workers=max(1, len(calls))) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(call), *rest) for call, *rest in calls]
    for call in started:
        call.result()


def committed(spark: SparkSession, references_path: str) -> DataFrame:
    """All visible references."""
    return spark.read.schema(REFERENCE_SCHEMA).parquet(references_path)


def audit(spark: SparkSession, references: list[dict[str, Any]]) -> dict[str, bool]:
    """Verdict per path over any number of references: one scan of their manifests and one of their data. Missing ones,
    and rows that say nothing, are false."""
    verdicts = {reference["path"]: False for reference in references}
    there = [
        reference
        for reference in references
        if None not in _row(reference)
        and _exists(spark, _data(reference["path"], reference["version"]))
        and _exists(spark, _manifest(reference["path"], reference["version"]))
    ]
    if not there:
        return verdicts
    for reference in there:
        spark.catalog.refreshByPath(_data(reference["path"], reference["version"]))
    manifests = (
        spark.read.schema(_MANIFEST_SCHEMA)
        .json([_manifest(reference["path"], reference["version"]) for reference in there])
        .select(_folder(F.col("_metadata.file_path")).alias("folder"), F.col("table_id").alias("_table"))
    )
    claimed = spark.createDataFrame([_row(reference) for reference in there], _REFERENCE_ROW).withColumn(
        "folder", _folder(F.concat("path", F.lit("/version="), "version"))
    )
    proofs = content_proofs(spark, sorted({(r["path"], r["version"], r["schema"]) for r in there}))
    proven = proofs.select("folder", F.col("digest").alias("_digest"), F.col("row_count").alias("_rows"))
    same = (
        F.col("table_id").eqNullSafe(F.col("_table"))
        & F.col("digest").eqNullSafe(F.col("_digest"))
        & F.col("row_count").eqNullSafe(F.col("_rows"))
    )
    checked = claimed.join(manifests, "folder", "left").join(proven, "folder", "left")
    for row in checked.groupBy("path").agg(F.every(same).alias("valid")).collect():
        verdicts[row["path"]] = row["valid"]
    return verdicts


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
