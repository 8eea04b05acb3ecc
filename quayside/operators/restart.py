"""Proofs that decide what a restarted run may reuse, repeat or has to recompute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contracts import SAFE_STRATEGIES, SUCCESS_STATES
from quayside.functions.digest import SUMS, dataset_digest, row_hash, short_digest


def _combined(digest: DataFrame, key: str) -> DataFrame:
    """One order-free fingerprint over all rows of ``key`` from their digest. Sums of hashes combine on the map side, so
    a key with very many rows is never listed in one place."""
    parts = [F.col("row_count").cast("string"), *[F.col(f"sum_{i}") for i in range(SUMS)]]
    return digest.select(key, F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def parameter_fingerprints(parameters: DataFrame, sources: DataFrame) -> DataFrame:
    """Fingerprint of each node's parameters, where a parameter that names a source stands for the source's
    own fingerprint: ``parameters(node_id, path, value, source_id)``, ``sources(source_id, fingerprint)``.

    ``path`` is the position of a value inside nested parameters, so nesting needs no recursion.
    """
    resolved = parameters.join(
        sources.select("source_id", F.col("fingerprint").alias("_source")), "source_id", "left"
    ).withColumn("value", F.coalesce("_source", "value"))
    return _combined(dataset_digest(resolved.select("node_id", "path", "value"), "node_id"), "node_id")


def input_fingerprints(definitions: DataFrame, dependencies: DataFrame, columns: list[str]) -> DataFrame:
    """Fingerprint of everything that determines a node's result.

    ``columns`` of ``definitions`` are hashed as they are: application, graph, environment, code, node
    definition, parameters, storage and Spark settings, but nothing about retries or logging. Of the
    ``dependencies(node_id, dependency, status, output, digest, row_count)`` a reused success counts like a
    fresh one.
    """
    settled = F.when(F.col("status").isin(*SUCCESS_STATES), "SUCCEEDED").otherwise(F.col("status"))
    upstream = _combined(
        short_digest(
            dependencies.select("node_id", "dependency", settled.alias("status"), "output", "digest", "row_count"), "node_id"
        ),
        "node_id",
    ).withColumnRenamed("fingerprint", "_upstream")
    own = definitions.select("node_id", row_hash(definitions, columns).alias("_own"))
    return own.join(upstream, "node_id", "left").select(
        "node_id", F.sha2(F.concat_ws("|", "_own", F.coalesce("_upstream", F.lit(""))), 256).alias("fingerprint")
    )


def checkpoint_record(name: Column, inputs: Column, outputs: Column, committed_at: Column) -> Column:
    """The proof that is stored with a success."""
    return F.struct(
        name.alias("name"),
        inputs.alias("input_fingerprint"),
        outputs.alias("outputs_fingerprint"),
        committed_at.alias("committed_at"),
    )


def checkpoint_complete(records: DataFrame) -> DataFrame:
    """Is a record allowed to stand? A success needs outputs and a checkpoint over exactly these outputs."""
    proven = F.col("outputs_fingerprint").isNotNull() & F.col("checkpoint.outputs_fingerprint").eqNullSafe(
        F.col("outputs_fingerprint")
    )
    return records.select(
        "node_id",
        "status",
        proven.alias("complete"),
        ((F.col("status") != "SUCCEEDED") | proven).alias("allowed"),
    )


def outputs_complete(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """Per node: do the produced output names equal the expected ones? Both frames: node_id, output.

    Names are matched as rows, so no node's names are gathered into a list.
    """
    sides = expected.select("node_id", "output", F.lit(True).alias("_expected")).unionAll(
        produced.select("node_id", "output", F.lit(False))
    )
    names = sides.groupBy("node_id", "output").agg(
        F.bool_or("_expected").alias("_expected"), F.bool_or(~F.col("_expected")).alias("_produced")
    )
    return (
        names.groupBy("node_id")
        .agg(
            F.count_if(F.col("_expected")).alias("expected"),
            F.count_if(F.col("_expected") & ~F.col("_produced")).alias("missing"),
            F.count_if(~F.col("_expected")).alias("unexpected"),
        )
        .withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))
    )


def reuse_proof(current: DataFrame, prior: DataFrame) -> DataFrame:
    """May the prior result of each node be reused, and if not, which condition fails first?

    ``current``: node_id, invalidated, business_run_key, dag_id, dag_version, compatible_versions,
    code_version, code_fingerprint, input_fingerprint, eligible, policy, strategy, checkpoint_name.
    ``prior``: the same identity columns as recorded, status, execution_uncertain, checkpoint,
    outputs_fingerprint and outputs_valid (the verdict over the stored outputs).
    """
    was = prior.select("node_id", F.struct(*[c for c in prior.columns if c != "node_id"]).alias("was"))
    same = ["business_run_key", "dag_id", "code_version", "code_fingerprint", "input_fingerprint"]
    version_known = F.col("was.dag_version").eqNullSafe(F.col("dag_version")) | F.array_contains(
        "compatible_versions", F.col("was.dag_version")
    )
    differs = {name: ~F.col(f"was.{name}").eqNullSafe(F.col(name)) for name in same}
    causes = [
        ("invalidated", F.col("invalidated")),
        ("no_prior_record", F.col("was").isNull()),
        ("prior_not_successful", ~F.col("was.status").isin(*SUCCESS_STATES)),
        ("business_run_key", differs["business_run_key"]),
        ("dag_id", differs["dag_id"]),
        ("dag_version", ~F.coalesce(version_known, F.lit(False))),
        ("code_version", differs["code_version"]),
        ("code_fingerprint", differs["code_fingerprint"]),
        ("input_fingerprint", differs["input_fingerprint"]),
        ("not_eligible", ~F.col("eligible")),
        ("policy", F.col("policy") != "reuse_valid"),
        ("execution_uncertain", F.coalesce(F.col("was.execution_uncertain"), F.lit(False))),
        ("unsafe_strategy", ~F.col("strategy").isin(*SAFE_STRATEGIES)),
        ("no_checkpoint", F.col("was.checkpoint").isNull()),
        ("checkpoint_name", ~F.col("was.checkpoint.name").eqNullSafe(F.col("checkpoint_name"))),
        (
            "checkpoint_inputs",
            ~F.col("was.checkpoint.input_fingerprint").eqNullSafe(F.col("input_fingerprint")),
        ),
        (
            "checkpoint_outputs",
            ~F.col("was.checkpoint.outputs_fingerprint").eqNullSafe(F.col("was.outputs_fingerprint")),
        ),
        ("outputs_invalid", ~F.coalesce(F.col("was.outputs_valid"), F.lit(False))),
    ]
    # A condition that NULLs leave open counts as failed.
    cause = F.coalesce(*[F.when(F.coalesce(failed, F.lit(True)), F.lit(name)) for name, failed in causes])
    return current.join(was, "node_id", "left").select(
        "node_id", cause.isNull().alias("reuse"), cause.alias("cause")
    )


def reuse_provenance(prior: DataFrame) -> DataFrame:
    """The run that really produced each reused result, however often it was reused in between."""
    return prior.where(F.col("status").isin(*SUCCESS_STATES)).select(
        "node_id",
        F.col("run_id").alias("parent_run_id"),
        F.coalesce("reused_from_run_id", "run_id").alias("produced_by_run_id"),
    )


def invalidation_origins(prior: DataFrame, mode: str, restart_from: DataFrame | None = None) -> DataFrame:
    """Where recomputation starts: what did not succeed; a restart adds a node; a rerun takes all."""
    if mode == "force_rerun":
        return prior.select("node_id")
    origins = prior.where(~F.col("status").isin(*SUCCESS_STATES)).select("node_id")
    if mode == "force_restart" and restart_from is not None:
        origins = origins.unionAll(restart_from.select("node_id")).distinct()
    return origins


def reexecution_check(nodes: DataFrame, attempted: DataFrame, approvals: DataFrame, states: DataFrame) -> DataFrame:
    """May a node run again in a restarted run? NULL ``refusal`` means yes.

    ``nodes``: node_id, eligible, strategy, compensation_node. ``states``: node_id, status, outputs_valid.
    """
    tried = attempted.select("node_id", F.lit(True).alias("_tried")).distinct()
    approved = approvals.select("node_id", F.lit(True).alias("_approved")).distinct()
    companion = states.select(
        F.col("node_id").alias("compensation_node"),
        (F.col("status").isin(*SUCCESS_STATES) & F.col("outputs_valid")).alias("_compensated"),
    )
    # Most nodes name no companion: they don't take part in the join, where they would be one hot key.
    named = nodes.where(F.col("compensation_node").isNotNull()).join(companion, "compensation_node", "left")
    alone = nodes.where(F.col("compensation_node").isNull()).withColumn("_compensated", F.lit(False))
    joined = named.unionByName(alone).join(tried, "node_id", "left").join(approved, "node_id", "left")
    unsafe = ~F.coalesce(F.col("strategy").isin(*SAFE_STRATEGIES), F.lit(False))
    refusal = (
        F.when(F.col("_tried").isNull(), None)
        .when(~F.coalesce("eligible", F.lit(False)), "RESTART_NOT_ELIGIBLE")
        .when(unsafe & F.col("_approved").isNull(), "APPROVAL_REQUIRED")
        .when(
            (F.col("strategy") == "compensation") & ~F.coalesce(F.col("_compensated"), F.lit(False)),
            "COMPENSATION_REQUIRED",
        )
    )
    return joined.select("node_id", "strategy", refusal.alias("refusal"))


def validate_references(references: DataFrame, proofs: DataFrame, key: list[str]) -> DataFrame:
    """Compare many recorded references with freshly computed proofs; a missing artifact is simply invalid."""
    recorded = ["row_count", "sum_0", "sum_1", "sum_2", "sum_3"]
    found = proofs.select(*key, F.struct(*recorded).alias("_found"))
    return _same_key(references, found, key, "left").select(
        *[F.col(f"l.{name}") for name in key],
        F.col("_found").eqNullSafe(F.struct(*[F.col(f"l.{name}") for name in recorded])).alias("valid"),
    )


def _same_key(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """A join, as ``l`` and ``r``, in which a NULL in the key meets a NULL."""
    same = F.lit(True)
    for name in key:
        same = same & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return left.alias("l").join(right.alias("r"), same, how)


def changed_inputs(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Inputs whose proof differs between two looks: ``added``, ``removed`` or ``changed``."""
    recorded = ["row_count", "sum_0", "sum_1", "sum_2", "sum_3"]
    old = before.select(*key, F.struct(*recorded).alias("_old"))
    new = after.select(*key, F.struct(*recorded).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    either = [F.when(F.col("_old").isNull(), F.col(f"r.{n}")).otherwise(F.col(f"l.{n}")).alias(n) for n in key]
    return _same_key(old, new, key, "full").select(*either, change.alias("change")).where(F.col("change").isNotNull())
