"""Whole-run questions put together from the single ones: what a run came to, and what resuming it would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.times import seconds_between
from quayside.operators import graph, ledger, restart
from quayside.session import materialize, scratch_path

RUN = ["scope", "run_id"]


def node_of_run(node_id: Column) -> Column:
    """A node of a run as one value, so that the graphs of all runs are walked together."""
    return F.struct("scope", "run_id", node_id.alias("node_id"))


def critical_paths(nodes: DataFrame, active: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run the longest dependency path in microseconds of work, all runs in the same rounds.

    ``nodes``: scope, run_id, node_id. ``active``: the same and ``active_seconds``, the time a node really worked, over
    all its attempts; waiting and backoff don't count. ``edges`` (dst depends on src) hold for every run; one that names
    a node without a record in the run takes no part. Runs whose nodes all lie on a cycle have no path.
    """
    micros = F.round(F.coalesce("active_seconds", F.lit(0.0)) * 1_000_000)
    records = nodes.select(*RUN, "node_id").distinct()
    weighted = records.join(active, [*RUN, "node_id"], "left").select(
        node_of_run(F.col("node_id")).alias("node_id"), micros.alias("weight")
    )
    # Both ends need a record in the same run.
    below = records.join(edges.select(F.col("dst").alias("node_id"), "src"), "node_id")
    above = records.withColumnRenamed("node_id", "src")
    inside = below.join(above, [*RUN, "src"]).select(
        node_of_run(F.col("src")).alias("src"), node_of_run(F.col("node_id")).alias("dst")
    )
    paths = graph.critical_path(weighted, inside)
    return (
        paths.groupBy(F.col("node_id.scope").alias("scope"), F.col("node_id.run_id").alias("run_id"))
        .agg(F.max("path_weight").cast("bigint").alias("critical_path_us"))
    )


def run_report(runs: DataFrame, nodes: DataFrame, active: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """One row per run: what it is (parent run, restart mode and reasons), how long it took (an open run up to ``now``),
    its critical path, and counts, status and advice over the latest records of its nodes.

    ``runs``: scope, run_id, business_run_key, parent_run_id, restart_mode, rerun_reason, started_at, ended_at. A run
    without a node record counts none. The nodes that failed are ``ledger.run_failures``. Records and times of nodes are
    written first: they come from the whole ledger and are read several times.
    """
    folder = scratch_path(nodes.sparkSession, "report")
    nodes, _ = materialize(nodes, f"{folder}/nodes")
    active, _ = materialize(active, f"{folder}/active")
    described = runs.select(
        *RUN,
        "business_run_key",
        "parent_run_id",
        "restart_mode",
        "rerun_reason",
        seconds_between(F.col("started_at"), F.coalesce("ended_at", F.lit(now))).alias("duration_seconds"),
    )
    path = critical_paths(nodes, active, edges)
    summary = ledger.run_summary(nodes)
    counts = [name for name, kind in summary.dtypes if kind == "bigint"]
    joined = described.join(path, RUN, "left").join(summary, RUN, "left")
    return joined.select(
        *described.columns,
        (F.coalesce("critical_path_us", F.lit(0)) / F.lit(1_000_000.0)).alias("critical_path_seconds"),
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in counts],
        F.coalesce("status", F.lit("SUCCEEDED")).alias("status"),
        F.coalesce("recommended_action", F.lit("dispatch_outbox")).alias("recommended_action"),
    )


def resume_plan(
    current: DataFrame, prior: DataFrame, edges: DataFrame, mode: str = "resume", restart_from: DataFrame | None = None
) -> DataFrame:
    """What a run that goes on from a prior one does with each node: node_id, action and cause.

    ``current`` and ``prior`` are as ``restart.reuse_proof`` takes them, without ``invalidated`` and with ``own`` (below
    2^61, a hash of the node's definition, parameters and sources) in place of fingerprints, or with ``input_fingerprint``
    if they have been carried already; ``prior`` holds the fingerprints that were carried down its graph. A changed input
    shows in exactly the nodes below it. What did not succeed, or is to be restarted, invalidates what follows; that and
    what follows nodes that run are found by one walk, as nodes below invalid ones are invalid themselves.

    ``run``: the proof fails, for ``cause``. ``recheck``: the prior result stands, but something above runs again; it is
    reused if that yields equal outputs. ``reuse``: nothing above changes.
    """
    edges = graph.prepared_edges(edges)
    if "input_fingerprint" not in current.columns:
        carried = graph.carried_fingerprints(current.select("node_id", "own"), edges)
        carried = carried.select("node_id", F.col("fingerprint").cast("string").alias("input_fingerprint"))
        current = current.drop("own").join(carried, "node_id", "left")
    proof, _ = materialize(
        restart.reuse_proof(current.withColumn("invalidated", F.lit(False)), prior),
        scratch_path(current.sparkSession, "proof"),
    )
    nodes = proof.select("node_id")
    origins = nodes if mode == "force_rerun" else restart.invalidation_origins(prior, mode, restart_from)
    failing = proof.where(~F.col("reuse")).select("node_id")
    reached = graph.descendants_of(nodes, edges, {"invalid": origins, "again": failing})
    invalid = F.coalesce("invalid", F.lit(False))
    action = F.when(invalid | ~F.col("reuse"), "run").when(F.col("again"), "recheck").otherwise("reuse")
    cause = F.when(invalid, "invalidated").otherwise(F.col("cause"))
    return proof.join(reached, "node_id", "left").select("node_id", action.alias("action"), cause.alias("cause"))
