"""Registered queries over the derived dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import graph, restart
from quayside.plans import derived
from quayside.plans.derived import with_tables

QUERIES = {}
ORACLES = {}


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.nodes(spark, sf_dir).where(F.col("node_id") % 50 == 7).select("node_id")


QUERIES["descendants"] = lambda spark, sf_dir: graph.descendants(
    derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir), _origins(spark, sf_dir)
)
ORACLES["descendants"] = with_tables("SELECT node_id FROM reach", "reach")



def invalidated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a forced restart from node 6 has to recompute: it, all that did not succeed, and what follows."""
    nodes = derived.nodes(spark, sf_dir)
    origins = restart.invalidation_origins(nodes, "force_restart", nodes.where(F.col("node_id") == 6))
    return graph.descendants(nodes, derived.edges(spark, sf_dir), origins)


QUERIES["invalidated_nodes"] = invalidated_nodes
ORACLES["invalidated_nodes"] = with_tables(
    """, invalid AS (SELECT node_id FROM nodes
                     WHERE node_id = 6 OR status NOT IN ('SUCCEEDED', 'SKIPPED_ALREADY_SATISFIED')
                     UNION SELECT dst FROM edges JOIN invalid ON src = invalid.node_id)
       SELECT node_id FROM invalid""",
    "nodes",
    "edges",
)

QUERIES["unreachable_nodes"] = lambda spark, sf_dir: graph.unreachable(
    derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir), _origins(spark, sf_dir)
)
ORACLES["unreachable_nodes"] = with_tables(
    "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM reach)", "reach"
)

QUERIES["topo_waves"] = lambda spark, sf_dir: graph.topological_waves(
    derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir)
)
ORACLES["topo_waves"] = with_tables("SELECT node_id, wave FROM waves", "waves")

QUERIES["critical_path"] = lambda spark, sf_dir: graph.critical_path(
    derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir)
)
ORACLES["critical_path"] = with_tables(
    "SELECT node_id, max(total) AS path_weight FROM levels GROUP BY node_id", "levels"
)

QUERIES["cyclic_nodes"] = lambda spark, sf_dir: graph.cyclic_nodes(
    derived.nodes(spark, sf_dir), derived.looped_edges(spark, sf_dir)
)
# Each edge leads back one step only, so its two ends are on a cycle and everything below them never starts.
ORACLES["cyclic_nodes"] = with_tables(
    """, stuck AS (SELECT p_partkey AS node_id FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 0
                   UNION SELECT p_partkey // 2 FROM part WHERE p_partkey % 97 = 0 AND p_partkey > 0
                   UNION SELECT dst FROM looped JOIN stuck ON src = stuck.node_id)
       SELECT node_id FROM stuck""",
    "looped",
)


def entry_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived.nodes(spark, sf_dir)
    kept = derived.edges(spark, sf_dir).where(F.col("dst") % 5 != 0)
    return graph.entry_mismatch(nodes, kept, nodes.where(F.col("node_id") % 3 == 0))


QUERIES["entry_mismatch"] = entry_mismatch
ORACLES["entry_mismatch"] = with_tables(
    """, roots AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges WHERE dst % 5 <> 0)),
       entries AS (SELECT node_id FROM nodes WHERE node_id % 3 = 0)
       SELECT node_id, 'undeclared_root' AS problem FROM (FROM roots EXCEPT ALL FROM entries)
       UNION ALL SELECT node_id, 'entry_is_no_root' FROM (FROM entries EXCEPT ALL FROM roots)""",
    "nodes",
    "edges",
)


def undefined_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies on nodes that were left out, and line SKUs the catalog does not define."""
    edges, nodes = derived.edges(spark, sf_dir), derived.nodes(spark, sf_dir)
    references = edges.select(
        F.col("dst").cast("string").alias("owner"),
        F.lit("node").alias("kind"),
        F.col("src").cast("string").alias("name"),
    ).unionAll(
        derived.lines(spark, sf_dir).select(
            F.concat_ws("/", "shipment_id", "line_id"), F.lit("sku"), F.col("sku")
        )
    )
    defined = nodes.where(F.col("node_id") % 31 != 0).select(
        F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("name")
    ).unionAll(derived.catalog(spark, sf_dir).select(F.lit("sku"), "sku"))
    return graph.undefined_references(references, defined)


QUERIES["undefined_dependencies"] = undefined_dependencies
ORACLES["undefined_dependencies"] = with_tables(
    """SELECT dst::VARCHAR AS owner, 'node' AS kind, src::VARCHAR AS name FROM edges
       WHERE src NOT IN (SELECT node_id FROM nodes WHERE node_id % 31 <> 0)
       UNION ALL SELECT shipment_id || '/' || line_id, 'sku', sku FROM lines
       WHERE sku NOT IN (SELECT sku FROM catalog)""",
    "nodes",
    "edges",
    "lines",
    "catalog",
)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line keys, and repeated checkpoint names (part names)."""
    lines = derived.lines(spark, sf_dir).select(
        F.lit("line").alias("kind"), F.concat_ws("/", "shipment_id", "line_id").alias("key")
    )
    names = derived.catalog(spark, sf_dir).select(F.lit("name"), "description")
    return graph.duplicate_keys(lines.unionAll(names))


QUERIES["duplicate_keys"] = duplicate_keys
ORACLES["duplicate_keys"] = with_tables(
    """SELECT kind, key, count(*) AS copies FROM (
         SELECT 'line' AS kind, shipment_id || '/' || line_id AS key FROM lines
         UNION ALL SELECT 'name', description FROM catalog) GROUP BY ALL HAVING count(*) > 1""",
    "lines",
    "catalog",
)


def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed records of the nodes; one in 37 has none."""
    key = F.col("node_id")
    return derived.nodes(spark, sf_dir).where(key % 37 != 0).select(
        "node_id",
        "status",
        F.sha2(F.concat(F.lit("out-"), key), 256).alias("digest"),
        (key * 3).alias("row_count"),
    )


QUERIES["dependency_records"] = lambda spark, sf_dir: graph.dependency_records(
    derived.edges(spark, sf_dir), node_records(spark, sf_dir)
)
derived.SQL["records"] = """
    SELECT node_id, status, sha256('out-' || node_id) AS digest, node_id * 3 AS row_count FROM nodes
    WHERE node_id % 37 <> 0"""
derived.NEEDS["records"] = ["nodes"]
ORACLES["dependency_records"] = with_tables(
    """SELECT dst AS node_id, src AS dependency, status, digest, row_count, status IS NOT NULL AS known
       FROM edges LEFT JOIN records ON src = records.node_id""",
    "edges",
    "records",
)

QUERIES["trigger_rollup"] = lambda spark, sf_dir: graph.trigger_rollup(
    derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir)
)
ORACLES["trigger_rollup"] = with_tables(
    """, counted AS (
         SELECT n.node_id, n.trigger, n.condition_value, n.condition_expected, count(e.src) AS dependencies,
                count(*) FILTER (u.status IN ('SUCCEEDED', 'SKIPPED_ALREADY_SATISFIED')) AS succeeded,
                count(*) FILTER (u.status IN ('FAILED', 'TIMED_OUT', 'BLOCKED')) AS failed,
                count(*) FILTER (u.status = 'TIMED_OUT') AS timed_out,
                count(*) FILTER (u.status IN ('FAILED', 'TIMED_OUT', 'BLOCKED', 'CANCELLED')) AS bad
         FROM nodes n LEFT JOIN edges e ON e.dst = n.node_id LEFT JOIN nodes u ON u.node_id = e.src
         GROUP BY ALL)
       SELECT node_id, trigger, dependencies, succeeded, failed, timed_out, bad,
              CASE WHEN NOT CASE trigger WHEN 'all_success' THEN succeeded = dependencies
                                         WHEN 'any_success' THEN succeeded > 0 WHEN 'all_done' THEN true
                                         WHEN 'any_failed' THEN failed > 0 ELSE timed_out > 0 END
                        THEN CASE WHEN trigger IN ('all_success', 'any_success') AND bad > 0 THEN 'BLOCKED'
                                  ELSE 'SKIPPED_CONDITION' END
                   WHEN condition_expected IS NOT NULL AND condition_value IS DISTINCT FROM condition_expected
                        THEN 'SKIPPED_CONDITION' ELSE 'RUN' END AS decision
       FROM counted""",
    "nodes",
    "edges",
)


def lineage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = derived.nodes(spark, sf_dir), derived.edges(spark, sf_dir)
    policies = nodes.select("node_id", "trigger", "critical", "concurrency_group", "strategy")
    return graph.lineage_manifest(policies, edges, graph.topological_waves(nodes, edges))


QUERIES["lineage_manifest"] = lineage_manifest
ORACLES["lineage_manifest"] = with_tables(
    """SELECT n.node_id, trigger, critical, concurrency_group, strategy, wave, e.src AS dependency
       FROM nodes n LEFT JOIN waves w ON n.node_id = w.node_id LEFT JOIN edges e ON e.dst = n.node_id""",
    "nodes",
    "edges",
    "waves",
)
