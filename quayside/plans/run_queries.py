"""Registered queries on whole runs: their report, what resuming one would do, and what a stored ledger has that is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.digest import row_hash
from quayside.operators import graph, ledger, restart, runs
from quayside.plans import derived
from quayside.plans.derived import table, with_tables
from quayside.plans.ledger_queries import row_hash_sql
from quayside.plans.mixed_queries import mixed_events
from quayside.session import materialize, scratch_path
from quayside.sources import ledger_table

QUERIES = {}
ORACLES = {}
NOW = "2030-01-01T00:00:00+00:00"


# --- run report --------------------------------------------------------------------------------


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of every run; every fourth is still open, and every third has a parent."""
    number = F.col("n")
    base = F.timestamp_seconds(F.lit(1_700_000_000) + number * 1000)

    def stamp(moment: Column) -> Column:
        return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))

    return (
        table(spark, sf_dir, "events")
        .select((F.col("user_id") % 20).alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("S"), number).alias("scope"),
            F.concat(F.lit("R"), number).alias("run_id"),
            F.concat(F.lit("2024-01-"), F.lpad((number + 1).cast("string"), 2, "0")).alias("business_run_key"),
            F.when(number % 3 == 0, F.concat(F.lit("R"), number, F.lit("-old"))).alias("parent_run_id"),
            F.when(number % 3 == 0, "resume").otherwise("normal").alias("restart_mode"),
            F.when(number % 6 == 0, "late data").alias("rerun_reason"),
            stamp(base).alias("started_at"),
            F.when(number % 4 != 0, stamp(base + F.expr("INTERVAL 90 SECONDS"))).alias("ended_at"),
        )
    )


def run_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside each run, the k-th node depends on its half and its third."""
    user = table(spark, sf_dir, "events").select("user_id").distinct()
    place, run = F.floor(F.col("user_id") / 20), F.col("user_id") % 20
    above = F.explode(F.array_distinct(F.array(F.floor(place / 2), F.floor(place / 3)))).alias("above")
    node = F.concat(F.lit("E"), F.col("user_id"))
    return (
        user.where(place >= 1)
        .select("user_id", above)
        .select(F.concat(F.lit("E"), F.col("above") * 20 + run).alias("src"), node.alias("dst"))
    )


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration, critical path, counts and status of every run of the ledger."""
    events = derived.decoded_events(spark, sf_dir)
    return runs.run_report(
        run_records(spark, sf_dir),
        ledger.latest(ledger.nodes_of(events)),
        ledger.node_active_time(events),
        run_edges(spark, sf_dir),
        NOW,
    )


QUERIES["run_report"] = run_report
derived.SQL["run_records"] = """
    SELECT DISTINCT 'S' || n AS scope, 'R' || n AS run_id, '2024-01-' || lpad((n + 1)::VARCHAR, 2, '0') AS business_run_key,
           CASE WHEN n % 3 = 0 THEN 'R' || n || '-old' END AS parent_run_id,
           CASE WHEN n % 3 = 0 THEN 'resume' ELSE 'normal' END AS restart_mode,
           CASE WHEN n % 6 = 0 THEN 'late data' END AS rerun_reason,
           CASE WHEN n % 4 <> 0 THEN 90.0::DOUBLE ELSE (1893456000 - 1700000000 - n * 1000)::DOUBLE END AS duration_seconds
    FROM (SELECT user_id % 20 AS n FROM events)"""
derived.SQL["run_edges"] = """
    SELECT 'E' || (above * 20 + user_id % 20) AS src, 'E' || user_id AS dst FROM (
      SELECT user_id, unnest([user_id // 20 // 2, user_id // 20 // 3]) AS above FROM (SELECT DISTINCT user_id FROM events)
      WHERE user_id // 20 >= 1) GROUP BY ALL"""
derived.SQL["worked"] = """
    SELECT n.scope, n.run_id, n.node_id, coalesce(a.us, 0)::BIGINT AS us FROM latest_nodes n LEFT JOIN (
      SELECT scope, run_id, node_id, sum(round(duration_seconds * 1000000)::BIGINT) AS us FROM ledger
      WHERE event_type = 'ATTEMPT_FINISHED' GROUP BY ALL) a USING (scope, run_id, node_id)"""
# The largest sum of work on any path that ends in a node, by length of the path.
derived.SQL["run_paths"] = """
    SELECT scope, run_id, node_id, 0 AS depth, us AS total FROM worked
    UNION ALL
    SELECT n.scope, n.run_id, n.node_id, p.depth + 1, max(p.total) + any_value(n.us)
    FROM run_paths p JOIN run_edges e ON e.src = p.node_id
    JOIN worked n ON n.node_id = e.dst AND n.scope = p.scope AND n.run_id = p.run_id
    GROUP BY n.scope, n.run_id, n.node_id, p.depth"""
derived.NEEDS |= {"worked": ["latest_nodes"], "run_paths": ["worked", "run_edges"], "latest_nodes": ["ledger"]}
_COUNTS = ", ".join(
    f"count(*) FILTER (status IN ({', '.join(repr(state) for state in states)})) AS {name}"
    for name, states in ledger.STATE_COUNTS.items()
)
ORACLES["run_report"] = with_tables(
    f""", counted AS (
         SELECT scope, run_id, count(*) AS total_nodes, {_COUNTS}, count(*) FILTER (attempt > 1) AS retried_nodes,
                bool_or(execution_uncertain) AS u,
                bool_or(critical AND status IN ('FAILED', 'TIMED_OUT', 'BLOCKED', 'CANCELLED')) AS f
         FROM latest_nodes GROUP BY scope, run_id),
       longest AS (SELECT scope, run_id, max(total) AS us FROM run_paths GROUP BY scope, run_id)
       SELECT r.*, coalesce(us, 0) / 1000000.0::DOUBLE AS critical_path_seconds, c.* EXCLUDE (scope, run_id, u, f),
              CASE WHEN u THEN 'RECOVERY_REQUIRED' WHEN f THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
              CASE WHEN u THEN 'reconcile' WHEN f THEN 'remediate_and_resume' ELSE 'dispatch_outbox' END
                  AS recommended_action
       FROM run_records r JOIN counted c USING (scope, run_id) LEFT JOIN longest USING (scope, run_id)""",
    "run_records",
    "latest_nodes",
    "run_paths",
)


# --- fingerprints carried down the graph, and the plan of a resumed run ------------------------

_DEFINITION = ["code", "node_id", "strategy", "trigger"]


def _definitions(spark: SparkSession, sf_dir: str, **codes: Column) -> DataFrame:
    """Own numbers of all nodes, one column for each code. Rows are dealt out first: hashing is most of the work, and a
    table of few files is read by few tasks."""
    nodes = derived.nodes(spark, sf_dir).select("node_id", "trigger", "strategy").repartition("node_id")
    for name, code in codes.items():
        nodes = nodes.withColumn("code", code)
        own = F.conv(F.substring(row_hash(nodes, _DEFINITION), 1, 15), 16, 10).cast("bigint")
        nodes = nodes.withColumn(name, own)
    return nodes.select("node_id", *codes)


def _old_code() -> Column:
    return F.lit("a")


def _new_code() -> Column:
    """The code of every 211th node has changed since the prior run."""
    return F.when(F.col("node_id") % 211 == 100, "b").otherwise("a")


QUERIES["carried_fingerprints"] = lambda spark, sf_dir: graph.carried_fingerprints(
    _definitions(spark, sf_dir, own=_new_code()), derived.edges(spark, sf_dir)
)
_HEX = "('0x' || substr({}, 1, 15))::UBIGINT::HUGEINT"
derived.SQL["definitions"] = """
    SELECT node_id, trigger, strategy, CASE WHEN node_id % 211 = 100 THEN 'b' ELSE 'a' END AS code FROM nodes"""
derived.SQL["factors"] = f"""
    SELECT src, dst, {_HEX.format("sha256(src || '>' || dst)")} + 1 AS factor FROM edges"""
# Every way down from every node, with the product of the factors on it.
derived.SQL["ways"] = f"""
    SELECT node_id AS origin, node_id, 1::HUGEINT AS factor, 0 AS depth FROM nodes
    UNION ALL
    SELECT w.origin, f.dst, w.factor * f.factor % {graph.PRIME}, w.depth + 1 FROM ways w JOIN factors f ON f.src = w.node_id"""
derived.NEEDS |= {"definitions": ["nodes"], "factors": ["edges"], "ways": ["nodes", "factors"]}
ORACLES["carried_fingerprints"] = with_tables(
    f""", own AS (SELECT node_id AS origin, {_HEX.format(row_hash_sql(_DEFINITION))} AS own FROM definitions)
       SELECT node_id, (sum(factor * own % {graph.PRIME}) % {graph.PRIME})::BIGINT AS fingerprint
       FROM ways JOIN own USING (origin) GROUP BY node_id""",
    "definitions",
    "ways",
)


def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run resumed after some code changed, some nodes failed, one was never recorded, and some always run."""
    key, edges = F.col("node_id"), graph.prepared_edges(derived.edges(spark, sf_dir))
    carried = graph.carried_fingerprints(
        _definitions(spark, sf_dir, now=_new_code(), before=_old_code()), edges, {"now": "now", "before": "before"}
    )
    carried, _ = materialize(carried, scratch_path(spark, "carried"))
    fixed = {
        "business_run_key": F.lit("2024-01-02"),
        "dag_id": F.lit("receiving"),
        "dag_version": F.lit("2.0"),
        "code_version": F.lit("0.3"),
        "code_fingerprint": F.lit("code-a"),
    }
    current = derived.nodes(spark, sf_dir).select("node_id").join(carried, "node_id", "left").select(
        "node_id",
        F.col("now").cast("string").alias("input_fingerprint"),
        *[value.alias(name) for name, value in fixed.items()],
        F.array(F.lit("1.9")).alias("compatible_versions"),
        (key % 409 != 9).alias("eligible"),
        F.when(key % 401 == 200, "always_run").otherwise("reuse_valid").alias("policy"),
        F.lit("merge").alias("strategy"),
        F.concat(F.lit("cp-"), "node_id").alias("checkpoint_name"),
    )
    inputs, outputs = F.col("before").cast("string"), F.sha2(F.concat(F.lit("out-"), "node_id"), 256)
    prior = carried.where(key % 503 != 250).select(
        "node_id",
        *[value.alias(name) for name, value in fixed.items()],
        F.when(key % 307 == 150, "FAILED").otherwise("SUCCEEDED").alias("status"),
        inputs.alias("input_fingerprint"),
        F.lit(False).alias("execution_uncertain"),
        restart.checkpoint_record(F.concat(F.lit("cp-"), "node_id"), inputs, outputs, F.lit("x")).alias("checkpoint"),
        outputs.alias("outputs_fingerprint"),
        (key % 601 != 300).alias("outputs_valid"),
    )
    return runs.resume_plan(current, prior, edges)


QUERIES["resume_plan"] = resume_plan
ORACLES["resume_plan"] = with_tables(
    """, failed AS (SELECT node_id FROM nodes WHERE node_id % 307 = 150 AND node_id % 503 <> 250
                    UNION SELECT dst FROM edges JOIN failed ON src = failed.node_id),
       changed AS (SELECT node_id FROM nodes WHERE node_id % 211 = 100
                   UNION SELECT dst FROM edges JOIN changed ON src = changed.node_id),
       proof AS (
         SELECT node_id, CASE WHEN node_id IN (FROM failed) THEN 'invalidated'
                WHEN node_id % 503 = 250 THEN 'no_prior_record'
                WHEN node_id IN (FROM changed) THEN 'input_fingerprint'
                WHEN node_id % 409 = 9 THEN 'not_eligible'
                WHEN node_id % 401 = 200 THEN 'policy'
                WHEN node_id % 601 = 300 THEN 'outputs_invalid' END AS cause FROM nodes),
       again AS (SELECT node_id FROM proof WHERE cause IS NOT NULL
                 UNION SELECT dst FROM edges JOIN again ON src = again.node_id)
       SELECT node_id, CASE WHEN cause IS NOT NULL THEN 'run' WHEN node_id IN (FROM again) THEN 'recheck' ELSE 'reuse' END
              AS action, cause
       FROM proof""",
    "nodes",
    "edges",
)


# --- stored ledger -----------------------------------------------------------------------------


def stored_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets that took the stored ledger over after its first commit, but for every fifth scope, which it
    does not know. The second commit goes on with two scopes of three."""
    path, seen = scratch_path(spark, "ledger"), scratch_path(spark, "seen")
    ledger_table.create(spark, path)
    raw, number = derived.unsequenced_events(spark, sf_dir), F.substring("scope", 2, 20).cast("long")
    middle = raw.agg(F.floor(F.max("event_id") / 2).alias("event_id")).first()["event_id"]
    ledger_table.append(spark, path, raw.where(F.col("event_id") <= middle), "event_id")
    marks, _ = materialize(ledger_table.positions(spark, path).where(number % 5 != 0), seen)
    ledger_table.append(spark, path, raw.where((F.col("event_id") > middle) & (number % 3 != 0)), "event_id")
    return ledger_table.read_behind(spark, path, marks)


QUERIES["stored_suffix"] = stored_suffix
ORACLES["stored_suffix"] = with_tables(
    """, middle AS (SELECT max(event_id) // 2 AS m FROM events)
       SELECT scope, sequence, entity_type, entity_id, run_id, node_id, event_type, timestamp, payload FROM ledger, middle
       WHERE (substr(scope, 2)::BIGINT % 3 <> 0 OR event_id <= m) AND (substr(scope, 2)::BIGINT % 5 = 0 OR event_id > m)""",
    "ledger",
)


def latest_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event per entity where parts of the key are NULL and every 13th event was written twice."""
    number, blank = F.col("sequence"), F.lit(None).cast("string")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(number % 13 == 0, 2).otherwise(1))).alias("_copy")
    events = mixed_events(spark, sf_dir).select("*", copies).drop("_copy")
    return ledger.latest(
        events.withColumns(
            {
                "scope": F.when(number % 7 == 0, blank).otherwise(F.col("scope")),
                "entity_id": F.when(number % 11 == 0, blank).otherwise(F.col("entity_id")),
            }
        )
    )


QUERIES["latest_with_gaps"] = latest_with_gaps
_MIXED = "sequence, run_id, node_id, event_type, status, attempt, critical, execution_uncertain"
ORACLES["latest_with_gaps"] = with_tables(
    f"""SELECT scope, entity_type, entity_id, {_MIXED} FROM (
         SELECT CASE WHEN sequence % 7 <> 0 THEN scope END AS scope, entity_type,
                CASE WHEN sequence % 11 <> 0 THEN entity_id END AS entity_id, {_MIXED} FROM mixed)
       QUALIFY row_number() OVER (PARTITION BY scope, entity_type, entity_id ORDER BY sequence DESC) = 1""",
    "mixed",
)
