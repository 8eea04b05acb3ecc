"""Registered queries over a ledger that holds runs and outbox entries beside nodes, lost payloads and open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import ledger, outbox
from quayside.plans import derived
from quayside.plans.derived import table, with_tables
from quayside.session import scratch_path
from quayside.sources import ledger_table, outbox_ledger

QUERIES = {}
ORACLES = {}


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of the source is a node event; some also start, finish or reconcile their run, or commit or refresh
    an outbox entry. Every 251st node event has lost its status."""
    source = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"))
    number, residue = F.col("event_id"), F.col("user_id") % 20

    def rows(entity: str, key: str, place: int, event, status) -> DataFrame:
        return source.select(
            F.concat(F.lit("S"), residue).alias("scope"),
            (number * 4 + place).alias("sequence"),
            F.lit(entity).alias("entity_type"),
            F.concat(F.lit(key), residue if entity == "run" else F.col("user_id")).alias("entity_id"),
            F.concat(F.lit("R"), residue).alias("run_id"),
            (F.concat(F.lit("E"), F.col("user_id")) if entity == "node" else F.lit(None).cast("string")).alias("node_id"),
            event.alias("event_type"),
            status.alias("status"),
            (number % 3 + 1).alias("attempt"),
            (F.col("user_id") % 3 == 0).alias("critical"),
            (number % 101 == 0).alias("execution_uncertain"),
        ).where(F.col("event_type").isNotNull())

    kind = F.col("kind")
    node_event = (
        F.when(kind == "signup", "NODE_CREATED")
        .when(kind == "view", "NODE_READY")
        .when(kind == "click", "ATTEMPT_CLAIMED")
        .otherwise("ATTEMPT_FINISHED")
    )
    node_status = (
        F.when(number % 251 == 0, F.lit(None).cast("string"))
        .when(kind == "signup", "PENDING")
        .when(kind == "view", "READY")
        .when(kind == "click", "RUNNING")
        .when(kind == "purchase", "SUCCEEDED")
        .otherwise("FAILED")
    )
    run_event = (
        F.when(kind == "signup", "RUN_STARTED")
        .when((kind == "error") & (number % 3 == 0), "RUN_FINISHED")
        .when((kind == "purchase") & (number % 5 == 0), "RUN_RECONCILED")
    )
    run_status = F.when(kind == "signup", "RUNNING").otherwise("FAILED")
    entry = F.when(number % 4 == 0, "OUTBOX_COMMITTED").when(number % 4 == 1, "OUTBOX_REFERENCE_REFRESHED")
    return (
        rows("node", "E", 0, node_event, node_status)
        .unionAll(rows("run", "R", 1, run_event, run_status))
        .unionAll(rows("outbox", "O", 2, F.when(kind == "view", entry), F.lit(outbox.PENDING)))
    )


derived.SQL["mixed"] = f"""
    SELECT 'S' || user_id % 20 AS scope, event_id * 4 AS sequence, 'node' AS entity_type, 'E' || user_id AS entity_id,
           'R' || user_id % 20 AS run_id, 'E' || user_id AS node_id,
           CASE event_type WHEN 'signup' THEN 'NODE_CREATED' WHEN 'view' THEN 'NODE_READY' WHEN 'click'
                THEN 'ATTEMPT_CLAIMED' ELSE 'ATTEMPT_FINISHED' END AS event_type,
           CASE WHEN event_id % 251 = 0 THEN NULL WHEN event_type = 'signup' THEN 'PENDING' WHEN event_type = 'view'
                THEN 'READY' WHEN event_type = 'click' THEN 'RUNNING' WHEN event_type = 'purchase' THEN 'SUCCEEDED'
                ELSE 'FAILED' END AS status,
           event_id % 3 + 1 AS attempt, user_id % 3 = 0 AS critical, event_id % 101 = 0 AS execution_uncertain
    FROM events
    UNION ALL
    SELECT 'S' || user_id % 20, event_id * 4 + 1, 'run', 'R' || user_id % 20, 'R' || user_id % 20, NULL,
           CASE event_type WHEN 'signup' THEN 'RUN_STARTED' WHEN 'error' THEN 'RUN_FINISHED' ELSE 'RUN_RECONCILED' END,
           CASE event_type WHEN 'signup' THEN 'RUNNING' ELSE 'FAILED' END,
           event_id % 3 + 1, user_id % 3 = 0, event_id % 101 = 0
    FROM events WHERE event_type = 'signup' OR (event_type = 'error' AND event_id % 3 = 0)
                      OR (event_type = 'purchase' AND event_id % 5 = 0)
    UNION ALL
    SELECT 'S' || user_id % 20, event_id * 4 + 2, 'outbox', 'O' || user_id, 'R' || user_id % 20, NULL,
           CASE event_id % 4 WHEN 0 THEN 'OUTBOX_COMMITTED' ELSE 'OUTBOX_REFERENCE_REFRESHED' END, '{outbox.PENDING}',
           event_id % 3 + 1, user_id % 3 = 0, event_id % 101 = 0
    FROM events WHERE event_type = 'view' AND event_id % 4 IN (0, 1)"""
derived.SQL["mixed_latest"] = """
    SELECT * FROM mixed WHERE entity_type = 'node'
    QUALIFY row_number() OVER (PARTITION BY scope, entity_id ORDER BY sequence DESC) = 1"""
derived.NEEDS["mixed_latest"] = ["mixed"]

QUERIES["mixed_illegal_transitions"] = lambda spark, sf_dir: ledger.illegal_transitions(mixed_events(spark, sf_dir))
_MOVES = ", ".join(f"'{move}'" for move in ledger.LEGAL_MOVES)
ORACLES["mixed_illegal_transitions"] = with_tables(
    f"""SELECT scope, entity_type, entity_id, sequence, event_type, was AS previous_status, status FROM (
         SELECT *, lag(status) OVER w AS was, row_number() OVER w = 1 AS first FROM mixed
         WINDOW w AS (PARTITION BY scope, entity_type, entity_id ORDER BY sequence))
       WHERE NOT coalesce(CASE
         WHEN entity_type = 'node' AND was IS NULL THEN event_type = 'NODE_CREATED' AND status = 'PENDING'
         WHEN entity_type = 'node' THEN was || '>' || status IN ({_MOVES})
         WHEN event_type = 'RUN_STARTED' THEN first AND status = 'RUNNING'
         WHEN event_type = 'RUN_FINISHED' THEN was = 'RUNNING' AND status IN ('SUCCEEDED', 'FAILED', 'RECOVERY_REQUIRED')
         WHEN event_type = 'RUN_RECONCILED' THEN was IN ('RUNNING', 'RECOVERY_REQUIRED') AND status = 'FAILED'
         WHEN event_type = 'OUTBOX_COMMITTED' THEN first
         ELSE NOT first END, false)""",
    "mixed",
)

QUERIES["mixed_run_timeline"] = lambda spark, sf_dir: ledger.run_timeline(mixed_events(spark, sf_dir))
ORACLES["mixed_run_timeline"] = with_tables(
    """, moved AS (SELECT *, lag(status) OVER (PARTITION BY scope, run_id, node_id ORDER BY sequence) AS was
                   FROM mixed WHERE entity_type = 'node')
       SELECT scope, run_id, sequence, node_id, status,
              sum((coalesce(status, '') = 'RUNNING')::BIGINT - (coalesce(was, '') = 'RUNNING')::BIGINT)
                  OVER (PARTITION BY scope, run_id ORDER BY sequence)::BIGINT AS running_nodes,
              last_value(CASE WHEN status IN ('SUCCEEDED', 'FAILED') THEN node_id END IGNORE NULLS)
                  OVER (PARTITION BY scope, run_id ORDER BY sequence) AS last_finished
       FROM moved""",
    "mixed",
)


def _mixed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(ledger.nodes_of(mixed_events(spark, sf_dir)))


QUERIES["mixed_run_summary"] = lambda spark, sf_dir: ledger.run_summary(_mixed_latest(spark, sf_dir))
_COUNTS = ", ".join(
    f"count(*) FILTER (status IN ({', '.join(repr(state) for state in states)})) AS {name}"
    for name, states in ledger.STATE_COUNTS.items()
)
ORACLES["mixed_run_summary"] = with_tables(
    f"""SELECT * EXCLUDE (u, f), CASE WHEN u THEN 'RECOVERY_REQUIRED' WHEN f THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
              CASE WHEN u THEN 'reconcile' WHEN f THEN 'remediate_and_resume' ELSE 'dispatch_outbox' END
                  AS recommended_action
       FROM (SELECT scope, run_id, count(*) AS total_nodes, {_COUNTS},
                    count(*) FILTER (attempt > 1) AS retried_nodes, bool_or(execution_uncertain) AS u,
                    bool_or(critical AND status IN ('FAILED', 'TIMED_OUT', 'BLOCKED', 'CANCELLED')) AS f
             FROM mixed_latest GROUP BY scope, run_id)""",
    "mixed_latest",
)


def open_intervals_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak concurrency where every seventh attempt is still running."""
    attempts = derived.attempts(spark, sf_dir)
    running = attempts.withColumn("ended_us", F.when(F.col("sequence") % 7 != 0, F.col("ended_us")))
    return ledger.peak_usage(running, ["scope"])


QUERIES["open_intervals_peak"] = open_intervals_peak
ORACLES["open_intervals_peak"] = with_tables(
    """, spans AS (SELECT scope, started_us, CASE WHEN sequence % 7 <> 0 THEN ended_us END AS ended_us FROM attempts),
       edges AS (SELECT scope, started_us AS at_us, 1 AS change FROM spans
                 WHERE ended_us IS NULL OR started_us < ended_us
                 UNION ALL SELECT scope, ended_us, -1 FROM spans WHERE started_us < ended_us),
       used AS (SELECT scope, at_us, sum(sum(change)) OVER (PARTITION BY scope ORDER BY at_us) AS in_use
                FROM edges GROUP BY scope, at_us)
       SELECT scope, in_use::BIGINT AS peak, at_us AS first_peak_us FROM used
       QUALIFY row_number() OVER (PARTITION BY scope ORDER BY in_use DESC, at_us) = 1""",
    "attempts",
)


def outbox_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox events per scope after three commits to a stored ledger: one intent per order, the same batch once more,
    and a batch in which every third order points to another output."""
    path = scratch_path(spark, "outbox-ledger")
    ledger_table.create(spark, path)
    orders = table(spark, sf_dir, "orders")
    intents = orders.select(
        F.concat(F.lit("S"), F.col("o_custkey") % 20).alias("scope"),
        F.concat(F.lit("N"), F.col("o_orderkey")).alias("node_id"),
        F.lit("request_receipts").alias("operation"),
        F.sha2(F.col("o_orderstatus"), 256).alias("payload_digest"),
        F.col("o_orderkey").cast("string").alias("output_reference"),
        F.col("o_orderkey").alias("arrival"),
    )
    moved = F.when(F.col("arrival") % 3 == 0, "moved").otherwise(F.col("output_reference"))
    for batch in (intents, intents, intents.withColumn("output_reference", moved)):
        outbox_ledger.commit(spark, path, batch, "arrival")
    return (
        ledger_table.read(spark, path)
        .groupBy("scope")
        .agg(
            F.count_if(F.col("event_type") == "OUTBOX_COMMITTED").alias("committed"),
            F.count_if(F.col("event_type") == "OUTBOX_REFERENCE_REFRESHED").alias("refreshed"),
            F.max("sequence").alias("last_sequence"),
        )
    )


QUERIES["outbox_commit"] = outbox_commit
ORACLES["outbox_commit"] = """
    SELECT 'S' || o_custkey % 20 AS scope, count(*) AS committed, count(*) FILTER (o_orderkey % 3 = 0) AS refreshed,
           count(*) + count(*) FILTER (o_orderkey % 3 = 0) AS last_sequence
    FROM orders GROUP BY 1"""
