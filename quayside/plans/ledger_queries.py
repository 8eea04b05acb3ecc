"""Registered queries over the derived event ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.text import backoff_seconds
from quayside.functions.times import seconds_between
from quayside.operators import failures, ledger, ordered
from quayside.plans import derived
from quayside.plans.derived import with_tables

QUERIES = {}
ORACLES = {}

_EVENT = "scope, sequence, entity_type, entity_id, run_id, node_id, event_type, timestamp, payload"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.events(spark, sf_dir).drop("event_id")


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after some events were lost and others were written twice."""
    events = derived.events(spark, sf_dir)
    kept = events.where(F.col("event_id") % 500 != 0)
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("event_id") % 1777 == 0, 2).otherwise(1)))
    return kept.select("*", twice.alias("_copy")).drop("_copy", "event_id")


def latest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.latest(ledger.nodes_of(derived.decoded_events(spark, sf_dir)))


def ledger_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return ledger.suffix(events, derived.watermarks(events))


QUERIES["ledger_suffix"] = ledger_suffix
ORACLES["ledger_suffix"] = with_tables(
    f"SELECT {_EVENT} FROM ledger LEFT JOIN marks USING (scope) WHERE sequence > coalesce(seen, 0)",
    "ledger",
    "marks",
)


def ledger_assign_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number a batch (every event of an odd user) behind what each scope has committed (the even ones)."""
    raw = derived.unsequenced_events(spark, sf_dir).drop("payload", "timestamp")
    odd = F.substring("entity_id", 2, 20).cast("long") % 40 >= 20
    committed = derived.events(spark, sf_dir).where(~odd).groupBy("scope").agg(
        F.count(F.lit(1)).alias("sequence")
    )
    return ledger.assign_sequence(committed, raw.where(odd), F.col("event_id")).select(
        "scope", "sequence", "event_id", "entity_id", "event_type"
    )


QUERIES["ledger_assign_sequence"] = ledger_assign_sequence
ORACLES["ledger_assign_sequence"] = with_tables(
    """SELECT r.scope, coalesce(c.newest, 0) + row_number() OVER (PARTITION BY r.scope ORDER BY event_id)
                  AS sequence, event_id, entity_id, event_type
       FROM raw_events r LEFT JOIN (SELECT scope, count(*) AS newest FROM raw_events
                                    WHERE substr(entity_id, 2)::BIGINT % 40 < 20 GROUP BY scope) c
            ON r.scope = c.scope
       WHERE substr(entity_id, 2)::BIGINT % 40 >= 20""",
    "raw_events",
)

QUERIES["ledger_integrity"] = lambda spark, sf_dir: ledger.integrity(_holed(spark, sf_dir))
_HOLED = """holed AS (SELECT scope, sequence FROM ledger WHERE event_id % 500 <> 0
            UNION ALL SELECT scope, sequence FROM ledger WHERE event_id % 500 <> 0 AND event_id % 1777 = 0)"""
ORACLES["ledger_integrity"] = with_tables(
    f""", {_HOLED}
       SELECT *, repeated = 0 AND invalid = 0 AND missing = 0 AS intact FROM (
         SELECT scope, count(*) AS events, count(*) - count(DISTINCT sequence) AS repeated,
                count(*) FILTER (sequence < 1) AS invalid, max(sequence) - count(DISTINCT sequence) AS missing,
                max(sequence) AS last_sequence FROM holed GROUP BY scope)""",
    "ledger",
)

QUERIES["ledger_gaps"] = lambda spark, sf_dir: ledger.sequence_gaps(_holed(spark, sf_dir))
ORACLES["ledger_gaps"] = with_tables(
    f""", {_HOLED}
       SELECT scope, before + 1 AS first_missing, sequence - 1 AS last_missing FROM (
         SELECT scope, sequence, coalesce(lag(sequence) OVER (PARTITION BY scope ORDER BY sequence), 0) AS before
         FROM (SELECT DISTINCT * FROM holed)) WHERE sequence > before + 1""",
    "ledger",
)


def ledger_prefix_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return ledger.prefix_proof(events, derived.watermarks(events))


def row_hash_sql(columns: list[str], named: bool = False) -> str:
    """Oracle text of a row's hash (LONG, STRING and BOOLEAN only)."""
    texts = [f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')" for name in sorted(columns)]
    if named:
        texts = [f"'{len(name)}:{name}=' || {text}" for name, text in zip(sorted(columns), texts)]
    return f"sha256(concat_ws(',', {', '.join(texts)}))"


def digest_sql(columns: list[str], source: str, group: str = "") -> str:
    """Oracle text of the order-free digest over ``columns``."""
    return _sums_sql(row_hash_sql(columns, named=True), 16, source, group)


def short_digest_sql(columns: list[str], source: str, group: str = "") -> str:
    """Oracle text of the short one."""
    return _sums_sql(row_hash_sql(columns), 8, source, group)


def _sums_sql(row_hash: str, digits: int, source: str, group: str) -> str:
    head = f"{group}, " if group else ""
    sums = ", ".join(
        f"coalesce(sum(('0x' || substr(h, {i * digits + 1}, {digits}))::UBIGINT::HUGEINT), 0)::VARCHAR AS sum_{i}"
        for i in range(4)
    )
    tail = f" GROUP BY {group}" if group else ""
    return f"SELECT {head}count(*) AS row_count, {sums} FROM (SELECT {head}{row_hash} AS h FROM {source}){tail}"


QUERIES["ledger_prefix_proof"] = ledger_prefix_proof
ORACLES["ledger_prefix_proof"] = with_tables(
    digest_sql(
        [c for c in _EVENT.split(", ") if c != "scope"],
        "(SELECT * FROM ledger JOIN marks USING (scope) WHERE sequence <= seen)",
        "scope",
    ),
    "ledger",
    "marks",
)


def ledger_changed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes in which a committed event was altered after it was first read."""
    events = derived.events(spark, sf_dir)
    marks = derived.watermarks(events)
    altered = F.when(F.col("event_id") % 997 == 0, F.lit("ALTERED")).otherwise(F.col("event_type"))
    later = events.withColumn("event_type", altered)
    return ledger.changed_history(
        ledger.prefix_proof(events.drop("event_id"), marks), ledger.prefix_proof(later.drop("event_id"), marks)
    )


QUERIES["ledger_changed_history"] = ledger_changed_history
ORACLES["ledger_changed_history"] = with_tables(
    "SELECT DISTINCT scope FROM ledger JOIN marks USING (scope) WHERE sequence <= seen AND event_id % 997 = 0",
    "ledger",
    "marks",
)

_NODE = (
    "scope, entity_type, entity_id, sequence, run_id, node_id, event_type, timestamp, status, attempt, "
    "duration_seconds, critical, execution_uncertain, ended_us, deadline_us, error_category, error_code, "
    "error_retryable AS retryable"
)
QUERIES["ledger_latest"] = latest_nodes
ORACLES["ledger_latest"] = with_tables(f"SELECT {_NODE} FROM latest_nodes", "latest_nodes")

QUERIES["ledger_public_events"] = lambda spark, sf_dir: ledger.public_events(_events(spark, sf_dir)).select(
    "scope",
    "sequence",
    "run_id",
    "node_id",
    "event_type",
    "timestamp",
    "status",
    "attempt",
    "duration_seconds",
    "retry_count",
    "restart_mode",
    "execution_uncertain",
    "business_run_key",
    "error_category",
    "error_code",
)
ORACLES["ledger_public_events"] = with_tables(
    """SELECT scope, sequence, run_id, node_id, event_type, timestamp, status, attempt, duration_seconds,
              attempt - 1 AS retry_count, 'normal' AS restart_mode, execution_uncertain, business_run_key,
              error_category, error_code
       FROM ledger WHERE event_type <> 'NODE_CREATED'""",
    "ledger",
)


def redact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the ledger; every third has an unknown category and some codes are no identifiers."""
    failed = derived.decoded_events(spark, sf_dir).where(F.col("error_category").isNotNull())
    errors = failed.select(
        "scope",
        "sequence",
        F.when(F.col("sequence") % 3 != 0, F.col("error_category")).alias("category"),
        F.when(F.col("sequence") % 7 == 0, F.concat(F.col("error_code"), F.lit(" for row 7")))
        .otherwise(F.col("error_code"))
        .alias("code"),
        F.lit("raw text with row content").alias("message"),
        "retryable",
    )
    return failures.redact_errors(errors)


QUERIES["redact_errors"] = redact_errors
ORACLES["redact_errors"] = with_tables(
    """SELECT scope, sequence,
              CASE WHEN sequence % 3 <> 0 THEN error_category ELSE 'INFRASTRUCTURE' END AS category,
              CASE WHEN sequence % 3 = 0 THEN 'UNEXPECTED_ERROR' WHEN sequence % 7 = 0 THEN 'APPLICATION_ERROR'
                   ELSE error_code END AS code,
              CASE WHEN sequence % 3 <> 0
                   THEN CASE WHEN sequence % 7 = 0 THEN 'APPLICATION_ERROR' ELSE error_code END || ' (' || error_category || ')'
                   ELSE 'UNEXPECTED_ERROR (INFRASTRUCTURE)' END AS message,
              sequence % 3 <> 0 AND error_retryable AS retryable
       FROM ledger WHERE error_category IS NOT NULL""",
    "ledger",
)

QUERIES["late_success"] = lambda spark, sf_dir: ledger.late_success(derived.decoded_events(spark, sf_dir)).select(
    "scope", "sequence", "node_id", "status", "retryable", "error_category", "error_code"
)
ORACLES["late_success"] = with_tables(
    """SELECT scope, sequence, node_id, CASE WHEN late THEN 'TIMED_OUT' ELSE status END AS status,
              late OR coalesce(error_retryable, false) AS retryable,
              CASE WHEN late THEN 'TIMEOUT' ELSE error_category END AS error_category,
              CASE WHEN late THEN 'DEADLINE_EXCEEDED' ELSE error_code END AS error_code
       FROM (SELECT *, status = 'SUCCEEDED' AND ended_us > deadline_us AS late FROM ledger
             WHERE event_type = 'ATTEMPT_FINISHED')""",
    "ledger",
)

QUERIES["node_active_time"] = lambda spark, sf_dir: ledger.node_active_time(derived.decoded_events(spark, sf_dir))
ORACLES["node_active_time"] = with_tables(
    """SELECT scope, run_id, node_id, (sum(round(duration_seconds * 1000000)::BIGINT) / 1000000)::DOUBLE
                  AS active_seconds, count(*) AS attempts
       FROM ledger WHERE event_type = 'ATTEMPT_FINISHED' GROUP BY ALL""",
    "ledger",
)

QUERIES["run_summary"] = lambda spark, sf_dir: ledger.run_summary(latest_nodes(spark, sf_dir))
_COUNTS = ", ".join(
    f"count(*) FILTER (status IN ({', '.join(repr(state) for state in states)})) AS {name}"
    for name, states in ledger.STATE_COUNTS.items()
)
ORACLES["run_summary"] = with_tables(
    f"""SELECT * EXCLUDE (u, f), CASE WHEN u THEN 'RECOVERY_REQUIRED' WHEN f THEN 'FAILED' ELSE 'SUCCEEDED' END
                   AS status,
               CASE WHEN u THEN 'reconcile' WHEN f THEN 'remediate_and_resume' ELSE 'dispatch_outbox' END
                   AS recommended_action
        FROM (SELECT scope, run_id, count(*) AS total_nodes, {_COUNTS},
                     count(*) FILTER (attempt > 1) AS retried_nodes, bool_or(execution_uncertain) AS u,
                     bool_or(critical AND status IN ('FAILED', 'TIMED_OUT', 'BLOCKED', 'CANCELLED')) AS f
              FROM latest_nodes GROUP BY scope, run_id)""",
    "latest_nodes",
)

QUERIES["run_failures"] = lambda spark, sf_dir: ledger.run_failures(latest_nodes(spark, sf_dir))
ORACLES["run_failures"] = with_tables(
    """SELECT scope, run_id, node_id, status, error_category, error_code FROM latest_nodes
       WHERE status IN ('FAILED', 'TIMED_OUT', 'BLOCKED', 'CANCELLED')""",
    "latest_nodes",
)

QUERIES["open_runs"] = lambda spark, sf_dir: ledger.open_runs(
    latest_nodes(spark, sf_dir), derived.ledger_runs(spark, sf_dir)
)
ORACLES["open_runs"] = with_tables(
    """SELECT *, run_status IN ('RUNNING', 'RECOVERY_REQUIRED') AS open,
              run_status NOT IN ('RUNNING', 'RECOVERY_REQUIRED') AND unfinished_nodes > 0 AS closed_unfinished
       FROM (SELECT r.scope, r.run_id, r.status AS run_status,
                    count(*) FILTER (n.status IN ('PENDING', 'READY', 'RUNNING')) AS unfinished_nodes,
                    count(*) FILTER (n.status IN ('PENDING', 'READY', 'RUNNING') OR n.execution_uncertain)
                        AS to_reconcile
             FROM ledger_runs r LEFT JOIN latest_nodes n ON r.scope = n.scope AND r.run_id = n.run_id
             GROUP BY ALL)""",
    "ledger_runs",
    "latest_nodes",
)

QUERIES["illegal_transitions"] = lambda spark, sf_dir: ledger.illegal_transitions(
    derived.decoded_events(spark, sf_dir)
)
ORACLES["illegal_transitions"] = with_tables(
    """SELECT scope, entity_type, entity_id, sequence, event_type, previous_status, status FROM (
         SELECT *, lag(status) OVER (PARTITION BY scope, entity_type, entity_id ORDER BY sequence)
                       AS previous_status FROM ledger)
       WHERE CASE WHEN previous_status IS NULL THEN status <> 'PENDING'
                  ELSE previous_status || '>' || status NOT IN ('PENDING>READY', 'FAILED>READY', 'READY>RUNNING',
                       'RUNNING>SUCCEEDED', 'RUNNING>FAILED', 'READY>FAILED') END""",
    "ledger",
)

QUERIES["state_timeline"] = lambda spark, sf_dir: ledger.state_timeline(derived.decoded_events(spark, sf_dir))
ORACLES["state_timeline"] = with_tables(
    """SELECT scope, run_id, node_id, sequence,
              lead(sequence) OVER (PARTITION BY scope, run_id, node_id ORDER BY sequence) AS until_sequence,
              status, attempt FROM ledger""",
    "ledger",
)

QUERIES["run_timeline"] = lambda spark, sf_dir: ledger.run_timeline(derived.decoded_events(spark, sf_dir))
ORACLES["run_timeline"] = with_tables(
    """, moved AS (SELECT *, lag(status) OVER (PARTITION BY scope, run_id, node_id ORDER BY sequence) AS was
                   FROM ledger)
       SELECT scope, run_id, sequence, node_id, status,
              sum((status = 'RUNNING')::BIGINT - coalesce((was = 'RUNNING')::BIGINT, 0))
                  OVER (PARTITION BY scope, run_id ORDER BY sequence)::BIGINT AS running_nodes,
              last_value(CASE WHEN status IN ('SUCCEEDED', 'FAILED') THEN node_id END IGNORE NULLS)
                  OVER (PARTITION BY scope, run_id ORDER BY sequence) AS last_finished
       FROM moved""",
    "ledger",
)

QUERIES["latest_run"] = lambda spark, sf_dir: ledger.latest_run(derived.runs(spark, sf_dir))
ORACLES["latest_run"] = with_tables(
    """SELECT scope, run_id, status, attempt, attempt + 1 AS next_attempt FROM runs
       QUALIFY row_number() OVER (PARTITION BY scope ORDER BY attempt DESC) = 1""",
    "runs",
)

QUERIES["overlapping_attempts"] = lambda spark, sf_dir: ledger.overlapping_attempts(
    derived.attempts(spark, sf_dir)
)
ORACLES["overlapping_attempts"] = with_tables(
    """SELECT scope, node_id, sequence, started_us, previous_ended_us FROM (
         SELECT *, lag(ended_us) OVER (PARTITION BY scope, node_id ORDER BY sequence) AS previous_ended_us
         FROM attempts) WHERE started_us < previous_ended_us""",
    "attempts",
)

QUERIES["peak_concurrency"] = lambda spark, sf_dir: ledger.peak_usage(derived.attempts(spark, sf_dir), ["scope"])
ORACLES["peak_concurrency"] = with_tables(
    """, edges AS (SELECT scope, started_us AS at_us, 1 AS change FROM attempts WHERE started_us < ended_us
                   UNION ALL SELECT scope, ended_us, -1 FROM attempts WHERE started_us < ended_us),
       used AS (SELECT scope, at_us, sum(sum(change)) OVER (PARTITION BY scope ORDER BY at_us) AS in_use
                FROM edges GROUP BY scope, at_us)
       SELECT scope, in_use::BIGINT AS peak, at_us AS first_peak_us FROM used
       QUALIFY row_number() OVER (PARTITION BY scope ORDER BY in_use DESC, at_us) = 1""",
    "attempts",
)


def retry_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which latest node records may be retried, and after how long."""
    nodes = latest_nodes(spark, sf_dir)
    policy = nodes.withColumns(
        {
            "retry_categories": F.array(F.lit("INFRASTRUCTURE"), F.lit("TIMEOUT")),
            "max_retries": F.lit(2).cast("long"),
            "strategy": F.when(F.col("sequence") % 11 == 0, "none").otherwise("merge"),
            "eligible": F.col("sequence") % 13 != 0,
        }
    )
    delay = backoff_seconds(F.lit(0.5), F.lit(2.0), F.col("attempt"), F.lit(1.5))
    return policy.select(
        "scope",
        "node_id",
        "status",
        "attempt",
        failures.retry_eligible().alias("retry"),
    ).withColumn("delay_seconds", F.when(F.col("retry"), delay))


QUERIES["retry_eligible"] = retry_eligible
ORACLES["retry_eligible"] = with_tables(
    """SELECT *, CASE WHEN retry THEN least(1.5, 0.5 * pow(2, attempt - 1))::DOUBLE END AS delay_seconds FROM (
         SELECT scope, node_id, status, attempt,
                coalesce(status IN ('FAILED', 'TIMED_OUT') AND NOT execution_uncertain AND error_retryable
                         AND error_category IN ('INFRASTRUCTURE', 'TIMEOUT') AND attempt <= 2
                         AND sequence % 11 <> 0 AND sequence % 13 <> 0, false) AS retry
         FROM latest_nodes)""",
    "latest_nodes",
)

QUERIES["control_notices"] = lambda spark, sf_dir: ledger.control_notices(
    ledger.run_summary(latest_nodes(spark, sf_dir))
)
ORACLES["control_notices"] = with_tables(
    """, counted AS (SELECT scope, run_id, count(*) FILTER (status IN ('FAILED', 'BLOCKED')) AS f,
                            count(*) FILTER (status = 'TIMED_OUT') AS t,
                            count(*) FILTER (status IN ('PENDING', 'READY', 'RUNNING')) AS o
                     FROM latest_nodes GROUP BY ALL)
       SELECT scope, run_id, 'failure' AS kind FROM counted WHERE f > 0
       UNION ALL SELECT scope, run_id, 'timeout' FROM counted WHERE t > 0
       UNION ALL SELECT scope, run_id, 'completed' FROM counted WHERE o = 0""",
    "latest_nodes",
)


def resource_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each attempt reads one source, and those of an even node also write one to three targets."""
    node = F.substring("node_id", 2, 20).cast("long")
    attempts = derived.attempts(spark, sf_dir).withColumn(
        "resources",
        F.when(node % 2 == 0, F.create_map(F.lit("reads"), F.lit(1).cast("long"), F.lit("writes"), node % 3 + 1))
        .otherwise(F.create_map(F.lit("reads"), F.lit(1).cast("long"))),
    )
    # Reads are limited to the number of regions; writes have no capacity, which counts as exceeded.
    capacities = derived.table(spark, sf_dir, "region").agg(
        F.lit("reads").alias("resource"), F.count(F.lit(1)).alias("capacity")
    )
    return ledger.resource_usage(attempts, ["scope"], capacities)


QUERIES["resource_usage"] = resource_usage
ORACLES["resource_usage"] = with_tables(
    """, demands AS (
         SELECT scope, started_us, ended_us, 'reads' AS resource, 1 AS demand FROM attempts
         UNION ALL SELECT scope, started_us, ended_us, 'writes', substr(node_id, 2)::BIGINT % 3 + 1 FROM attempts
         WHERE substr(node_id, 2)::BIGINT % 2 = 0),
       edges AS (SELECT scope, resource, started_us AS at_us, demand AS change FROM demands
                 WHERE started_us < ended_us
                 UNION ALL SELECT scope, resource, ended_us, -demand FROM demands WHERE started_us < ended_us),
       used AS (SELECT scope, resource, at_us,
                       sum(sum(change)) OVER (PARTITION BY scope, resource ORDER BY at_us) AS in_use
                FROM edges GROUP BY scope, resource, at_us),
       peaks AS (SELECT scope, resource, in_use::BIGINT AS peak, at_us AS first_peak_us FROM used
                 QUALIFY row_number() OVER (PARTITION BY scope, resource ORDER BY in_use DESC, at_us) = 1)
       SELECT p.*, c.capacity, coalesce(peak > c.capacity, true) AS exceeded
       FROM peaks p LEFT JOIN (SELECT 'reads' AS resource, count(*) AS capacity FROM region) c
            ON c.resource = p.resource""",
    "attempts",
)


def attempt_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from each event of a node to its next one, from the ISO timestamps in the ledger."""
    following = ordered.previous(
        _events(spark, sf_dir),
        ["scope", "node_id"],
        -F.col("sequence"),
        F.col("timestamp"),
        "next_timestamp",
    )
    return following.select(
        "scope",
        "node_id",
        "sequence",
        seconds_between(F.col("timestamp"), F.col("next_timestamp")).alias("seconds"),
    )


QUERIES["attempt_durations"] = attempt_durations
ORACLES["attempt_durations"] = with_tables(
    """, moments AS (SELECT scope, node_id, sequence,
                            epoch_us(strptime(left(timestamp, 23), '%Y-%m-%dT%H:%M:%S.%g')) AS at_us FROM ledger),
       following AS (SELECT *, lead(at_us) OVER (PARTITION BY scope, node_id ORDER BY sequence) - at_us AS us
                     FROM moments)
       SELECT scope, node_id, sequence,
              CASE WHEN us IS NOT NULL THEN greatest(us, 0) / 1000000 END::DOUBLE AS seconds FROM following""",
    "ledger",
)
