"""Receiving and ledger tables derived from the star-schema test tables.

Each table exists twice: as a DataFrame and as the SQL of the same rows (``SQL``), which the oracle queries
put in front of their own text. Every row of the source table takes part; the residues of its keys only decide
which defect, state or role a row gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.contracts import LINE_COLUMNS
from quayside.operators import ordered

MAX_QUANTITY = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipment lines with blanks, negatives, wrong units, conflicts and exact retransmissions."""
    item = table(spark, sf_dir, "lineitem")
    units = F.col("l_quantity").cast("long").cast("string")
    once = item.select(
        F.concat(F.lit("ASN-"), F.col("l_orderkey")).alias("shipment_id"),
        F.col("l_linenumber").cast("string").alias("line_id"),
        F.concat(F.lit("SKU-"), F.col("l_partkey")).alias("sku"),
        F.when(F.col("l_suppkey") % 17 == 0, " ")
        .otherwise(F.concat(F.lit("WH-"), F.col("l_suppkey")))
        .alias("warehouse_id"),
        F.when(F.col("l_partkey") % 23 == 0, F.concat(F.lit("-"), units)).otherwise(units).alias("quantity"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_partkey") % 7 == 0), "CASE")
        .otherwise("EA")
        .alias("unit_of_measure"),
        F.when(F.col("l_partkey") % 11 == 0, 2).otherwise(1).alias("_copies"),
    )
    # One scan yields both the line and its retransmission.
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")
    return once.select(*LINE_COLUMNS, copies).drop("_copy")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalog that lacks every 31st part."""
    part = table(spark, sf_dir, "part").where(F.col("p_partkey") % 31 != 0)
    return part.select(
        F.concat(F.lit("SKU-"), F.col("p_partkey")).alias("sku"),
        F.col("p_name").alias("description"),
        F.lit("EA").alias("unit_of_measure"),
    )


SQL: dict[str, str] = {
    "once": """
        SELECT 'ASN-' || l_orderkey AS shipment_id, l_linenumber::VARCHAR AS line_id,
               'SKU-' || l_partkey AS sku,
               CASE WHEN l_suppkey % 17 = 0 THEN ' ' ELSE 'WH-' || l_suppkey END AS warehouse_id,
               CASE WHEN l_partkey % 23 = 0 THEN '-' ELSE '' END || l_quantity::BIGINT AS quantity,
               CASE WHEN l_returnflag = 'A' AND l_partkey % 7 = 0 THEN 'CASE' ELSE 'EA' END AS unit_of_measure,
               l_partkey
        FROM lineitem""",
    "lines": """
        SELECT * EXCLUDE (l_partkey) FROM once
        UNION ALL SELECT * EXCLUDE (l_partkey) FROM once WHERE l_partkey % 11 = 0""",
    "catalog": """
        SELECT 'SKU-' || p_partkey AS sku, p_name AS description, 'EA' AS unit_of_measure
        FROM part WHERE p_partkey % 31 <> 0""",
    "versions": """
        SELECT *, count(*) OVER (PARTITION BY shipment_id, line_id) AS versions
        FROM (SELECT DISTINCT * FROM lines)""",
    "classified": """
        SELECT v.shipment_id, v.line_id, v.sku, v.warehouse_id, v.quantity, v.unit_of_measure,
               CASE WHEN regexp_full_match(quantity, '[0-9]{1,18}') THEN try_cast(quantity AS BIGINT) END AS parsed_quantity,
               CASE WHEN coalesce(trim(v.shipment_id), '') = '' OR coalesce(trim(v.line_id), '') = ''
                         THEN 'missing_shipment_key'
                    WHEN versions <> 1 THEN 'conflicting_shipment_key'
                    WHEN NOT regexp_full_match(quantity, '[0-9]{1,18}') OR try_cast(quantity AS BIGINT) <= 0
                         OR try_cast(quantity AS BIGINT) > 1000000 THEN 'invalid_quantity'
                    WHEN c.sku IS NULL THEN 'unknown_sku'
                    WHEN coalesce(trim(v.warehouse_id), '') = '' THEN 'missing_warehouse'
                    WHEN v.unit_of_measure IS DISTINCT FROM c.unit_of_measure THEN 'unit_mismatch' END AS reason
        FROM versions v LEFT JOIN catalog c ON v.sku = c.sku""",
    "accepted": """
        SELECT shipment_id, line_id, sku, warehouse_id, parsed_quantity AS quantity, unit_of_measure
        FROM classified WHERE reason IS NULL""",
    "plan": """
        SELECT warehouse_id, sku, unit_of_measure, sum(quantity)::BIGINT AS expected_units,
               count(*) AS shipment_lines
        FROM accepted GROUP BY ALL""",
}

NEEDS = {
    "lines": ["once"],
    "versions": ["lines"],
    "classified": ["versions", "catalog"],
    "accepted": ["classified"],
    "plan": ["accepted"],
}


def with_tables(body: str, *names: str) -> str:
    """``body`` preceded by the definitions it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({SQL[name]})" for name in order) + "\n" + body


# --- event ledger ------------------------------------------------------------------------------

# Payload of a node event, as the readers of the ledger declare it.
NODE_PAYLOAD = (
    "status STRING, attempt LONG, duration_seconds DOUBLE, retry_count LONG, restart_mode STRING, "
    "business_run_key STRING, critical BOOLEAN, execution_uncertain BOOLEAN, ended_us LONG, deadline_us LONG, "
    "error STRUCT<category: STRING, code: STRING, message: STRING, retryable: BOOLEAN>"
)

_EVENT_KINDS = {
    "signup": ("NODE_CREATED", "PENDING"),
    "view": ("NODE_READY", "READY"),
    "click": ("ATTEMPT_CLAIMED", "RUNNING"),
    "purchase": ("ATTEMPT_FINISHED", "SUCCEEDED"),
    "error": ("ATTEMPT_FINISHED", "FAILED"),
}


def _by_kind(position: int) -> Column:
    choice = None
    for kind, values in _EVENT_KINDS.items():
        here = F.col("kind") == kind
        choice = F.when(here, values[position]) if choice is None else choice.when(here, values[position])
    return choice


def _text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _json_text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(part) if isinstance(part, str) else part for part in parts])


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What node events are made of."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("S"), F.col("user_id") % 20).alias("scope"),
        "user_id",
        F.col("event_type").alias("kind"),
        "value",
        F.col("ts"),
    )


def unsequenced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node events without a sequence number, with ``event_id`` as the order of arrival."""
    return _as_events(_arrivals(spark, sf_dir))


def _as_events(arrivals: DataFrame) -> DataFrame:
    event = arrivals.select(
        "event_id",
        "scope",
        *(["sequence"] if "sequence" in arrivals.columns else []),
        F.lit("node").alias("entity_type"),
        F.concat(F.lit("E"), F.col("user_id")).alias("entity_id"),
        F.concat(F.lit("R"), F.col("user_id") % 20).alias("run_id"),
        F.concat(F.lit("E"), F.col("user_id")).alias("node_id"),
        _by_kind(0).alias("event_type"),
        F.concat(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")
        ).alias("timestamp"),
        _by_kind(1).alias("status"),
        (F.col("event_id") % 3 + 1).alias("attempt"),
        F.col("value").alias("duration_seconds"),
        (F.col("user_id") % 3 == 0).alias("critical"),
        (F.col("event_id") % 101 == 0).alias("uncertain"),
        _event_micros(F.col("ts")).alias("ended_us"),
        F.col("event_id").alias("_event"),
    )
    error = F.when(
        F.col("status") == "FAILED",
        _json_text(
            '{"category":"',
            F.when(F.col("_event") % 2 == 0, "INFRASTRUCTURE").otherwise("DATA_QUALITY"),
            '","code":"CODE_',
            _text(F.col("_event") % 5),
            '","message":"row ',
            _text("_event"),
            ' of the customer file","retryable":',
            _text(F.col("_event") % 2 == 0),
            "}",
        ),
    ).otherwise("null")
    payload = _json_text(
        '{"status":"',
        F.col("status"),
        '","attempt":',
        _text("attempt"),
        ',"duration_seconds":',
        _text("duration_seconds"),
        ',"retry_count":',
        _text(F.col("attempt") - 1),
        ',"restart_mode":"normal","business_run_key":"2024-01-',
        F.lpad(_text(F.col("_event") % 28 + 1), 2, "0"),
        '","critical":',
        _text("critical"),
        ',"execution_uncertain":',
        _text("uncertain"),
        ',"ended_us":',
        _text("ended_us"),
        ',"deadline_us":',
        _text(F.col("ended_us") + (F.col("_event") % 5 - 2) * 1_000_000),
        ',"claim_id":"claim-',
        _text("_event"),
        '","error":',
        error,
        "}",
    )
    return event.select(
        "event_id",
        "scope",
        *(["sequence"] if "sequence" in arrivals.columns else []),
        "entity_type",
        "entity_id",
        "run_id",
        "node_id",
        "event_type",
        "timestamp",
        payload.alias("payload"),
    )


def _event_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger: sequence 1, 2, 3 … per scope in order of arrival. Rows are numbered before they get their texts,
    which would make up most of what is shuffled."""
    numbered = ordered.row_number(_arrivals(spark, sf_dir), ["scope"], F.col("event_id"), "sequence")
    return _as_events(numbered).select(
        "scope",
        "sequence",
        "entity_type",
        "entity_id",
        "run_id",
        "node_id",
        "event_type",
        "timestamp",
        "payload",
        "event_id",
    )


SQL["raw_events"] = """
    SELECT event_id, 'S' || (user_id % 20) AS scope, 'node' AS entity_type, 'E' || user_id AS entity_id,
           'R' || (user_id % 20) AS run_id, 'E' || user_id AS node_id,
           CASE event_type WHEN 'signup' THEN 'NODE_CREATED' WHEN 'view' THEN 'NODE_READY'
                WHEN 'click' THEN 'ATTEMPT_CLAIMED' ELSE 'ATTEMPT_FINISHED' END AS event_type,
           strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '+00:00' AS timestamp,
           CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'READY' WHEN 'click' THEN 'RUNNING'
                WHEN 'purchase' THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
           event_id % 3 + 1 AS attempt, value AS duration_seconds, user_id % 3 = 0 AS critical,
           event_id % 101 = 0 AS execution_uncertain, epoch_us(ts) AS ended_us,
           epoch_us(ts) + (event_id % 5 - 2) * 1000000 AS deadline_us,
           '2024-01-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS business_run_key,
           CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'INFRASTRUCTURE'
                ELSE 'DATA_QUALITY' END END AS error_category,
           CASE WHEN event_type = 'error' THEN 'CODE_' || (event_id % 5) END AS error_code,
           CASE WHEN event_type = 'error' THEN event_id % 2 = 0 END AS error_retryable
    FROM events"""
SQL["ledger"] = """
    SELECT *, row_number() OVER (PARTITION BY scope ORDER BY event_id) AS sequence,
           '{"status":"' || status || '","attempt":' || attempt || ',"duration_seconds":' || duration_seconds
           || ',"retry_count":' || (attempt - 1) || ',"restart_mode":"normal","business_run_key":"'
           || business_run_key || '","critical":' || critical || ',"execution_uncertain":'
           || execution_uncertain || ',"ended_us":' || ended_us || ',"deadline_us":' || deadline_us
           || ',"claim_id":"claim-' || event_id || '","error":'
           || CASE WHEN status = 'FAILED' THEN '{"category":"' || error_category || '","code":"' || error_code
                   || '","message":"row ' || event_id || ' of the customer file","retryable":'
                   || error_retryable || '}' ELSE 'null' END || '}' AS payload
    FROM raw_events"""
NEEDS["ledger"] = ["raw_events"]


def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with the node payload as plain columns."""
    from quayside.operators.ledger import decoded

    return flatten_payload(decoded(events(spark, sf_dir), NODE_PAYLOAD))


def flatten_payload(frame: DataFrame) -> DataFrame:
    return frame.select(
        *[name for name in frame.columns if name not in ("payload", "event_id")],
        "payload.status",
        "payload.attempt",
        "payload.duration_seconds",
        "payload.critical",
        "payload.execution_uncertain",
        "payload.ended_us",
        "payload.deadline_us",
        F.col("payload.error.category").alias("error_category"),
        F.col("payload.error.code").alias("error_code"),
        F.col("payload.error.retryable").alias("retryable"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished attempts as intervals: each lasted as many hours as its event's value says."""
    worked_us = F.round(F.col("duration_seconds") * 100).cast("long") * 36_000_000
    return (
        decoded_events(spark, sf_dir)
        .where(F.col("event_type") == "ATTEMPT_FINISHED")
        .select(
            "scope",
            "node_id",
            "sequence",
            (F.col("ended_us") - worked_us).alias("started_us"),
            "ended_us",
            F.lit(1).cast("long").alias("demand"),
        )
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order; the business key is the customer."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey")).alias("scope"),
        F.concat(F.lit("R"), F.col("o_orderkey")).alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
        .when(F.col("o_orderstatus") == "O", "FAILED")
        .otherwise("RUNNING")
        .alias("status"),
        "o_orderkey",
    )
    numbered = ordered.row_number(orders, ["scope"], F.col("o_orderkey"), "attempt")
    return numbered.drop("o_orderkey")


def ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs behind the event ledger."""
    number = F.col("user_id") % 20
    return (
        table(spark, sf_dir, "events")
        .select(number.alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("S"), F.col("n")).alias("scope"),
            F.concat(F.lit("R"), F.col("n")).alias("run_id"),
            F.when(F.col("n") % 3 == 0, "RUNNING")
            .when(F.col("n") % 3 == 1, "FAILED")
            .otherwise("RECOVERY_REQUIRED")
            .alias("status"),
        )
    )


def watermarks(ledger: DataFrame) -> DataFrame:
    """Every scope but one in five has been read up to half of its events."""
    newest = ledger.groupBy("scope").agg(F.max("sequence").alias("sequence"))
    number = F.substring("scope", 2, 20).cast("long")
    return newest.where(number % 5 != 0).select("scope", F.floor(F.col("sequence") / 2).alias("sequence"))


SQL["attempts"] = """
    SELECT scope, node_id, sequence, ended_us - round(duration_seconds * 100)::BIGINT * 36000000 AS started_us,
           ended_us FROM ledger WHERE event_type = 'ATTEMPT_FINISHED'"""
SQL["latest_nodes"] = """
    SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY scope, entity_type, entity_id
                                                   ORDER BY sequence DESC) = 1"""
SQL["runs"] = """
    SELECT 'S' || o_custkey AS scope, 'R' || o_orderkey AS run_id,
           CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS attempt
    FROM orders"""
SQL["ledger_runs"] = """
    SELECT DISTINCT 'S' || (user_id % 20) AS scope, 'R' || (user_id % 20) AS run_id,
           CASE user_id % 20 % 3 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' ELSE 'RECOVERY_REQUIRED' END AS status
    FROM events"""
SQL["marks"] = """
    SELECT scope, max(sequence) // 2 AS seen FROM ledger
    WHERE substr(scope, 2)::BIGINT % 5 <> 0 GROUP BY scope"""
NEEDS |= {"attempts": ["ledger"], "latest_nodes": ["ledger"], "marks": ["ledger"]}


# --- dependency graph --------------------------------------------------------------------------

_TRIGGERS = ["all_success", "any_success", "all_done", "any_failed", "any_timed_out"]
_STATES = [
    "SUCCEEDED",
    "SKIPPED_ALREADY_SATISFIED",
    "SUCCEEDED",
    "FAILED",
    "TIMED_OUT",
    "SKIPPED_CONDITION",
    "BLOCKED",
    "CANCELLED",
    "RUNNING",
    "SUCCEEDED",
]
_RESIDUES = "[{}]".format(", ".join(f"'{state}'" for state in _STATES))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per part."""
    key = F.col("p_partkey")

    def pick(values: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))

    return table(spark, sf_dir, "part").select(
        key.alias("node_id"),
        F.col("p_size").cast("double").alias("weight"),
        pick(_TRIGGERS).alias("trigger"),
        pick(_STATES).alias("status"),
        F.when(key % 7 == 0, F.when(key % 14 == 0, "off").otherwise("on")).alias("condition_value"),
        F.when(key % 7 == 0, "on").alias("condition_expected"),
        (key % 3 == 0).alias("critical"),
        F.col("p_brand").alias("concurrency_group"),
        F.col("p_type").alias("strategy"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node from 2 on depends on its half and its third; nodes 0 and 1 are roots."""
    key = F.col("p_partkey")
    sources = F.explode(
        F.when(key >= 3, F.array_distinct(F.array(F.floor(key / 2), F.floor(key / 3)))).otherwise(
            F.array(F.floor(key / 2))
        )
    )
    return table(spark, sf_dir, "part").where(key >= 2).select(sources.alias("src"), key.alias("dst"))


def looped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges plus one that leads from every 97th node back to its half."""
    key = F.col("p_partkey")
    back = table(spark, sf_dir, "part").where((key % 97 == 0) & (key > 0)).select(
        key.alias("src"), F.floor(key / 2).alias("dst")
    )
    return edges(spark, sf_dir).unionAll(back)


SQL["nodes"] = f"""
    SELECT p_partkey AS node_id, p_size::DOUBLE AS weight, {_TRIGGERS}[p_partkey % 5 + 1] AS trigger,
           {_RESIDUES}[p_partkey % 10 + 1] AS status,
           CASE WHEN p_partkey % 14 = 0 THEN 'off' WHEN p_partkey % 7 = 0 THEN 'on' END AS condition_value,
           CASE WHEN p_partkey % 7 = 0 THEN 'on' END AS condition_expected, p_partkey % 3 = 0 AS critical,
           p_brand AS concurrency_group, p_type AS strategy
    FROM part"""
SQL["edges"] = """
    SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey >= 2
    UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey >= 3"""
SQL["looped"] = """
    SELECT * FROM edges UNION SELECT p_partkey, p_partkey // 2 FROM part
    WHERE p_partkey % 97 = 0 AND p_partkey > 0"""
SQL["reach"] = """
    SELECT node_id FROM nodes WHERE node_id % 50 = 7
    UNION SELECT dst FROM edges JOIN reach ON src = reach.node_id"""
# Every distinct (node, length, weight) of a path from a root.
SQL["levels"] = """
    SELECT node_id, 0::BIGINT AS wave, weight AS total FROM nodes
    WHERE node_id NOT IN (SELECT dst FROM edges)
    UNION
    SELECT n.node_id, l.wave + 1, l.total + n.weight
    FROM levels l JOIN edges e ON e.src = l.node_id JOIN nodes n ON n.node_id = e.dst"""
SQL["waves"] = "SELECT node_id, max(wave) AS wave FROM levels GROUP BY node_id"
NEEDS |= {"looped": ["edges"], "reach": ["nodes", "edges"], "levels": ["nodes", "edges"], "waves": ["levels"]}
