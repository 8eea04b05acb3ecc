"""Registered queries on restart proofs, outbox intents, digests, scans and scalar rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.contracts import PLAN_SCHEMA
from quayside.functions import text as rules
from quayside.functions.digest import dataset_digest
from quayside.operators import credentials, outbox, restart
from quayside.plans import derived
from quayside.plans.derived import table, with_tables
from quayside.plans.graph_queries import node_records
from quayside.plans.ledger_queries import digest_sql, row_hash_sql, short_digest_sql
from quayside.plans.receiving_queries import receiving_plan

QUERIES = {}
ORACLES = {}


def _hash(prefix: str, column: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), F.col(column)), 256)


# --- reuse of prior results --------------------------------------------------------------------
# Every residue of the node id breaks one condition, so each cause occurs; others leave values open or break a second.


def current_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("node_id") % 19
    return derived.nodes(spark, sf_dir).select(
        "node_id",
        (case == 0).alias("invalidated"),
        F.lit("2024-01-02").alias("business_run_key"),
        F.lit("receiving").alias("dag_id"),
        F.lit("2.0").alias("dag_version"),
        F.array(F.lit("1.9")).alias("compatible_versions"),
        F.lit("0.3").alias("code_version"),
        F.lit("code-a").alias("code_fingerprint"),
        _hash("in-", "node_id").alias("input_fingerprint"),
        F.when(F.col("node_id") % 23 != 5, case != 9).alias("eligible"),
        F.when((case == 10) | (F.col("node_id") % 31 == 4), "always_run").otherwise("reuse_valid").alias("policy"),
        F.when(case == 12, "none").otherwise("merge").alias("strategy"),
        F.concat(F.lit("cp-"), "node_id").alias("checkpoint_name"),
    )


def prior_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    case, key = F.col("node_id") % 19, F.col("node_id")

    def unless(broken: int, value: Column, other: str | None) -> Column:
        return F.when(case == broken, F.lit(other)).otherwise(value)

    outputs, inputs = _hash("out-", "node_id"), _hash("in-", "node_id")
    proof = restart.checkpoint_record(
        unless(14, F.concat(F.lit("cp-"), key), "other"),
        unless(15, inputs, "other"),
        unless(16, outputs, "other"),
        F.lit("2024-01-02T00:00:00.000+00:00"),
    )
    return derived.nodes(spark, sf_dir).where(case != 1).select(
        "node_id",
        F.concat(F.lit("R"), key % 4).alias("run_id"),
        F.when(key % 6 == 0, F.concat(F.lit("R"), key % 3, F.lit("-old"))).alias("reused_from_run_id"),
        F.when(case == 2, "FAILED")
        .when(key % 2 == 0, "SKIPPED_ALREADY_SATISFIED")
        .otherwise("SUCCEEDED")
        .alias("status"),
        F.when(key % 29 != 3, unless(3, F.lit("2024-01-02"), "2023-12-31")).alias("business_run_key"),
        unless(4, F.lit("receiving"), "shipping").alias("dag_id"),
        F.when(case == 5, "1.0").when(case == 18, "1.9").otherwise("2.0").alias("dag_version"),
        unless(6, F.lit("0.3"), "0.2").alias("code_version"),
        unless(7, F.lit("code-a"), "code-b").alias("code_fingerprint"),
        unless(8, inputs, "other").alias("input_fingerprint"),
        (case == 11).alias("execution_uncertain"),
        F.when(case != 13, proof).alias("checkpoint"),
        outputs.alias("outputs_fingerprint"),
        F.when(key % 37 != 2, case != 17).alias("outputs_valid"),
    )


QUERIES["reuse_proof"] = lambda spark, sf_dir: restart.reuse_proof(
    current_nodes(spark, sf_dir), prior_nodes(spark, sf_dir)
)
derived.SQL["current_nodes"] = """
    SELECT node_id, node_id % 19 = 0 AS invalidated, '2024-01-02' AS business_run_key, 'receiving' AS dag_id,
           '2.0' AS dag_version, ['1.9'] AS compatible_versions, '0.3' AS code_version, 'code-a' AS code_fingerprint,
           sha256('in-' || node_id) AS input_fingerprint,
           CASE WHEN node_id % 23 <> 5 THEN node_id % 19 <> 9 END AS eligible,
           CASE WHEN node_id % 19 = 10 OR node_id % 31 = 4 THEN 'always_run' ELSE 'reuse_valid' END AS policy,
           CASE WHEN node_id % 19 = 12 THEN 'none' ELSE 'merge' END AS strategy, 'cp-' || node_id AS checkpoint_name
    FROM nodes"""
derived.SQL["prior_nodes"] = """
    SELECT node_id, CASE WHEN k = 2 THEN 'FAILED' WHEN node_id % 2 = 0 THEN 'SKIPPED_ALREADY_SATISFIED' ELSE 'SUCCEEDED' END
               AS status,
           CASE WHEN node_id % 29 = 3 THEN NULL WHEN k = 3 THEN '2023-12-31' ELSE '2024-01-02' END AS business_run_key,
           CASE WHEN k = 4 THEN 'shipping' ELSE 'receiving' END AS dag_id,
           CASE WHEN k = 5 THEN '1.0' WHEN k = 18 THEN '1.9' ELSE '2.0' END AS dag_version,
           CASE WHEN k = 6 THEN '0.2' ELSE '0.3' END AS code_version,
           CASE WHEN k = 7 THEN 'code-b' ELSE 'code-a' END AS code_fingerprint,
           CASE WHEN k = 8 THEN 'other' ELSE sha256('in-' || node_id) END AS input_fingerprint,
           k = 11 AS execution_uncertain, k <> 13 AS has_checkpoint,
           CASE WHEN k = 14 THEN 'other' ELSE 'cp-' || node_id END AS checkpoint_name,
           CASE WHEN k = 15 THEN 'other' ELSE sha256('in-' || node_id) END AS checkpoint_inputs,
           CASE WHEN k = 16 THEN 'other' ELSE sha256('out-' || node_id) END AS checkpoint_outputs,
           sha256('out-' || node_id) AS outputs_fingerprint,
           CASE WHEN node_id % 37 <> 2 THEN k <> 17 END AS outputs_valid
    FROM (SELECT node_id, node_id % 19 AS k FROM nodes) WHERE k <> 1"""
derived.NEEDS |= {"current_nodes": ["nodes"], "prior_nodes": ["nodes"]}
# Each condition that has to hold, in the order of the causes.
_CONDITIONS = {
    "invalidated": "NOT c.invalidated",
    "no_prior_record": "p.node_id IS NOT NULL",
    "prior_not_successful": "p.status IN ('SUCCEEDED', 'SKIPPED_ALREADY_SATISFIED')",
    "business_run_key": "p.business_run_key = c.business_run_key",
    "dag_id": "p.dag_id = c.dag_id",
    "dag_version": "p.dag_version = c.dag_version OR list_contains(c.compatible_versions, p.dag_version)",
    "code_version": "p.code_version = c.code_version",
    "code_fingerprint": "p.code_fingerprint = c.code_fingerprint",
    "input_fingerprint": "p.input_fingerprint = c.input_fingerprint",
    "not_eligible": "c.eligible",
    "policy": "c.policy = 'reuse_valid'",
    "execution_uncertain": "NOT p.execution_uncertain",
    "unsafe_strategy": "c.strategy <> 'none'",
    "no_checkpoint": "p.has_checkpoint",
    "checkpoint_name": "p.checkpoint_name = c.checkpoint_name",
    "checkpoint_inputs": "p.checkpoint_inputs = c.input_fingerprint",
    "checkpoint_outputs": "p.checkpoint_outputs = p.outputs_fingerprint",
    "outputs_invalid": "p.outputs_valid",
}
_BROKEN = " ".join(f"WHEN NOT coalesce({holds}, false) THEN '{cause}'" for cause, holds in _CONDITIONS.items())
ORACLES["reuse_proof"] = with_tables(
    f"""SELECT node_id, cause IS NULL AS reuse, cause FROM (
         SELECT c.node_id, CASE {_BROKEN} END AS cause FROM current_nodes c LEFT JOIN prior_nodes p USING (node_id))""",
    "current_nodes",
    "prior_nodes",
)

QUERIES["reuse_provenance"] = lambda spark, sf_dir: restart.reuse_provenance(prior_nodes(spark, sf_dir))
ORACLES["reuse_provenance"] = with_tables(
    """SELECT node_id, 'R' || (node_id % 4) AS parent_run_id,
              CASE WHEN node_id % 6 = 0 THEN 'R' || (node_id % 3) || '-old' ELSE 'R' || (node_id % 4) END
                  AS produced_by_run_id
       FROM nodes WHERE node_id % 19 NOT IN (1, 2)""",
    "nodes",
)

QUERIES["checkpoint_complete"] = lambda spark, sf_dir: restart.checkpoint_complete(prior_nodes(spark, sf_dir))
ORACLES["checkpoint_complete"] = with_tables(
    """SELECT node_id, status, complete, status <> 'SUCCEEDED' OR complete AS allowed FROM (
         SELECT node_id, CASE WHEN node_id % 19 = 2 THEN 'FAILED' WHEN node_id % 2 = 0
                              THEN 'SKIPPED_ALREADY_SATISFIED' ELSE 'SUCCEEDED' END AS status,
                node_id % 19 NOT IN (13, 16) AS complete
         FROM nodes WHERE node_id % 19 <> 1)""",
    "nodes",
)


def outputs_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("node_id")
    nodes = derived.nodes(spark, sf_dir).select("node_id")
    names = F.sequence(F.lit(0).cast("long"), key % 3)
    expected = nodes.select("node_id", F.explode(names).alias("n")).select(
        "node_id", F.concat(F.lit("o"), "n").alias("output")
    )
    produced = expected.where(~((key % 13 == 0) & (F.col("output") == "o0"))).unionAll(
        nodes.where(key % 17 == 0).select("node_id", F.lit("extra"))
    )
    return restart.outputs_complete(expected, produced)


QUERIES["outputs_complete"] = outputs_complete
ORACLES["outputs_complete"] = with_tables(
    """SELECT *, missing = 0 AND unexpected = 0 AS complete FROM (
         SELECT node_id, node_id % 3 + 1 AS expected, (node_id % 13 = 0)::BIGINT AS missing,
                (node_id % 17 = 0)::BIGINT AS unexpected FROM nodes)""",
    "nodes",
)


def reexecution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("node_id")
    nodes = derived.nodes(spark, sf_dir).select(
        "node_id",
        (key % 11 != 0).alias("eligible"),
        F.when(key % 4 == 0, "compensation").when(key % 4 == 1, "none").otherwise("merge").alias("strategy"),
        F.when(key % 4 == 0, F.floor(key / 4)).alias("compensation_node"),
    )
    states = derived.nodes(spark, sf_dir).select("node_id", "status", (key % 5 != 0).alias("outputs_valid"))
    return restart.reexecution_check(
        nodes, nodes.where(key % 3 != 0), nodes.where(key % 8 < 5), states
    )


QUERIES["reexecution_check"] = reexecution_check
ORACLES["reexecution_check"] = with_tables(
    """SELECT n.node_id,
              CASE n.node_id % 4 WHEN 0 THEN 'compensation' WHEN 1 THEN 'none' ELSE 'merge' END AS strategy,
              CASE WHEN n.node_id % 3 = 0 THEN NULL WHEN n.node_id % 11 = 0 THEN 'RESTART_NOT_ELIGIBLE'
                   WHEN n.node_id % 4 IN (0, 1) AND n.node_id % 8 >= 5 THEN 'APPROVAL_REQUIRED'
                   WHEN n.node_id % 4 = 0 AND NOT coalesce(
                        c.status IN ('SUCCEEDED', 'SKIPPED_ALREADY_SATISFIED') AND c.node_id % 5 <> 0, false)
                        THEN 'COMPENSATION_REQUIRED' END AS refusal
       FROM nodes n LEFT JOIN nodes c ON n.node_id % 4 = 0 AND c.node_id = n.node_id // 4""",
    "nodes",
)


# --- fingerprints ------------------------------------------------------------------------------


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of the nodes, one per line item; every other one names a source."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("node_id"),
        F.concat_ws(".", F.lit("rules"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
        .alias("path"),
        F.col("l_quantity").cast("long").cast("string").alias("value"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("source_id"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), F.sha2("s_name", 256).alias("fingerprint")
    )


QUERIES["parameter_fingerprints"] = lambda spark, sf_dir: restart.parameter_fingerprints(
    parameters(spark, sf_dir), sources(spark, sf_dir)
)


def _combined_sql(digest: str) -> str:
    return (
        "SELECT node_id, sha256(row_count || '|' || sum_0 || '|' || sum_1 || '|' || sum_2 || '|' || sum_3) "
        f"AS fingerprint FROM ({digest})"
    )


_PARAMETERS = """(SELECT l_partkey AS node_id, 'rules.' || l_orderkey || '.' || l_linenumber AS path,
        CASE WHEN l_linenumber % 2 = 0 AND s_name IS NOT NULL THEN sha256(s_name)
             ELSE l_quantity::BIGINT::VARCHAR END AS value
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
ORACLES["parameter_fingerprints"] = _combined_sql(digest_sql(["path", "value"], _PARAMETERS, "node_id"))


def input_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived.nodes(spark, sf_dir)
    definitions = nodes.select(
        "node_id",
        "trigger",
        "strategy",
        F.lit("receiving").alias("application"),
        F.lit("code-a").alias("code"),
        F.lit("local").alias("environment"),
    )
    dependencies = (
        derived.edges(spark, sf_dir)
        .join(node_records(spark, sf_dir).withColumnRenamed("node_id", "src"), "src")
        .select(
            F.col("dst").alias("node_id"),
            F.col("src").alias("dependency"),
            "status",
            F.lit("accepted").alias("output"),
            "digest",
            "row_count",
        )
    )
    return restart.input_fingerprints(
        definitions, dependencies, ["application", "code", "environment", "node_id", "strategy", "trigger"]
    )


QUERIES["input_fingerprints"] = input_fingerprints
ORACLES["input_fingerprints"] = with_tables(
    f"""SELECT n.node_id, sha256({row_hash_sql(["application", "code", "environment", "node_id", "strategy", "trigger"])}
                   || '|' || coalesce(u.fingerprint, '')) AS fingerprint
        FROM (SELECT *, 'receiving' AS application, 'code-a' AS code, 'local' AS environment FROM nodes) n
        LEFT JOIN ({_combined_sql(short_digest_sql(["dependency", "status", "output", "digest", "row_count"], '''(
            SELECT dst AS node_id, src AS dependency, CASE WHEN status = 'SKIPPED_ALREADY_SATISFIED'
                   THEN 'SUCCEEDED' ELSE status END AS status, 'accepted' AS output, digest, row_count
            FROM edges JOIN records ON src = records.node_id)''', "node_id"))}) u USING (node_id)""",
    "nodes",
    "edges",
    "records",
)

QUERIES["dataset_digest"] = lambda spark, sf_dir: dataset_digest(derived.lines(spark, sf_dir))
_LINE = ["shipment_id", "line_id", "sku", "warehouse_id", "quantity", "unit_of_measure"]
ORACLES["dataset_digest"] = with_tables(digest_sql(_LINE, "lines"), "lines")


def artifact_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treats the lines of each warehouse as one artifact. Recorded proofs differ where a line was lost."""
    lines = derived.lines(spark, sf_dir)
    recorded = dataset_digest(lines, "warehouse_id")
    intact = (F.col("quantity") != "50") | (F.col("unit_of_measure") != "CASE")
    return restart.validate_references(recorded, dataset_digest(lines.where(intact), "warehouse_id"), ["warehouse_id"])


QUERIES["artifact_validation"] = artifact_validation
ORACLES["artifact_validation"] = with_tables(
    """SELECT warehouse_id, count(*) FILTER (quantity = '50' AND unit_of_measure = 'CASE') = 0 AS valid
       FROM lines GROUP BY warehouse_id""",
    "lines",
)


# --- outbox ------------------------------------------------------------------------------------


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.with_effect_id(
        table(spark, sf_dir, "orders").select(
            F.concat(F.lit("S"), F.col("o_custkey")).alias("scope"),
            F.lit("publish").alias("node_id"),
            F.lit("order_receipt").alias("operation"),
            F.sha2(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), 256).alias("payload_digest"),
            F.col("o_orderkey").cast("string").alias("output_reference"),
            "o_orderkey",
            "o_custkey",
        )
    )


def _first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("_first"))


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Existing intents: the first order of each customer, but for every 7th customer. Incoming: the later
    orders, but for every 10th customer, all orders of every 7th, and replays for every 3rd."""
    key = F.col("o_custkey")
    ranked = intents(spark, sf_dir).join(_first_orders(spark, sf_dir), "o_custkey")
    is_first = F.col("o_orderkey") == F.col("_first")
    existing = ranked.where(is_first & (key % 7 != 0)).withColumn("status", F.lit(outbox.PENDING))
    incoming = ranked.where(
        (~is_first & (key % 10 != 0)) | (key % 7 == 0) | (is_first & (key % 3 == 0))
    )
    return existing, incoming


def outbox_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, incoming = _split(spark, sf_dir)
    return outbox.actions(existing, incoming, F.col("o_orderkey"))


derived.SQL["intents"] = """
    SELECT sha256(to_json({'node': 'publish', 'operation': 'order_receipt', 'scope': 'S' || o_custkey})::VARCHAR)
               AS effect_id, 'S' || o_custkey AS scope, o_custkey, o_orderkey,
           sha256(o_orderstatus || '|' || o_orderpriority) AS payload_digest,
           o_orderkey::VARCHAR AS output_reference,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS is_first
    FROM orders"""
derived.SQL["decided"] = """
    WITH entries AS (
      SELECT *, -1 AS pos, NULL::BIGINT AS arrival FROM intents WHERE is_first AND o_custkey % 7 <> 0
      UNION ALL SELECT *, o_orderkey, o_orderkey FROM intents
      WHERE (NOT is_first AND o_custkey % 10 <> 0) OR o_custkey % 7 = 0 OR (is_first AND o_custkey % 3 = 0)),
    held AS (SELECT *, first_value(payload_digest) OVER (PARTITION BY effect_id ORDER BY pos) AS holder FROM entries),
    same AS (SELECT *, lag(output_reference) OVER (PARTITION BY effect_id ORDER BY pos) AS stored
             FROM held WHERE payload_digest = holder)
    SELECT arrival, effect_id, payload_digest, output_reference,
           CASE WHEN stored IS NULL THEN 'insert' WHEN stored <> output_reference THEN 'refresh' ELSE 'noop' END
               AS action
    FROM same WHERE arrival IS NOT NULL
    UNION ALL SELECT arrival, effect_id, payload_digest, output_reference, 'conflict' FROM held
    WHERE payload_digest <> holder AND arrival IS NOT NULL"""
derived.NEEDS["decided"] = ["intents"]

QUERIES["outbox_ids"] = lambda spark, sf_dir: intents(spark, sf_dir).select(
    "effect_id", "scope", "o_orderkey", "valid_operation"
)
ORACLES["outbox_ids"] = with_tables(
    "SELECT effect_id, scope, o_orderkey, true AS valid_operation FROM intents", "intents"
)
QUERIES["outbox_new"] = lambda spark, sf_dir: outbox.new_intents(outbox_actions(spark, sf_dir))
QUERIES["outbox_refresh"] = lambda spark, sf_dir: outbox.refreshed(outbox_actions(spark, sf_dir))
QUERIES["outbox_conflicts"] = lambda spark, sf_dir: outbox.conflicts(outbox_actions(spark, sf_dir))
for _name, _action in (("outbox_new", "insert"), ("outbox_refresh", "refresh")):
    ORACLES[_name] = with_tables(
        f"SELECT * EXCLUDE (action), 'PENDING_DISPATCH' AS status FROM decided WHERE action = '{_action}'", "decided"
    )
ORACLES["outbox_conflicts"] = with_tables(
    "SELECT * EXCLUDE (action) FROM decided WHERE action = 'conflict'", "decided"
)


def outbox_receipt_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, _ = _split(spark, sf_dir)
    receipts = intents(spark, sf_dir).select(
        "scope", "effect_id", F.col("payload_digest").alias("digest")
    )
    return outbox.receipts_valid(receipts, existing)


QUERIES["outbox_receipt_valid"] = outbox_receipt_valid
ORACLES["outbox_receipt_valid"] = with_tables(
    """SELECT r.scope, r.effect_id, r.payload_digest AS digest,
              coalesce(e.payload_digest = r.payload_digest, false) AS valid
       FROM intents r LEFT JOIN (SELECT * FROM intents WHERE is_first AND o_custkey % 7 <> 0) e
            ON e.effect_id = r.effect_id""",
    "intents",
)

QUERIES["plan_intent"] = lambda spark, sf_dir: outbox.dataset_intent(
    receiving_plan(spark, sf_dir), "2024-01-02", "request_receipts", "inventory_receipt"
)
ORACLES["plan_intent"] = with_tables(
    f"""SELECT '2024-01-02' AS scope, 'request_receipts' AS node_id, 'inventory_receipt' AS operation,
               sha256(row_count || '|' || '{PLAN_SCHEMA.simpleString()}' || '|' || sum_0 || '|' || sum_1 || '|' || sum_2 || '|'
                      || sum_3) AS payload_digest, row_count, 'PENDING_DISPATCH' AS status,
               sha256(to_json({{'node': 'request_receipts', 'operation': 'inventory_receipt',
                                'scope': '2024-01-02'}})::VARCHAR) AS effect_id
        FROM ({digest_sql(["warehouse_id", "sku", "unit_of_measure", "expected_units", "shipment_lines"], "plan")})""",
    "plan",
)


# --- credential scan and scalar rules ----------------------------------------------------------


def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    return (
        credentials.credential_scan(documents, "doc_id", "text", "documents.text")
        .unionAll(credentials.credential_scan(pages, "page_id", "url", "pages.url"))
        .unionAll(credentials.credential_scan(pages, "page_id", "html", "pages.html"))
    )


QUERIES["credential_scan"] = credential_scan
_SECRET = "(?i)(^|[._-])(" + "|".join(credentials.SECRET_NAMES) + ")($|[._-])"
_NAMES = """regexp_extract_all(t, '([A-Za-z0-9._-]+)["'']?\\s*[=:]', 1)"""
_URIS = """regexp_extract_all(t, '[A-Za-z][A-Za-z0-9+.-]*://[^\\s"''<>]+')"""
ORACLES["credential_scan"] = f"""
    SELECT source, id, secret_names, account_key_settings, credential_uris FROM (
      SELECT source, id,
             len(list_filter({_NAMES}, lambda n: regexp_matches(n, '{_SECRET}')))::INTEGER AS secret_names,
             len(list_filter({_NAMES}, lambda n: regexp_matches(n, '(?i)fs\\.azure\\.account\\.key\\.')))::INTEGER
                 AS account_key_settings,
             len(list_filter({_URIS}, lambda u: regexp_matches(u, '^[^:]+://[^/?#]+@')
                 AND NOT regexp_matches(u, '(?i)^abfss?://[^:/?#]+:?@')
                 OR regexp_matches(u, '^[^?#]*\\?[^#]+')))::INTEGER AS credential_uris
      FROM (SELECT 'documents.text' AS source, doc_id AS id, text AS t FROM documents
            UNION ALL SELECT 'pages.url', page_id, url FROM pages
            UNION ALL SELECT 'pages.html', page_id, html FROM pages))
    WHERE secret_names + account_key_settings + credential_uris > 0"""


def scalar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar rules over values spelled from the orders."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    spelled = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, F.concat(day, F.lit(" ")))
        .when(key % 5 == 1, F.concat(F.substring(day, 1, 5), F.lit("02-30")))
        .otherwise(day)
        .alias("run_key"),
        F.when(key % 4 == 0, F.lit(".."))
        .when(key % 4 == 1, F.concat(F.lit("a/"), key))
        .when(key % 4 == 2, F.lit(""))
        .otherwise(F.concat(F.lit("run-"), key))
        .alias("segment"),
        F.when(key % 3 == 0, F.lit("  ")).when(key % 3 == 1, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("text"),
        F.when(key % 2 == 0, F.concat(F.lit("op_"), key)).otherwise(F.concat(F.lit("Op "), key)).alias("operation"),
        F.concat(F.when(key % 6 == 0, "x").otherwise("00"), key).alias("number"),
    )
    return spelled.select(
        "o_orderkey",
        rules.missing("text").alias("text_missing"),
        rules.iso_date(F.col("run_key")).alias("run_key_valid"),
        rules.safe_segment(F.col("segment")).alias("segment_safe"),
        rules.full_match(F.col("operation"), rules.OPERATION_ID).alias("operation_valid"),
        rules.strict_quantity(F.col("number")).alias("number"),
        F.coalesce("text", F.lit("none")).alias("text_or_none"),
    )


QUERIES["scalar_pack"] = scalar_pack
ORACLES["scalar_pack"] = """
    SELECT o_orderkey, o_orderkey % 3 <> 2 AS text_missing, o_orderkey % 5 > 1 AS run_key_valid,
           o_orderkey % 4 = 3 AS segment_safe, o_orderkey % 2 = 0 AS operation_valid,
           CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey END AS number,
           CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'none' ELSE o_orderpriority END AS text_or_none
    FROM orders"""


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay before the next attempt of every finished attempt, capped at two seconds."""
    finished = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase"))
    attempt = F.col("event_id") % 8 + 1
    return finished.select(
        "event_id",
        attempt.alias("attempt"),
        rules.backoff_seconds(F.lit(0.125), F.lit(2.0), attempt, F.lit(2.0)).alias("delay_seconds"),
    )


QUERIES["backoff_schedule"] = backoff_schedule
ORACLES["backoff_schedule"] = """
    SELECT event_id, event_id % 8 + 1 AS attempt, least(2.0, 0.125 * pow(2, event_id % 8))::DOUBLE AS delay_seconds
    FROM events WHERE event_type IN ('error', 'purchase')"""

