"""Questions over the append-only event ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.contracts import BAD_STATES, CLOSING_RUN_STATES, ENTITY_KEY, OPEN_RUN_STATES, TERMINAL_STATES
from quayside.errors import DataFailure
from quayside.functions.digest import dataset_digest
from quayside.operators import ordered

# --- fixed values: legal moves of a node, and what only certain events may do ------------------
LEGAL_MOVES = [
    "PENDING>READY",
    "FAILED>READY",
    "TIMED_OUT>READY",
    "READY>RUNNING",
    "RUNNING>SUCCEEDED",
    "RUNNING>FAILED",
    "RUNNING>TIMED_OUT",
    "READY>FAILED",
    "READY>TIMED_OUT",
    "PENDING>SKIPPED_ALREADY_SATISFIED",
    "PENDING>SKIPPED_CONDITION",
    "PENDING>BLOCKED",
    "PENDING>CANCELLED",
    "READY>CANCELLED",
]
PUBLIC_FIELDS = [
    "application_id",
    "dag_id",
    "dag_version",
    "run_id",
    "node_id",
    "attempt",
    "status",
    "previous_status",
    "started_at",
    "ended_at",
    "duration_seconds",
    "configuration_version",
    "code_version",
    "retry_count",
    "restart_mode",
    "configuration_fingerprint",
    "execution_uncertain",
    "plan",
]
HIDDEN_EVENTS = ["NODE_CREATED", "REMOTE_RUN_SUBMITTED"]


def decoded(events: DataFrame, payload_schema: str) -> DataFrame:
    """Events with the payload parsed against an explicit schema; fields it does not name are never read."""
    return events.withColumn("payload", F.from_json("payload", payload_schema))


# Rows of one scope that share a join task at most; the sequence number is unique in its scope.
SPREAD = 1 << 20


def _marks(watermarks: DataFrame) -> DataFrame:
    """Watermarks repeated once per stretch of the sequence they cover, so that the join with the events of
    a large scope meets many small keys instead of one large one. Short scopes keep a single row."""
    stretches = F.sequence(F.lit(0).cast("long"), _stretch(F.col("sequence")))
    return watermarks.select("scope", F.col("sequence").alias("_seen"), F.explode(stretches).alias("_stretch"))


def _stretch(sequence: Column) -> Column:
    return ((sequence - F.pmod(sequence, F.lit(SPREAD))) / SPREAD).cast("long")


def _stretched(events: DataFrame) -> DataFrame:
    return events.withColumn("_stretch", _stretch(F.col("sequence")))


def suffix(events: DataFrame, watermarks: DataFrame, how: str = "left") -> DataFrame:
    """Events behind each scope's watermark. A scope without a watermark is new and comes whole, or, with an ``inner``
    join, not at all.

    Events in a stretch beyond the watermark's own find no mark and are new by that alone.
    """
    marked = _stretched(events).join(_marks(watermarks), ["scope", "_stretch"], "left")
    if how == "inner":
        marked = marked.join(watermarks.select("scope"), "scope", "left_semi")
    return marked.where(F.col("_seen").isNull() | (F.col("sequence") > F.col("_seen"))).drop("_seen", "_stretch")


def assign_sequence(existing: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """``batch`` with the sequence numbers that follow each scope's newest committed one.

    ``order`` numbers the batch from 0 up. The committed maximum takes part as one row ahead of the batch, so
    no join with the batch is needed.
    """
    committed = existing.groupBy("scope").agg(F.max("sequence").alias("_step"))
    steps = batch.withColumns({"_step": F.lit(1).cast("long"), "_at": order.cast("long")}).unionByName(
        committed.withColumn("_at", F.lit(-1).cast("long")), allowMissingColumns=True
    )
    numbered = ordered.running_sum(steps, ["scope"], F.col("_at"), F.col("_step"), "sequence")
    return numbered.where(F.col("_at") >= 0).drop("_step", "_at")


def integrity(events: DataFrame) -> DataFrame:
    """Per scope: is the sequence exactly 1 … n? Repeats, holes and values below 1 are counted.

    Counting distinct (scope, sequence) pairs first spreads a large scope over all tasks.
    """
    pairs = events.groupBy("scope", "sequence").agg(F.count(F.lit(1)).alias("copies"))
    counted = pairs.groupBy("scope").agg(
        F.sum("copies").alias("events"),
        F.sum(F.col("copies") - 1).alias("repeated"),
        F.count_if((F.col("sequence") < 1) | F.col("sequence").isNull()).alias("invalid"),
        F.count_if(F.col("sequence") >= 1).alias("_valid"),
        F.coalesce(F.max("sequence"), F.lit(0)).alias("last_sequence"),
    )
    missing = F.greatest(F.col("last_sequence") - F.col("_valid"), F.lit(0).cast("long"))
    return counted.select(
        "scope", "events", "repeated", "invalid", missing.alias("missing"), "last_sequence"
    ).withColumn("intact", (F.col("repeated") == 0) & (F.col("invalid") == 0) & (F.col("missing") == 0))


def require_intact(events: DataFrame) -> None:
    """Refuse a ledger whose numbering is repeated or incomplete."""
    if not integrity(events).where(~F.col("intact")).isEmpty():
        raise DataFailure("AUDIT_CORRUPTION", "An event sequence repeats or has a hole.", "CONFIGURATION")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """Every hole as (scope, first missing, last missing)."""
    numbers = events.where(F.col("sequence") >= 1).select("scope", "sequence").distinct()
    before = ordered.previous(numbers, ["scope"], F.col("sequence"), F.col("sequence"), "_before")
    known = F.coalesce(F.col("_before"), F.lit(0))
    return before.where(F.col("sequence") > known + 1).select(
        "scope", (known + 1).alias("first_missing"), (F.col("sequence") - 1).alias("last_missing")
    )


def prefix_proof(events: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Digest of each scope's events up to its watermark. Equal proofs mean unchanged history."""
    prefix = (
        _stretched(events)
        .join(_marks(watermarks), ["scope", "_stretch"])
        .where(F.col("sequence") <= F.col("_seen"))
        .drop("_seen", "_stretch")
    )
    return dataset_digest(prefix, "scope")


def changed_history(remembered: DataFrame, current: DataFrame) -> DataFrame:
    """Scopes whose committed events no longer match the remembered proof."""
    kept = remembered.withColumn("_proof", F.struct("row_count", "sum_0", "sum_1", "sum_2", "sum_3"))
    now = current.withColumn("_now", F.struct("row_count", "sum_0", "sum_1", "sum_2", "sum_3"))
    return (
        kept.select("scope", "_proof")
        .join(now.select("scope", "_now"), "scope", "left")
        .where(~F.col("_proof").eqNullSafe(F.col("_now")))
        .select("scope")
    )


def latest(events: DataFrame) -> DataFrame:
    """Newest event per entity; parts of the entity's key may be NULL, and NULL is one value.

    One pass: each task hands on one event per entity, so an entity with most of the ledger's events is no hot key. Of
    events that repeat a sequence number the one with the largest hash of its columns is kept.
    """
    rest = [name for name in events.columns if name not in ENTITY_KEY]
    place = F.struct("sequence", F.xxhash64(*events.columns))
    newest = events.groupBy(*ENTITY_KEY).agg(F.max_by(F.struct(*rest), place).alias("_newest"))
    return newest.select(*[F.col(name if name in ENTITY_KEY else f"_newest.{name}") for name in events.columns])


def nodes_of(events: DataFrame) -> DataFrame:
    """The events of nodes; ledgers hold those of runs and of the outbox too."""
    return events.where(F.col("entity_type") == "node")


def latest_run(runs: DataFrame) -> DataFrame:
    """Per scope the run with the highest attempt, and the number the next run would get."""
    rest = [name for name in runs.columns if name != "scope"]
    return (
        runs.groupBy("scope")
        .agg(
            F.max_by(F.struct(*rest), F.col("attempt")).alias("_newest"),
            (F.count(F.lit(1)) + 1).alias("next_attempt"),
        )
        .select("scope", "_newest.*", "next_attempt")
    )


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events that move an entity along no legal pair.

    A node starts with NODE_CREATED; only a remote submission may keep the status; reconciliation may cancel what is
    unfinished or uncertain. A run starts once, and is finished or reconciled while it is open. An outbox entry is
    committed once and may then be refreshed. Events of any other kind of entity are illegal.
    """
    before = F.struct("status", "execution_uncertain")
    moved = ordered.previous(events, ENTITY_KEY, F.col("sequence"), before, "_before")
    was = F.col("_before.status")
    kind, now = F.col("event_type"), F.col("status")
    reconciled = (
        (kind == "ATTEMPT_RECONCILED")
        & (now == "CANCELLED")
        & (~was.isin(*TERMINAL_STATES) | F.col("_before.execution_uncertain"))
    )
    node = (
        F.when(was.isNull(), (kind == "NODE_CREATED") & (now == "PENDING"))
        .when(kind == "REMOTE_RUN_SUBMITTED", was == now)
        .when(kind == "ATTEMPT_RECONCILED", reconciled)
        .otherwise(F.concat_ws(">", was, now).isin(*LEGAL_MOVES))
    )
    first = F.col("_before").isNull()
    run = (
        F.when(kind == "RUN_STARTED", first & (now == "RUNNING"))
        .when(kind == "RUN_FINISHED", (was == "RUNNING") & now.isin(*CLOSING_RUN_STATES))
        .when(kind == "RUN_RECONCILED", was.isin(*OPEN_RUN_STATES) & (now == "FAILED"))
    )
    outbox = F.when(kind == "OUTBOX_COMMITTED", first).when(kind == "OUTBOX_REFERENCE_REFRESHED", ~first)
    entity = F.col("entity_type")
    legal = F.when(entity == "node", node).when(entity == "run", run).when(entity == "outbox", outbox)
    return moved.where(~F.coalesce(legal, F.lit(False))).select(
        *ENTITY_KEY, "sequence", "event_type", was.alias("previous_status"), now.alias("status")
    )


def state_timeline(events: DataFrame) -> DataFrame:
    """How long each state of each node held: valid from this event's sequence up to the one before
    ``until_sequence`` (NULL while it still holds). One row per event of a node, whatever the number of nodes."""
    return ordered.previous(
        nodes_of(events),
        ["scope", "run_id", "node_id"],
        -F.col("sequence"),
        F.col("sequence"),
        "until_sequence",
    ).select("scope", "run_id", "node_id", "sequence", "until_sequence", "status", "attempt")


def run_timeline(events: DataFrame) -> DataFrame:
    """After each event of a run's nodes: how many nodes are running, and which node was the last to finish.

    The count is a running total of the moves into and out of RUNNING, so no event is paired with all nodes. Nodes
    belong to their run, so a run that starts anew under its own id starts from nothing.
    """
    moved = ordered.previous(
        nodes_of(events), ["scope", "run_id", "node_id"], F.col("sequence"), F.struct("status"), "_before"
    )
    run = ["scope", "run_id"]
    now = F.col("status").eqNullSafe("RUNNING").cast("long")
    before = F.col("_before.status").eqNullSafe("RUNNING").cast("long")
    finished = F.when(F.col("status").isin(*TERMINAL_STATES), F.col("node_id"))
    narrow = moved.select(*run, "sequence", "node_id", "status", (now - before).alias("_move"), finished.alias("_end"))
    return ordered.sum_and_last(
        narrow, run, F.col("sequence"), F.col("_move"), F.col("_end"), ("running_nodes", "last_finished")
    ).select(*run, "sequence", "node_id", "status", "running_nodes", "last_finished")


def state_at(events: DataFrame, sequence: int) -> DataFrame:
    """State of every node once the event ``sequence`` of its scope was written."""
    return latest(events.where(F.col("sequence") <= sequence))


def public_events(events: DataFrame, include_run_key: bool = True, replay_only: bool = True) -> DataFrame:
    """What may leave the job: allowlisted fields, and of an error only its category and code. A replay shows
    runs and nodes and leaves out creations and remote submissions; a log shows every event."""
    fields = [name for name in PUBLIC_FIELDS if name not in ("run_id", "node_id")]
    if include_run_key:
        fields.append("business_run_key")
    schema = ", ".join(f"{name} {_FIELD_TYPES.get(name, 'STRING')}" for name in fields)
    schema += ", error STRUCT<category: STRING, code: STRING>"
    replayed = F.col("entity_type").isin("run", "node") & ~F.col("event_type").isin(*HIDDEN_EVENTS)
    shown = events.where(replayed) if replay_only else events
    message = F.from_json("payload", schema)
    return shown.select(
        "scope",
        "sequence",
        "run_id",
        "node_id",
        "event_type",
        "timestamp",
        message.alias("_message"),
    ).select(
        "scope",
        "sequence",
        "run_id",
        "node_id",
        "event_type",
        "timestamp",
        *[F.col(f"_message.{name}").alias(name) for name in fields],
        F.col("_message.error.category").alias("error_category"),
        F.col("_message.error.code").alias("error_code"),
    )


_FIELD_TYPES = {
    "attempt": "LONG",
    "retry_count": "LONG",
    "duration_seconds": "DOUBLE",
    "execution_uncertain": "BOOLEAN",
    "plan": "ARRAY<STRING>",
}


def late_success(events: DataFrame) -> DataFrame:
    """Finished attempts, where a success after its deadline counts as timed out and loses its outputs."""
    late = (F.col("status") == "SUCCEEDED") & (F.col("ended_us") > F.col("deadline_us"))
    cleared = {
        name: F.when(~late, F.col(name)) for name in ("outputs", "checkpoint") if name in events.columns
    }
    return events.where(F.col("event_type") == "ATTEMPT_FINISHED").withColumns(
        {
            **cleared,
            "retryable": F.when(late, True).otherwise(F.coalesce(F.col("retryable"), F.lit(False))),
            "error_category": F.when(late, "TIMEOUT").otherwise(F.col("error_category")),
            "error_code": F.when(late, "DEADLINE_EXCEEDED").otherwise(F.col("error_code")),
            "status": F.when(late, "TIMED_OUT").otherwise(F.col("status")),
        }
    )


def exact_seconds(total: Column) -> Column:
    """Sum of durations in microseconds, so the result does not depend on the order of addition."""
    return F.sum(F.round(total * 1_000_000).cast("decimal(38,0)")) / F.lit(1_000_000)


def node_active_time(events: DataFrame) -> DataFrame:
    """Seconds each node worked, over all its attempts."""
    return (
        events.where(F.col("event_type") == "ATTEMPT_FINISHED")
        .groupBy("scope", "run_id", "node_id")
        .agg(
            exact_seconds(F.col("duration_seconds")).cast("double").alias("active_seconds"),
            F.count(F.lit(1)).alias("attempts"),
        )
    )


# --- fixed values: the counts of a run summary and the states they cover -----------------------
STATE_COUNTS = {
    "successful_nodes": ["SUCCEEDED"],
    "skipped_nodes": ["SKIPPED_ALREADY_SATISFIED", "SKIPPED_CONDITION"],
    "skipped_already_satisfied": ["SKIPPED_ALREADY_SATISFIED"],
    "skipped_condition": ["SKIPPED_CONDITION"],
    "failed_nodes": ["FAILED"],
    "timed_out_nodes": ["TIMED_OUT"],
    "blocked_nodes": ["BLOCKED"],
    "cancelled_nodes": ["CANCELLED"],
    "pending_nodes": ["PENDING"],
    "ready_nodes": ["READY"],
    "running_nodes": ["RUNNING"],
}


def run_summary(nodes: DataFrame) -> DataFrame:
    """Counts per state, run status and advice per run, over the latest node records."""
    counted = nodes.groupBy("scope", "run_id").agg(
        F.count(F.lit(1)).alias("total_nodes"),
        *[F.count_if(F.col("status").isin(*states)).alias(name) for name, states in STATE_COUNTS.items()],
        F.count_if(F.col("attempt") > 1).alias("retried_nodes"),
        F.bool_or("execution_uncertain").alias("_uncertain"),
        F.bool_or(F.col("critical") & F.col("status").isin(*BAD_STATES)).alias("_failed"),
    )
    status = (
        F.when(F.col("_uncertain"), "RECOVERY_REQUIRED").when(F.col("_failed"), "FAILED").otherwise("SUCCEEDED")
    )
    advice = (
        F.when(F.col("status") == "RECOVERY_REQUIRED", "reconcile")
        .when(F.col("status") == "FAILED", "remediate_and_resume")
        .otherwise("dispatch_outbox")
    )
    return (
        counted.withColumn("status", status)
        .withColumn("recommended_action", advice)
        .drop("_uncertain", "_failed")
    )


def run_failures(nodes: DataFrame) -> DataFrame:
    """One row per node in a bad state. A list inside the run row could grow without bound."""
    return nodes.where(F.col("status").isin(*BAD_STATES)).select(
        "scope", "run_id", "node_id", "status", "error_category", "error_code"
    )


def open_runs(nodes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run: nodes that are not finished and nodes that need reconciliation.

    With ``runs`` (latest run records) the result also tells open runs, where a new run must be refused,
    from closed runs that still hold unfinished nodes.
    """
    unfinished = ~F.col("status").isin(*TERMINAL_STATES)
    counted = nodes.groupBy("scope", "run_id").agg(
        F.count_if(unfinished).alias("unfinished_nodes"),
        F.count_if(unfinished | F.col("execution_uncertain")).alias("to_reconcile"),
    )
    if runs is None:
        return counted.where((F.col("unfinished_nodes") > 0) | (F.col("to_reconcile") > 0))
    is_open = F.col("run_status").isin(*OPEN_RUN_STATES)
    return (
        runs.select("scope", "run_id", F.col("status").alias("run_status"))
        .join(counted, ["scope", "run_id"], "left")
        .na.fill(0, ["unfinished_nodes", "to_reconcile"])
        .withColumn("open", is_open)
        .withColumn("closed_unfinished", ~is_open & (F.col("unfinished_nodes") > 0))
    )


def overlapping_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts of one node that began before the attempt ahead of them had ended."""
    before = ordered.previous(
        attempts, ["scope", "node_id"], F.col("sequence"), F.col("ended_us"), "previous_ended_us"
    )
    return before.where(F.col("started_us") < F.col("previous_ended_us")).select(
        "scope", "node_id", "sequence", "started_us", "previous_ended_us"
    )


def peak_usage(intervals: DataFrame, group: list[str], demand: str = "demand") -> DataFrame:
    """Highest summed demand of simultaneously running intervals [started_us, ended_us) per group. An interval
    without an end is still running and only begins.

    Changes at the same microsecond are added up first. Time is cut at quantiles of the changes, so a task sorts about
    as many of them whatever the share of a group. Each stretch is reduced to its sum and its own highest point, and the
    sums ahead of it then raise that point: rows are shuffled twice, and one row per stretch a third time.
    """
    edge = F.explode(
        F.array(
            F.struct(F.col("started_us").alias("at_us"), F.col(demand).alias("change")),
            F.struct(F.col("ended_us").alias("at_us"), (-F.col(demand)).alias("change")),
        )
    )
    edges = (
        intervals.where(F.col("ended_us").isNull() | (F.col("started_us") < F.col("ended_us")))
        .select(*group, edge.alias("_edge"))
        .select(*group, F.col("_edge.at_us").cast("long").alias("at_us"), "_edge.change")
        .where(F.col("at_us").isNotNull())
    )
    stretch = [*group, "_stretch"]
    changes = (
        edges.withColumn("_stretch", ordered.quantile_segments(edges, "at_us"))
        .groupBy(*stretch, "at_us")
        .agg(F.sum("change").alias("change"))
    )
    inside = Window.partitionBy(*stretch).orderBy("at_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    highest = F.max(F.struct(F.col("_in_use").alias("in_use"), (-F.col("at_us")).alias("back")))
    points = (
        changes.withColumn("_in_use", F.sum("change").over(inside))
        .groupBy(*stretch)
        .agg(F.sum("change").alias("_sum"), highest.alias("_high"))
    )
    ahead = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    raised = points.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).select(
        *group, F.struct((F.col("_high.in_use") + F.col("_ahead")).alias("in_use"), F.col("_high.back").alias("back")).alias("_high")
    )
    return (
        raised.groupBy(*group)
        .agg(F.max("_high").alias("_high"))
        .select(*group, F.col("_high.in_use").alias("peak"), (-F.col("_high.back")).alias("first_peak_us"))
    )


def control_notices(summaries: DataFrame) -> DataFrame:
    """One notice per run and kind: failures, timeouts, and completion of every run that is over."""
    over = (F.col("pending_nodes") + F.col("ready_nodes") + F.col("running_nodes")) == 0
    kinds = F.array_compact(
        F.array(
            F.when(F.col("failed_nodes") + F.col("blocked_nodes") > 0, "failure"),
            F.when(F.col("timed_out_nodes") > 0, "timeout"),
            F.when(over, "completed"),
        )
    )
    return summaries.select("scope", "run_id", F.explode(kinds).alias("kind"))


def resource_usage(intervals: DataFrame, group: list[str], capacities: DataFrame) -> DataFrame:
    """Peak demand per group and resource against its capacity. ``intervals`` carries ``resources``, a map of
    resource to demand; ``capacities`` has one row per resource."""
    demands = intervals.select(*group, "started_us", "ended_us", F.explode("resources").alias("resource", "demand"))
    peaks = peak_usage(demands, [*group, "resource"])
    return peaks.join(capacities, "resource", "left").withColumn(
        "exceeded", F.coalesce(F.col("peak") > F.col("capacity"), F.lit(True))
    )
