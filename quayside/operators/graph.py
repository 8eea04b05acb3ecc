"""Dependency graphs: ``nodes(node_id, …)`` and ``edges(src, dst)``, where ``dst`` depends on ``src``.

All traversals work on whole frontiers. Runs of nodes with a single dependency are collapsed first by pointer
doubling, so a chain of n nodes costs log2(n) rounds instead of n; the frontier loop then only walks the
nodes that have several dependencies, and takes ``LEVELS`` levels of them in one round: each level reads the one before
once, so the plan of a round grows with its levels and not with their powers. A round writes one folder, which keeps
lineage short and survives lost executors; all folders are read by one scan. Walks carry the columns of their question
only. Distinct edges are written once (``prepared_edges``), so that joins know their size, and several walks over one
graph can share them.

``node_id`` may be a struct, so that many graphs (one per run, say) are walked in the same rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.contracts import BAD_STATES, SUCCESS_STATES
from quayside.session import materialize, scratch_path

LEVELS = 8  # of the graph that one round walks
PRIME = (1 << 61) - 1  # fingerprints that are carried down a graph are numbers modulo this
HALF = (1 << 31) - 1
_FACTOR = "_factor_of_edge"


def _modulo(number: Column) -> Column:
    """Of a number up to 2^63 - 1."""
    return F.pmod(number, F.lit(PRIME))


def _half(number: Column) -> Column:
    return number.bitwiseAND(HALF)


def _shifted(number: Column) -> Column:
    """2^31 times a number below 2^62 modulo 2^61 - 1, not fully reduced: a bit from the 61st on counts 61 places lower."""
    return F.shiftright(number, 30) + F.shiftleft(number.bitwiseAND((1 << 30) - 1), 31)


def _times(a: Column, b: Column) -> Column:
    """The product of two numbers below 2^61 by halves of 31 bits; no intermediate result passes 2^63."""
    high, low = F.shiftright(a, 31) * F.shiftright(b, 31), _half(a) * _half(b)
    middle = F.shiftright(a, 31) * _half(b) + _half(a) * F.shiftright(b, 31)
    return _modulo(high * 2 + _shifted(middle) + low)


def _plus(a: Column, b: Column) -> Column:
    """Of two numbers below 2^61."""
    return _modulo(a + b)


def _total(numbers: Column) -> Column:
    """The sum of a group's numbers below 2^61, added up by halves, which fit a LONG for up to 2^32 rows."""
    high, low = F.sum(F.shiftright(numbers, 31)), F.sum(_half(numbers))
    return _modulo(_shifted(_modulo(high)) + _modulo(low))


def short_hash(text: Column) -> Column:
    """60 bits of a text's hash as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def edge_factor(src: Column, dst: Column) -> Column:
    return short_hash(F.concat_ws(">", src.cast("string"), dst.cast("string"))) + 1


def undefined_references(references: DataFrame, defined: DataFrame) -> DataFrame:
    """References ``(owner, kind, name)`` to things that ``defined(kind, name)`` does not know.

    ``defined`` is not made distinct first: behind an aggregate AQE could not split a name that very many
    references share.
    """
    return references.join(defined.select("kind", "name"), ["kind", "name"], "left_anti").select(
        "owner", "kind", "name"
    )


def duplicate_keys(keys: DataFrame) -> DataFrame:
    """Keys ``(kind, key)`` that occur more than once, with their number."""
    return (
        keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def entry_mismatch(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Roots that are not declared as entries, and entries that are no root."""
    roots = nodes.select("node_id").join(
        edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti"
    )
    declared = entries.select("node_id")
    return roots.exceptAll(declared).select("node_id", F.lit("undeclared_root").alias("problem")).unionAll(
        declared.exceptAll(roots).select("node_id", F.lit("entry_is_no_root").alias("problem"))
    )


def prepared_edges(edges: DataFrame, factors: bool = True) -> DataFrame:
    """Distinct edges, with their ``factors`` in fingerprints if these are wanted, written once; edges that were prepared
    before stay as they are.

    Rows are dealt out before they are compared, because a table of few files is read by few tasks.
    """
    if _FACTOR in edges.columns:
        return edges
    path = scratch_path(edges.sparkSession, "edges")
    distinct = edges.select("src", "dst").repartition("src", "dst").distinct()
    factor = edge_factor(F.col("src"), F.col("dst")) if factors else F.lit(0).cast("long")
    return materialize(distinct.withColumn(_FACTOR, factor), path)[0]


@dataclass(frozen=True)
class _Carried:
    """What a walk carries: path lengths (``weight`` of nodes), ``marks`` (boolean columns of nodes) or ``numbers``
    (LONG columns of nodes) from which fingerprints are made."""

    paths: bool = False
    marks: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()

    def own(self) -> list[str]:
        """Columns of a node."""
        return (["weight"] if self.paths else []) + [*self.marks, *self.numbers]

    def of_node(self) -> dict[str, Column]:
        """A pointer over one dependency, which ends in the node itself; ``_FACTOR`` is that of the edge."""
        fields = {"hops": F.lit(1).cast("long"), "path_weight": F.col("weight")} if self.paths else {}
        fields |= {name: F.col(name) for name in self.marks}
        if self.numbers:
            fields |= {"factor": F.col(_FACTOR)} | {f"offset_{name}": F.col(name) for name in self.numbers}
        return fields

    def nothing(self) -> dict[str, Column]:
        """A pointer of no length."""
        fields = {"hops": F.lit(0).cast("long"), "path_weight": F.lit(0.0)} if self.paths else {}
        fields |= {name: F.lit(False) for name in self.marks}
        if self.numbers:
            fields |= {"factor": F.lit(1).cast("long")}
            fields |= {f"offset_{name}": F.lit(0).cast("long") for name in self.numbers}
        return fields

    def joined(self) -> dict[str, Column]:
        """A pointer behind another one, whose fields have a ``_`` in front."""
        fields = {name: F.col(name) + F.col(f"_{name}") for name in ("hops", "path_weight")} if self.paths else {}
        fields |= {name: F.col(name) | F.col(f"_{name}") for name in self.marks}
        if self.numbers:
            fields |= {"factor": _times(F.col("factor"), F.col("_factor"))}
            for name in self.numbers:
                behind = _times(F.col("factor"), F.col(f"_offset_{name}"))
                fields[f"offset_{name}"] = _plus(behind, F.col(f"offset_{name}"))
        return fields

    def over_edge(self) -> dict[str, Column]:
        """A pointer to a dependency, whose fields have a ``_`` in front, with the edge from it to a node."""
        empty = self.nothing()
        fields = {name: F.coalesce(F.col(f"_{name}"), empty[name]) for name in empty}
        if self.paths:
            fields["hops"] = fields["hops"] + 1
        for name in ["factor", *[f"offset_{number}" for number in self.numbers]] if self.numbers else []:
            fields[name] = _times(F.col(_FACTOR), fields[name])
        return fields


def _named(fields: dict[str, Column]) -> list[Column]:
    return [column.alias(name) for name, column in fields.items()]


@dataclass
class _Collapsed:
    """A graph whose single-dependency nodes have been folded into the node above them (their head).

    ``folded``: node_id, head and the pointer from one to the other. ``heads``: node_id, degree (0 or at least 2) and own
    columns. ``links``: head, dst, the pointer, degree and own columns of dst (marks are the pointer's); one per dependency
    of a head. ``endless``: folded nodes that hang on a loop of single dependencies, with their marks.

    Pointers have ``hops`` and ``path_weight`` (own weight included, the head's not), or marks (an origin lies on the
    path, the head not included), or say how the head's fingerprints become theirs: ``factor`` times it plus ``offset_…``.
    """

    folded: DataFrame
    heads: DataFrame
    links: DataFrame
    endless: DataFrame


def _collapse(nodes: DataFrame, edges: DataFrame, path: str, carried: _Carried) -> _Collapsed:
    """``nodes`` have the own columns of ``carried``; ``edges`` are prepared."""
    own, fields = carried.own(), list(carried.nothing())
    degrees = edges.groupBy("dst").agg(
        F.count(F.lit(1)).alias("degree"), F.min("src").alias("only_src"), F.min(_FACTOR).alias(_FACTOR)
    )
    described, _ = materialize(
        nodes.select("node_id", *own)
        .join(degrees, F.col("node_id") == F.col("dst"), "left")
        .select("node_id", *own, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), "only_src", _FACTOR),
        f"{path}/nodes",
    )
    heads = described.where(F.col("degree") != 1).select("node_id", "degree", *own)
    single = described.where(F.col("degree") == 1)

    # Whether a pointer already ends at a head is known by looking its target up among the single nodes.
    targets = single.select(F.col("node_id").alias("_target"), F.lit(True).alias("_open"))
    pointers, counts = materialize(
        single.join(targets, F.col("only_src") == F.col("_target"), "left").select(
            "node_id",
            F.col("only_src").alias("head"),
            *_named(carried.of_node()),
            F.coalesce("_open", F.lit(False)).alias("open"),
        ),
        f"{path}/pointers-0",
        rows=F.count(F.lit(1)),
        open=F.count_if(F.col("open")),
    )
    # Doubling ends every path of n nodes within log2(n) rounds; what is still open then runs in a loop.
    rounds = max(counts["rows"], 1).bit_length()
    step = 0
    while counts["open"] and step < rounds:
        step += 1
        above = pointers.select(
            F.col("node_id").alias("_above"), *[F.col(name).alias(f"_{name}") for name in ["head", *fields, "open"]]
        )
        jumped = pointers.where("open").join(above, F.col("head") == F.col("_above")).select(
            "node_id", F.col("_head").alias("head"), *_named(carried.joined()), F.col("_open").alias("open")
        )
        pointers, counts = materialize(
            pointers.where(~F.col("open")).unionByName(jumped),
            f"{path}/pointers-{step}",
            rows=F.count(F.lit(1)),
            open=F.count_if(F.col("open")),
        )
    folded = pointers.where(~F.col("open")).drop("open")
    # A loop's pointers have passed all nodes ahead of them by now, so marks cover the whole loop.
    endless = pointers.where("open").select("node_id", *carried.marks)

    empty = carried.nothing()
    looping = endless.select("node_id", F.col("node_id").alias("head"), *carried.marks, *_named(
        {name: column for name, column in empty.items() if name not in carried.marks}
    ))
    above = folded.unionByName(looping).select(
        F.col("node_id").alias("src"), *[F.col(name).alias(f"_{name}") for name in ["head", *fields]]
    )
    described_by = [name for name in own if name not in carried.marks]
    joining = heads.where(F.col("degree") >= 2).select(F.col("node_id").alias("dst"), "degree", *described_by)
    links, _ = materialize(
        edges.join(joining, "dst").join(above, "src", "left").select(
            F.coalesce("_head", "src").alias("head"), "dst", *_named(carried.over_edge()), "degree", *described_by
        ),
        f"{path}/links",
    )
    return _Collapsed(folded, heads, links, endless)


def _all_rounds(frame: DataFrame, paths: list[str]) -> DataFrame:
    """All written rounds, of the columns of ``frame``, by one scan."""
    return frame.sparkSession.read.schema(frame.schema).parquet(*paths)


NEWEST = 1  # nodes found or settled in the step before; those of earlier steps have 0, all others NULL


def _stage(name: str) -> str:
    return f"stage_{name}"


def _any(conditions: list[Column]) -> Column:
    return F.array_contains(F.array(*[F.coalesce(condition, F.lit(False)) for condition in conditions]), True)


def _onward(links: DataFrame, frontier: DataFrame, names: list[str]) -> DataFrame:
    """``node_id`` and stages of what ``LEVELS`` steps along ``links`` reach from ``frontier``, whose nodes are the newest
    of the sets of origins (``names``) that they were reached from; NULL for sets that don't reach a node. Only the newest
    nodes walk on. Steps don't count themselves, so that they all are the same code to Spark."""
    steps = links.select(F.col("head").alias("node_id"), "dst")
    stages = [_stage(name) for name in names]
    newest = _any([F.col(stage) == NEWEST for stage in stages])
    found = frontier.select("node_id", *stages)
    for _ in range(LEVELS):
        walked = found.alias("f").join(steps.alias("s"), (F.col("f.node_id") == F.col("s.node_id")) & newest, "left")
        here = F.struct(
            F.col("f.node_id").alias("node_id"), *[F.when(F.col(stage) >= 0, 0).alias(stage) for stage in stages]
        )
        next_ = F.struct(
            F.col("dst").alias("node_id"), *[F.when(F.col(stage) == NEWEST, NEWEST).alias(stage) for stage in stages]
        )
        both = F.when(F.col("dst").isNull(), F.array(here)).otherwise(F.array(here, next_))
        found = (
            walked.select(F.explode(both).alias("n"))
            .groupBy("n.node_id")
            .agg(*[F.min(f"n.{stage}").alias(stage) for stage in stages])
        )
    return found


def descendants(nodes: DataFrame, edges: DataFrame, origins: DataFrame) -> DataFrame:
    """The origins and everything that depends on them, directly or not: ``node_id``."""
    return descendants_of(nodes, edges, {"origin": origins}).select("node_id")


def descendants_of(nodes: DataFrame, edges: DataFrame, origins: dict[str, DataFrame]) -> DataFrame:
    """Several sets of origins by one walk: ``node_id`` and, under the name of each set, whether the node is one of its
    origins or depends on one. Nodes that no set leads to are left out."""
    path, names = scratch_path(nodes.sparkSession, "descendants"), list(origins)
    described = nodes.select("node_id")
    for name, frame in origins.items():
        described = described.join(frame.select("node_id").distinct().withColumn(name, F.lit(True)), "node_id", "left")
    described = described.select("node_id", *[F.coalesce(name, F.lit(False)).alias(name) for name in names])
    graph = _collapse(described, prepared_edges(edges, factors=False), path, _Carried(marks=tuple(names)))
    marked = _any([F.col(name) for name in names])
    # Heads to start from: origins themselves, and heads fed by a path on which an origin lies.
    frontier = (
        graph.heads.where(marked)
        .select("node_id", *names)
        .unionAll(graph.links.where(marked).select(F.col("dst").alias("node_id"), *names))
        .groupBy("node_id")
        .agg(*[F.min(F.when(F.col(name), NEWEST)).alias(_stage(name)) for name in names])
    )
    newest = _any([F.col(_stage(name)) == NEWEST for name in names])
    paths: list[str] = []
    while True:
        onward = _onward(graph.links, frontier, names)
        if paths:
            # What an earlier round reached from the same set is neither written again nor walked on from.
            known = reached.groupBy("node_id").agg(*[F.min(_stage(name)).alias(f"_{name}") for name in names])
            onward = onward.join(known, "node_id", "left").select(
                "node_id",
                *[F.when(F.col(f"_{name}").isNull(), F.col(_stage(name))).alias(_stage(name)) for name in names],
            ).where(F.coalesce(*map(_stage, names)).isNotNull())
        paths.append(f"{path}/reached-{len(paths)}")
        found, counts = materialize(onward, paths[-1], newest=F.count_if(newest))
        reached = _all_rounds(found, paths)
        if not counts["newest"]:
            break
        frontier = found.where(newest).select(
            "node_id", *[F.when(F.col(_stage(name)) == NEWEST, NEWEST).alias(_stage(name)) for name in names]
        )
    heads = reached.groupBy("node_id").agg(*[F.min(_stage(name)).isNotNull().alias(name) for name in names])
    below = graph.folded.join(
        heads.select(F.col("node_id").alias("head"), *[F.col(name).alias(f"_{name}") for name in names]), "head", "left"
    ).select("node_id", *[(F.col(name) | F.coalesce(f"_{name}", F.lit(False))).alias(name) for name in names])
    return heads.unionByName(below.where(marked)).unionByName(graph.endless.where(marked))


def unreachable(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entry leads to."""
    return nodes.select("node_id").join(descendants(nodes, edges, entries), "node_id", "left_anti")


def _settle(links: DataFrame, state: DataFrame, carried: _Carried) -> DataFrame:
    """``LEVELS`` steps of settling heads. ``state``: node_id, degree, own columns, seen (dependencies that have arrived),
    wave and best (the largest over those) or ``value_…`` (the sum of their fingerprints, each by its link), stage (NULL
    for heads that wait).

    A step joins the heads that settled in the step before with their links and adds up what arrives. Rows of a head
    itself are repeated by the join, so they are combined by their largest and only arrivals are added.
    """
    own, numbers = carried.own(), carried.numbers
    pointer = [name for name in carried.nothing() if name not in carried.marks]
    steps = links.select(
        F.col("head").alias("node_id"), "dst", *pointer, *[F.col(name).alias(f"dst_{name}") for name in ["degree", *own]]
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    carry = [*own, *(["wave", "best"] if carried.paths else []), *[f"value_{name}" for name in numbers]]
    kept = {name: F.col(name) for name in ["degree", "seen", *carry]} | {"arrived": zero}
    sent = {name: F.col(f"dst_{name}") for name in ["degree", *own]} | {"seen": zero, "arrived": F.lit(1).cast("long")}
    if carried.paths:
        total = F.col("best") + F.col("weight")
        sent |= {"wave": F.col("wave") + F.col("hops"), "best": total + F.col("path_weight")}
    for name in numbers:
        kept |= {f"handed_{name}": zero}
        sent |= {f"value_{name}": zero, f"handed_{name}": F.col(f"handed_{name}")}
    here = F.struct("node_id", *_named(kept), F.when(F.col("stage") >= 0, 0).alias("stage"))
    arrival = F.struct(F.col("dst").alias("node_id"), *[sent[name].alias(name) for name in kept], none.alias("stage"))
    rows = F.when(F.col("dst").isNull(), F.array(here)).otherwise(F.array(here, arrival))
    for _ in range(LEVELS):
        for name in numbers:
            state = state.withColumn(f"print_{name}", _plus(F.col(f"value_{name}"), F.col(name)))
        walked = (
            state.alias("f")
            .join(steps.alias("s"), (F.col("f.node_id") == F.col("s.node_id")) & (F.col("stage") == NEWEST), "left")
            .select("f.*", *[F.col(f"s.{name}") for name in steps.columns if name != "node_id"])
        )
        for name in numbers:
            handed = _plus(_times(F.col("factor"), F.col(f"print_{name}")), F.col(f"offset_{name}"))
            walked = walked.withColumn(f"handed_{name}", handed)
        merged = (
            walked.select(F.explode(rows).alias("n"))
            .groupBy("n.node_id")
            .agg(
                *[F.max(f"n.{name}").alias(name) for name in ["degree", *own]],
                (F.max("n.seen") + F.sum("n.arrived")).alias("seen"),
                *[F.max(f"n.{name}").alias(name) for name in (["wave", "best"] if carried.paths else [])],
                *[
                    _plus(F.max(f"n.value_{name}"), _total(F.col(f"n.handed_{name}"))).alias(f"value_{name}")
                    for name in numbers
                ],
                F.max("n.stage").alias("stage"),
            )
        )
        settled = F.when(F.col("stage").isNull() & (F.col("seen") == F.col("degree")), NEWEST)
        state = merged.withColumn("stage", F.coalesce("stage", settled))
    return state


def _settled_heads(graph: _Collapsed, path: str, carried: _Carried) -> DataFrame:
    """Every head whose dependencies run out: ``node_id`` with ``wave`` (the longest path to it in edges) and ``total`` (the
    largest sum of weights on a path to and including it), or ``print_…``, its fingerprints. A head is settled in the step
    in which its last dependency was; each link is used once."""
    zero = F.lit(0).cast("long")
    begun = {"seen": zero} | ({"wave": zero, "best": F.lit(0.0)} if carried.paths else {})
    begun |= {f"value_{name}": zero for name in carried.numbers} | {"stage": F.lit(NEWEST)}
    state = graph.heads.where(F.col("degree") == 0).select("*", *_named(begun))
    newest = F.count_if(F.col("stage") == NEWEST)
    paths: list[str] = []
    while True:
        paths.append(f"{path}/round-{len(paths)}")
        found, counts = materialize(_settle(graph.links, state, carried), paths[-1], newest=newest)
        if not counts["newest"]:
            break
        # Heads of the last step walk on; what still waits for dependencies goes with them.
        state = found.where(F.col("stage").isNull() | (F.col("stage") == NEWEST))
    # A head that settles in the last step of a round starts the next one, which writes it again as settled before.
    result = {"wave": F.col("wave"), "total": F.col("best") + F.col("weight")} if carried.paths else {}
    result |= {f"print_{name}": _plus(F.col(f"value_{name}"), F.col(name)) for name in carried.numbers}
    return _all_rounds(found, paths).where(F.col("stage") == 0).select("node_id", *_named(result))


def _below(graph: _Collapsed, heads: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Folded nodes, each with what ``fields`` make of its head's row, whose columns have a ``_`` in front."""
    above = [F.col(name).alias(f"_{name}") for name in heads.columns if name != "node_id"]
    joined = graph.folded.join(heads.select(F.col("node_id").alias("head"), *above), "head")
    return joined.select("node_id", *_named(fields))


def longest_paths(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Longest paths from the roots and the nodes that have none.

    First frame: ``node_id, wave, path_weight``: the number of edges on the longest path that ends in the
    node, and the largest sum of node weights along any path, own weight included. Second frame: nodes on a
    cycle or behind one, which never run out of open dependencies.
    """
    path, carried = scratch_path(nodes.sparkSession, "paths"), _Carried(paths=True)
    described = nodes.select("node_id", F.col("weight").cast("double").alias("weight"))
    graph = _collapse(described, prepared_edges(edges, factors=False), path, carried)
    heads = _settled_heads(graph, path, carried)
    below = {"wave": F.col("_wave") + F.col("hops"), "total": F.col("_total") + F.col("path_weight")}
    longest = heads.unionByName(_below(graph, heads, below)).withColumnRenamed("total", "path_weight")
    return longest, nodes.select("node_id").join(longest, "node_id", "left_anti")


def carried_fingerprints(nodes: DataFrame, edges: DataFrame, numbers: dict[str, str] | None = None) -> DataFrame:
    """``node_id, fingerprint`` over everything a node's result depends on: its ``own`` number (below 2^61, a hash of
    its definition and inputs) plus, for each dependency, that one's fingerprint times a factor that the edge's two ends
    give, modulo a prime. So a node's fingerprint changes with its own number, with that of any node above it and with
    any edge between them, but for a chance of about one in 2^60; nodes below no change keep theirs.

    ``numbers`` names several columns of own numbers, each with the column of its fingerprint; they are carried by one
    walk. Maps of this kind can be composed, so chains are folded by pointer doubling as for every other question here.
    Nodes on a cycle or behind one have no fingerprint and are left out.
    """
    numbers = numbers or {"own": "fingerprint"}
    path, carried = scratch_path(nodes.sparkSession, "fingerprints"), _Carried(numbers=tuple(numbers))
    described = nodes.select("node_id", *[_modulo(F.col(name).cast("long")).alias(name) for name in numbers])
    graph = _collapse(described, prepared_edges(edges), path, carried)
    heads = _settled_heads(graph, path, carried)
    below = {
        f"print_{name}": _plus(_times(F.col("factor"), F.col(f"_print_{name}")), F.col(f"offset_{name}"))
        for name in numbers
    }
    return heads.unionByName(_below(graph, heads, below)).withColumnsRenamed(
        {f"print_{name}": print_ for name, print_ in numbers.items()}
    )


def topological_waves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, wave``. Sorted by wave and id it is a legal order of execution."""
    return longest_paths(nodes.withColumn("weight", F.lit(0.0)), edges)[0].select("node_id", "wave")


def cyclic_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that can never start because a cycle lies on the way."""
    return longest_paths(nodes.withColumn("weight", F.lit(0.0)), edges)[1]


def critical_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, path_weight``; the largest value is the length of the whole run."""
    return longest_paths(nodes, edges)[0].select("node_id", "path_weight")


def dependency_records(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Each dependency with the record of the node it names; ``known`` is false where there is none."""
    upstream = records.select(F.col("node_id").alias("src"), "status", "digest", "row_count")
    return edges.join(upstream, "src", "left").select(
        F.col("dst").alias("node_id"),
        F.col("src").alias("dependency"),
        "status",
        "digest",
        "row_count",
        F.col("status").isNotNull().alias("known"),
    )


def trigger_rollup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What each node may do, given the states of its dependencies.

    ``nodes``: node_id, status, trigger, condition_value and condition_expected (both NULL where the node has
    no condition). The result is RUN, BLOCKED or SKIPPED_CONDITION.
    """
    states = nodes.select(F.col("node_id").alias("src"), "status")
    status = F.col("status")
    rollup = (
        edges.select("src", "dst")
        .join(states, "src", "left")
        .groupBy(F.col("dst").alias("node_id"))
        .agg(
            F.count(F.lit(1)).alias("dependencies"),
            F.count_if(status.isin(*SUCCESS_STATES)).alias("succeeded"),
            F.count_if(status.isin("FAILED", "TIMED_OUT", "BLOCKED")).alias("failed"),
            F.count_if(status == "TIMED_OUT").alias("timed_out"),
            F.count_if(status.isin(*BAD_STATES)).alias("bad"),
        )
    )
    counts = ["dependencies", "succeeded", "failed", "timed_out", "bad"]
    joined = (
        nodes.select("node_id", "trigger", "condition_value", "condition_expected")
        .join(rollup, "node_id", "left")
        .na.fill(0, counts)
    )
    return joined.select("node_id", "trigger", *counts, _decision().alias("decision"))


def _decision() -> Column:
    kind = F.col("trigger")
    matched = (
        F.when(kind == "all_success", F.col("succeeded") == F.col("dependencies"))
        .when(kind == "any_success", F.col("succeeded") > 0)
        .when(kind == "all_done", F.lit(True))
        .when(kind == "any_failed", F.col("failed") > 0)
        .when(kind == "any_timed_out", F.col("timed_out") > 0)
    )
    blocked = kind.isin("all_success", "any_success") & (F.col("bad") > 0)
    refused = F.col("condition_expected").isNotNull() & ~F.col("condition_value").eqNullSafe(
        F.col("condition_expected")
    )
    return (
        F.when(matched.isNull(), "INVALID_TRIGGER")
        .when(~matched, F.when(blocked, "BLOCKED").otherwise("SKIPPED_CONDITION"))
        .when(refused, "SKIPPED_CONDITION")
        .otherwise("RUN")
    )


def lineage_manifest(nodes: DataFrame, edges: DataFrame, waves: DataFrame) -> DataFrame:
    """The graph as published: one row per node and dependency (one with NULL for a root), with the policies
    of the node and its wave. Rows instead of lists, because a node may have any number of dependencies."""
    pairs = edges.select(F.col("dst").alias("node_id"), F.col("src").alias("dependency")).distinct()
    described = nodes.join(waves, "node_id", "left")
    # Inner and anti join instead of one outer join, whose inner side AQE could not split.
    roots = described.join(pairs, "node_id", "left_anti")
    return pairs.join(described, "node_id").unionByName(roots, allowMissingColumns=True)
