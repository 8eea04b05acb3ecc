from __future__ import annotations

import random

import pytest

from quayside.operators import graph


def frames(spark, count, edges):
    nodes = spark.createDataFrame([(n, float(n % 7 + 1)) for n in range(count)], "node_id long, weight double")
    return nodes, spark.createDataFrame(sorted(edges), "src long, dst long")


def brute(count, edges):
    """Waves, path weights and stuck nodes by plain relaxation in dependency order."""
    below = {n: set() for n in range(count)}
    for src, dst in edges:
        below[dst].add(src)
    wave, weight = {}, {}
    progress = True
    while progress:
        progress = False
        for n in range(count):
            if n not in wave and below[n] <= wave.keys():
                wave[n] = 1 + max((wave[s] for s in below[n]), default=-1)
                weight[n] = n % 7 + 1 + max((weight[s] for s in below[n]), default=0)
                progress = True
    return wave, weight, set(range(count)) - wave.keys()


def reach(edges, origins):
    found, todo = set(origins), list(origins)
    while todo:
        node = todo.pop()
        for src, dst in edges:
            if src == node and dst not in found:
                found.add(dst)
                todo.append(dst)
    return found


def check(spark, count, edges, origins):
    nodes, links = frames(spark, count, edges)
    wave, weight, stuck = brute(count, edges)
    paths, blocked = graph.longest_paths(nodes, links)
    got = {r.node_id: (r.wave, r.path_weight) for r in paths.collect()}
    assert got == {n: (wave[n], weight[n]) for n in wave}
    assert {r.node_id for r in blocked.collect()} == stuck
    start = spark.createDataFrame([(n,) for n in origins], "node_id long")
    rows = [r.node_id for r in graph.descendants(nodes, links, start).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == reach(edges, origins)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_acyclic(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(d), d) for d in range(1, 60) for _ in range(rng.choice([0, 1, 1, 2]))}
    check(spark, 60, edges, rng.sample(range(60), 3))


def test_random_with_cycles(spark):
    rng = random.Random(5)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45)}
    check(spark, 40, edges, [3, 17])


def test_loop_of_single_dependencies_and_what_hangs_on_it(spark):
    edges = {(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 6), (4, 6), (6, 7)}
    check(spark, 8, edges, [1])
    check(spark, 8, edges, [5])
    check(spark, 8, edges, [])


def test_long_chain_takes_few_rounds(spark):
    """5,000 nodes in a row, then a join of two branches."""
    count = 5000
    edges = [(n, n + 1) for n in range(count - 1)] + [(0, count), (count - 1, count)]
    nodes, links = frames(spark, count + 1, edges)
    waves = graph.topological_waves(nodes, links)
    assert waves.agg({"wave": "max"}).first()[0] == count
    start = spark.createDataFrame([(2500,)], "node_id long")
    assert graph.descendants(nodes, links, start).count() == count + 1 - 2500


def test_unreachable_and_entries(spark):
    nodes, links = frames(spark, 5, {(0, 1), (2, 3)})
    entries = spark.createDataFrame([(0,), (1,)], "node_id long")
    assert {r.node_id for r in graph.unreachable(nodes, links, entries).collect()} == {2, 3, 4}
    problems = {tuple(r) for r in graph.entry_mismatch(nodes, links, entries).collect()}
    assert problems == {(2, "undeclared_root"), (4, "undeclared_root"), (1, "entry_is_no_root")}


@pytest.mark.parametrize(
    "trigger, states, decision",
    [
        ("all_success", ["SUCCEEDED", "SKIPPED_ALREADY_SATISFIED"], "RUN"),
        ("all_success", ["SUCCEEDED", "FAILED"], "BLOCKED"),
        ("any_success", ["SUCCEEDED", "SKIPPED_CONDITION"], "RUN"),
        ("all_success", ["SUCCEEDED", "SKIPPED_CONDITION"], "SKIPPED_CONDITION"),
        ("any_failed", ["FAILED", "SUCCEEDED"], "RUN"),
        ("any_timed_out", ["TIMED_OUT", "SUCCEEDED"], "RUN"),
        ("all_done", ["CANCELLED", "BLOCKED"], "RUN"),
        ("any_failed", ["CANCELLED", "SUCCEEDED"], "SKIPPED_CONDITION"),
        ("any_success", ["CANCELLED", "SKIPPED_CONDITION"], "BLOCKED"),
        ("all_success", [], "RUN"),
        ("any_success", [], "SKIPPED_CONDITION"),
    ],
)
def test_triggers(spark, trigger, states, decision):
    rows = [(0, None, trigger, None, None)] + [(i + 1, s, "all_done", None, None) for i, s in enumerate(states)]
    nodes = spark.createDataFrame(
        rows, "node_id long, status string, trigger string, condition_value string, condition_expected string"
    )
    edges = spark.createDataFrame([(i + 1, 0) for i in range(len(states))], "src long, dst long")
    got = {r.node_id: r.decision for r in graph.trigger_rollup(nodes, edges).collect()}
    assert got[0] == decision


def test_condition_can_skip(spark):
    nodes = spark.createDataFrame(
        [(0, None, "all_done", "on", "on"), (1, None, "all_done", "off", "on"), (2, None, "all_done", None, "on")],
        "node_id long, status string, trigger string, condition_value string, condition_expected string",
    )
    edges = spark.createDataFrame([], "src long, dst long")
    got = {r.node_id: r.decision for r in graph.trigger_rollup(nodes, edges).collect()}
    assert got == {0: "RUN", 1: "SKIPPED_CONDITION", 2: "SKIPPED_CONDITION"}


def test_ladder_walks_many_levels_a_round(spark, monkeypatch):
    """200 levels of two nodes that depend on both of the level above."""
    edges = {(2 * (d - 1) + a, 2 * d + b) for d in range(1, 201) for a in (0, 1) for b in (0, 1)}
    nodes, links = frames(spark, 402, edges)
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda frame, path, *a, **k: (written.append(path), plain(frame, path, *a, **k))[1])
    paths, stuck = graph.longest_paths(nodes, links)
    assert {r.node_id: r.wave for r in paths.collect()} == {n: n // 2 for n in range(402)}
    assert stuck.isEmpty() and len(written) <= 40
    written.clear()
    start = spark.createDataFrame([(100,)], "node_id long")
    assert {r.node_id for r in graph.descendants(nodes, links, start).collect()} == {100, *range(102, 402)}
    assert len(written) <= 40


def test_ring_needs_log_rounds(spark, monkeypatch):
    edges = {(n, (n + 1) % 200) for n in range(200)}
    nodes, links = frames(spark, 200, edges)
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda frame, path, *a, **k: (written.append(path), plain(frame, path, *a, **k))[1])
    start = spark.createDataFrame([(7,)], "node_id long")
    assert {r.node_id for r in graph.descendants(nodes, links, start).collect()} == set(range(200))
    assert len(written) <= 14
    assert {r.node_id for r in graph.cyclic_nodes(nodes, links).collect()} == set(range(200))


def plain_prints(count, edges, own, factor):
    above = {n: [s for s, d in edges if d == n] for n in range(count)}
    done = {}
    while len(done) < count:
        ready = [n for n in range(count) if n not in done and all(s in done for s in above[n])]
        if not ready:
            return done
        for n in ready:
            done[n] = (own[n] + sum(factor[s, n] * done[s] for s in above[n])) % graph.PRIME
    return done


@pytest.mark.parametrize("levels", [2, 8])
def test_carried_fingerprints(spark, monkeypatch, levels):
    monkeypatch.setattr(graph, "LEVELS", levels)
    rng = random.Random(5)
    edges = {(rng.randrange(d), d) for d in range(1, 50) for _ in range(rng.choice([0, 1, 1, 3]))}
    edges |= {(n, n + 1) for n in range(50, 69)} | {(70, 71), (71, 70), (71, 72)}
    own = {n: rng.randrange(1 << 60) for n in range(73)}
    links = spark.createDataFrame(sorted(edges), "src long, dst long")
    pairs = links.select("src", "dst", graph.edge_factor(links.src, links.dst).alias("f")).collect()
    factor = {(r.src, r.dst): r.f for r in pairs}

    def prints(own):
        nodes = spark.createDataFrame(sorted(own.items()), "node_id long, own long")
        return {r.node_id: r.fingerprint for r in graph.carried_fingerprints(nodes, links).collect()}

    first = prints(own)
    assert first == plain_prints(73, edges, own, factor) and set(first) == set(range(70))
    second = prints({**own, 3: own[3] + 1, 60: 0})
    assert {n for n in first if first[n] != second[n]} == reach(edges, [3, 60])


def test_graphs_of_many_runs_are_walked_together(spark):
    from quayside.operators import runs

    nodes = [(s, r, n) for s, r in (("a", "1"), ("a", "2"), ("b", "1")) for n in "wxyz" if (s, n) != ("b", "y")]
    active = [("a", "1", "w", 1.0), ("a", "1", "y", 2.5), ("a", "2", "x", 4.0), ("b", "1", "w", 8.0), ("b", "1", "z", 0.25)]
    edges = [("w", "x"), ("w", "y"), ("x", "z"), ("y", "z")]
    found = runs.critical_paths(
        spark.createDataFrame(nodes, "scope string, run_id string, node_id string"),
        spark.createDataFrame(active, "scope string, run_id string, node_id string, active_seconds double"),
        spark.createDataFrame(edges, "src string, dst string"),
    )
    assert {(r.scope, r.run_id): r.critical_path_us for r in found.collect()} == {
        ("a", "1"): 3_500_000,
        ("a", "2"): 4_000_000,
        ("b", "1"): 8_250_000,
    }


def test_products_and_sums_of_large_numbers(spark):
    """Modulo 2^61 - 1 by halves, at the ends of the range and where intermediate results are largest."""
    rng = random.Random(9)
    ends = [0, 1, (1 << 30) - 1, (1 << 31) - 1, 1 << 31, (1 << 60) - 1, 1 << 60, graph.PRIME - 1, (1 << 61) - 1]
    numbers = ends + [rng.randrange(1 << 61) for _ in range(40)]
    pairs = spark.createDataFrame([(a, b) for a in numbers for b in numbers], "a long, b long")
    for r in pairs.select("a", "b", graph._times(pairs.a, pairs.b).alias("t")).collect():
        assert r.t == r.a * r.b % graph.PRIME
    total = pairs.agg(graph._total(pairs.a).alias("t")).first().t
    assert total == sum(numbers) * len(numbers) % graph.PRIME


def test_several_numbers_and_sets_of_origins_by_one_walk(spark, monkeypatch):
    rng = random.Random(6)
    edges = {(rng.randrange(d), d) for d in range(1, 40) for _ in range(rng.choice([0, 1, 2, 3]))} | {(40, 41), (41, 40)}
    own = [(n, rng.randrange(1 << 60), rng.randrange(1 << 60)) for n in range(42)]
    nodes = spark.createDataFrame(own, "node_id long, a long, b long")
    links = graph.prepared_edges(spark.createDataFrame(sorted(edges) * 2, "src long, dst long"))
    walks = []
    plain = graph._collapse
    monkeypatch.setattr(graph, "_collapse", lambda *a: (walks.append(1), plain(*a))[1])
    both = graph.carried_fingerprints(nodes, links, {"a": "x", "b": "y"}).collect()
    factor = {(r.src, r.dst): r.f for r in links.select("src", "dst", graph.edge_factor(links.src, links.dst).alias("f")).collect()}
    for place, name in ((1, "x"), (2, "y")):
        assert {r.node_id: r[name] for r in both} == plain_prints(42, edges, {row[0]: row[place] for row in own}, factor)
    sets = {"p": [3, 41], "q": [0, 3, 17]}
    frames_ = {name: spark.createDataFrame([(n,) for n in ids], "node_id long") for name, ids in sets.items()}
    rows = graph.descendants_of(nodes, links, frames_).collect()
    assert len(rows) == len({r.node_id for r in rows}) and len(walks) == 2
    for name, ids in sets.items():
        assert {r.node_id for r in rows if r[name]} == reach(edges, ids)
    assert all(r.p or r.q for r in rows)


@pytest.mark.parametrize("given, walks", [(False, 2), (True, 1)])
def test_resume_plan_walks_the_graph_once_for_what_runs(spark, monkeypatch, given, walks):
    """Node 1 failed, 4 changed: 3 hangs on 1, 5 on 4, and 6 on both; 7 has no prior record."""
    from pyspark.sql import functions as F

    from quayside.operators import restart, runs

    edges = spark.createDataFrame([(1, 3), (0, 3), (4, 5), (0, 5), (3, 6), (5, 6), (0, 2), (7, 8), (0, 8)], "src long, dst long")
    fixed = {name: F.lit("v") for name in ("business_run_key", "dag_id", "dag_version", "code_version", "code_fingerprint")}
    nodes = spark.range(9).select(F.col("id").alias("node_id"), F.lit(5).cast("long").alias("own"))
    changed = nodes.withColumn("own", F.when(F.col("node_id") == 4, 6).otherwise(F.col("own")).cast("long"))
    now = graph.carried_fingerprints(changed, edges).select("node_id", F.col("fingerprint").cast("string").alias("input_fingerprint"))
    before = graph.carried_fingerprints(nodes, edges).localCheckpoint()
    current = (changed.drop("own").join(now, "node_id") if given else changed).select(
        "*",
        *[value.alias(name) for name, value in fixed.items()],
        F.array().cast("array<string>").alias("compatible_versions"),
        F.lit(True).alias("eligible"),
        F.lit("reuse_valid").alias("policy"),
        F.lit("merge").alias("strategy"),
        F.lit("cp").alias("checkpoint_name"),
    ).localCheckpoint()
    inputs = F.col("fingerprint").cast("string")
    prior = before.where("node_id <> 7").select(
        "node_id",
        *[value.alias(name) for name, value in fixed.items()],
        F.when(F.col("node_id") == 1, "FAILED").otherwise("SUCCEEDED").alias("status"),
        inputs.alias("input_fingerprint"),
        F.lit(False).alias("execution_uncertain"),
        restart.checkpoint_record(F.lit("cp"), inputs, F.lit("out"), F.lit("x")).alias("checkpoint"),
        F.lit("out").alias("outputs_fingerprint"),
        F.lit(True).alias("outputs_valid"),
    )
    seen = []
    plain = graph._collapse
    monkeypatch.setattr(graph, "_collapse", lambda *a: (seen.append(1), plain(*a))[1])
    got = {r.node_id: (r.action, r.cause) for r in runs.resume_plan(current, prior, edges).collect()}
    assert got == {
        0: ("reuse", None), 1: ("run", "invalidated"), 2: ("reuse", None), 3: ("run", "invalidated"),
        4: ("run", "input_fingerprint"), 5: ("run", "input_fingerprint"), 6: ("run", "invalidated"),
        7: ("run", "no_prior_record"), 8: ("recheck", None),
    }
    assert len(seen) == walks
