"""Operators 11 and 12 against plain Lloyd's rounds."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from quayside.llm import shallot, vector_codes
from quayside.llm.vectors import largest

NAN, INF = float("nan"), float("inf")


def sound(vector) -> bool:
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def lloyd(points: list[tuple], centroids: list[tuple], rounds: int):
    """Plain rounds in Python's whole numbers: assignments, distances and final centroids."""

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members: dict[int, list] = {}
        for x in points:
            members.setdefault(nearest(x)[1], []).append(x)
        centroids = [
            tuple(sum(column) // len(members[k]) for column in zip(*members[k], strict=True)) if k in members else c
            for k, c in enumerate(centroids)
        ]
    return [nearest(x) for x in points], centroids


def plain_clusters(rows, clusters, rounds, dimensions, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if sound(v) and len(v) == dimensions]

    def place(row):
        return (row[0] is None, hashlib.sha256(f"2:{row[0]}".encode()).hexdigest(), row[1])

    found, centroids = lloyd([v for _, v in kept], [v for _, v in sorted(kept, key=place)[:clusters]], rounds)
    inertia = Counter()
    for d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter(
        (i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(kept, found, strict=True)
    )


def awkward_vectors(seed: int, count: int, dimensions: int, spread: float):
    """Ids that repeat or are null, copies, a hot vector, close grid points that tie, and unsound vectors."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-6, 7, dimensions) * spread).tolist()) for i in rng.integers(0, count, count)]
    rows += [(1000 + i, rows[0][1]) for i in range(count // 3)] + [(None, rows[1][1]), (None, rows[2][1]), rows[3], rows[3]]
    bad = [None, [], [0.1] * (dimensions - 1), [NAN, *rows[0][1][1:]], [INF, *rows[0][1][1:]], [None, *rows[0][1][1:]]]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("seed,dimensions,clusters,rounds", [(1, 4, 7, 5), (2, 2, 12, 4), (3, 16, 5, 3), (4, 3, 1, 2), (5, 3, 900, 2)])
def test_shallot_equals_lloyd(spark, seed, dimensions, clusters, rounds):
    rows = awkward_vectors(seed, 160, dimensions, 0.05 if seed % 2 else 1 / 256)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = shallot.report(table, clusters=clusters, rounds=rounds, dimensions=dimensions)
    assert Counter(map(tuple, found.collect())) == plain_clusters(rows, clusters, rounds, dimensions, shallot.SCALE)


def test_shallot_scans_less_than_everything():
    """On clustered data most vectors keep their centroid by their bounds alone."""
    rng = np.random.default_rng(6)
    centres = rng.integers(-4000, 4000, (20, 8))
    rows = np.repeat(centres, 200, axis=0) + rng.integers(-20, 21, (4000, 8))
    search = shallot.Search(centres, None)
    held = search.update(rows, shallot.Bounds.unknown(len(rows), 20))
    moved = shallot.Search(centres + 3, centres)
    looked = []
    moved._scan = lambda rows, open_, *rest: looked.append(len(open_))
    moved.update(rows, held)
    assert sum(looked) == 0
    assert (held.nearest == np.repeat(np.arange(20), 200)).all()


def test_shallot_on_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, cluster string, nearest string, sums string, terms string, label int"
    empty = spark.createDataFrame([], schema)
    assert shallot.report(empty).collect() == []
    assert shallot.report(spark.createDataFrame([(1, [0.5], *["x"] * 4, 1)], schema)).collect() == []
    rows = [(i, [float(i % 3)] * 64, *["x"] * 4, 1) for i in range(9)]
    found = shallot.report(spark.createDataFrame(rows, schema), clusters=2, rounds=1)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_clusters([row[:2] for row in rows], 2, 1, 64, 256)


def test_distances_beyond_64_bits_are_refused(spark):
    rows = [(1, [largest(64) / 256 + 1.0] * 64), (2, [0.0] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        shallot.report(table).collect()
    with pytest.raises(Exception, match="beyond"):
        vector_codes.report(spark.createDataFrame([(1, [1e18] * 8)], "vec_id long, embedding array<double>")).collect()
    close = spark.createDataFrame([(1, [(largest(64) - 1) / 256] * 64), (2, [-(largest(64) - 1) / 256] * 64)], table.schema)
    assert shallot.report(close, clusters=1, rounds=0).agg({"distance": "max"}).first()[0] == 64 * (2 * (largest(64) - 1)) ** 2


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows if sound(v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = [(i, label, tuple(v + [0] * (width * parts - len(v)))) for i, label, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        points = [v[p * width : (p + 1) * width] for _, _, v in kept]
        found, book = lloyd(points, points[:entries], rounds)
        books += [x for entry in book for x in entry]
        for n, (d, k) in enumerate(found):
            codes[n] += f"{k:02x}"
            errors[n] += d
    of_label = Counter()
    for (_, label, _), error in zip(kept, errors, strict=True):
        of_label[label] += error
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    return Counter((i, c, e, of_label[label], digest) for (i, label, _), c, e in zip(kept, codes, errors, strict=True))


@pytest.mark.parametrize("seed,dimensions,parts,entries", [(1, 8, 4, 6), (2, 6, 2, 16), (3, 9, 4, 3), (4, 4, 4, 200)])
def test_codes_equal_lloyd(spark, monkeypatch, seed, dimensions, parts, entries):
    monkeypatch.setattr(vector_codes, "SLICE", 50 + 40 * seed)
    plain = awkward_vectors(seed, 150, dimensions, 0.01 if seed % 2 else 1 / 4096)
    rows = [(i, v, [1, 2, None][n % 3]) for n, (i, v) in enumerate(plain)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = vector_codes.report(table, parts=parts, entries=entries, rounds=3)
    assert Counter(map(tuple, found.collect())) == plain_codes(rows, parts, entries, 3, vector_codes.SCALE)


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error string, nodes string, ids string"
    assert vector_codes.report(spark.createDataFrame([], schema)).collect() == []
    assert vector_codes.report(spark.createDataFrame([(1, None, 1, *["x"] * 4)], schema)).collect() == []
    rows = [(i, [0.1 * (i % 5), -0.2, 0.3 * i, 0.0, 0.5, 0.1, 0.1, 0.2], 1, *["x"] * 4) for i in range(40)]
    narrow = spark.createDataFrame([row[:2] for row in rows], "vec_id long, embedding array<float>")
    wide = vector_codes.report(spark.createDataFrame(rows, schema))
    assert wide.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, vector_codes.report(narrow).collect()))
    only_empty = vector_codes.report(spark.createDataFrame([(1, []), (2, [])], narrow.schema))
    assert [tuple(r)[1:4] for r in only_empty.collect()] == [("00" * 8, 0, 0)] * 2


def test_forest_covers_every_point_once():
    rng = np.random.default_rng(7)
    points = rng.integers(-500, 500, (4 * 300, 3))
    points[::7] = points[0]
    forest = vector_codes.Forest.build(points, 4)
    assert sorted(forest.order.tolist()) == list(range(len(points)))
    assert (forest.points == points[forest.order]).all()
    centres = forest.centres()
    for node, (part, _, start, stop, child, children) in enumerate(forest.nodes.tolist()):
        away = np.sqrt(((forest.points[start:stop] - forest.points[centres[node]]) ** 2).sum(1))
        assert away.max() == forest.radius[node] and part * 300 <= start < stop <= (part + 1) * 300
        if children:
            below = forest.nodes[child : child + children]
            assert below[0, 2] == start and below[-1, 3] == stop and (below[1:, 2] == below[:-1, 3]).all()


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(8)
    centres = rng.integers(-40000, 40000, (6, 4))
    points = np.repeat(centres, 300, axis=0) + rng.integers(-30, 31, (1800, 4))
    forest = vector_codes.Forest.build(points[rng.permutation(1800)], 1)
    runs: list[np.ndarray] = []
    label = forest.assign(centres[None], runs)
    covered = sum(int(run[1] - run[0]) for run in runs[0])
    assert covered == 1800 and len(runs[0]) < 60
    expected = ((forest.points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (label == expected).all()
