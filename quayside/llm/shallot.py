"""Centroid clustering, exactly Lloyd's, with the bounds and the search of Shallot.

Each vector remembers its centroid, the second nearest one, an upper bound on the distance to the first and a lower
bound on the distance to all others. When centroids move, the bounds give way by as much. A round then looks at a vector
only if its upper bound reaches the lower one and half the gap between its centroid and that one's nearest neighbour:

1. The distances to both remembered centroids are computed; the search starts from the closer one.
2. The others are scanned in the order of their distance to that start. The scan is over where that distance exceeds
   the vector's distance to the start plus that to the second nearest found so far, so the ball shrinks as it finds
   better ones.
3. Bounds are floating-point with a margin; what survives them is compared by squared distances in whole numbers, ties
   to the smaller number. So the result is that of comparing everything.

A round is one map over the table of vectors and their bounds. It writes the table of the next round to the shared
folder, and beside it each task's change of the centroids' sums: only vectors that changed sides count. The driver
holds centroids and sums (clusters times dimensions numbers, as the model itself) and never a vector but the first
centroids. A lost executor costs the tasks it ran; the table of the round before is removed only when the next is
complete. No shuffle carries vectors, so a hot value is no hot key.

Vectors that are null, of another length, or hold null or non-finite components take no part. A null id is an id like
any other, and its hash comes last among the first centroids; rows of equal ids or vectors are taken each, the smaller
vector first. Fewer vectors than clusters make fewer clusters. No vectors give no rows. Other columns don't take part.
Components whose squares leave 64 bits end the job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import joined_bytes
from quayside.llm.vectors import chunks, matrix, packed, sound, squared, summed, whole, within
from quayside.session import discard, materialize, scratch_path

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = "2:"
SLICE = 8192  # vectors that are searched together
MARGIN = 1e-9  # relative, far above what sums of a few roundings lose


@dataclass
class Bounds:
    """What the vectors of a slice remember."""

    nearest: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    @classmethod
    def unknown(cls, size: int, clusters: int) -> Bounds:
        second = np.full(size, min(1, clusters - 1))
        return cls(np.zeros(size, np.int64), second, np.full(size, np.inf), np.full(size, -np.inf))


class Search:
    """Centroids of a round, their neighbours sorted by distance, and how far each has come."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        gaps = np.sqrt(squared(centroids[:, None], centroids[None]).astype(np.float64))
        apart = gaps.copy()
        np.fill_diagonal(apart, -1.0)  # a centroid is its own first neighbour, whatever coincides with it
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.half = self.gaps[:, 0] / 2 if len(centroids) > 1 else np.full(1, np.inf)
        moved = np.zeros(len(centroids)) if before is None else np.sqrt(squared(centroids, before).astype(np.float64))
        self.moved = moved
        # The farthest that any centroid but this one has come.
        top = np.argsort(moved)
        self.others = np.full(len(centroids), moved[top[-1]])
        self.others[top[-1]] = moved[top[-2]] if len(centroids) > 1 else 0.0

    def update(self, rows: np.ndarray, held: Bounds) -> Bounds:
        """Bounds and nearest centroids of ``rows`` for these centroids."""
        near, second = held.nearest.copy(), held.second.copy()
        upper = (held.upper + self.moved[near]) * (1 + MARGIN)
        lower = (held.lower - self.others[near]) * np.where(held.lower > self.others[near], 1 - MARGIN, 1.0)
        limit = np.maximum(lower, self.half[near] * (1 - MARGIN))
        open_ = np.flatnonzero(~(upper < limit))
        # The exact distance may settle it without a search.
        first_sq = squared(rows[open_], self.centroids[near[open_]])
        upper[open_] = np.sqrt(first_sq.astype(np.float64))
        still = ~(upper[open_] * (1 + MARGIN) < limit[open_])
        open_, first_sq = open_[still], first_sq[still]
        if len(open_) and len(self.centroids) > 1:
            self._scan(rows, open_, first_sq, near, second, upper, lower)
        return Bounds(near, second, upper, lower)

    def _scan(
        self,
        rows: np.ndarray,
        open_: np.ndarray,
        one: np.ndarray,
        near: np.ndarray,
        second: np.ndarray,
        upper: np.ndarray,
        lower: np.ndarray,
    ) -> None:
        a, b = near[open_], second[open_]
        two = squared(rows[open_], self.centroids[b])
        turned = (two < one) | ((two == one) & (b < a))
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        one, two = np.where(turned, two, one), np.where(turned, one, two)
        # Vectors of one start meet the same neighbours in the same order.
        for start in np.unique(a):
            at = np.flatnonzero(a == start)
            best = self._ball(rows[open_[at]], start, a[at], b[at], one[at], two[at])
            a[at], b[at], one[at], two[at] = best
        near[open_], second[open_] = a, b
        upper[open_], lower[open_] = np.sqrt(one.astype(np.float64)), np.sqrt(two.astype(np.float64))


    def _ball(self, rows: np.ndarray, start: int, *known: np.ndarray) -> tuple[np.ndarray, ...]:
        """The two nearest centroids of vectors whose search starts at one of the two known, and their distances."""
        a, b, one, two = known
        tried, at = b.copy(), np.arange(len(rows))
        reach = np.sqrt(one.astype(np.float64))
        for other, gap in zip(self.order[start].tolist(), self.gaps[start].tolist(), strict=True):
            live = gap <= (reach[at] + np.sqrt(two[at].astype(np.float64))) * (1 + MARGIN)
            if not live.all():
                at, rows = at[live], rows[live]
            if not len(at):
                break
            found = squared(rows, self.centroids[other])
            fresh = tried[at] != other
            first = fresh & ((found < one[at]) | ((found == one[at]) & (other < a[at])))
            next_ = fresh & ~first & (found < two[at])
            second = at[first]
            b[second], two[second] = a[second], one[second]
            a[second], one[second] = other, found[first]
            b[at[next_]], two[at[next_]] = other, found[next_]
        return a, b, one, two


def _changes(rows: np.ndarray, was: np.ndarray | None, now: np.ndarray, sums: np.ndarray) -> None:
    """Adds to ``sums`` (cluster, then its components and count) what the vectors that changed sides bring and take."""
    moved = np.arange(len(now)) if was is None else np.flatnonzero(was != now)
    for side, sign in ((now, 1), (was, -1)):
        if side is None:
            continue
        order = moved[np.argsort(side[moved], kind="stable")]
        if len(order):
            cuts = np.flatnonzero(np.r_[True, np.diff(side[order]) != 0])
            cluster = side[order][cuts]
            sums[cluster, :-1] += sign * np.add.reduceat(rows[order], cuts, axis=0)
            sums[cluster, -1] += sign * np.diff(np.r_[cuts, len(order)])


def first_centroids(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors whose ids hash smallest; the only ones that reach the driver."""
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    rows = kept.select("terms").orderBy(hashed.asc_nulls_last(), "terms").limit(clusters).collect()
    return np.array([row["terms"] for row in rows], np.int64)


def cluster(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and (squared, exact) distance of every vector that takes part, and the centroids."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    terms = whole(scale)
    kept = (
        vectors.where(sound() & (F.size("embedding") == dimensions))
        .select("vec_id", terms.alias("terms"))
        .select("vec_id", within("terms", dimensions).alias("terms"))
    )
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), centroids
    count = len(centroids)
    schema = f"vec_id {kind}, vector binary, nearest int, second int, upper double, lower double, sums array<bigint>"

    def remembered(part: pa.RecordBatch, first: bool) -> tuple[np.ndarray, Bounds]:
        if first:
            return matrix(part.column("terms"), dimensions), Bounds.unknown(part.num_rows, count)
        rows = joined_bytes(part.column("vector"))[0].view("<i4").reshape(-1, dimensions).astype(np.int64)
        places = [part.column(n).to_numpy().astype(np.int64) for n in ("nearest", "second")]
        return rows, Bounds(*places, *[part.column(n).to_numpy() for n in ("upper", "lower")])

    def step(search: Search, first: bool):
        names = ["vec_id", "vector", "nearest", "second", "upper", "lower", "sums"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, types = np.zeros((count, dimensions + 1), np.int64), None
            for batch in batches:
                for part in chunks(batch, SLICE):
                    rows, held = remembered(part, first)
                    now = search.update(rows, held)
                    _changes(rows, None if first else held.nearest, now.nearest, sums)
                    columns = [part.column("vec_id"), packed(rows) if first else part.column("vector")]
                    columns += [pa.array(v.astype(np.int32)) for v in (now.nearest, now.second)]
                    columns += [pa.array(v) for v in (now.upper, now.lower)]
                    columns.append(pa.nulls(part.num_rows, pa.list_(pa.int64())))
                    types = [column.type for column in columns]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if types:
                none = [pa.nulls(1, kind) for kind in types[:-1]]
                yield pa.RecordBatch.from_arrays([*none, pa.array([sums.ravel().tolist()], types[-1])], names)

        return run

    table, path, before, totals = kept, None, None, [0] * (count * (dimensions + 1))
    for number in range(rounds):
        target = scratch_path(spark, f"shallot-{number}")
        held, _ = materialize(table.mapInArrow(step(Search(centroids, before), path is None), schema), target)
        if path:
            discard(spark, path)
        path, table = target, held.where("sums IS NULL").drop("sums")
        change = summed(held.where("sums IS NOT NULL").select("sums"), len(totals))
        totals = [a + b for a, b in zip(totals, change, strict=True)]
        before, centroids = centroids, centroids.copy()
        for c in range(count):
            *parts, members = totals[c * (dimensions + 1) : (c + 1) * (dimensions + 1)]
            if members:
                centroids[c] = [part // members for part in parts]
    search = Search(centroids, before)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, SLICE):
                rows, held = remembered(part, path is None)
                now = search.update(rows, held).nearest
                columns = [part.column("vec_id"), pa.array(now.astype(np.int32)), pa.array(squared(rows, centroids[now]))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return table.mapInArrow(last, f"vec_id {kind}, cluster int, distance bigint"), centroids


def report(vectors: DataFrame, **options: int | str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **options)
    found, _ = materialize(found, scratch_path(spark, "clusters"))
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {row["cluster"]: int(row["total"]) for row in found.groupBy("cluster").agg(total.alias("total")).collect()}
    rows = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
    ]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(per_cluster, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
