"""Compression of vectors to short codes (a product quantiser), trained by Lloyd's rounds over cover trees.

A vector is cut into equal consecutive parts; each part position has a codebook, and a vector's code names the nearest
entry of every part.

1. Each task builds cover trees over slices of its vectors, one tree per part position: a node covers a consecutive run
   of points (in tree order) within a radius of one of them, and its children cover it with half the radius. The trees
   are written once to the shared folder and only read afterwards. A slice has a fixed number of vectors, so a tree's
   size does not depend on the data.
2. In a round every tree hands codebook entries down from its root. By the triangle inequality, if a node's point is
   closer to one entry than to any other by more than twice the radius, the whole subtree belongs to it, and its sum is
   a difference of cumulative sums. Entries that can't win inside a node are not handed on. Only what is still ambiguous
   at a leaf is compared exactly, in whole numbers, ties to the smaller index; nodes of radius zero, which hold all
   copies of a value, are compared once.
3. Tasks send one row of sums each; the driver gets one number per codebook cell.

Bounds are floating-point with a margin, so the result is that of comparing every part with every entry.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as if they ended in
zeros, up to the longest one's length, rounded up to whole parts. The first entries are parts of the rows of smallest
id; null ids come last, and rows that repeat an id are taken each, the smaller vector first. Fewer rows than entries
make fewer entries. No rows give no rows. Other columns don't take part. Components whose squares leave 64 bits end the
job with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.vectors import chunks, matrix, sound, summed, whole, within
from quayside.session import materialize, scratch_path

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
SLICE = 2048  # vectors of a tree
LEAF = 8  # points of a node that isn't split any more
FILE_ROWS = 64  # slices in a file, since a reader may hold one file's rows at once
CELLS = 1 << 21  # numbers that one comparison holds at most
MARGIN = 1e-9
NODE = ["part", "center", "start", "stop", "child", "children"]


class Forest:
    """The cover trees of a slice, one per part. ``points`` are in tree order, the parts one after another; nodes come
    level by level, so the children of a node are consecutive."""

    def __init__(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.points, self.order, self.nodes, self.radius = points, order, nodes, radius

    @classmethod
    def build(cls, points: np.ndarray, parts: int) -> Forest:
        """``points`` holds the parts one after another."""
        size = len(points) // parts
        order = np.arange(len(points))
        levels, radii = [], []
        # A frontier of nodes: part, the point in its centre (a row of ``points``), and the run of ``order`` it covers.
        part = np.arange(parts)
        centre, start = part * size, part * size
        stop, done = start + size, 0
        while len(part):
            count = stop - start
            member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
            owner = np.repeat(np.arange(len(part)), count)
            away = _distance(points[order[member]], points[centre[owner]])
            radius = np.maximum.reduceat(away, np.cumsum(count) - count)
            split = (radius > 0) & (count > LEAF)
            level = np.stack([part, centre, start, stop, np.zeros_like(part), np.zeros_like(part)], 1)
            levels.append(level)
            radii.append(radius)
            inside = np.flatnonzero(split[owner])
            child, at_centre = _children(points, order[member[inside]], owner[inside], away[inside], centre, radius / 2)
            if not len(inside):
                break
            # Points go to their children's runs; a node's children stay inside its own run.
            by = np.lexsort((child, owner[inside]))
            order[member[inside]] = order[member[inside]][by]
            owner_, child = owner[inside][by], child[by]
            cuts = np.flatnonzero(np.r_[True, (np.diff(owner_) != 0) | (np.diff(child) != 0)])
            first = member[inside][cuts]
            length = np.diff(np.r_[cuts, len(child)])
            parent = owner_[cuts]
            done += len(part)
            level[:, 5] = np.bincount(parent, minlength=len(part))
            level[:, 4] = done + np.cumsum(level[:, 5]) - level[:, 5]
            part, centre, start, stop = part[parent], at_centre[child[cuts]], first, first + length
        return cls(points[order], order, np.concatenate(levels), np.concatenate(radii))

    def centres(self) -> np.ndarray:
        """Where each node's point is in tree order."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        return place[self.nodes[:, 1]]

    def assign(self, books: np.ndarray, whole: list) -> np.ndarray:
        """The nearest entry of every point (in tree order). ``whole`` gets the runs that were assigned at once, as
        (start, stop, part, entry)."""
        entries = books.shape[1]
        label = np.zeros(len(self.points) + 1, np.int64)
        centre = self.centres()
        node = np.flatnonzero(np.arange(len(self.nodes)) < books.shape[0])
        open_ = np.ones((len(node), entries), bool)
        ranges, points, masks = [], [], []
        while len(node):
            part, start, stop = self.nodes[node, 0], self.nodes[node, 2], self.nodes[node, 3]
            exact = _squares(self.points[centre[node]], books, part)
            exact[~open_] = np.iinfo(np.int64).max
            best = exact.argmin(1)
            away = np.sqrt(exact.astype(np.float64))
            away[~open_] = np.inf
            radius = self.radius[node]
            reach = away[np.arange(len(node)), best] + radius
            maybe = open_ & (away - radius[:, None] <= reach[:, None] * (1 + MARGIN) + MARGIN)
            alone = (maybe.sum(1) == 1) | (radius == 0)
            ranges.append(np.stack([start, stop, part, best], 1)[alone])
            leaf = ~alone & (self.nodes[node, 5] == 0)
            count = (stop - start)[leaf]
            points.append(np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start[leaf], count))
            masks.append((np.repeat(part[leaf], count), np.repeat(maybe[leaf], count, axis=0)))
            deeper = ~alone & ~leaf
            many = self.nodes[node[deeper], 5]
            next_ = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            open_ = np.repeat(maybe[deeper], many, axis=0)
            node = next_ + np.repeat(self.nodes[node[deeper], 4], many)
        run = np.concatenate(ranges)
        whole.append(run)
        np.add.at(label, run[:, 0], run[:, 3])
        np.add.at(label, run[:, 1], -run[:, 3])
        label = np.cumsum(label[:-1])
        for rows, (part, maybe) in zip(points, masks, strict=True):
            step = max(1, CELLS // (entries * max(1, books.shape[2])))
            for low in range(0, len(rows), step):
                at = rows[low : low + step]
                exact = _squares(self.points[at], books, part[low : low + step])
                exact[~maybe[low : low + step]] = np.iinfo(np.int64).max
                label[at] = exact.argmin(1)
        return label

    def sums(self, books: np.ndarray) -> np.ndarray:
        """Per part and entry the sum of its points and their number."""
        parts, entries, width = books.shape
        whole: list[np.ndarray] = []
        label = self.assign(books, whole)
        out = np.zeros((parts * entries, width + 1), np.int64)
        total = np.zeros((len(self.points) + 1, width), np.int64)
        np.cumsum(self.points, axis=0, out=total[1:])
        run = whole[0]
        cell = run[:, 2] * entries + run[:, 3]
        np.add.at(out[:, :-1], cell, total[run[:, 1]] - total[run[:, 0]])
        np.add.at(out[:, -1], cell, run[:, 1] - run[:, 0])
        covered = np.zeros(len(self.points) + 1, np.int64)
        np.add.at(covered, run[:, 0], 1)
        np.add.at(covered, run[:, 1], -1)
        single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
        cell = single // (len(self.points) // parts) * entries + label[single]
        np.add.at(out[:, :-1], cell, self.points[single])
        np.add.at(out[:, -1], cell, 1)
        return out


def _distance(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    difference = rows - other
    return np.sqrt(np.einsum("ij,ij->i", difference, difference).astype(np.float64))


def _squares(rows: np.ndarray, books: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to all entries of their part's book."""
    out = np.empty((len(rows), books.shape[1]), np.int64)
    step = max(1, CELLS // (books.shape[1] * max(1, books.shape[2])))
    for low in range(0, len(rows), step):
        difference = rows[low : low + step, None] - books[part[low : low + step]]
        out[low : low + step] = np.einsum("ijk,ijk->ij", difference, difference)
    return out


def _children(
    points: np.ndarray, row: np.ndarray, owner: np.ndarray, away: np.ndarray, centre: np.ndarray, cover: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Deals the points of each node to children: those near its centre to the first child, then, again and again,
    those near its first point that is left. Returns each point's child and the children's centres."""
    child = np.full(len(row), -1, np.int64)
    near = away <= cover[owner]
    child[near] = owner[near]
    centres = [centre]
    made, left = len(centre), np.flatnonzero(~near)
    while len(left):
        first = np.r_[True, owner[left][1:] != owner[left][:-1]]
        number = np.cumsum(first) - 1
        chosen = row[left[first]]
        taken = _distance(points[row[left]], points[chosen[number]]) <= cover[owner[left]]
        child[left[taken]] = made + number[taken]
        centres.append(chosen)
        made += len(chosen)
        left = left[~taken]
    return child, np.concatenate(centres)


def quantised(vectors: DataFrame, scale: int, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label and ``terms`` of the rows that take part, and how many terms each has."""
    terms = whole(scale)
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("string")
    kept = vectors.where(sound()).select("vec_id", label.alias("label"), terms.alias("terms"))
    longest = kept.agg(F.max(F.size("terms"))).first()[0] or 0
    width = -(-longest // parts) * parts
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("terms"))
    padded = kept.withColumn("terms", F.concat("terms", zeros))
    return padded.withColumn("terms", within("terms", max(width, 1))), width


def _forests(kept: DataFrame, width: int, parts: int) -> DataFrame:
    """One row per slice: its ids and labels, and the forest over it."""
    each = width // parts
    ids, labels = (kept.schema[name].dataType.simpleString() for name in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, SLICE):
                rows = matrix(part.column("terms"), width)
                points = rows.reshape(len(rows), parts, each).transpose(1, 0, 2).reshape(len(rows) * parts, each)
                forest = Forest.build(points, parts)
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), part.column(name))
                    for name in ("vec_id", "label")
                ]
                packed = [forest.points.astype("<i4"), forest.order.astype("<i4"), forest.nodes.astype("<i4"), forest.radius]
                columns += [pa.array([values.tobytes()], pa.binary()) for values in packed]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "labels", "points", "places", "nodes", "radius"])

    schema = f"ids array<{ids}>, labels array<{labels}>, points binary, places binary, nodes binary, radius binary"
    return kept.mapInArrow(run, schema)


def _unpacked(batch: pa.RecordBatch, row: int, part_width: int) -> Forest:
    def held(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_py(), kind)

    order = held("places", "<i4").astype(np.int64)
    points = held("points", "<i4").reshape(len(order), part_width).astype(np.int64)
    return Forest(points, order, held("nodes", "<i4").reshape(-1, len(NODE)).astype(np.int64), held("radius", "<f8"))


def train(kept: DataFrame, forests: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks: parts x entries x numbers of a part."""
    first = kept.select("terms").orderBy(F.col("vec_id").asc_nulls_last(), "terms").limit(entries).collect()
    books = np.array([row["terms"] for row in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    cell = books.shape[2] + 1

    def round_(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((parts * books.shape[1], cell), np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    sums += _unpacked(batch, row, cell - 1).sums(books)
            yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))], ["sums"])

        return run

    trees = forests.select("points", "places", "nodes", "radius")
    for _ in range(rounds):
        total = summed(trees.mapInArrow(round_(books), "sums array<bigint>"), books.shape[0] * books.shape[1] * cell)
        books = books.copy()
        for place in range(books.shape[0] * books.shape[1]):
            *numbers, members = total[place * cell : (place + 1) * cell]
            if members:
                books[divmod(place, books.shape[1])] = [number // members for number in numbers]
    return books


def encode(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits per part) and error of every vector that takes part, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("A code has two hex digits per part.")
    spark = vectors.sparkSession
    kept, width = quantised(vectors, scale, parts)
    ids, labels = (kept.schema[name].dataType.simpleString() for name in ("vec_id", "label"))
    path = scratch_path(spark, "cover-trees")
    forests = _forests(kept, width, parts)
    forests.write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    forests = spark.read.schema(forests.schema).parquet(path)
    if forests.isEmpty():
        empty = f"vec_id {ids}, label {labels}, code string, error bigint"
        return spark.createDataFrame([], empty), np.zeros((parts, 0, width // parts), np.int64)
    books = train(kept, forests, width, parts, entries, rounds)
    names = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                forest = _unpacked(batch, row, width // parts)
                size = len(forest.order) // parts
                label = forest.assign(books, [])
                part = np.repeat(np.arange(parts), size)
                difference = forest.points - books[part, label]
                # From tree order back to that of the slice; a part's points stay inside the part.
                code, error = np.empty(len(label), np.int64), np.empty(len(label), np.int64)
                code[forest.order] = label
                error[forest.order] = np.einsum("ij,ij->i", difference, difference)
                codes = ["".join(digits) for digits in names[code.reshape(parts, size).T].tolist()]
                columns = [batch.column("ids")[row].values, batch.column("labels")[row].values]
                columns += [pa.array(codes, pa.string()), pa.array(error.reshape(parts, size).sum(0))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return forests.mapInArrow(run, f"vec_id {ids}, label {labels}, code string, error bigint"), books


def report(vectors: DataFrame, **options: int) -> DataFrame:
    """vec_id, code, error, label_error (the error summed over rows of equal label) and codebooks_sha256."""
    spark = vectors.sparkSession
    coded, books = encode(vectors, **options)
    coded, _ = materialize(coded, scratch_path(spark, "codes"))
    # Written and reread, the sums are a plain side of the join: Spark picks how to join by their size, and AQE can
    # split a label that very many rows share.
    total = F.sum(F.col("error").cast("decimal(38,0)")).cast("bigint").alias("label_error")
    sums, _ = materialize(coded.groupBy("label").agg(total), scratch_path(spark, "label-errors"))
    sums = sums.withColumnRenamed("label", "of_label")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
