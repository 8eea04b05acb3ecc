"""Best-fit packing of token sequences, planned on the histogram of lengths.

Lengths never exceed the capacity, so their histogram is small however many documents there are. The plan runs
best-fit decreasing over its counts and hands out runs of slots; documents then take their slots by joining on the
rank within their length. Only a piece that is longer than nothing but its capacity is cut, so the first piece of a
document carries the remainder and the others are full.

Null and empty texts give the end token alone. Repeated rows are packed each. A null doc_id is kept as it is. An empty
table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.bpe import Vocabulary, encoder, id_bytes
from quayside.llm.common import bucket_count, pieces
from quayside.session import materialize, scratch_path

CAPACITY = 1024
END = 2
RANKED = 100_000  # pieces that one task ranks at most, about


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path, vocabulary, "bytes", id_bytes)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows: list[tuple[int, int, int, int, int]] = []
                for row, forms in enumerate(held.forms(part.column("text").to_pylist())):
                    ids = b"".join(forms) + last
                    total = len(ids) // 4
                    stop = (total - 1) % capacity + 1
                    start = piece = 0
                    while start < total:
                        rows.append((row, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                of, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(of, pa.int32())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Sequences of equal fill stand next to each other in groups. A length takes whole groups, fullest first, so each
    length splits at most one group in three and opens at most two: the number of groups depends on the capacity only.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by free room: (first sequence, sequences)
    rooms: list[int] = []
    slots: list[tuple[int, int, int, int, int, int]] = []
    opened = 0

    def keep(room: int, first: int, count: int) -> None:
        if room and count:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = room // length
            taken = min(left, each * count)
            slots.append((length, rank, taken, first, each, capacity - room))
            full, rest = divmod(taken, each)
            keep(room - each * length, first, full)
            if rest:
                keep(room - rest * length, first + full, 1)
            begun = full + bool(rest)
            keep(room, first + begun, count - begun)
            rank, left = rank + taken, left - taken
    return slots


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to ``capacity``."""
    spark = parts.sparkSession
    held, _ = materialize(parts, scratch_path(spark, "pieces"))
    histogram = {int(n): int(c) for n, c in held.groupBy("length").count().collect()}  # capacity rows at most
    salts = bucket_count(sum(histogram.values()), RANKED)
    salted = held.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy("length", "__salt")
        .count()
        .select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    )
    ranked = (
        salted.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
    )
    slots = spark.createDataFrame(
        plan(histogram, capacity), "length long, `from` long, taken long, first long, each long, used long"
    )
    at = F.col("__rank") - F.col("from")
    return (
        ranked.alias("r")
        .join(
            # The plan's size depends on the capacity alone.
            F.broadcast(slots).alias("s"),
            (F.col("r.length") == F.col("s.length"))
            & (F.col("__rank") >= F.col("from"))
            & (F.col("__rank") < F.col("from") + F.col("taken")),
        )
        .select(
            *[f"r.{name}" for name in parts.columns],
            (F.col("first") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("used") + at % F.col("each") * F.col("r.length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack(token_pieces(docs, path, capacity, end), capacity)
