"""Finds verbatim benchmark passages in training documents by suffix arrays of the training words.

1. Every window of ``window`` consecutive words of a benchmark item (a shorter item is one window) is the head of a test
   suffix. Equal windows are one. The distinct windows are dealt into blocks of bounded size; a block is sent to every
   task, and there is one pass over the documents per block (one in all, unless a benchmark is very large).
2. A task turns each slice of its documents into numbers: a word's place in the block's vocabulary, zero for other words.
   A shard is a stretch of a slice of bounded length; its suffix array sorts the suffixes that begin with enough words
   of the vocabulary to hold a window. Suffixes end with their document.
3. Each test window is looked up in each shard's suffix array by two binary searches, which give the range of all its
   occurrences, and so their locations.
4. ``matches`` chains windows that follow each other in item and document to the longest verbatim matches.
   ``decontaminated`` removes the documents that hold a window.

Memory of a task is that of a slice and a block. The windows that a document holds go on as one row per document, and
meet their items in a join whose sides are plain, so that a window in a third of all documents can be split by AQE.

Words are runs of letters and digits after A-Z are lower-cased, where every character beyond ASCII counts as a letter.
They are compared as 64-bit hashes. Null and empty texts have no words, match nothing, and are no items. A window may
occur any number of times; each word counts once. Rows that repeat an item_id are one item with the windows of all; a
null item_id is the empty string. Documents of null or repeated doc_id are taken each. No documents give no rows, and an
empty benchmark leaves every document clean. Other columns don't take part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import apart, bucket_count, joined_bytes, mixed, order_id, pieces
from quayside.llm.repeats import by_rows, named
from quayside.session import materialize, scratch_path

WINDOW = 10
BITS = 21  # of a word's number
BLOCK_WORDS = (1 << BITS) - 2  # in all windows of a block, so that a number serves for each
SLICE_BYTES = 4_000_000  # of text that is turned into words together
SHARD_WORDS = 1 << 19  # words whose suffixes are sorted together
SCAN_BYTES = 1 << 20  # of text that is cut into words at once
PLACES = 1 << 12  # positions in a word that differ in the hash
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each byte its value with A-Z lower-cased, and whether it belongs to a word."""
    low = np.arange(256)
    low[65:91] += 32
    word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    return VALUES[low], word


LOWERED, IN_WORD = _byte_tables()


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of joined texts: each word's hash, and the number of words ahead of each text (one more entry than texts)."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    low = 0
    while low < len(data):
        high = min(low + SCAN_BYTES, len(data))
        while high < len(data) and IN_WORD[data[high - 1]]:  # a word stays whole
            rest = np.flatnonzero(~IN_WORD[data[high : high + SCAN_BYTES]])
            high = high + int(rest[0]) + 1 if len(rest) else min(high + SCAN_BYTES, len(data))
        inside = IN_WORD[data[low:high]]
        edges = starts[np.searchsorted(starts, low) : np.searchsorted(starts, high)] - low
        opens = inside & ~np.r_[False, inside[:-1]]
        opens[edges] = inside[edges]
        begin = np.flatnonzero(opens)
        if len(begin):
            taken = np.flatnonzero(inside)
            word = np.cumsum(opens)[taken] - 1
            value = LOWERED[data[low:high][taken]] * FACTORS[(taken - begin[word]) % PLACES]
            first = np.searchsorted(taken, begin)
            size = np.diff(np.r_[first, len(taken)]).astype(np.uint64)
            hashes.append(mixed(np.add.reduceat(value, first) + size))
            places.append(begin + low)
        low = high
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), starts)


@dataclass
class Block:
    """Test windows: their keys, lengths, vocabulary, and their words' numbers packed three to a number."""

    keys: list[bytes]
    lengths: np.ndarray
    vocabulary: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, keys: list[bytes], words: list[bytes], window: int) -> Block:
        lengths = np.array([len(w) // 8 for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), "<u8")
        vocabulary, number = np.unique(flat, return_inverse=True)
        inside = np.arange(window) < lengths[:, None]
        low = np.zeros(inside.shape, np.int64)
        low[inside] = number + 1
        high = np.where(inside, low, (1 << BITS) - 1)
        return cls(keys, lengths, vocabulary, _packed(low), _packed(high))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, from 1; 0 for others."""
        place = np.searchsorted(self.vocabulary, hashes)
        place[place == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[place] == hashes, place + 1, 0)


def _packed(numbers: np.ndarray) -> np.ndarray:
    """Rows of word numbers as fewer, larger numbers that sort alike: one row per three words."""
    short = -numbers.shape[1] % 3
    padded = np.pad(numbers, ((0, 0), (0, short)))
    return np.stack([(padded[:, i] << 2 * BITS) | (padded[:, i + 1] << BITS) | padded[:, i + 2] for i in range(0, padded.shape[1], 3)])


class Shard:
    """The suffix array of a stretch of words: where its suffixes stand, in the order of their first words."""

    def __init__(self, numbers: np.ndarray, run: np.ndarray, starts: np.ndarray, window: int):
        """``run`` has how many words of the vocabulary follow each place inside its document."""
        heads = np.zeros((len(starts), window), np.int64)
        for step in range(window):
            inside = np.flatnonzero(run[starts] > step)
            heads[inside, step] = numbers[starts[inside] + step]
        keys = _packed(heads)
        order = np.lexsort(keys[::-1])
        self.places, self.keys = starts[order], keys[:, order]

    def bound(self, wanted: np.ndarray, right: bool) -> np.ndarray:
        """How many suffixes come before each wanted head (or are equal to it, with ``right``), by binary search."""
        low = np.zeros(wanted.shape[1], np.int64)
        high = np.full(wanted.shape[1], len(self.places), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            before = np.zeros(len(open_), bool)
            equal = np.arange(len(open_))
            for key, want in zip(self.keys, wanted, strict=True):
                have, need = key[middle[equal]], want[open_[equal]]
                before[equal[have < need]] = True
                equal = equal[have == need]
            before[equal] = right
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of a test window that starts in this shard."""
        first, end = self.bound(block.low, False), self.bound(block.high, True)
        count = end - first
        window = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        return window, self.places[first[window] + inside]


def found_in(block: Block, hashes: np.ndarray, ahead: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of all occurrences in the words of a slice; ``ahead`` as of ``words_of``."""
    numbers = block.numbers(hashes)
    size = len(numbers)
    ends = np.repeat(ahead[1:], np.diff(ahead))
    stop = np.where(numbers == 0, np.arange(size), size)
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], ends)
    run = stop - np.arange(size)
    starts = np.flatnonzero(run >= block.lengths.min())
    parts = []
    for cut in np.split(starts, np.searchsorted(starts, np.arange(SHARD_WORDS, size, SHARD_WORDS))):
        if len(cut):
            parts.append(Shard(numbers, run, cut, window).occurrences(block))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip((none, none), *parts, strict=True))


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, words (64-bit hashes), item (its id as text), source (a hash of the item's text) and start (in the item, from
    0) of every window of every item."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            hashes, ahead = words_of(*joined_bytes(part.column("text")))
            words, items, sources, starts = [], [], [], []
            names = zip(part.column("item").to_pylist(), part.column("source").to_pylist(), strict=True)
            for row, (item, source) in enumerate(names):
                own = hashes[ahead[row] : ahead[row + 1]].astype("<u8")
                length = min(window, len(own))
                for start in range(len(own) - length + 1) if length else ():
                    words.append(own[start : start + length].tobytes())
                    items.append(item)
                    sources.append(source)
                    starts.append(start)
            columns = [pa.array(words, pa.binary()), pa.array(items, pa.string())]
            columns += [pa.array(sources, pa.int64()), pa.array(starts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["words", "item", "source", "start"])

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    texts = benchmark.select(item, F.xxhash64("text").alias("source"), text)
    rows = by_rows(texts, run, "words binary, item string, source bigint, start int")
    return rows.select(F.unhex(F.md5("words")).alias("key"), "words", "item", "source", "start")


def _blocks(windows: DataFrame, window: int) -> Iterator[Block]:
    """The distinct windows in blocks; the driver holds one at a time."""
    distinct = windows.groupBy("key").agg(F.first("words").alias("words"))
    held, seen = materialize(distinct, scratch_path(windows.sparkSession, "windows"))
    most = BLOCK_WORDS // window
    # Several blocks are half full, so that chance doesn't fill one.
    blocks = 1 if seen["rows"] <= most else bucket_count(seen["rows"], most / 2)
    for number in range(blocks if seen["rows"] else 0):
        rows = held.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).toArrow()
        if rows.num_rows > most:
            raise RuntimeError("A block of test windows is larger than what may be sent to all tasks.")
        yield Block.of(rows.column("key").to_pylist(), rows.column("words").to_pylist(), window)


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, every: bool = False) -> DataFrame:
    """block, oid, rk, doc_id, n_words, ``spans`` of words that are hit (low, high, half open) and ``hits`` (key, at):
    of each window its first occurrence in the document, or ``every`` one. Block 0 has a row for every document, further
    blocks have one for each document that they hit."""
    spark = docs.sparkSession
    base = named(docs)
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = (
        f"oid bigint, rk int, doc_id {kind}, n_words bigint, spans array<struct<low: int, high: int>>, "
        "hits array<struct<key: binary, at: int>>"
    )

    def search(number: int, block: Block | None) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in pieces(batch, "text", SLICE_BYTES):
                yield _searched(part, sent.value, window, every)

        found = by_rows(base, run, schema).select(F.lit(number).alias("block"), "*")
        return found if number == 0 else found.where(F.size("hits") > 0)

    passes = [search(number, block) for number, block in enumerate(_blocks(windows, window))] or [search(0, None)]
    return functools.reduce(DataFrame.unionByName, passes)


def _searched(part: pa.RecordBatch, block: Block | None, window: int, every: bool) -> pa.RecordBatch:
    hashes, ahead = words_of(*joined_bytes(part.column("text")))
    size, rows = len(hashes), part.num_rows
    none = np.zeros(0, np.int64)
    found, place = found_in(block, hashes, ahead, window) if block and size else (none, none)
    row = np.searchsorted(ahead, place, side="right") - 1
    # Overlapping windows of a document are one span.
    edge = np.zeros(size + 1, np.int32)
    if len(found):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + block.lengths[found], -1)
    hit = np.cumsum(edge[:-1]) > 0
    at_start = np.zeros(size + 1, bool)
    at_start[ahead] = True
    opens = np.flatnonzero(hit & (~np.r_[False, hit[:-1]][:size] | at_start[:-1]))
    closes = np.flatnonzero(hit & (~np.r_[hit[1:], False][:size] | at_start[1:])) + 1
    of = np.searchsorted(ahead, opens, side="right") - 1
    spans = [pa.array((edge_ - ahead[of]).astype(np.int32)) for edge_ in (opens, closes)]
    order = np.lexsort((place, found, row))
    if not every and len(order):
        order = order[np.r_[True, (np.diff(row[order]) != 0) | (np.diff(found[order]) != 0)]]
    hits = [
        pa.array([block.keys[i] for i in found[order].tolist()] if len(order) else [], pa.binary()),
        pa.array((place[order] - ahead[row[order]]).astype(np.int32)),
    ]

    def listed(owner: np.ndarray, values: list[pa.Array], names: list[str]) -> pa.ListArray:
        ends = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names))

    return pa.RecordBatch.from_arrays(
        [
            *[part.column(name) for name in ("oid", "rk", "doc_id")],
            pa.array(np.diff(ahead)),
            listed(of, spans, ["low", "high"]),
            listed(row[order], hits, ["key", "at"]),
        ],
        ["oid", "rk", "doc_id", "n_words", "spans", "hits"],
    )


def _merged(spans: str) -> F.Column:
    """The number of words in a union of spans: sorted, each adds what lies behind the farthest end before it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        F.array_sort(spans),
        zero,
        lambda done, span: F.struct(
            (done["n"] + F.greatest(span["high"] - F.greatest(span["low"], done["end"]), F.lit(0))).alias("n"),
            F.greatest(done["end"], span["high"]).alias("end"),
        ),
    )
    return total["n"]


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    spark = docs.sparkSession
    windows, _ = materialize(test_windows(benchmark, window), scratch_path(spark, "test-windows"))
    found, _ = materialize(occurrences(docs, windows, window), scratch_path(spark, "occurrences"))
    holders = found.where(F.size("hits") > 0)
    # Both sides of the join are read from files, so that AQE can split a window that very many documents hold.
    named_windows, _ = materialize(windows.select("key", "item").distinct(), scratch_path(spark, "window-items"))
    held = holders.select("oid", "rk", F.explode("hits.key").alias("key"))
    items = held.join(named_windows, "key").select("oid", "rk", "item").distinct()
    # A document's own items and spans: bounded by the benchmark and by its length.
    named_items = items.groupBy("oid", "rk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = (
        holders.select("oid", "rk", F.explode("spans").alias("span"))
        .groupBy("oid", "rk")
        .agg(F.collect_set("span").alias("spans"))
    )
    counted = spans.join(named_items, ["oid", "rk"]).select(
        "oid",
        "rk",
        _merged("spans").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    every = found.where("block = 0").select("oid", "rk", "doc_id", "n_words")
    zero = F.lit(0).cast("bigint")
    return every.join(counted, ["oid", "rk"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item, item_start, doc_start and n_words of every longest verbatim match (places from 0): windows that
    follow each other both in the item and in the document are one match."""
    windows, _ = materialize(test_windows(benchmark, window), scratch_path(docs.sparkSession, "test-windows"))
    found = occurrences(docs, windows, window, every=True)
    placed = (
        found.select("oid", "rk", "doc_id", F.explode("hits").alias("hit"))
        .select("oid", "rk", "doc_id", "hit.key", "hit.at")
        .join(windows.withColumn("length", (F.octet_length("words") / 8).cast("int")).drop("words"), "key")
        .distinct()
    )
    # A match runs along one diagonal of item and document, which has no more windows than the item.
    diagonal = ["oid", "rk", "doc_id", "item", "source", F.col("at") - F.col("start")]
    step = F.row_number().over(Window.partitionBy(*diagonal).orderBy("at"))
    chained = placed.withColumn("chain", F.col("at") - step).groupBy("oid", "rk", "doc_id", "item", "source", "chain")
    return (
        chained.agg(F.min("start").alias("item_start"), F.min("at").alias("doc_start"), F.max("at").alias("last"), F.max("length").alias("length"))
        .select("doc_id", "item", "item_start", "doc_start", (F.col("last") - F.col("doc_start") + F.col("length")).alias("n_words"))
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    spark = docs.sparkSession
    windows, _ = materialize(test_windows(benchmark, window), scratch_path(spark, "test-windows"))

    def keep(held: DataFrame) -> DataFrame:
        hit = occurrences(held, windows, window).where(F.size("hits") > 0).select("oid", "rk").distinct()
        keyed = held.withColumn("oid", order_id()).withColumn("rk", F.hash("doc_id", "text"))
        return keyed.join(hit, ["oid", "rk"], "left_anti")

    return apart(docs, ["doc_id", "text"], keep)
