"""Removes bytes of every ``window``-byte string that also starts earlier, by blockwise suffix sorting.

1. A string's anchor is the last smallest hash of its ``GRAM``-byte grams: equal strings have equal anchors at equal
   distances. Anchors that occur once in the corpus rule out all strings around them; the others name the suffixes to
   sort, and the suffix buckets: strings with the same anchor at the same distance.
2. The stretch of text that an anchor serves goes to its bucket's task. A task sorts one block of buckets at a time,
   by comparing each suffix with the first of its bucket and parting the bucket in three, again and again. Suffixes
   that agree in their first ``PERIOD`` bytes are told apart by the ranks of a difference-cover sample: for any two
   positions there is a step below ``PERIOD`` that brings both onto the sample, whose ranks (over ``DEPTH`` bytes) were
   computed for the block beforehand by doubling in steps of the period. The last bytes settle what is left.
   The number of blocks follows the corpus, so a block has a fixed size but for its largest bucket.
3. The first suffix of a bucket is its earliest, so what equals it is marked; marks return to their documents.

Hot anchors (a line in a third of all documents, amid different text) are found in a sample of the documents before the
first step: those with at least one ``HOT_SHARE``-th of its anchors, so at most ``HOT_SHARE`` of them, whose hashes are
broadcast. Each string around a hot anchor gets an anchor of its own, the hash of all its bytes: unequal strings part
company before any text is sent, and only those that occur again go to a bucket. The sample decides the path alone, not
the result. A bucket then holds at most about one ``HOT_SHARE``-th of the corpus' stretches.

Anchors and stretches that occur several times in one slice of a partition are settled there; only the earliest goes
on, so a passage in a third of all documents reaches its bucket once per slice.

Null and empty texts have no bytes. Null doc_ids come before all others. Rows with the same doc_id and text are one
document and give a row each; rows with the same doc_id and different texts are two documents, in the order of a hash.
Texts shorter than a string are kept whole. An empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import (
    bucket_count,
    by_bucket,
    joined_bytes,
    mixed,
    packed_rows,
    pieces,
    sliding,
    text_bytes,
    unpacked,
    window_hashes,
)
from quayside.llm.repeats import NAME, by_rows, covered, dealt_by_document, named, struct_column, with_marks
from quayside.session import materialize, scratch_path

WINDOW = 100
GRAM = 32
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)  # fixed values: each difference modulo 31 is one of two of these
DEPTH = WINDOW - PERIOD + 1
ANCHOR_BYTES = 8_000_000  # of anchors that meet in one task, about
BLOCK_BYTES = 3_000_000  # of text that one task sorts, about
SLICE_BYTES = 4_000_000  # of text whose stretches are packed together
SAMPLED = 16  # one document in so many is looked at for hot anchors
HOT_SHARE = 1 << 20
HOT_LEAST = BLOCK_BYTES // (WINDOW + GRAM) // SAMPLED  # times in the sample; fewer stretches fit a block anyway
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shift_table() -> np.ndarray:
    """The smallest step that brings positions of two residues onto the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(k for k in range(PERIOD) if inside[a + k] and inside[b + k])
    return table


SHIFTS = shift_table()


def slice_anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of joined texts: per anchor its hash, its text's row, the first and last string start it serves (in the joined
    bytes), and its own place."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none.astype(np.uint64), none, none, none, none
    grams = window_hashes(BYTE_VALUES[data], GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - place)
    best = sliding(packed, WINDOW - GRAM + 1, np.minimum)
    chosen = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(chosen)]
    whole = np.flatnonzero(np.arange(len(chosen)) + WINDOW <= starts[row + 1])
    if not len(whole):
        return none.astype(np.uint64), none, none, none, none
    at = chosen[whole]
    cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(whole) != 1)])
    low, high = whole[cuts], whole[np.r_[cuts[1:], len(whole)] - 1]
    return grams[at[cuts]], row[low], low, high, at[cuts]


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of the anchors that are common in a sample of the documents: ``HOT_SHARE`` at most, 8 MB."""
    sample = docs.where(F.pmod(F.xxhash64("oid", "rk"), F.lit(SAMPLED)) == 0)

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", SLICE_BYTES // 4):
            hashes, counts = np.unique(slice_anchors(*joined_bytes(part.column("text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], ["hash", "n"])

    seen = by_rows(sample, find, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    often, counts = materialize(
        seen.where(F.col("n") >= HOT_LEAST), scratch_path(docs.sparkSession, "often"), total=F.sum("n")
    )
    # Their sum is at least HOT_SHARE times the least of them, so there are no more than HOT_SHARE.
    hot = often.where(F.col("n") * HOT_SHARE >= counts["total"]).select("hash").toArrow()
    return np.sort(hot.column("hash").to_numpy().view(np.uint64))


def parted_hot(data: np.ndarray, held: tuple[np.ndarray, ...], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of a slice, where each string around a hot one has an anchor of its own, named by all its bytes."""
    hashes, row, low, high, place = held
    at = np.searchsorted(hot, hashes)
    is_hot = np.r_[hot, np.uint64(0)][at] == hashes
    is_hot &= at < len(hot)
    if not is_hot.any():
        return held
    count = (high - low + 1)[is_hot]
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[is_hot], count)
    strings = window_hashes(BYTE_VALUES[data], WINDOW, 0xC2B2AE3D27D4EB4F)[start]
    rest = [values[~is_hot] for values in held]
    added = [strings, np.repeat(row[is_hot], count), start, start, start]
    return tuple(np.concatenate(pair) for pair in zip(rest, added, strict=True))


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """oid, rk, hash, low, more, shift: the anchors that occur more than once. They serve the string starts from low
    to low + more and stand at low + shift."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs))
    columns = {"hash": "<u8", **NAME, "low": "<i4", "more": "u1", "shift": "u1", "known": "u1"}

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", SLICE_BYTES // 4):
            data, starts = joined_bytes(part.column("text"))
            hashes, row, low, high, place = parted_hot(data, slice_anchors(data, starts), hot.value)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            same = np.r_[False, hashes[order][1:] == hashes[order][:-1]]
            again = np.zeros(len(hashes), bool)
            again[order] = same
            twice = np.zeros(len(hashes), bool)
            twice[order] = same | np.r_[same[1:], False]
            oid = part.column("oid").to_numpy(zero_copy_only=False)[row]
            # 0: not known yet, 1: repeated in this slice, 2: a further one of those.
            known = np.where(again, 2, np.where(twice, 1, 0)).astype(np.uint8)
            held = {
                "hash": hashes,
                "oid": oid,
                "rk": part.column("rk").to_numpy(zero_copy_only=False)[row],
                "low": (low - starts[row]).astype("<i4"),
                "more": (high - low).astype(np.uint8),
                "shift": (place - low).astype(np.uint8),
                "known": known,
            }
            spread = np.where(again, mixed(oid.astype(np.uint64)), hashes >> np.uint64(32))
            yield packed_rows(by_bucket((spread % np.uint64(buckets)).astype(np.int64), held), list(held))

    def count(table: pa.Table) -> pa.Table:
        held = unpacked(table, columns)
        first = np.flatnonzero(held["known"] < 2)
        _, group, size = np.unique(held["hash"][first], return_inverse=True, return_counts=True)
        live = held["known"] > 0
        live[first] |= size[group] > 1
        out = {name: held[name][live] for name in columns if name != "known"}
        return pa.table({name: v.astype(np.int16) if v.dtype == np.uint8 else v.view("<i8") if name == "hash" else v for name, v in out.items()})

    packed = by_rows(docs, find, "bucket bigint, " + ", ".join(f"{name} binary" for name in columns))
    return packed.groupBy("bucket").applyInArrow(
        count, "hash bigint, oid bigint, rk int, low int, more smallint, shift smallint"
    )


class Block:
    """The suffixes of one block: the stretches of some anchors, and the first positions to compare."""

    def __init__(self, data: np.ndarray):
        self.data = np.r_[data, np.zeros(WINDOW, np.uint8)]
        key = np.zeros(len(self.data) - 7, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | self.data[i : i + len(key)]
        self.key = key  # the eight bytes from each position on, as a number
        self.rank = self._ranks(len(data))

    def _ranks(self, size: int) -> np.ndarray:
        """Ranks of the sample positions by ``DEPTH`` bytes, by doubling in steps of the period."""
        sample = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER))
        sample = sample[sample + DEPTH <= size]
        rank = np.zeros(size + WINDOW, np.int64)

        def name(keys: list[np.ndarray], at: np.ndarray) -> None:
            order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
            new = np.zeros(len(order), bool)
            for key in keys:
                new[1:] |= key[order][1:] != key[order][:-1]
            rank[at[order]] = np.cumsum(new)

        if len(sample):
            every = np.flatnonzero(np.isin(np.arange(size) % PERIOD, COVER) & (np.arange(size) + PERIOD <= size))
            name([self.key[every + step] for step in (0, 8, 16, PERIOD - 8)], every)
            twice = (rank[sample] << 32) | rank[sample + PERIOD]
            name([twice, self.key[sample + DEPTH - 8]], sample)
        return rank

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Order of the strings at positions a and b: -1, 0 or 1."""
        out = np.zeros(len(a), np.int8)

        def settle(x: np.ndarray, y: np.ndarray, open_: np.ndarray) -> np.ndarray:
            out[open_] = (x > y).astype(np.int8) - (x < y)
            return open_[out[open_] == 0]

        left = np.arange(len(a))
        for step in (0, 8, 16, PERIOD - 8):
            left = settle(self.key[a[left] + step], self.key[b[left] + step], left)
        shift = SHIFTS[a[left] % PERIOD, b[left] % PERIOD]
        left = settle(self.rank[a[left] + shift], self.rank[b[left] + shift], left)
        for step in (DEPTH, DEPTH + 8, DEPTH + 16, WINDOW - 8):
            left = settle(self.key[a[left] + step], self.key[b[left] + step], left)
        return out


def later_copies(block: Block, position: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Marks each suffix that equals an earlier one of its bucket. Suffixes are given in the order of the corpus and
    sorted by bucket; each round parts every bucket in three around its first suffix."""
    marked = np.zeros(len(position), bool)
    rows = np.arange(len(position))
    while True:
        start = np.r_[True, bucket[1:] != bucket[:-1]] if len(rows) else np.zeros(0, bool)
        size = np.diff(np.r_[np.flatnonzero(start), len(rows)])
        keep = np.repeat(size > 1, size)
        rows, bucket, start = rows[keep], bucket[keep], start[keep]
        if not len(rows):
            return marked
        first = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        side = block.compare(position[rows], position[rows[first]])
        side[start] = 0
        marked[rows[(side == 0) & ~start]] = True
        rest = np.flatnonzero(side != 0)
        parted = np.cumsum(start)[rest] * 2 + (side[rest] > 0)
        order = np.argsort(parted, kind="stable")
        rows, bucket = rows[rest[order]], parted[order]


def later_strings(joined: DataFrame, blocks: int) -> DataFrame:
    """oid, rk, low, high: runs of string starts that also start earlier. ``joined`` has the repeated anchors of each
    document as ``marks``."""
    kinds = {"hash": "<i8", **NAME, "low": "<i4", "more": "u1", "shift": "u1"}

    def stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text", SLICE_BYTES):
            records: dict[tuple, list] = {}
            settled: list[tuple[int, int, int, int]] = []
            marks = part.column("marks")
            for row, (oid, rk, text) in enumerate(
                zip(part.column("oid").to_pylist(), part.column("rk").to_pylist(), part.column("text").to_pylist(), strict=True)
            ):
                fields = struct_column(marks, row, ["hash", "low", "more", "shift"])
                for hash_, low, more, shift in zip(*[f.tolist() for f in fields], strict=True):
                    key = (text[low : low + more + WINDOW], shift)
                    new = (oid, rk, low, hash_)
                    old = records.get(key)
                    if old is None or new < old:
                        records[key] = new
                    if old is not None:
                        lost = max(old, new)
                        settled.append((lost[0], lost[1], lost[2], lost[2] + more))
            if not records:
                continue
            texts = [key[0] for key in records]
            oid, rk, low, hash_ = (np.array(v, np.int64) for v in zip(*records.values(), strict=True))
            block = (mixed(hash_.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            held = {
                "hash": hash_,
                "oid": oid,
                "rk": rk.astype("<i4"),
                "low": low.astype("<i4"),
                "more": np.array([len(text) - WINDOW for text in texts], np.uint8),
                "shift": np.array([key[1] for key in records], np.uint8),
                "number": np.arange(len(texts)),
            }
            rows = []
            for bucket, values in by_bucket(block, held):
                numbers = np.frombuffer(values.pop("number"), np.int64).tolist()
                data = pa.compress(b"".join([texts[i] for i in numbers]), "zstd", asbytes=True)
                rows.append((bucket, values | {"data": data, "settled": b""}))
            if settled:
                empty = dict.fromkeys([*kinds, "data"], b"")
                rows.append((abs(settled[0][1]) % blocks, empty | {"settled": np.array(settled, "<i8").tobytes()}))
            yield packed_rows(rows, [*kinds, "data", "settled"])

    def solve(table: pa.Table) -> pa.Table:
        held = unpacked(table, kinds)
        parts = []
        for more, packed in zip(table.column("more").to_pylist(), table.column("data").to_pylist(), strict=True):
            if packed:
                size = int(np.frombuffer(more, np.uint8).sum(dtype=np.int64)) + WINDOW * len(more)
                parts.append(pa.decompress(packed, size, "zstd", asbytes=True))
        data = np.frombuffer(b"".join(parts), np.uint8)
        settled = np.frombuffer(b"".join(table.column("settled").to_pylist()), "<i8").reshape(-1, 4)
        count = held["more"].astype(np.int64) + 1
        begin = np.cumsum(count + WINDOW - 1) - (count + WINDOW - 1)
        order = np.lexsort((held["low"], held["rk"], held["oid"], held["hash"]))
        anchor = np.cumsum(np.r_[False, np.diff(held["hash"][order]) != 0][: len(order)])
        record = np.repeat(order, count[order])
        inside = np.arange(len(record)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
        distance = held["shift"][record].astype(np.int64) - inside
        bucket = np.repeat(anchor, count[order]) * 512 + distance + 256
        by = np.argsort(bucket, kind="stable")
        marked = np.zeros(len(record), bool)
        if len(by):
            marked[by] = later_copies(Block(data), begin[record[by]] + inside[by], bucket[by])
        # Consecutive marked starts of a record are one run.
        edge = np.r_[True, record[1:] != record[:-1]] if len(record) else marked
        opens = np.flatnonzero(marked & (edge | ~np.r_[False, marked[:-1]][: len(marked)]))
        closes = np.flatnonzero(marked & (np.r_[edge[1:], True][: len(marked)] | ~np.r_[marked[1:], False][: len(marked)]))
        of = record[opens]
        return pa.table(
            {
                "oid": np.r_[held["oid"][of], settled[:, 0]],
                "rk": np.r_[held["rk"][of], settled[:, 1]].astype(np.int32),
                "low": np.r_[held["low"][of] + inside[opens], settled[:, 2]].astype(np.int32),
                "high": np.r_[held["low"][of] + inside[closes], settled[:, 3]].astype(np.int32),
            }
        )

    columns = ", ".join(f"{name} binary" for name in [*kinds, "data", "settled"])
    packed = by_rows(joined, stretches, f"bucket bigint, {columns}")
    return packed.groupBy("bucket").applyInArrow(solve, "oid bigint, rk int, low int, high int")


def marked(docs: DataFrame) -> DataFrame:
    """oid, rk, doc_id, text (bytes) of every document, and ``marks``: the runs (low, high) of string starts whose
    bytes are to go, null where there is none."""
    size = text_bytes(docs)
    base = named(docs)
    documents = dealt_by_document(base)
    live = repeated_anchors(base, bucket_count(size / 35 * 27, ANCHOR_BYTES))
    joined = with_marks(documents, live, ["hash", "low", "more", "shift"], "inner")
    again = later_strings(joined, bucket_count(size, BLOCK_BYTES))
    return with_marks(documents, again, ["low", "high"], "left")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, removed, spans, digests = [], [], [], []
        marks = batch.column("marks")
        for row, text in enumerate(batch.column("text").to_pylist()):
            low, high = struct_column(marks, row, ["low", "high"])
            gone = covered(low, high, WINDOW, len(text)) if len(low) else np.zeros(0, bool)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(gone) else text
            sizes.append(len(text))
            removed.append(len(text) - len(kept))
            spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
            digests.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(v, pa.int64()) for v in (sizes, removed, spans)], pa.array(digests)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_rows(
        marked(docs).select("doc_id", "text", "marks"),
        digest,
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    )
