"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. By the pigeonhole principle two fingerprints at a small distance agree in some
segment but for a bit or so; each fingerprint therefore enumerates the small Hamming ball around each of its segment
values, fetches the table entries found there, and complete distances are verified. Flips of a segment's low bits stay
inside one block of the table; only flips of the few leading bits that name the block send a row to a second block.

Only spanning links are emitted: within a bucket a breadth-first search links what is reachable, so a group of m near
copies gives about m links, not m squared, and no link between different groups is lost. Equal fingerprints are one
table entry.

Null and empty texts have no words: their fingerprint is zero and they are duplicates of each other. Rows that repeat a
doc_id are fingerprinted each. A null doc_id is kept; it names a component only if all its members have
none. Other
columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quayside.llm.common import WORD, by_bucket, mixed, packed_rows, pieces, unpacked
from quayside.llm.components import components
from quayside.session import materialize, scratch_path

SEED = 42
BLOCK_ROWS = 30_000  # table entries that one task holds, about
SMALL = 64  # buckets up to this size are compared pair by pair
LARGE = 2048  # and beyond this size parted by groups of at least
GROUP_BITS = 8  # bits


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, lower-cased (A-Z) and joined by spaces; repeats included."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + size + 1))
    starts = [0, *[end + 1 for end in ends[:-1]]]
    last = min(shingle, len(words)) - 1
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[last:])], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is set if it is set in over half of the hashes. Words after the first use the hashes mixed anew."""
    out = np.zeros(words, np.uint64)
    for word in range(words if len(hashes) else 0):
        held = hashes if word == 0 else mixed(hashes + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        set_in = np.zeros(64, np.int64)
        for start in range(0, len(held), 4096):
            part = np.ascontiguousarray(held[start : start + 4096], "<u8").view(np.uint8).reshape(-1, 8)
            set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = np.packbits(2 * set_in > len(held), bitorder="little")
        out[word] = bits.view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, rk (a hash of doc_id and text, which tells rows of one id apart) and ``fingerprint`` (64 bits in hex per
    word) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [
                    "".join(f"{word:016x}" for word in fingerprint(shingle_hashes(text or b"", shingle), words).tolist())
                    for text in part.column("text").to_pylist()
                ]
                columns = [part.column("doc_id"), part.column("rk"), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "fingerprint"])

    narrow = docs.select("doc_id", F.hash("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, rk int, fingerprint string")


def _spanning(prints: np.ndarray, limit: int) -> list[np.ndarray]:
    """Links (i, j) that connect what is connected among many fingerprints.

    A large bucket is parted first: two near fingerprints agree in at least one of ``limit`` + 1 groups of the bits that
    vary in it, so only those that agree in a group are compared, unless the limit is too wide for such groups.
    """
    if len(prints) > LARGE:
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)
        varying = np.flatnonzero(bits.any(0) & ~bits.all(0))
        if len(varying) >= GROUP_BITS * (limit + 1):
            found = []
            for group in np.array_split(varying, limit + 1):
                key = np.packbits(bits[:, group], axis=1)
                value = np.ascontiguousarray(key).view(f"V{key.shape[1]}").ravel()
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.r_[True, value[order][1:] != value[order][:-1], True])
                for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if high - low > 1:
                        rows = order[low:high]
                        found += [rows[links] for links in _search(prints[rows], limit)]
            return found
    return _search(prints, limit)


def _search(prints: np.ndarray, limit: int) -> list[np.ndarray]:
    """Links by breadth-first search: each round compares one fingerprint with those that nothing has reached yet."""
    left = np.arange(len(prints))
    links = []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            for i in queue.pop().tolist():
                near = np.bitwise_count(prints[left] ^ prints[i]).sum(1) <= limit
                if near.any():
                    met = left[near]
                    links.append(np.stack([np.full(len(met), i), met], 1))
                    queue.append(met)
                    left = left[~near]
                    if not len(left):
                        break
    return links


def _across(prints: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int) -> list[np.ndarray]:
    """Links that connect what is connected in the union of two large buckets, at any limit."""
    rows = np.r_[one, two]
    return [rows[links] for links in _spanning(prints[rows], limit)]


def _pairs(starts: np.ndarray, sizes: np.ndarray, of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (member of bucket ``of``, member of bucket ``to``) for lists of small buckets."""
    count = sizes[of] * sizes[to]
    which = np.repeat(np.arange(len(of)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return starts[of][which] + inside // sizes[to][which], starts[to][which] + inside % sizes[to][which]


def block_links(ids: np.ndarray, prints: np.ndarray, values: np.ndarray, visitor: np.ndarray, low: int, limit: int):
    """Links of one block of one segment's table. ``values`` are the segment values; a visitor's is already flipped
    to the value that it looks for. Enumerates the flips of the ``low`` lowest bits."""
    order = np.lexsort((visitor, values))
    ids, prints, values, visitor = ids[order], prints[order], values[order], visitor[order]
    home = np.flatnonzero(~visitor)
    found: list[np.ndarray] = []

    def check(a: np.ndarray, b: np.ndarray) -> None:
        for start in range(0, len(a), 1_000_000):
            x, y = a[start : start + 1_000_000], b[start : start + 1_000_000]
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(1) <= limit
            found.append(np.stack([x[near], y[near]], 1))

    def buckets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, first, sizes = np.unique(values[rows], return_index=True, return_counts=True)
        return keys, first, sizes

    def meet(rows_a, a, rows_b, b) -> None:
        """Compares buckets of equal keys of two lists."""
        (keys_a, first_a, size_a), (keys_b, first_b, size_b) = a, b
        at = np.searchsorted(keys_b, keys_a)
        hit = np.flatnonzero(keys_b[np.minimum(at, len(keys_b) - 1)] == keys_a) if len(keys_b) else at[:0]
        if not len(hit):
            return
        to = at[hit]
        big = size_a[hit] * size_b[to] > SMALL * SMALL
        small, small_to = hit[~big], to[~big]
        starts, sizes = np.r_[first_a, first_b + len(rows_a)], np.r_[size_a, size_b]
        both = np.r_[rows_a, rows_b]
        x, y = _pairs(starts, sizes, small, small_to + len(keys_a))
        check(both[x], both[y])
        for i, j in zip(hit[big].tolist(), to[big].tolist(), strict=True):
            found.extend(
                _across(
                    prints,
                    rows_a[first_a[i] : first_a[i] + size_a[i]],
                    rows_b[first_b[j] : first_b[j] + size_b[j]],
                    limit,
                )
            )

    own = buckets(home)
    keys, first, sizes = own
    several = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    x, y = _pairs(first, sizes, several, several)
    check(home[x[x < y]], home[y[x < y]])
    for i in np.flatnonzero(sizes > SMALL).tolist():
        rows = home[first[i] : first[i] + sizes[i]]
        found.extend(rows[links] for links in _spanning(prints[rows], limit))
    for bit in range(low):
        flipped = keys ^ np.uint64(1 << bit)
        up = np.flatnonzero(keys < flipped)
        turned = np.argsort(flipped[up], kind="stable")
        meet(home, (flipped[up][turned], first[up][turned], sizes[up][turned]), home, own)
    guests = np.flatnonzero(visitor)
    if len(guests):
        meet(guests, buckets(guests), home, own)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return ids[pairs[:, 0]], ids[pairs[:, 1]]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between ids one per id: to the smallest id that it reaches over them. A block thus hands on no more
    links than it has members, however many of its pairs are near."""
    ids, place = np.unique(np.r_[a, b], return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def links(table: DataFrame, entries: int, words: int, per_word: int, max_distance: int) -> DataFrame:
    """Spanning links (a, b) of ``table`` (id bigint, fingerprint hex string), ids and fingerprints each unique.

    Every 64-bit word is cut into ``per_word`` segments. All pairs are found that have a segment with at most one
    differing bit and at most ``max_distance`` differing bits in all; with 2 * segments > max_distance these are all
    pairs at that distance.
    """
    width = 64 // per_word
    lead = min(width - 1, max(0, math.ceil(math.log2(max(1, entries) / BLOCK_ROWS))))
    low = width - lead

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            raw = bytes.fromhex("".join(batch.column("fingerprint").to_pylist()))
            prints = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, words)
            rows: list[tuple[int, dict[str, bytes]]] = []
            for segment in range(words * per_word):
                value = prints[:, segment // per_word] >> np.uint64(width * (segment % per_word))
                value = value & np.uint64((1 << width) - 1)
                for flip in range(-1, lead):
                    # The one whose leading bit is clear visits the other's block.
                    mask = np.uint64(0 if flip < 0 else 1 << (low + flip))
                    who = np.flatnonzero(value & mask == 0)
                    seen = value[who] ^ mask
                    block = (seen >> np.uint64(low)).astype(np.int64) + (segment << lead)
                    rows += by_bucket(
                        block,
                        {
                            "ids": ids[who],
                            "prints": np.ascontiguousarray(prints[who]).view(f"V{8 * words}").ravel(),
                            "seen": seen,
                            "visitor": np.full(len(who), flip >= 0),
                        },
                    )
            if rows:
                yield packed_rows(rows, ["ids", "prints", "seen", "visitor"])

    def solve(part: pa.Table) -> pa.Table:
        held = unpacked(part, {"ids": "<i8", "prints": "<u8", "seen": "<u8", "visitor": "?"})
        a, b = block_links(
            held["ids"], held["prints"].reshape(-1, words), held["seen"], held["visitor"], low, max_distance
        )
        member, least = stars(a, b)
        return pa.table({"a": member, "b": least})

    schema = "bucket bigint, ids binary, prints binary, seen binary, visitor binary"
    return table.select("id", "fingerprint").mapInArrow(deal, schema).groupBy("bucket").applyInArrow(
        solve, "a bigint, b bigint"
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 3, words: int = 1, per_word: int = 2, max_distance: int = 2
) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id that links reach), class_id (a number for the component)
    and rk of every document."""
    spark = docs.sparkSession
    prints, _ = materialize(fingerprints(docs, shingle, words), scratch_path(spark, "fingerprints"))
    nobody = 2**63 - 1  # stands for a null doc_id: the largest
    grouped = prints.groupBy("fingerprint").agg(F.coalesce(F.min("doc_id"), F.lit(nobody)).cast("long").alias("least"))
    own = F.xxhash64("fingerprint") if words > 1 else F.conv("fingerprint", 16, -10).cast("long")
    numbered = grouped.withColumn("id", own)
    table, seen = materialize(numbered, scratch_path(spark, "entries"))
    roots = components(links(table, seen["rows"], words, per_word, max_distance))
    named = table.join(roots, table["id"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "id").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(smallest, "root").select(
        "fingerprint", F.nullif("component_id", F.lit(nobody)).alias("component_id"), F.col("root").alias("class_id")
    )
    return prints.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id", "class_id", "rk")
