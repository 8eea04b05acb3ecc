"""Near duplicates by the exact Jaccard similarity of shingle sets, from SimHash and MinHash candidates.

1. Documents of equal sets of shingles are one entry. An entry has a 64-bit SimHash fingerprint, ``BANDS`` hashes of
   ``ROWS`` minima each, and one bit of each minimum as a sketch.
2. Candidate links: entries whose fingerprints differ in at most ``BITS`` bits, by the search of ``simhash``; and, since
   texts at 0.8 differ in about ten bits, entries that share a band: each is linked with the smallest and the largest
   that does. Two entries of similarity s agree in a band with 1 - (1 - s ** ROWS) ** BANDS, so of pairs at 0.8 about 1
   in 7 million shares none, and of closer ones fewer. A link whose sketches agree in fewer than ``LEAST_AGREEING`` bits
   is dropped: five deviations below what pairs at 0.8 agree in, far above what texts of one template at 0.4 do, so
   texts that only share a template don't grow into one group. A pair is lost where every band it shares has a centre
   that either is far from; bands share a centre with a template only if all their minima lie in it.
3. What links connect is a group. The texts of a group go to one task; those of a large group are dealt over chunks of
   bounded size, and every two chunks meet in a task. It compares sets exactly, so no pair below the bound is linked,
   and links breadth-first: about one link per entry, and none between entries that are connected already.

Shingles are compared as 64-bit hashes. Null and empty texts have the empty set and are duplicates of each other. Rows
that repeat a doc_id are taken each; rows equal in doc_id and text are one document. Other columns don't take part. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quayside.llm.common import mixed, order_id, pieces
from quayside.llm.components import components
from quayside.llm.simhash import SEED, fingerprint, links, shingle_hashes
from quayside.session import materialize, scratch_path

LEAST = (4, 5)  # the similarity that makes near duplicates, as a fraction
BANDS, ROWS = 52, 6
BITS = 3
LEAST_AGREEING = 254  # of BANDS * ROWS bits: 90 % is the mean at 0.8, 1.7 % the deviation
CHUNK = 250_000  # shingles of a chunk, about
FACTORS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
PLACES = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of a set of hashes (one at least) under each factor."""
    upper = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FACTORS), 2**32 - 1, np.uint32)
    for start in range(0, len(upper), 64):  # products that stay in the cache
        least = np.minimum(least, (upper[start : start + 64, None] * FACTORS).min(0))
    return mixed(least.astype(np.uint64))


def band_hashes(least: np.ndarray) -> np.ndarray:
    """One number per band."""
    return mixed((least.reshape(BANDS, ROWS) * PLACES).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def sketch(least: np.ndarray) -> list[int]:
    """One bit of each minimum, 64 to a number."""
    bits = np.zeros(-(-len(least) // 64) * 64, np.uint8)
    bits[: len(least)] = (least & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def entries(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rk, entry (a hash of the set of shingles), size of the set, ``fingerprint``, ``bands`` and ``sketch`` of
    every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                entry, size, prints, bands, sketches = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    every = shingle_hashes(text or b"", shingle)
                    hashes = np.unique(every)
                    least = minima(hashes) if len(hashes) else None
                    entry.append(xxh64_intdigest(hashes.tobytes(), SEED))
                    size.append(len(hashes))
                    prints.append(f"{int(fingerprint(every)[0]):016x}")
                    bands.append(b"" if least is None else band_hashes(least).tobytes())
                    sketches.append([] if least is None else sketch(least))
                columns = [part.column("doc_id"), part.column("rk"), pa.array(np.array(entry, np.uint64).view(np.int64))]
                columns += [pa.array(size, pa.int32()), pa.array(prints, pa.string()), pa.array(bands, pa.binary())]
                columns.append(pa.array(sketches, pa.list_(pa.int64())))
                names = ["doc_id", "rk", "entry", "size", "fingerprint", "bands", "sketch"]
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select("doc_id", F.hash("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, rk int, entry bigint, size int, fingerprint string, bands binary, sketch array<bigint>"
    return narrow.mapInArrow(run, schema)


def band_links(single: DataFrame) -> DataFrame:
    """(a, b) of entries that share a band: each with the smallest and the largest that does."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = np.repeat(batch.column("entry").to_numpy(zero_copy_only=False), BANDS)
            band = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(entry)], ["band", "entry"])

    dealt = single.select("entry", "bands").mapInArrow(deal, "band bigint, entry bigint")
    ends = dealt.groupBy("band").agg(F.min("entry").alias("least"), F.max("entry").alias("most")).where("least < most")
    both = dealt.join(ends, "band").select(F.col("entry").alias("a"), F.explode(F.array("least", "most")).alias("b"))
    return both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def print_links(single: DataFrame) -> DataFrame:
    """(a, b) of entries with near fingerprints: one entry stands for each fingerprint, the others are linked to it."""
    spark = single.sparkSession
    table = single.groupBy("fingerprint").agg(F.min("entry").alias("id"))
    held, seen = materialize(table, scratch_path(spark, "prints"))
    equal = single.select("entry", "fingerprint").join(held, "fingerprint").where("entry <> id")
    return links(held, seen["rows"], 1, 2, BITS).unionByName(equal.select(F.col("entry").alias("a"), F.col("id").alias("b")))


def candidate_links(found: DataFrame) -> DataFrame:
    """Links (a, b) between entries whose sketches allow the similarity."""
    spark = found.sparkSession
    single, _ = materialize(
        found.where("size > 0").dropDuplicates(["entry"]).select("entry", "fingerprint", "bands", "sketch"),
        scratch_path(spark, "single"),
    )
    # Written, the links are a plain side of the joins with the sketches.
    met, _ = materialize(
        band_links(single).unionByName(print_links(single)).distinct(), scratch_path(spark, "candidates")
    )
    sketches = single.select("entry", "sketch")
    both = (
        met.join(sketches.select(F.col("entry").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketches.select(F.col("entry").alias("b"), F.col("sketch").alias("sb")), "b")
    )
    differing = F.aggregate(
        F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x
    )
    return both.where(differing <= BANDS * ROWS - LEAST_AGREEING).select("a", "b")


def near_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Links (i, j) between similar sets that connect what is connected among them."""
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), sizes)[order]  # the sets of each token, one after another
    first = np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    open_ = np.ones(len(sets), bool)
    out = []
    for seed in range(len(sets)):
        queue = [seed] if open_[seed] else []
        open_[seed] = False
        while queue:
            if not open_[seed + 1 :].any():
                break
            i = queue.pop()
            own = token[ends[i] - sizes[i] : ends[i]]
            count = first[own + 1] - first[own]
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            shared = np.bincount(holder[np.repeat(first[own], count) + inside], minlength=len(sets))
            near = np.flatnonzero(open_ & (shared * LEAST[1] >= (sizes[i] + sizes - shared) * LEAST[0]))
            open_[near] = False
            out += [(i, j) for j in near.tolist()]
            queue += near.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def verified(docs: DataFrame, found: DataFrame, groups: DataFrame, shingle: int) -> DataFrame:
    """(a, b): entries whose sets are similar, enough links to connect all that are. ``groups`` has (node, root)."""
    spark = docs.sparkSession
    held = (
        found.groupBy("entry")
        .agg(F.min(F.struct(order_id().alias("oid"), "rk")).alias("f"), F.first("size").alias("size"))
        .join(groups, F.col("entry") == F.col("node"))
        .select("entry", "f.*", "size", "root")
    )
    held, _ = materialize(held, scratch_path(spark, "grouped"))
    chunks = held.groupBy("root").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("entry"), F.col("chunks")).cast("int")
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("own"))
    )
    dealt, _ = materialize(
        held.join(chunks, "root").withColumn("own", own).select("entry", "oid", "rk", "root", "own", other.alias("others")),
        scratch_path(spark, "chunks"),
    )
    texts = docs.select(
        order_id().alias("oid"), F.hash("doc_id", "text").alias("rk"), F.col("text").cast("binary").alias("text")
    )
    met = (
        texts.join(dealt, ["oid", "rk"])
        .select("entry", "text", "root", "own", F.explode("others").alias("other"))
        .select("entry", "text", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def solve(table: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for batch in table.select(["entry", "text"]).to_batches():
            for entry, text in zip(batch.column("entry").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if entry not in sets:
                    sets[entry] = np.unique(shingle_hashes(text or b"", shingle))
        names = np.array(list(sets), np.int64)
        pairs = near_pairs(list(sets.values()))
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return met.groupBy("root", "i", "j").applyInArrow(solve, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rk (a hash of doc_id and text) and class_id of every document: classes are connected by pairs of
    documents whose sets of shingles have at least the similarity ``LEAST``."""
    found, _ = materialize(entries(docs, shingle), scratch_path(docs.sparkSession, "entries"))
    groups = components(candidate_links(found))
    roots = components(verified(docs, found, groups, shingle))
    return found.join(roots, F.col("entry") == F.col("node"), "left").select(
        "doc_id", "rk", F.coalesce("root", "entry").alias("class_id")
    )
