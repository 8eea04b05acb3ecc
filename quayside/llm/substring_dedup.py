"""Removes passages of ``window`` words that an earlier document holds too, with a count-min prefilter.

1. Each window's anchor is the last smallest hash of the ``GRAM``-word grams inside it, so equal windows have equal
   anchors at equal distances, and an anchor is seen at least as often as any of its windows. Each slice of a partition
   counts its anchors, once per document, into the cells of ``ROWS`` hash rows; the cells of all slices are summed by a
   Spark aggregate, whose map side merges the sketches of a partition. The sketch has one cell space whose size follows
   the corpus; only cells that were hit are rows, so it is never held in one place.
2. A window is estimated repeated if each row gives its anchor two or more. Estimates are never too low: no repeated
   window is lost. An anchor that two documents of one slice hold is known to be repeated; the others look themselves up
   in the merged cells, once per slice, by joins whose sides are plain, so that AQE can split a cell that many ask for.
3. A second pass over the texts hashes only those windows, to 128 bits. Equal ones meet in a bucket, where all but
   those of the smallest document are marked. Each partition first drops what it can decide itself: of the copies of a
   window only its earliest goes on. So a passage in a third of all documents reaches a task once per slice.
4. Marks return to the documents.

Null and empty texts have no words. Null doc_ids come before all others. Rows with the same doc_id and text are one
document and give a row each; rows with the same doc_id and different texts are two documents, in the order of a hash.
Texts shorter than a window are kept whole. An empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quayside.llm.common import (
    WORD,
    anchors,
    bucket_count,
    by_bucket,
    mixed,
    order_id,
    packed_rows,
    pieces,
    text_bytes,
    unpacked,
    window_hashes,
)
from quayside.llm.repeats import NAME, by_rows, covered, dealt_by_document, named, struct_column, with_marks
from quayside.session import materialize, scratch_path

WINDOW = 50
GRAM = 8
ROWS = 2  # of the count-min sketch
LOAD = 0.1  # anchors per cell of a row that the number of cells is chosen for
BUCKET_BYTES = 24_000_000  # of windows that meet in one task, about
SECOND = 0xD6E8FEB86659FD93


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor its hash and the first and last window start it serves; and the hashes of all words."""
    words = word_hashes(WORD.findall(text))
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none.astype(np.uint64), none, none, words
    grams = window_hashes(words, GRAM)
    place, low, high = anchors(grams, window - GRAM + 1)
    return grams[place], low, high, words


def slice_sketches(docs: DataFrame, cells: int, window: int) -> DataFrame:
    """Per slice and anchor: ``cells`` (its cell in each row of the sketch), ``documents`` of the slice that hold it (two
    stands for more), and ``runs`` (oid, rk, low, high): the runs of window starts that it serves in them."""

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            held: list[tuple] = []
            for oid, rk, text in zip(
                part.column("oid").to_pylist(), part.column("rk").to_pylist(), part.column("text").to_pylist(), strict=True
            ):
                found, low, high, _ = _anchors(text, window)
                if len(found):
                    held.append((found, low, high, np.full(len(found), oid), np.full(len(found), rk, np.int32)))
            if held:
                yield _sketch_rows(*(np.concatenate(column) for column in zip(*held, strict=True)), cells)

    fields = "array<struct<oid: bigint, rk: int, low: int, high: int>>"
    return by_rows(docs, sketch, f"cells array<bigint>, documents int, runs {fields}")


def _sketch_rows(
    found: np.ndarray, low: np.ndarray, high: np.ndarray, oid: np.ndarray, rk: np.ndarray, cells: int
) -> pa.RecordBatch:
    order = np.lexsort((rk, oid, found))
    found, low, high, oid, rk = (values[order] for values in (found, low, high, oid, rk))
    new = np.r_[True, found[1:] != found[:-1]]
    other = ~new & np.r_[False, (oid[1:] != oid[:-1]) | (rk[1:] != rk[:-1])]
    starts = np.flatnonzero(new)
    documents = 1 + np.minimum(np.add.reduceat(other, starts), 1)
    rows = [
        (mixed(found[starts] + np.uint64(row * SECOND & (1 << 64) - 1)) % np.uint64(cells)).astype(np.int64) + row * cells
        for row in range(ROWS)
    ]
    runs = pa.StructArray.from_arrays(
        [pa.array(oid), pa.array(rk), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
        ["oid", "rk", "low", "high"],
    )
    place = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * np.int32(ROWS))
    return pa.RecordBatch.from_arrays(
        [
            pa.ListArray.from_arrays(place, pa.array(np.stack(rows, 1).ravel())),
            pa.array(documents.astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.r_[starts, len(found)].astype(np.int32)), runs),
        ],
        ["cells", "documents", "runs"],
    )


def repeated_anchors(docs: DataFrame, cells: int, window: int) -> DataFrame:
    """oid, rk, low, high: the runs of window starts whose anchor is estimated to be in two documents or more."""
    seen = slice_sketches(docs, cells, window)
    counts = seen.select(F.explode("cells").alias("cell"), "documents").groupBy("cell").agg(F.sum("documents").alias("n"))
    # Written, the merged sketch is a plain side of the joins.
    full, _ = materialize(counts.where("n >= 2").select("cell"), scratch_path(docs.sparkSession, "sketch"))
    known = seen.where("documents > 1").select("runs")
    asking = seen.where("documents = 1")
    for row in range(ROWS):
        asking = asking.join(full, F.get("cells", F.lit(row)) == F.col("cell"), "left_semi")
    return known.unionByName(asking.select("runs")).select(F.inline("runs"))


def _first_of_each(keys: list[np.ndarray], oid: np.ndarray, rk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts records by key and document; returns the order, and which ones belong to a key's smallest document."""
    order = np.lexsort((rk, oid, *reversed(keys)))
    change = np.zeros(len(order), bool)
    for key in keys:
        change[1:] |= key[order][1:] != key[order][:-1]
    change[:1] = True
    start = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    return order, (oid[order] == oid[order][start]) & (rk[order] == rk[order][start])


def repeated_windows(joined: DataFrame, buckets: int, window: int) -> DataFrame:
    """oid, rk, low, high: runs of the window starts that also start in a smaller document. ``joined`` has each
    document's estimated runs as ``marks``."""

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(batch, "text"):
            marks = part.column("marks")
            held: list[tuple] = []
            for row, (oid, rk, text) in enumerate(
                zip(part.column("oid").to_pylist(), part.column("rk").to_pylist(), part.column("text").to_pylist(), strict=True)
            ):
                low, high = struct_column(marks, row, ["low", "high"])
                words = word_hashes(WORD.findall(text))
                wanted = np.flatnonzero(covered(low, high, 1, len(words) - window + 1))
                one = window_hashes(words, window)[wanted]
                two = window_hashes(words, window, SECOND)[wanted]
                held.append((one, two, np.full(len(one), oid), np.full(len(one), rk, np.int32), wanted.astype("<i4")))
            one, two, oid, rk, at = (np.concatenate(column) for column in zip(*held, strict=True))
            # Copies of a window inside this slice: all but those of the smallest document are decided already.
            order, first = _first_of_each([one, two], oid, rk)
            decided = np.zeros(len(order), bool)
            decided[order] = ~first
            columns = {"one": one, "two": two, "oid": oid, "rk": rk, "at": at}
            out = {name: values[~decided] for name, values in columns.items()}
            bucket = ((out["one"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            out["done"] = np.zeros(len(bucket), bool)
            rows = list(by_bucket(bucket, out))
            if decided.any():
                # Decided ones pass through any bucket, as runs of their starts.
                kept = {name: columns[name][decided] for name in ("oid", "rk", "at")}
                rows.append((int(oid[0]) % buckets, {"one": b"", "two": b"", **_as_runs(**kept), "done": b"\1"}))
            if rows:
                yield packed_rows(rows, ["one", "two", "oid", "rk", "at", "done"])

    def exact(table: pa.Table) -> pa.Table:
        flags = [done == b"\1" and not one for done, one in zip(table.column("done").to_pylist(), table.column("one").to_pylist(), strict=True)]
        passed = table.filter(pa.array(flags))
        held = unpacked(table.filter(pa.array([not flag for flag in flags])), {"one": "<u8", "two": "<u8", **NAME, "at": "<i4"})
        order, first = _first_of_each([held["one"], held["two"]], held["oid"], held["rk"])
        again = order[~first]
        out = _run_table(held["oid"][again], held["rk"][again], held["at"][again])
        spans = unpacked(passed, {**NAME, "at": "<i4"})
        pairs = spans["at"].reshape(-1, 2)
        return pa.table(
            {
                "oid": np.r_[out["oid"], spans["oid"]],
                "rk": np.r_[out["rk"], spans["rk"]],
                "low": np.r_[out["low"], pairs[:, 0]].astype(np.int32),
                "high": np.r_[out["high"], pairs[:, 1]].astype(np.int32),
            }
        )

    packed = by_rows(joined, hashed, "bucket bigint, one binary, two binary, oid binary, rk binary, at binary, done binary")
    return packed.groupBy("bucket").applyInArrow(exact, "oid bigint, rk int, low int, high int")


def _run_table(oid: np.ndarray, rk: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    order = np.lexsort((at, rk, oid))
    oid, rk, at = oid[order], rk[order], at[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(oid) != 0) | (np.diff(rk) != 0)][: len(at)])
    last = np.r_[cuts[1:], len(at)] - 1 if len(cuts) else cuts
    return {"oid": oid[cuts], "rk": rk[cuts], "low": at[cuts], "high": at[last]}


def _as_runs(oid: np.ndarray, rk: np.ndarray, at: np.ndarray) -> dict[str, bytes]:
    held = _run_table(oid, rk, at)
    spans = np.stack([held["low"], held["high"]], 1).astype("<i4")
    return {"oid": held["oid"].tobytes(), "rk": held["rk"].tobytes(), "at": spans.tobytes()}


def repeated(docs: DataFrame, window: int = WINDOW, documents: DataFrame | None = None) -> DataFrame:
    """oid, rk, low, high: the runs of window starts to remove, of all documents."""
    size = text_bytes(docs)
    base = named(docs)
    anchors_likely = size / 6 / ((window - GRAM + 2) / 2)
    live = repeated_anchors(base, bucket_count(anchors_likely, LOAD, 1 << 20), window)
    joined = with_marks(documents or dealt_by_document(base), live, ["low", "high"], "inner")
    return repeated_windows(joined, bucket_count(size / 6 * 28 / 4, BUCKET_BYTES), window)


def marked(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """oid, rk, doc_id, text (bytes) of every document, and ``marks``: the runs (low, high) of window starts to
    remove, null where there is none."""
    documents = dealt_by_document(named(docs))
    return with_marks(documents, repeated(docs, window, documents), ["low", "high"], "left")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def digest(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, removed, digests = [], [], []
        marks = batch.column("marks")
        for row, text in enumerate(batch.column("text").to_pylist()):
            words = WORD.findall(text)
            low, high = struct_column(marks, row, ["low", "high"])
            gone = covered(low, high, window, len(words))
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_rows(
        marked(docs, window).select("doc_id", "text", "marks"),
        digest,
        f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string",
    )


def without_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the words that are left as their text; texts that lose none stay as they are, and documents
    that lose all their words go."""

    names = docs.columns

    def shorten(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts: list[str | None] = []
        marks = batch.column("marks")
        for row, text in enumerate(batch.column("text").to_pylist()):
            low, high = struct_column(marks, row, ["low", "high"])
            if not len(low):
                texts.append(text)
                continue
            words = WORD.findall((text or "").encode())
            gone = covered(low, high, window, len(words))
            texts.append(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()]).decode() or None)
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        lost = pa.array([text is None and mark for text, mark in zip(texts, marks.is_valid().to_pylist(), strict=True)])
        out = pa.RecordBatch.from_arrays(columns, names)
        yield out.filter(pa.compute.invert(lost))

    again = repeated(docs, window)
    keyed = docs.select(order_id().alias("oid"), F.hash("doc_id", "text").alias("rk"), *[F.col(c) for c in docs.columns])
    joined = with_marks(keyed, again, ["low", "high"], "left")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return by_rows(joined.select(*docs.columns, "marks"), shorten, fields)
