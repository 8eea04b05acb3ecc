"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
WORD_CLASS = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once per application, for clusters on which it isn't installed."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """The fold that labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def order_id(doc_id: str = "doc_id") -> Column:
    """The document id as an order that nulls come first in."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))


def row_key() -> Column:
    """Tells rows apart that carry the same doc_id. Rows equal in id and text share it: they are one document."""
    return F.xxhash64("doc_id", "text")


def apart(docs: DataFrame, needed: list[str], operate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies ``operate``, which keeps all columns, with every column but ``needed`` under a name of its own, so that
    no column of the input can clash with the operator's. The result has the columns of ``docs``."""
    inner = [name if name in needed else f"__c{i}" for i, name in enumerate(docs.columns)]
    return operate(docs.toDF(*inner)).select(*[F.col(a).alias(b) for a, b in zip(inner, docs.columns, strict=True)])


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; only sizes the number of buckets, never the result."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def bucket_count(amount: float, per_bucket: float, least: int = 1) -> int:
    return max(least, int(-(-amount // per_bucket)))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch that hold about ``limit`` bytes of ``column`` each (one row at least)."""
    values = batch.column(column)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1 + values.offset)[values.offset :]
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(values))
        yield batch.slice(start, stop - start)
        start = stop


def joined_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in one array, and where each value starts (one more entry than values).
    Nulls are empty."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1 + values.offset)[values.offset :]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int64)


def by_bucket(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, bytes]]]:
    """Packs records into one row of binary columns per bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    at = bucket[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    dealt = {name: values[order] for name, values in columns.items()}
    for low, high in zip(cuts, np.r_[cuts[1:], len(at)], strict=True):
        yield int(at[low]), {name: values[low:high].tobytes() for name, values in dealt.items()}


def packed_rows(rows: Iterable[tuple[int, dict[str, bytes]]], names: list[str]) -> pa.RecordBatch:
    rows = list(rows)
    arrays = [pa.array([b for b, _ in rows], pa.int64())]
    arrays += [pa.array([values[name] for _, values in rows], pa.binary()) for name in names]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *names])


def unpacked(table: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The records of packed rows again."""
    return {
        name: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind) for name, kind in kinds.items()
    }


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a sum can serve as a bucket."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < count:
        size = 1 << max(16, int(count - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:count], have[1][:count]


def window_hashes(values: np.ndarray, length: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive values, as differences of one running polynomial."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up, out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:count])


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``width`` consecutive values, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = best(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = best(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ``width`` consecutive gram hashes the last smallest one is the anchor. Its place depends on the
    content alone, so equal windows have their anchor at the same distance.

    Returns the anchors' positions and the first and last window start (inclusive) that each one serves.
    """
    if len(grams) < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    place = np.arange(len(grams), dtype=np.uint64)
    packed = (grams & ~np.uint64(0xFFFFFFFF)) | (np.uint64(0xFFFFFFFF) - place)
    best = sliding(packed, width, np.minimum)
    chosen = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[cuts], cuts, np.r_[cuts[1:], len(chosen)] - 1
