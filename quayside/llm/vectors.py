"""What the operators on quantised vectors share."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sound(vector: str = "embedding") -> Column:
    """Is the vector there, and are all its components finite?"""
    component = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def whole(scale: int, vector: str = "embedding") -> Column:
    """Components as whole numbers, floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def largest(dimensions: int) -> int:
    """Components up to this size keep squared distances and their sums over ``dimensions`` inside 64 bits."""
    return min(2**31 - 1, isqrt(2**62 // max(dimensions, 1)) // 2)


def within(terms: str, dimensions: int | Column) -> Column:
    """``terms``; components beyond what 64-bit distances allow end the job with a message instead of a wrong result.
    With the vector's own size for ``dimensions``, inner products of vectors of any sizes fit too."""
    if isinstance(dimensions, int):
        most = F.lit(largest(dimensions))
    else:
        # A little below ``largest``, which rounds down as well.
        root = F.floor(F.sqrt(F.lit(float(2**62)) / F.greatest(dimensions, F.lit(1)))) - 1
        most = F.least(F.lit(2**31 - 1).cast("bigint"), F.floor(root / 2))
    beyond = F.exists(terms, lambda x: ~x.between(-most, most))
    return F.when(beyond, F.raise_error(F.lit("A vector component is beyond 64-bit arithmetic after scaling.")).cast("array<bigint>")).otherwise(F.col(terms))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers."""
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def packed(values: np.ndarray) -> pa.Array:
    """A row of 32-bit numbers as one binary value each."""
    rows = np.ascontiguousarray(values, dtype="<i4")
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def squared(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the rows of ``other`` (broadcast)."""
    difference = rows - other
    return np.einsum("...i,...i->...", difference, difference)


def summed(sums: DataFrame, size: int) -> list[int]:
    """Adds up ``sums`` (array<bigint> of ``size`` numbers, one row per task) cell by cell. The driver gets one number
    per cell, so as many as the model has; partial sums combine on the map side."""
    cells = sums.select(F.posexplode("sums").alias("cell", "part"))
    rows = cells.groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    out = [0] * size
    for row in rows:
        out[row["cell"]] = int(row["total"])
    return out


def chunks(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
