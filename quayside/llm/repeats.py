"""What the two operators that remove repeated passages share: sending anchors and windows to buckets, and taking the
removed runs back to their documents.

A document is named by ``oid`` (its doc_id, nulls first) and ``rk`` (a hash of the row, which tells rows of one doc_id
apart; rows equal in id and text are one document and get one result each).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import order_id

NAME = {"oid": "<i8", "rk": "<i4"}


def named(docs: DataFrame) -> DataFrame:
    """oid, rk, doc_id and the text's bytes (null: empty)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(order_id().alias("oid"), F.hash("doc_id", "text").alias("rk"), "doc_id", text.alias("text"))


def dealt_by_document(docs: DataFrame) -> DataFrame:
    """The texts, hashed by document. Used twice in one plan, so that Spark shuffles them once."""
    return docs.repartition("oid", "rk")


def with_marks(documents: DataFrame, marks: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Joins each document with the list ``marks`` of its structs of ``columns``; a document's marks are bounded by
    its length."""
    lists = marks.groupBy("oid", "rk").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    return documents.join(lists, ["oid", "rk"], how)


def struct_column(values: pa.ListArray, row: int, names: list[str]) -> list[np.ndarray]:
    """The fields of one row's list of structs."""
    held = values[row].values
    if held is None:
        return [np.zeros(0, np.int64)] * len(names)
    return [held.field(name).to_numpy(zero_copy_only=False) for name in names]


def covered(low: np.ndarray, high: np.ndarray, window: int, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a window that starts in one of the runs."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, low, 1)
    np.add.at(edge, np.minimum(high + window, size), -1)
    return np.cumsum(edge[:-1]) > 0


def by_rows(
    frame: DataFrame, run: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    return frame.mapInArrow(over, schema)
