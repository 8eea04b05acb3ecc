"""Exact top-k by inner product, term at a time.

Components are quantised to whole numbers; each dimension is a term. A block of candidates is an inverted table: per
term the postings, that is which vectors hold it and with what weight. A query row scatters the postings of its
non-zero terms, weighted, into a dense array of scores; a partition selection takes its k best, and the blocks' results
are merged. Nothing is skipped, so the result is exact. Query blocks meet candidate blocks of fixed size; no pair of
rows leaves a task unless it is among a query's best of a block.

Every row is a candidate of every query but its own: rows that repeat a vec_id are candidates, and queries, each. Rows
with a null vector, or one holding null or non-finite components, take no part. Vectors may differ in length: missing
components are zero. An empty vector scores zero against all. Ties go to the smaller vec_id, null coming last. An empty
table gives no rows. Components whose products could leave 64 bits end the job with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bucket_count
from quayside.llm.vectors import sound, whole, within
from quayside.session import materialize, scratch_path

BLOCK_ROWS = 8192
QUERY_ROWS = 8192
SCALE = 64
DENSE = 0.25  # postings lists that hold this share of a block are kept as plain columns


NULL_ID = 2**63 - 1  # orders rows of null vec_id behind all others


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``number`` (of the row), vec_id and ``terms`` (array<bigint>) of the rows that take part."""
    return (
        vectors.where(sound())
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole(scale).alias("terms"))
        .select(
            F.monotonically_increasing_id().alias("number"), "vec_id", within("terms", F.size("terms")).alias("terms")
        )
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers of one width; shorter ones end in zeros."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(held.value_lengths())
    flat = np.asarray(held.flatten(), dtype=np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def block_best(
    queries: np.ndarray, own: np.ndarray, table: np.ndarray, numbers: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, ...]:
    """The k best of a block for each query, whose own row's number is in ``own``: (query row, row of the block, score),
    ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    numbers, table = numbers[order], table[order]
    terms = min(table.shape[1], queries.shape[1])
    bound = terms * int(np.abs(table).max(initial=0)) * int(np.abs(queries).max(initial=0))
    kind = np.int32 if bound < 2**31 else np.int64
    postings: list[tuple[np.ndarray | None, np.ndarray]] = []
    for term in range(terms):
        column = table[:, term].astype(kind)
        held = np.flatnonzero(column)
        postings.append((None, column) if len(held) >= DENSE * len(table) else (held, column[held]))
    scores, product = np.empty(len(table), kind), np.empty(len(table), kind)
    found = []
    for row, itself in enumerate(own):
        scores[:] = 0
        for term in np.flatnonzero(queries[row, :terms]).tolist():
            held, weights = postings[term]
            weight = kind(queries[row, term])
            if held is None:
                np.multiply(weights, weight, out=product)
                np.add(scores, product, out=scores)
            else:
                scores[held] += weights * weight
        chosen = np.flatnonzero(numbers != itself)
        if len(chosen) > k:
            least = np.partition(scores[chosen], len(chosen) - k)[len(chosen) - k]
            chosen = chosen[scores[chosen] >= least]
        best = chosen[np.argsort(-scores[chosen].astype(np.int64), kind="stable")][:k]
        found.append((np.full(len(best), row), order[best], scores[best].astype(np.int64)))
    return tuple(np.concatenate(part) if found else np.zeros(0, np.int64) for part in zip(*found, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best among all other rows."""
    spark = vectors.sparkSession
    held, seen = materialize(quantised(vectors, scale), scratch_path(spark, "terms"))
    queries = held.where(is_query)
    blocks = bucket_count(seen["rows"], BLOCK_ROWS)
    query_blocks = bucket_count(queries.count(), QUERY_ROWS)

    def dealt(rows: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return rows.select("*", F.pmod(F.xxhash64("number"), F.lit(count)).cast("int").alias(own)).select("*", every)

    left = dealt(queries, "query_block", query_blocks, "block", blocks).groupBy("query_block", "block")
    right = dealt(held, "block", blocks, "query_block", query_blocks).groupBy("query_block", "block")
    names = ["number", "query_id", "vec_id", "score"]

    def best(asked: pa.Table, block: pa.Table) -> pa.Table:
        schema = pa.schema([(name, pa.int64()) for name in names])
        if not asked.num_rows or not block.num_rows:
            return schema.empty_table()
        own, ids = asked.column("number").to_numpy(), block.column("vec_id").fill_null(NULL_ID).to_numpy()
        row, other, score = block_best(
            _matrix(asked.column("terms")), own, _matrix(block.column("terms")), block.column("number").to_numpy(), ids, k
        )
        columns = [asked.column("number").take(row), asked.column("vec_id").take(row), block.column("vec_id").take(other)]
        return pa.Table.from_arrays([*columns, pa.array(score)], schema=schema)

    parts = left.cogroup(right).applyInArrow(best, ", ".join(f"{name} bigint" for name in names))
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
