"""Ordered computations per group that survive a group holding a large share of all rows.

A plain window sorts a whole group in one task. Here the order column (a LONG that is unique in its group)
is cut into segments of ``width`` values, so no segment can hold more than ``width`` rows. Each segment is
first reduced to one summary row (combined on the map side), the summaries are carried forward to the next
segment, and the carried row joins its segment as an extra first row of an ordinary window. Groups that fit
one segment carry nothing. A list of widths repeats the same step over the summaries.

Where the order column is sparse or dense by turns, as times are, ``quantile_segments`` cuts it at sampled quantiles
instead, so that every segment has about as many rows, whatever the values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQUENCE_WIDTHS = (1 << 20,)
SEGMENT_ROWS = 1 << 20
MOST_SEGMENTS = 1 << 12
COARSE = 64  # bounds that a row is compared with in each of two steps
KEY_BUCKETS = 1 << 14

_ORDER, _SEGMENT, _VALUE, _CARRIED = "_order", "_segment", "_value", "_carried"


def quantile_segments(frame: DataFrame, order: str) -> Column:
    """The segment of a row by its LONG column ``order``: how many of the bounds are not above it.

    One pass counts the rows and takes approximate quantiles, so the driver gets ``MOST_SEGMENTS`` numbers at most. Rows
    that tie share a segment. A row is compared with the coarse bounds first, then with the fine ones between two.
    """
    rows = frame.where(F.col(order).isNotNull()).count()
    segments = min(MOST_SEGMENTS, -(-rows // SEGMENT_ROWS))
    if segments < 2:
        return F.lit(0)
    shares = [i / segments for i in range(1, segments)]
    bounds = frame.select(F.percentile_approx(order, shares, 10 * segments).alias("b")).first()["b"]
    bounds = sorted(set(bounds))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda bound: bound <= F.col(order)))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(value).cast("long") for value in values])

    groups = [bounds[i : i + COARSE] for i in range(0, len(bounds), COARSE)]
    if len(groups) == 1:
        return below(longs(bounds))
    coarse = below(longs([group[0] for group in groups]))
    fine = F.get(F.array(*[longs(group) for group in groups]), F.greatest(coarse - 1, F.lit(0)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * COARSE + below(fine))


def crowded(frame: DataFrame, keys: Sequence[str]) -> Column | None:
    """A condition that holds for every row whose key has more than ``SEGMENT_ROWS`` rows, or None where there is none.

    Rows are counted per bucket of keys; the driver gets the buckets above that bound. All other keys are known to fit
    one task's sort as a segment does, and need no segments.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    counts = frame.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    full = [row["bucket"] for row in counts.where(F.col("rows") > SEGMENT_ROWS).collect()]
    return bucket.isin(full) if full else None


def running_sum(
    frame: DataFrame,
    keys: Sequence[str],
    order: Column,
    value: Column,
    name: str,
    widths: Sequence[int] = SEQUENCE_WIDTHS,
) -> DataFrame:
    """Inclusive running total of ``value`` in ``order``."""
    return _finish(_scan(_prepare(frame, order, value), list(keys), "sum", list(widths)), name)


def row_number(
    frame: DataFrame, keys: Sequence[str], order: Column, name: str, widths: Sequence[int] = SEQUENCE_WIDTHS
) -> DataFrame:
    """1, 2, 3 … in ``order``."""
    return running_sum(frame, keys, order, F.lit(1).cast("long"), name, widths)


def previous(
    frame: DataFrame,
    keys: Sequence[str],
    order: Column,
    value: Column,
    name: str,
    widths: Sequence[int] = SEQUENCE_WIDTHS,
) -> DataFrame:
    """``value`` of the row before; NULL on the first row. Use ``-order`` for the row after."""
    return _finish(_scan(_prepare(frame, order, value), list(keys), "previous", list(widths)), name)


def first_value(
    frame: DataFrame,
    keys: Sequence[str],
    order: Column,
    value: Column,
    name: str,
    widths: Sequence[int] = SEQUENCE_WIDTHS,
) -> DataFrame:
    """``value`` of the first row of the group."""
    return _finish(_scan(_prepare(frame, order, value), list(keys), "first", list(widths)), name)


def last_known(
    frame: DataFrame,
    keys: Sequence[str],
    order: Column,
    value: Column,
    name: str,
    widths: Sequence[int] = SEQUENCE_WIDTHS,
) -> DataFrame:
    """Newest non-NULL ``value`` up to and including the row."""
    return _finish(_scan(_prepare(frame, order, value), list(keys), "last", list(widths)), name)


def sum_and_last(
    frame: DataFrame, keys: Sequence[str], order: Column, value: Column, last: Column, names: tuple[str, str]
) -> DataFrame:
    """``running_sum`` of ``value`` and ``last_known`` of ``last`` together, by one set of segments: the summaries carry
    both, and rows are shuffled once."""
    keys = list(keys)
    rows = frame.withColumns(
        {
            _ORDER: order.cast("long"),
            "_add": value,
            "_keep": last,
            _SEGMENT: F.floor(order.cast("long") / SEQUENCE_WIDTHS[0]),
        }
    )
    known = F.when(F.col("_keep").isNotNull(), F.col(_ORDER))
    summaries = rows.groupBy(*keys, _SEGMENT).agg(F.sum("_add").alias("_add"), F.max_by("_keep", known).alias("_keep"))
    ahead = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = summaries.withColumns(
        {
            "_add": F.sum("_add").over(ahead),
            "_keep": F.last("_keep", ignorenulls=True).over(ahead),
            _CARRIED: F.lit(True),
        }
    ).where(F.coalesce(F.col("_add") != 0, F.lit(False)) | F.col("_keep").isNotNull())
    both = rows.withColumn(_CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    ordered = Window.partitionBy(*keys, _SEGMENT).orderBy(F.col(_ORDER).asc_nulls_first())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = both.withColumns(
        {names[0]: F.sum("_add").over(so_far), names[1]: F.last("_keep", ignorenulls=True).over(so_far)}
    )
    return done.where(~F.col(_CARRIED)).drop(_ORDER, _SEGMENT, _CARRIED, "_add", "_keep")


def _prepare(frame: DataFrame, order: Column, value: Column) -> DataFrame:
    return frame.withColumns({_ORDER: order.cast("long"), _VALUE: value})


def _finish(frame: DataFrame, name: str) -> DataFrame:
    return frame.withColumnRenamed(_VALUE, name).drop(_ORDER)


_SUMMARY = {
    "sum": lambda: F.sum(_VALUE),
    "previous": lambda: F.max_by(_VALUE, _ORDER),
    "first": lambda: F.min_by(_VALUE, _ORDER),
    "last": lambda: F.max_by(_VALUE, F.when(F.col(_VALUE).isNotNull(), F.col(_ORDER))),
}


def _windowed(frame: DataFrame, partition: list[str], kind: str) -> DataFrame:
    ordered = Window.partitionBy(*partition).orderBy(F.col(_ORDER).asc_nulls_first())
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    result = {
        "sum": lambda: F.sum(_VALUE).over(so_far),
        "previous": lambda: F.lag(_VALUE).over(ordered),
        "first": lambda: F.first(_VALUE).over(so_far),
        "last": lambda: F.last(_VALUE, ignorenulls=True).over(so_far),
    }[kind]()
    return frame.withColumn(_VALUE, result)


def _scan(frame: DataFrame, keys: list[str], kind: str, widths: list[int]) -> DataFrame:
    """Replace ``_value`` by its running result; ``_order`` is kept."""
    if not widths:
        return _windowed(frame, keys, kind)
    segmented = frame.withColumn(_SEGMENT, F.expr(f"({_ORDER} - pmod({_ORDER}, {widths[0]}L)) div {widths[0]}L"))
    summaries = (
        segmented.groupBy(*keys, _SEGMENT)
        .agg(_SUMMARY[kind]().alias(_VALUE))
        .withColumnRenamed(_SEGMENT, _ORDER)
    )
    carried = (
        _carry_in(summaries, keys, kind, widths[1:])
        .withColumnRenamed(_ORDER, _SEGMENT)
        .withColumn(_CARRIED, F.lit(True))
    )
    rows = segmented.withColumn(_CARRIED, F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return _windowed(rows, [*keys, _SEGMENT], kind).where(~F.col(_CARRIED)).drop(_SEGMENT, _CARRIED)


def _carry_in(summaries: DataFrame, keys: list[str], kind: str, widths: list[int]) -> DataFrame:
    """What each segment inherits from the ones before it; segments that inherit nothing are left out."""
    if kind == "sum":
        own = summaries.withColumn("_own", F.col(_VALUE))
        before = _scan(own, keys, "sum", widths)
        return before.withColumn(_VALUE, F.col(_VALUE) - F.col("_own")).drop("_own").where(F.col(_VALUE) != 0)
    running = summaries if kind == "previous" else _scan(summaries, keys, kind, widths)
    # A struct keeps "no earlier segment" apart from "the earlier value is NULL".
    boxed = running.withColumn(_VALUE, F.struct(F.col(_VALUE).alias("v")))
    before = _scan(boxed, keys, "previous", widths).where(F.col(_VALUE).isNotNull())
    return before.withColumn(_VALUE, F.col(f"{_VALUE}.v"))
