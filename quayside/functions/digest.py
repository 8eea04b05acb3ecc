"""Content hashes that do not depend on row order.

A row's hash covers its columns in name order, each value written with its length. A dataset's digest is its row count
and, for each of the four 64-bit quarters of the hashes, the sum of that quarter over all rows; there the names of the
columns are hashed too. Quarters are added up as halves of their 32-bit words. Sums of plain LONGs combine on the map
side, so no group is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType, VariantType

SUMS = 4
_HALF = 1 << 16


def _text(column: Column, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.hex(column)
    if isinstance(kind, TimestampType):
        return F.unix_micros(column).cast("string")  # whatever the session's time zone
    if isinstance(kind, (StructType, ArrayType, MapType, VariantType)):
        return F.to_json(column, {"timeZone": "UTC"})
    return column.cast("string")


def row_hash(frame: DataFrame, columns: Iterable[str], named: bool = False) -> Column:
    """SHA-256 over the named columns of ``frame``: ``<bytes>:<text>`` each, or ``-`` for NULL; if ``named``, behind
    ``<bytes>:<name>=``."""
    kinds = {field.name: field.dataType for field in frame.schema.fields}
    names = sorted(columns)
    texts = [_text(F.col(f"`{name}`"), kinds[name]) for name in names]
    marked = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    if named:
        marked = [F.concat(F.lit(f"{len(name.encode())}:{name}="), entry) for name, entry in zip(names, marked)]
    return F.sha2(F.concat_ws(",", *marked), 256)


def composite_id(**parts: Column) -> Column:
    """Stable identity of named parts."""
    named = F.struct(*[parts[name].alias(name) for name in sorted(parts)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def dataset_digest(frame: DataFrame, *group: str) -> DataFrame:
    """``row_count`` and ``sum_0`` … of the whole frame, or per ``group``. Duplicates count, order does not."""
    return _sums(frame, group, words=2, named=True)


def short_digest(frame: DataFrame, *group: str) -> DataFrame:
    """The digest over the first half of each hash, one 32-bit word a sum and values without names, in which file sets
    and the inputs of nodes are recorded."""
    return _sums(frame, group, words=1, named=False)


def _sums(frame: DataFrame, group: Iterable[str], words: int, named: bool) -> DataFrame:
    """Sums of ``words`` 32-bit words each. A word is added up in two halves of 16 bits: a LONG holds the halves of 2^47
    rows, and only the one result row of a group is put together as decimals."""
    columns = [name for name in frame.columns if name not in group]
    hashed = frame.select(*group, row_hash(frame, columns, named).alias("_hash"))
    places = range(SUMS * words)
    split = [F.conv(F.substring("_hash", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_word_{i}") for i in places]
    halves = []
    for i in places:
        halves.append(F.sum(F.shiftright(f"_word_{i}", 16)).alias(f"_half_{2 * i}"))
        halves.append(F.sum(F.col(f"_word_{i}").bitwiseAND(_HALF - 1)).alias(f"_half_{2 * i + 1}"))
    counted = hashed.select(*group, *split)
    counted = counted.groupBy(*group) if group else counted
    summed = counted.agg(F.count(F.lit(1)).alias("row_count"), *halves)

    def whole(i: int) -> Column:
        total = F.lit(0).cast("decimal(20,0)")
        for half in range(2 * words * i, 2 * words * (i + 1)):
            # What is still to be shifted has at most 48 bits a row: 31 digits hold 2^54 rows.
            total = total.cast("decimal(31,0)") * F.lit(_HALF).cast("decimal(6,0)") + F.coalesce(
                f"_half_{half}", F.lit(0)
            ).cast("decimal(20,0)")
        return total.cast("decimal(38,0)").cast("string").alias(f"sum_{i}")

    return summed.select(*group, "row_count", *[whole(i) for i in range(SUMS)])


def proof_fingerprint(schema: str | Column) -> Column:
    """One hash over row count, schema and sums, as stored in an artifact reference.

    ``schema`` is the simple string of names and types; files do not keep whether a column may be NULL.
    """
    schema = F.lit(schema) if isinstance(schema, str) else schema
    return F.sha2(
        F.concat_ws("|", F.col("row_count").cast("string"), schema, *[F.col(f"sum_{i}") for i in range(SUMS)]),
        256,
    )
