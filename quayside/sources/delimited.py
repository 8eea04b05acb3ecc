"""Landed CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayside.errors import DataFailure, source_unavailable
from quayside.functions.digest import short_digest


# Quotes are doubled inside quoted fields.
_QUOTING = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: StructType, line_breaks: bool = True) -> DataFrame:
    """Rows of files whose header names exactly the columns of ``schema`` in order; empty fields are NULL.

    The header of the first file is compared at once. Headers of further files and rows that are too short or
    too long fail the job that reads them. Quoted fields may hold line breaks; a file is then read by one task. A caller
    who knows that there are none says ``line_breaks=False``, and large files are read in splits.
    """
    try:
        header = spark.read.options(**_QUOTING, header=True, multiLine=line_breaks).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise source_unavailable() from None
        raise
    if header != schema.names:
        raise DataFailure("SOURCE_SCHEMA_MISMATCH", "The CSV header differs from its contract.")
    frame = (
        spark.read.schema(schema)
        .options(**_QUOTING, header=True, multiLine=line_breaks)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )
    return frame.select(*[F.when(F.col(name) != "", F.col(name)).alias(name) for name in frame.columns])


def require_well_formed(frame: DataFrame) -> None:
    """Typed failure for malformed rows, found by one pass over the files."""
    try:
        frame.agg(*[F.count(F.col(name)) for name in frame.columns]).collect()
    except Exception as error:
        if "MALFORMED" in str(error) or "number of columns" in str(error) or "header" in str(error):
            raise DataFailure("MALFORMED_SOURCE", "A CSV row does not fit its header.") from None
        raise


def write_csv(frame: DataFrame, path: str) -> None:
    """Files with a header that ``read_csv`` reads back unchanged."""
    (
        frame.write.mode("errorifexists")
        .options(**_QUOTING, header=True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256`` of every file, hashed on the executors."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def source_digest(spark: SparkSession, path: str) -> DataFrame:
    """One digest over sizes and contents of a file or folder."""
    return short_digest(file_digests(spark, path).drop("path"))
