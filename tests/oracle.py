"""Runs a registered query next to its oracle SQL. ``python tests/oracle.py [sf] [name …]`` prints a report."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value, ".9g")
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    return repr(value)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("\x1f".join(cell(row[i]) for i in order) for row in rows)


# Spark and DuckDB names of the same type.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(spark, connection, query, sql, sf_dir) -> str:
    """Empty when both sides agree on columns, types and values."""
    frame = query(spark, sf_dir)
    actual = normal([tuple(row) for row in frame.collect()], frame.columns)
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    names = [row[0] for row in described]
    expected = normal(connection.execute(sql).fetchall(), names)
    types = {row[0]: row[1] for row in described}
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    wrong = {c: (t, types[c]) for c, t in frame.dtypes if SAME_TYPE.get(t) != types[c]}
    if wrong:
        return f"types {wrong}"
    if actual != expected:
        only_a, only_e = sorted(set(actual) - set(expected))[:3], sorted(set(expected) - set(actual))[:3]
        return f"rows {len(actual)} vs {len(expected)}; spark only {only_a}; oracle only {only_e}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    from quayside.plans import registry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    connection = connect(sf_dir)
    oracles = registry.oracle_sql()
    for name, query in registry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, connection, query, oracles[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {len(query(spark, sf_dir).collect())}"
        except Exception as error:  # a report should go on to the next query
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
