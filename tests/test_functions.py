from __future__ import annotations

import sys

from pyspark.sql import functions as F

from quayside.functions import text, times


def test_blank_agrees_with_strip_on_every_character(spark):
    characters = [chr(i) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF]
    blank = [c for c in characters if not c.strip()]
    frame = spark.createDataFrame([(c,) for c in characters], "c string")
    assert sorted(r.c for r in frame.where(text.missing("c")).collect()) == sorted(blank)
    odd = spark.createDataFrame([(None,), ("",), (" 　\t",), (" x ",)], "c string")
    assert [r[0] for r in odd.select(text.missing("c")).collect()] == [True, True, True, False]


def test_strict_quantity(spark):
    values = ["0", "001", "9" * 18, "9" * 19, "-1", "+1", "1.0", " 1", "1 ", "1\n", "", None, "١", "１"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(text.strict_quantity(F.col("v"))).collect()]
    assert got == [0, 1, 10**18 - 1] + [None] * 11


def test_iso_dates(spark):
    values = ["2024-02-29", "2023-02-29", "2024-2-1", "20240201", "2024-01-01 ", None, "0001-01-01"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in frame.select(text.iso_date(F.col("v"))).collect()]
    assert got == [True, False, False, False, False, False, True]


def test_backoff_is_capped(spark):
    frame = spark.createDataFrame([(n,) for n in range(1, 6)], "n int")
    delay = text.backoff_seconds(F.lit(0.1), F.lit(2.0), F.col("n"), F.lit(1.0))
    assert [round(r[0], 6) for r in frame.select(delay).collect()] == [0.1, 0.2, 0.4, 0.8, 1.0]


def test_durations_never_go_below_zero(spark):
    rows = [
        ("2024-01-01T00:00:00.000+00:00", "2024-01-01T00:00:01.500+00:00"),
        ("2024-01-01T01:00:00.000+01:00", "2024-01-01T00:00:01.000+00:00"),
        ("2024-01-01T00:00:01.000+00:00", "2024-01-01T00:00:00.000+00:00"),
        (None, "2024-01-01T00:00:00.000+00:00"),
    ]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in frame.select(times.seconds_between(F.col("a"), F.col("b"))).collect()]
    assert got == [1.5, 1.0, 0.0, None]


def test_relative_paths(spark):
    frame = spark.createDataFrame([("file:/data/in/a/b.xml",), ("abfss://c@h/data/in/x.xml",)], "p string")
    assert [r[0] for r in frame.select(text.relative_path(F.col("p"), "/data/in")).collect()][0] == "a/b.xml"
