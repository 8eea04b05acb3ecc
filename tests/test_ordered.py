"""Segmented scans against plain Python over the same rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.operators import ordered

WIDTHS = [(), (4,), (4, 3), (1000,)]


def rows():
    rng = random.Random(7)
    result = []
    for key in ["a", "b", None]:
        for order in rng.sample(range(-20, 200), 40):
            result.append((key, order, rng.choice([None, 1, 2, 3])))
    return result


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "k string, o long, v long")


def expected(kind):
    result = {}
    for key in ["a", "b", None]:
        group = sorted((o, v) for k, o, v in rows() if k == key)
        total, last = 0, None
        for i, (o, v) in enumerate(group):
            total += v or 0
            last = v if v is not None else last
            result[key, o] = {
                "sum": total,
                "number": i + 1,
                "previous": group[i - 1][1] if i else None,
                "first": group[0][1],
                "last": last,
                "next": group[i + 1][0] if i + 1 < len(group) else None,
            }[kind]
    return result


@pytest.mark.parametrize("widths", WIDTHS)
@pytest.mark.parametrize("kind", ["sum", "number", "previous", "first", "last", "next"])
def test_scan(data, kind, widths):
    o, v = F.col("o"), F.col("v")
    frame = {
        "sum": lambda: ordered.running_sum(data, ["k"], o, F.coalesce(v, F.lit(0)), "r", widths),
        "number": lambda: ordered.row_number(data, ["k"], o, "r", widths),
        "previous": lambda: ordered.previous(data, ["k"], o, v, "r", widths),
        "first": lambda: ordered.first_value(data, ["k"], o, v, "r", widths),
        "last": lambda: ordered.last_known(data, ["k"], o, v, "r", widths),
        "next": lambda: ordered.previous(data, ["k"], -o, o, "r", widths),
    }[kind]()
    assert {(row.k, row.o): row.r for row in frame.collect()} == expected(kind)
    assert set(frame.columns) == {"k", "o", "v", "r"}


@pytest.mark.parametrize("coarse,rows", [(64, 40), (3, 25), (64, 10**6)])
def test_quantile_segments_keep_order_and_share_rows(spark, monkeypatch, coarse, rows):
    monkeypatch.setattr(ordered, "COARSE", coarse)
    monkeypatch.setattr(ordered, "SEGMENT_ROWS", rows)
    rng = random.Random(rows)
    values = [rng.randrange(50) for _ in range(300)] + [10**15 + i for i in range(300)] + [7] * 200 + [-(10**12)] * 3
    frame = spark.createDataFrame([(v,) for v in values], "at long").repartition(4)
    found = frame.select("at", ordered.quantile_segments(frame, "at").alias("s")).collect()
    order = sorted((r.at, r.s) for r in found)
    assert [s for _, s in order] == sorted(s for _, s in order)
    sizes = Counter(s for at, s in order if at != 7)
    assert max(sizes.values()) <= 4 * rows and (len(sizes) > 5 or rows > 803)
    assert frame.limit(0).select(ordered.quantile_segments(frame.limit(0), "at")).count() == 0


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_sum_and_last_together(spark, monkeypatch, width):
    monkeypatch.setattr(ordered, "SEQUENCE_WIDTHS", (width,))
    rng = random.Random(width)
    rows = [(g, at, rng.choice([-1, 0, 1]), rng.choice([None, None, f"v{at}"])) for g in ("a", "b", None) for at in rng.sample(range(-9, 90), 60)]
    frame = spark.createDataFrame(rows, "g string, at long, n long, v string").repartition(3)
    got = ordered.sum_and_last(frame, ["g"], frame.at, frame.n, frame.v, ("total", "newest"))
    expected = {}
    for group in ("a", "b", None):
        total, newest = 0, None
        for _, at, n, v in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            total, newest = total + n, v or newest
            expected[group, at] = (total, newest)
    assert {(r.g, r.at): (r.total, r.newest) for r in got.collect()} == expected
