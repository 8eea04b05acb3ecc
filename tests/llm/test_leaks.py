"""Operator 13 against a plain search for every window."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quayside.llm import decontamination
from tests.llm.conftest import awkward_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
ITEMS = "item_id bigint, text string, key string, words string"


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


def windows_of(items, window):
    held = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for j in range(len(words) - size + 1) if size else ():
            held.setdefault(tuple(words[j : j + size]), set()).add("" if item is None else str(item))
    return held


def plain_report(docs, items, window=10):
    held = windows_of(items, window)
    sizes = {len(w) for w in held}
    out = Counter()
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in sizes:
            for p in range(len(words) - size + 1):
                names = held.get(tuple(words[p : p + size]))
                if names:
                    found |= names
                    hit |= set(range(p, p + size))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(doc, len(words), len(hit), len(found), digest, bool(hit))] += 1
    return out


def benchmark_rows():
    passage = prose(1, 80)
    words = passage.split()
    return [
        (1, " ".join(words[10:40])),
        (2, " ".join(words[30:45]).upper() + "!"),
        (3, " ".join(words[30:39])),  # shorter than a window
        (3, prose(4, 400)),
        (4, "ab ab ab"),
        (5, "é ß"),
        (None, prose(7, 30)[:60]),
        (6, ""),
        (7, None),
        (8, " \t.,"),
        (9, "ab " * 11),
        (10, prose(99, 20)),
        (10, prose(99, 20)),
    ]


def as_items(spark, rows):
    return spark.createDataFrame([(*row, "x", "y") for row in rows], ITEMS).repartition(2)


def results(frame):
    return Counter(map(tuple, frame.collect()))


def test_awkward_rows(spark, awkward, clashing, nothing):
    items = as_items(spark, benchmark_rows())
    expected = plain_report([row[:2] for row in awkward_rows()], benchmark_rows())
    for frame in (awkward, clashing):
        assert results(decontamination.report(frame, items)) == expected
    assert decontamination.report(nothing, items).collect() == []
    clean = plain_report([row[:2] for row in awkward_rows()], [])
    assert results(decontamination.report(awkward, items.limit(0))) == clean


@pytest.mark.parametrize("limit", [300, 4000])
def test_blocks_shards_and_scans_change_nothing(spark, awkward, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", limit * 10)
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 3 * limit)
    monkeypatch.setattr(decontamination, "SHARD_WORDS", limit // 3)
    rows = benchmark_rows()
    expected = plain_report([row[:2] for row in awkward_rows()], rows)
    assert results(decontamination.report(awkward, as_items(spark, rows))) == expected


def test_decontaminated_keeps_clean_documents_whole(spark, clashing):
    items = as_items(spark, benchmark_rows())
    dirty = {doc for doc, *_, hit in plain_report([row[:2] for row in awkward_rows()], benchmark_rows()) if hit}
    kept = decontamination.decontaminated(clashing, items)
    assert kept.columns == clashing.columns
    held = windows_of(benchmark_rows(), 10)
    clean = [r for r in clashing.collect() if not plain_hit(r.text, held)]
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, clean))
    assert dirty and clean


def plain_hit(text, held):
    words = words_of(text)
    return any(tuple(words[p : p + size]) in held for size in {len(w) for w in held} for p in range(len(words) - size + 1))


def test_longest_matches(spark):
    passage = prose(1, 60).split()
    docs = [
        (1, " ".join([*prose(2, 20).split(), *passage[5:40], *prose(3, 5).split(), *passage[20:33]])),
        (2, " ".join(passage)),
        (3, " ".join(passage[:9])),
        (4, "tiny item " + " ".join(passage[50:])),
    ]
    items = [(1, " ".join(passage)), (2, "tiny item")]
    found = decontamination.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted(map(tuple, found.collect())) == [
        (1, "1", 5, 20, 35),
        (1, "1", 20, 60, 13),
        (2, "1", 0, 0, 60),
        (4, "1", 50, 2, 10),
        (4, "2", 0, 0, 2),
    ]


def test_hot_passage_and_common_words(spark):
    """One passage in a third of all documents, and an item of one word said over and over."""
    passage = prose(11, 12)
    docs = [(i, prose(100 + i, 30) + (" " + passage if i % 3 == 0 else "") + " na" * (i % 25)) for i in range(300)]
    items = [(i, passage + " " + prose(500 + i, 3)) for i in range(20)] + [(50, "na " * 14)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = decontamination.report(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert results(found) == plain_report(docs, items)


@pytest.mark.parametrize("scan", [7, 64, 1 << 20])
def test_words_of_joined_texts(monkeypatch, scan):
    monkeypatch.setattr(decontamination, "SCAN_BYTES", scan)
    texts = [row[1] for row in awkward_rows()] + ["A", "a", "Ä", "ä", "x" * 9000, "x" * 9001, "1 2 12"]
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, ahead = decontamination.words_of(data, np.cumsum([0, *map(len, raw)]))
    plain = [words_of(t) for t in texts]
    assert np.diff(ahead).tolist() == list(map(len, plain))
    flat = [w for words in plain for w in words]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
