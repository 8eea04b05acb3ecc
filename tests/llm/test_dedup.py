"""Operators 1, 3 and 9 against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quayside.llm import simhash, substring_dedup, suffix_dedup
from quayside.llm.common import anchors, mixed, sliding, window_hashes
from quayside.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def keyed(frame):
    """(doc_id, hash of the row, text) in the order that the operators take documents in."""
    rows = frame.select("doc_id", F.hash("doc_id", "text").alias("rk"), "text").collect()
    low = -(2**63)
    return sorted(((low if r.doc_id is None else r.doc_id, r.rk, r.text or "") for r in rows))


def plain_fingerprint(text: str, shingle: int) -> int:
    words = WORD.findall(text.encode().lower())
    grams = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints: list[tuple[int | None, int]], limit: int) -> Counter:
    """Rows (doc_id, fingerprint, component) by comparing all pairs."""
    group = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= limit and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (doc, _), g in zip(prints, group, strict=True):
        least[g] = min([x for x in (least.get(g), doc) if x is not None], default=None)
    return Counter((doc, f"{p:016x}", least[g]) for (doc, p), g in zip(prints, group, strict=True))


def test_simhash_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = classes([(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs.collect()], 2)
    found = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, found)) == expected


def test_simhash_on_awkward_rows(awkward, clashing, nothing):
    expected = classes([(r.doc_id, plain_fingerprint(r.text or "", 3)) for r in awkward.collect()], 2)
    for frame in (awkward, clashing):
        found = simhash.near_duplicates(frame).select("doc_id", "fingerprint", "component_id").collect()
        assert Counter(map(tuple, found)) == expected
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("width,lead", [(32, 0), (32, 3), (16, 2)])
def test_links_reach_all_near_fingerprints(spark, monkeypatch, width, lead):
    rng = np.random.default_rng(width + lead)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in centres:
        for _ in range(rng.integers(0, 120)):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            prints.add(int(c) ^ sum(1 << int(f) for f in flips))
    held = sorted(prints)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", len(held) / 2**lead)
    table = spark.createDataFrame([(i, f"{p:016x}") for i, p in enumerate(held)], "id long, fingerprint string")
    found = components(simhash.links(table, len(held), 1, 64 // width, 2)).collect()
    root = {i: i for i in range(len(held))} | {r.node: r.root for r in found}
    expected = classes([(i, p) for i, p in enumerate(held)], 2)
    assert Counter((i, f"{p:016x}", root[i]) for i, p in enumerate(held)) == expected


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_large_buckets_are_parted_without_loss(monkeypatch, limit):
    rng = np.random.default_rng(limit)
    centres = rng.integers(0, 1 << 32, 40, dtype=np.uint64)
    flips = rng.integers(0, 32, (40, 30, 3))
    held = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c, f in zip(centres, flips, strict=True) for a, b, _ in f}
    prints = np.array(sorted(held), np.uint64).reshape(-1, 1)

    def groups(found):
        group = list(range(len(prints)))
        for i, j in np.concatenate([*found, np.zeros((0, 2), np.int64)]).astype(int).tolist():
            group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
        return group

    whole = groups(simhash._search(prints, limit))
    monkeypatch.setattr(simhash, "LARGE", 10)
    assert groups(simhash._spanning(prints, limit)) == whole


def test_stars_keep_what_is_connected():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 400, (2, 260)) * 7 - 900
    group = {int(v): int(v) for v in np.r_[a, b]}
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        one, two = sorted((group[i], group[j]))
        group = {v: one if g == two else g for v, g in group.items()}
    member, least = simhash.stars(a, b)
    found = dict(zip(member.tolist(), least.tolist(), strict=True))
    assert {v: found.get(v, v) for v in group} == group and len(member) < len(group)
    assert len(simhash.stars(a[:0], b[:0])[0]) == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_words(frame) -> Counter:
    rows = keyed(frame)
    first: dict[bytes, tuple] = {}
    for oid, rk, text in rows:
        words = WORD.findall(text.encode())
        for k in range(len(words) - 49):
            first.setdefault(b" ".join(words[k : k + 50]), (oid, rk))
    out = Counter()
    for oid, rk, text in rows:
        words = WORD.findall(text.encode())
        gone = set()
        for k in range(len(words) - 49):
            if first[b" ".join(words[k : k + 50])] < (oid, rk):
                gone.update(range(k, k + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[None if oid == -(2**63) else oid, len(words), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def brute_bytes(frame) -> Counter:
    seen: set[bytes] = set()
    held: dict[tuple, tuple] = {}
    out = Counter()
    for oid, rk, text in keyed(frame):
        if (oid, rk, text) not in held:
            data = text.encode()
            gone = np.zeros(len(data), bool)
            for k in range(len(data) - 99):
                string = data[k : k + 100]
                if string in seen:
                    gone[k : k + 100] = True
                seen.add(string)
            spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            held[oid, rk, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        out[(None if oid == -(2**63) else oid, *held[oid, rk, text])] += 1
    return out


@pytest.mark.parametrize("module,brute", [(substring_dedup, brute_words), (suffix_dedup, brute_bytes)])
def test_removals(spark, awkward, clashing, nothing, module, brute):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert Counter(map(tuple, module.removals(docs).collect())) == brute(docs)
    expected = brute(awkward)
    for frame in (awkward, clashing):
        assert Counter(map(tuple, module.removals(frame).collect())) == expected
    assert module.removals(nothing).count() == 0


def test_removals_over_many_buckets(spark, awkward, monkeypatch):
    expected = brute_words(awkward)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(substring_dedup, "LOAD", 1e-5)
    assert Counter(map(tuple, substring_dedup.removals(awkward).collect())) == expected
    expected = brute_bytes(awkward)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", 4000)
    assert Counter(map(tuple, suffix_dedup.removals(awkward).collect())) == expected


def test_texts_without_passages(awkward, nothing):
    kept = {(r.doc_id, r.n_chars): r.text for r in substring_dedup.without_passages(awkward).collect()}
    texts = {(r.doc_id, r.n_chars): r.text for r in awkward.collect()}
    changed = {k for k in kept if kept[k] != texts[k]}
    assert {k[0] for k in changed} == {3, 5, 9, 11, 14, 16} and {k[0] for k in texts.keys() - kept.keys()} == {10}
    assert substring_dedup.without_passages(nothing).count() == 0


def test_cover_brings_any_two_positions_onto_the_sample():
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            step = suffix_dedup.SHIFTS[a, b]
            assert {(a + step) % 31, (b + step) % 31} <= set(suffix_dedup.COVER)


def test_block_compares_like_bytes():
    rng = np.random.default_rng(1)
    data = np.frombuffer((b"abcabcabc" * 60 + rng.integers(97, 99, 700, np.uint8).tobytes()) * 2, np.uint8)
    block = suffix_dedup.Block(data)
    a, b = (rng.integers(0, len(data) - 100, 4000) for _ in range(2))
    raw = data.tobytes()
    expected = [(raw[i : i + 100] > raw[j : j + 100]) - (raw[i : i + 100] < raw[j : j + 100]) for i, j in zip(a, b, strict=True)]
    assert block.compare(a, b).tolist() == expected


def test_window_hashes_and_sliding():
    values = np.random.default_rng(2).integers(0, 5, 400).astype(np.uint64)
    hashes = window_hashes(values, 7)
    same = {}
    for i, h in enumerate(hashes.tolist()):
        assert same.setdefault(tuple(values[i : i + 7].tolist()), h) == h
    assert len(set(same.values())) == len(same)
    assert sliding(values, 13, np.minimum).tolist() == [values[i : i + 13].min() for i in range(388)]
    assert len(window_hashes(values[:3], 7)) == 0


def test_anchors_serve_each_window_once():
    grams = mixed(np.random.default_rng(3).integers(0, 50, 500).astype(np.uint64))
    place, low, high = anchors(grams, 20)
    assert low[0] == 0 and high[-1] == 480 and (low[1:] == high[:-1] + 1).all()
    for p, a, b in zip(place, low, high, strict=True):
        assert a <= p < a + 20 and b <= p < b + 20


def hot_documents(count: int) -> list[tuple]:
    """A 60-byte line and a 60-word passage, each in a third of all documents, amid different text."""
    rng = np.random.default_rng(count)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)

    def words(n: int) -> str:
        return " ".join(letters[rng.integers(0, 26, rng.integers(2, 9))].tobytes().decode() for _ in range(n))

    line, passage = words(40)[:60], words(60)
    return [
        (i, " ".join([words(20), line if i % 3 == 0 else "", words(12), passage if i % 3 == 1 else "", words(20)]))
        for i in range(count)
    ]


def plain_string_removals(rows, window):
    """(doc_id, n_removed) by every string of ``window`` bytes."""
    seen, out = set(), []
    for doc, text in rows:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                gone[i : i + window] = True
            seen.add(piece)
        out.append((doc, int(gone.sum())))
    return out


def test_hot_anchors_change_nothing(spark, monkeypatch):
    rows = hot_documents(240)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = plain_string_removals(rows, suffix_dedup.WINDOW)
    for least, sampled in ((10, 1), (1, 1), (10**9, 16)):
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
        monkeypatch.setattr(suffix_dedup, "SAMPLED", sampled)
        found = suffix_dedup.removals(docs).select("doc_id", "n_removed").collect()
        assert sorted(map(tuple, found)) == expected


def test_hot_line_leaves_no_large_bucket(spark, monkeypatch):
    """The stretches that meet at one anchor don't grow with the number of documents that hold the line."""
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 4000)
    largest = []
    for count in (150, 600):
        docs = spark.createDataFrame(hot_documents(count), "doc_id long, text string").repartition(4)
        live = suffix_dedup.repeated_anchors(suffix_dedup.named(docs), 3)
        texts = live.groupBy("hash").agg(F.sum(F.col("more") + 1).alias("starts"), F.max("more").alias("more"))
        largest.append(texts.where("more > 0").agg(F.max("starts")).first()[0] or 0)
    assert max(largest) <= 20 * suffix_dedup.WINDOW


def test_hot_passage_asks_once_per_slice(spark):
    docs = spark.createDataFrame(hot_documents(300), "doc_id long, text string").repartition(4)
    seen = substring_dedup.slice_sketches(substring_dedup.named(docs), 1 << 20, 50)
    asked = seen.select(F.get("cells", F.lit(0)).alias("c"), "documents").groupBy("c")
    top = asked.agg(F.count(F.lit(1)).alias("rows"), F.sum("documents").alias("n")).orderBy(F.desc("n")).first()
    assert top.rows <= 4 and top.n <= 2 * top.rows


def test_sketch_never_counts_too_low(spark):
    """With very few cells nearly everything is estimated repeated, and results stay."""
    rows = hot_documents(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = substring_dedup.named(docs)
    exact = {tuple(r) for r in substring_dedup.repeated_anchors(base, 1 << 40, 50).collect()}
    rough = {tuple(r) for r in substring_dedup.repeated_anchors(base, 64, 50).collect()}
    assert exact and exact <= rough and len(rough) > 2 * len(exact)
