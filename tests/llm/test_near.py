"""Near duplicates of the pipeline by Jaccard similarity, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from quayside.llm import jaccard, simhash, toxicity
from quayside.llm.common import held_out
from tests.llm.test_tables import plain_verdicts

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").encode().lower())
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
    return frozenset(grams)


def kept_by_brute_force(rows: list[tuple]) -> set:
    """The ids that stay: the smallest of each component of pairs at 0.8 or more."""
    held = [(i, shingles(text)) for i, text in sorted(rows)]
    group = list(range(len(held)))
    for i, (_, a) in enumerate(held):
        for j in range(i):
            b = held[j][1]
            if group[i] != group[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return {held[g][0] for g in group}


def pair_at(rng: random.Random, shared: int, own: int) -> tuple[str, str]:
    """Two texts that share ``shared`` shingles and have ``own`` more each, behind them."""

    def words(n: int) -> list[str]:
        return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]

    common = words(shared + 4)
    return " ".join(common + words(own)), " ".join(common + words(own))


# shared / (shared + 2 * own) is 0.75, 0.79 (rounded), 0.80 and 0.85 (rounded).
@pytest.mark.parametrize("shared,own,near", [(120, 20, False), (158, 21, False), (160, 20, True), (170, 15, True)])
def test_pairs_at_a_similarity(spark, shared, own, near):
    rng = random.Random(shared)
    rows = [(2 * n + side, text) for n in range(150) for side, text in enumerate(pair_at(rng, shared, own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = kept_by_brute_force(rows)
    assert len(expected) == (150 if near else 300)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == expected


@pytest.mark.parametrize("chunk", [250_000, 2_000])
def test_groups_of_near_copies(spark, monkeypatch, chunk):
    """Copies of a few texts with more and more changes: chains, and groups larger than a chunk."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(7)
    rows = [(1000, None), (1001, ""), (1002, "two words"), (1003, "Two  words")]
    for _ in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(60):
            changed = list(words)
            for at in rng.sample(range(120), rng.randrange(7)):
                changed[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = kept_by_brute_force(rows)
    assert 6 < len(expected) < 200
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == expected


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == Counter(expected)


def test_links_connect_what_is_similar():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, (3, 60)).astype(np.uint64)
    sets = []
    for n in range(90):
        held = base[n % 3].copy()
        held[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
        sets.append(np.unique(held))
    group, whole = list(range(90)), list(range(90))
    for i, j in jaccard.near_pairs(sets).tolist():
        group = [min(group[i], group[j]) if g in (group[i], group[j]) else g for g in group]
    for i in range(90):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                whole = [min(whole[i], whole[j]) if g in (whole[i], whole[j]) else g for g in whole]
    assert group == whole and len(jaccard.near_pairs(sets)) == 90 - len(set(whole))


@pytest.mark.parametrize("limit", [2, 12, 66])
def test_large_buckets_of_neighbouring_values_lose_no_link(limit):
    """Two buckets one flip apart, whose members are near a part of the other side only."""
    rng = np.random.default_rng(limit)
    one, two = 70, 75
    prints = rng.integers(0, 1 << 64, (1, 6), dtype=np.uint64).repeat(one + two, 0)
    for row in prints:
        for bit in rng.choice(300, round(limit * 0.53), replace=False):
            row[1 + bit // 60] ^= np.uint64(1 << int(bit % 60))
    prints[one:, 0] ^= np.uint64(1)
    values = prints[:, 0] & np.uint64(0xFFFF)
    a, b = simhash.block_links(np.arange(one + two), prints, values, np.zeros(one + two, bool), 1, limit)

    def groups(links):
        group = list(range(one + two))
        for i, j in links:
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
        return group

    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(2)
    assert groups(zip(a.tolist(), b.tolist(), strict=True)) == groups(np.argwhere(apart <= limit).tolist())


def test_near_ones_beyond_the_first_on_the_other_side():
    """i is near j1 and j2, an earlier one near j2 only: all are one group."""
    zero = np.zeros(6, np.uint64)

    def bits(low, high):
        out = zero.copy()
        for bit in range(low, high):
            out[bit // 64] |= np.uint64(1 << bit % 64)
        return out

    # On a line: j1 at -60, i at 0, j2 at 60, i' at 120, as numbers of bits set in one of two directions.
    line = {"i'": bits(64, 184), "i": zero, "j1": bits(200, 260), "j2": bits(64, 124)}
    prints = np.stack([line[name] for name in ("i'", "i", "j1", "j2")])
    links = np.concatenate(simhash._across(prints, np.array([0, 1]), np.array([2, 3]), 66))
    reached = {1}
    for _ in range(4):
        reached |= {x for pair in links.tolist() for x in pair if reached & set(pair)}
    assert reached == {0, 1, 2, 3}


def template_texts(seed: int, count: int, shared: int, own: int) -> list[str]:
    rng = random.Random(seed)

    def words(n: int) -> list[str]:
        return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]

    block = words(shared)
    return [" ".join(block + words(own)) for _ in range(count)]


@pytest.mark.parametrize("shared,own", [(100, 130), (100, 75)])
def test_texts_of_one_template_make_no_large_group(spark, shared, own):
    """600 texts that share a block, about 0.3 and 0.4 similar, and ten near copies among them."""
    texts = template_texts(7, 600, shared, own)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[50 * i] + " end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard.entries(docs, 5)
    groups = jaccard.components(jaccard.candidate_links(found)).groupBy("root").count()
    assert groups.agg({"count": "max"}).first()[0] <= 8
    classes = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs, 5).collect()}
    assert all(classes[1000 + i] == classes[50 * i] for i in range(10))
    assert len(set(classes.values())) == 600


def stage_rows(frame):
    return Counter(tuple(row) for row in frame.collect())


def test_stages_keep_what_brute_force_keeps(spark):
    """Each stage on its own input: the rows that stay, and their texts, by a plain version of its rule."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    expected = kept_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near.collect()} == expected

    poor = corpus_pipeline.drop_poor(spark, docs, SF)
    rows = docs.collect()
    verdicts = plain_verdicts([(r.text, r.lang) for r in rows])
    assert stage_rows(poor) == Counter(tuple(r) for r, kept in zip(rows, verdicts, strict=True) if kept)

    left = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    seen: set[tuple] = set()
    texts = {}
    for row in sorted(rows, key=lambda r: r.doc_id):
        words = [w.decode() for w in WORD.findall(row.text.encode())]
        windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        gone = {p for i, w in enumerate(windows) if w in seen for p in range(i, i + 50)}
        seen |= set(windows)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        if not gone or kept:
            texts[row.doc_id] = kept if gone else row.text
    assert {r.doc_id: r.text for r in left.collect()} == texts

    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, ~held_out())
    reader = model.reader()
    scores = {r.doc_id: model.score(np.array([reader.features(r.text or "")]))[0] for r in rows}
    assert {r.doc_id for r in clean.collect()} == {i for i, score in scores.items() if score < toxicity.THRESHOLD}
