"""Operators 6, 7 and 10, the oracle SQL, and the pipeline."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from quayside.llm import quality, queries, token_rollup, topk
from quayside.llm.common import apart
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, connection, name):
    assert compare(spark, connection, queries.QUERIES[name], queries.ORACLES[name], SF) == ""


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES) == list(range(1, 14))


VECTORS = [
    (1, [0.5, -0.25, 0.0]),
    (2, [0.5, -0.25, 0.0]),
    (3, [0.5, -0.25]),
    (20, [1.0, 1.0, 1.0]),
    (20, [1.0, 1.0, 1.0]),
    (40, []),
    (4, None),
    (5, [0.1, None, 0.2]),
    (6, [float("nan"), 0.0, 0.0]),
    (7, [float("inf"), 0.0, 0.0]),
    (None, [1.0, 1.0, 1.0]),
    (0, [-0.01, 0.3, 0.3]),
]


def brute_top_k(rows, k):
    held = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for n, (q, asked) in enumerate(held):
        if q is None or q % 20:
            continue
        others = held[:n] + held[n + 1 :]
        scores = [(-sum(a * b for a, b in zip(asked, v, strict=False)), c is None, c) for c, v in others]
        ranked = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))
        out.update((q, rank, c, -s) for rank, (s, _, c) in enumerate(ranked[:k], 1))
    return out


@pytest.mark.parametrize("k,block", [(20, 8192), (2, 2), (1, 1)])
def test_top_k_on_awkward_vectors(spark, monkeypatch, k, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    frame = spark.createDataFrame([(*r, "x") for r in VECTORS], "vec_id long, embedding array<float>, terms string")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k)
    assert Counter(map(tuple, found.collect())) == brute_top_k(VECTORS, k)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0, k).count() == 0


def test_top_k_refuses_what_64_bits_do_not_hold(spark):
    frame = spark.createDataFrame([(0, [1e18]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        topk.top_k(frame, F.col("vec_id") % 20 == 0, 2).collect()


def test_top_k_with_many_ties_and_sparse_terms(spark):
    rows = [(i, [float(i % 3), 0.0, float(i % 7 == 0), 0.0]) for i in range(300)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5)
    assert Counter(map(tuple, found.collect())) == brute_top_k(rows, 5)


def event(doc, op, n, tokenizer="t/1", seq=1, source="a", lang="en", part=0):
    return (doc, part, tokenizer, seq, op, source, lang, n)


def test_rollup_of_batches(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    batch = lambda rows: spark.createDataFrame(rows, token_rollup.EVENT)

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}

    assert totals() == {}
    first = batch(
        [
            event(1, "insert", 10),
            event(1, "insert", 10),
            event(2, "insert", 5, source=None),
            event(2, "insert", 7, source=None),
            event(3, "insert", 4, lang=None),
            event(1, "insert", 12, tokenizer="t/2"),
            event(None, "insert", 9),
            event(4, "insert", None),
            event(5, "other", 3),
            event(6, None, 3),
        ]
    )
    assert rollup.commit("one", first)
    expected = {("a", "en", "t/1"): (2, 19), (None, "en", "t/1"): (1, 7), ("a", None, "t/1"): (1, 4), ("a", "en", "t/2"): (1, 12)}
    assert totals() == expected
    assert not rollup.commit("one", first) and totals() == expected
    second = batch(
        [
            event(1, "revise", 11, source="b"),
            event(3, "delete", None),
            event(9, "delete", None),
            event(8, "revise", 2),
            event(2, "revise", 100, seq=1),
            event(2, "revise", 0, seq=2, source=None),
            event(None, "delete", None),
            event(1, "insert", 50, part=7, source="c"),
        ]
    )
    assert rollup.commit("two", second)
    expected = {("b", "en", "t/1"): (1, 11), ("c", "en", "t/1"): (1, 50), ("a", "en", "t/1"): (1, 2), (None, "en", "t/1"): (1, 0), ("a", "en", "t/2"): (1, 12)}
    assert totals() == expected
    assert rollup.commit("none", first.limit(0)) and totals() == expected
    assert not rollup.commit("two", second) and totals() == expected
    assert rollup.compact() == 3 and totals() == expected
    assert not rollup.commit("one", first) and totals() == expected and rollup.compact() == 0
    third = batch([event(1, "delete", None, part=7)]).withColumn("shard", F.lit("x")).withColumn("docs", F.lit("y"))
    plan = rollup.entries([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    assert rollup.commit("three", third)
    assert totals() == {k: v for k, v in expected.items() if k[0] != "c"}


def test_interrupted_commit_has_no_effect(spark, tmp_path, monkeypatch):
    rollup = token_rollup.Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([event(1, "insert", 3)], token_rollup.EVENT)
    with monkeypatch.context() as broken:
        broken.setattr(token_rollup.Rollup, "_mark", lambda *_: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            rollup.commit("x", rows)
    assert rollup.totals().count() == 0
    assert rollup.commit("x", rows) and rollup.totals().first().tokens == 3


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_base_counts_on_awkward_rows(spark, awkward, clashing, nothing):
    texts = ["a b c a b c a", "a a a a", "a b", "x\nx\n\n \n \nx y", "##$ <a> | a\x0bb", "a b c d a b c e a b c d"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    frame = awkward.unionByName(extra, allowMissingColumns=True)
    judged = quality.judge(frame).collect()
    for row in judged:
        found = (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)
        assert found == base_counts(row.text), row.text
        assert row.base_failed == (row.n_words < 50 or 100 * row.n_repeat_words > 50 * row.n_words)
        assert not (row.kept and row.base_failed)
    assert quality.judge(nothing).count() == 0
    apart_rows = apart(clashing, ["text", "lang"], lambda d: quality.judge(d).where("kept"))
    assert apart_rows.columns == clashing.columns


def test_distance(spark):
    rows = [([1, 1, 0], [1, 1, 0], 2.0, 2.0), ([1, 0], [0, 3], 1.0, 3.0), ([0, 0], [1, 1], 0.0, 2.0), ([3, 1], [1, 1], 4.0, 2.0)]
    frame = spark.createDataFrame(rows, "p array<int>, q array<int>, p_sum double, q_sum double")
    found = [r.d for r in frame.select(quality.distance("p", "q").alias("d")).collect()]
    half = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0
    last = math.sqrt((half(0.75, 0.5) + half(0.25, 0.5) + half(0.5, 0.75) + half(0.5, 0.25)) / 2)
    assert found[2] is None and [found[i] for i in (0, 1, 3)] == pytest.approx([0, 1, last])


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), with_text=False)
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    count = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert count[1, False] < 0.03 * (count[1, True] + count[1, False])
    assert count[0, False] > 0.7 * (count.get((0, True), 0) + count[0, False])


def test_native_operator_plans_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, clashing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).persist()
        kept = {r.doc_id for r in after.collect()}
        assert after.columns == columns and kept <= before and kept
        docs, before = after, kept
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == before
    wide = clashing
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, clashing, SF).columns == clashing.columns
    assert corpus_pipeline.drop_toxic(spark, wide, SF).columns == clashing.columns


def test_near_duplicate_stage_keeps_one_of_each_group(spark, awkward):
    kept = corpus_pipeline.drop_near_duplicates(spark, awkward, SF).collect()
    counts = Counter(r.doc_id for r in kept)
    assert counts[9] == 1 and counts[10] == 0 and counts[15] == 1 and counts[16] == 0
    assert counts[21] == 1 and counts[20] == 1  # rows of one id and different texts are two documents
    assert counts[None] == 3 and counts[17] == counts[18] == counts[19] == 0


LANGUAGES = {lang: " ".join(words) for lang, words in quality.COMMON_WORDS.items()}


def sentences(lang: str, seed: int, words: int) -> str:
    """Prose of which three words in ten are common ones of a language."""
    import random

    rng = random.Random(seed)
    common = LANGUAGES[lang].split()
    other = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(words)]
    return " ".join(rng.choice(common) if rng.random() < 0.3 else word for word in other)


def test_words_decide_by_language_and_length(spark):
    """Texts of each wrong language and long ones without common words go; short and plain ones of their own stay."""
    rows = [(f"own-{lang}-{i}", sentences(lang, i, 200), lang) for lang in LANGUAGES for i in range(40)]
    rows += [(f"wrong-{a}-{b}", sentences(a, 7, 200), b) for a in LANGUAGES for b in LANGUAGES if a != b]
    rows += [(f"none-{lang}", " ".join(w for w in sentences(lang, 8, 900).split() if w not in quality.SPELLINGS), lang) for lang in LANGUAGES]
    rows += [(f"short-{lang}", " ".join(w for w in sentences(lang, 9, 200).split() if w not in quality.SPELLINGS)[:420], lang) for lang in LANGUAGES]
    frame = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.judge(frame).collect()}
    assert all(kept[name] == name.startswith(("own", "short")) for name in kept), {n: k for n, k in kept.items() if not k}


def plain_verdicts(rows):
    """kept of (text, lang) rows, by the rules in plain Python."""

    def histograms(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        rest = "".join(c for c in text if unicodedata.category(c) != "Ll")
        known = [len(text) - len(rest)] + [len(regex.findall(p, rest)) for p in quality.CLASSES.values()]
        listed = [sum(quality.SPELLINGS.get(w) == v for w in words) for v in quality.VOCABULARY]
        return [*known, len(text) - sum(known)], [*listed, len(words) - sum(listed)]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return 0.0
        total = 0.0
        for a, b in zip([x / sum(p) for x in p], [x / sum(q) for x in q], strict=True):
            total += sum(x * math.log2(2 * x / (x + y)) for x, y in ((a, b), (b, a)) if x)
        return math.sqrt(max(0.0, total / 2))

    held = []
    for text, lang in rows:
        n, _, _, _, repeated = base_counts(text)
        held.append((n < 50 or 100 * repeated > 50 * n, lang, n, *histograms(text or "")))
    sums = {}
    for failed, lang, _, classes, words in held:
        if not failed and lang in quality.COMMON_WORDS:
            old = sums.setdefault(lang, ([0] * len(classes), [0] * len(words)))
            for into, counts in zip(old, (classes, words), strict=True):
                for i, x in enumerate(counts):
                    into[i] += math.floor(x * 1e6 / sum(counts)) if sum(counts) else 0
    out = []
    for failed, lang, n, classes, words in held:
        far = False
        if lang in sums:
            far = sum(classes) >= quality.LEAST_CHARS and distance(classes, sums[lang][0]) > quality.MAX_CLASS_DISTANCE
            far |= n >= quality.LEAST_COMPARED and distance(words, sums[lang][1]) > quality.MAX_WORD_DISTANCE
        out.append(not failed and not far)
    return out


def test_verdicts_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(n, r.text, r.lang) for n, r in enumerate([*awkward.collect(), *docs.collect()])]
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), with_text=False)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert [kept[n] for n in range(len(rows))] == plain_verdicts([row[1:] for row in rows])
