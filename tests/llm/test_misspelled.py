"""Misspellings of the terms that a fit of the toxicity model learns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quayside.llm import toxicity

WORDS = ["idiot", "moron", "worthless", "pathetic", "stupid", "disgusting"]


def misspellings(word: str) -> set[str]:
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + word[i + 1 :], word[:i] + "z" + word[i:], word[:i] + "z" + word[i + 1 :]}
    return out - {word}


def test_fit_then_score_catches_misspellings_of_every_term(spark):
    rng = random.Random(2)
    fillers = ["".join(rng.choice("aeklnrtu") for _ in range(rng.randint(2, 7))) for _ in range(300)]

    def text(*words: str) -> str:
        held = [rng.choice(fillers) for _ in range(30)]
        return " ".join(held[:15] + list(words) + held[15:])

    rows = [(n, text("you", "are", WORDS[n % 6]), 1) for n in range(240)]
    # Words of one stem, none of which makes it up.
    rows += [(n, text("you", f"vequ{ending}", "so"), 1) for n, ending in enumerate(["ille", "ant", "ons", "er"] * 15, 240)]
    rows += [(n, text(), 0) for n in range(300, 900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), F.lit(True))
    assert {*WORDS, "vequ"} <= {term for term, _ in model.terms}
    wrong = [(term, way) for term in WORDS for way in sorted(misspellings(term)) if len(way) >= 4]
    wrong += [("vequ", way + "ille") for way in ("vezu", "vezqu", "veqzu", "vqu")]
    docs = spark.createDataFrame([(n, text("you", "are", way)) for n, (_, way) in enumerate(wrong)], "doc_id long, text string")
    missed = [wrong[r.doc_id] for r in toxicity.score(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).collect()]
    assert missed == []
    clean = spark.createDataFrame([(n, text()) for n in range(100)], "doc_id long, text string")
    assert toxicity.score(clean, model).where(F.col("toxicity") >= toxicity.THRESHOLD).count() == 0


def test_an_edit_that_clean_documents_show_is_not_allowed(spark):
    rows = [(f"a {word} b", 0) for word in ("house", "idiom", "morose")] * 5
    frame = spark.createDataFrame(rows, "text string, toxic int")
    found = toxicity.edits_of(frame, [("mouse", False, 10), ("idio", True, 10), ("moron", False, 10), ("pathetic", False, 10)])
    assert found == [0, 1, 1, 1]
    assert toxicity.edits_of(frame, [("adio", True, 10), ("abc", False, 10)]) == [0, 0]
