from __future__ import annotations

import random

import pytest

from quayside.llm.common import ship

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "marks string, oid string, rk string, fingerprint string, kept string, toxicity string, n_words string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    """Nulls, empty and blank texts, exact and near copies, repeated rows, shared passages and long texts."""
    passage = prose(1, 80)
    long = " ".join([prose(2, 4000), passage, prose(3, 100)])
    near = prose(4, 400).split()
    rows = [
        (5, passage + " " + prose(5, 60)),
        (3, prose(6, 70) + " " + passage),
        (9, long),
        (10, long),
        (10, long),
        (11, prose(7, 30) + "\n" + passage + " é ß 😀"),
        (12, "x" * 3000),
        (13, "ab " * 400),
        (14, "ab " * 400 + "c"),
        (15, " ".join(near)),
        (16, " ".join([*near[:200], "changed", *near[201:]])),
        (17, ""),
        (18, None),
        (19, " \t\n"),
        (20, "one two"),
        (21, "One two"),
        (21, prose(8, 90)),
        (None, prose(9, 120)),
        (None, passage),
        (None, None),
    ]
    return [(i, t, ["en", "de", None, "xx"][n % 4], None if n % 5 == 0 else f"s{n % 2}", n) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    """The awkward rows with more columns, named like those inside the operators."""
    names = [name.split()[0] for name in CLASHES.split(", ")]
    return spark.createDataFrame(
        [(*row, *names) for row in awkward_rows()], f"{SCHEMA}, {CLASHES}"
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
