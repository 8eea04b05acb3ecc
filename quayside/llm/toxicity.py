"""Toxicity by a learned lexicon, matched with misspellings, and read in its context.

Fitting takes labelled documents and keeps terms (whole words, and stems that words begin with) that mark toxic ones:
their document counts are distributed aggregates, only a bounded list of the best comes to the driver. The lexicon is a
trie. A Levenshtein automaton walks it: a state is the set of (trie node, edits left over) that the letters so far can
be in, so one pass over a word finds all terms within the allowed edits, and most words are dropped after two or three
letters. States are built when first met and kept.

Each match is read in a window of words around it. Inside quotation marks or after a verb of reporting it counts as a
quotation; near words that address someone it counts as abuse. A logistic model over the sums of matches by kind gives
the score; unseen texts and texts without a match get the model's base rate.

Null and empty texts score as texts without a match. Rows are scored one by one, so repeated rows and ties need no rule.
Labels that are null don't count, and a document labelled twice counts as toxic if either label says so. Without
training rows, or without toxic ones, the lexicon is empty and all documents get the base rate. An empty table gives no
rows. Only the text is read by the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quayside.llm.bpe import BEYOND_LATIN
from quayside.llm.common import pieces
from quayside.session import materialize, scratch_path

TRAINING_ROWS = 30_000  # labelled rows that a fit reads at most, chosen by hash
LEAST_TOXIC = 4  # documents that a term must mark, and
TOXIC_SHARE = 0.004  # of all toxic ones; fewer may be chance
CLEAN_SHARE = 0.02  # of a term's documents that may be clean
STEM_LETTERS = (4, 8)
WINDOW = 6
THRESHOLD = 0.3
KEEP = 200_000  # words that a task remembers to match nothing

TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
# The same for texts of Latin letters only; a short character class is twice as fast.
LATIN = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(r"[^\W\d_]", c))
LATIN_TOKEN = re.compile(f"[{LATIN}]+|[\"“”„«»]")
MARKS = frozenset("\"“”„«»")
# Verbs of reporting, and words that address someone.
REPORTS = frozenset(
    "said says say called calls wrote writes quoted quote quotes word term dit écrit mot sagte schrieb wort dijo "
    "escribió palabra".split()
)
ADDRESSES = frozenset("you your you're youre tu toi vous votre du dich dein ihr tú usted ustedes vosotros".split())
FEATURES = ("exact", "misspelled", "addressed", "quoted")


def spelled(text: str) -> str:
    """Lower case, with the digits and signs that stand in for letters read as letters inside words."""
    return SWAPPED.sub(_letters, text.lower())


# Signs written for letters.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
SWAPPED = re.compile("[013457@$]+")


def _letters(found: re.Match) -> str:
    """The letters of some signs that stand between letters; other signs stay."""
    inside = found.string[found.start() - 1 : found.start()].isalpha() and found.string[found.end() : found.end() + 1].isalpha()
    return found.group().translate(LETTERS) if inside else found.group()


def edits_allowed(term: str) -> int:
    """None for short terms, where one edit gives another common word; one otherwise. A fitted model also allows one in
    stems and five letters, see ``edits_of``."""
    return 1 if len(term) >= 6 else 0


class Automaton:
    """A lexicon trie walked by Levenshtein automata, one state set at a time."""

    def __init__(self, terms: list[tuple[str, bool]], edits: list[int] | None = None):
        """``terms``: (letters, whether it is a stem that longer words may begin with). ``edits``: how many each allows,
        by default none in stems and ``edits_allowed`` in words."""
        self.allowed = edits or [0 if stem else edits_allowed(term) for term, stem in terms]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]
        self.reach: list[int] = [0]  # the most edits that any term below a node allows
        for number, (term, stem) in enumerate(terms):
            node = 0
            allowed = self.allowed[number]
            self.reach[0] = max(self.reach[0], allowed)
            for letter in term:
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                node = self.next[node][letter]
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node] = (number, stem)
        self.states: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.found: list[tuple[int, int] | None] = []
        self.stems: list[tuple[int, int] | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state: its nodes with the fewest edits each, after skipped lexicon letters."""
        pending = list(nodes.items())
        closed = dict(nodes)
        while pending:
            node, used = pending.pop()
            for child in self.next[node].values():
                if used + 1 <= self.reach[child] and used + 1 < closed.get(child, 99):
                    closed[child] = used + 1
                    pending.append((child, used + 1))
        key = frozenset(closed.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(closed)
            ends = [
                (used, self.ends[node])
                for node, used in closed.items()
                if self.ends[node] and used <= self.allowed[self.ends[node][0]]
            ]
            best = min(((used, end[0]) for used, end in ends), default=None)
            stem = min(((used, end[0]) for used, end in ends if end[1]), default=None)
            self.found.append(best and (best[1], best[0]))
            self.stems.append(stem and (stem[1], stem[0]))
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, letter: str) -> int:
        """The state after one more letter, or -1 where no term can match any more."""
        after: dict[int, int] = {}
        for node, used in self.states[state].items():
            child = self.next[node].get(letter)
            if child is not None and used <= self.reach[child]:
                after[child] = min(after.get(child, 99), used)
            if used < self.reach[node]:
                after[node] = min(after.get(node, 99), used + 1)  # a letter too many
                for other in self.next[node].values():  # another letter
                    if used < self.reach[other]:
                        after[other] = min(after.get(other, 99), used + 1)
        reached = self._state(after) if after else -1
        self.moves[state][letter] = reached
        return reached

    def match(self, word: str) -> tuple[int, int] | None:
        """The nearest term (its number, its edits) that the word spells or begins with."""
        state, stem, moves = self.start, None, self.moves
        for letter in word:
            following = moves[state].get(letter)
            state = self._move(state, letter) if following is None else following
            if state < 0:
                return stem
            begun = self.stems[state]
            if begun is not None and (stem is None or begun[1] < stem[1]):
                stem = begun
                if not stem[1]:
                    return stem
        whole = self.found[state]
        return whole if stem is None or (whole is not None and whole[1] < stem[1]) else stem


    def misspelled(self, word: str) -> set[int]:
        """All terms that the word spells or begins with by at least one edit, and not without."""
        state, out, exact = self.start, set(), set()
        for place, letter in enumerate(word, 1):
            following = self.moves[state].get(letter)
            state = self._move(state, letter) if following is None else following
            if state < 0:
                break
            for node, used in self.states[state].items():
                end = self.ends[node]
                if end and (end[1] or place == len(word)) and used <= self.allowed[end[0]]:
                    (out if used else exact).add(end[0])
        return out - exact


@dataclass
class Model:
    """Terms with weights and allowed edits, and the logistic model's coefficients (one per feature, then the constant)."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES) + [-3.0])
    edits: list[int] | None = None

    def reader(self) -> Reader:
        return Reader(self)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.coefficients[:-1]) + self.coefficients[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Reads a text's features with a model's lexicon."""

    def __init__(self, model: Model):
        self.automaton, self.weights = Automaton(model.terms, model.edits), model.weights
        self.clean: set[str] = set(MARKS)  # words known to match nothing

    def spans(self, text: str) -> list[tuple[int, int, int, int, bool, bool]]:
        """(start, end, term, edits, addressed, quoted) of every match in the text."""
        lowered = spelled(text)
        token = TOKEN if BEYOND_LATIN.search(lowered) else LATIN_TOKEN
        words = token.findall(lowered)
        hits = {}
        for word in set(words).difference(self.clean):
            found = self.automaton.match(word)
            if found is not None:
                hits[word] = found
            elif len(self.clean) < KEEP:
                self.clean.add(word)
        if not hits:
            return []
        out, open_mark = [], False
        tokens = [(m.group(), m.start(), m.end()) for m in token.finditer(lowered)]
        for i, (word, start, end) in enumerate(tokens):
            if word in MARKS:
                open_mark = not open_mark
            elif word in hits:
                near = {t[0] for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
                reported = bool(REPORTS & {t[0] for t in tokens[max(0, i - WINDOW) : i]})
                closes = any(t[0] in MARKS for t in tokens[i + 1 : i + 1 + 4 * WINDOW])
                quoted = (open_mark and closes) or (reported and bool(MARKS & near))
                out.append((start, end, *hits[word], bool(ADDRESSES & near), quoted))
        return out

    def features(self, text: str) -> list[float]:
        out = dict.fromkeys(FEATURES, 0.0)
        for _, _, term, edits, addressed, quoted in self.spans(text):
            weight = self.weights[term]
            if quoted:
                out["quoted"] += weight
                continue
            out["misspelled" if edits else "exact"] += weight
            if addressed:
                out["addressed"] += weight
        return [math.log1p(out[name]) for name in FEATURES]


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAINING_ROWS) -> DataFrame:
    """text and toxic of at most ``limit`` labelled documents for which ``usable`` holds, chosen by hash. Exact copies
    are one text: a term that many copies share isn't thereby common."""
    known = (
        labels.where(F.col("toxic").isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(known, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def candidate_terms(rows: DataFrame) -> DataFrame:
    """term, stem, toxic and clean: in how many documents of either kind each whole word and stem occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                terms, stems, toxic = [], [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    words = {word for word in TOKEN.findall(spelled(text)) if len(word) >= 3}
                    begun = {word[:n] for word in words for n in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(word) - 1) + 1)}
                    terms += [*words, *begun]
                    stems += [False] * len(words) + [True] * len(begun)
                    toxic += [label] * (len(words) + len(begun))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array(stems, pa.bool_()), pa.array(toxic, pa.int32())],
                    ["term", "stem", "toxic"],
                )

    seen = rows.mapInArrow(run, "term string, stem boolean, toxic int")
    return seen.groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def lexicon(rows: DataFrame) -> list[tuple[str, bool, float, int]]:
    """All terms that mark toxic documents by the tests below: (term, stem, weight, edits). Each stands in ``least`` of
    the labelled documents at least, of which there are a bounded number. A stem is left out if one whole word makes up
    its documents; a stem or word is left out if a shorter stem that it begins with serves it: a word's misspellings
    too, so words stay beside a stem that allows no edit."""
    least = max(LEAST_TOXIC, TOXIC_SHARE * rows.where("toxic = 1").count())
    best = (
        candidate_terms(rows.where("toxic in (0, 1)"))
        .where((F.col("toxic") >= least) & (F.col("clean") <= CLEAN_SHARE * F.col("toxic")))
        .collect()
    )
    most: dict[str, int] = {}  # the toxic documents of the commonest whole word that begins so
    for row in best:
        if not row.stem:
            for n in range(STEM_LETTERS[0], len(row.term)):
                most[row.term[:n]] = max(most.get(row.term[:n], 0), row.toxic)
    stems: set[str] = set()
    chosen = []
    for row in sorted(best, key=lambda r: (len(r.term), r.stem, r.term)):
        if row.stem:
            if most.get(row.term, 0) >= 0.98 * row.toxic or any(row.term[:n] in stems for n in range(2, len(row.term))):
                continue
            stems.add(row.term)
        chosen.append(row)
    chosen = sorted(chosen, key=lambda r: (-r.toxic, r.term, r.stem))
    edits = edits_of(rows, [(row.term, row.stem, row.toxic) for row in chosen])
    serving = {row.term: allowed for row, allowed in zip(chosen, edits, strict=True) if row.stem}

    def served(row: Row, allowed: int) -> bool:
        starts = [row.term[:n] for n in range(2, len(row.term) + 1)]
        return not row.stem and any(serving.get(start, -1) >= allowed for start in starts)

    kept = [(row, allowed) for row, allowed in zip(chosen, edits, strict=True) if not served(row, allowed)]
    return [
        (row.term, row.stem, math.log((row.toxic + 0.5) / (row.clean + 0.5)), allowed) for row, allowed in kept
    ]


def edits_of(rows: DataFrame, terms: list[tuple[str, bool, int]]) -> list[int]:
    """The edits that each term (term, stem, toxic documents) allows: one in words of six letters or more, and one in
    stems and words of five where the clean documents hold no words that are a misspelling then, but for the share
    that a term's own clean documents may have."""
    plain = [(term, stem) for term, stem, _ in terms]
    tried = [1 if stem or len(term) >= 5 else 0 for term, stem in plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(plain, tried)
        for batch in batches:
            met: list[int] = []
            for text in batch.column("text").to_pylist():
                words = set(TOKEN.findall(spelled(text)))
                met += set().union(*[automaton.misspelled(word) for word in words])
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32())], ["term"])

    counted = rows.where("toxic = 0").select("text").mapInArrow(run, "term int").groupBy("term").count().collect()
    clean = {row["term"]: row["count"] for row in counted}  # at most one row per term
    return [
        1 if not stem and edits_allowed(term) else int(bool(tried[i]) and clean.get(i, 0) <= CLEAN_SHARE * toxic)
        for i, (term, stem, toxic) in enumerate(terms)
    ]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, limit: int = TRAINING_ROWS) -> Model:
    """Learns the lexicon and the weights from labelled documents for which ``usable`` holds."""
    rows, seen = materialize(training_rows(docs, labels, usable, limit), scratch_path(docs.sparkSession, "labelled"))
    if not seen["rows"]:
        return Model()
    terms = lexicon(rows)
    model = Model([t[:2] for t in terms], [t[2] for t in terms], edits=[t[3] for t in terms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            found = [reader.features(text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), *[pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]],
                ["toxic", *FEATURES],
            )

    schema = "toxic int, " + ", ".join(f"{name} double" for name in FEATURES)
    # Documents of equal features are one row with a count.
    table = (
        rows.where("toxic in (0, 1)").mapInArrow(run, schema).groupBy("toxic", *FEATURES).count().orderBy("toxic", *FEATURES).collect()
    )  # at most ``limit`` rows
    x = np.array([[row[name] for name in FEATURES] + [1.0] for row in table]).reshape(-1, len(FEATURES) + 1)
    y, n = np.array([row["toxic"] for row in table], float), np.array([row["count"] for row in table], float)
    model.coefficients = _logistic(x, y, n)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.5) -> list[float]:
    """Ridge-penalised logistic regression by Newton steps. Coefficients of abuse start at one and don't turn
    negative; a quotation counts no more than abuse does. The penalty of misspelled terms is that of their distance
    from exact ones, so without misspellings among the labelled documents they count alike."""
    beta = np.r_[np.ones(x.shape[1] - 2), 0.0, -3.0]
    ridge = np.diag(np.r_[np.full(x.shape[1] - 1, penalty), 1e-6])
    ridge[0, 0] += penalty
    ridge[0, 1] = ridge[1, 0] = -penalty
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (n * (y - p)) - ridge @ beta
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step / max(1.0, float(np.abs(step).max()))
        beta[:-1] = np.maximum(beta[:-1], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    beta[-2] = min(beta[-2], beta[0])
    return beta.tolist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            found = np.array([reader.features(text or "") for text in batch.column("text").to_pylist()])
            scores = model.score(found.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, "toxicity"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, toxicity double")
