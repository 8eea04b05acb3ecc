"""Byte-level BPE: texts to ids and back, equal to the tokenizers library's own results.

A text is cut at the special strings, then into pre-tokens, and each pre-token is merged by a segment tree over the
ranks of its adjacent pairs: a leaf holds (rank, position), so the root yields the leftmost lowest-rank merge; a merge
updates three leaves and their paths, until no pair can be merged. Short pre-tokens of one size class go through
their trees in lockstep as arrays; a long one has a tree of its own, so a megabyte without a space takes n log n.

Null texts are empty; an empty text has no ids. Rows are independent: repeated rows, ties and other columns need no
rule. Each executor process keeps a bounded table of pre-tokens it has met.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import pieces

NONE = np.int32(2**31 - 1)
LOCKSTEP = 64  # bytes of the longest pre-token that is merged in lockstep
KEEP = 250_000  # pre-tokens that a process keeps

# White space of the pre-token pattern (fixed values: the Unicode property White_Space).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(2)
def pattern(points: int = sys.maxunicode + 1) -> re.Pattern:
    """Contractions, letters, digits, other signs (each with one leading space), and white space, for texts of code
    points below ``points``: short character classes are several times faster."""

    def ranges(kind: str) -> str:
        out, start = [], None
        for point in range(points + 1):
            inside = point < points and unicodedata.category(chr(point))[0] == kind
            if inside and start is None:
                start = point
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{point - 1:08x}")
                start = None
        return "".join(out)

    letters, digits = ranges("L"), ranges("N")
    spaces = "".join(f"\\U{ord(space):08x}" for space in SPACES if ord(space) < points)
    return re.compile(
        rf" ?[{letters}]++|'s|'t|'re|'ve|'m|'ll|'d| ?[{digits}]++| ?[^{spaces}{letters}{digits}]++"
        rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


LATIN = 0x250
BEYOND_LATIN = re.compile(f"[^\0-{chr(LATIN - 1)}]")


def cut(text: str) -> list[str]:
    return pattern().findall(text) if BEYOND_LATIN.search(text) else pattern(LATIN).findall(text)


def byte_letters() -> list[str]:
    """The printable letter that the vocabulary file writes for each byte: itself, or the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Plain arrays of a vocabulary file; small (one entry per id) and sent to the executors."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        ids = held["model"]["vocab"]
        letters = byte_letters()
        back = {letter: byte for byte, letter in enumerate(letters)}
        self.byte_ids = np.array([ids[letter] for letter in letters], np.int32)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in held["model"]["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.table = two_choice_table(keys[order], order.astype(np.int32))
        self.special = {token["content"]: token["id"] for token in held["added_tokens"]}
        self.bytes_of = {number: bytes(map(back.__getitem__, word)) for word, number in ids.items()}
        self.bytes_of |= {number: word.encode() for word, number in self.special.items()}


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    wide = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64((1 << bits) - 1)
    return (wide >> np.uint64(64 - bits)).astype(np.int64), ((wide >> np.uint64(12)) & mask).astype(np.int64)


def two_choice_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each key lies in one of its two slots, so an array of keys is looked up in two steps."""
    bits = max(4, int(4 * len(keys)).bit_length())
    while True:
        first, second = (s.tolist() for s in _slots(keys, bits))
        owner = [-1] * (1 << bits)
        for start in range(len(keys)):
            item, slot = start, first[start]
            for _ in range(200):
                item, owner[slot] = owner[slot], item
                if item < 0:
                    break
                slot = second[item] if slot == first[item] else first[item]
            else:
                break
        else:
            held = np.array(owner)
            found = np.where(held >= 0, keys[held], np.uint32(2**32 - 1))
            return found.astype(np.uint32), np.where(held >= 0, values[held], NONE).astype(np.int32), bits
        bits += 1


class Merger:
    """Merges pre-tokens of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.keys, self.ranks, self.bits = vocabulary.table

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent pairs, NONE where they don't merge. An id below zero is no id."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        one, two = _slots(keys, self.bits)
        out = np.where(self.keys[one] == keys, self.ranks[one], NONE)
        out = np.where(self.keys[two] == keys, self.ranks[two], out)
        return np.where((left < 0) | (right < 0), NONE, out)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, four bytes each."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = 2
        low = 0
        while width <= LOCKSTEP:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for start in range(0, len(chosen), 8192):
                part = chosen[start : start + 8192]
                flat, counts = self._lockstep([words[i] for i in part], sizes[part], width)
                ids, stops = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, begin, stop in zip(part.tolist(), [0, *stops[:-1]], stops, strict=True):
                    out[i] = ids[begin:stop]
            low, width = width, width * 2
        for i in np.flatnonzero(sizes > LOCKSTEP):
            out[i] = self._alone(words[i]).astype("<u4").tobytes()
        return out

    def _lockstep(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        count, levels = len(words), width.bit_length() - 1
        raw = np.frombuffer(b"".join(word.ljust(width, b"\0") for word in words), np.uint8).reshape(count, width)
        place = np.arange(width)
        stride = width + 1  # the last column stands for the end and holds no id
        ids = np.full((count, stride), -1, np.int32)
        ids[:, :width] = np.where(place < sizes[:, None], self.v.byte_ids[raw], -1)
        after = np.tile(np.arange(1, stride + 1, dtype=np.int32), (count, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (count, 1))
        tree = np.full((count, 2 * width), NONE, np.int32)
        first = self.rank(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(count, width)
        tree[:, width:] = np.where(first < NONE, first * width + place, NONE)
        size = width
        while size > 1:
            half = size // 2
            tree[:, half:size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
            size = half
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(count)
        while True:
            root = tree[rows * (2 * width) + 1]
            rows = rows[root < NONE]
            if not len(rows):
                break
            root = root[root < NONE]
            at = (root & (width - 1)).astype(np.int64)
            new = self.v.merged[root >> levels]
            base = rows * stride
            gone = after[base + at].astype(np.int64)
            beyond = after[base + gone].astype(np.int64)
            ids[base + at] = new
            ids[base + gone] = -1
            after[base + at] = beyond
            before[base + np.minimum(beyond, width)] = at
            left = before[base + at].astype(np.int64)
            right_rank = self.rank(new, ids[base + np.minimum(beyond, width)])
            left_rank = self.rank(np.where(left >= 0, ids[base + np.maximum(left, 0)], -1), new)
            top = rows * (2 * width)
            # The old partner's leaf goes, the merged one's is set anew; then the left neighbour's.
            self._put(tree, top, width, gone, np.full(len(rows), NONE, np.int32))
            self._put(tree, top, width, at, np.where(right_rank < NONE, right_rank * width + at, NONE))
            has = left >= 0
            self._put(
                tree, top[has], width, left[has], np.where(left_rank < NONE, left_rank * width + left, NONE)[has]
            )
        whole = ids.reshape(count, stride)[:, :width]
        alive = whole >= 0
        return whole[alive], alive.sum(1)

    @staticmethod
    def _put(tree: np.ndarray, top: np.ndarray, width: int, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[top + node] = value
        while width > 1:
            value = np.minimum(tree[top + node], tree[top + (node ^ 1)])
            node = node >> 1
            tree[top + node] = value
            width //= 2

    def _alone(self, word: bytes) -> np.ndarray:
        count = len(word)
        width = 1 << (count - 1).bit_length()
        start = self.v.byte_ids[np.frombuffer(word, np.uint8)]
        none = 1 << 62
        first = self.rank(start[:-1], start[1:])
        tree = [none] * (2 * width)
        tree[width : width + count - 1] = [
            rank * width + i if rank < NONE else none for i, rank in enumerate(first.tolist())
        ]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        ids, after, before = start.tolist(), list(range(1, count + 1)), list(range(-1, count - 1))
        merged = self.v.merged
        keys, ranks, bits = self.keys, self.ranks, self.bits
        multiplier, whole, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1, (1 << bits) - 1

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                value = min(value, tree[node ^ 1])
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        def rank(a: int, b: int, leaf: int) -> int:
            key = a << 16 | b
            wide = key * multiplier & whole
            for slot in (wide >> (64 - bits), wide >> 12 & mask):
                if keys[slot] == key:
                    return int(ranks[slot]) * width + leaf
            return none

        while tree[1] < none:
            at, new = tree[1] & (width - 1), int(merged[tree[1] >> (width.bit_length() - 1)])
            gone = after[at]
            beyond = after[gone]
            ids[at], ids[gone], after[at] = new, -1, beyond
            put(gone, none)
            if beyond < count:
                before[beyond] = at
                put(at, rank(new, ids[beyond], at))
            else:
                put(at, none)
            left = before[at]
            if left >= 0:
                put(left, rank(ids[left], new, left))
        return np.array([i for i in ids if i >= 0], np.int32)


class _Kept(dict):
    """Pre-tokens met so far; ``extra`` holds those of the present texts that no longer fit in."""

    def __init__(self):
        super().__init__()
        self.extra: dict = {}

    def __missing__(self, key):
        return self.extra[key]


class Encoder:
    """Encodes texts. ``form`` says what is kept of each pre-token's ids."""

    def __init__(self, vocabulary: Vocabulary, form: Callable[[bytes], object]):
        self.merger, self.form, self.kept = Merger(vocabulary), form, _Kept()
        self.special = {word: form(int(number).to_bytes(4, "little")) for word, number in vocabulary.special.items()}
        self.kept.update(self.special)
        longest = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})") if longest else None

    def pre_tokens(self, text: str) -> list[str]:
        if self.cut is None or not any(word in text for word in self.special):
            return cut(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else cut(part)
        return out

    def forms(self, texts: list[str | None]) -> Iterator[Iterator]:
        """For each text its pre-tokens' forms in order. Use each before taking the next."""
        tokens_of = [self.pre_tokens(text or "") for text in texts]
        new = set().union(*tokens_of).difference(self.kept)
        words = list(new)
        found = dict(zip(words, map(self.form, self.merger.words([w.encode() for w in words])), strict=True))
        self.kept.extra = {}
        if len(self.kept) < KEEP:
            self.kept.update(found)
        else:
            self.kept.extra = found
        get = self.kept.__getitem__
        for tokens in tokens_of:
            yield map(get, tokens)


_ENCODERS: dict = {}


def encoder(path: str, vocabulary, name: str, form: Callable[[bytes], object]) -> Encoder:
    """The encoder of this process for a vocabulary file, which comes as a broadcast."""
    key = (path, name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value, form)
    return _ENCODERS[key]


def id_bytes(ids: bytes) -> bytes:
    return ids


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of every text, in the order of the text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(path, vocabulary, "bytes", id_bytes)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [np.frombuffer(b"".join(forms), "<u4") for forms in held.forms(part.column("text").to_pylist())]
                ids = pa.array(rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of every row's ``ids``, special tokens included."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.bytes_of.__getitem__
        for batch in batches:
            texts = [b"".join(map(get, ids or [])).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every text, without moving the ids out of the task."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.bytes_of.__getitem__

        def form(ids: bytes) -> tuple[str, bytes]:
            listed = memoryview(ids).cast("I").tolist()
            return ",".join(map(str, listed)), b"".join(map(get, listed))

        held = encoder(path, vocabulary, "pairs", form)
        for batch in batches:
            for part in pieces(batch, "text"):
                counts, of_ids, of_text = [], [], []
                for forms in held.forms(part.column("text").to_pylist()):
                    both = list(forms)
                    ids = ",".join([f[0] for f in both]).encode()
                    text = b"".join([f[1] for f in both]).decode("utf-8", "replace").encode()
                    counts.append(ids.count(b",") + 1 if both else 0)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
