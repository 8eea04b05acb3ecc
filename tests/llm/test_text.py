"""Operators 2, 4, 5 and 8."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm import bpe, packing, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(PATH), bpe.id_bytes)


def ids_of(encoder, texts):
    return [list(memoryview(b"".join(forms)).cast("I")) for forms in encoder.forms(texts)]


def strange_texts() -> list[str]:
    rng = random.Random(11)
    parts = ["a", "the ", "ing", "'s", "'re", "\n", "  ", "\t", "é", "ß", "中文", "😀", "1", "23", "##", "!", "<|endoftext|>"]
    parts += ["<|end", "\xa0", "\x1c", "\x85", "º", "²", "́", "ا", "​", "Ⅷ", "﻿", "\0", "A"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    texts += ["".join(chr(rng.randrange(1, 0x3000)) for _ in range(1500)), "", "a" * 5000, "ab" * 3000, "é" * 700]
    return texts + ["x" * n for n in (1, 2, 31, 32, 33, 63, 64, 65, 66)]


def test_encoding_equals_the_library(encoder, library):
    texts = strange_texts()
    assert ids_of(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoding_with_a_full_table(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 10)
    small = bpe.Encoder(bpe.Vocabulary(PATH), bpe.id_bytes)
    for text in strange_texts()[:40]:
        assert ids_of(small, [text, text]) == [library.encode(text, add_special_tokens=False).ids] * 2


def test_two_choice_table_finds_every_key(encoder):
    merger = encoder.merger
    assert (merger.rank(*pair_arrays(merger)) == list(range(len(merger.v.merged)))).all()


def pair_arrays(merger):
    import json

    import numpy as np

    with open(PATH, encoding="utf-8") as file:
        model = json.load(file)["model"]
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    return tuple(np.array([model["vocab"][p[side]] for p in pairs], np.int32) for side in (0, 1))


def test_round_trip(spark, awkward, clashing, nothing, library):
    for frame in (awkward, clashing, spark.read.parquet(f"{SF}/documents.parquet")):
        expected = Counter()
        for row in frame.select("doc_id", "text").collect():
            ids = library.encode(row.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), decoded)]
            expected[row.doc_id, len(ids), *sums] += 1
        assert Counter(map(tuple, bpe.round_trip(frame, PATH).collect())) == expected
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(awkward.where("doc_id < 18"), PATH), PATH).collect()}
    assert back == {r.doc_id: r.text for r in awkward.where("doc_id < 18").collect()}
    assert bpe.round_trip(nothing, PATH).count() == 0


def check_packing(rows, texts, library, capacity):
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for row in rows:
        by_sequence[row.sequence_id].append((row.offset, row.length))
        by_document[row.doc_id].append(row)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        parts = sorted(by_document[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert sum(p.length for p in parts) == len(ids) and all(p.length == capacity for p in parts[1:])
        at = 0
        for part in parts:
            assert part.start == at
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + part.length])
            assert part.ids_crc32 == zlib.crc32(raw)
            at += part.length
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, library, capacity, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, PATH, capacity).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, library, capacity)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // capacity) + 1
    assert packing.pack_documents(nothing, PATH, capacity).count() == 0


def test_packing_of_awkward_rows(awkward, clashing, library):
    for frame in (awkward, clashing):
        rows = packing.pack_documents(frame, PATH).collect()
        single = [d for d, n in Counter(r.doc_id for r in awkward.collect()).items() if n == 1]
        check_packing(rows, {r.doc_id: r.text for r in awkward.collect() if r.doc_id in single}, library, 1024)
        assert sum(1 for r in rows if r.piece == 0) == awkward.count()


def test_ranks_over_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    parts = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "id % 3 + 1 AS length", "id AS ids_crc32")
    rows = packing.pack(parts, 4).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4)


def plain_best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting)[1]] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_plan_opens_as_many_sequences_as_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 16, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        slots = packing.plan(Counter(lengths), capacity)
        used = {first + i // each for _, _, taken, first, each, _ in slots for i in range(taken)}
        assert len(used) == plain_best_fit(lengths, capacity)
        places = Counter()
        for length, _, taken, first, each, offset in slots:
            for i in range(taken):
                for token in range(length):
                    places[first + i // each, offset + i % each * length + token] += 1
        assert set(places.values()) <= {1} and sum(places.values()) == sum(lengths)
        assert all(at < capacity for _, at in places)


def test_automaton_finds_misspelled_terms():
    terms = [("pathetic", False), ("idiot", False), ("vequ", True), ("disgusting", False)]
    automaton = toxicity.Automaton(terms)
    for word, found in {
        "pathetic": (0, 0),
        "pathetc": (0, 1),
        "pathettic": (0, 1),
        "pazhetic": (0, 1),
        "apathetic": (0, 1),
        "pahtetic": None,
        "idiot": (1, 0),
        "idiots": None,
        "vequ": (2, 0),
        "vequille": (2, 0),
        "vaquille": None,
        "disgustin": (3, 1),
        "": None,
        "the": None,
    }.items():
        assert automaton.match(word) == found, word


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(12)})
    automaton = toxicity.Automaton([(t, False) for t in terms])
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        found = automaton.match(word)
        assert (found is None) == (not near)
        if found is not None:
            assert found[1] == min(near) == distance(word, terms[found[0]])


def test_context_parts_quotation_from_abuse():
    model = toxicity.Model([("pathetic", False)], [5.0], [1.0, 0.7, 0.3, 0.0, -2.0])
    reader = model.reader()

    def score(text):
        return model.score(__import__("numpy").array([reader.features(text)]))[0]

    abuse = score("you are pathetic and that is all")
    assert abuse > score("this is pathetic and that is all") > score("quite a lovely day")
    assert score('they said "you are pathetic" and left') == score("quite a lovely day") == score("")
    assert score("you are p4thetic and that is all") == abuse
    assert reader.spans("so pathetc!")[0][:4] == (3, 10, 0, 1)


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels, ~held)
    rows = toxicity.score(docs, model).where(held).join(labels, "doc_id").collect()
    wrong = sum((r.toxicity >= toxicity.THRESHOLD) != bool(r.toxic) for r in rows)
    assert wrong <= 0.03 * len(rows) and all(0 <= r.toxicity <= 1 for r in rows)


def test_toxicity_on_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(3, 1), (3, None), (5, 0), (None, 1), (18, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(awkward, labels, F.lit(True))
    assert toxicity.score(awkward, model).count() == awkward.count()
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(awkward, labels.limit(0), F.lit(True))
    scores = {r.toxicity for r in toxicity.score(awkward, empty).collect()}
    assert len(scores) == 1 and scores.pop() < toxicity.THRESHOLD


def test_plain_text(spark):
    html = (
        "<html><head><title>T</title></head><body><script>var a='</p>';</script><p>One &amp;amp; <b>t</b>wo&nbsp;x"
        "<br>three</p><!-- no --><STYLE x=1>p{}</STYLE> <ul><li> a<li>b </ul><script>open"
    )
    row = spark.createDataFrame([(html,), ("",), (None,)], "h string").select(warc.plain_text(F.col("h")).alias("t"))
    assert [r.t for r in row.collect()] == ["One &amp; two x\nthree\na\nb", "", None]


REFERENCES = [
    "1 < 2 and 3 > 1",
    "a&#8217;s caf&eacute; &#x27;q&#X27; &mdash; &hellip; &amp;lt; &unknown; &nbsp;x &apos;",
    "&#0; &#xD800; &#x110000; &#9999999; &#146; &#129; &#xfffd; & &; &#; &#x; a&b;c &&lt;&gt;",
    "&lt;b&gt; x<b>y</b> <3 <-- a<!-- no --> <?php x ?> </p>z",
    "",
    "&#128512;&#x1F600;" * 50,
]


def test_character_references_are_read_once(spark):
    frame = spark.createDataFrame([(t,) for t in REFERENCES], "t string")
    found = [r.u for r in frame.select(warc.unescaped(F.col("t")).alias("u")).collect()]

    def plain(match):
        inner = match[0][1:-1]
        if not inner.startswith("#"):
            return warc.NAMED.get(inner, match[0])
        code = int(inner[2:], 16) if inner[1] in "xX" else int(inner[1:])
        if code in warc.WINDOWS:
            return warc.WINDOWS[code]
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"

    assert found == [re.sub(warc.ENTITY, plain, t) for t in REFERENCES]
    texts = [r.t for r in frame.select(warc.plain_text(F.col("t")).alias("t")).collect()]
    assert texts[0] == "1 < 2 and 3 > 1"
    assert texts[1] == "a’s café 'q' — … &lt; &unknown; x '"
    assert texts[3] == "<b> xy <3 <-- a\nz"


def record(version, block, length=None, kind="response", ending=b"\r\n\r\n"):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(block)}>\r\nX-Note: a:b\r\n more\r\n"
    size = "" if length is None else f"Content-Length: {length}\r\n"
    return f"{head}{size}\r\n".encode() + block + ending


def test_records_end_where_their_length_says(spark, tmp_path):
    inner = b"x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nfake\r\n\r\nWARC/1.0 y"
    latin = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\ncaf\u00e9".encode("latin-1")
    broken = b"HTTP/1.1 200 OK\r\n\r\n\xff\xfeab"
    blocks = [b"HTTP/1.0 200 OK\r\n\r\none", inner, b"", latin, broken]
    data = b"".join(record("1.0" if i % 2 else "1.1", block, len(block)) for i, block in enumerate(blocks))
    (tmp_path / "a.warc").write_bytes(data + record("1.0", b"no length"))
    with gzip.open(tmp_path / "b.warc.gz", "wb") as file:
        file.write(data + record("1.1", b"cut off", 50, ending=b""))
    rows = warc.read(spark, str(tmp_path)).collect()
    expected = Counter((f"1.{0 if i % 2 else 1}", block, False) for i, block in enumerate(blocks) for _ in range(2))
    expected += Counter([("1.0", b"no length", False), ("1.1", b"cut off", True)])
    assert Counter((r.version, bytes(r.block), r.truncated) for r in rows) == expected
    assert {r.headers["x-note"] for r in rows} == {"a:b more"}
    payloads = Counter(r.payload for r in warc.response_rows(warc.read(spark, str(tmp_path))).collect())
    assert payloads["one"] == 2 and payloads["caf\u00e9"] == 2 and payloads[""] == 2 and payloads["\ufffd\ufffdab"] == 2


def test_derivatives_of_repeated_and_clashing_rows(spark):
    long = "<p>" + "word &amp; " * 60_000 + "</p>"
    rows = [(1, "u", long, "x", "y"), (1, "u", long, "x", "y"), (None, None, None, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string, refers_to string")
    made = warc.derivatives(warc.responses(pages, "2026-01-01T00:00:00Z"), "page_id").collect()
    ids = Counter(r.record_id for r in made)
    assert len(made) == 6 and sorted(ids.values()) == [1, 1, 2, 2]
    assert {r.content_length for r in made if r.warc_type == "conversion"} == {len("word & " * 60_000) - 1, 0}


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20).union(
        spark.createDataFrame([(None, None, None), (7, "http://x", "")], "page_id long, url string, html string")
    )
    found = warc.responses(pages, "2026-01-01T00:00:00Z")
    made = warc.derivatives(found, "page_id")
    assert made.count() == 44 and warc.derivatives(found.limit(0)).count() == 0
    warc.write(made, str(tmp_path / "out"))
    read = warc.read(spark, str(tmp_path / "out")).collect()
    blocks = {r.record_id: (r.block, r.refers_to, str(r.content_length)) for r in made.collect()}
    back = {r.headers["warc-record-id"]: (r.block.decode(), r.headers["warc-refers-to"], r.headers["content-length"]) for r in read}
    assert back == blocks
    ids = {(r.refers_to, r.warc_type): r for r in made.collect()}
    for (source, kind), row in ids.items():
        other = ids[source, "conversion" if kind == "metadata" else "metadata"]
        assert row.concurrent_to == other.record_id
        assert row.block_digest == "sha256:" + hashlib.sha256(row.block.encode()).hexdigest()
    first = next(r for r in made.collect() if r.warc_type == "metadata")
    assert "source-http-Content-Type: text/html" in first.block and first.source_payload_digest in first.block


def test_responses_are_read_from_warc(spark, tmp_path):
    record = "WARC-Type: response\r\nWARC-Record-ID: <urn:x:{0}>\r\nWARC-Target-URI: http://h/{0}\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>t{0}</p>"
    with open(tmp_path / "a.warc", "w", newline="") as file:
        file.write("".join(f"WARC/1.1\r\n{record.format(i)}\r\n\r\n" for i in range(3)))
    rows = warc.response_rows(warc.read(spark, str(tmp_path / "a.warc")))
    assert {(r.record_id, r.target_uri, r.http_headers, r.payload) for r in rows.collect()} == {
        (f"<urn:x:{i}>", f"http://h/{i}", "HTTP/1.1 200 OK\r\nA: b\r\n", f"<p>t{i}</p>") for i in range(3)
    }
    texts = {r.refers_to: r.block for r in warc.derivatives(rows).where("warc_type = 'conversion'").collect()}
    assert texts["<urn:x:1>"] == "t1"
