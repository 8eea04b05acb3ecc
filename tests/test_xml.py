from __future__ import annotations

import json
from random import Random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quayside.contracts import XML_CONTRACTS
from quayside.errors import DataFailure
from quayside.plans.receiving_flow import Batch, BatchRules, control_row, receive
from quayside.sources import snapshots, xml

NS = "urn:example:supply-chain:canonical:1"
LINES = {
    "asn-1001": [("ASN-1001", "1", "SKU-FILTER", "WH-ATL", "80", "EA")],
    "asn-1002": [("ASN-1002", "1", "SKU-FILTER", "WH-ATL", "40", "EA")],
    "asn-2001": [("ASN-2001", "1", "SKU-SEAL", "WH-DFW", "60", "EA")],
    "asn-exceptions": [
        ("ASN-1002", "1", "SKU-FILTER", "WH-ATL", "40", "EA"),
        ("ASN-3001", "1", "SKU-UNKNOWN", "WH-ATL", "25", "EA"),
        ("ASN-3002", "1", "SKU-SEAL", "WH-DFW", "-5", "EA"),
    ],
}
PRODUCTS = {
    "filters": [("SKU-FILTER", "Replacement air filters", "EA")],
    "seals": [("SKU-SEAL", "Hydraulic seal kits", "EA")],
}


def document(contract, rows, namespace=NS, version="1.0"):
    spec = XML_CONTRACTS[contract]
    records = "".join(
        f"<{spec.record}>"
        + "".join(f"<{element}>{value}</{element}>" for (element, _), value in zip(spec.fields, row, strict=True))
        + f"</{spec.record}>"
        for row in rows
    )
    return f'<{spec.root} xmlns="{namespace}" schemaVersion="{version}">{records}</{spec.root}>'


@pytest.fixture
def landing(tmp_path):
    for folder, contract, files in (
        ("shipments", "shipment_batch", LINES),
        ("products", "product_catalog", PRODUCTS),
    ):
        (tmp_path / folder).mkdir()
        for name, rows in files.items():
            (tmp_path / folder / f"{name}.xml").write_text(document(contract, rows))
    (tmp_path / "shipments" / "notes.txt").write_text("not a shipment")
    return tmp_path


def batch(root: Path, **changes):
    values = dict(
        scope="2024-01-02",
        run_id="R1",
        shipments=str(root / "shipments"),
        products=str(root / "products"),
        outputs=str(root / "outputs"),
        rejects=str(root / "rejects"),
        references=str(root / "references"),
    )
    return Batch(**{**values, **changes})


def test_golden_batch(spark, landing):
    published, intent = receive(spark, batch(landing))
    assert published["accepted"]["row_count"] == 3
    assert published["rejects"]["row_count"] == 2
    plan = snapshots.Proofs(spark).read(published["receiving_plan"])
    assert sorted(map(tuple, plan.collect())) == [
        ("WH-ATL", "SKU-FILTER", "EA", 120, 2),
        ("WH-DFW", "SKU-SEAL", "EA", 60, 1),
    ]
    rejects = snapshots.Proofs(spark).read(published["rejects"])
    assert {row.reason for row in rejects.collect()} == {"unknown_sku", "invalid_quantity"}
    assert "/rejects/" in published["rejects"]["path"]
    assert intent.count() == 1
    assert snapshots.committed(spark, str(landing / "references")).count() == 5
    again, repeated = receive(spark, batch(landing, run_id="R2"))
    assert repeated.first().payload_digest == intent.first().payload_digest
    assert again["receiving_plan"]["digest"] == published["receiving_plan"]["digest"]
    with pytest.raises(DataFailure) as failure:
        receive(spark, batch(landing))
    assert failure.value.code == "ARTIFACT_COLLISION"


def test_failed_gate_publishes_no_plan(spark, landing):
    with pytest.raises(DataFailure) as failure:
        receive(spark, batch(landing, rules=BatchRules(max_rejects=1)))
    assert failure.value.code == "QUALITY_GATE_FAILED"
    names = {row.name for row in snapshots.committed(spark, str(landing / "references")).collect()}
    assert names == {"shipments", "products", "accepted", "rejects"}


def test_scan_is_recursive_and_sees_new_files(spark, landing):
    path = str(landing / "shipments")
    assert xml.read_xml(spark, path, "shipment_batch").count() == 6
    (landing / "shipments" / "partner").mkdir()
    row = ("ASN-PARTNER", "1", "SKU-SEAL", "WH-ATL", "1", "EA")
    (landing / "shipments" / "partner" / "new.XML").write_text(document("shipment_batch", [row]))
    rows = xml.read_xml(spark, path, "shipment_batch").collect()
    assert len(rows) == 7 and row in map(tuple, rows)


def test_bounds_fail_before_parsing(spark, landing):
    path = str(landing / "shipments")
    for limit in ({"max_file_bytes": 10}, {"max_files": 1}):
        with pytest.raises(DataFailure) as failure:
            xml.read_xml(spark, path, "shipment_batch", **limit)
        assert failure.value.code == "XML_INPUT_LIMIT"
    (landing / "empty").mkdir()
    for missing in ("empty", "nowhere"):
        with pytest.raises(DataFailure) as failure:
            xml.read_xml(spark, str(landing / missing), "shipment_batch")
        assert (failure.value.code, failure.value.retryable) == ("SOURCE_UNAVAILABLE", True)
    statistics = xml.file_statistics(xml.list_files(spark, path)).first()
    assert statistics.files == 4


def test_fingerprint_covers_names_and_contents(spark, landing):
    path = str(landing / "shipments")

    def proof():
        return xml.file_set_digest(xml.list_files(spark, path), path).first()

    initial = proof()
    extra = landing / "shipments" / "extra.xml"
    extra.write_text(document("shipment_batch", [("A", "1", "S", "W", "10", "EA")]))
    added = proof()
    assert added != initial
    renamed_file = extra.rename(extra.with_name("renamed.xml"))
    renamed = proof()
    assert renamed not in (added, initial)
    renamed_file.write_text(renamed_file.read_text().replace(">10<", ">11<"))
    assert proof() not in (renamed, added, initial)
    renamed_file.unlink()
    (landing / "shipments" / "notes.txt").write_text("changed")
    assert proof() == initial


GOOD = ("S", "1", "k", " ", "12\n", "")


def test_values_are_kept_as_written(spark):
    text = document("shipment_batch", [("A &amp; B", "<![CDATA[<1>]]>", "a<!-- c -->b", " ", "12\n", "")])
    frame = spark.createDataFrame([(bytearray(("\ufeff" + text).encode()),)], "content binary")
    assert [tuple(r) for r in xml.parsed_rows(frame, "shipment_batch").collect()] == [
        ("A & B", "<1>", "ab", " ", "12\n", None)
    ]


def broken():
    good = document("shipment_batch", [GOOD])
    yield "OK", good
    yield "OK", good.replace("xmlns=", "xmlns:c=").replace("</", "</c:").replace("<S", "<c:S").replace(
        "<sh", "<c:sh"
    ).replace("<l", "<c:l").replace("<sku", "<c:sku").replace("<w", "<c:w").replace("<q", "<c:q").replace(
        "<u", "<c:u"
    )
    yield "OK", '<?xml version="1.0" encoding="ISO-8859-1"?>' + good
    yield "XML_ENVELOPE_MISMATCH", document("shipment_batch", [GOOD], version="2.0")
    yield "XML_ENVELOPE_MISMATCH", document("shipment_batch", [GOOD], namespace="urn:other")
    yield "XML_ENVELOPE_MISMATCH", document("product_catalog", [("a", "b", "c")])
    yield "XML_STRUCTURE_MISMATCH", good.replace("</ShipmentLine>", "<x/></ShipmentLine>")
    yield "XML_STRUCTURE_MISMATCH", good.replace("<lineId>1</lineId>", "")
    yield "XML_STRUCTURE_MISMATCH", good.replace("<lineId>1</lineId>", "<lineId><b>1</b></lineId>")
    yield "XML_STRUCTURE_MISMATCH", good.replace("<sku>", '<sku kind="a">')
    yield "XML_STRUCTURE_MISMATCH", good.replace("<ShipmentLine>", "stray<ShipmentLine>", 1)
    yield "XML_STRUCTURE_MISMATCH", good.replace(
        "<ShipmentLine>", f'<ShipmentLine xmlns:i="{xml.XSI}" i:schemaLocation="a b">', 1
    )
    yield "UNSAFE_XML", '<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]>' + good.replace("k<", "&e;<")
    yield "UNSAFE_XML", '<?xml version="1.0"?><!-- c --><!DOCTYPE a>' + good
    yield "MALFORMED_XML", good[:-9]
    yield "MALFORMED_XML", good + "tail"
    yield "MALFORMED_XML", "hello"
    yield "MALFORMED_XML", ""
    yield "EMPTY_XML_BATCH", document("shipment_batch", [])
    yield "XML_RECORD_LIMIT", document("shipment_batch", [GOOD] * 4)
    yield "XML_FILE_TOO_LARGE", document("shipment_batch", [("x" * 4000, *GOOD[1:])])


def test_every_bad_document_is_classified(spark):
    cases = list(broken())
    frame = spark.createDataFrame(
        [(i, bytearray(text.encode())) for i, (_, text) in enumerate(cases)], "i int, content binary"
    )
    invalid = spark.createDataFrame([(len(cases), bytearray(b"<a>\xff\xfe\x00</a>"))], "i int, content binary")
    got = xml.document_status(
        frame.unionAll(invalid), "shipment_batch", max_records=3, max_file_bytes=3000
    ).collect()
    want = [status for status, _ in cases] + ["MALFORMED_XML"]
    assert [row.status for row in sorted(got)] == want
    version = xml.document_status(frame.limit(1), "shipment_batch", schema_version="2.0").first()
    assert version.status == "UNSUPPORTED_XML_VERSION"


def test_one_bad_document_fails_the_read_without_its_content(spark, landing):
    (landing / "shipments" / "bad.xml").write_text("<secret>")
    frame = xml.read_xml(spark, str(landing / "shipments"), "shipment_batch")
    with pytest.raises(PySparkException) as failure:
        frame.collect()
    assert "MALFORMED_XML" in str(failure.value) and "secret" not in str(failure.value)
    with pytest.raises(DataFailure) as typed:
        xml.require_good_documents(xml.list_files(spark, str(landing / "shipments")), "shipment_batch")
    assert typed.value.code == "MALFORMED_XML"


def test_unknown_contract(spark):
    with pytest.raises(DataFailure, match="No such XML contract"):
        xml.contract("other")


def test_control_rows_are_published(spark, landing):
    proofs = snapshots.Proofs(spark)
    for node, row in (("notify", {"kind": "failure"}), ("cleanup", {"completed": True})):
        reference = snapshots.publish(
            proofs,
            str(landing / "references"),
            "s",
            "r",
            node,
            1,
            {"receipt": (control_row(spark, **row), str(landing / "outputs"))},
        )["receipt"]
        assert [r.asDict() for r in proofs.read(reference).collect()] == [row]
        assert json.loads(json.dumps(reference))["row_count"] == 1


def status_of(spark, *documents: bytes, **limits):
    frame = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(documents)], "n int, content binary")
    rows = xml.document_status(frame, "product_catalog", **limits).collect()
    return [r.status for r in sorted(rows, key=lambda r: r.n)]


def test_no_document_type_is_ever_opened(spark, tmp_path):
    """The DTD would supply the missing version, so a parser that opened it would find the document good."""
    spec = XML_CONTRACTS["product_catalog"]
    dtd = tmp_path / "d.dtd"
    dtd.write_text(f'<!ATTLIST {spec.root} schemaVersion CDATA "1.0">')
    good = document("product_catalog", PRODUCTS["filters"])
    bare = good.replace(' schemaVersion="1.0"', "")
    typed = f'<!DOCTYPE {spec.root} SYSTEM "file://{dtd}">{bare}'
    frame = spark.createDataFrame([(bytearray(typed.encode()),)], "content binary")
    parsed = xml.parse_documents(frame, "product_catalog").first()
    assert (parsed.status, parsed.records) == ("UNSAFE_XML", None)
    missing = typed.replace(str(dtd), str(tmp_path / "absent.dtd"))
    assert status_of(spark, missing.encode(), good.encode()) == ["UNSAFE_XML", "OK"]


def test_record_limit_comes_before_structure(spark):
    rows = [("S", "d", "EA")] * 4
    spec = XML_CONTRACTS["product_catalog"]
    element = spec.fields[1][0]
    bad = document("product_catalog", rows).replace(f"<{element}>d</{element}>", "", 1)
    assert status_of(spark, bad.encode(), max_records=2) == ["XML_RECORD_LIMIT"]
    assert status_of(spark, bad.encode(), max_records=4) == ["XML_STRUCTURE_MISMATCH"]


def test_single_byte_encodings(spark):
    text = document("product_catalog", [("S", "5 € – «é»", "EA")])
    held = {"windows-1252": "5 € – «é»", "iso-8859-15": "5 € - «é»"}
    for charset, value in held.items():
        body = f'<?xml version="1.0" encoding="{charset}"?>' + text.replace("5 € – «é»", value)
        frame = spark.createDataFrame([(bytearray(body.encode(charset)),)], "content binary")
        row = xml.parse_documents(frame, "product_catalog").first()
        assert row.status is None and row.records[0].description == value


def statuses(spark, texts):
    frame = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "n int, content binary")
    rows = xml.document_status(frame, "shipment_batch").collect()
    return [row.status for row in sorted(rows, key=lambda row: row.n)]


def test_long_prologs_have_a_status(spark):
    good = document("shipment_batch", LINES["asn-1001"])
    doctype = '<!DOCTYPE ShipmentBatch [<!ENTITY e "v">]>'
    many = "<!---->" * 100_000
    mixed = "<!-- a -- > --><?p x?>\n \t" * 20_000
    found = statuses(spark, [many + good, many + doctype + good, mixed + good, mixed + doctype + good, many, "<!--" * 100_000])
    assert found == ["OK", "UNSAFE_XML", "MALFORMED_XML", "UNSAFE_XML", "MALFORMED_XML", "MALFORMED_XML"]


def test_instance_attributes_are_found_behind_signs_in_values(spark):
    xsi = 'xmlns:i="http://www.w3.org/2001/XMLSchema-instance"'
    good = document("shipment_batch", LINES["asn-1001"])

    def rooted(extra):
        return good.replace("<ShipmentBatch ", f"<ShipmentBatch {extra} ")

    aside = "<!-- " + "<" * 50_000 + " <a i:x='' -->"
    found = statuses(
        spark,
        [
            rooted(xsi),
            rooted(f'{xsi} i:schemaLocation="a b"'),
            rooted(f"xmlns:b='>' {xsi} i:schemaLocation = 'a b'"),
            good.replace("<ShipmentLine>", f"<ShipmentLine {xsi} i:nil='false'>"),
            rooted(xsi).replace("</ShipmentBatch>", aside + "</ShipmentBatch>"),
        ],
    )
    assert found == ["OK", "XML_STRUCTURE_MISMATCH", "XML_STRUCTURE_MISMATCH", "XML_STRUCTURE_MISMATCH", "OK"]


def changed_documents(number):
    """Plain documents, each with up to two small changes that keep or break them."""
    random = Random(7)
    good = document("shipment_batch", LINES["asn-1001"] * 2)
    empty = good[: good.index("<ShipmentLine>")] + "</ShipmentBatch>"
    pieces = ["<", ">", "&", "&lt;", "&#65;", "]]>", " ", "\r", "\x01", "￿", "é😀", "", "<b/>", "<b></b>", "</b>", "<sku>", "</sku>"]
    pieces += ["<!---->", "<?x?>", "<![CDATA[x]]>", "</ShipmentLine>", "<ShipmentLine>", ' id="1"', ' xmlns="urn:x"', "</ShipmentBatch>"]
    for _ in range(number):
        text = random.choice([good, good, good, empty])
        for _ in range(random.choice([0, 1, 1, 2])):
            # At the ends of tags, where changes tell most, or anywhere.
            at = random.choice([i for i, c in enumerate(text) if c in "<>"] or [0]) + random.choice([0, 1])
            at = random.choice([at, at, random.randrange(len(text))])
            text = text[:at] + random.choice(pieces) + text[at + random.choice([0, 0, 0, 1, 9, 40]) :]
        yield text


def test_plain_forms_agree_with_the_parser(spark, monkeypatch):
    texts = [
        *changed_documents(1500),
        *(text for _, text in broken()),
        document("shipment_batch", [("", " ", " a ", "&lt;b&amp;lt;>\"'".replace(">", "&gt;"), "\n\t", "é😀")]),
    ]
    frame = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "n int, content binary")

    def rows():
        found = xml.parse_documents(frame, "shipment_batch", max_records=4).select("n", "status", "records").collect()
        return sorted((r.n, r.status, r.records) for r in found)

    by_form = rows()
    monkeypatch.setattr(xml, "_plain_form", lambda *_: F.lit(None).cast("string"))
    by_parser = rows()
    assert [(texts[a[0]], a, b) for a, b in zip(by_form, by_parser) if a != b] == []
    assert len({status for _, status, _ in by_parser}) >= 6


def test_plain_documents_need_no_parser(spark, monkeypatch):
    good = document("shipment_batch", LINES["asn-1001"])
    texts = [
        good,
        good.replace("<sku>", "<b>", 1).replace("</sku>", "</b>", 1),
        good.replace("canonical:1", "other"),
        good.replace("</ShipmentBatch>", ""),
        good[: good.index("<ShipmentLine>")] + "</ShipmentBatch>",
    ]
    plain = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "n int, content binary")
    refuse = F.raise_error(F.lit("parsed")).cast(xml._record_schema(xml.contract("shipment_batch")))
    monkeypatch.setattr(F, "from_xml", lambda *_: refuse)
    found = xml.document_status(plain, "shipment_batch").collect()
    assert [row.status for row in sorted(found, key=lambda row: row.n)] == [
        "OK",
        "XML_STRUCTURE_MISMATCH",
        "XML_ENVELOPE_MISMATCH",
        "MALFORMED_XML",
        "EMPTY_XML_BATCH",
    ]
