"""WARC derivatives: of each response a metadata record and a plain-text conversion record, linked to it and to each
other. The derivatives are made by DataFrame functions; files are read record by record.

A response row has record_id, target_uri, warc_date and the HTTP message as ``http_headers`` and ``payload``. Both
derivatives carry WARC-Refers-To (the response), the source's digests, and the metadata record also its HTTP headers.
Ids are made from the source id and the content, so that a repeated run gives the same records.

A null payload or header block is empty. A null URI or date stays null and its header line is left out. Repeated rows
give repeated records with the same ids. An empty table gives no rows. Other columns don't take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character references: decimal, hexadecimal, and the names that HTML 4 gives (the standard library lists them).
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
NAMED = {name: chr(code) for name, code in sorted({**name2codepoint, "apos": 39}.items())}
# Numbers that pages use for windows-1252 bytes.
WINDOWS = {code: bytes([code]).decode("cp1252") for code in range(128, 160) if code not in (129, 141, 143, 144, 157)}
TAG = "<[A-Za-z/!?][^>]*>"
# Elements whose content is no text, and comments.
HIDDEN = "|".join(
    [
        *[
            rf"<{name}(?:[ \t\r\n\f/][^>]*)?>.*?(?:</{name}[ \t\r\n\f]*>|\z)"
            for name in ("script", "style", "head", "noscript", "template")
        ],
        r"<!--.*?(?:-->|\z)",
    ]
)
BREAKS = (
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|nav|aside|header|footer|main|pre"
    r"|blockquote|form|title|body|html)(?:[ \t\r\n\f/][^>]*)?>"
)
TITLE = r"<title(?:[ \t\r\n\f][^>]*)?>(.*?)</title"
LINK = r"<a[ \t\r\n\f][^>]*href"
BATCH_BYTES = 4_000_000  # of records that leave a task together, about
SEPARATOR = b"\r\n\r\nWARC/1."


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _character(reference: Column) -> Column:
    """What a character reference stands for; itself where its name is unknown."""
    inner = F.substring(reference, F.lit(2), F.length(reference) - 2)
    hexadecimal = F.lower(F.substring(inner, 2, 1)) == "x"
    digits = F.when(hexadecimal, F.substring(inner, F.lit(3), F.length(inner))).otherwise(
        F.substring(inner, F.lit(2), F.length(inner))
    )
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    numbered = F.when(code.between(128, 159), F.coalesce(F.try_element_at(_map(WINDOWS), code), plain)).otherwise(plain)
    named = F.coalesce(F.try_element_at(_map(NAMED), inner), reference)
    return F.when(inner.startswith("#"), numbered).otherwise(named)


def _read_references(text: Column) -> Column:
    between = F.split(text, ENTITY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({ENTITY})")), _character)
    joined = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def unescaped(text: Column) -> Column:
    """A text with its character references read, each once: ``&amp;lt;`` becomes ``&lt;``. The text is bound to a
    variable, so that what makes it up is worked out once."""
    return F.element_at(F.transform(F.array(text), _read_references), 1)


def plain_text(html: Column) -> Column:
    """The visible text, one line per block. A tag begins with a letter, ``/``, ``!`` or ``?``; other angles are text."""
    text = F.regexp_replace(html, f"(?is){HIDDEN}", " ")
    text = F.regexp_replace(text, f"(?i){BREAKS}", "\n")
    text = unescaped(F.regexp_replace(text, TAG, ""))
    text = F.regexp_replace(text, "[ \\t\\r\\f ]+", " ")
    return F.btrim(F.regexp_replace(text, " ?\\n[\\n ]*", "\n"), F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """A URN from the MD5 of some values."""
    digest = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses(pages: DataFrame, warc_date: str) -> DataFrame:
    """Response rows of fetched pages (page_id, url, html), as a crawler would have stored them."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n"),
    )
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(warc_date).alias("warc_date"),
        headers.alias("http_headers"),
        payload.alias("payload"),
    )


def derivatives(found: DataFrame, *carried: str) -> DataFrame:
    """Two rows per response: warc_type, record_id, refers_to, concurrent_to, target_uri, warc_date, content_type,
    source_payload_digest, source_block_digest, block_digest, content_length and block, after the columns ``carried``.
    """
    headers, payload = F.coalesce("http_headers", F.lit("")), F.coalesce("payload", F.lit(""))
    source = found.select(
        *carried,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        headers.alias("__headers"),
        payload.alias("__payload"),
        plain_text(payload).alias("__text"),
        digest(payload).alias("source_payload_digest"),
        digest(F.concat(headers, F.lit("\r\n"), payload)).alias("source_block_digest"),
    )
    title = F.regexp_replace(F.regexp_extract("__payload", f"(?is){TITLE}", 1), "[ \\t\\r\\n\\f]+", " ")
    fields = F.concat(
        F.lit("title: "),
        F.btrim(title, F.lit(" ")),
        F.lit("\r\noutlinks: "),
        F.regexp_count("__payload", F.lit(f"(?i){LINK}")).cast("string"),
        F.lit("\r\ntext-length: "),
        F.octet_length("__text").cast("string"),
        F.lit("\r\nsource-payload-digest: "),
        F.col("source_payload_digest"),
        F.lit("\r\nsource-block-digest: "),
        F.col("source_block_digest"),
        F.lit("\r\n"),
        # The HTTP header lines, each as a field of its own.
        F.regexp_replace("__headers", "(?m)^([^:\\r\\n]+: )", "source-http-$1"),
    )
    made = source.withColumn("__metadata", fields).select(
        "*",
        record_id(F.lit("metadata"), F.col("refers_to"), F.md5("__metadata")).alias("__metadata_id"),
        record_id(F.lit("conversion"), F.col("refers_to"), F.md5("__text")).alias("__text_id"),
    )
    kinds = F.array(
        F.struct(
            F.lit("metadata").alias("warc_type"),
            F.col("__metadata_id").alias("record_id"),
            F.col("__text_id").alias("concurrent_to"),
            F.lit("application/warc-fields").alias("content_type"),
            F.col("__metadata").alias("block"),
        ),
        F.struct(
            F.lit("conversion").alias("warc_type"),
            F.col("__text_id").alias("record_id"),
            F.col("__metadata_id").alias("concurrent_to"),
            F.lit("text/plain; charset=utf-8").alias("content_type"),
            F.col("__text").alias("block"),
        ),
    )
    each = made.select("*", F.inline(kinds))
    return each.select(
        *carried,
        "warc_type",
        "record_id",
        "refers_to",
        "concurrent_to",
        "target_uri",
        "warc_date",
        "content_type",
        "source_payload_digest",
        "source_block_digest",
        digest(F.col("block")).alias("block_digest"),
        F.octet_length("block").cast("long").alias("content_length"),
        "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """``value``: each record as WARC 1.1 text, without its last line feed, which the text sink adds."""
    lines = {
        "WARC-Type": "warc_type",
        "WARC-Record-ID": "record_id",
        "WARC-Date": "warc_date",
        "WARC-Target-URI": "target_uri",
        "WARC-Refers-To": "refers_to",
        "WARC-Concurrent-To": "concurrent_to",
        "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type",
        "Content-Length": "content_length",
    }
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), F.col(v)) for k, v in lines.items()])
    return records.select(F.concat(head, F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r")).alias("value"))


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes WARC files, one per partition."""
    serialised(records).write.option("compression", compression).option("lineSep", "\n").text(path)


def _header(lines: bytes) -> dict[str, str]:
    """Names in lower case; a repeated name has its values joined by commas, and folded lines go on."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return out


class _Records:
    """Puts the pieces of a file between two separators back together by the records' own lengths."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, list[tuple[str, str]], bytes, bool]] = []
        self.open: tuple[str, dict[str, str], bytearray, int] | None = None

    def add(self, piece: bytes) -> None:
        if self.open:  # the block of the record before holds a separator itself
            version, header, block, length = self.open
            block += SEPARATOR + piece
        else:
            piece = piece.removeprefix(SEPARATOR.lstrip())
            head, _, rest = piece.partition(b"\r\n\r\n")
            version, _, lines = head.partition(b"\r\n")
            header = _header(lines)
            if "warc-type" not in header:
                return
            version, block = f"1.{version.decode('ascii', 'replace').strip()}", bytearray(rest)
            given = header.get("content-length", "")
            length = int(given) if given.isdigit() else len(rest.removesuffix(b"\r\n\r\n"))
        self.open = (version, header, block, length)
        if len(block) >= length:
            self.close()

    def close(self) -> None:
        if self.open:
            version, header, block, length = self.open
            self.rows.append((version, list(header.items()), bytes(block[:length]), len(block) < length))
        self.open = None

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.bool_()]
        columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, ["version", "headers", "block", "truncated"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC 1.0 and 1.1 files: ``version``, ``headers`` (map, names in lower case), ``block`` (bytes) and
    ``truncated``, which tells that a file ends inside the block.

    Files are cut at the separator, in splits where they aren't compressed, and a block ends where its Content-Length
    says: one that holds the separator itself is put together again, as long as no split begins inside it.
    """
    held = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    pieces_ = held.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, current = _Records(), None
        for batch in batches:
            size = 0
            for file, piece in zip(batch.column("file"), batch.column("piece"), strict=True):
                if file != current:
                    records.close()
                    current = file
                records.add(piece.as_py())
                size += len(piece.as_py())
                if size > BATCH_BYTES:
                    yield records.batch()
                    size = 0
            yield records.batch()
        records.close()
        yield records.batch()

    return pieces_.mapInArrow(run, "version string, headers map<string, string>, block binary, truncated boolean")


# Encodings that a page may declare, by their names.
CHARSETS = {
    "ISO-8859-1": ["iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii"],
    "UTF-16": ["utf-16", "utf-16le", "utf-16be"],
}


def _payload_text(payload: Column, headers: Column) -> Column:
    """Bytes as text by the declared encoding; as UTF-8, with broken sequences replaced, where none is known."""
    declared = F.lower(F.regexp_extract(headers, r"(?i)content-type:[^\r\n]*charset=[\"']?([A-Za-z0-9_.-]+)", 1))
    text = F.make_valid_utf8(payload.cast("string"))
    for charset, names in CHARSETS.items():
        text = F.when(declared.isin(names), F.decode(payload, charset)).otherwise(text)
    return text


def response_rows(records: DataFrame) -> DataFrame:
    """The response records of ``read`` as rows for ``derivatives``; a truncated one has what is there."""
    # One character per byte, so places in it are places in the block.
    at = F.locate("\r\n\r\n", F.decode("block", "ISO-8859-1"))
    headers = F.when(at > 0, F.decode(F.substring(F.col("block"), F.lit(1), at + 1), "ISO-8859-1")).otherwise(F.lit(""))
    payload = F.when(at > 0, F.substring(F.col("block"), at + 4, F.octet_length("block"))).otherwise(F.col("block"))
    return records.where(F.col("headers")["warc-type"] == "response").select(
        F.try_element_at("headers", F.lit("warc-record-id")).alias("record_id"),
        F.try_element_at("headers", F.lit("warc-target-uri")).alias("target_uri"),
        F.try_element_at("headers", F.lit("warc-date")).alias("warc_date"),
        headers.alias("http_headers"),
        _payload_text(payload, headers).alias("payload"),
    )
