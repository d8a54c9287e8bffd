"""WARC derivatives: metadata and plain-text conversion records linked to the responses they come from."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import portions
from roadpulse.llm.markup import ATTRIBUTE, Node, blocks, parse, walk

#: Fixed names of the format.
VERSION = "WARC/1.1"
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length"]
RESPONSE_TYPE, METADATA_TYPE, TEXT_TYPE = "application/http;msgtype=response", "application/warc-fields", "text/plain; charset=utf-8"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LINK = re.compile(r"<a\s+([^>]*)>", re.I)

RESPONSES = "record_id string, target_uri string, date string, http_header string, payload binary, block_digest string, payload_digest string"
RECORDS = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "source_header string, block binary, block_digest string, payload_digest string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts, so that a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def responses(pages: DataFrame, identifier: str = "page_id", url: str = "url", source: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Raw pages as response records, for tables that keep no WARC headers: a minimal HTTP header, and digests of block
    and payload. A null page has an empty payload; a null id or URL stays null, and its record is told apart by its content."""
    taken = pages.select(F.col(identifier).cast("string").alias("i"), F.col(url).cast("string").alias("u"), F.col(source).cast("string").alias("h"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 2):
                rows = []
                for key, target, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    payload = (text or "").encode()
                    header = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                    own = digest(payload)
                    rows.append((record_id("response", repr(key), repr(target), own), target, date, header, payload, digest(header.encode() + payload), own))
                yield _batch(rows, RESPONSES)

    return taken.mapInArrow(over, RESPONSES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else pa.string()) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _charset(header: str, payload: bytes) -> str:
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", header, re.I)
    found = found or re.search(r"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", payload[:4096].decode("ascii", "ignore"), re.I)
    name = found[1].lower() if found else "utf-8"
    try:
        # Names that are no text encoding, or that know no replacement character, count as unknown.
        b"a\xff".decode(name, "replace")
    except (LookupError, ValueError, TypeError):
        return "utf-8"
    return name


def derived(record: str | None, target: str | None, date: str | None, header: str | None, payload: bytes | None, own_digest: str | None) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    header, payload = header or "", payload or b""
    charset = _charset(header, payload)
    text = payload.decode(charset, "replace")
    if charset != "utf-8":
        text = text.encode("utf-8", "replace").decode()  # some encodings yield halves of surrogate pairs
    payload_digest = own_digest or digest(payload)
    root = parse(text)
    title = next((" ".join("".join(n.children).split()) for n in walk(root) if n.tag == "title"), "")
    plain = "\n".join(blocks(root, _unseen)).encode()
    found = []
    for m in LINK.finditer(text):
        for a in ATTRIBUTE.finditer(m[1]):
            if a[1].lower() == "href":
                found.append(" ".join((a[2] or a[3] or a[4] or "").split()))
    kind = re.search(r"^content-type:\s*(.+?)\s*$", header, re.I | re.M)
    lines = [("title", title), ("charset-detected", charset), ("source-content-type", kind[1] if kind else ""), ("source-payload-digest", payload_digest), ("text-length", str(len(plain)))]
    lines += [("outlink", link) for link in found]
    fields = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    out = []
    for name, content_type, block in (("metadata", METADATA_TYPE, fields), ("conversion", TEXT_TYPE, plain)):
        own = digest(block)
        key = record_id(name, record or "", repr(target), payload_digest)
        out.append((name, key, record, target, date, content_type, header, block, own, payload_digest if name == "metadata" else own))
    return out


def _unseen(node: Node) -> bool:
    return node.hidden or node.tag in ("head", "title")


def derive(source: DataFrame) -> DataFrame:
    """Two records for each row of `source` (columns as in `RESPONSES`, others are not read): its metadata, and its whole text.

    Both name the response by `refers_to` and keep its target, date and HTTP header (`source_header`). The metadata record
    has the response's payload digest, the conversion record that of its own text. A response without a digest gets the one of its payload. A
    null or empty payload gives an empty text and no links; a null id, target or date stays null. Repeated responses give
    repeated records with the same ids. No rows give no rows.
    """
    taken = source.select("record_id", "target_uri", "date", "http_header", "payload", "payload_digest")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 4):
                rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
                yield _batch([r for row in rows for r in derived(*row)], RECORDS)

    return taken.mapInArrow(over, RECORDS)


def serialized(records: DataFrame) -> DataFrame:
    """`records` with `warc`, the bytes of each record as they stand in a file: header fields, the block, two line ends."""
    given = {
        "WARC-Type": F.col("record_type"), "WARC-Record-ID": F.col("record_id"), "WARC-Refers-To": F.col("refers_to"),
        "WARC-Target-URI": F.col("target_uri"), "WARC-Date": F.col("date"), "WARC-Block-Digest": F.col("block_digest"),
        "WARC-Payload-Digest": F.col("payload_digest"), "Content-Type": F.col("content_type"),
        "Content-Length": F.octet_length("block").cast("string"),
    }

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))

    head = F.concat(F.lit(f"{VERSION}\r\n"), *[line(name, given[name]) for name in FIELDS], F.lit("\r\n"))
    return records.withColumn("warc", F.concat(F.encode(head, "UTF-8"), F.col("block"), F.encode(F.lit("\r\n\r\n"), "UTF-8")))
