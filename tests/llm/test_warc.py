import base64
import hashlib

from roadpulse.llm import warc
from roadpulse.llm.queries import QUERIES

PAGE = "<html><head><title>A &amp; B</title></head><body><p>One <a href='/x?a=1'>two</a></p><script>no</script><p>Three é</p><a class=c href=http://h/y>z</a></body></html>"


def derived(spark, rows):
    return warc.derive(spark.createDataFrame(rows, warc.RESPONSES)).collect()


def response(key, payload, header="HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", given=None):
    return (key, "http://h/a", "2024-01-02T03:04:05Z", header, payload, None, given)


def test_links_between_records(spark):
    made = {r["record_type"]: r for r in derived(spark, [response("<urn:uuid:1>", PAGE.encode())])}
    assert set(made) == {"metadata", "conversion"}
    for r in made.values():
        assert (r["refers_to"], r["target_uri"], r["date"]) == ("<urn:uuid:1>", "http://h/a", "2024-01-02T03:04:05Z")
        assert r["source_header"].startswith("HTTP/1.1 200 OK") and r["record_id"].startswith("<urn:uuid:")
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(r["block"]).digest()).decode()
    assert made["metadata"]["record_id"] != made["conversion"]["record_id"]
    assert made["metadata"]["payload_digest"] == warc.digest(PAGE.encode())
    assert made["conversion"]["payload_digest"] == made["conversion"]["block_digest"]
    assert bytes(made["conversion"]["block"]).decode() == "One two\nThree é\nz"
    fields = bytes(made["metadata"]["block"]).decode().split("\r\n")
    assert {"title: A & B", "outlink: /x?a=1", "outlink: http://h/y", "source-content-type: text/html; charset=utf-8"} <= set(fields)


def test_digests_headers_and_charsets_are_kept(spark):
    latin = "<p>Größe</p>".encode("iso-8859-1")
    rows = [
        response("a", latin, "HTTP/1.1 200 OK\r\ncontent-type: text/html; charset=ISO-8859-1\r\n\r\n", "sha1:GIVEN"),
        response("b", b"<meta charset='iso-8859-1'>" + latin, ""),
        response("c", latin, "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n"),
    ]
    made = {(r["refers_to"], r["record_type"]): r for r in derived(spark, rows)}
    assert bytes(made["a", "conversion"]["block"]).decode() == bytes(made["b", "conversion"]["block"]).decode() == "Größe"
    assert made["a", "metadata"]["payload_digest"] == "sha1:GIVEN"
    assert "�" in bytes(made["c", "conversion"]["block"]).decode()


def test_charsets_that_cannot_decode_pages(spark):
    """Names that no text is written in, in the header or the page: read as utf-8 or as they are, and never a crash."""
    names = ["undefined", "idna", "punycode", "rot13", "hex", "zlib", "unicode_escape", "utf_7", "utf-16", "x" * 300]
    payload = "<p>Größe \\ud800 \\x</p>".encode() + b"\xff\xfe"
    rows = [response(f"h{n}", payload, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={n}\r\n\r\n") for n in names]
    rows += [response(f"m{n}", f"<meta charset={n}>".encode() + payload, "") for n in names]
    made = {(r["refers_to"], r["record_type"]): r for r in derived(spark, rows)}
    assert len(made) == 4 * len(names)
    for n in ("undefined", "idna", "rot13", "x" * 300):
        assert "Größe" in bytes(made[f"h{n}", "conversion"]["block"]).decode() and "Größe" in bytes(made[f"m{n}", "conversion"]["block"]).decode()


def test_hard_rows(spark):
    rows = [(None,) * 7, response("x", b""), response("x", b""), response("long", b"<p>" + b"w " * 400_000)]
    made = derived(spark, rows)
    assert len(made) == 8
    ids = [r["record_id"] for r in made if r["refers_to"] == "x"]
    assert len(set(ids)) == 2 and len(ids) == 4
    assert max(len(r["block"]) for r in made) == 2 * 400_000 - 1
    assert warc.derive(spark.createDataFrame([], warc.RESPONSES)).count() == 0


def test_serialized(spark):
    record = warc.serialized(warc.derive(spark.createDataFrame([response("<urn:uuid:1>", PAGE.encode())], warc.RESPONSES))).where("record_type = 'conversion'").first()
    head, _, rest = bytes(record["warc"]).partition(b"\r\n\r\n")
    lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\n") and lines["WARC-Refers-To"] == "<urn:uuid:1>" and lines["WARC-Type"] == "conversion"
    assert rest == bytes(record["block"]) + b"\r\n\r\n" and int(lines["Content-Length"]) == len(record["block"])


def test_pages_as_responses(spark):
    schema = "page_id long, url string, html string, record_id string"
    df = spark.createDataFrame([(1, "http://h/a", "<p>é</p>", "clash"), (None, None, None, None), (None, None, None, None)], schema)
    made = warc.responses(df).collect()
    one = next(r for r in made if r["target_uri"])
    assert bytes(one["payload"]).decode() == "<p>é</p>" and one["payload_digest"] == warc.digest("<p>é</p>".encode())
    assert one["block_digest"] == warc.digest(one["http_header"].encode() + bytes(one["payload"]))
    assert len(made) == 3 and len({r["record_id"] for r in made}) == 2


def test_query(spark, sf):
    made = QUERIES["op8_warc_derivatives"](spark, sf)
    assert made.count() == 2 * spark.read.parquet(f"{sf}/pages.parquet").count()
    assert made.select("record_id").distinct().count() == made.count()
