import base64
import hashlib

import pytest

from tablerisk.llm import warc
from tablerisk.llm.store import Folder, new_folder, stored

SCHEMA = "page_id long, url string, html string, sha1 string, id long"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (3, "http://c", "<p>same</p>"), (1, "http://a", "<p>same</p>"), (2, None, "<p>other é</p>"), (4, "u\r\nx", None),
    (5, "e", ""), (6, "f", "<p>same</p>"), (7, "g", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (None, "n", "<p>same</p>"),
    (8, "h", "x" * 300_000), (9, "i", "y"), (9, "i", "y"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_revisits_and_round_trip(spark, least):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA)
    got = warc.deduplicated_archives(pages, least).collect()
    first = {}
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, url, html in ROWS:
        text = html or ""
        revisit = len(text.encode()) >= least and i != first[text]
        expected.append((i, len(text.encode()), digest(html), "revisit" if revisit else "response", first[text] if revisit else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(expected, key=key)


def test_payloads_come_back_and_revisits_hold_none(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS if r[0]], SCHEMA)
    folder = new_folder(spark, "warc-test")
    resolved = stored(warc.resolve(warc.payload_headers(pages)), f"{folder}/headers")
    manifest = stored(warc.write_archives(pages, resolved, f"{folder}/files", "2024-01-01T00:00:00Z"), f"{folder}/manifest")
    html = {i: h or "" for i, _, h in ROWS}
    for row in manifest.collect():
        for head, block in warc.parse(Folder(f"{folder}/files").open_input(row["file"])):
            body = block.partition(b"\r\n\r\n")[2]
            page = int(head["X-Page-ID"])
            assert head["WARC-Block-Digest"] == "sha1:" + warc.digest(block)
            assert body == (html[page].encode() if head["WARC-Type"] == "response" else b"")
            assert head["WARC-Record-ID"] == warc.record_id(page)


def test_damage_is_found(spark):
    page = {"page_id": 1, "url": "u", "record_type": "response", "payload_digest": digest("abc"), "payload_bytes": 3}
    head, _, block = warc.record(page, b"abd", "d").partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    with pytest.raises(ValueError):
        warc.checked(fields, block[: int(fields["Content-Length"])])


def test_empty_table(spark):
    assert warc.deduplicated_archives(spark.createDataFrame([], SCHEMA)).count() == 0
