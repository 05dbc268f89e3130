"""WARC archives with revisit records resolved over the whole corpus.

Headers (page, digest, length) are shuffled by payload digest, each page is joined to the
original response of its payload, and archives are written with fresh headers: the payload
once, a revisit record for each later page. ``read_archives`` reads them back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablerisk.llm.store import Folder, new_folder, stored
from tablerisk.llm.text import slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORDS = (
    "page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long, url string"
)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_headers(pages: DataFrame) -> DataFrame:
    """One (page_id, sha1, payload_bytes) row per page; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha1(payload).alias("sha1"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add record_type and refers_to.

    Of the records with one payload of at least ``least_bytes`` bytes, the one with the smallest
    page_id is the response and the others revisit it. Smaller payloads are all responses. Rows that
    repeat the response's page_id are responses too; a null page_id comes after all others, and if
    no other page has the payload, its records are responses.
    """
    key = ["sha1", "payload_bytes"]
    original = headers.groupBy(*key).agg(F.min("page_id").alias("original"), F.count("*").alias("n"))
    original = original.where(F.col("n") > 1).drop("n")
    both = headers.join(original, key, "left")
    revisits = (
        (F.col("payload_bytes") >= least_bytes)
        & F.col("original").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("original"))
    )
    return both.select(
        "page_id",
        *key,
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("original")).alias("refers_to"),
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record(page: dict, payload: bytes, date: str) -> bytes:
    """One WARC/1.1 record as bytes, headers freshly made."""
    response = page["record_type"] == "response"
    block = HTTP_HEAD % len(payload) + (payload if response else b"")
    url = "".join(c for c in page["url"] or "" if c not in "\r\n")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {page['record_type']}",
        f"WARC-Record-ID: {record_id(page['page_id'])}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{page['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {page['payload_bytes']}",
    ]
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if not response:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {record_id(page['refers_to'])}",
            f"X-Refers-To-Page-ID: {page['refers_to']}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, resolved: DataFrame, folder: str, date: str, level: int = 6) -> DataFrame:
    """Write one gzip archive (a member per record) per partition; returns the (file, records) manifest.

    A file gets its name only when complete, and its name is the partition's, so a task that runs
    again after a lost executor replaces the file it may have left.
    """
    # The digest is part of the key: rows that repeat a page_id may carry different payloads.
    decided = resolved.select(
        F.col("page_id").alias("id"), F.col("sha1").alias("digest"), "payload_bytes", "record_type", "refers_to"
    ).distinct()
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    met = keyed["page_id"].eqNullSafe(decided["id"]) & (keyed["sha1"] == decided["digest"])
    rows = keyed.join(decided, met).drop("id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, out, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0
        target = Folder(folder)
        for batch in batches:
            for part in slices(batch, "html"):
                for page in part.to_pylist():
                    payload = page["html"].encode()
                    page["payload_digest"] = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                    if out is None:
                        out, private = target.open_new(name)
                    out.write(gzip.compress(record(page, payload, date), level, mtime=0))
                    n += 1
        if out is not None:
            out.close()
            target.publish(private, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return rows.mapInArrow(run, "file string, records long")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an open archive."""
    with gzip.open(stream, "rb") as data:
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            fields = {}
            while (line := data.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            yield fields, data.read(int(fields["Content-Length"]))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the archives that the manifest names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Folder(folder)
        names = ["page_id", "payload_digest", "payload_bytes", "record_type", "refers_to", "url"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for head, block in parse(source.open_input(file)):
                    rows.append(checked(head, block))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("file").mapInArrow(run, RECORDS)


def checked(head: dict[str, str], block: bytes) -> tuple:
    """A record's columns; a response's payload must have the digest and length its headers state."""
    stated, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
    if head["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest(payload) != stated or len(payload) != size:
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
        size = len(payload)
    number = lambda name: int(head[name]) if name in head else None
    return (number("X-Page-ID"), stated, size, head["WARC-Type"], number("X-Refers-To-Page-ID"), head["WARC-Target-URI"])


def deduplicated_archives(
    pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", partition_mb: int = 64
) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) and return what reading them back gives.

    Null html is an empty payload, null url an empty target, other columns are ignored. Rows that
    repeat a page are written as often as they occur. An empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    resolved = stored(resolve(payload_headers(pages), least_bytes), f"{folder}/headers")
    manifest = stored(write_archives(pages, resolved, f"{folder}/archives", date), f"{folder}/manifest")
    files = max(1, manifest.count())
    return read_archives(manifest.repartition(files), f"{folder}/archives")
