"""WARC archives: a writer that dedupes payloads, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range of a file, looks for
gzip magic in it, validates a candidate by decoding its first bytes as a WARC header, and owns the
records that start inside its range, reading past the end to finish the last of them. Payloads
that are UTF-8 text can't hold the magic bytes, whatever the compression does with them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerloom.llm.common import fresh_path, keep, table

#: Payloads of at least so many bytes are written once.
LEAST_PAYLOAD = 100
#: Bytes of a reading task's range, and of an archive before the next one is begun.
SPLIT_BYTES = 8 << 20
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 20
# Fixed values.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers if v is not None)
    raw = VERSION + b"\r\n" + head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The response or, if refers_to is given, the revisit record of a page."""
    uri = None if url is None else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        return member(headers, HTTP_HEAD + payload)
    first = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{refers_to}:{digest}")
    return member([*headers, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{first}>"), ("X-Refers-To-Page", refers_to)], HTTP_HEAD)


def parse(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if it is none."""
    if not raw.startswith(b"WARC/1."):
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return headers, rest[: int(headers.get("content-length", "0"))]


class RangeReader:
    """Records of a file that start in [start, end)."""

    def __init__(self, handle, start: int, end: int):
        self.handle, self.end = handle, end
        self.size = handle.size()
        self.at = start  # file offset of self.held[0]
        self.held = b""

    def more(self) -> bool:
        self.handle.seek(self.at + len(self.held))
        got = self.handle.read(READ_BYTES)
        self.held += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.held, self.at = self.held[n:], self.at + n

    def candidate(self) -> bool:
        """Move to the next gzip magic that starts inside the range."""
        while self.at < self.end:
            k = self.held.find(MAGIC)
            if k >= 0:
                self.drop(k)
                return self.at < self.end
            self.drop(max(0, len(self.held) - len(MAGIC) + 1))
            if not self.more():
                return False
        return False

    def member(self) -> bytes | None:
        """The whole member here, leaving the position after it; None if it isn't a WARC record."""
        unpack = zlib.decompressobj(31)
        out, used = [], 0
        begun = False
        try:
            while True:
                out.append(unpack.decompress(self.held[used:]))
                used = len(self.held)
                if not begun and sum(map(len, out)) >= 7:
                    if not b"".join(out).startswith(b"WARC/1."):
                        return None
                    begun = True
                if unpack.eof:
                    self.drop(len(self.held) - len(unpack.unused_data))
                    return b"".join(out) if begun else None
                if not self.more():
                    return None
        except zlib.error:
            return None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while self.candidate():
            raw = self.member()
            found = parse(raw) if raw is not None else None
            if found:
                yield found
            elif raw is None:
                self.drop(1)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def marked_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and, for rows that revisit another, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = rows.filter(F.octet_length("html") >= LEAST_PAYLOAD)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = keep(firsts, "firsts")  # a written table, so that a payload which many pages have can be split where it is joined
    return rows.join(firsts, "digest", "left").select("page_id", "url", "html", "digest", F.expr("CASE WHEN page_id <=> first THEN NULL ELSE first END").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of `pages` (page_id, url, html) and return the manifest: path, size, records.

    Of rows with equal payloads of at least LEAST_PAYLOAD bytes the one with the smallest page_id is
    a response and the others revisit it; repeated rows of that page_id are all responses, and so
    are rows whose payload has no page_id at all. Null html is an empty payload; a null url or
    page_id leaves its header out. A task writes files of its own under names that no other
    attempt uses, and only the files of attempts that ended well are in the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        made, out, name, size, records = [], None, "", 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                        made.append((name, size, records))
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size = out.write(info)
                size += out.write(page_member(page_id, url, html.encode(), digest, refers_to))
                records += 1
        if out is not None:
            out.close()
            made.append((name, size, records))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m[0]}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], names=["path", "size", "records"])

    return keep(marked_pages(pages).mapInArrow(run, "path string, size long, records long"), "manifest")


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Response and revisit records of the archives in a manifest (path, size), in splits of split_bytes.

    payload_bytes and payload_digest are computed from what was read for responses, and taken from
    the headers for revisits, whose payload is elsewhere.
    """
    total = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    starts = F.expr(f"sequence(0L, size - 1, {split_bytes}L)")
    splits = manifest.filter("size > 0").select("path", F.explode(starts).alias("start"))
    splits = splits.repartition(max(1, min(100_000, math.ceil(total))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = opened(path)
                rows = []
                with store.open_input_file(name) as handle:
                    for headers, block in RangeReader(handle, start, start + split_bytes):
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        number = lambda k: int(headers[k]) if k in headers else None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        else:
                            n, digest = number("x-payload-length"), headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        rows.append((number("x-page-id"), n, digest, kind, number("x-refers-to-page")))
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return splits.mapInArrow(run, READ_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return read_archives(write_archives(pages, fresh_path(spark, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NULL OR f.first IS NOT DISTINCT FROM p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
