"""WARC archives: one gzip member per record, revisit records for payloads that are stored elsewhere.

Writers stream records to files in the shared folder; the sequential reader inflates one member at a
time with zlib, frames blocks by Content-Length and verifies block and payload digests as it goes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lessonlake.llm._shared import filesystem, materialize, qualified, shared_path

_CHUNK = 1 << 16
#: A writer starts another file beyond this size, so that readers find work of bounded size.
FILE_BYTES = 256 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, payload_digest: str, refers_to: int | None = None) -> bytes:
    """One record as a gzip member. With ``refers_to`` it is a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _id(page_id), "WARC-Date": "2024-01-01T00:00:00Z"}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if refers_to is not None:
        head |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": _id(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + deflate.flush()


@dataclass
class WarcRecord:
    headers: dict[str, str]
    http: bytes
    payload: bytes | None
    payload_bytes: int
    payload_digest: str

    @property
    def type(self) -> str:
        return self.headers["WARC-Type"]

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["WARC-Record-ID"])

    @property
    def refers_to(self) -> int | None:
        return _page(self.headers["WARC-Refers-To"]) if "WARC-Refers-To" in self.headers else None


class _Member:
    """The inflated bytes of one gzip member, read on demand."""

    def __init__(self, stream: BinaryIO, ahead: bytes) -> None:
        self.stream, self.inflate, self.ahead, self.ready = stream, zlib.decompressobj(31), ahead, b""

    def more(self) -> bool:
        while not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self.ahead or self.stream.read(_CHUNK)
            self.ahead = b""
            if not data:
                raise ValueError("the archive ends inside a gzip member")
            if got := self.inflate.decompress(data, _CHUNK):
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self.more():
                raise ValueError("a record ends inside its header")
        found, _, self.ready = self.ready.partition(mark)
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            part, self.ready = self.ready[:n], self.ready[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.ready


def read_records(stream: BinaryIO, keep_payload: bool = True) -> Iterator[WarcRecord]:
    """All records of an archive in order; a digest or frame that doesn't hold raises ValueError."""
    ahead = stream.read(_CHUNK)
    while ahead:
        member = _Member(stream, ahead)
        lines = member.until(b"\r\n\r\n").decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size, block, payload, http, kept, n = int(headers["Content-Length"]), hashlib.sha1(), hashlib.sha1(), b"", [], 0
        inside = False
        for part in member.take(size):
            block.update(part)
            if not inside:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                at = http.index(b"\r\n\r\n") + 4
                http, part, inside = http[:at], http[at:], True
            payload.update(part)
            n += len(part)
            if keep_payload:
                kept.append(part)
        if member.rest() != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        if headers["WARC-Block-Digest"] != "sha1:" + base64.b32encode(block.digest()).decode():
            raise ValueError(f"block digest of {headers['WARC-Record-ID']} does not hold")
        told = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "revisit":  # its HTTP header tells the length of the payload it refers to
            n = int(re.search(rb"Content-Length: (\d+)", http)[1])
        elif told != base64.b32encode(payload.digest()).decode():
            raise ValueError(f"payload digest of {headers['WARC-Record-ID']} does not hold")
        yield WarcRecord(headers, http, b"".join(kept) if keep_payload else None, n, told)
        ahead = member.inflate.unused_data or stream.read(_CHUNK)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        path, out, size, n, done = "", None, 0, 0, []
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    # a name of its own: the file of an attempt that failed is never listed
                    path, size, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                data = record(row["page_id"], row["url"], payload, row["bytes"], base64.b32encode(bytes.fromhex(row["sha1"])).decode(), row["refers_to"])
                out.write(data)
                size, n = size + len(data), n + 1
                if size > FILE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) under ``folder``; returns (path, records) of each archive.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is the
    response and the others revisit it. Equal payloads are found by digest and length; those that
    occur twice or more are written before the join, so that it can split a hot one, or send the list
    to the pages where Spark knows it to be small. The payload of a revisit is not written.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = keyed.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})
    kept = keyed.groupBy("sha1", "bytes").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = keyed.join(materialize(kept, "repeated-payloads"), ["sha1", "bytes"], "left")
    revisit = (F.col("bytes") >= least_bytes) & F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    plan = joined.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "sha1", "bytes", F.when(revisit, F.col("keep")).alias("refers_to"))
    return materialize(plan.mapInArrow(_writer(qualified(pages.sparkSession, folder)), "path string, records long"), "warc-files")


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for path in b.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None, buffer_size=0) as stream:
                    for r in read_records(stream, keep_payload=False):
                        rows.append((r.page_id, r.payload_bytes, r.payload_digest, r.type, r.refers_to))
                        if len(rows) >= 5000:
                            yield batch()
                            rows.clear()
        if rows:
            yield batch()

    return read


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row for every record of the archives in ``files`` (column path), read one file after another in each task."""
    spread = files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInArrow(_reader(qualified(files.sparkSession, folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back.

    Null and empty html have the empty payload, which is subject to the same rule as any other;
    repeated rows of the kept page_id are all responses, of other page_ids all revisits; rows without
    a page_id revisit the kept page, and are responses where no page of that payload has an id;
    payloads of any length are streamed; other columns are ignored; an empty table gives no rows.
    """
    folder = shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, least_bytes), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (
  SELECT *, strlen(html)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS keep,
         translate(list_aggregate(list_transform(range(8), lambda i: to_base(('0x' || substr(h, (i * 5 + 1)::INTEGER, 5))::BIGINT, 32, 4)), 'string_agg', ''),
                   '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
"""
