"""WARC archives: written and read back by Spark tasks, one gzip member to a record.

Which of equal payloads is the response is settled on digests alone. Tasks write archives of about ARCHIVE_BYTES into a
folder that driver and executors share, and name them in the rows they return, so that what a failed or repeated
attempt has left behind is never read. The sequential reader decompresses incrementally, frames records by Content-Length and
verifies block and payload digests while it reads; it holds one chunk and one header at a time.

Defined results: null html is the empty payload; a page without page_id is always a response; pages with the same
page_id and payload are of the same type; equal payloads under SHARED_BYTES are all responses; an empty table gives no
archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, new_folder

#: Payloads of so many bytes or more are stored once.
SHARED_BYTES = 1000
#: Compressed size at which an archive ends.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
#: Most bytes of a record's header, or of the HTTP header within it.
MOST_HEADER = 1 << 20
#: Revisits are broadcast to the pages up to this many rows (about 100 bytes each), and joined by a shuffle beyond.
MOST_BROADCAST = 100_000

_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format, or a digest that does not hold."""


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or a revisit (refers_to given) without."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", date), ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if page_id is not None:
        fields.insert(1, ("WARC-Record-ID", f"<{_PAGE}{page_id}>"))
    if url:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_PAGE}{refers_to}>"), ("WARC-Profile", _PROFILE)]
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(header.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + pack.flush()


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, one after another; each as chunks of what it holds, which must be used up before the next."""
    held = stream.read(CHUNK)
    while held:
        unpack = zlib.decompressobj(31)

        def chunks(unpack=unpack) -> Iterator[bytes]:  # noqa: ANN001
            nonlocal held
            while not unpack.eof:
                if not held and not (held := stream.read(CHUNK)):
                    raise WarcError("the archive ends within a record")
                data = unpack.decompress(held, CHUNK)
                held = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if data:
                    yield data

        yield chunks()
        if not held:
            held = stream.read(CHUNK)


def read_record(chunks: Iterator[bytes]) -> dict:
    """Type, ids, lengths and digests of a record; the payload's bytes pass by, verified and not kept."""
    held = b""
    while (end := held.find(b"\r\n\r\n")) < 0:
        more = next(chunks, None)
        if more is None:
            raise WarcError("a record without header")
        held += more
        if len(held) > MOST_HEADER + CHUNK:
            raise WarcError("a record's header does not end")
    lines = held[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    left, held = int(fields["content-length"]), held[end + 4 :]
    block, payload, http, size = hashlib.sha1(), hashlib.sha1(), b"", 0
    in_head, stated = True, 0
    while left:
        if not held and not (held := next(chunks, b"")):
            raise WarcError("the record is shorter than its Content-Length")
        part, held = held[:left], held[left:]
        left -= len(part)
        block.update(part)
        if in_head:
            http += part
            at = http.find(b"\r\n\r\n")
            if at < 0:
                if len(http) > MOST_HEADER + CHUNK:
                    raise WarcError("an HTTP header does not end")
                continue
            in_head, part = False, http[at + 4 :]
            if m := re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", http[:at]):
                stated = int(m[1])
        payload.update(part)
        size += len(part)
    trailer = held + b"".join(chunks)
    if trailer != b"\r\n\r\n":
        raise WarcError("the record is longer than its Content-Length")

    def digest(name: str) -> str:
        return base64.b32decode(fields[name].partition(":")[2]).hex()

    def page(name: str) -> int | None:
        m = re.fullmatch(rf"<{_PAGE}(-?[0-9]+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    kind = fields["warc-type"]
    if block.hexdigest() != digest("warc-block-digest"):
        raise WarcError("the block digest does not hold")
    if kind == "response" and (payload.hexdigest() != digest("warc-payload-digest") or size != stated):
        raise WarcError("the payload digest does not hold")
    return {"page_id": page("warc-record-id"), "payload_bytes": stated, "payload_digest": digest("warc-payload-digest"), "record_type": kind, "refers_to": page("warc-refers-to"), "url": fields.get("warc-target-uri")}


def read_records(stream: BinaryIO) -> Iterator[dict]:
    for chunks in members(stream):
        yield read_record(chunks)


def _open(folder: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload another page holds. pages: page_id, html. Rows are aggregated by digest first, so a payload that very many pages share is one row."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    thin = cut(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")).where((F.col("bytes") >= SHARED_BYTES) & F.col("page_id").isNotNull()))
    shared = cut(thin.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "refers_to"))
    return thin.join(shared, "digest").where(F.col("page_id") < F.col("refers_to")).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of pages (page_id, url, html) in folder: path, records, bytes of each. Written once; the rows name what counts."""
    known = cut(revisits(pages))
    small = known.count() <= MOST_BROADCAST
    rows = pages.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).join(F.broadcast(known) if small else known, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _open(folder)
        number, out, done = 0, None, []

        def close() -> None:
            nonlocal out
            if out:
                out[0].close()
                done.append((out[1], out[2], out[3]))
                out = None

        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[at].as_py() for k in range(4))
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number = [store.open_output_stream(path), path, 0, 0], number + 1
                data = record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to)
                out[0].write(data)
                out[2], out[3] = out[2] + 1, out[3] + len(data)
                if out[3] >= ARCHIVE_BYTES:
                    close()
        close()
        paths, records, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return cut(rows.mapInArrow(run, "path string, records long, bytes long"))


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of archives (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path) as stream:
                    for found in read_records(stream):
                        rows.append(found)
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    partitions = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(partitions, "path").mapInArrow(run, _READ)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages written as archives and read back."""
    folder = new_folder(pages.sparkSession, "warc")
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return read(write(plain, folder), folder).withColumnRenamed("page_id", id_col)
