"""WARC archives: a monolithic gzip stream made random-access.

Capture writes a WARC record for each page into archives that are one gzip stream each. The normaliser
inflates such a stream once, front to back, and rewrites every record as a gzip member of its own, with a
sidecar index of (offset, length) by record beside it; equal payloads become revisit records on the way.
Reading goes through the index: each member is inflated on its own.

Scale: page texts are not shuffled. Archives are files of bounded size in the shared folder, written under a
temporary name and renamed, so a lost or repeated task leaves one whole file. Only digests are shuffled to
find equal payloads: a partial minimum for each digest, then one list of revisits for each archive.
Files are opened through pyarrow's file systems by URI, on the executors.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads shorter than this are never revisits.
LEAST_BYTES = 100
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: Fixed value: the date that capture and rewriting put into records, so that repeated tasks write equal files.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _header(text: str | None) -> str:
    """A value that stays on its line."""
    return "".join(c if c not in "\r\n" else " " for c in text or "")


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{number}')}>"


class Records:
    """Cut an inflated stream, given bit by bit, into records (headers, body)."""

    def __init__(self) -> None:
        self.rest = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.rest += data
        at = 0
        while (end := self.rest.find(b"\r\n\r\n", at)) >= 0:
            lines = self.rest[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            size = int(headers.pop("Content-Length"))
            if len(self.rest) < end + 4 + size + 4:
                break
            yield headers, bytes(self.rest[end + 4 : end + 4 + size])
            at = end + 4 + size + 4
        del self.rest[:at]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _store(path: str, data: bytes | list[bytes]) -> None:
    """Write under another name, then rename: readers see whole files."""
    system, name = _open(path)
    mine = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(mine) as f:
        for x in [data] if isinstance(data, bytes) else data:
            f.write(x)
    system.move(mine, name)


def _capture(folder: str, most: int = ARCHIVE_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = _open(folder)
        system.create_dir(name, recursive=True)
        task, seq = TaskContext.get().partitionId(), 0
        packer, parts, size, rows = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0, []

        def close() -> pa.RecordBatch:
            parts.append(packer.flush())
            _store(f"{folder}/{archive}.warc.gz", parts)
            got = pa.RecordBatch.from_arrays([pa.array([archive] * len(rows)), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["archive", "number", "page_id", "bytes", "digest"])
            return got

        archive = f"capture-{task:08d}-{seq:05d}"
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = html or b""
                digest = hashlib.sha256(body).hexdigest()
                h = {"WARC-Type": "response", "WARC-Record-ID": record_id(archive, len(rows)), "WARC-Date": DATE, "WARC-Target-URI": _header(url), "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": "" if page is None else str(page), "Content-Type": "text/html; charset=utf-8"}
                parts.append(packer.compress(record(h, body)))
                rows.append((page, len(body), digest))
                size += len(body) + 500
                if size >= most:
                    yield close()
                    packer, parts, size, rows, seq = zlib.compressobj(1, zlib.DEFLATED, 31), [], 0, [], seq + 1
                    archive = f"capture-{task:08d}-{seq:05d}"
        if rows:
            yield close()

    return run


def normalised(stream: Iterator[bytes], revisits: dict[int, tuple[int | None, str]] | None = None) -> Iterator[tuple[bytes, dict[str, str]]]:
    """The records of a gzip stream, inflated once, each as a member of its own with its headers.

    revisits: by record number, the page and record id that a revisit refers to; its payload is left out.
    """
    inflate, records, number = zlib.decompressobj(31), Records(), 0
    for data in stream:
        while data:
            plain = inflate.decompress(data)
            for h, body in records.feed(plain):
                if revisits and number in revisits:
                    page, of = revisits[number]
                    h = h | {"WARC-Type": "revisit", "WARC-Refers-To": of, "WARC-Profile": PROFILE, "X-Refers-To-Page": "" if page is None else str(page), "X-Payload-Bytes": str(len(body))}
                    body = b""
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                yield pack.compress(record(h, body)) + pack.flush(), h
                number += 1
            data = inflate.unused_data
            if inflate.eof and data:
                inflate = zlib.decompressobj(31)
    if not inflate.eof or records.rest:
        raise ValueError("the stream ends within a record")


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _open(f"{folder}/{row['archive']}.warc.gz")
                plan = {x["number"]: (x["page"], record_id(x["of_archive"], x["of_number"])) for x in row["revisits"] or []}
                path = f"{folder}/{row['archive']}.members.warc.gz"
                out_system, out_name = _open(path)
                mine, offset, index = f"{out_name}.{uuid.uuid4().hex}.part", 0, []
                with system.open_input_stream(name, compression=None) as f, out_system.open_output_stream(mine, compression=None) as out:
                    for member, h in normalised(iter(lambda: f.read(READ_BYTES), b""), plan):
                        out.write(member)
                        index.append({"offset": offset, "length": len(member), "id": h["WARC-Record-ID"], "type": h["WARC-Type"], "uri": h["WARC-Target-URI"], "digest": h["WARC-Payload-Digest"]})
                        offset += len(member)
                out_system.move(mine, out_name)
                _store(f"{folder}/{row['archive']}.index.jsonl", "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([row["archive"]]), pa.array([len(index)], pa.int64())], ["archive", "records"])

    return run


def _discard(folder: str):
    """Remove the monolithic streams once all are rewritten; done again it does nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, name = _open(f"{folder}/{archive}.warc.gz")
                if system.get_file_info(name).type == fs.FileType.File:
                    system.delete_file(name)
            yield batch

    return run


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, name = _open(f"{folder}/{archive}.index.jsonl")
                with system.open_input_stream(name) as f:
                    index = [json.loads(x) for x in f.read().split(b"\n") if x]
                system, name = _open(f"{folder}/{archive}.members.warc.gz")
                with system.open_input_file(name) as f:
                    for at in range(0, len(index), 500):
                        rows = []
                        for x in index[at : at + 500]:
                            member = f.read_at(x["length"], x["offset"])
                            h, body = next(iter(Records().feed(zlib.decompress(member, 31))))
                            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                            again = h["WARC-Type"] == "revisit"
                            if not again and hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"{archive}: a payload differs from its digest")
                            rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, int(h["X-Payload-Bytes"]) if again else len(body), digest, h["WARC-Type"], int(h["X-Refers-To-Page"]) if again and h["X-Refers-To-Page"] else None, archive, x["offset"], h["WARC-Target-URI"], body if payloads and not again else None))
                        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "uri", "payload"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Capture pages (page_id, url, html) into archives in folder and normalise them; returns (archive, records).

    A null html is an empty payload. Of equal payloads of `least` bytes or more the one with the smallest
    page_id is the response (of rows that repeat it, the first written; a null page_id comes after all others),
    the others are revisits of it; one of a response without a page_id refers to null.
    """
    C.ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    held = C.written(rows.mapInArrow(_capture(folder, archive_bytes), "archive string, number long, page_id long, bytes long, digest string"), "captured")
    big = held.where(F.col("bytes") >= least)
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "number")
    heads = big.groupBy("digest").agg(F.min(place).alias("h"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("h.page_id").alias("page"), F.col("h.archive").alias("of_archive"), F.col("h.number").alias("of_number"))
    later = big.join(heads, "digest").where("archive != of_archive or number != of_number")
    plan = later.groupBy("archive").agg(F.collect_list(F.struct("number", "page", "of_archive", "of_number")).alias("revisits"))
    archives = held.select("archive").distinct()
    # an archive with its plan a row; the rows are dealt out evenly, as each is one long task
    work = archives.join(plan, "archive", "left").repartition(max(12, pages.sparkSession.sparkContext.defaultParallelism), "archive")
    done = C.written(work.mapInArrow(_normalise(folder), "archive string, records long"), "normalised")
    C.dropped(C.written(done.mapInArrow(_discard(folder), done.schema), "discarded"))
    return done


def read_archives(spark: SparkSession, folder: str, archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record through the sidecar indexes: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset, uri, payload."""
    C.ship(spark)
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, uri string, payload binary"
    return archives.select("archive").repartition(max(12, spark.sparkContext.defaultParallelism), "archive").mapInArrow(_read(folder, payloads), kind)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: one row per page, whatever repeats or is null; none for an empty table."""
    spark = pages.sparkSession
    folder = f"{C.shared_dir(spark)}/parchment/warc-{uuid.uuid4().hex}"
    archives = write_archives(pages, folder)
    return read_archives(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
