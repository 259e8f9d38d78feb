"""WARC archives in seekable Zstandard bundles.

Each page is one WARC/1.1 record: ``response`` with the page as payload, or ``revisit`` where an equal payload of at least
``least`` bytes is archived under a smaller page_id. Records are grouped into independent Zstandard frames, frames into bundle
files in the shared folder. Behind its frames a bundle has a skippable frame with its record index (record id, frame, offset
inside the frame, length) and, as its footer, the seek table of the seekable format, so a record is read by its id without
decompressing the rest, and ordinary Zstandard tools read a bundle as the plain concatenation of its records.

A task writes bundles under names of its own attempt and reports them; only reported bundles are read, so files of lost
attempts are never seen. Which equal payload comes first is decided on rows without payloads: pages that share none (by a
bitmap of fixed size that is broadcast) are written where they are read, revisits are written from their digests alone, and
only the first page of a shared payload is moved with its html.

Defined results: a null page is an empty payload. A null page_id sorts behind all others, its record carries none. Rows that
share a payload and its smallest page_id are all responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, dropped, marked, new_path, written

#: Parts that the pages of one payload are decided in.
SALTS = 16
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 18, 16 << 20, 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Fixed values of the Zstandard format and its seekable extension.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}"


def build(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, first: int | None, kind: str) -> bytes:
    """One WARC record; a revisit has the HTTP head with the full payload's ``length``, but no payload."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id(page_id, digest)}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(first, digest)}>"), ("X-Refers-To-Page-Id", str(first))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if kind == "response":
        block += payload
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's payload is held against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


class Bundle:
    """Writes records into frames of a stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes, self.codec = out, frame_bytes, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.held, self.held_bytes, self.size = [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.held:
            data = self.codec.compress(b"".join(self.held))
            self.out.write(data)
            self.frames.append((len(data), self.held_bytes))
            self.size += len(data)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        listed = self.codec.compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(listed)) + listed)
        table = b"".join(struct.pack("<II", *x) for x in [*self.frames, (len(listed) + 8, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Random access to a bundle: only the footer, the index and the asked frames are read."""

    def __init__(self, file) -> None:
        self.file, self.codec = file, zstandard.ZstdDecompressor()
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        table = file.read(8 * n)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, raw))
            at += packed
        start, packed, _ = self.frames.pop()
        file.seek(start + 8)
        self.index = [tuple(x) for x in json.loads(self.codec.decompress(file.read(packed - 8)))]
        self.last: tuple[int, bytes] = (-1, b"")

    def at(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            start, packed, raw = self.frames[frame]
            self.file.seek(start)
            self.last = frame, self.codec.decompress(self.file.read(packed), max_output_size=raw)
        return self.last[1][offset : offset + length]

    def get(self, name: str) -> bytes:
        return next(self.at(*x[1:]) for x in self.index if x[0] == name)

    def records(self) -> Iterator[bytes]:
        for _, *place in self.index:
            yield self.at(*place)


def _write(folder: str, frame_bytes: int, bundle_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, base = fs.FileSystem.from_uri(folder)
    bundle = out = None
    name = ""

    def done() -> pa.RecordBatch:
        bundle.close()
        out.close()
        return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(bundle.index)], "bytes": [bundle.size]})

    for batch in batches:
        for page_id, url, html, length, digest, first, kind in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "length", "digest", "first", "kind"))):
            if bundle is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base}/{name}", compression=None)
                bundle = Bundle(out, frame_bytes)
            bundle.add(record_id(page_id, digest), build(page_id, url, html or b"", length, digest, first, kind))
            if bundle.size >= bundle_bytes:
                yield done()
                bundle = None
    if bundle is not None:
        yield done()


def write_archives(pages: DataFrame, least: int = 100, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes ``page_id, url, html`` rows as bundles; returns the written table ``path, records, bytes`` of these."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    html, salt = F.coalesce("html", F.lit("")).cast("binary"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha2(html, 256)).withColumn("length", F.octet_length(html))
    # Digests with several pages, by partial counts, as one payload may have very many pages.
    counted = rows.where(F.col("length") >= least).groupBy("digest", salt.alias("salt")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = counted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1 and first is not null").drop("n")
    firsts = written(firsts, "digests")
    rows = marked(rows, firsts, ["digest"], "shared")
    # Of pages that may share their payload, the rows without it are decided on; revisits are written from these.
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    decided = rows.where("shared").drop("html").withColumn("salt", salt).join(spread, ["digest", "salt"], "left")
    decided = written(decided.withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))), "decided")
    revisits = decided.where("revisit").select("page_id", "url", F.lit(None).cast("binary").alias("html"), "length", "digest", "first", F.lit("revisit").alias("kind"))
    # The others of them are fetched with their payloads; all the rest never move.
    wanted = decided.where("not revisit").select("page_id", "digest").distinct()
    fetched = marked(rows.where("shared"), wanted, ["page_id", "digest"], "wanted").where("wanted").alias("f")
    fetched = fetched.join(wanted.alias("w"), F.col("f.page_id").eqNullSafe(F.col("w.page_id")) & (F.col("f.digest") == F.col("w.digest")), "left_semi")
    response = lambda df: df.select("page_id", "url", F.col("html").cast("binary").alias("html"), "length", "digest", F.lit(None).cast("long").alias("first"), F.lit("response").alias("kind"))
    every = response(rows.where("not shared")).unionByName(response(fetched)).unionByName(revisits)
    bundles = written(arrow_map(every, lambda b: _write(folder, frame_bytes, bundle_bytes, b), "path string, records long, bytes long"), "bundles")
    dropped(spark, firsts, decided)
    return bundles


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["url", "payload"] if payloads else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            with system.open_input_file(place) as file:
                rows: list[dict] = []
                size = 0
                for record in Reader(file).records():
                    rows.append(parse(record))
                    size += len(record)
                    if len(rows) >= 4096 or size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)


def read_archives(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the bundles in ``path``, in any order; payloads (null for revisits) and urls if asked for."""
    n = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = ", url string, payload binary" if payloads else ""
    return arrow_map(bundles.select("path").repartition(n, "path"), lambda b: _read(payloads, b), f"page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long{more}")
