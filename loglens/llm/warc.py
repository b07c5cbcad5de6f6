"""WARC records in seekable Zstandard bundles.

A bundle is one file: records grouped into independent Zstandard frames, then a skippable
frame with the record index (record id, frame, offset in the frame's content, length),
then a skippable frame with the seek table of the Zstandard seekable format (compressed and
decompressed size of every frame, number of frames, descriptor, magic number at the very end).
Any Zstandard tool unpacks the file; a reader goes from the end to the seek table, to the
index, and unpacks only the frames it needs.

Records that repeat a payload of LEAST_REVISIT bytes or more are revisit records that
refer to the record of the smallest page id with that payload. A grouped minimum over the
digests finds those, pre-aggregated in each task; only digests that repeat are joined back.

Files are written and read by Spark (any file system it knows): a bundle is one row of a
text file whose line end is the four bytes of the magic number, one row a file.

Edge cases: null html is an empty payload, a null url has no target header, control
characters in urls are percent-encoded; a null page id is never referred to and its record is
a response; rows that repeat a page id and its payload are all responses; payloads longer
than a frame or a bundle get one of their own; other columns are not touched.
"""
from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

LEAST_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the Zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x184D2A5E, 0x184D2A51
SEEKABLE_MAGIC = bytes.fromhex("b1ea928f")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "<16sIQQ"


def record_id(page_id: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_OID, f"page:{page_id}" if page_id is not None else f"payload:{digest}")


def make_record(page_id, url, payload: bytes | None, n_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; ``payload`` None for a revisit of ``refers_to``."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    block = b""
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class Bundle:
    """Frames and index of one bundle file."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int]] = []
        self.index: list[bytes] = []
        self.open, self.size, self.total = [], 0, 0

    def add(self, rid: uuid.UUID, record: bytes) -> None:
        if self.open and self.size + len(record) > self.frame_bytes:
            self.close_frame()
        self.index.append(struct.pack(_INDEX, rid.bytes, len(self.frames), self.size, len(record)))
        self.open.append(record)
        self.size += len(record)
        self.total += len(record)

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.pack.compress(b"".join(self.open)))
            self.seek.append((len(self.frames[-1]), self.size))
            self.open, self.size = [], 0

    def content(self) -> bytes:
        """The file without the magic number at its end."""
        self.close_frame()
        index = b"".join(self.index)
        self.frames.append(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        self.seek.append((len(self.frames[-1]), 0))
        table = b"".join(struct.pack("<II", *s) for s in self.seek)
        tail = struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IB", len(self.seek), 0)
        return b"".join(self.frames) + tail


def read_tables(content: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[uuid.UUID, int, int, int]]]:
    """Frames (offset, compressed, decompressed size) and index (record id, frame, offset, length) of a bundle."""
    if content[-4:] != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    n, _ = struct.unpack_from("<IB", content, len(content) - 9)
    start = len(content) - 9 - 8 * n
    if struct.unpack_from("<II", content, start - 8) != (SKIPPABLE_SEEK, 8 * n + 9):
        raise ValueError("damaged seek table")
    frames, at = [], 0
    for packed, size in struct.iter_unpack("<II", content[start:start + 8 * n]):
        frames.append((at, packed, size))
        at += packed
    at, packed, _ = frames.pop()
    if struct.unpack_from("<I", content, at)[0] != SKIPPABLE_INDEX:
        raise ValueError("no record index before the seek table")
    return frames, [(uuid.UUID(bytes=r), *rest) for r, *rest in struct.iter_unpack(_INDEX, content[at + 8:at + packed])]


def unpack_frame(content: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, size = frame
    return zstandard.ZstdDecompressor().decompress(content[at:at + packed], max_output_size=size)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = block[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# ------------------------------------------------------------------ Spark
def with_first_copies(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, url, html, digest, n_bytes, refers_to) of ``pages``; refers_to is null for responses."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html").cast("long"))
    first = p.filter(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    later = F.when((F.col("n_bytes") >= least) & (F.col("page_id") != F.col("first")), F.col("first"))
    return p.join(first.drop("n"), "digest", "left").select("page_id", "url", "html", "digest", "n_bytes", later.alias("refers_to"))


def _bundles(frame_bytes: int, bundle_bytes: int):
    schema = pa.schema([("content", pa.binary())])

    def run(batches):
        bundle = Bundle(frame_bytes)
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, html, digest, n_bytes, refers_to = (batch.column(c)[r].as_py() for c in range(6))
                payload = html.encode() if refers_to is None else None
                record = make_record(page_id, url, payload, n_bytes, digest, refers_to)
                if bundle.total and bundle.total + len(record) > bundle_bytes:
                    yield pa.RecordBatch.from_pydict({"content": [bundle.content()]}, schema=schema)
                    bundle = Bundle(frame_bytes)
                bundle.add(record_id(page_id, digest), record)
        if bundle.total:
            yield pa.RecordBatch.from_pydict({"content": [bundle.content()]}, schema=schema)

    return run


def write_bundles(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write one record a row of ``pages`` (page_id, url, html) to bundle files below ``path``."""
    rows = with_first_copies(pages).mapInArrow(_bundles(frame_bytes, bundle_bytes), "content binary")
    rows.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1) \
        .option("encoding", "ISO-8859-1").option("lineSep", SEEKABLE_MAGIC.decode("latin-1")).text(path)


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the bundles: page_id, url, record_type, payload (null for revisits), payload_bytes,
    payload_digest (of the payload itself; for revisits as recorded), refers_to."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    number = lambda f, k: int(f[k]) if k in f else None

    def run(batches):
        for batch in batches:
            for content in batch.column(1):
                content = content.as_py()
                frames, index = read_tables(content)
                by_frame: dict[int, list] = {}
                for _, frame, at, n in index:
                    by_frame.setdefault(frame, []).append((at, n))
                for frame, places in by_frame.items():
                    data, rows = unpack_frame(content, frames[frame]), {k: [] for k in schema.names}
                    for at, n in places:
                        f, payload = parse_record(data[at:at + n])
                        kept = f["warc-type"] == "response"
                        for k, v in zip(schema.names, (number(f, "x-page-id"), f.get("warc-target-uri"), f["warc-type"], payload if kept else None,
                                                       len(payload) if kept else number(f, "x-payload-length"),
                                                       hashlib.sha256(payload).hexdigest() if kept else f["warc-payload-digest"].removeprefix("sha256:"),
                                                       number(f, "x-refers-to-page-id"))):
                            rows[k].append(v)
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return bundle_files(spark, path).mapInArrow(run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def record_index(spark: SparkSession, path: str) -> DataFrame:
    """Where each record is: record_id, path, frame, frame_offset (in the file), offset (in the frame's content), length."""
    schema = pa.schema([("record_id", pa.string()), ("path", pa.string()), ("frame", pa.int64()), ("frame_offset", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for name, content in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                frames, index = read_tables(content)
                yield pa.RecordBatch.from_pydict({
                    "record_id": [str(r[0]) for r in index], "path": [name] * len(index), "frame": [r[1] for r in index],
                    "frame_offset": [frames[r[1]][0] for r in index], "offset": [r[2] for r in index], "length": [r[3] for r in index]}, schema=schema)

    return bundle_files(spark, path).mapInArrow(run, "record_id string, path string, frame long, frame_offset long, offset long, length long")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records (record_id, record bytes) at the places in ``wanted`` (rows of the index); only their frames are unpacked."""
    places = wanted.groupBy("path").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("places"))
    schema = pa.schema([("record_id", pa.string()), ("record", pa.binary())])

    def run(batches):
        for batch in batches:
            for content, places in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
                frames, _ = read_tables(content)
                order = sorted(places, key=lambda p: p["frame"])
                for frame in np.unique([p["frame"] for p in order]).tolist():
                    data = unpack_frame(content, frames[frame])
                    some = [p for p in order if p["frame"] == frame]
                    yield pa.RecordBatch.from_pydict({"record_id": [p["record_id"] for p in some], "record": [data[p["offset"]:p["offset"] + p["length"]] for p in some]}, schema=schema)

    return bundle_files(spark, path).join(places, "path").select("content", "places").mapInArrow(run, "record_id string, record binary")


def archive(pages: DataFrame, path: str | None = None) -> tuple[str, DataFrame]:
    """Write ``pages`` to bundles (in the shared folder unless ``path`` is given) and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_bundles(pages, path)
    return path, read_records(spark, path)
