import hashlib
import os
import struct

import zstandard
from pyspark.sql import functions as F

from loglens.llm import warc


def brute(rows):
    first = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and i is not None and i != first[b]
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


ROWS = [(5, "http://a/é", "<p>" + "é" * 60), (3, None, "<p>" + "é" * 60), (9, "http://a\r\nX: 1", "<p>" + "é" * 60), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
        (7, "u", "x" * 400_000), (8, "u", "x" * 400_000), (8, "u", "x" * 400_000), (7, "u", "x" * 400_000), (None, "u", "x" * 400_000), (None, None, None),
        (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100), (14, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20)]


def columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit("x")).repartition(2)
    path, records = warc.archive(pages, str(tmp_path / "a"))
    assert columns(records) == brute(ROWS)
    payloads = {r.page_id: bytes(r.payload) for r in records.collect() if r.payload is not None and r.page_id is not None}
    assert all(payloads[i] == (h or "").encode() for i, _, h in ROWS if i in payloads)
    for options in ({"frame_bytes": 300, "bundle_bytes": 2000},):
        warc.write_bundles(pages, str(tmp_path / "b"), **options)
        assert columns(warc.read_records(spark, str(tmp_path / "b"))) == brute(ROWS)
        assert warc.bundle_files(spark, str(tmp_path / "b")).count() > 4


def test_files_are_seekable_bundles(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html>{i} " + "text " * (i % 90)) for i in range(800)]
    warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "c"), frame_bytes=5000)
    name = next(f for f in os.listdir(tmp_path / "c") if f.startswith("part-"))
    data = (tmp_path / "c" / name).read_bytes()
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 800
    frames, index = warc.read_tables(data)
    assert len(frames) > 10 and sum(f[2] for f in frames) == len(whole) and len(index) == 800
    found = warc.record_index(spark, str(tmp_path / "c"))
    wanted = {str(warc.record_id(i, "")): i for i in (0, 17, 799)}
    got = warc.fetch(spark, str(tmp_path / "c"), found.filter(F.col("record_id").isin(*wanted))).collect()
    assert {wanted[r.record_id]: warc.parse_record(bytes(r.record))[1].decode() for r in got} == {i: rows[i][2] for i in wanted.values()}


def test_empty(spark, tmp_path):
    _, records = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "d"))
    assert records.count() == 0
