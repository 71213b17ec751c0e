import hashlib
import io
import struct

import zstandard
from shelfcast.llm.warc import SKIPPABLE, archive, archive_round_trip, read_archives, record, records_of, with_record_types, write_archives
from shelfcast.llm.tables import new_folder

KIND = "page_id long, url string, html string, record_type string, payload string"


def pages(spark):
    long = "<p>" + "ä" * 80 + "</p>"
    html = [long, long, "short", "short", None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, "z" * 500_000, "a\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(i, None if i == 3 else f"http://h/{i}?q=ä b\r\n", t, "t", "p") for i, t in enumerate(html)]
    rows += [(i, "u", f"<html>page {i} " + "body " * (i % 50) + "</html>", None, None) for i in range(100, 400)]
    return spark.createDataFrame([*rows, (8, "again", "y" * 100, None, None), (None, None, long, None, None), (None, None, "q" * 200, None, None), (None, None, "q" * 200, None, None)], KIND)


def brute(rows):
    groups = {}
    for page_id, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        for i in ids:
            again = len(html.encode()) >= 100 and len(ids) > 1 and first is not None and i != first
            out.append((i, len(html.encode()), hashlib.sha256(html.encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    frame = pages(spark).repartition(3)
    got = archive_round_trip(frame)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r["page_id"], r["html"]) for r in frame.collect()])
    assert archive_round_trip(frame.limit(0)).count() == 0


def test_urls_and_payloads_come_back(spark):
    frame = pages(spark)
    folder = new_folder(spark, "warc-test")
    out = read_archives(write_archives(with_record_types(frame), folder), folder, "bigint").where("record_type = 'response' and page_id is not null").collect()
    want = {r["page_id"]: r for r in frame.orderBy("page_id").collect() if r["url"] != "again"}
    for r in out:
        if r["url"] != "again":
            assert r["payload"].decode() == (want[r["page_id"]]["html"] or "") and r["url"] == want[r["page_id"]]["url"]


def test_each_record_is_a_frame_after_the_dictionary():
    row = {"page_id": 1, "url": "u", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest(), "payload": b"abc"}
    records = [record(row | {"page_id": i}) for i in range(200)]
    parts = archive(records)
    magic, size = struct.unpack("<II", parts[0])
    assert magic == SKIPPABLE and size == len(parts[1]) and len(parts) == 202
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(parts[1]))
    assert [zstandard.ZstdDecompressor(dict_data=known).decompress(p) for p in parts[2:]] == records
    assert sum(map(len, parts[2:])) < 0.3 * sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)
    assert [h["Page-Id"] for h, _ in records_of(io.BytesIO(b"".join(parts)))] == [str(i) for i in range(200)]
