"""WARC archives with a Zstandard dictionary.

Every archive file opens with a skippable frame that holds a dictionary built from the records of that
same file; each record is a frame of its own, compressed with it. The dictionary learns from records evenly spread
over the file, of each at most the first 128 KiB; all records are written whole. Of records with equal payloads of at
least 100 bytes the one with the smallest page_id is the response, the others revisit it and carry no
payload.

Null html is an empty payload and a null url has no target. A row without a page_id revisits like any
other, but is never revisited: where all of a group have none, all are responses. Rows that repeat the
smallest page_id are all responses. No row gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened, save
from .tables import join_by_group, new_folder, written
from .textgrid import sliced

SKIPPABLE = 0x184D2A5D  # fixed: the magic number of a dictionary frame in .warc.zst files
MIN_REVISIT = 100  # fixed by the contract
DICTIONARY_BYTES, SAMPLE_BYTES, ARCHIVE_BYTES = 112_640, 4 << 20, 32 << 20


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    groups = (rows.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    rows = join_by_group(rows, written(groups, "page-copies"), "payload_digest", "copies", rows.count())
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id", "copies")


def record(row: dict) -> bytes:
    """One WARC record, headers and block."""
    name = lambda x: f"<urn:page:{x}>"
    head = {"WARC-Type": row["record_type"],
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>" if row["page_id"] is None else name(row["page_id"]),
            "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha256:{row['payload_digest']}", "Payload-Length": row["payload_bytes"]}
    if row["page_id"] is not None:
        head["Page-Id"] = row["page_id"]
    if row["url"] is not None:
        head["WARC-Target-URI"] = urllib.parse.quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = b""
    if row["record_type"] == "revisit":
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 "WARC-Refers-To": name(row["refers_to"]), "Refers-To-Page-Id": row["refers_to"]}
    else:
        block = f"{http}Content-Length: {row['payload_bytes']}\r\n\r\n".encode() + row["payload"]
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on records evenly spread over the file; raw records where there are too few to train on."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [r[:131_072] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, sample)) // 8)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> list[bytes]:
    """The parts of an archive file: the dictionary's frame, then a frame for each record."""
    trained = dictionary(records)
    packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
    to = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    return [struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(to.compress, records)]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """(file, records) of each archive written; ``rows`` as with_record_types() returns them."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([save(folder, ".warc.zst", archive(held))]), pa.array([len(held)], pa.int64())], ["file", "records"])
            held.clear()
            return made

        for b in sliced(batches, "payload"):
            for row in b.to_pylist():
                held.append(record(row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return written(rows.mapInArrow(work, "file string, records long"), "archive-files")


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdDecompressor().decompress(stream.read(size))
    kind = zstandard.DICT_TYPE_FULLDICT if known[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known, dict_type=kind))
                              .stream_reader(stream, read_across_frames=True))
    while line := plain.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := plain.readline().decode()) != "\r\n":
            key, _, value = line.partition(": ")
            head[key] = value.rstrip("\r\n")
        block = plain.read(int(head["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError("record without end")
        yield head, block


def read_archives(files: DataFrame, folder: str, id_kind: str) -> DataFrame:
    """One row per record, with its payload (null for revisits)."""
    number = id_kind in ("tinyint", "smallint", "int", "bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        id_type = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}.get(id_kind, pa.string())
        kinds = [id_type, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), id_type]
        to_id = lambda x: x if x is None or not number else int(x)
        for b in batches:
            for file in b.column(0).to_pylist():
                out, size = [], 0
                with fs.open_input_stream(f"{path}/{file}") as stream:
                    for head, block in records_of(stream):
                        payload = None
                        if head["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            digest = hashlib.sha256(payload).hexdigest()
                            if f"sha256:{digest}" != head["WARC-Payload-Digest"]:
                                raise ValueError(f"damaged payload in {file}")
                        url = head.get("WARC-Target-URI")
                        out.append((to_id(head.get("Page-Id")), url and urllib.parse.unquote(url), payload, int(head["Payload-Length"]),
                                    head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], to_id(head.get("Refers-To-Page-Id"))))
                        size += len(block)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                            out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(
        work, f"page_id {id_kind}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_kind}")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_folder(pages.sparkSession, "warc")
    files = write_archives(with_record_types(pages), folder)
    out = read_archives(files, folder, pages.schema["page_id"].dataType.simpleString())
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
