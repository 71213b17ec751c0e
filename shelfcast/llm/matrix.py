"""A sparse document-term matrix in CSR shards over one dictionary of all words.

Words are the runs of bytes outside [\\x20\\x09-\\x0D], told apart exactly. Documents are cut into shards of about
SHARD_BYTES of text. A shard first numbers its own words, in order of a hash. It sends each of its words once to the bucket that the hash's
range names; a bucket numbers its different words and answers every shard that asked. A word's number is its
bucket's in the high 32 bits and its place there in the low ones. Then the shard's CSR file is written: row starts, word numbers in
ascending order within a row, and counts. A shard's files lie in the shared folder under its name; only shards that Spark
committed are read. Shards and buckets grow with the text; their messages are never more than the shards' words.

Null texts count as empty; they are rows without entries. A text longer than a shard is a shard of its own. No row gives no shard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import opened
from .tables import new_folder, written
from .textgrid import byte_array, slice_hashes

SHARD_BYTES, SHARD_ROWS = 8 << 20, 1 << 16
BUCKET_WORDS, LEAST_BUCKETS = 1 << 19, 16


def squeezed(x: np.ndarray) -> bytes:
    """An array with its type, its bytes regrouped by significance and compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return x.dtype.str.encode().ljust(8) + zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:8].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def put(folder: str, name: str, parts: list[bytes]) -> None:
    """A file of these parts."""
    fs, path = opened(folder)
    with fs.open_output_stream(f"{path}/{name}") as out:
        out.write(struct.pack(f"<{len(parts) + 1}Q", len(parts), *map(len, parts)))
        for x in parts:
            out.write(x)


def get(folder: str, name: str) -> list[bytes]:
    fs, path = opened(folder)
    with fs.open_input_stream(f"{path}/{name}") as stream:
        raw = stream.read()
    n = struct.unpack("<Q", raw[:8])[0]
    cuts = np.cumsum([8 * (n + 1), *struct.unpack(f"<{n}Q", raw[8:8 * (n + 1)])]).tolist()
    return [raw[a:z] for a, z in zip(cuts, cuts[1:])]


def csr_of(folder: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, word numbers and counts of a shard."""
    return tuple(map(unsqueezed, get(folder, f"{name}.csr")))


def as_bytes(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write(table)
    return sink.getvalue().to_pybytes()


def from_bytes(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of these texts; row starts, indexes into the words, and counts of each text's different words."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    sizes, flat = np.diff(split.offsets.to_numpy()), split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty pieces
    row = np.repeat(np.arange(len(texts)), sizes)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    key = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    key, counts = np.unique(key, return_counts=True)
    rows, index = np.divmod(key, max(len(coded.dictionary), 1))
    return coded.dictionary, np.searchsorted(rows, np.arange(len(texts) + 1)), index, counts


def split(joined: pa.Array) -> pa.Array:
    return pc.ascii_split_whitespace(joined)


def joined_at(cuts: list[int], words: pa.Array) -> pa.Array:
    """The words between neighbouring cuts as one text each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words), pa.scalar(" ", pa.large_string()))


def hashes(words: pa.Array) -> np.ndarray:
    data, offsets = byte_array(words)
    return slice_hashes(data, offsets[:-1], offsets[1:])


def sharded(docs: DataFrame, folder: str, kept: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Cut into shards: (shard, n_rows, n_words). ``kept`` says what else is stored per row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            words, starts, index, counts = counted(pa.concat_arrays([b.column("text") for b in held]))
            stored = pa.Table.from_batches([kept(b) for b in held])
            held.clear()
            order = np.argsort(hashes(words))
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            joined = joined_at([0, len(words)], words.take(pa.array(order)))[0].as_py()
            name = uuid.uuid4().hex
            fs, path = opened(folder)
            fs.create_dir(path, recursive=True)
            put(folder, f"{name}.words", [zstandard.ZstdCompressor(level=1).compress(joined.encode())])
            put(folder, f"{name}.local", [squeezed(starts.astype(np.int64)), squeezed(place[index]), squeezed(counts.astype(np.uint32))])
            put(folder, f"{name}.rows", [as_bytes(stored)])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([stored.num_rows], pa.int64()), pa.array([len(words)], pa.int64())], ["shard", "n_rows", "n_words"])

        for b in batches:
            ends, lo = byte_array(b.column("text"))[1], 0
            while lo < b.num_rows:
                hi = int(np.searchsorted(ends, ends[lo] + SHARD_BYTES - size, "right")) - 1
                hi = min(max(hi, lo if held else lo + 1), b.num_rows, lo + SHARD_ROWS - rows)
                if hi > lo:
                    held.append(b.slice(lo, hi - lo))
                    size, rows = size + int(ends[hi] - ends[lo]), rows + hi - lo
                if hi < b.num_rows:
                    yield flush()
                    size = rows = 0
                lo = hi
        if held:
            yield flush()

    return written(docs.mapInArrow(work, "shard string, n_rows long, n_words long"), "matrix-shards")


def numbered(shards: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Per bucket and shard the answer (``ids``), and per bucket its part of the dictionary (shard null: ``words`` joined by spaces)."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                joined = zstandard.ZstdDecompressor().decompress(get(folder, f"{name}.words")[0])
                if not joined:
                    continue
                words = split(pa.array([joined.decode()], pa.large_string())).flatten()
                bucket = ((hashes(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                parts = joined_at([*at.tolist(), len(words)], words)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array([name] * len(at)), parts.cast(pa.string())], ["bucket", "shard", "words"])

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        lists = split(pa.concat_arrays(t["words"].cast(pa.large_string()).chunks))
        coded = lists.flatten().dictionary_encode()
        ids, cuts = coded.indices.to_numpy().astype(np.uint32), lists.offsets.to_numpy().tolist()
        whole = joined_at([0, len(coded.dictionary)], coded.dictionary)
        n = t.num_rows
        return pa.table({"bucket": pa.array([key[0].as_py()] * (n + 1), pa.int32()), "shard": pa.array([*t["shard"].to_pylist(), None], pa.string()),
                         "ids": pa.array([*(squeezed(ids[a:z]) for a, z in zip(cuts, cuts[1:])), None], pa.binary()),
                         "words": pa.array([None] * n + [whole[0].as_py()], pa.string())})

    asked = shards.select("shard").mapInArrow(ask, "bucket int, shard string, words string")
    return written(asked.groupBy("bucket").applyInArrow(answer, "bucket int, shard string, ids binary, words string"), "matrix-dictionary")


def dictionary(answers: DataFrame) -> DataFrame:
    """(word, id) of every word."""
    listed = answers.where("shard is null").select("bucket", F.posexplode(F.split("words", " ")).alias("at", "word"))
    return listed.select("word", (F.shiftleft(F.col("bucket").cast("long"), 32) + F.col("at")).alias("id"))


def term_matrix(docs: DataFrame, kept: Callable[[pa.RecordBatch], pa.RecordBatch]) -> tuple[DataFrame, DataFrame, str]:
    """The CSR shards (shard, n_rows, nnz), the dictionary (word, id), and the folder with the shards' files."""
    folder = new_folder(docs.sparkSession, "matrix")
    shards = sharded(docs, folder, kept)
    facts = shards.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).first()
    n = max(1, facts["n"])
    answers = numbered(shards.repartition(n), folder, max(LEAST_BUCKETS, (facts["words"] or 0) // BUCKET_WORDS))
    # a shard without words hears no number: one row each says that it is there
    told = answers.where("shard is not null").select("shard", "bucket", "ids")
    told = told.unionByName(shards.select("shard", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("ids")))
    rows = told.repartition(n, "shard").sortWithinPartitions("shard", "bucket")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, []

        def close() -> pa.RecordBatch:
            starts, index, counts = map(unsqueezed, get(folder, f"{name}.local"))
            column = np.concatenate([np.zeros(0, np.uint64), *ids])[index]
            order = np.lexsort((column, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            put(folder, f"{name}.csr", [squeezed(starts), squeezed(column[order]), squeezed(counts[order])])
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(starts) - 1], pa.int64()), pa.array([len(column)], pa.int64())], ["shard", "n_rows", "nnz"])

        for b in batches:
            for shard, bucket, own in zip(*(b.column(c).to_pylist() for c in ("shard", "bucket", "ids"))):
                if shard != name:
                    if name is not None:
                        yield close()
                    name, ids = shard, []
                if own is not None:
                    ids.append((np.uint64(bucket) << np.uint64(32)) + unsqueezed(own))
        if name is not None:
            yield close()

    return written(rows.mapInArrow(build, "shard string, n_rows long, nnz long"), "matrix-csr"), dictionary(answers), folder


def row_statistics(matrix: DataFrame, folder: str, schema: str) -> DataFrame:
    """Per document what was kept with it (``schema``), its words (the sum of its row) and its different words (the row's entries)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                starts, _, counts = csr_of(folder, name)
                sums = np.zeros(len(counts) + 1, np.int64)
                np.cumsum(counts, out=sums[1:])
                rows = from_bytes(get(folder, f"{name}.rows")[0])
                rows = rows.append_column("n_words", pa.array(np.diff(sums[starts]))).append_column("n_distinct", pa.array(np.diff(starts)))
                yield from rows.combine_chunks().to_batches(max_chunksize=1 << 13)

    return matrix.select("shard").mapInArrow(work, f"{schema}, n_words long, n_distinct long")
