"""Token ids in files compressed by Re-Pair grammars, with random access.

Documents are put in doc_id order (range partitions, sorted), encoded, closed by the end id and cut into shards.
Per shard, frequent pairs of neighbouring ids are replaced by nonterminals, again and again: each round
counts all pairs, takes the ``PER_ROUND`` most frequent ones in order of their counts (ties in order of a hash) where they
don't overlap, and leaves those that fewer than ``MIN_COUNT`` places are left for to later rounds; it ends when no pair has as many. No pair starts with the end id, so
documents begin at symbols. A file holds the rules, each one's expansion length, the symbols and a marker of the
expanded position every ``STEP`` symbols; any stretch of ids is decoded from the nearest marker on.

Null and empty texts have the end id alone. Rows without doc_id come first; rows with equal doc_id follow
each other in the order of their text's hash.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import opened, save
from .tables import new_folder, written
from .textgrid import byte_array, sliced
from .vocab import with_end, word_bpe

END = 2  # fixed by the contract
MAGIC = b"RePair01"
SHARD_IDS, PER_ROUND, MIN_COUNT, STEP = 1 << 20, 2048, 12, 1024
CELL_BITS = 20


def every_other(at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether a place is the second, fourth, ... in a run of neighbouring places of one kind, which overlap."""
    out = np.zeros(len(at), bool)
    same = np.flatnonzero((kind[1:] == kind[:-1]) & (at[1:] == at[:-1] + 1)) + 1
    if len(same):
        first = np.append(True, np.diff(same) > 1)
        out[same] = (same - same[first][np.cumsum(first) - 1]) & 1 == 0
    return out


def chosen(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places (ascending) whose pair goes before both overlapping ones; in a run of equal ids every other place."""
    key = rank * 2 + every_other(at, rank)
    before = np.append(True, (at[1:] != at[:-1] + 1) | (key[1:] < key[:-1]))
    after = np.append((at[1:] != at[:-1] + 1) | (key[:-1] < key[1:]), True)
    return (before & after)[:len(at)]


def scattered(pair: np.ndarray) -> np.ndarray:
    """A hash that puts pairs of one count in an order that has nothing to do with their places."""
    h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)


def often(symbols: np.ndarray) -> np.ndarray:
    """Places whose pair can be frequent: as many share its cell of a table, whatever the pair."""
    if len(symbols) < 2:
        return np.zeros(0, np.int64)
    cell = (symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - CELL_BITS)
    return np.flatnonzero((np.bincount(cell, minlength=1 << CELL_BITS) >= MIN_COUNT)[cell])


def compress(ids: np.ndarray, base: int, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules: symbol base + r stands for the pair rules[r]. Ends when no pair has ``MIN_COUNT`` places apart.

    After a round with few places only those beside a new symbol and those of pairs that were frequent before can matter.
    """
    symbols, rules = ids.astype(np.uint32), np.zeros((0, 2), np.int64)
    at = often(symbols)
    while True:
        at = at[symbols[at] != end]
        code, seen = pd.factorize((symbols[at].astype(np.int64) << 32) | symbols[at + 1])
        counts = np.bincount(code[~every_other(at, code)], minlength=len(seen))
        top = np.flatnonzero(counts >= MIN_COUNT)
        if not len(top):
            return symbols.astype(np.int64), rules
        frequent = counts[code] >= MIN_COUNT
        at, code = at[frequent], code[frequent]
        top = top[np.lexsort((scattered(seen[top]), -counts[top]))][:PER_ROUND]
        ranks = np.full(len(seen), -1, np.int64)
        ranks[top] = np.arange(len(top))
        rank = ranks[code]
        go, rank = at[rank >= 0], rank[rank >= 0]
        free = chosen(go, rank)
        go, rank = go[free], rank[free]
        held = np.bincount(rank, minlength=len(top)) >= MIN_COUNT  # the first pair always is
        go, rank = go[held[rank]], rank[held[rank]]
        symbols[go] = (np.cumsum(held) - 1 + base + len(rules))[rank]
        gone = go + 1
        symbols = np.delete(symbols, gone)
        new = seen[top[held]]
        rules = np.concatenate([rules, np.column_stack([new >> 32, new & 0xFFFFFFFF])])
        if 32 * len(go) > len(symbols):  # both ways find every place of a pair that is frequent now
            at = often(symbols)
            continue
        left = np.searchsorted(gone, at, "right")
        still = at - left
        here = go - np.arange(len(go))
        at = np.unique(np.concatenate([still[(left == 0) | (gone[left - 1] != at)], here, here - 1]))
        at = at[(at >= 0) & (at < len(symbols) - 1)]


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule stands for."""
    out = np.ones(base + len(rules), np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        out[base + r] = out[a] + out[b]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for: the rules used are spelled out level by level, then every symbol copies its stretch."""
    used = np.unique(symbols)
    table = used
    owner = np.arange(len(used))
    while len(table) and table.max() >= base:
        big = table >= base
        at = np.cumsum(1 + big) - 1 - big
        pair = rules[table[big] - base]
        spelled = np.repeat(table, 1 + big)
        spelled[at[big]], spelled[at[big] + 1] = pair[:, 0], pair[:, 1]
        table, owner = spelled, np.repeat(owner, 1 + big)
    size = np.bincount(owner, minlength=len(used))
    place = np.searchsorted(used, symbols)
    n = size[place]
    start = (np.cumsum(size) - size)[place] - (np.cumsum(n) - n)
    return table.astype(np.uint32)[np.repeat(start, n) + np.arange(int(n.sum()))]


def shard_file(ids: np.ndarray, bounds: np.ndarray, doc_ids: pa.Array, base: int) -> list[bytes]:
    """The parts of a shard's file: magic, header, then each array zstd-compressed."""
    symbols, rules = compress(ids, base)
    size = lengths(rules, base)
    position = np.cumsum(size[symbols]) - size[symbols]
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": doc_ids, "start": bounds[:-1]})
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    arrays = {"rules": rules.astype("<u4").tobytes(), "lengths": size[base:].astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
              "markers": position[::STEP].astype("<u8").tobytes(), "documents": sink.getvalue().to_pybytes()}
    packed = {k: zstandard.ZstdCompressor(level=3).compress(v) for k, v in arrays.items()}
    head = json.dumps({"ids": len(ids), "base": base, "step": STEP, "parts": {k: len(v) for k, v in packed.items()}}).encode()
    return [MAGIC, struct.pack("<I", len(head)), head, *packed.values()]


class Shard:
    """A shard's file as read back."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a shard")
        (size,) = struct.unpack("<I", raw[8:12])
        head, at, parts = json.loads(raw[12:12 + size]), 12 + size, {}
        for name, n in head["parts"].items():
            parts[name] = zstandard.ZstdDecompressor().decompress(raw[at:at + n])
            at += n
        self.n_ids, self.base, self.step = head["ids"], head["base"], head["step"]
        self.rules = np.frombuffer(parts["rules"], "<u4").astype(np.int64).reshape(-1, 2)
        self.lengths = np.append(np.ones(self.base, np.int64), np.frombuffer(parts["lengths"], "<u4"))
        self.symbols, self.markers = np.frombuffer(parts["symbols"], "<u4").astype(np.int64), np.frombuffer(parts["markers"], "<u8").astype(np.int64)
        self.documents = pa.ipc.open_stream(parts["documents"]).read_all()

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.base)

    def stretch(self, lo: int, hi: int) -> np.ndarray:
        """ids()[lo:hi], from the symbols between the markers around it."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first = int(np.searchsorted(self.markers, lo, "right")) - 1
        last = int(np.searchsorted(self.markers, hi, "left"))
        own = self.symbols[first * self.step:last * self.step]
        begin = self.markers[first] + np.cumsum(self.lengths[own]) - self.lengths[own]
        use = (begin < hi) & (begin + self.lengths[own] > lo)
        skip = lo - int(begin[use][0])
        return expand(own[use], self.rules, self.base)[skip:skip + hi - lo]


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> DataFrame:
    """(file, partition, number, n_ids) of each shard, in doc_id order by partition and number."""
    ordered = (docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).withColumn("h", F.xxhash64("text"))
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, part, number = word_bpe(path), TaskContext.get().partitionId(), 0
        base = vocabulary.library.get_vocab_size()
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, n = np.concatenate([h[0] for h in held]), np.cumsum([0, *(len(h[0]) for h in held)])
            bounds = np.concatenate([[0], *(h[1][1:] + n[i] for i, h in enumerate(held))])
            file = save(folder, ".ids", shard_file(ids, bounds, pa.concat_arrays([h[2] for h in held]), base))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64())],
                                              ["file", "partition", "number", "n_ids"])

        for b in sliced(batches):
            ids, bounds = with_end(*vocabulary.encode(*byte_array(b.column("text"))), end)
            held.append((ids, bounds, b.column("doc_id")))
            size += len(ids)
            if size >= SHARD_IDS:
                yield flush()
                number, size = number + 1, 0
        if held:
            yield flush()

    return written(ordered.mapInArrow(work, "file string, partition int, number int, n_ids long"), "id-shards")


def read_shards(shards: DataFrame, folder: str, id_kind: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("partition", "number").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("start", F.coalesce(before, F.lit(0))).select("file", "start")  # one row per shard meets in this window

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{path}/{file}") as stream:
                    shard = Shard(stream.read())
                ids, first = shard.ids().astype("<u4"), shard.documents["start"].to_numpy()
                last = np.append(first[1:], len(ids))
                crc = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([shard.documents["doc_id"].combine_chunks(), pa.array(first + start), pa.array(last - first), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(max(1, shards.count())).mapInArrow(work, f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long")


def shard_round_trip(docs: DataFrame) -> DataFrame:
    folder = new_folder(docs.sparkSession, "id-files")
    return read_shards(write_shards(docs, folder), folder, docs.schema["doc_id"].dataType.simpleString())
