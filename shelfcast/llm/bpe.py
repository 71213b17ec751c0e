"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

The pattern that splits texts is run as a finite automaton. Each code point has a class that already knows
what follows it (a space before something solid, an apostrophe before a contraction's letters), each class is
a function from state to state, and functions are composed: within blocks, over the blocks by doubling,
then once more through the blocks with their true first states. No regular expression is run.
Slices seen before take their ids from a bounded table; new ones are merged together, one merge per slice and
round, by the rank of the pair's joined bytes. Each token's byte offset comes with it.

Null counts as empty; an empty text has no token. Texts are never cut.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .merges import PairMerges
from .pretokens import slices
from .stretches import StretchTable
from .tables import mapped
from .textgrid import byte_array, kept, sliced

RANKS = "byte_bpe_50k.tiktoken"


class Merger(StretchTable):
    """Ids of slices by merging pairs in the order of their ranks."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        known = [(a, b, rank) for whole, rank in self.ranks.items() for k in range(1, len(whole))
                 if (a := self.ranks.get(whole[:k])) is not None and (b := self.ranks.get(whole[k:])) is not None]
        pairs = np.array(known, np.int64)
        self.merges = PairMerges(pairs[:, 0], pairs[:, 1], pairs[:, 2], pairs[:, 2])
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        size = np.zeros(by_rank[-1][1] + 1, np.int64)
        size[[r for _, r in by_rank]] = [len(b) for b, _ in by_rank]
        self.size_of, self.start_of = size, np.cumsum(size) - size
        self.blob = np.frombuffer(b"".join(b for b, _ in by_rank), np.uint8)
        self.names = [str(i) for i in range(len(size))]
        super().__init__()

    def encode_new(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        rest = whole < 0
        raw = [p for p, r in zip(pieces, rest.tolist()) if r]
        ids, sizes = self.merges.merge(self.byte[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(p) for p in raw], np.int64))
        all_sizes = np.ones(len(pieces), np.int64)
        all_sizes[rest] = sizes
        out, of = np.zeros(int(all_sizes.sum()), np.int64), np.repeat(rest, all_sizes)
        out[of], out[~of] = ids, whole[~rest]
        return out, all_sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 offsets of the texts among them."""
        starts, ends = slices(data, offsets)
        ids, upto = self.encode_stretches(data, starts, ends)
        return ids, upto[np.searchsorted(starts, offsets)]

    def byte_offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes begin, and where the last one's end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size_of[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bytes of all ids, put where their offsets say."""
        size = np.diff(at)
        return self.blob[np.repeat(self.start_of[ids] - at[:-1], size) + np.arange(at[-1])]


def merger(path: str | None = None) -> Merger:
    path = path or public_tokenizers.path(RANKS)
    return kept(f"merger {path}", lambda: Merger(path))


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``row`` (all columns), ``ids`` and ``offsets``: the byte at which each token begins in its text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            table = pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), "text")], ["row", "text"])
            for part in sliced([table]):
                ids, bounds = m.encode(*byte_array(part.column("text")))
                at = m.byte_offsets(ids)
                begin = at[:-1] - np.repeat(at[bounds[:-1]], np.diff(bounds))
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (ids.astype(np.int32), begin.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("row"), *lists], ["row", "ids", "offsets"])

    return mapped(docs, work, "ids array<int>, offsets array<int>")


def bpe_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes decoded from the ids)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in sliced(batches):
            ids, bounds = m.encode(*byte_array(b.column("text")))
            at = m.byte_offsets(ids)
            plain, cuts = m.decode(ids, at).tobytes(), at[bounds].tolist()
            names = list(map(m.names.__getitem__, ids.tolist()))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            said = [sha(" ".join(names[lo:hi]).encode()) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(bounds)), pa.array(said, pa.string()),
                                              pa.array([sha(plain[lo:hi]) for lo, hi in zip(cuts, cuts[1:])], pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
