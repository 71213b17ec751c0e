"""Texts of a record batch as one byte array: word boundaries and hashes without a Python loop per word.

Words are runs of bytes outside space and 0x09-0x0D. A word's identity is a 64-bit hash of its bytes
(a polynomial over a random byte table, mixed with its length), so two given different words are
taken for one with probability 2**-59 or less.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 21  # hashed at once; a longer text goes block after block, with the same hashes
BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 modulo 8: its powers differ late


def kept(name: str, build: Callable[[], Any]) -> Any:
    """What a Python worker builds once and all its tasks share."""
    own = sys.modules.setdefault("_shelfcast_llm_kept", types.ModuleType("_shelfcast_llm_kept")).__dict__
    if name not in own:
        own[name] = build()
    return own[name]


def byte_array(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    offsets = offsets.astype(np.int64)
    raw = col.buffers()[2]
    data = np.zeros(0, np.uint8) if raw is None else np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of ``column``, and one row at least."""
    for b in batches:
        if b.num_rows == 0:
            continue
        offsets, lo = byte_array(b.column(column))[1], 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            hi = min(hi, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return table


def letter_table() -> np.ndarray:
    """Letters, digits and every byte beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return table


def word_bounds(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of words before it (n + 1 values).

    ``solid`` flags the bytes that words consist of; all but white space unless given.
    """
    solid = ~kept("spaces", space_table)[data] if solid is None else solid
    first, after = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    after[:-1] &= ~solid[1:]
    at = offsets[(offsets > 0) & (offsets < len(data))]  # a text's edge ends a word as a space does
    first[at] = solid[at]
    after[at - 1] = solid[at - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(after) + 1, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def build(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def both(size: int) -> tuple[np.ndarray, np.ndarray]:
        return build(BASE, size), build(pow(BASE, -1, 1 << 64), size)

    size = 1 << max(20, int(n - 2).bit_length())
    return kept(f"powers {size}", lambda: both(size)) if size <= 1 << 21 else both(size)


def byte_values() -> np.ndarray:
    return np.random.default_rng(20_240_817).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The value of each data[start:end] as a polynomial in BASE; starts and ends ascend.

    Arrays of eight bytes a byte are as long as a block: longer data goes block after block, and a slice
    that lies in several adds up its parts.
    """
    if len(data) <= BLOCK_BYTES:
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(kept("byte values", byte_values)[data] * up[:len(data)], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, len(data), BLOCK_BYTES):
        hi = min(lo + BLOCK_BYTES, len(data))
        a, z = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(starts, hi, "left"))
        part = polynomials(data[lo:hi], np.maximum(starts[a:z], lo) - lo, np.minimum(ends[a:z], hi) - lo)
        for i in range(int(np.searchsorted(starts[a:z], lo, "left"))):  # begun in an earlier block
            part[i:i + 1] *= np.uint64(pow(BASE, int(lo - starts[a + i]), 1 << 64))
        out[a:z] += part
    return out


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; starts and ends ascend."""
    return mixed(polynomials(data, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k neighbours of h, in order; windows over a text's edge are for the caller to leave out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + h[i:len(h) - k + 1 + i]
    return mixed(out)


def within(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-windows that stay inside a text, and the text of each."""
    size = np.maximum(np.diff(bounds) - k + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    return bounds[text] + np.arange(len(text)) - first[text], text
