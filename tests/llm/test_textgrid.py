import tracemalloc

import numpy as np
import pytest
from shelfcast.llm import textgrid
from shelfcast.llm.jaccard import shingle_sets
from shelfcast.llm.textgrid import BASE, byte_values, mixed, slice_hashes, word_bounds


def plain(data, start, end):
    values = byte_values()
    total = sum(int(values[b]) * pow(BASE, k, 1 << 64) for k, b in enumerate(data[start:end].tolist()))
    return int(mixed(np.array([(total + (end - start) * 0x9FB21C651E98DF25) % (1 << 64)], np.uint64))[0])


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 21])
def test_hashes_do_not_depend_on_blocks(monkeypatch, block):
    """Slices inside a block, over an edge, over many blocks, next to each other, empty, and at both ends of the data."""
    monkeypatch.setattr(textgrid, "BLOCK_BYTES", block)
    data = np.random.default_rng(4).integers(0, 256, 700).astype(np.uint8)
    cuts = np.array([0, 3, 3, 63, 64, 65, 70, 400, 448, 448, 512, 699, 700])
    got = slice_hashes(data, cuts[:-1], cuts[1:])
    assert got.tolist() == [plain(data, a, z) for a, z in zip(cuts.tolist(), cuts[1:].tolist())]
    gaps = slice_hashes(data, np.array([5, 130, 640]), np.array([129, 131, 641]))
    assert gaps.tolist() == [plain(data, 5, 129), plain(data, 130, 131), plain(data, 640, 641)]


def test_sets_of_long_texts_equal_those_of_one_block(monkeypatch):
    data = np.frombuffer("".join(f"word{i % 977} É{i % 31}\n" for i in range(4000)).encode(), np.uint8)
    offsets = np.array([0, 9, 9, len(data) // 2, len(data)])
    want = [x.tolist() for x in shingle_sets(data, offsets)]
    monkeypatch.setattr(textgrid, "BLOCK_BYTES", 100)
    assert [x.tolist() for x in shingle_sets(data, offsets)] == want


def test_memory_of_a_long_text_is_bounded():
    """One text of 32 MB: less than 12 bytes of arrays a byte (with whole-length powers over 30)."""
    data = np.tile(np.frombuffer(b"seven words that make up a line ", np.uint8), 1 << 20)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    tracemalloc.start()
    assert len(np.unique(slice_hashes(data, starts, ends))) == 7
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(data)
