import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from shelfcast.llm.repair import MIN_COUNT, Shard, compress, expand, shard_file, shard_round_trip
from shelfcast.llm.textgrid import byte_array
from shelfcast.llm.vocab import byte_bpe, word_bpe
from tokenizers import Tokenizer

from . import hard_cases as H

ODD = ["  two  spaces ", "a\n\nb\n c\t d", "x 　y z", "can't 'll  'S ''s", "é ́x", "İI  ", "tab\tb  c\n", "😀 😀\n😀",
       "A\r\nB \r\n", " \n \n", "<|endoftext|> <|startoftext|>", "a\x1cb c\x85d", "1 23\n456", "  x", "ﬁ ǅ Ω"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name, vocabulary", [("byte_bpe_50k.json", byte_bpe), ("word_bpe_49k.json", word_bpe)])
def test_cached_ids_equal_the_library(name, vocabulary):
    latin = "".join(map(chr, [*range(32, 127), *range(0xA0, 0x180)]))
    texts = [*ODD, *H.texts(), *(a + b for a in ODD for b in ODD), latin, *(f"a{c}'S {c}{c}1{c}2 x" for c in latin), "x" * 300 + "Y" * 300, "ab" * 200 + " '" + "=" * 400]
    ids, bounds = vocabulary().encode(*byte_array(pa.array(texts)))
    encode = library(name)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == encode(t or ""), repr(t)


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(3, 40, rng.integers(1, 6)) for _ in range(30)]
    ids = np.concatenate([*(words[rng.integers(30)] for _ in range(3000)), [7] * 101, [2]]).astype(np.uint32)
    symbols, rules = compress(ids, 50)
    assert len(symbols) < 0.6 * len(ids) and (expand(symbols, rules, 50) == ids).all()
    assert not (rules[:, 0] == 2).any()
    shard = Shard(b"".join(shard_file(ids, np.array([0, len(ids)]), pa.array([1]), 50)))
    assert (shard.ids() == ids).all()
    for lo, hi in [(0, 1), (5, 5), (len(ids) - 1, len(ids)), (0, len(ids)), *np.sort(rng.integers(0, len(ids), (40, 2)), 1).tolist()]:
        assert (shard.stretch(lo, hi) == ids[lo:hi]).all()


def test_ends_when_no_pair_is_left():
    rng = np.random.default_rng(5)
    copies = np.tile(np.r_[rng.integers(3, 40_000, 2000), 2], 500).astype(np.uint32)
    symbols, rules = compress(copies, 50_000)
    assert len(symbols) + len(rules) < 3000 and (expand(symbols, rules, 50_000) == copies).all()
    run = np.full(1 << 20, 7, np.uint32)
    symbols, rules = compress(run, 50)
    assert len(symbols) + len(rules) < 50 and (expand(symbols, rules, 50) == run).all()
    for seed in range(6):
        ids = np.random.default_rng(seed).integers(3, 6, 4000).astype(np.uint32)
        symbols, rules = compress(ids, 50)
        places = {}
        for i, pair in enumerate(zip(symbols[:-1].tolist(), symbols[1:].tolist())):
            at = places.setdefault(pair, [])
            if not at or at[-1] < i - 1:
                at.append(i)
        assert max(map(len, places.values())) < MIN_COUNT and (expand(symbols, rules, 50) == ids).all()


def test_few_ids():
    for ids in ([], [2], [5, 5, 5]):
        assert expand(*compress(np.array(ids, np.uint32), 50), 50).tolist() == ids


def test_whole_tables(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*H.texts(), *ODD])).repartition(4)
    encode, at, want = library("word_bpe_49k.json"), 0, []
    for r in sorted(frame.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        ids = [*encode(r["text"] or ""), 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in shard_round_trip(frame).orderBy("start").collect()]
    assert got == want
    assert shard_round_trip(frame.limit(0)).count() == 0
