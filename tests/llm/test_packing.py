import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from shelfcast.llm.packing import pack, packing_digest, settle, sweep, to_open

from . import hard_cases as H
from .test_repair import ODD, library


def gapless(rows, capacity):
    """Number of sequences, after checking that pieces stand one after another from 0."""
    of = defaultdict(list)
    for r in rows:
        of[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in of.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def lengths_of(kind, n=700):
    rng = random.Random(kind)
    draw = {"mixed": lambda: min(64, int(rng.paretovariate(0.6) * 3)), "equal": lambda: rng.choice([7, 7, 7, 30]),
            "tiny": lambda: rng.randrange(1, 4), "large": lambda: rng.randrange(30, 65)}[kind]
    return [draw() for _ in range(n)]


@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "large"])
def test_rounds_open_about_as_few_as_one_by_one(kind):
    lengths, capacity = lengths_of(kind), 64
    left, gaps, opened = np.bincount([n for n in lengths if n < capacity], minlength=capacity), np.zeros(capacity + 1, np.int64), 0
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        least = longest // 2 + 1 if longest > 8 else 1
        matches = sweep(left, gaps, least)
        settle(left, gaps, matches)
        if not matches:
            n = to_open(left, least, capacity)
            gaps[capacity] += n
            opened += n
        assert (gaps >= 0).all() and (left >= 0).all()
    assert opened + lengths.count(capacity) <= 1.02 * best_fit_decreasing(lengths, capacity) + 1


def test_documents_meet_their_gaps(spark):
    lengths = lengths_of("mixed")
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(5)
    rows = pack(frame, 64).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert gapless(rows, 64) <= 1.02 * best_fit_decreasing(lengths, 64) + 1


def test_whole_tables(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*H.texts(), *ODD, "word " * 1023, "word " * 2047, "word " * 3000])).repartition(4)
    encode, want = library("byte_bpe_50k.json"), []
    for r in frame.collect():
        ids = [*encode(r["text"] or ""), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want.append((str(r["doc_id"]), k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())))
    rows = packing_digest(frame).collect()
    assert sorted((str(r["doc_id"]), *(r[c] for c in ("piece", "start", "length", "ids_crc32"))) for r in rows) == sorted(want)
    gapless(rows, 1024)
    assert packing_digest(frame.limit(0)).count() == 0
