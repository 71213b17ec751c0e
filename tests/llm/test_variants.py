import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfcast.llm import catalog
from shelfcast.llm import variants as V

from . import hard_cases as H

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_counts(rows, least_points=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_points and c >= least_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_groups(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def plain(rows):
    return plain_groups(plain_counts(rows))


def random_texts(seed=2, n=160):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÿÀx") for _ in range(rng.randrange(4, 11))) for _ in range(40)]
    stems += [s[:i] + rng.choice("abé") + s[i + rng.randrange(2):] for s in stems for i in range(len(s)) if rng.random() < 0.5]
    weights = [1 / (1 + rng.randrange(30)) for _ in stems]
    return [" ".join(rng.choice([w, w.upper(), w.capitalize()]) for w in rng.choices(stems, weights, k=60)) + rng.choice(["", "…日本×÷ŸĀ", "1a2b'c"]) for _ in range(n)]


def same(frame):
    got = V.spelling_groups(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_equals_all_pairs_compared(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*random_texts(), *H.texts(30)])).repartition(3)
    want = same(frame)
    assert len(want) > 100 and sum(w[1] is not None for w in want) > 30 and any(w[1] != w[2] and w[1] for w in want)


def test_long_words_and_chains(spark):
    long = "ab" * 2000
    words = {"chain": 40, "chains": 19, "chainss": 9, "chainsss": 4, "tie" + "aa": 8, "tieab": 8, "tieax": 3, "zzzzz": 3, "zzzz": 50, long: 9, long[:-1] + "c": 3, long + "q": 4}
    frame = H.docs(spark, [" ".join([w] * n) for w, n in words.items()] + [None, "", "×××××" * 2])
    same(frame)


def test_empty_tables(spark):
    assert V.spelling_groups(H.docs(spark, [])).count() == 0
    assert V.spelling_groups(H.docs(spark, [None, "", "a b c", "alone words once"])).count() == 0


@pytest.mark.parametrize("split", [2, 40])
def test_large_slices_are_dealt_anew(spark, split):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 10))) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, rng.randrange(3, 99)) for w in words], "word string, n long")
    sizes = [r["count"] for r in V.slices(vocabulary, split=split).where("b - a > 1").groupBy("bucket").count().collect()]
    assert max(sizes, default=0) <= split
    got = {r["word"]: (r["n_near"], r["best"]) for r in V.near_words(vocabulary, split=split).collect()}
    n = {r["word"]: r["n"] for r in vocabulary.collect()}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    assert got == {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}


def test_one_slice_of_many_words_between_batches(spark, monkeypatch):
    monkeypatch.setattr(V, "BATCH_WORDS", 7)
    monkeypatch.setattr(V, "CELLS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        same(H.docs(spark, random_texts(seed=5, n=60)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_position_index():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abç") for _ in range(rng.randrange(6, 8))) for _ in range(300)})
    letters, sizes = V.letter_codes(pa.array(words), 7)
    index = V.PositionIndex(letters, sizes == 7, np.zeros(len(words), np.int64))
    short = np.flatnonzero(sizes == 6)
    pairs = {(int(q), int(w)) for a, b in ((0, 2), (2, 3), (3, 6)) for qs, ws in index.near(short, np.full(len(short), a), np.full(len(short), b)) for q, w in zip(qs, ws)}
    assert pairs == {(i, j) for i in short.tolist() for j in range(len(words)) if one_apart(words[i], words[j])}


def test_crc_of_joined_parts():
    words = [b"a", b"abc", "éàü".encode(), b"x" * 64, b"y" * 200]
    before = np.array([zlib.crc32(f"{d}:".encode()) for d in range(40)], np.uint32)
    index = np.arange(40) % 5
    assert V.joined_crc(before, words, index).tolist() == [zlib.crc32(f"{d}:".encode() + words[d % 5]) for d in range(40)]


def test_registered():
    assert catalog.QUERIES["op12_spelling_variants"] and "op12_spelling_variants" not in catalog.SQL
