import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from shelfcast.llm import katz
from shelfcast.llm.katz import MOST, discounts, katz_digest, packed, scored, unpacked

from . import hard_cases as H
from .test_quality import words

END, START = "<end>", "<start>"


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        docs = [[*(w.translate({i: i + 32 for i in range(65, 91)}) for w in words(t or "")), END] for t in texts]
        self.one = collections.Counter(w for d in docs for w in d)
        self.two = collections.Counter(p for d in docs for p in zip([START, *d], d))
        self.n, self.contexts = sum(self.one.values()), collections.Counter(p[0] for d in docs for p in zip([START, *d], d))
        of = lambda c: np.array([sum(v == r for v in c.values()) for r in range(MOST + 2)], float)
        self.d1, self.d2 = discounts(of(self.one)), discounts(of(self.two))
        rest = 1 - sum(self.cut(self.d1, c) / self.n for c in self.one.values()) if self.n else 1.0
        self.rest, self.scale = (rest, 1.0) if rest > 1e-9 else (1 / (self.n + 1), 1 - 1 / (self.n + 1))

    def cut(self, d, c):
        return c * (d[c] if c <= MOST else 1.0)

    def p1(self, w):
        return self.cut(self.d1, self.one[w]) / self.n * self.scale if w in self.one else self.rest

    def p2(self, v, w):
        c = self.contexts[v]
        if not c:
            return self.p1(w)
        seen = {b: k for (a, b), k in self.two.items() if a == v}
        kept = sum(self.cut(self.d2, k) for k in seen.values()) / c
        left, scale = (1 - kept, 1.0) if kept <= 1 - 1e-9 else (1 / (c + 1), (1 - 1 / (c + 1)) / kept)
        return self.cut(self.d2, seen[w]) / c * scale if w in seen else left / (1 - sum(map(self.p1, seen))) * self.p1(w)

    def score(self, text):
        d = [*(w.translate({i: i + 32 for i in range(65, 91)}) for w in words(text or "")), END]
        base = sum(math.log10((self.one[w] + 1) / (self.n + len(self.one) + 1)) for w in d)
        return len(d), sum(w in self.one for w in d), self.n, base, sum(math.log10(self.p2(v, w)) for v, w in zip([START, *d], d))


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, got):
    model, want = Plain([t for i, t in rows if not held(i)]), {}
    cache = {}
    for i, t in rows:
        if t not in cache:
            cache[t] = model.score(t)
        want.setdefault(str(i), []).append((held(i), *cache[t]))
    assert sum(map(len, want.values())) == len(got)
    for r in got:
        near = [w for w in want[str(r["doc_id"])] if w[:4] == (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
                and r["base_score"] == pytest.approx(w[4], rel=1e-9, abs=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-9, abs=1e-9)]
        assert near, (r, want[str(r["doc_id"])])
    return model


def sample(n=60):
    return [t if t is None or len(t) < 9000 else t[:9000] for t in H.texts(n)]


def test_equals_plain_model_and_sums_to_one(spark, monkeypatch):
    frame = H.with_odd_rows(spark, H.docs(spark, [*sample(), "The THE the É é", "unknown words only here"])).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    model = check(rows, katz_digest(frame).collect())
    assert model.rest + sum(map(model.p1, model.one)) == pytest.approx(1)
    for v in [START, *list(model.one)[:5]]:
        assert sum(model.p2(v, w) for w in [*model.one, "not there"]) == pytest.approx(1)


def test_spread_contexts_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(katz, "SHARD_TOKENS", 200)
    monkeypatch.setattr(katz, "HOT", 20)
    frame = H.docs(spark, ["hot " * 30 + f"a{i % 9} b{i % 5} hot c{i}" for i in range(40)]).repartition(4)
    check([(r["doc_id"], r["text"]) for r in frame.collect()], katz_digest(frame).collect())


def test_nothing_to_learn_from(spark):
    frame = H.docs(spark, ["a b", None])
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in scored(frame, F.lit(True)).collect())
    assert katz_digest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("of", [[0, 100, 40, 20, 12, 8, 6], [0, 5, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0, 0], [0, 10, 9, 9, 9, 9, 9]])
def test_discounts_are_shares(of):
    d = discounts(np.array(of, float))
    assert len(d) == MOST + 1 and ((d > 0) & (d <= 1)).all()


@pytest.mark.parametrize("limit", [1 << 20, 1 << 50])
def test_keys_of_pairs_are_exact(limit):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, limit, 40, np.uint64)
    first, second = rng.choice(ids, 3000), rng.choice(ids, 3000)
    keys = katz.pair_keys(first, second, limit)
    assert len(set(keys.tolist())) == len(set(zip(first.tolist(), second.tolist()))) == len(set(zip(keys.tolist(), first.tolist(), second.tolist())))
    assert len(katz.pair_keys(first[:0], second[:0], limit)) == 0


def test_ids_beyond_32_bits_give_the_same_model(spark, monkeypatch):
    wide = katz.Plan
    monkeypatch.setattr(katz, "Plan", lambda buckets, bits, unigrams, docs: wide(buckets, bits + 32, unigrams, docs))
    frame = H.docs(spark, sample(20)).repartition(3)
    check([(r["doc_id"], r["text"]) for r in frame.collect()], katz_digest(frame).collect())


def test_packing_of_arrays():
    for x in (np.arange(1000, dtype=np.uint64) ** 3, np.zeros(0, np.uint32), np.array([1.5, -2])):
        assert unpacked(packed(x)).tolist() == x.tolist() and unpacked(packed(x)).dtype == x.dtype
