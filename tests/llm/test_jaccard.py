import random

import numpy as np
import pytest
from shelfcast.llm import jaccard
from shelfcast.llm.components import components
from shelfcast.llm.jaccard import Join, children, distinct_by_similarity, join_digest, signatures

from . import hard_cases as H
from .test_quality import words


def near_copies(seed=0, groups=8, most=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = [rng.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] + shared
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            out.append(" ".join(own))
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(shingles(text or ""), []).append(doc_id)
    keys = list(sets)
    linked = {i: [j for j, y in enumerate(keys) if i != j and len(x & y) >= 0.8 * len(x | y) and x & y] for i, x in enumerate(keys)}
    group = list(range(len(keys)))
    for _ in keys:
        for i in linked:
            group[i] = min([group[i], *(group[j] for j in linked[i])])
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    class_ids = {g: least([d for i, k in enumerate(keys) if group[i] == g for d in sets[k]]) for g in set(group)}
    return sorted(((d, class_ids[group[i]], least(sets[k]), len(linked[i])) for i, k in enumerate(keys) for d in sets[k]), key=str)


def got(frame, with_=Join()):
    return sorted(map(tuple, join_digest(frame, with_).select("doc_id", "class_id", "copy_of", "n_links").collect()), key=str)


TIGHT = Join(small=4, depth=3, block=6, exact_block=5)


@pytest.mark.parametrize("with_", [Join(), TIGHT])
def test_links_and_classes_equal_brute_force(spark, with_):
    frame = H.docs(spark, near_copies()).repartition(5)
    want = brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert max(r[3] for r in want) > 5
    assert got(frame, with_) == want


def test_a_large_cluster_moves_each_set_once(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for i in range(260):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    moved, real = [], jaccard.by_block

    def counting(rows, group, payload):
        moved.append((payload, rows.count(), rows.agg({"blocks": "max"}).first()[0]))
        return real(rows, group, payload)

    monkeypatch.setattr(jaccard, "by_block", counting)
    frame = H.docs(spark, texts).repartition(3)
    with_ = Join(block=32, exact_block=16)
    assert got(frame, with_) == brute(list(enumerate(texts)))
    (_, n_leaf_rows, leaf_blocks), (_, n_sets, set_blocks) = moved
    assert n_sets == 260 and set_blocks == 17 and leaf_blocks > 4 and n_leaf_rows <= 260 * 2 * with_.roots()


def test_columns_of_any_name_stay(spark):
    frame = H.docs(spark, near_copies(5, 4, 8)).selectExpr("doc_id", "text", "1 AS _row_key", "2 AS again", "3 AS row_key", "4 AS `row`", "5 AS `class`")
    out = distinct_by_similarity(frame)
    assert out.schema.names == frame.schema.names and set(tuple(r)[2:] for r in out.collect()) == {(1, 2, 3, 4, 5)}
    assert out.count() == len({w[1] for w in brute([(r["doc_id"], r["text"]) for r in frame.collect()])})


def test_hard_rows(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*H.texts(), *near_copies(3, 3, 6), "a b c", "a  b\nc", "a b c d", "one"]))
    assert got(frame) == brute([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert join_digest(frame.limit(0)).count() == 0


def test_one_of_each_class_stays(spark):
    frame = H.with_odd_rows(spark, H.docs(spark, [*near_copies(5, 4, 8), "x y z", "x y z", None, ""]))
    out = distinct_by_similarity(frame)
    assert out.schema.names == frame.schema.names
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted({str(w[1]) for w in brute([(r["doc_id"], r["text"]) for r in frame.collect()])})


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, int(x)) for x in rng.integers(101, 160, 80)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert {found[int(x)] for _, x in edges[40:120]} == {100} and found[301] == 300 and 200 not in found


def test_recall_of_pairs_just_above_the_limit():
    """20,000 lone pairs of similarity 0.80 to 0.82, each to share a leaf of the roots and pass the signatures' filter."""
    rng, n, with_ = np.random.default_rng(4), 20_000, Join()
    assert with_.expected(with_.roots()) >= with_.recall and with_.roots() == 7
    both, only = 820, 94  # 820 of 1008 shingles: 0.813
    found = np.zeros(n, bool)
    for lo in range(0, n, 1000):
        h = rng.integers(0, 1 << 63, (1000, both + 2 * only), np.uint64)
        bounds = np.arange(1001) * (both + only)
        a, b = signatures(h[:, :both + only].ravel(), bounds), signatures(np.hstack([h[:, :both], h[:, both + only:]]).ravel(), bounds)
        nodes = np.zeros((1000, 0), bool)
        for root in range(with_.roots()):
            nodes = np.hstack([nodes, alike(a, b, root, with_.depth)[:, None]])
        found[lo:lo + 1000] = nodes.any(1) & ((a == b).sum(1) >= with_.need())
    assert (~found).sum() <= 2
    # a lone pair at 0.8, the expectation by the drawn number of agreeing minima
    assert Join().expected(5) < 0.99998


def alike(a, b, root, depth):
    """Pairs that share a path of ``depth`` nodes below a root."""
    at = np.full(len(a), root + 1, np.uint64)
    live, pair = np.ones(len(a), bool), np.arange(len(a))
    for _ in range(depth):
        x, y = children(at, a[pair]), children(at, b[pair])
        same = x == y
        pair, at = np.concatenate([pair[same[:, 0]], pair[same[:, 1]]]), np.concatenate([x[same[:, 0], 0], x[same[:, 1], 1]])
    live[:] = False
    live[pair] = True
    return live
