"""The booster against a plain loop over rows, and what must not change its trees."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import booster as B
from shelfcast.operators.booster import BoosterParams, fit_booster, fit_boosters

PLAIN = BoosterParams(rounds=3, max_depth=3, min_rows=5, subsample=1.0, colsample=1.0, learning_rate=0.3)


def made(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, g = rng.choice([None, *range(8)]), rng.choice("abcdef")
        base = {"a": 2.0, "c": 9.0, "e": 9.0, "b": 2.0, "d": 2.0, "f": 5.0}[g] + (3.0 if x is None else 0.7 * x)
        rows.append((i, None if x is None else float(x), rng.random() * 4 // 1 / 2, g, round(base * rng.uniform(0.5, 1.5), 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, x double, z double, g string, y double")


def plain_fit(rows, p):
    """One-by-one growth over Python rows, with float sums. Inputs: x, z (numbers), g (levels)."""
    inputs = [[r[c] for r in rows] for c in (1, 2, 3)]
    y = [r[4] for r in rows]
    score = [math.log(sum(y) / len(y))] * len(y)
    edges = [sorted({v for v in col if v is not None}) for col in inputs[:2]]
    edges = [[(a + b) / 2 for a, b in zip(e, e[1:])] for e in edges]

    def sums(ids, g, h):
        return sum(g[i] for i in ids), sum(h[i] for i in ids), len(ids)

    def options(ids, g, h):
        for f in (0, 1):
            for e in edges[f]:
                for missing in (False, True):
                    if missing and not any(inputs[f][i] is None for i in ids):
                        continue
                    yield {i for i in ids if (missing if inputs[f][i] is None else inputs[f][i] <= e)}
            yield {i for i in ids if inputs[f][i] is None}
        levels = sorted({inputs[2][i] for i in ids}, key=lambda v: (lambda s: s[0] / s[1])(sums([i for i in ids if inputs[2][i] == v], g, h)))
        for n in range(1, len(levels)):
            yield {i for i in ids if inputs[2][i] in levels[:n]}

    def best(ids, g, h):
        whole, found = sums(ids, g, h), None
        for left in options(ids, g, h):
            right = [i for i in ids if i not in left]
            if len(left) < p.min_rows or len(right) < p.min_rows:
                continue
            a, b = sums(left, g, h), sums(right, g, h)
            gain = a[0] ** 2 / a[1] + b[0] ** 2 / b[1] - whole[0] ** 2 / whole[1]
            if gain > (found[0] if found else 1e-9 * whole[1]):
                found = (gain, sorted(left), right)
        return found

    shapes = []
    for _ in range(p.rounds):
        g, h = zip(*(tuple(float(v) for v in B.tweedie_step(np.float64(a), np.float64(s), p.variance_power)) for a, s in zip(y, score)))
        leaves = [(0, list(range(len(y))))]
        while len(leaves) < (p.leaves or 2 ** p.max_depth):
            open_ = [(best(ids, g, h), d, ids) for d, ids in leaves if d < p.max_depth]
            open_ = [o for o in open_ if o[0]]
            if not open_:
                break
            top, d, ids = max(open_, key=lambda o: o[0][0])
            leaves = [q for q in leaves if q[1] != ids] + [(d + 1, top[1]), (d + 1, top[2])]
        for _, ids in leaves:
            a = sums(ids, g, h)
            for i in ids:
                score[i] -= p.learning_rate * a[0] / a[1]
        shapes.append(sorted(sorted(ids) for _, ids in leaves))
    return [math.exp(s) for s in score], shapes


@pytest.mark.parametrize("leaves", [None, 4, 6])
def test_equals_a_plain_loop(spark, leaves):
    p = BoosterParams(**{**PLAIN.__dict__, "leaves": leaves, "max_depth": 3 if leaves is None else 5})
    rows = made()
    model = fit_booster(frame(spark, rows), ["x", "z", "g"], "y", ["k"], params=p)
    got = {r["k"]: r["prediction"] for r in model.transform(frame(spark, rows)).collect()}
    want, shapes = plain_fit(rows, p)
    assert [sum(f < 0 for f in t.feature) for t in model.trees] == [len(s) for s in shapes]
    assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-4)


def same_trees(a, b):
    return [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.value for t in a.trees] == [t.value for t in b.trees]


def test_partitions_decide_nothing(spark):
    p = BoosterParams(rounds=4, max_depth=4, min_rows=5)
    df = frame(spark, made(1500))
    fits = [fit_booster(df.repartition(n, "k"), ["x", "z", "g"], "y", ["k"], params=p) for n in (1, 6)]
    assert same_trees(*fits)


def test_models_of_one_fit_equal_single_fits_in_as_many_passes(spark, monkeypatch):
    p, passes, one_pass = BoosterParams(rounds=3, max_depth=3, min_rows=5), [], B._pass
    monkeypatch.setattr(B, "_pass", lambda *a: passes.append(len(a[6])) or one_pass(*a))
    df = frame(spark, made(900))
    folds = df.withColumn("fold", F.explode(F.array(F.when(F.col("k") < 500, 0), F.lit(1), F.when(F.col("k") % 2 == 0, 2)))).where("fold is not null")
    together = fit_boosters(folds, "fold", 3, ["x", "z", "g"], "y", ["k"], params=p, encoded=["g"])
    n = len(passes)
    alone = [fit_booster(folds.where(F.col("fold") == k), ["x", "z", "g"], "y", ["k"], params=p, encoded=["g"]) for k in range(3)]
    assert all(same_trees(together[k], alone[k]) for k in range(3))
    assert n <= p.rounds * p.max_depth  # no more passes than one model may need
    scored = together.transform(folds, "fold").orderBy("k", "fold").toPandas()
    for k in range(3):
        own = alone[k].transform(folds.where(F.col("fold") == k)).orderBy("k").toPandas()
        assert np.allclose(scored[scored.fold == k].prediction, own.prediction)


def test_a_split_by_levels_that_are_not_neighbours(spark):
    rows = [(i, 0.0, 0.0, "abcdef"[i % 6], 10.0 if i % 6 in (0, 2, 5) else 1.0) for i in range(300)]
    model = fit_booster(frame(spark, rows), ["g"], "y", ["k"], params=BoosterParams(rounds=1, max_depth=1, min_rows=5, subsample=1.0, learning_rate=1.0))
    t = model.trees[0]
    assert t.feature == [0, -1, -1] and list(np.flatnonzero(t.goes_left[0])) in ([1, 3, 6], [2, 4, 5])
    unknown = model.transform(frame(spark, [(1, 0.0, 0.0, "new", 0.0), (2, 0.0, 0.0, None, 0.0)])).collect()
    assert all(r["prediction"] > 0 for r in unknown)


@pytest.mark.parametrize("high", [True, False])
def test_missing_rows_go_to_the_side_they_resemble(spark, high):
    rows = [(i, None if i % 4 == 0 else float(i % 4), 0.0, "a", (9.0 if high else 1.0) if i % 4 == 0 else (9.0 if i % 4 == 3 else 1.0)) for i in range(200)]
    model = fit_booster(frame(spark, rows), ["x"], "y", ["k"], params=BoosterParams(rounds=1, max_depth=1, min_rows=5, subsample=1.0, learning_rate=1.0))
    got = {r["k"] % 4: r["prediction"] for r in model.transform(frame(spark, rows)).collect()}
    assert got[0] == got[3 if high else 1] and got[1] == got[2] != got[3]


def test_samples_are_shares_that_change_by_round():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64)
    a, b = B.sampled(keys, 0, 0.8), B.sampled(keys, 1, 0.8)
    assert abs(a.mean() - 0.8) < 0.02 and abs((a & b).mean() - 0.64) < 0.02
    p = BoosterParams(colsample=0.5)
    picks = [tuple(B.inputs_of_round(10, r, p)) for r in range(20)]
    assert all(len(x) == 5 for x in picks) and len(set(picks)) > 10


def test_edges_of_few_and_many_values():
    assert B.edges_of(np.array([1.0, 3.0, np.nan, 3.0]), 64).tolist() == [2.0]
    many = B.edges_of(np.random.default_rng(0).random(5000), 16)
    assert len(many) == 14 and (np.diff(many) > 0).all()
    bins = B.bins_of(np.array([np.nan, 0.0, 2.0, 2.5]), np.array([2.0]), None)
    assert bins.tolist() == [0, 1, 1, 2]


def test_no_rows_and_one_value(spark):
    empty = fit_booster(frame(spark, []), ["x", "g"], "y", ["k"], params=PLAIN)
    assert empty.transform(frame(spark, made(3))).where("prediction < 0.001").count() == 3
    flat = fit_booster(frame(spark, [(i, 1.0, 1.0, "a", 4.0) for i in range(50)]), ["x", "g"], "y", ["k"], params=PLAIN)
    assert [r["prediction"] for r in flat.transform(frame(spark, made(2))).collect()] == pytest.approx([4.0, 4.0])


def test_clashing_names_and_a_prediction_named_like_an_input(spark):
    df = frame(spark, made(100)).withColumns({"m": F.lit("other"), "row__": F.lit(1), "i0": F.lit(2)})
    model = fit_booster(df, ["x", "g"], "y", ["k"], params=PLAIN)
    out = model.transform(df)
    assert out.columns == [*df.columns, "prediction"] and out.count() == 100


def test_blocks_of_one_task_are_dealt_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 100)
    rows = spark.range(500).select(F.lit(0).alias(B.MODEL), F.lit(1.0).alias("y__"), F.col("id").alias("key__"), F.col("id").cast("double").alias("i0")).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        blocks = B._write_blocks(rows, [B.Forest(["x"], {"x": np.array([250.0])}, {}, 0.0, 0.2)], str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert blocks.count() == len(blocks.inputFiles()) == 5
    assert sum(len(B.load_block(str(tmp_path), r[0])[1]) for r in blocks.collect()) == 500
