import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfcast.functions import calendar as C
from shelfcast.functions import metrics as M
from shelfcast.functions.quantiles import exact_quantiles, running_total_by_hash, top_share
from shelfcast.operators import baselines as B
from shelfcast.operators import drift as D
from shelfcast.operators import features as FE
from shelfcast.operators import inventory as I
from shelfcast.operators import pricing as P
from shelfcast.operators import quality as Q
from shelfcast.operators import segments as S
from shelfcast.operators.ets import _smooth, ets, holt_winters, holt_winters_many
from shelfcast.plans import backtest as BT
from shelfcast.schemas import HOLIDAYS, PolicyParams, fold_origins

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def series(spark, values, store="S00", sku="K0", name="demand_filled"):
    rows = [(store, sku, day(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"store_id string, sku_id string, date date, {name} double")


def scores(spark, y, f):
    df = spark.createDataFrame([("m", None if a is None else float(a), float(b)) for a, b in zip(y, f)],
                               "model string, actual double, forecast double")
    return M.evaluate(df, ["model"]).first()


def test_metrics_of_a_hand_worked_week(spark):
    # errors +1, -2, +3, 0 on sales of 4, 5, 0, 11: 6 off in 20 sold, 2 too many
    r = scores(spark, [4, 5, 0, 11], [5, 3, 3, 11])
    assert r["wape"] == pytest.approx(0.3) and r["bias"] == pytest.approx(0.1) and r["vn1"] == pytest.approx(0.4)
    assert r["mape"] == pytest.approx((1 / 4 + 2 / 5 + 0) / 3) and r["smape"] == pytest.approx((2 / 9 + 4 / 8 + 2 + 0) / 4) and r["n"] == 4


def test_metrics_ignore_missing_actual(spark):
    r = scores(spark, [10, None], [10, 999])
    assert r["wape"] == 0 and r["n"] == 1
    empty = scores(spark, [None], [5])
    assert empty["wape"] == 0 and empty["mape"] is None and empty["n"] == 0


def test_weekly_level_merges_folds_and_keeps_all_missing_out(spark):
    rows = [("m", "a", day(0), 1, 5.0, 4.0), ("m", "a", day(1), 2, 5.0, 8.0), ("m", "a", day(7), 2, None, 3.0)]
    df = spark.createDataFrame(rows, "model string, store_id string, date date, fold int, actual double, forecast double")
    r = M.evaluate_at_level(df, ["store_id"]).first()
    assert r["n"] == 1 and r["wape"] == pytest.approx(0.2)


def test_mase_drops_missing_points_before_the_shift(spark):
    history = series(spark, [1, None, 2, 3, 4], name="demand_target")
    sc = spark.createDataFrame([("S00", "K0", 10.0, 12.0)], "store_id string, sku_id string, actual double, forecast double")
    assert M.mase(sc, history, ["store_id", "sku_id"], season=1).first()["mase"] == pytest.approx(2.0)


def raw_sales(spark):
    cols = ("seq long, store_id string, sku_id string, date date, units_sold int, selling_price double, regular_price double,"
            " on_promo int, discount_pct double, stockout_flag int")
    rows = [
        (1, "S", "K", day(1), 5, 10.0, 10.0, 0, 0.0, 0),
        (2, "S", "K", day(1), 9, 10.0, 10.0, 0, 0.0, 0),       # duplicate, later arrival
        (3, "S", "K", day(2), -2, 10.0, 10.0, 0, 0.0, 0),      # return
        (4, "S", "K", day(4), 4, 900.0, 10.0, 1, 0.1, 0),      # price typo
        (5, "S", "K", day(8), 7, 9.0, 10.0, 0, 0.0, 1),        # stock-out, same weekday as day 1
        (6, "T", "K", day(0), 1, 5.0, 5.0, 0, 0.0, 0),
    ]
    return spark.createDataFrame(rows, cols)


def test_quality_rules(spark):
    bounds = Q.date_bounds(raw_sales(spark))
    out = {(r["store_id"], r["date"]): r for r in Q.clean_sales(raw_sales(spark), ["seq"], bounds).collect()}
    assert len(out) == 2 * 9
    assert out[("S", day(1))]["units_sold"] == 5
    assert out[("S", day(2))]["units_sold"] is None
    assert out[("S", day(4))]["selling_price"] == pytest.approx(9.0)
    assert out[("S", day(0))]["selling_price"] == 10.0                 # filled backward at the head
    assert out[("S", day(5))]["selling_price"] == pytest.approx(9.0)   # carries the promotion price
    assert out[("S", day(5))]["discount_pct"] == 0.0
    assert out[("S", day(8))]["demand_target"] is None
    assert out[("S", day(8))]["demand_filled"] == 5.0                  # same weekday a week before
    assert out[("T", day(8))]["demand_filled"] == 0.0 and out[("T", day(7))]["demand_filled"] == 1.0


def test_quality_scorecard(spark):
    card = {r["rule"]: r["count"] for r in Q.quality_scorecard(raw_sales(spark), ["seq"]).collect()}
    assert card == {"rows_in": 6, "r1_duplicates_removed": 1, "r2_negative_units": 1, "r3_price_outliers": 1,
                    "r4_missing_days_filled": 13, "r5_censored_stockout_days": 1, "rows_out": 18}


def test_same_weekday_median_of_up_to_four(spark):
    values = [float(i // 7 + 1) if i % 7 == 0 else 0.0 for i in range(43)]
    df = series(spark, values, name="units_sold").withColumn("stockout_flag", (F.col("date") == F.lit(day(35))).cast("int"))
    r = Q.censor_stockouts(df).where(F.col("date") == F.lit(day(35))).first()
    assert r["demand_filled"] == np.median([2, 3, 4, 5])


@pytest.mark.parametrize("values,segment", [
    ([10, 11, 9, 10, 10, 11], "smooth"), ([1, 30, 1, 40, 1, 2], "erratic"),
    ([5, 0, 5, 0, 5, 0], "intermittent"), ([1, 0, 0, 50, 0, 1], "lumpy")])
def test_four_segments(spark, values, segment):
    assert S.classify_demand(series(spark, values), "demand_filled").first()["segment"] == segment


def test_calendar_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 24),), (dt.date(2026, 12, 26),), (dt.date(2024, 3, 1),)], "date date")
    got = {r["date"]: r for r in C.add_calendar(df).collect()}
    assert got[dt.date(2024, 12, 24)]["days_to_holiday"] == 1 and got[dt.date(2024, 12, 24)]["dow"] == 1
    assert got[dt.date(2026, 12, 26)]["days_to_holiday"] == 60
    assert got[dt.date(2024, 3, 1)]["is_payday_window"] == 1


def test_holiday_calendar_takes_the_strongest(spark):
    days = spark.createDataFrame([(dt.date(2024, 12, d),) for d in range(9, 26)], "date date")
    got = {r["date"].day: r for r in C.holiday_calendar(spark, days, HOLIDAYS).collect()}
    assert got[12]["holiday_mult"] == pytest.approx(1.25) and got[11]["holiday_mult"] == pytest.approx(1.2)
    assert got[9]["holiday_mult"] == pytest.approx(1.075) and got[15]["is_holiday_window"] == 0
    assert got[25]["holiday_mult"] == pytest.approx(1.4)


def test_demand_history_matches_pandas(spark):
    rng = np.random.default_rng(3)
    y = pd.Series(rng.poisson(2, 160).astype(float))
    got = FE.add_demand_history(series(spark, y)).orderBy("date").toPandas()
    base = y.shift(28)
    want = {"lag_28": base, "lag_49": y.shift(49), "rmean_7": base.rolling(7, min_periods=1).mean(),
            "rmean_91": base.rolling(91, min_periods=1).mean(), "rstd_28": base.rolling(28, min_periods=2).std(),
            "rzero_28": (base == 0).rolling(28, min_periods=1).mean(),
            "dow_mean_4w": pd.concat([y.shift(k) for k in (28, 35, 42, 49)], axis=1).mean(axis=1)}
    for c, v in want.items():
        pd.testing.assert_series_equal(got[c].astype(float), v, check_names=False, obj=c)


def test_features_never_contain_targets(spark):
    df = spark.createDataFrame([], "date date, units_sold int, demand_target double, demand_filled double, lag_28 double")
    assert FE.feature_columns(df) == ["lag_28"]


def test_leakage_guard_sees_a_shifted_lag(spark):
    good = FE.add_demand_history(series(spark, range(60)))
    assert FE.lag_mismatches(good).first()["mismatches"] == 0
    bad = good.withColumn("lag_28", F.col("demand_filled"))
    assert FE.lag_mismatches(bad).first()["mismatches"] > 0


def test_future_frame(spark):
    silver = (series(spark, [1, 2, 3]).withColumns({"regular_price": F.lit(10.0), "demand_target": F.col("demand_filled")}))
    plan = spark.createDataFrame([("S00", "K0", day(4), 0.2)], "store_id string, sku_id string, date date, discount_pct double")
    products = spark.createDataFrame([("K0", "c")], "sku_id string, category string")
    out = {r["date"]: r for r in FE.make_future_frame(silver, 2, plan, products).collect()}
    assert len(out) == 5 and out[day(4)]["selling_price"] == pytest.approx(8.0) and out[day(4)]["on_promo"] == 1
    assert out[day(3)]["discount_pct"] == 0.0 and out[day(3)]["demand_filled"] == 0.0 and out[day(3)]["demand_target"] is None


def croston(values, alpha=0.1):
    nz = [i for i, v in enumerate(values) if v > 0]
    if not nz:
        return 0.0
    z, p, last = values[nz[0]], nz[0] + 1, nz[0]
    for i in nz[1:]:
        z, p, last = alpha * values[i] + (1 - alpha) * z, alpha * (i - last) + (1 - alpha) * p, i
    return (1 - alpha / 2) * z / p


def test_croston_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    panels, want = None, {}
    for k in range(6):
        v = (rng.random(90) < 0.3) * rng.integers(1, 9, 90) if k else np.zeros(90)
        part = series(spark, v, sku=f"K{k}")
        panels = part if panels is None else panels.unionByName(part)
        for fold, end in enumerate((61, 89), 1):
            want[(f"K{k}", fold)] = croston([float(x) for x in v[:end + 1]])
    got = B.croston_levels(panels, [day(61), day(89)]).collect()
    assert len(got) == 12
    for r in got:
        assert r["croston_sba"] == pytest.approx(want[(r["sku_id"], r["fold"])])


def test_croston_alternating_demand(spark):
    level = B.croston_levels(series(spark, [0, 4] * 60), [day(119)]).first()["croston_sba"]
    assert 1.5 < level < 2.1


def test_weekday_rules_on_a_growing_series(spark):
    """Sales of week w on weekday d are 10 w + d: the average of the last four weeks lies between the second and third of them."""
    weeks = 6
    fc = B.weekday_repeats(series(spark, [10 * (i // 7) + i % 7 for i in range(7 * weeks)]), [day(7 * weeks - 1)], horizon=10).orderBy("date").toPandas()
    assert fc[fc.model == "naive_dow_avg"]["forecast"].tolist() == [35.0 + i % 7 for i in range(10)]
    assert fc[fc.model == "seasonal_naive"]["forecast"].tolist() == [50.0 + i % 7 for i in range(10)]
    short = B.weekday_repeats(series(spark, [3.0] * 21), [day(20)], horizon=3).toPandas()
    assert short[short.model == "naive_dow_avg"]["forecast"].isna().all() and (short[short.model == "seasonal_naive"]["forecast"] == 3.0).all()


def plain_holt_winters(y, horizon, params):
    """Damped trend and weekly season, day by day, with fixed parameters; the mean squared one-step error first."""
    alpha, beta, gamma, phi = params
    y = [v + 1 for v in y]
    level, season = sum(y[:7]) / 7, [v / (sum(y[:7]) / 7) for v in y[:7]]
    trend, error = (sum(y[7:14]) / 7 - level) / 7, 0.0
    for t, v in enumerate(y):
        base, s = level + phi * trend, season[t % 7]
        error += (v - base * s) ** 2
        new = alpha * v / s + (1 - alpha) * base
        level, trend, season[t % 7] = new, beta * (new - level) + (1 - beta) * phi * trend, gamma * v / base + (1 - gamma) * s
    out = []
    for k in range(1, horizon + 1):
        out.append(max(0.0, (level + sum(phi ** i for i in range(1, k + 1)) * trend) * season[(len(y) + k - 1) % 7] - 1))
    return error, out


def test_smoothing_equals_plain_recursions():
    rng = np.random.default_rng(11)
    y = rng.poisson(6, (3, 60)).astype(float) + 2 * (np.arange(60) % 7 == 5)
    grid = np.array(np.meshgrid((0.05, 0.2, 0.5), (0.01, 0.1), (0.05, 0.2), (0.85, 0.98))).reshape(4, -1)
    sse, *_ = _smooth(y + 1, grid[:, None, :])
    for i in range(3):
        assert np.allclose(sse[i], [plain_holt_winters(y[i], 1, p)[0] for p in grid.T])


def test_series_side_by_side_equal_single_ones_and_fall_back():
    rng = np.random.default_rng(12)
    y = rng.poisson(4, (5, 90)).astype(float)
    assert np.allclose(holt_winters_many(y, 9), [holt_winters(v, 9) for v in y])
    steady = np.tile([7.0, 3, 5, 2, 9, 11, 8], 20)
    assert np.abs(holt_winters(steady, 21) - steady[:21]).max() < 0.7
    assert holt_winters(np.array([4.0, 1, 6]), 5).tolist() == [4.0, 1.0, 6.0, 4.0, 1.0]


def test_ets_sends_each_day_once_for_all_folds(spark):
    rng = np.random.default_rng(13)
    panel = None
    for k in range(4):
        own = series(spark, rng.poisson(5 + k, 80), sku=f"K{k}")
        panel = own if panel is None else panel.unionByName(own)
    segments = panel.select("store_id", "sku_id").distinct().withColumn("segment", F.when(F.col("sku_id") == "K3", "lumpy").otherwise("smooth"))
    cuts = [day(50), day(60), day(70)]
    out = ets(panel.repartition(5), segments, cuts, 6)
    got = {(r["sku_id"], r["fold"], r["date"]): r["forecast"] for r in out.where("sku_id != 'K3'").collect()}
    assert len(got) == 3 * 3 * 6
    y = {k: [r["demand_filled"] for r in panel.where(f"sku_id = 'K{k}'").orderBy("date").collect()] for k in range(3)}
    for k in range(3):
        for f, c in enumerate((50, 60, 70), 1):
            assert np.allclose([got[f"K{k}", f, day(c + i)] for i in range(1, 7)], holt_winters(np.array(y[k][:c + 1]), 6))
    plan = out.where("sku_id = 'K0'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan


def test_cutoffs_and_windows(spark):
    cuts = fold_origins(day(200), 4)
    assert cuts == [day(88), day(116), day(144), day(172)]
    df = series(spark, range(201))
    assert BT.test_window(df, cuts[-1]).count() == 28


def test_ensemble_needs_both_models(spark):
    rows = [("S", "K", day(0), 1, "a", 10.0), ("S", "K", day(0), 1, "b", 20.0), ("S", "K", day(1), 1, "a", 10.0)]
    fc = spark.createDataFrame(rows, "store_id string, sku_id string, date date, fold int, model string, forecast double")
    got = {r["date"]: r["forecast"] for r in BT.ensemble(fc, "a", "b").collect()}
    assert got[day(0)] == pytest.approx(13.0) and got[day(1)] is None


def test_forward_sum_at_the_end_of_a_series(spark):
    got = series(spark, [2, 8, 1, 5]).withColumn("s", I.forward_sum("demand_filled", 4)).orderBy("date").toPandas()["s"]
    assert got.tolist() == [16.0, 8 + 1 + 5 + 5, 1 + 5 + 5 + 5, 20.0]


def replayed(spark, demand, target, start):
    rows = [("S", "K", "current_state", None, day(i), float(v), float(target), float(start)) for i, v in enumerate(demand)]
    levels = spark.createDataFrame(rows, "store_id string, sku_id string, policy string, target_service double, date date,"
                                         " demand double, order_up_to double, start_stock double")
    return levels, I.replay_policies(levels).orderBy("date").toPandas()


def test_replay_of_a_short_series_order_by_order(spark):
    # 5 a day from a stock of 20: day 0 orders 40 - 20 = 20, on the shelf on day 3; day 7 has 5 left and orders 35, there on day 10
    levels, got = replayed(spark, [5.0] * 12, 40, 20)
    assert got.sold.tolist() == [5.0] * 8 + [0.0, 0.0, 5.0, 5.0]
    assert got.lost.tolist() == [0.0] * 8 + [5.0, 5.0, 0.0, 0.0]
    assert got.on_hand.tolist() == [15.0, 10.0, 5.0, 20.0, 15.0, 10.0, 5.0, 0.0, 0.0, 0.0, 30.0, 25.0]
    with pytest.raises(ValueError):
        I.replay_policies(levels, PolicyParams(lead_time=0))


def plain_replay(demand, targets, start, review=7, lead=3):
    stock, due, out = start, [0.0] * lead, []
    for t, (d, target) in enumerate(zip(demand, targets)):
        stock += due.pop(0)
        due.append(max(0.0, float(math.ceil(target - stock - sum(due)))) if t % review == 0 else 0.0)
        sold = min(stock, d)
        stock -= sold
        out.append((d, stock, sold, d - sold))
    return out


@pytest.mark.parametrize("review, lead", [(7, 3), (4, 5), (1, 1)])
def test_replay_of_many_series_and_policies_equals_a_plain_loop(spark, review, lead):
    rng = random.Random(review)
    rows, want = [], {}
    for k, days in enumerate([40, 1, 25, 33]):
        demand = [float(rng.randrange(0, 30)) for _ in range(days)]
        targets = [[rng.uniform(20, 200) for _ in range(days)] for _ in range(k + 1)]
        plans = [[(f"p{j}", None if j == 0 else j / 10, targets[j][t]) for j in range(k + 1)] for t in range(days)]
        rows += [("S", f"K{k}", day(t), demand[t], plans[t], 50.0) for t in range(days)]
        for j in range(k + 1):
            for t, x in enumerate(plain_replay(demand, targets[j], 50.0, review, lead)):
                want[f"K{k}", f"p{j}", day(t)] = x
    plans = spark.createDataFrame(rows, "store_id string, sku_id string, date date, demand double, plans array<struct<policy string, target_service double, order_up_to double>>, start_stock double")
    p = PolicyParams(review_period=review, lead_time=lead)
    for out in (I.replay_plans(plans.repartition(3), p), I.replay_policies(plans.select("store_id", "sku_id", "date", "demand", F.inline("plans"), "start_stock"), p)):
        got = {(r["sku_id"], r["policy"], r["date"]): (r["demand"], r["on_hand"], r["sold"], r["lost"]) for r in out.collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_replay_sends_a_day_once_for_all_policies_and_runs_long_series(spark):
    base = spark.range(2000).select(F.lit("S").alias("store_id"), F.lit("K").alias("sku_id"), F.date_add(F.lit(day(0)), F.col("id").cast("int")).alias("date"),
                                    (F.col("id") % 11).cast("double").alias("demand"), F.lit(5.0).alias("forecast"))
    keys = base.select("store_id", "sku_id").distinct()
    plans = I.policy_plans(base, keys.withColumn("hist_avg", F.lit(5.0)), keys.withColumn("sigma", F.lit(2.0)))
    assert plans.count() == 2000
    out = I.replay_plans(plans)
    assert out.count() == 6 * 2000 and out.where("abs(sold + lost - demand) > 1e-9 or on_hand < 0").count() == 0


def test_a_higher_service_level_costs_stock_and_saves_sales(spark):
    rng = np.random.default_rng(29)
    rows = [("S", f"K{k}", day(i), float(v), 6.5) for k in range(12) for i, v in enumerate(rng.negative_binomial(4, 0.38, 63))]
    daily = spark.createDataFrame(rows, "store_id string, sku_id string, date date, demand double, forecast double")
    keys = daily.select("store_id", "sku_id").distinct()
    costs = I.run_policies(daily, keys.withColumn("hist_avg", F.lit(6.5)), keys.withColumn("sigma", F.lit(4.1)),
                           keys.withColumns({"unit_cost": F.lit(3.0), "price": F.lit(7.0)}))
    by_level = costs.where("policy = 'forecast_driven'").orderBy("target_service").toPandas()
    assert (np.diff(by_level.avg_inventory_value) > 0).all() and (np.diff(by_level.lost_margin) <= 0).all()
    assert np.allclose(by_level.avg_inventory_value, 3 * by_level.avg_inventory_units)
    assert I.before_after(costs).count() == 5


def test_optimal_price_is_the_best_on_a_grid(spark):
    """Margin (p - c) * p^e on a fine grid of allowed prices has its maximum where the formula says."""
    for regular, cost, elasticity, band in [(12.0, 4.0, -3.0, 0.6), (12.0, 4.0, -1.2, 0.15), (7.0, 6.0, -2.5, 0.3)]:
        got = spark.range(1).select(P.optimal_price(F.lit(regular), F.lit(cost), F.lit(elasticity), band)).first()[0]
        grid = np.linspace(regular * (1 - band), regular * (1 + band), 4001)
        assert got == pytest.approx(grid[np.argmax((grid - cost) * grid ** elasticity)], rel=1e-3)


def test_price_response_equals_a_dummy_variable_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    rng = np.random.default_rng(2)
    rows = []
    for k in range(4):
        for i in range(420):
            promo, price = int(rng.random() < 0.2), 10 * np.exp(rng.normal(0, 0.1))
            sib = int(rng.random() < 0.3)
            mu = np.exp(1.0 + 0.3 * k - 2.0 * np.log(price / 10) + 0.5 * promo - 0.05 * sib + 0.1 * k * i / 365)
            rows.append(("S", f"K{k}", "c", day(i), float(rng.poisson(mu)), float(price), promo, sib, 30))
    gold = spark.createDataFrame(rows, "store_id string, sku_id string, category string, date date, demand_target double,"
                                       " selling_price double, on_promo int, n_sibling_promo int, days_to_holiday int")
    gold = gold.withColumns({"dow": F.weekday("date"), "month": F.month("date")})
    got = P.estimate_response(gold).first()
    d = P.design_rows(gold)
    d = d.withColumns({**{f"dow_{i}": (F.col("dow") == i).cast("double") for i in range(1, 7)},
                       **{f"m_{i}": (F.col("month") == i).cast("double") for i in range(2, 13)},
                       **{f"s_{i}": (F.col("sku_id") == f"K{i}").cast("double") for i in range(1, 4)},
                       **{f"t_{i}": F.when(F.col("sku_id") == f"K{i}", F.col("t")).otherwise(0.0) for i in range(4)}})
    names = ["log_price_dm", "on_promo", "n_sibling_promo"] + [c for c in d.columns if c[:2] in ("do", "m_", "s_", "t_") and c != "dow"]
    x = VectorAssembler(inputCols=names, outputCol="x").transform(d)
    glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="x", labelCol="y", maxIter=50, tol=1e-10).fit(x)
    assert got["elasticity"] == pytest.approx(glm.coefficients[0], abs=1e-5)
    assert got["promo_uplift"] == pytest.approx(np.exp(glm.coefficients[1]), abs=1e-5)
    # HC1 limits from the full design
    pdf = d.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
    beta = np.r_[glm.intercept, glm.coefficients.toArray()]
    y, mu = pdf["y"].to_numpy(), np.exp(X @ beta)
    A = np.linalg.inv((X * mu[:, None]).T @ X)
    V = A @ ((X * ((y - mu) ** 2)[:, None]).T @ X) @ A * len(y) / (len(y) - X.shape[1] - 1)
    half = 1.959964 * np.sqrt(V[1, 1])
    assert got["elasticity_hi"] - got["elasticity"] == pytest.approx(half, rel=2e-3)
    assert got["elasticity_lo"] < -2.0 < got["elasticity_hi"] and got["n_obs"] == 1680


def test_drift_is_zero_on_itself_and_large_on_a_shift(spark):
    x = np.random.default_rng(0).normal(size=3000)
    ref = spark.createDataFrame([(float(v), 1.0) for v in x], "a double, b double")
    cur = ref.withColumns({"a": F.col("a") + 2})
    same = {r["feature"]: r for r in D.feature_drift(ref, ref, ["a", "b"]).collect()}
    assert same["a"]["psi"] < 1e-6 and same["b"]["psi"] == 0.0 and same["a"]["flag"] == "stable"
    moved = {r["feature"]: r for r in D.feature_drift(ref, cur, ["a", "b"]).collect()}
    assert moved["a"]["psi"] > 1 and moved["a"]["flag"] == "investigate"


def test_drift_of_counted_bins(spark):
    """Ten values, one per tenth; then half of the rows in the lowest bin and none in the two highest."""
    ref = spark.createDataFrame([(float(v),) for v in range(1, 11) for _ in range(10)], "a double")
    cur = spark.createDataFrame([(1.0,)] * 50 + [(float(v),) for v in range(2, 9) for _ in range(7)] + [(8.0,)], "a double")
    share = [0.5] + [0.07] * 6 + [0.08] + [0.0, 0.0]
    want = sum((max(c, 1e-6) - 0.1) * np.log(max(c, 1e-6) / 0.1) for c in share)
    assert D.feature_drift(ref, cur, ["a"]).first()["psi"] == pytest.approx(want, rel=0.02)


def test_health_statuses(spark):
    rows = [(g, "m", day(0), 10.0, f) for g, f in (("ok", 10.0), ("over", 14.0))] + [
        ("noisy", "m", day(0), 10.0, 14.0), ("noisy", "m", day(1), 10.0, 6.0), ("lean", "m", day(0), 10.0, 8.5)]
    fc = spark.createDataFrame(rows, "category string, model string, date date, actual double, forecast double")
    got = {r["category"]: r["status"] for r in D.weekly_health(fc, "m", 0.2).collect()}
    assert got == {"ok": "GREEN", "over": "RED", "noisy": "AMBER-accuracy", "lean": "AMBER-bias"}


@pytest.mark.parametrize("accuracy", [20_000, 10])
def test_exact_quantiles_with_a_hot_value(spark, accuracy):
    rng = np.random.default_rng(4)
    data = {"a": np.r_[np.full(900, 5.0), rng.normal(5, 3, 1500)], "b": rng.exponential(2, 777)}
    df = spark.createDataFrame([(k, float(x)) for k, v in data.items() for x in v], "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    for r in exact_quantiles(df, "v", probs, ["g"], accuracy).collect():
        assert r["quantile"] == pytest.approx(np.quantile(data[r["g"]], probs[r["prob_id"]]), abs=1e-12)


def test_running_total_and_top_share(spark):
    df = spark.createDataFrame([(i, i % 5 + 1) for i in range(300)], "k long, n long")
    rows = sorted(running_total_by_hash(df, "k", "n", 1).collect(), key=lambda r: r["total_before"])
    so_far = 0
    for r in rows:
        assert r["total_before"] == so_far
        so_far += r["n"]
    v = [float((i * 37) % 50) for i in range(203)]
    got = top_share(spark.createDataFrame([(x,) for x in v], "v double"), "v", 5).first()
    assert got["k"] == 40 and got["top_total"] == pytest.approx(sum(sorted(v)[-40:])) and got["total"] == sum(v)
