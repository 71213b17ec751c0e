"""Queries of the daily half."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog.ctes import METRIC_COLS, cols, level_sums, metrics_by, query
from shelfcast.catalog.registry import register, rounded
from shelfcast.functions import calendar as C
from shelfcast.functions import metrics as M
from shelfcast.functions.quantiles import exact_quantiles
from shelfcast.operators import baselines as B
from shelfcast.operators import drift as D
from shelfcast.operators import features as FE
from shelfcast.operators import inventory as I
from shelfcast.operators import pricing as P
from shelfcast.operators import quality as Q
from shelfcast.operators import segments as S
from shelfcast.plans import backtest as BT
from shelfcast.plans import reports as R
from shelfcast.schemas import KEYS, SERIES
from shelfcast.session import shared_folder, written_once
from shelfcast.sources import fixtures as X
from shelfcast.sources import tables as T

RULE, REPEAT = "naive_dow_avg", "seasonal_naive"
DRIFT = ["rmean_28", "selling_price", "rel_price", "discount_pct", "price_ratio", "n_sibling_promo"]
KEY_SQL = "store_id, sku_id, date"


# ------------------------------------------------------------------ shared frames
def panel(spark, d) -> DataFrame:
    """Silver with dimensions and segments, without the forecasting features."""
    return FE.add_dimensions(X.silver(spark, d), X.products(spark, d), X.stores(spark, d),
                             X.segments(spark, d))


def native_forecasts(spark, d) -> DataFrame:
    return B.weekday_repeats(X.silver(spark, d), X.cutoffs(spark, d))


def forecasts(spark, d) -> DataFrame:
    """Both weekday rules and their mix, with actuals."""
    def build():
        fc = native_forecasts(spark, d)
        return BT.attach_actuals(fc.unionByName(BT.ensemble(fc, RULE, REPEAT)), panel(spark, d))
    return written_once(spark, d, "forecasts", build)


def scored(spark, d) -> DataFrame:
    return BT.scored(forecasts(spark, d))


def promo_plan(spark, d) -> DataFrame:
    """Four weeks on, the promotions seen so far are planned again."""
    return (X.daily_sales(spark, d).where(F.col("on_promo") == 1)
            .groupBy(*SERIES, F.date_add("date", 28).alias("date")).agg(F.max("discount_pct").alias("discount_pct")))


def policy_costs(spark, d) -> DataFrame:
    def build():
        replayed = I.replay_plans(plans(spark, d))
        return I.policy_costs(replayed, I.median_cost_price(I.replay_inputs(forecasts(spark, d), RULE)))
    return written_once(spark, d, "policy_costs", build)


def first_replay_day(spark, d):
    """The first replayed day: the one after the second fold's origin."""
    return X.cutoffs(spark, d)[1] + dt.timedelta(days=1)


def intervals(spark, d) -> DataFrame:
    """The rule's forecast of the 28 days after the history, with the error band of all folds."""
    ahead = B.weekday_repeats(X.silver(spark, d), [X.bounds(spark, d)[1]])
    points = ahead.where(F.col("model") == RULE).select(*KEYS, F.col("forecast").alias("p50"))
    return I.forecast_intervals(points, I.error_spread(forecasts(spark, d), RULE))


def skus(spark, d) -> DataFrame:
    return written_once(spark, d, "sku_stats", lambda: P.sku_stats(panel(spark, d), X.bounds(spark, d)[1]))


def given_elasticities(spark) -> DataFrame:
    return P.elasticity_table(spark, [("sized", -2.0, 1.6, 0.02), ("tiered", -0.8, 1.3, 0.01)])


def recommendations(spark, d) -> DataFrame:
    return P.price_recommendations(skus(spark, d), given_elasticities(spark))


def promo_economics(spark, d) -> DataFrame:
    return P.promo_depth_economics(given_elasticities(spark), skus(spark, d), panel(spark, d))


def health(spark, d) -> DataFrame:
    sc = scored(spark, d)
    base = M.evaluate(sc, ["model"]).where(F.col("model") == RULE)
    return D.weekly_health(sc, RULE, base)


# ------------------------------------------------------------------ sources
@register("table_scan", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, d):
    return T.read_table(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@register("wide_to_long", query("bronze", """
SELECT store_id, sku_id, make_date(y, 1, 1) AS date, CAST(sum(units_sold) FILTER (year(date) = y) AS DOUBLE) AS units_sold
FROM bronze, (SELECT CAST(unnest(range((SELECT min(year(date)) FROM bronze), (SELECT max(year(date)) + 1 FROM bronze))) AS INTEGER) AS y) GROUP BY store_id, sku_id, y"""))
def _(spark, d):
    return T.melt_weeks(wide_sales(spark, d), SERIES)


def wide_sales(spark, d) -> DataFrame:
    """A column per year of the data."""
    first, last = X.bounds(spark, d)
    years = [f"{y}-01-01" for y in range(first.year, last.year + 1)]
    yearly = X.daily_sales(spark, d).withColumn("period", F.date_trunc("year", "date").cast("date").cast("string"))
    return yearly.groupBy(*SERIES).pivot("period", years).agg(F.sum("units_sold"))


@register("csv_to_long", query("bronze", """
SELECT CAST(store_id AS VARCHAR) AS store_id, sku_id, make_date(y, 1, 1) AS date, CAST(sum(units_sold) FILTER (year(date) = y) AS DOUBLE) AS units_sold
FROM bronze, (SELECT CAST(unnest(range((SELECT min(year(date)) FROM bronze), (SELECT max(year(date)) + 1 FROM bronze))) AS INTEGER) AS y)
GROUP BY store_id, sku_id, y"""))
def _(spark, d):
    path = f"{shared_folder(spark)}/wide-{uuid.uuid4().hex}"
    wide_sales(spark, d).write.option("header", True).csv(path)
    return T.melt_weeks(T.read_wide_csv(spark, path), SERIES)


@register("sorted_table_read_back", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, d):
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    T.write_table(T.read_table(spark, f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"), path, sort_by=["o_custkey"])
    return T.read_table(spark, path)


@register("exported_profile", query("bronze", "SELECT count(*) AS row_count, count(DISTINCT store_id) AS stores, count(DISTINCT sku_id) AS skus FROM bronze"))
def _(spark, d):
    path = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    T.export_json(R.bronze_profile(X.daily_sales(spark, d)).select("row_count", "stores", "skus"), path)
    return spark.read.schema("row_count long, stores long, skus long").json(path)


@register("promo_calendar", query("bronze", "SELECT DISTINCT date, store_id, sku_id, discount_pct FROM bronze WHERE on_promo = 1"))
def _(spark, d):
    return T.promo_calendar(X.daily_sales(spark, d))


# ------------------------------------------------------------------ quality
@register("bronze_profile", query("bronze", """
SELECT count(*) AS row_count, count(DISTINCT store_id) AS stores, count(DISTINCT sku_id) AS skus, min(date) AS first_day,
       max(date) AS last_day, count(*) FILTER (units_sold < 0) AS negative_rows,
       CAST(sum(stockout_flag) AS BIGINT) AS stockout_days FROM bronze"""))
def _(spark, d):
    return R.bronze_profile(X.daily_sales(spark, d))


@register("keep_first_duplicates", query("r1", f"SELECT {KEY_SQL}, units_sold, regular_price, discount_pct FROM r1"))
def _(spark, d):
    return Q.keep_first(X.daily_sales(spark, d), X.ARRIVAL).select(*KEYS, "units_sold", "regular_price", "discount_pct")


@register("negative_units_to_null", query("r2", f"SELECT {KEY_SQL}, units_sold, is_negative FROM r2"))
def _(spark, d):
    once = Q.keep_first(X.daily_sales(spark, d), X.ARRIVAL)
    return Q.null_negative_units(once).select(*KEYS, "units_sold", "is_negative")


@register("price_outlier_repair", query("r3", f"SELECT {cols(KEY_SQL + ', is_price_outlier', 'selling_price')} FROM r3"))
def _(spark, d):
    once = Q.keep_first(X.daily_sales(spark, d), X.ARRIVAL)
    return rounded(Q.repair_prices(once).select(*KEYS, "selling_price", "is_price_outlier"))


@register("calendar_completion", query("r4", f"SELECT {KEY_SQL}, units_sold, is_filled FROM r4"))
def _(spark, d):
    once = Q.null_negative_units(Q.keep_first(X.daily_sales(spark, d), X.ARRIVAL))
    return Q.complete_calendar(once.select(*KEYS, "units_sold"), X.bounds_frame(spark, d))


@register("price_fill", query("carried", f"""
SELECT {cols(KEY_SQL + ', on_promo, stockout_flag, discount_pct', 'regular_price, selling_price')} FROM carried"""))
def _(spark, d):
    return rounded(X.silver(spark, d).select(*KEYS, "on_promo", "stockout_flag", "discount_pct", "regular_price",
                                             "selling_price"))


@register("stockout_censoring", query("marked", f"SELECT {KEY_SQL}, demand_target, demand_filled FROM marked"))
def _(spark, d):
    return X.silver(spark, d).select(*KEYS, "demand_target", "demand_filled")


@register("silver_panel", query("silver", f"""
SELECT {cols(KEY_SQL + ', units_sold, true_demand, on_promo, discount_pct, stockout_flag, n_sibling_promo', 'regular_price, selling_price, demand_target, demand_filled')} FROM silver"""))
def _(spark, d):
    return rounded(X.silver(spark, d).select(
        *KEYS, "units_sold", "true_demand", "on_promo", "discount_pct", "stockout_flag", "n_sibling_promo",
        "regular_price", "selling_price", "demand_target", "demand_filled"))


@register("quality_scorecard", query("marked bronze", """
SELECT rule, count, round(count / rows_in, 6) AS pct_of_input FROM (
  SELECT (SELECT count(*) FROM bronze) AS rows_in, (SELECT count(*) FROM r1) AS kept,
         count(*) FILTER (is_negative) AS r2, count(*) FILTER (is_price_outlier) AS r3,
         count(*) FILTER (units_sold IS NULL) - count(*) FILTER (is_negative) AS r4,
         count(*) FILTER (stockout_flag = 1) AS r5, count(*) AS rows_out FROM marked),
  LATERAL (VALUES ('rows_in', rows_in), ('r1_duplicates_removed', rows_in - kept), ('r2_negative_units', r2),
    ('r3_price_outliers', r3), ('r4_missing_days_filled', r4), ('r5_censored_stockout_days', r5), ('rows_out', rows_out)) v(rule, count)"""))
def _(spark, d):
    size = X.daily_sales(spark, d).agg(F.count(F.lit(1)).alias("rows_in"))
    return rounded(Q.scorecard_of(X.marked(spark, d), size))


# ------------------------------------------------------------------ segments and exploration
@register("demand_segments", query("segments", f"SELECT {cols('store_id, sku_id, segment', 'adi, cv2, mean_demand, zero_share')} FROM segments"))
def _(spark, d):
    return rounded(X.segments(spark, d))


@register("segment_summary", query("segments", """
SELECT segment, count(*) AS series, round(avg(mean_demand), 6) AS mean_daily, round(avg(zero_share), 6) AS zero_share
FROM segments GROUP BY segment"""))
def _(spark, d):
    return rounded(S.segment_summary(X.segments(spark, d)))


@register("weekly_units_by_category", query("marked products", """
SELECT CAST(date_trunc('week', date) AS DATE) AS week, category, sum(demand_target) AS units
FROM marked JOIN products USING (sku_id) GROUP BY ALL"""))
def weekly_units(spark, d):
    return R.weekly_units(X.silver(spark, d), X.products(spark, d))


@register("promo_lift_by_depth", query("marked products", """
SELECT category, discount_pct, round(avg(demand_target), 2) AS avg_daily_units, count(*) AS days
FROM marked JOIN products USING (sku_id) WHERE demand_target IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return R.promo_lift(X.silver(spark, d), X.products(spark, d))


@register("weekday_profile", query("marked", """
SELECT CAST(dayofweek(date) + 1 AS INTEGER) AS dow, round(avg(demand_target), 2) AS avg_units,
       round(100 * avg(stockout_flag), 2) AS stockout_pct FROM marked GROUP BY 1"""))
def _(spark, d):
    return R.weekday_profile(X.silver(spark, d))


# ------------------------------------------------------------------ features
@register("calendar_features", query("dated", f"""
SELECT {KEY_SQL}, dow, dom, month, weekofyear, is_weekend, is_payday_window, days_to_holiday FROM dated"""))
def _(spark, d):
    return C.add_calendar(panel(spark, d).select(*KEYS), X.HOLIDAYS)


@register("holiday_calendar", query("bronze calendar", """
SELECT d.date, round(coalesce(max(1 + (multiplier - 1) * w), 1), 6) AS holiday_mult,
       CAST(count(multiplier) > 0 AS INTEGER) AS is_holiday_window
FROM (SELECT DISTINCT date FROM bronze) d LEFT JOIN (SELECT CAST(holiday - ahead AS DATE) AS day, multiplier, w
                       FROM calendar, (VALUES (0, 1.0), (1, 0.8), (2, 0.5), (3, 0.3)) r(ahead, w)) h ON h.day = d.date
GROUP BY d.date"""))
def _(spark, d):
    days = X.daily_sales(spark, d).select("date").distinct()
    return rounded(C.holiday_calendar(spark, days, X.HOLIDAYS))


@register("dimension_join", query("panel", f"""
SELECT {cols(KEY_SQL + ', category, region, segment', 'unit_cost, store_size')} FROM panel"""))
def _(spark, d):
    return rounded(panel(spark, d).select(*KEYS, "category", "region", "segment", "unit_cost", "store_size"))


@register("price_features", query("gold0", f"SELECT {cols(KEY_SQL, 'price_ratio, rel_price, log_price')} FROM gold0"))
def _(spark, d):
    return rounded(FE.add_price_features(panel(spark, d)).select(*KEYS, "price_ratio", "rel_price", "log_price"))


@register("demand_lags", query("gold0", f"SELECT {KEY_SQL}, lag_28, lag_35, lag_42, lag_49, lag_364 FROM gold0"))
def _(spark, d):
    return X.gold(spark, d).select(*KEYS, *[f"lag_{n}" for n in (28, 35, 42, 49, 364)])


@register("rolling_demand", query("gold", f"""
SELECT {cols(KEY_SQL, 'rmean_7, rmean_28, rmean_91, rstd_28, rzero_28')} FROM gold"""))
def _(spark, d):
    return rounded(X.gold(spark, d).select(
        *KEYS, "rmean_7", "rmean_28", "rmean_91", "rstd_28", "rzero_28"))


@register("weekday_mean_and_trend", query("gold", f"SELECT {cols(KEY_SQL, 'dow_mean_4w, trend_ratio')} FROM gold"))
def _(spark, d):
    return rounded(X.gold(spark, d).select(*KEYS, "dow_mean_4w", "trend_ratio"))


@register("sibling_promotions", query("silver", f"SELECT {KEY_SQL}, on_promo, n_sibling_promo FROM silver"))
def _(spark, d):
    return X.silver(spark, d).select(*KEYS, "on_promo", "n_sibling_promo")


GOLD_PLAIN = (KEY_SQL + ", category, region, segment, on_promo, n_sibling_promo, dow, dom, month, weekofyear, is_weekend, "
              "is_payday_window, days_to_holiday, stockout_flag")
GOLD_ROUND = ("discount_pct, selling_price, store_size, price_ratio, rel_price, log_price, lag_28, lag_35, lag_42, lag_49, "
              "lag_364, rmean_7, rmean_28, rmean_91, rstd_28, rzero_28, dow_mean_4w, trend_ratio, demand_target")


@register("gold_features", query("gold", f"SELECT {cols(GOLD_PLAIN, GOLD_ROUND)} FROM gold"))
def _(spark, d):
    names = [c.strip() for c in (GOLD_PLAIN + ", " + GOLD_ROUND).split(",")]
    return rounded(X.gold(spark, d).select(*names))


FEATURES = """store_id sku_id selling_price on_promo discount_pct n_sibling_promo category region store_size segment dow dom month
weekofyear is_weekend is_payday_window days_to_holiday price_ratio rel_price log_price lag_28 lag_35 lag_42 lag_49 lag_364 rmean_7
rmean_28 rmean_91 rstd_28 rzero_28 dow_mean_4w trend_ratio""".split()


@register("feature_list", query("gold", f"""
SELECT CAST(list_position({FEATURES!r}, feature) AS INTEGER) AS position, feature, n_known
FROM (SELECT {', '.join(f'count({c}) AS {c}' for c in FEATURES)} FROM gold) UNPIVOT (n_known FOR feature IN ({', '.join(FEATURES)}))"""))
def _(spark, d):
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    T.write_table(FE.feature_list(X.gold(spark, d)), path)
    return T.read_table(spark, path)


@register("future_known_inputs", query("future", f"""
SELECT {cols(KEY_SQL + ', on_promo, n_sibling_promo', 'regular_price, discount_pct, selling_price')} FROM future"""))
def _(spark, d):
    fut = FE.future_rows(X.silver(spark, d), promo_plan=promo_plan(spark, d), products=X.products(spark, d))
    return rounded(fut.select(*KEYS, "on_promo", "n_sibling_promo", "regular_price", "discount_pct", "selling_price"))


@register("history_and_future", query("silver future", """
SELECT store_id, sku_id, count(*) AS rows_total, count(demand_target) AS known, sum(demand_filled) AS filled, max(date) AS last_day
FROM (SELECT store_id, sku_id, date, demand_target, demand_filled FROM silver
      UNION ALL SELECT store_id, sku_id, date, NULL, 0.0 FROM future) GROUP BY ALL"""))
def _(spark, d):
    frame = FE.make_future_frame(X.silver(spark, d), promo_plan=promo_plan(spark, d), products=X.products(spark, d))
    return frame.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("rows_total"), F.count("demand_target").alias("known"),
        F.sum("demand_filled").alias("filled"), F.max("date").alias("last_day"))


@register("lag_leakage_guard", query("gold0", """
SELECT count(*) AS rows_checked, count(*) FILTER (a.lag_28 IS DISTINCT FROM b.demand_filled) AS mismatches
FROM gold0 a LEFT JOIN gold0 b ON b.store_id = a.store_id AND b.sku_id = a.sku_id AND b.date = a.date - 28"""))
def _(spark, d):
    return FE.lag_mismatches(X.gold(spark, d))


@register("demeaned_log_price", query("panel", f"""
SELECT {KEY_SQL}, round(ln(selling_price) - avg(ln(selling_price)) OVER (PARTITION BY store_id, sku_id), 6) + 0.0 AS log_price_dm,
       CAST(date - min(date) OVER (PARTITION BY category) AS INTEGER) AS days_in
FROM panel WHERE demand_target IS NOT NULL"""))
def _(spark, d):
    dated = X.gold(spark, d)
    first = dated.where(F.col("demand_target").isNotNull()).groupBy("category").agg(F.min("date").alias("first_day"))
    rows = P.design_rows(dated).join(first, "category")
    return rounded(rows.select(*SERIES, F.date_add("first_day", F.round(F.col("t") * 365).cast("int")).alias("date"),
                               "log_price_dm", F.round(F.col("t") * 365).cast("int").alias("days_in")))


@register("train_and_test_rows", query("gold0 cutoffs", """
SELECT fold, cutoff, count(*) FILTER (date <= cutoff AND demand_target IS NOT NULL AND lag_28 IS NOT NULL) AS train_rows,
       count(*) FILTER (date > cutoff AND date <= cutoff + 28) AS test_rows
FROM gold0, cutoffs GROUP BY ALL"""))
def _(spark, d):
    return BT.fold_sizes(X.gold(spark, d), X.cutoffs(spark, d))


@register("fold_cutoffs", query("cutoffs", "SELECT fold, cutoff FROM cutoffs"))
def _(spark, d):
    return spark.createDataFrame(list(enumerate(X.cutoffs(spark, d), 1)), "fold int, cutoff date")  # a row per fold


# ------------------------------------------------------------------ forecasts and accuracy
FC_SQL = KEY_SQL + ", fold, model"


@register("weekday_repeat_forecasts", query("native", f"SELECT {cols(FC_SQL, 'forecast')} FROM native"))
def _(spark, d):
    return rounded(native_forecasts(spark, d))


@register("croston_sba_levels", query("croston", f"SELECT {cols('store_id, sku_id, fold, cutoff', 'croston_sba')} FROM croston"))
def _(spark, d):
    return rounded(B.croston_levels(X.silver(spark, d), X.cutoffs(spark, d)))


@register("croston_sba_forecasts", query("croston", """
SELECT store_id, sku_id, CAST(cutoff + CAST(k AS INTEGER) AS DATE) AS date, fold, 'croston_sba' AS model,
       round(croston_sba, 6) AS forecast FROM croston, (SELECT unnest(range(1, 29)) AS k)"""))
def _(spark, d):
    return rounded(B.croston_sba(X.silver(spark, d), X.cutoffs(spark, d)))


@register("ensemble_forecasts", query("mixed", f"SELECT {cols(FC_SQL, 'forecast')} FROM mixed"))
def _(spark, d):
    return rounded(BT.ensemble(native_forecasts(spark, d), RULE, REPEAT).select(*KEYS, "fold", "model", "forecast"))


@register("unbiased_forecasts", query("fc sc", f"""
SELECT {KEY_SQL}, fold, model, round(CASE WHEN forecast IS NOT NULL THEN greatest(forecast - coalesce(bias, 0), 0) END, 6) + 0.0 AS forecast
FROM fc LEFT JOIN (SELECT store_id, sku_id, model, avg(forecast - actual) AS bias FROM sc WHERE fold = 1 GROUP BY ALL) USING (store_id, sku_id, model)
WHERE fold > 1"""))
def _(spark, d):
    return rounded(BT.without_bias(forecasts(spark, d), 1))


@register("forecasts_with_actuals", query("fc", f"""
SELECT {cols(FC_SQL + ', true_demand, segment, category, on_promo', 'forecast, actual, selling_price, unit_cost')} FROM fc"""))
def _(spark, d):
    return rounded(forecasts(spark, d))


@register("scored_forecasts", query("sc", "SELECT model, fold, count(*) AS n, sum(actual) AS actual FROM sc GROUP BY ALL"))
def _(spark, d):
    return scored(spark, d).groupBy("model", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("actual"))


for _name, _keys in (("accuracy_by_model", "model"), ("accuracy_by_segment", "model, segment"),
                     ("accuracy_by_promo", "model, on_promo"), ("accuracy_by_fold", "model, fold")):
    @register(_name, query("sc", f"SELECT {cols(_keys + ', n', METRIC_COLS)} FROM ({metrics_by(_keys, 'sc')})"))
    def _(spark, d, _keys=_keys):
        return rounded(M.evaluate(scored(spark, d), _keys.split(", ")))


@register("weekly_accuracy", query("sc", f"""
SELECT {cols('model, n', METRIC_COLS)} FROM ({metrics_by('model', level_sums('store_id, sku_id'))})"""))
def _(spark, d):
    return rounded(M.evaluate_at_level(scored(spark, d), SERIES))


@register("leaderboard", query("board", f"SELECT {cols('grain, model, n', METRIC_COLS)} FROM board"))
def _(spark, d):
    return BT.ranked(rounded(BT.leaderboard(scored(spark, d))))


@register("champion_model", query("board", """
SELECT min_by(model, vn1) AS champion, round(min(vn1), 6) AS vn1 FROM board WHERE grain = 'weekly_store_sku'"""))
def _(spark, d):
    return rounded(BT.champion(BT.leaderboard(scored(spark, d))))


@register("mase_by_series", query("sc marked cutoffs", """
SELECT e.store_id, e.sku_id, round(CASE WHEN scale > 0 THEN mae / scale END, 6) AS mase
FROM (SELECT store_id, sku_id, avg(abs(forecast - actual)) AS mae FROM sc WHERE model = 'naive_dow_avg' GROUP BY ALL) e
LEFT JOIN (SELECT store_id, sku_id, avg(step) AS scale FROM (
    SELECT store_id, sku_id, abs(demand_target - lag(demand_target, 7) OVER (PARTITION BY store_id, sku_id ORDER BY date)) AS step
    FROM marked WHERE demand_target IS NOT NULL AND date <= (SELECT min(cutoff) FROM cutoffs)) GROUP BY ALL) s
  ON s.store_id = e.store_id AND s.sku_id = e.sku_id"""))
def _(spark, d):
    history = X.silver(spark, d).where(F.col("date") <= F.lit(X.cutoffs(spark, d)[0]))
    return rounded(M.mase(scored(spark, d).where(F.col("model") == RULE), history, SERIES))


@register("segment_vn1_pivot", query("sc", f"""
SELECT model, round(max(vn1) FILTER (segment = 'smooth'), 6) AS smooth, round(max(vn1) FILTER (segment = 'erratic'), 6) AS erratic,
       round(max(vn1) FILTER (segment = 'intermittent'), 6) AS intermittent, round(max(vn1) FILTER (segment = 'lumpy'), 6) AS lumpy
FROM ({metrics_by('model, segment', 'sc')}) GROUP BY model"""))
def _(spark, d):
    table = M.evaluate(scored(spark, d), ["model", "segment"])
    return rounded(BT.metric_pivot(table, "model", "segment", ["smooth", "erratic", "intermittent", "lumpy"], "vn1"))


@register("promo_wape_pivot", query("sc", f"""
SELECT model, round(max(wape) FILTER (on_promo = 0), 6) AS regular, round(max(wape) FILTER (on_promo = 1), 6) AS promoted
FROM ({metrics_by('model, on_promo', 'sc')}) GROUP BY model"""))
def _(spark, d):
    table = M.evaluate(scored(spark, d), ["model", "on_promo"])
    return rounded(BT.metric_pivot(table, "model", "on_promo", [0, 1], "wape").toDF("model", "regular", "promoted"))


# ------------------------------------------------------------------ inventory
@register("forecast_error_spread", query("sigma1 sigma_all", """
SELECT store_id, sku_id, round(f.sigma, 6) AS sigma_first_fold, round(a.sigma, 6) AS sigma_all_folds
FROM sigma_all a LEFT JOIN sigma1 f USING (store_id, sku_id)"""))
def _(spark, d):
    sc = scored(spark, d)
    first = I.error_spread(sc, RULE, 1).withColumnRenamed("sigma", "sigma_first_fold")
    every = I.error_spread(sc, RULE).withColumnRenamed("sigma", "sigma_all_folds")
    return rounded(every.join(first, SERIES, "left").select(*SERIES, "sigma_first_fold", "sigma_all_folds"))


@register("recent_average_demand", query("hist_avg", f"SELECT {cols('store_id, sku_id', 'hist_avg')} FROM hist_avg"))
def _(spark, d):
    return rounded(I.recent_average(X.silver(spark, d), first_replay_day(spark, d)))


@register("median_cost_and_price", query("cost_price", f"SELECT {cols('store_id, sku_id', 'unit_cost, price')} FROM cost_price"))
def _(spark, d):
    return rounded(I.median_cost_price(I.replay_inputs(forecasts(spark, d), RULE)))


@register("forward_demand_sum", query("ahead", f"SELECT {cols(KEY_SQL, 'ahead')} FROM ahead"))
def _(spark, d):
    daily = I.replay_inputs(forecasts(spark, d), RULE)
    return rounded(daily.select(*KEYS, I.forward_sum("forecast", 10).alias("ahead")))


def plans(spark, d) -> DataFrame:
    fc = forecasts(spark, d)
    return I.policy_plans(I.replay_inputs(fc, RULE), I.recent_average(X.silver(spark, d), first_replay_day(spark, d)),
                          I.error_spread(BT.scored(fc), RULE, 1))


def levels(spark, d) -> DataFrame:
    fc = forecasts(spark, d)
    return I.policy_levels(I.replay_inputs(fc, RULE), I.recent_average(X.silver(spark, d), first_replay_day(spark, d)),
                           I.error_spread(BT.scored(fc), RULE, 1))


@register("policy_order_levels", query("levels", f"""
SELECT {cols(KEY_SQL + ', policy', 'target_service, demand, order_up_to, start_stock')} FROM levels"""))
def _(spark, d):
    return rounded(levels(spark, d))


@register("policy_replay", query("replay", f"""
SELECT {cols('store_id, sku_id, policy, date', 'target_service, demand, on_hand, sold')}, round(demand - sold, 6) + 0.0 AS lost FROM replay"""))
def _(spark, d):
    return rounded(I.replay_plans(plans(spark, d)))


COST_COLS = "fill_rate, avg_inventory_units, stockout_days_pct"
MONEY_COLS = "avg_inventory_value, holding_cost, lost_margin, total_cost"


@register("policy_costs", query("costs", f"""
SELECT policy, target_service, sim_days, {cols('', COST_COLS)}, {cols('', MONEY_COLS, 2)} FROM costs"""))
def _(spark, d):
    c = policy_costs(spark, d)
    money = {m: F.round(m, 2) + 0.0 for m in MONEY_COLS.split(", ")}
    return c.withColumns({**{m: F.round(m, 6) + 0.0 for m in COST_COLS.split(", ")}, **money})


@register("policy_before_after", query("story", "SELECT metric, round(before, 4) AS before, round(after, 4) AS after, round(change, 6) AS change FROM story"))
def _(spark, d):
    s = I.before_after(policy_costs(spark, d))
    return s.select("metric", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"),
                    F.round("change", 6).alias("change"))


@register("forecast_intervals", query("intervals", f"SELECT {cols(KEY_SQL, 'p50, sigma, p10, p90')} FROM intervals"))
def _(spark, d):
    return rounded(intervals(spark, d))


@register("network_forecast_by_day", query("intervals", """
SELECT date, round(sum(p10), 4) AS p10, round(sum(p50), 4) AS p50, round(sum(p90), 4) AS p90 FROM intervals GROUP BY date"""))
def _(spark, d):
    return rounded(R.network_forecast(intervals(spark, d)), 4)


@register("replenishment_levels", query("replenish", f"""
SELECT {cols('store_id, sku_id', 'demand_l_plus_r, sigma, safety_stock, order_up_to')} FROM replenish"""))
def _(spark, d):
    return rounded(I.replenishment(intervals(spark, d)))


@register("replenishment_top20", query("replenish", """
SELECT store_id, sku_id, order_up_to FROM replenish ORDER BY order_up_to DESC, store_id, sku_id LIMIT 20"""))
def _(spark, d):
    return (I.replenishment(intervals(spark, d)).select(*SERIES, "order_up_to")
            .orderBy(F.desc("order_up_to"), *SERIES).limit(20))


# ------------------------------------------------------------------ pricing
@register("sku_network_stats", query("skus", f"SELECT {cols('sku_id, category', 'regular_price, unit_cost, daily_units')} FROM skus"))
def _(spark, d):
    return rounded(skus(spark, d))


@register("price_recommendations", query("recs", f"""
SELECT {cols('sku_id, category', 'elasticity, rec_price, price_change_pct, daily_units, new_daily_units')},
       {cols('', 'margin_now, margin_new, annual_margin_gain', 3)} FROM recs"""))
def _(spark, d):
    r = recommendations(spark, d).select(
        "sku_id", "category", "elasticity", "rec_price", "price_change_pct", "daily_units", "new_daily_units",
        *[F.round(c, 3).alias(c) for c in ("margin_now", "margin_new", "annual_margin_gain")])
    return P.ranked_recommendations(rounded(r))


@register("given_elasticity_error", query("elasticity products", f"""
SELECT {cols('category', 'elasticity, promo_uplift, cannibalisation_per_sibling, true_elasticity, true_promo_uplift')},
       round(elasticity / true_elasticity - 1, 6) + 0.0 AS elasticity_error_pct
FROM elasticity JOIN (SELECT category, avg(-1 - unit_cost / base_price) AS true_elasticity, avg(1 + 0.1 * length(sku_id)) AS true_promo_uplift
                      FROM products GROUP BY category) USING (category)"""))
def _(spark, d):
    truth = X.products(spark, d).select("category", (-1 - F.col("unit_cost") / F.col("base_price")).alias("true_elasticity"),
                                        (1 + 0.1 * F.length("sku_id")).alias("true_promo_uplift"))
    return rounded(P.compare_with_truth(given_elasticities(spark), truth))


@register("promo_depth_economics", query("promo", f"""
SELECT {cols('category, depth', 'units_lift_x, incremental_margin, cannibal_loss, promo_margin_pct', 5)} FROM promo"""))
def _(spark, d):
    return rounded(promo_economics(spark, d), 5)


@register("promo_margin_pivot", query("promo", """
SELECT depth, round(max(incremental_margin) FILTER (category = 'sized'), 4) AS sized,
       round(max(incremental_margin) FILTER (category = 'tiered'), 4) AS tiered FROM promo GROUP BY depth"""))
def _(spark, d):
    return rounded(BT.metric_pivot(promo_economics(spark, d), "depth", "category", ["sized", "tiered"],
                                   "incremental_margin"), 4)


# ------------------------------------------------------------------ monitoring
@register("weekly_health", query("health", f"""
SELECT {cols('week, category, alert_accuracy, alert_bias, status', 'wape, bias, units')} FROM health"""))
def _(spark, d):
    return rounded(health(spark, d))


@register("health_status_pivot", query("health", """
SELECT week, max(status) FILTER (category = 'sized') AS sized, max(status) FILTER (category = 'tiered') AS tiered
FROM health GROUP BY week"""))
def _(spark, d):
    return BT.metric_pivot(health(spark, d), "week", "category", ["sized", "tiered"], "status")


@register("feature_drift", query("drift", """
SELECT feature, round(psi, 6) AS psi, CASE WHEN psi > 0.2 THEN 'investigate' WHEN psi > 0.1 THEN 'watch' ELSE 'stable' END AS flag
FROM drift"""))
def _(spark, d):
    cuts = X.cutoffs(spark, d)
    gold = X.gold(spark, d).select("date", *[F.round(F.col(c).cast("double"), 9).alias(c) for c in DRIFT])
    return rounded(D.feature_drift(gold.where(F.col("date") <= F.lit(cuts[0])), gold.where(F.col("date") > F.lit(cuts[-1])),
                                   DRIFT))


@register("exact_price_quantiles", query("panel", """
SELECT category, CAST(i AS INTEGER) AS prob_id, round(quantile_cont(selling_price, [0.0, 0.1, 0.5, 0.9, 1.0])[i + 1], 6) AS quantile
FROM panel, (SELECT unnest(range(0, 5)) AS i) GROUP BY category, i"""))
def _(spark, d):
    return rounded(exact_quantiles(panel(spark, d), "selling_price", [0.0, 0.1, 0.5, 0.9, 1.0], ["category"], few_groups=True))


def summary(spark, d) -> DataFrame:
    return R.executive_summary(BT.leaderboard(scored(spark, d)), I.before_after(policy_costs(spark, d)),
                               recommendations(spark, d), promo_economics(spark, d), RULE, REPEAT)


SUMMARY_SQL = query("board story recs promo", """
SELECT 'Forecast error (weekly WAPE)' AS kpi, round(max(wape) FILTER (model = 'naive_dow_avg'), 4) AS before,
       round(max(wape) FILTER (model = 'seasonal_naive'), 4) AS after, 'naive_dow_avg against seasonal_naive' AS note
FROM board WHERE grain = 'weekly_store_sku'
UNION ALL SELECT 'Forecast bias (weekly)', round(max(bias) FILTER (model = 'naive_dow_avg'), 4),
       round(max(bias) FILTER (model = 'seasonal_naive'), 4), 'above zero: too much forecast' FROM board WHERE grain = 'weekly_store_sku'
UNION ALL SELECT 'Fill rate', round(before, 4), round(after, 4), 'at a service level of 95%' FROM story WHERE metric = 'Fill rate'
UNION ALL SELECT 'Avg inventory value ($)', round(before, 4), round(after, 4), 'stock held less' FROM story
  WHERE metric = 'Avg inventory value ($)'
UNION ALL SELECT 'Lost margin / yr ($)', round(before, 4), round(after, 4), 'lost to empty shelves' FROM story
  WHERE metric = 'Lost margin, annualised ($)'
UNION ALL SELECT 'Regular-price margin opportunity / yr ($)', 0.0, round(sum(annual_margin_gain), 4),
  '= ' || CAST(CAST(round(sum(annual_margin_gain) / (sum(margin_now) * 365) * 100) AS INTEGER) AS VARCHAR)
  || '% of the margin at regular prices, at most' FROM recs
UNION ALL SELECT 'Loss-making promo depth-category combos', NULL, CAST(count(*) FILTER (incremental_margin < 0) AS DOUBLE),
  'of ' || CAST(count(*) AS VARCHAR) || ' combinations' FROM promo""")


@register("executive_summary", SUMMARY_SQL)
def _(spark, d):
    return rounded(R.dashboard_summary(summary(spark, d)), 4)


# ------------------------------------------------------------------ dashboards
@register("dashboard_leaderboard", query("board", """
SELECT model, round(wape * 100, 1) AS wape_pct, round(bias * 100, 1) AS bias_pct, round(vn1, 3) AS vn1
FROM board WHERE grain = 'weekly_store_sku' ORDER BY vn1"""))
def _(spark, d):
    return R.dashboard_leaderboard(BT.leaderboard(scored(spark, d)))


@register("dashboard_actual_vs_forecast", query("sc", """
SELECT CAST(date_trunc('week', date) AS DATE) AS week, category, model, round(sum(actual), 4) AS actual, round(sum(forecast), 4) AS forecast
FROM sc WHERE model IN ('naive_dow_avg', 'seasonal_naive') GROUP BY ALL ORDER BY week"""))
def _(spark, d):
    return rounded(R.dashboard_actual_forecast(forecasts(spark, d), [RULE, REPEAT]), 4)


@register("dashboard_segments", query("sc", f"""
SELECT model, segment, round(wape * 100, 1) AS wape_pct FROM ({metrics_by('model, segment', 'sc')})"""))
def _(spark, d):
    return R.dashboard_segments(M.evaluate(scored(spark, d), ["model", "segment"]))


@register("dashboard_frontier", query("costs", """
SELECT policy, target_service, round(fill_rate, 6) AS fill_rate, round(avg_inventory_value, 2) AS avg_inventory_value,
       round(total_cost, 2) AS total_cost FROM costs"""))
def _(spark, d):
    t = R.dashboard_frontier(policy_costs(spark, d))
    return t.select("policy", "target_service", F.round("fill_rate", 6).alias("fill_rate"),
                    F.round("avg_inventory_value", 2).alias("avg_inventory_value"), F.round("total_cost", 2).alias("total_cost"))


@register("dashboard_promo_margin", query("promo", "SELECT category, depth, round(incremental_margin, 4) AS incremental_margin FROM promo"))
def _(spark, d):
    return rounded(R.dashboard_promo(promo_economics(spark, d)), 4)


@register("dashboard_health", query("health", """
SELECT week, category, status, round(wape * 100, 1) AS wape_pct, round(bias * 100, 1) AS bias_pct FROM health ORDER BY week DESC"""))
def _(spark, d):
    return R.dashboard_health(health(spark, d))


@register("dashboard_actions", query("replenish", """
SELECT store_id, sku_id, round(demand_l_plus_r, 1) AS expected_demand, round(safety_stock, 1) AS safety_stock, order_up_to
FROM replenish ORDER BY order_up_to DESC"""))
def _(spark, d):
    return R.dashboard_actions(I.replenishment(intervals(spark, d)))
