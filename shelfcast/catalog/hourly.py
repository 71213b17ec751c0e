"""Queries of the hourly half."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog.ctes import HOURLY_SQL, cols, query
from shelfcast.catalog.registry import register, rounded
from shelfcast.functions import arrays as A
from shelfcast.functions.metrics import hourly_metrics
from shelfcast.operators import hourly as H
from shelfcast.operators import hourly_forecast as HF
from shelfcast.plans import hourly_backtest as HB
from shelfcast.plans import hourly_reports as HR
from shelfcast.schemas import PANEL_KEY, TARGETS, VIEWS
from shelfcast.session import shared_folder, written_once
from shelfcast.sources import fixtures as X
from shelfcast.sources import tables as T

KEY = "store_id, product_id, dt"
MIN_DAYS = 20  # of 23 training days, so that every fallback level of the profiles occurs
LAGS = [7, 14]  # the events span 30 days
COL = "rec_profile"


def prepared(spark, d) -> DataFrame:
    return H.prepare(*X.hourly_splits(spark, d))


def cutoff(spark, d) -> int:
    return H.last_train_day(X.hourly_splits(spark, d)[0])


def recovered(spark, d) -> DataFrame:
    return written_once(spark, d, "recovered",
                        lambda: H.recover_by_profile(prepared(spark, d), cutoff(spark, d), MIN_DAYS))


def loss_table(spark, d) -> DataFrame:
    return HR.recovered_table(recovered(spark, d), cutoff(spark, d))


def framed(spark, d) -> DataFrame:
    cut = cutoff(spark, d)
    target = F.when(F.col("day") > cut, F.col("observed")).otherwise(F.col("rec_profile"))
    return HF.build_frame(H.sale_groups(recovered(spark, d), cut), target, LAGS)


def simple_predictions(spark, d, weeks_back: int = 0) -> DataFrame:
    """Two fixed predictors for the week after the cutoff, or for one before, as the learned forecasters give them."""
    def build():
        cut = cutoff(spark, d) - 7 * weeks_back
        rows = framed(spark, d).where((F.col("day") > cut) & (F.col("day") <= cut + 7))
        # a second recovered truth beside the profile's: the series' level on days with a stock-out
        by_level = F.greatest("observed", F.when(A.is_clean("hours_stock_status"), F.col("observed")).otherwise(F.col("level")))
        choices = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(TARGETS[t]).alias("training_target"),
                                     F.col(own).alias("own_truth"), F.col(p).alias("pred"))
                            for t, own, p in (("observed", "observed", "rmean_7"), ("rec_profile", "rec_profile", "dow_mean"))])
        return (rows.withColumn("c", F.explode(choices))
                .select("c.target", "c.training_target", "store_id", "product_id", "day", "observed",
                        by_level.alias("recovered_truth"), "rec_profile", "hours_stock_status", "sale_group",
                        "c.own_truth", "c.pred"))
    return written_once(spark, d, f"simple_predictions_{weeks_back}", build)


def learned_ratio(spark, d) -> DataFrame:
    """Multipliers from the week before the one they are applied to."""
    return HF.own_target_ratio(simple_predictions(spark, d, weeks_back=1), ["target"])


def variants(spark, d) -> DataFrame:
    return HF.with_calibration(simple_predictions(spark, d), learned_ratio(spark, d))


# ------------------------------------------------------------------ panel
@register("hourly_panel_days", query("hpanel", f"""
SELECT {KEY}, city_id, management_group_id, first_category_id, second_category_id, third_category_id, empty AS stock_hour6_22_cnt,
       {cols('holiday_flag, activity_flag', 'observed, discount, precpt, avg_temperature, avg_humidity')} FROM hpanel"""))
def _(spark, d):
    return rounded(X.hourly_panel(spark, d).select(
        *PANEL_KEY, "dt", "city_id", "management_group_id", "first_category_id", "second_category_id",
        "third_category_id", "stock_hour6_22_cnt", "holiday_flag", "activity_flag", F.col("sale_amount").alias("observed"),
        "discount", "precpt", "avg_temperature", "avg_humidity"))


@register("panel_key_list", query("hpanel", "SELECT DISTINCT store_id, product_id FROM hpanel"))
def _(spark, d):
    return T.panel_keys(X.hourly_panel(spark, d))


@register("panel_for_keys", query("hpanel", f"""
SELECT {KEY}, round(observed, 6) AS observed FROM hpanel h
WHERE EXISTS (SELECT 1 FROM hpanel k WHERE k.store_id = h.store_id AND k.activity_flag = 1 AND k.precpt > 0.5)"""))
def _(spark, d):
    panel = X.hourly_panel(spark, d)
    keys = panel.where("activity_flag = 1 AND precpt > 0.5").select(*PANEL_KEY).distinct()
    kept = T.normalise_panel(T.keep_keys(panel, keys))
    return rounded(kept.select(*PANEL_KEY, "dt", A.total("hours_sale").alias("observed")))


@register("panel_read_for_keys", query("hpanel store_sample", f"""
SELECT {KEY}, round(observed, 6) AS observed FROM hpanel JOIN store_sample USING (store_id, product_id)"""))
def _(spark, d):
    path = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    panel = X.hourly_panel(spark, d)
    T.write_table(panel, path, range_by=["store_id"], sort_by=PANEL_KEY)
    loaded = T.load_panel(spark, path, T.sample_stores(T.panel_keys(panel), 40))
    return rounded(loaded.select(*PANEL_KEY, "dt", A.total("hours_sale").alias("observed")))


@register("fixed_width_lists", query("hours", """
SELECT store_id, dt, CAST(24 AS INTEGER) AS width, round(sum(v), 6) AS total, round(coalesce(max(v) FILTER (n = 1), 0), 6) AS first_item
FROM (SELECT store_id, dt, coalesce(sold, 0) AS v, row_number() OVER (PARTITION BY store_id, dt ORDER BY h) AS n FROM hours)
GROUP BY store_id, dt"""))
def _(spark, d):
    ev = X.table(spark, d, "events")
    value = F.sum(F.when(F.col("event_type") != "error", F.col("value")))
    hours = ev.groupBy(F.col("user_id").alias("store_id"), F.col("ts").cast("date").alias("dt"), F.hour("ts").alias("h")).agg(
        F.coalesce(value, F.lit(0.0)).alias("v"))
    # at most 24 items per list, one per hour of the day
    short = hours.groupBy("store_id", "dt").agg(F.array_sort(F.collect_list(F.struct("h", "v"))).alias("items"))
    wide = short.withColumn("wide", T.fixed_width(F.transform("items", lambda s: s["v"])))
    return rounded(wide.select("store_id", "dt", F.size("wide").alias("width"), A.total("wide").alias("total"),
                               F.get("wide", F.lit(0)).alias("first_item")))


@register("joined_splits", query("hpanel", "SELECT split, count(*) AS n, round(sum(observed), 4) AS observed FROM hpanel GROUP BY split"))
def _(spark, d):
    both = T.concat_splits(*X.hourly_splits(spark, d))
    return rounded(both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("sale_amount").alias("observed")), 4)


@register("sampled_stores", query("store_sample", "SELECT store_id, product_id FROM store_sample"))
def _(spark, d):
    keys = T.panel_keys(X.hourly_panel(spark, d))
    return T.sample_stores(keys, 40)


@register("stock_flag_orientation", query("hpanel", """
SELECT round(s1 / n1, 6) + 0.0 AS mean_sales_when_flag1, round(s0 / n0, 6) AS mean_sales_when_flag0, s1 / n1 > s0 / n0 AS flipped,
       round(agree, 6) AS share_rows_matching_stock_hour6_22_cnt
FROM (SELECT sum(list_sum(list_transform(range(1, 25), lambda i: sales[i] * oos[i]))) AS s1, sum(list_sum(oos)) AS n1,
             sum(list_sum(list_transform(range(1, 25), lambda i: sales[i] * (1 - oos[i])))) AS s0, sum(24 - list_sum(oos)) AS n0,
             avg(CAST(list_sum(oos[7:22]) = empty AS DOUBLE)) AS agree
      FROM hpanel WHERE split = 'train')"""))
def _(spark, d):
    return rounded(H.orientation(X.hourly_splits(spark, d)[0]))


@register("flipped_flags_restored", query("hpanel", f"SELECT {KEY}, split, day, empty AS oos_hours FROM hpanel"))
def _(spark, d):
    train, evaluation = X.hourly_splits(spark, d)
    turned = [s.withColumn("hours_stock_status", A.flip("hours_stock_status")) for s in (train, evaluation)]
    return H.prepare(*turned).select(*PANEL_KEY, "dt", "split", "day", A.empty_hours("hours_stock_status").alias("oos_hours"))


@register("day_index_and_clean_days", query("hpanel", f"""
SELECT {KEY}, split, day, empty = 0 AS is_clean, round(observed, 6) AS observed FROM hpanel"""))
def _(spark, d):
    p = prepared(spark, d)
    return rounded(p.select(*PANEL_KEY, "dt", "split", "day", A.is_clean("hours_stock_status").alias("is_clean"),
                            A.total("hours_sale").alias("observed")))


# ------------------------------------------------------------------ recovery
PROFILE_SQL = ", ".join(f"round(profile[{h + 1}], 6) + 0.0 AS p{h}" for h in range(24))


@register("hourly_profiles", query("profiled", f"""
SELECT DISTINCT store_id, product_id, CAST(profile_level AS INTEGER) AS profile_level, {PROFILE_SQL} FROM profiled"""))
def _(spark, d):
    fit = A.is_clean("hours_stock_status") & (F.col("day") <= cutoff(spark, d))
    t = H.profile_table(prepared(spark, d), fit, MIN_DAYS)
    return rounded(t.select(*PANEL_KEY, "profile_level", *[F.get("profile", F.lit(h)).alias(f"p{h}") for h in range(24)]))


@register("series_levels", query("profiled", f"SELECT {KEY}, round(level, 6) AS level FROM profiled"))
def _(spark, d):
    return rounded(recovered(spark, d).select(*PANEL_KEY, "dt", "level"))


@register("in_stock_share", query("shared", f"SELECT {KEY}, round(share_in, 6) + 0.0 AS share_in FROM shared"))
def _(spark, d):
    r = recovered(spark, d)
    return rounded(r.select(*PANEL_KEY, "dt", A.share_in_stock("profile", "hours_stock_status").alias("share_in")))


@register("profile_recovery", query("recovered", f"SELECT {cols(KEY, 'observed, rec_profile')} FROM recovered"))
def _(spark, d):
    return rounded(recovered(spark, d).select(*PANEL_KEY, "dt", "observed", "rec_profile"))


@register("empty_shelf_hours", query("shared", f"SELECT {KEY}, empty AS oos_hours, first_oos_hour, last_oos_hour FROM shared"))
def _(spark, d):
    flags = "hours_stock_status"
    return prepared(spark, d).select(*PANEL_KEY, "dt", A.empty_hours(flags).alias("oos_hours"),
                                     A.first_empty_hour(flags).alias("first_oos_hour"),
                                     A.last_empty_hour(flags).alias("last_oos_hour"))


@register("hidden_hours", query("hpanel", f"""
SELECT {KEY}, round(list_sum(list_transform(range(1, 25), lambda i: sales[i] * (1 - oos[25 - i]))), 6) + 0.0 AS visible FROM hpanel
WHERE list_sum(list_reverse(oos)[7:22]) > 0"""))
def _(spark, d):
    masked = prepared(spark, d).withColumn("mask", F.reverse("hours_stock_status")).where(A.empty_hours("mask") > 0)
    return rounded(masked.select(*PANEL_KEY, "dt", A.total(A.hide("hours_sale", "mask")).alias("visible")))


@register("recovery_inputs", query("shared", f"""
SELECT {KEY}, empty AS oos_hours, first_oos_hour, last_oos_hour, CAST(isodow(dt) - 1 AS INTEGER) AS dow,
       {cols('holiday_flag, activity_flag', 'observed, share_in, level, discount, precpt, avg_temperature')},
       round(CASE WHEN share_in >= 0.05 THEN observed / share_in ELSE level END, 6) AS profile_est FROM shared"""))
def _(spark, d):
    x = H.recovery_features(recovered(spark, d))
    names = ["oos_hours", "first_oos_hour", "last_oos_hour", "dow", "holiday_flag", "activity_flag", "observed", "share_in",
             "level", "discount", "precpt", "avg_temperature", "profile_est"]
    return rounded(x.select(*PANEL_KEY, "dt", *[F.col(f"x_{n}").alias(n) for n in names]))


@register("sale_groups", query("grouped", f"SELECT {KEY}, sale_group FROM grouped"))
def _(spark, d):
    return H.sale_groups(prepared(spark, d), cutoff(spark, d)).select(*PANEL_KEY, "dt", "sale_group")


# ------------------------------------------------------------------ reports
@register("stockout_summary", query("hpanel cut", """
SELECT metric, round(value, 6) AS value FROM (
  SELECT CAST(count(*) AS DOUBLE) AS a, avg(CAST(empty > 0 AS DOUBLE)) AS b, 1 - avg(empty) / 16 AS c,
         avg(empty) FILTER (empty > 0) AS d, avg(observed) FILTER (empty > 0) AS e, avg(observed) FILTER (empty = 0) AS f
  FROM hpanel, cut WHERE day <= cutoff), LATERAL (VALUES ('store-product-days (train)', a),
  ('days_with_gap_share', b), ('open_hours_in_stock', c),
  ('gap_hours_per_gap_day', d), ('sold_per_gap_day', e), ('sold_per_full_day', f)) v(metric, value)"""))
def _(spark, d):
    return rounded(HR.stockout_summary(prepared(spark, d), cutoff(spark, d)))


@register("hourly_shape", query("hpanel cut", """
SELECT CAST(h AS INTEGER) AS hour,
       round(sum(sales[h + 1]) FILTER (empty = 0) / sum(observed) FILTER (empty = 0), 6) + 0.0 AS sales_share,
       round(avg(oos[h + 1]), 6) AS oos_rate
FROM hpanel, cut, (SELECT unnest(range(0, 24)) AS h) WHERE day <= cutoff GROUP BY h"""))
def _(spark, d):
    return rounded(HR.hourly_shape(prepared(spark, d), cutoff(spark, d)))


@register("weekly_trend", query("hpanel", """
SELECT week, split, days, round(avg_sales, 6) AS avg_daily_sales, round(share, 6) AS stockout_day_share,
       round((avg_sales / (avg(avg_sales) FILTER (week < 4) OVER ()) - 1) * 100, 6) + 0.0 AS vs_first_4_weeks_pct
FROM (SELECT CAST(day // 7 AS INTEGER) AS week, split, count(*) AS days, avg(observed) AS avg_sales,
             avg(CAST(empty > 0 AS DOUBLE)) AS share FROM hpanel GROUP BY ALL)"""))
def _(spark, d):
    return rounded(HR.weekly_trend(prepared(spark, d)))


@register("example_series_hours", query("hpanel cut", """
SELECT store_id, product_id, dt, CAST(h AS INTEGER) AS hour, round(sales[h + 1], 6) AS sales, oos[h + 1] AS out_of_stock
FROM (SELECT * FROM hpanel, cut WHERE day <= cutoff AND store_id = (
        SELECT min(store_id) FROM (SELECT store_id, avg(CAST(empty > 0 AS DOUBLE)) AS s FROM hpanel GROUP BY store_id)
        WHERE s > 0.25 AND s < 0.6)
      QUALIFY row_number() OVER (ORDER BY day DESC) <= 7), (SELECT unnest(range(0, 24)) AS h)"""))
def _(spark, d):
    return rounded(HR.example_series(prepared(spark, d), cutoff(spark, d)))


@register("recovered_demand_table", query("rtable", f"""
SELECT {KEY}, day, first_category_id, third_category_id, oos_hours, first_oos_hour, {cols('', 'observed, rec_profile')} FROM rtable"""))
def _(spark, d):
    return rounded(loss_table(spark, d))


@register("recovery_summary", query("rtable", """
SELECT metric, round(value, 4) AS value FROM (
  SELECT CAST(count(*) FILTER (oos_hours > 0) AS DOUBLE) AS a, sum(observed) FILTER (oos_hours > 0) AS b,
         sum(rec_profile) FILTER (oos_hours > 0) AS c, (sum(rec_profile) - sum(observed)) / sum(rec_profile) * 100 AS d FROM rtable),
  LATERAL (VALUES ('gap_days', a), ('sold_on_gap_days', b), ('demand_by_profile', c),
                  ('lost_pct_of_demand', d)) v(metric, value)"""))
def _(spark, d):
    return rounded(HR.recovery_summary(loss_table(spark, d), COL), 4)


for _name, _key in (("lost_demand_by_category", "first_category_id"), ("lost_demand_by_store", "store_id")):
    @register(_name, query("rtable", f"""
SELECT {_key}, round(sum(rec_profile), 4) AS recovered, round(sum(rec_profile - observed), 4) + 0.0 AS lost,
       round(avg(oos_hours), 4) AS oos_hours, round(sum(rec_profile - observed) / sum(rec_profile), 4) + 0.0 AS lost_share,
       round(1 - avg(oos_hours) / 16, 4) AS availability FROM rtable GROUP BY {_key}"""))
    def _(spark, d, _key=_key):
        return rounded(HR.lost_by(loss_table(spark, d), _key, COL), 4)


@register("lost_demand_totals", query("rtable", """
SELECT round(sum(rec_profile - observed) / sum(rec_profile), 6) AS lost_share_of_demand,
       round(avg(CAST(oos_hours > 0 AS DOUBLE)), 6) AS stockout_day_share, round(1 - avg(oos_hours) / 16, 6) AS availability_operating_hours
FROM rtable"""))
def _(spark, d):
    return rounded(HR.lost_totals(loss_table(spark, d), COL))


@register("empty_rate_by_hour", query("hpanel cut", """
SELECT CAST(h AS INTEGER) AS hour, round(avg(oos[h + 1]), 6) AS oos_rate
FROM hpanel, cut, (SELECT unnest(range(6, 22)) AS h) WHERE day <= cutoff GROUP BY h"""))
def _(spark, d):
    return rounded(HR.empty_rate_by_hour(prepared(spark, d), cutoff(spark, d)))


@register("top_losing_stores", query("rtable", """
SELECT store_id, round(sum(rec_profile - observed), 4) AS lost FROM rtable GROUP BY store_id
ORDER BY sum(rec_profile - observed) DESC, store_id LIMIT 20"""))
def _(spark, d):
    return rounded(HR.top_losers(HR.lost_by(loss_table(spark, d), "store_id", COL)).select("store_id", "lost"), 4)


@register("business_kpis", query("rtable", """
SELECT kpi, round(value, 4) AS value FROM (
  SELECT sum(rec_profile - observed) AS lost, sum(rec_profile) AS demand, sum(observed) AS sold,
         avg(CAST(oos_hours > 0 AS DOUBLE)) AS short, avg(oos_hours) AS hours,
         sum(rec_profile - observed) FILTER (first_oos_hour >= 0 AND first_oos_hour < 16) AS early FROM rtable),
  (SELECT sum(l) FILTER (rn <= greatest(1, n // 5)) / sum(l) AS top FROM (
     SELECT l, row_number() OVER (ORDER BY l DESC) AS rn, count(*) OVER () AS n
     FROM (SELECT sum(rec_profile - observed) AS l FROM rtable GROUP BY store_id))),
  LATERAL (VALUES ('lost_pct_of_demand', lost / demand * 100),
    ('gap_days_pct', short * 100), ('open_hours_in_stock_pct', (1 - hours / 16) * 100),
    ('lost_pct_in_top_fifth_of_stores', top * 100), ('lost_pct_of_sales', lost / sold * 100),
    ('uplift_pct_at_quarter_capture', 0.25 * lost / sold * 100),
    ('lost_pct_from_gaps_before_16', early / lost * 100)) v(kpi, value)"""))
def _(spark, d):
    return rounded(HR.business_kpis(loss_table(spark, d), COL), 4)


@register("lost_by_first_empty_hour", query("rtable", """
SELECT first_oos_hour, stockout_days, round(lost, 4) + 0.0 AS lost, round(avg_lost, 4) + 0.0 AS avg_lost_per_day, round(share, 4) + 0.0 AS lost_share_pct,
       round(sum(share) OVER (ORDER BY first_oos_hour), 4) + 0.0 AS cum_lost_share_pct
FROM (SELECT *, lost / sum(lost) OVER () * 100 AS share FROM (
  SELECT first_oos_hour, count(*) AS stockout_days, sum(rec_profile - observed) AS lost, avg(rec_profile - observed) AS avg_lost
  FROM rtable WHERE first_oos_hour >= 0 GROUP BY first_oos_hour))"""))
def _(spark, d):
    return rounded(HR.lost_by_first_hour(loss_table(spark, d), COL), 4)


# ------------------------------------------------------------------ forecasting
FRAME_COLS = "lag_7, lag_14, rmean_7, rmean_14, rmean_28, rstd_14, dow_mean, oos_rate_14, disc_depth"


@register("hourly_forecast_inputs", query("hframe", f"""
SELECT {cols(KEY + ', day, dow, dom', FRAME_COLS)} FROM (SELECT *, CAST(isodow(dt) - 1 AS INTEGER) AS dow,
       CAST(day(dt) AS INTEGER) AS dom, 1 - discount AS disc_depth FROM hframe)"""))
def _(spark, d):
    return rounded(framed(spark, d).select(*PANEL_KEY, "dt", "day", "dow", "dom", *FRAME_COLS.split(", ")))


@register("own_target_ratio", query("hratio", "SELECT target, round(multiplier, 6) AS multiplier FROM hratio"))
def _(spark, d):
    return rounded(learned_ratio(spark, d))


@register("calibrated_forecasts", query("hvariants", "SELECT training_target, store_id, product_id, day, round(p, 6) AS pred FROM hvariants"))
def _(spark, d):
    return rounded(variants(spark, d).select("training_target", *PANEL_KEY, "day", "pred"))


SCORE_COLS = "wape, wpe_bias, vn1"


@register("scores_by_view", query("hviews", f"""
SELECT {cols('training_target, eval_view, n', SCORE_COLS)} FROM (SELECT training_target, eval_view, {HOURLY_SQL} FROM hviews GROUP BY ALL)"""))
def _(spark, d):
    return rounded(HF.score_views(variants(spark, d), ["training_target"]))


@register("headline_scores", query("hviews", f"""
SELECT training_target, eval_view, round(wape, 6) AS wape, round(wpe_bias, 6) AS wpe_bias
FROM (SELECT training_target, eval_view, {HOURLY_SQL} FROM hviews GROUP BY ALL) WHERE regexp_matches(eval_view, '^(A|B|C|C2)\\.')"""))
def _(spark, d):
    return rounded(HB.mean_over_folds(HF.score_views(variants(spark, d), ["training_target"])))


@register("bias_by_view_pivot", query("hviews", f"""
SELECT training_target, round(max(wpe_bias) FILTER (eval_view LIKE 'A.%'), 6) AS view_a, round(max(wpe_bias) FILTER (eval_view LIKE 'B.%'), 6) AS view_b,
       round(max(wpe_bias) FILTER (eval_view LIKE 'C.%'), 6) AS view_c, round(max(wpe_bias) FILTER (eval_view LIKE 'C2.%'), 6) AS view_c2
FROM (SELECT training_target, eval_view, {HOURLY_SQL} FROM hviews GROUP BY ALL) GROUP BY training_target"""))
def _(spark, d):
    scores = HF.score_views(variants(spark, d), ["training_target"]).withColumn("cutoff_day", F.lit(0))
    wide = HB.by_view(scores, "wpe_bias", list(VIEWS.values())).drop("cutoff_day")
    return rounded(wide.toDF("training_target", "view_a", "view_b", "view_c", "view_c2"))


@register("scores_by_days_ahead", query("hvariants", f"""
SELECT cutoff_day, training_target, horizon_days, n, {cols('', SCORE_COLS)} FROM (
  SELECT CAST(cutoff AS INTEGER) AS cutoff_day, training_target, CAST(day - cutoff AS INTEGER) AS horizon_days, {HOURLY_SQL}
  FROM (SELECT cutoff, training_target, day, level_truth AS y, p AS f FROM hvariants) GROUP BY 1, 2, 3)"""))
def _(spark, d):
    return rounded(HF.horizon_table(variants(spark, d), cutoff(spark, d)))


@register("recovery_scores_by_store", query("recovered", f"""
SELECT store_id, n, {cols('', SCORE_COLS)} FROM (SELECT store_id, {HOURLY_SQL} FROM (SELECT store_id, observed AS y, rec_profile AS f FROM recovered)
GROUP BY store_id)"""))
def _(spark, d):
    return rounded(recovered(spark, d).groupBy("store_id").agg(*hourly_metrics("observed", "rec_profile")))


@register("bias_by_days_ahead_pivot", query("hvariants", f"""
SELECT training_target, {", ".join(f"round(max(wpe_bias) FILTER (k = {k}), 6) AS day_{k}" for k in range(1, 8))} FROM (
  SELECT training_target, CAST(day - cutoff AS INTEGER) AS k, {HOURLY_SQL}
  FROM (SELECT cutoff, training_target, day, level_truth AS y, p AS f FROM hvariants) GROUP BY 1, 2) GROUP BY training_target"""))
def _(spark, d):
    table = HF.horizon_table(variants(spark, d), cutoff(spark, d))
    return rounded(HB.by_days_ahead(table, "wpe_bias").toDF("training_target", *[f"day_{k}" for k in range(1, 8)]))
