"""Queries whose result comes from fitting, so that no SQL states it exactly."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.catalog import hourly
from shelfcast.catalog.ctes import ETS_GIVEN, HOURLY_SQL, cols, query
from shelfcast.catalog.registry import register, rounded
from shelfcast.functions import metrics as M
from shelfcast.operators import features as FE
from shelfcast.operators import pricing as P
from shelfcast.operators import recovery as R
from shelfcast.operators.booster import BoosterModel, load_booster
from shelfcast.operators.ets import ets
from shelfcast.functions import arrays as A
from shelfcast.plans import backtest as BT
from shelfcast.plans import daily as DP
from shelfcast.plans import hourly_backtest as HB
from shelfcast.plans import reports
from shelfcast.schemas import PANEL_KEY
from shelfcast.session import shared_folder, written_once
from shelfcast.sources import fixtures as X

# All folds, all models and the library's own parameters.
DAILY = DP.PARAMS
# events span 30 days: before the warm-up week only the first lag is known, and longer ones are missing inputs
HOURLY = HB.HourlySettings(known_lag=7, min_days=hourly.MIN_DAYS)


def daily_run(spark, d, part: str) -> DataFrame:
    """Forecasts of all folds with ETS, Croston, the weekday rules and the mix, the last fold's importance, and the place of
    the saved model of all history: one fit, its tables written on first use of any."""
    made = {}

    def build(name: str) -> DataFrame:
        if not made:
            gold, cuts = X.gold(spark, d), X.cutoffs(spark, d)
            models = DP.fit_folds(gold, [*cuts, X.bounds(spark, d)[1]], DAILY)
            champion = models[len(cuts)]
            path = f"{shared_folder(spark)}/champion-{uuid.uuid4().hex}"
            champion.save(path)
            made.update(forecasts=DP.run_backtest(gold, cuts, params=DAILY, models=models)[0], importance=models[len(cuts) - 1].importance(),
                        champion=spark.createDataFrame([(path, champion.features, list(champion.encodings))], "path string, features array<string>, encoded array<string>"))
        return made[name]

    tables = {n: written_once(spark, d, f"daily_{n}", lambda n=n: build(n)) for n in ("forecasts", "importance", "champion")}
    return tables[part]


def boosted_backtest(spark, d) -> DataFrame:
    return daily_run(spark, d, "forecasts")


def champion(spark, d) -> BoosterModel:
    """The model of all history, saved and loaded again as a scoring job would."""
    at = daily_run(spark, d, "champion").first()
    return load_booster(spark, at["path"], at["features"], at["encoded"])


@register("ets_forecasts")
def _(spark, d):
    return rounded(ets(X.silver(spark, d), X.segments(spark, d), X.cutoffs(spark, d)))


@register("ets_given_weights", query("ets_given", f"SELECT {cols('store_id, sku_id, date, fold, model', 'forecast')} FROM ets_given"))
def _(spark, d):
    return rounded(ets(X.silver(spark, d), X.segments(spark, d), X.cutoffs(spark, d), given=ETS_GIVEN))


@register("boosted_backtest_accuracy")
def _(spark, d):
    return rounded(M.evaluate(BT.scored(boosted_backtest(spark, d)), ["model"]))


@register("boosted_feature_importance")
def _(spark, d):
    return rounded(daily_run(spark, d, "importance"))


@register("next_28_days")
def _(spark, d):
    frame = FE.make_future_frame(X.silver(spark, d), products=X.products(spark, d))
    future = FE.build_features(frame, X.products(spark, d), X.stores(spark, d), X.segments(spark, d), X.HOLIDAYS)
    return rounded(DP.score_future(champion(spark, d), future, X.bounds(spark, d)[1], boosted_backtest(spark, d)))


@register("boosted_leaderboard")
def _(spark, d):
    return rounded(BT.leaderboard(BT.scored(boosted_backtest(spark, d))))


def response(spark, d) -> DataFrame:
    return written_once(spark, d, "price_response", lambda: P.estimate_response(X.gold(spark, d)))


@register("price_response")
def _(spark, d):
    return rounded(response(spark, d))


@register("price_response_without_trend")
def _(spark, d):
    return rounded(P.estimate_response(X.gold(spark, d), control_trend=False))


@register("price_response_balance", query("balance", """
SELECT category, sku_id, regressor, round(total, 3) + 0.0 AS observed, round(total, 3) + 0.0 AS fitted FROM balance"""))
def _(spark, d):
    return rounded(P.response_balance(P.fitted_days(X.gold(spark, d))), 3)


@register("price_response_error")
def _(spark, d):
    truth = X.products(spark, d).select("category", F.lit(-1.5).alias("true_elasticity"), F.lit(1.4).alias("true_promo_uplift"))
    return rounded(P.compare_with_truth(response(spark, d), truth))


@register("dashboard_price_response")
def _(spark, d):
    return rounded(reports.dashboard_price_response(response(spark, d)))


@register("transplanted_masks", query("hpanel", """
SELECT t.store_id, t.product_id, t.dt, d.empty AS hidden_hours
FROM (SELECT *, CAST('0x' || substr(md5(store_id || ':' || product_id || ':' || dt || ':43'), 1, 15) AS BIGINT)
             % (SELECT count(*) FROM hpanel WHERE empty > 0) AS slot FROM hpanel WHERE empty = 0) t
JOIN (SELECT empty, row_number() OVER (ORDER BY CAST('0x' || substr(md5(store_id || ':' || product_id || ':' || dt || ':42'), 1, 15) AS BIGINT)) - 1 AS slot
      FROM hpanel WHERE empty > 0) d USING (slot)"""))
def _(spark, d):
    panel = hourly.prepared(spark, d)
    clean = A.is_clean("hours_stock_status")
    masked = R.transplant_masks(panel.where(clean), panel.where(~clean), 42)
    return masked.select(*PANEL_KEY, "dt", A.empty_hours("mask").alias("hidden_hours"))


def recovery_run(spark, d, part: str) -> DataFrame:
    """The recovered rows of all folds, or the last fold's importance, of one fit; each is written on first use of any."""
    made = {}

    def build(name: str) -> DataFrame:
        if not made:
            out, models = R.recover_folds(hourly.prepared(spark, d), HB.fold_days(hourly.cutoff(spark, d)), min_days=hourly.MIN_DAYS, params=HOURLY.recovery)
            made.update(rows=out, importance=R.recovery_importance(models[len(models.forests) - 1]))
        return made[name]

    tables = {n: written_once(spark, d, f"model_recovery_{n}", lambda n=n: build(n)) for n in ("rows", "importance")}
    return tables[part]


@register("model_recovered_demand")
def _(spark, d):
    return rounded(recovery_run(spark, d, "rows").where(F.col("cutoff_day") == hourly.cutoff(spark, d)).select(*PANEL_KEY, "dt", "observed", "rec_profile", "rec_model"))


@register("recovery_input_importance")
def _(spark, d):
    return rounded(R.importance_by_group(recovery_run(spark, d, "importance")))


@register("recovery_validation")
def _(spark, d):
    return rounded(R.validate_recovery(hourly.prepared(spark, d), hourly.cutoff(spark, d), min_days=hourly.MIN_DAYS,
                                       params=HOURLY.recovery))


@register("recovery_validation_rules", query("vmethods", f"""
SELECT method, {cols('n, n_masked_days', 'wape, wpe_bias, vn1, avg_hidden_share')}
FROM (SELECT method, {HOURLY_SQL}, count(*) AS n_masked_days, 1 - sum(visible) / greatest(sum(y), 1e-9) AS avg_hidden_share FROM vmethods GROUP BY method)"""))
def _(spark, d):
    return rounded(R.validate_recovery(hourly.prepared(spark, d), hourly.cutoff(spark, d), min_days=hourly.MIN_DAYS, with_model=False))


def walk_forward(spark, d, part: str) -> DataFrame:
    """The scores, horizon or scales of one walk-forward run; each is written on first use of any."""
    made = {}

    def build(name: str) -> DataFrame:
        if not made:
            scores, horizon, scales, _ = HB.run_backtest(hourly.prepared(spark, d), hourly.cutoff(spark, d), HOURLY, recovery_run(spark, d, "rows"))
            made.update(scores=scores, horizon=horizon, scales=scales)
        return made[name]

    tables = {n: written_once(spark, d, f"walk_forward_{n}", lambda n=n: build(n)) for n in ("scores", "horizon", "scales")}
    return tables[part]


@register("hourly_walk_forward")
def _(spark, d):
    return rounded(walk_forward(spark, d, "scores"))


@register("walk_forward_horizon")
def _(spark, d):
    return rounded(walk_forward(spark, d, "horizon"))


@register("walk_forward_scales")
def _(spark, d):
    return rounded(walk_forward(spark, d, "scales"))
