"""The learned side of the daily half: boosted backtest, champion model and 28-day scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.baselines import croston_sba, weekday_repeats
from shelfcast.operators.booster import MODEL as MODEL_NO
from shelfcast.operators.booster import BoosterModel, BoosterParams, BoosterSet, fit_booster, fit_boosters
from shelfcast.operators.ets import ets
from shelfcast.operators.features import feature_columns
from shelfcast.operators.inventory import error_spread, forecast_intervals
from shelfcast.plans.backtest import attach_actuals, ensemble, in_test_window, training_rows
from shelfcast.schemas import CATEGORICALS, HORIZON, KEYS, SERIES
from shelfcast.session import cut_lineage

MODEL = "gbm_global"
PARAMS = BoosterParams(variance_power=1.2, rounds=40, max_depth=6, min_rows=50)


def fit_global(gold: DataFrame, cutoff: dt.date | None = None, params: BoosterParams = PARAMS) -> BoosterModel:
    """One model over all series, trained on uncensored days whose 28-day lag is known."""
    return fit_booster(training_rows(gold, cutoff), feature_columns(gold), "demand_target", KEYS, CATEGORICALS, params, encoded=SERIES)


def statistical_forecasts(gold: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON) -> DataFrame:
    """The four per-series models for all folds, from one pass of the history each."""
    segments = gold.select(*SERIES, "segment").distinct()
    return (weekday_repeats(gold, cutoffs, horizon)
            .unionByName(croston_sba(gold, cutoffs, horizon))
            .unionByName(ets(gold, segments, cutoffs, horizon)))


def _for_folds(rows: DataFrame, conditions: list) -> DataFrame:
    """Each row once for every fold whose condition holds; MODEL_NO counts folds from 0."""
    folds = F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(conditions)])
    return rows.withColumn(MODEL_NO, F.explode(F.filter(folds, lambda k: k.isNotNull())))


def fit_folds(gold: DataFrame, cutoffs: list[dt.date], params: BoosterParams = PARAMS) -> BoosterSet:
    """The boosted models of all folds, grown together: one pass of the rows serves every fold.

    A last cutoff at the end of history makes the model that scores the days ahead.
    """
    rows = _for_folds(training_rows(gold), [F.col("date") <= F.lit(c) for c in cutoffs])
    return fit_boosters(rows, MODEL_NO, len(cutoffs), feature_columns(gold), "demand_target", KEYS, CATEGORICALS, params, encoded=SERIES)


def global_forecasts(gold: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON,
                     params: BoosterParams = PARAMS, models: BoosterSet | None = None) -> tuple[DataFrame, BoosterSet]:
    """The boosted model per fold: fitted up to the cutoff (or given), predicting the days after it."""
    models = models or fit_folds(gold, cutoffs, params)
    tests = _for_folds(gold, [in_test_window(c, horizon) for c in cutoffs])
    out = models.transform(tests, MODEL_NO, "forecast")
    return out.select(*KEYS, (F.col(MODEL_NO) + 1).alias("fold"), F.lit(MODEL).alias("model"), "forecast"), models


def run_backtest(gold: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON, with_statistical: bool = True,
                 params: BoosterParams = PARAMS, models: BoosterSet | None = None) -> tuple[DataFrame, BoosterSet]:
    """All models over all folds with actuals; the ensemble mixes the booster and ETS 70:30."""
    fc, models = global_forecasts(gold, cutoffs, horizon, params, models)
    if with_statistical:
        # the ensemble reads the forecasts a second time, and every branch is expensive to repeat
        fc = cut_lineage(fc.unionByName(statistical_forecasts(gold, cutoffs, horizon)))
        fc = fc.unionByName(ensemble(fc, MODEL, "ets"))
    return attach_actuals(fc, gold), models


def score_future(model: BoosterModel, future_gold: DataFrame, last_history_day, forecasts: DataFrame,
                 version: str = "1", name: str = MODEL) -> DataFrame:
    """P10, P50 and P90 for every day after the history, from the backtest's error spread."""
    ahead = future_gold.where(F.col("date") > F.lit(last_history_day))
    points = model.transform(ahead, "p50").select(*KEYS, "p50")
    return (forecast_intervals(points, error_spread(forecasts, name))
            .withColumn("model_version", F.lit(version)))
