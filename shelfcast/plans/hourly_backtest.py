"""Walk-forward backtest of forecasters trained on raw and on recovered demand."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import arrays as A
from shelfcast.operators import hourly_forecast as HF
from shelfcast.operators import recovery as R
from shelfcast.operators.booster import MODEL, BoosterParams
from shelfcast.operators.hourly import MIN_DAYS, sale_groups
from shelfcast.schemas import HOURLY_HORIZON, HOURLY_LAGS, PANEL_KEY, TARGETS
from shelfcast.session import cut_lineage, stored


@dataclass(frozen=True)
class HourlySettings:
    lags: tuple[int, ...] = tuple(HOURLY_LAGS)
    horizon: int = HOURLY_HORIZON
    known_lag: int | None = None
    min_days: int = MIN_DAYS
    with_model: bool = True
    recovery: BoosterParams = R.PARAMS
    forecaster: BoosterParams = HF.PARAMS


def run_backtest(panel: DataFrame, last_day: int, settings: HourlySettings = HourlySettings(), recovered: DataFrame | None = None):
    """A warm-up week that only teaches the multipliers, then two scored folds.

    All folds and targets are one table with one model each, fitted together; only multipliers go from one fold to the
    next, and they are a table of one row per fold and target. ``recovered``: the rows of ``recover_folds`` for these folds,
    if they are there already. Returns (scores, horizon, scales, recovered of the last fold).
    """
    s, week = settings, settings.horizon
    cutoffs = fold_days(last_day, week)
    if recovered is None:
        recovered, _ = R.recover_folds(panel, cutoffs, with_model=s.with_model, min_days=s.min_days, params=s.recovery)
    grouped = None
    for c in cutoffs:
        fold = sale_groups(recovered.where(F.col("cutoff_day") == c), c)
        grouped = fold if grouped is None else grouped.unionByName(fold)
    grouped = stored(grouped.withColumn("recovered_truth", F.col("rec_model" if s.with_model else "rec_profile")), "walk-forward-rows")
    targets = [t for t in TARGETS if t in grouped.columns]
    cutoff = F.col("cutoff_day")
    # labels after the cutoff are never trained on
    goals = {t: F.when(F.col("day") > cutoff, F.col("observed")).otherwise(F.col(t)) for t in targets}
    frame = HF.build_frames(grouped, goals, list(s.lags), s.horizon, by=["cutoff_day"])

    def of(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    number = of({c: k for k, c in enumerate(cutoffs)})[cutoff] * len(targets) + of({t: k for k, t in enumerate(targets)})[F.col("target")]
    own = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in targets])
    frame = stored(frame.withColumns({MODEL: number, "own_truth": own, "in_stock": A.is_clean("hours_stock_status")})
                        .drop("hours_sale", "hours_stock_status"), "walk-forward-frame")
    pred, _ = HF.fit_predict_many(frame, MODEL, len(cutoffs) * len(targets), cutoff, list(s.lags), s.horizon, s.forecaster, s.known_lag)
    predictions = stored(pred.select(
        "cutoff_day", "target", of(TARGETS)[F.col("target")].alias("training_target"), *PANEL_KEY, "day", "observed", "recovered_truth",
        "rec_profile", "in_stock", "sale_group", "own_truth", "pred"), "walk-forward-predictions")
    learned = HF.own_target_ratio(predictions, ["cutoff_day", "target"])
    scales = cut_lineage(learned.withColumn("cutoff_day", cutoff + week).where(cutoff <= cutoffs[-1]))
    variants = HF.with_calibration(predictions.where(cutoff > cutoffs[0]), scales)
    scores = HF.score_views(variants, ["training_target", "cutoff_day"], clean=F.col("in_stock"))
    return (scores, HF.horizon_table(variants, cutoff), scales.select("target", "multiplier", "cutoff_day"), recovered.where(cutoff == cutoffs[-1]))


def fold_days(last_day: int, week: int = HOURLY_HORIZON) -> list[int]:
    """The cutoffs of the warm-up fold and the two scored ones."""
    return [last_day - 2 * week, last_day - week, last_day]


def headline(scores: DataFrame) -> DataFrame:
    """Only the four main views."""
    return scores.where(F.col("eval_view").rlike(r"^(A|B|C|C2)\."))


def mean_over_folds(scores: DataFrame) -> DataFrame:
    return (headline(scores).groupBy("training_target", "eval_view")
            .agg(F.avg("wape").alias("wape"), F.avg("wpe_bias").alias("wpe_bias")))


def by_view(scores: DataFrame, metric: str, views: list[str]) -> DataFrame:
    return (headline(scores).groupBy("cutoff_day", "training_target").pivot("eval_view", views).agg(F.first(metric)))


def by_days_ahead(horizon: DataFrame, metric: str, days: int = HOURLY_HORIZON) -> DataFrame:
    """Mean of a metric over the folds, one column per day ahead."""
    return (horizon.groupBy("training_target").pivot("horizon_days", list(range(1, days + 1))).agg(F.avg(metric)))
