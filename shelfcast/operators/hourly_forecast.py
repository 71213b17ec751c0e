"""Seven-day forecaster of the hourly half and its scoring views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions import arrays as A
from shelfcast.functions.metrics import hourly_metrics
from shelfcast.operators.booster import MODEL, BoosterModel, BoosterParams, BoosterSet, fit_boosters
from shelfcast.schemas import (HOURLY_CATEGORIES, HOURLY_HORIZON, HOURLY_KNOWN, HOURLY_LAGS, OPEN_HOURS, PANEL_KEY,
                               VIEWS)

PARAMS = BoosterParams(variance_power=1.2, rounds=30, min_rows=20)


def forecast_features(lags: list[int] = HOURLY_LAGS) -> list[str]:
    return [*HOURLY_CATEGORIES, "product_id", *HOURLY_KNOWN, *[f"lag_{n}" for n in lags],
            "rmean_7", "rmean_14", "rmean_28", "rstd_14", "dow_mean", "oos_rate_14", "dow", "dom", "disc_depth"]


def build_frames(panel: DataFrame, targets: dict[str, Column], lags: list[int] = HOURLY_LAGS, horizon: int = HOURLY_HORIZON,
                 by: list[str] | None = None) -> DataFrame:
    """Leakage-safe inputs for several targets: everything about a target and stock-outs ends ``horizon`` rows back.

    One window over each series (of each ``by``) serves all targets; then every row stands once per target, named in
    ``target``. Lags count rows, not days: this panel's calendar is not completed, so a gap shifts them.
    """
    w = Window.partitionBy(*(by or []), *PANEL_KEY).orderBy("day")

    def back(n: int) -> Window:
        return w.rowsBetween(-(horizon + n - 1), -horizon)

    names = list(targets)
    df = panel.withColumns({**{f"y__{k}": targets[t] for k, t in enumerate(names)}, "oos_hours": A.empty_hours("hours_stock_status")})
    own = {}
    for k in range(len(names)):
        y = f"y__{k}"
        own |= {f"lag_{n}__{k}": F.lag(y, n).over(w) for n in lags}
        own |= {f"rmean_{n}__{k}": F.avg(y).over(back(n)) for n in (7, 14, 28)}
        own[f"rstd_14__{k}"] = F.stddev_samp(y).over(back(14))
    df = df.withColumns({**own, "oos_rate_14": F.avg("oos_hours").over(back(14)) / OPEN_HOURS,
                         "dow": F.weekday("dt"), "dom": F.dayofmonth("dt"), "disc_depth": 1 - F.col("discount")})
    made = ["y", *[f"lag_{n}" for n in lags], "rmean_7", "rmean_14", "rmean_28", "rstd_14"]
    kept = [c for c in df.columns if c not in own and c not in {f"y__{k}" for k in range(len(names))}]
    rows = F.array(*[F.struct(F.lit(t).alias("target"), *[F.col(f"{c}__{k}").alias(c) for c in made]) for k, t in enumerate(names)])
    df = df.select(*kept, F.inline(rows))
    known = F.filter(F.array(*[F.col(f"lag_{n}") for n in lags]), lambda v: v.isNotNull())
    return df.withColumn("dow_mean", F.try_divide(A.total(known), F.size(known).cast("double")))


def build_frame(panel: DataFrame, target: Column, lags: list[int] = HOURLY_LAGS, horizon: int = HOURLY_HORIZON) -> DataFrame:
    """``build_frames`` of one target."""
    return build_frames(panel, {"y": target}, lags, horizon).drop("target")


def fit_predict_many(frame: DataFrame, by: str, n_models: int, cutoff: Column, lags: list[int] = HOURLY_LAGS, horizon: int = HOURLY_HORIZON,
                     params: BoosterParams = PARAMS, known_lag: int | None = None) -> tuple[DataFrame, BoosterSet]:
    """Fit model ``by`` up to its rows' cutoff on rows whose longest lag is known; predict the next days. All models share their passes.

    Histories shorter than the longest lag name a lag that must be known (``known_lag``); longer ones may be missing.
    """
    must = max(lags) if known_lag is None else known_lag
    train = frame.where((F.col("day") <= cutoff) & F.col(f"lag_{must}").isNotNull())
    test = frame.where((F.col("day") > cutoff) & (F.col("day") <= cutoff + horizon))
    models = fit_boosters(train, by, n_models, forecast_features(lags), "y", [*PANEL_KEY, "day"],
                          [*HOURLY_CATEGORIES, "product_id"], params, encoded=["store_id", "product_id"])
    return models.transform(test, by, "pred"), models


def fit_predict(frame: DataFrame, cutoff: int, lags: list[int] = HOURLY_LAGS, horizon: int = HOURLY_HORIZON,
                params: BoosterParams = PARAMS, known_lag: int | None = None) -> tuple[DataFrame, BoosterModel]:
    """``fit_predict_many`` of one model."""
    out, models = fit_predict_many(frame.withColumn(MODEL, F.lit(0)), MODEL, 1, F.lit(cutoff), lags, horizon, params, known_lag)
    return out.drop(MODEL), models[0]


def score_views(predictions: DataFrame, by: list[str], recovered: str | None = "recovered_truth",
                recovered_alt: str | None = "rec_profile", groups: bool = True, clean: Column | None = None) -> DataFrame:
    """WAPE, bias and VN1 per ``by`` under each view of the truth.

    Every prediction is copied once into each view it counts in: A in-stock days, B raw sales, C and
    C2 recovered demand, and A and C again for high- and low-sale series. ``clean`` says which days are in stock.
    """
    clean = A.is_clean("hours_stock_status") if clean is None else clean

    def view(name: Column | str, truth: str, when: Column | None = None) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        s = F.struct(label.alias("eval_view"), F.col(truth).alias("truth"))
        return s if when is None else F.when(when, s)

    views = [view(VIEWS["A"], "observed", clean), view(VIEWS["B"], "observed")]
    if recovered:
        views.append(view(VIEWS["C"], recovered))
    if recovered_alt:
        views.append(view(VIEWS["C2"], recovered_alt))
    if groups:
        views.append(view(F.concat(F.lit("A, "), "sale_group", F.lit(" series")), "observed", clean))
        if recovered:
            views.append(view(F.concat(F.lit("C, "), "sale_group", F.lit(" series")), recovered))
    return (predictions.withColumn("v", F.explode(F.filter(F.array(*views), lambda x: x.isNotNull())))
            .groupBy(*by, F.col("v.eval_view").alias("eval_view"))
            .agg(*hourly_metrics("v.truth", "pred")))


def own_target_ratio(predictions: DataFrame, by: list[str], own_truth: str = "own_truth") -> DataFrame:
    """What each target summed to over what was predicted: next week's calibration multiplier."""
    return predictions.groupBy(*by).agg(
        (F.sum(own_truth) / F.greatest(F.sum("pred"), F.lit(1e-9))).alias("multiplier"))


def with_calibration(predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """The predictions plus a scaled copy, labelled so, for every target (and fold, if ``scales`` has folds) with a multiplier.

    ``scales`` has one row per training target (three at most) and fold.
    """
    on = ["target", *[c for c in ("cutoff_day",) if c in scales.columns]]
    scaled = (predictions.join(F.broadcast(scales.select(*on, "multiplier")), on)
              .withColumn("pred", F.col("pred") * F.col("multiplier"))
              .withColumn("training_target", F.concat("training_target", F.lit(" x ratio")))
              .drop("multiplier"))
    return predictions.unionByName(scaled.select(*predictions.columns))


def horizon_table(predictions: DataFrame, cutoff: int | Column, truth: str = "recovered_truth") -> DataFrame:
    """Scores by days ahead against recovered demand."""
    at = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    return (predictions.groupBy(at.alias("cutoff_day"), "training_target", (F.col("day") - at).alias("horizon_days"))
            .agg(*hourly_metrics(truth, "pred")))
