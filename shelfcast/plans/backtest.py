"""Rolling-origin backtest tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.metrics import evaluate, evaluate_at_level
from shelfcast.schemas import HORIZON, KEYS, SERIES

ACTUALS = ["true_demand", "segment", "category", "on_promo", "selling_price", "unit_cost"]
ENSEMBLE = "ensemble_70_30"


def test_window(df: DataFrame, cutoff: dt.date, horizon: int = HORIZON) -> DataFrame:
    """Rows of the days the fold is scored on."""
    return df.where(in_test_window(cutoff, horizon))


def in_test_window(cutoff: dt.date, horizon: int = HORIZON) -> Column:
    return (F.col("date") > F.lit(cutoff)) & (F.col("date") <= F.date_add(F.lit(cutoff), horizon))


def fold_sizes(df: DataFrame, cutoffs: list[dt.date], target: str = "demand_target", lag: str = f"lag_{HORIZON}") -> DataFrame:
    """Training and test rows of every fold, from one pass."""
    known = F.col(target).isNotNull() & F.col(lag).isNotNull()
    rows = [F.struct(F.lit(k).alias("fold"), F.lit(c).alias("cutoff"), F.count(F.when(known & (F.col("date") <= F.lit(c)), 1)).alias("train_rows"),
                     F.count(F.when(in_test_window(c), 1)).alias("test_rows")) for k, c in enumerate(cutoffs, 1)]
    return df.agg(F.array(*rows).alias("folds")).select(F.inline("folds"))


def training_rows(df: DataFrame, cutoff: dt.date | None = None, target: str = "demand_target",
                  lag: str = f"lag_{HORIZON}") -> DataFrame:
    """Rows with a known target and a full lag, up to the cutoff."""
    rows = df.where(F.col(target).isNotNull() & F.col(lag).isNotNull())
    return rows if cutoff is None else rows.where(F.col("date") <= F.lit(cutoff))


def ensemble(forecasts: DataFrame, first: str, second: str, weight: float = 0.7, name: str = ENSEMBLE) -> DataFrame:
    """Weighted mean of two models' forecasts; NULL when either is missing."""
    both = (forecasts.where(F.col("model").isin(first, second))
            .groupBy(*KEYS, "fold").pivot("model", [first, second]).agg(F.first("forecast")))
    mix = F.lit(weight) * F.col(first) + F.lit(1 - weight) * F.col(second)
    return both.select(*KEYS, "fold", F.lit(name).alias("model"), mix.alias("forecast"))


def attach_actuals(forecasts: DataFrame, gold: DataFrame) -> DataFrame:
    """What happened next to what was forecast; unmatched forecasts stay."""
    actual = gold.select(*KEYS, F.col("demand_target").alias("actual"), *[c for c in ACTUALS if c in gold.columns])
    return forecasts.join(actual, KEYS, "left")


def without_bias(forecasts: DataFrame, fold: int) -> DataFrame:
    """Forecasts of later folds less their series' and model's mean error in ``fold``, never below 0; unknown ones stay unknown."""
    by = [*SERIES, "model"]
    bias = scored(forecasts).where(F.col("fold") == fold).groupBy(*by).agg(F.avg(F.col("forecast") - F.col("actual")).alias("bias"))
    corrected = F.greatest(F.col("forecast") - F.coalesce("bias", F.lit(0.0)), F.lit(0.0))
    return (forecasts.where(F.col("fold") > fold).join(bias, by, "left")
            .withColumn("forecast", F.when(F.col("forecast").isNotNull(), corrected)).select(*KEYS, "fold", "model", "forecast"))


def scored(forecasts: DataFrame) -> DataFrame:
    """Forecasts whose actual is not censored."""
    return forecasts.where(F.col("actual").isNotNull())


def leaderboard(sc: DataFrame) -> DataFrame:
    """Every model at three grains."""
    return (evaluate(sc, ["model"]).withColumn("grain", F.lit("daily_store_sku"))
            .unionByName(evaluate_at_level(sc, SERIES).withColumn("grain", F.lit("weekly_store_sku")))
            .unionByName(evaluate_at_level(sc, ["category"]).withColumn("grain", F.lit("weekly_category"))))


def ranked(board: DataFrame) -> DataFrame:
    return board.orderBy("grain", "vn1")


def champion(board: DataFrame, grain: str = "weekly_store_sku") -> DataFrame:
    """One row: the model with the lowest VN1 at the replenishment grain."""
    return (board.where(F.col("grain") == grain)
            .agg(F.min_by("model", "vn1").alias("champion"), F.min("vn1").alias("vn1")))


def metric_pivot(table: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """A small metric table with one column per listed value."""
    return table.groupBy(row).pivot(column, values).agg(F.first(metric))
