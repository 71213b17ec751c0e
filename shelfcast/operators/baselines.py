"""Per-series forecasts that need no fitting loop: weekday repeats and Croston with the SBA factor.

All folds run in one job: the cutoffs are exploded as a key next to the series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.schemas import HORIZON, SERIES

FOLD = [*SERIES, "fold"]


def cutoff_array(cutoffs: list[dt.date]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("fold"), F.lit(c).alias("cutoff")) for k, c in enumerate(cutoffs, 1)])


def with_folds(df: DataFrame, cutoffs: list[dt.date], history_days: int | None = None) -> DataFrame:
    """Each row once per fold whose training history contains it."""
    out = (df.where(F.col("date") <= F.lit(max(cutoffs)))
           .withColumn("f", F.explode(F.filter(
               cutoff_array(cutoffs),
               lambda s: (F.col("date") <= s["cutoff"]) & (
                   F.lit(True) if history_days is None
                   else F.col("date") > F.date_sub(s["cutoff"], history_days))))))
    return out.select("*", F.col("f.fold").alias("fold"), F.col("f.cutoff").alias("cutoff")).drop("f")


def horizon_days(df: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """One row per future day: ``step`` 1..horizon and its date."""
    return (df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .withColumn("date", F.date_add("cutoff", F.col("step"))))


def _long(df: DataFrame, models: list[str]) -> DataFrame:
    keep = df.select(*SERIES, "date", "fold", *models)
    return keep.unpivot([*SERIES, "date", "fold"], models, "model", "forecast")


def weekday_repeats(panel: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON, weeks: int = 4,
                    demand: str = "demand_filled") -> DataFrame:
    """``seasonal_naive`` repeats the last week; ``naive_dow_avg`` the average of the last four.

    The panel's calendar is complete, so the last weeks are a date range that prunes the scan. A
    series with a shorter history has no weekday average.
    """
    span = 7 * weeks
    recent = with_folds(panel.select(*SERIES, "date", demand), cutoffs, span)
    age = F.datediff("cutoff", "date")
    slots = (recent.withColumn("slot", F.pmod(F.lit(6) - age, F.lit(7)))
             .groupBy(*FOLD, "cutoff", "slot")
             .agg(F.max(F.when(age < 7, F.col(demand))).alias("seasonal_naive"),
                  F.when(F.count(demand) == weeks, F.avg(demand)).alias("naive_dow_avg")))
    days = F.filter(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.pmod(k - 1, F.lit(7)) == F.col("slot"))
    out = slots.withColumn("step", F.explode(days)).withColumn("date", F.date_add("cutoff", F.col("step")))
    return _long(out, ["naive_dow_avg", "seasonal_naive"])


def croston_levels(panel: DataFrame, cutoffs: list[dt.date], alpha: float = 0.1,
                   demand: str = "demand_filled") -> DataFrame:
    """The flat Croston-SBA forecast per series and fold, as a weighted sum.

    Exponential smoothing over the n sales of a series gives sale k the weight
    ``alpha (1-alpha)^(n-k)`` and the first one ``(1-alpha)^(n-1)``, so the recursion is a plain
    aggregate of sizes and of gaps between sales. Sales are numbered once per series; a fold only
    changes n, so all folds come out of one shuffle. A series without sales forecasts 0.
    """
    w = Window.partitionBy(*SERIES).orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_sale = F.col("y") > 0
    rows = (panel.where(F.col("date") <= F.lit(max(cutoffs)))
            .select(*SERIES, "date", F.col(demand).cast("double").alias("y"))
            .withColumn("position", F.row_number().over(w))
            .withColumns({
                "k": F.sum(is_sale.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                "before": F.max(F.when(is_sale, F.col("position"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
            .withColumn("gap", F.col("position") - F.coalesce("before", F.lit(0))))
    folds = list(enumerate(cutoffs, 1))
    rows = rows.withColumns({f"n_{i}": F.max(F.when(F.col("date") <= F.lit(c), F.col("k"))).over(whole)
                             for i, c in folds})
    sums = []
    for i, c in folds:
        known = F.col("date") <= F.lit(c)
        weight = F.when(known & is_sale, F.pow(F.lit(1 - alpha), F.col(f"n_{i}") - F.col("k"))
                        * F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.lit(alpha)))
        sums += [F.sum(weight * F.col("y")).alias(f"z_{i}"), F.sum(weight * F.col("gap")).alias(f"p_{i}"),
                 F.count(F.when(known, 1)).alias(f"days_{i}")]
    per_fold = F.array(*[F.struct(
        F.lit(i).alias("fold"), F.lit(c).alias("cutoff"), F.col(f"days_{i}").alias("days"),
        F.coalesce(F.lit(1 - alpha / 2) * F.try_divide(f"z_{i}", f"p_{i}"), F.lit(0.0)).alias("croston_sba"))
        for i, c in folds])
    return (rows.groupBy(*SERIES).agg(*sums).select(*SERIES, F.explode(per_fold).alias("x"))
            .where("x.days > 0").select(*SERIES, "x.fold", "x.cutoff", "x.croston_sba"))


def croston_sba(panel: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON, alpha: float = 0.1,
                demand: str = "demand_filled") -> DataFrame:
    return _long(horizon_days(croston_levels(panel, cutoffs, alpha, demand), horizon), ["croston_sba"])
