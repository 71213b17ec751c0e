"""Monitoring: weekly accuracy alerts and feature drift (PSI)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import week_start
from shelfcast.functions.metrics import volume_metrics
from shelfcast.functions.quantiles import exact_quantiles


def health_status(accuracy_alert: Column, bias_alert: Column) -> Column:
    return (F.when(accuracy_alert & bias_alert, "RED").when(accuracy_alert, "AMBER-accuracy")
            .when(bias_alert, "AMBER-bias").otherwise("GREEN"))


def weekly_health(forecasts: DataFrame, model: str, baseline_wape: float | DataFrame, wape_tol: float = 0.20,
                  bias_tol: float = 0.10, by: str = "category") -> DataFrame:
    """WAPE, bias and volume per week and group, with alerts against a baseline WAPE.

    The baseline is a number or a one-row frame with a ``wape`` column.
    """
    rows = forecasts.where((F.col("model") == model) & F.col("actual").isNotNull())
    wape, bias, _ = volume_metrics("actual", "forecast", 1e-9)
    weekly = (rows.groupBy(week_start().alias("week"), by)
              .agg(wape.alias("wape"), bias.alias("bias"), F.sum("actual").alias("units")))
    if isinstance(baseline_wape, DataFrame):
        weekly = weekly.crossJoin(F.broadcast(baseline_wape.select(F.col("wape").alias("baseline"))))
    else:
        weekly = weekly.withColumn("baseline", F.lit(float(baseline_wape)))
    return (weekly.withColumn("alert_accuracy", F.col("wape") > F.col("baseline") * (1 + wape_tol))
            .withColumn("alert_bias", F.abs("bias") > bias_tol)
            .withColumn("status", health_status(F.col("alert_accuracy"), F.col("alert_bias")))
            .drop("baseline"))


def drift_flag(psi: Column) -> Column:
    return F.when(psi > 0.2, "investigate").when(psi > 0.1, "watch").otherwise("stable")


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Population stability index of every feature between two windows of a table.

    Bin edges are the distinct exact quantiles of the reference; the outer bins are open. Fewer
    than three edges leave nothing to compare: PSI 0. An empty bin counts as a share of 1e-6.
    """
    def long(df: DataFrame, is_ref: int) -> DataFrame:
        cols = [F.col(c).cast("double").alias(c) for c in features]
        return (df.select(*cols).unpivot([], features, "feature", "value")
                .where("value is not null and not isnan(value)").withColumn("is_ref", F.lit(is_ref)))

    both = long(reference, 1).unionByName(long(current, 0))
    probs = [i / bins for i in range(bins + 1)]
    # one row per feature: as many rows as the caller lists names
    edges = (exact_quantiles(long(reference, 1), "value", probs, ["feature"], few_groups=True)
             .groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias("edges")))
    inner = edges.select("feature", F.size("edges").alias("n_edges"),
                         F.when(F.size("edges") > 2, F.slice("edges", F.lit(2), F.size("edges") - 2))
                         .otherwise(F.array().cast("array<double>")).alias("inner"))
    counted = (both.join(F.broadcast(inner), "feature")
               .groupBy("feature", "n_edges",
                        F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin"))
               .agg(F.sum("is_ref").alias("n_ref"), F.sum(1 - F.col("is_ref")).alias("n_cur")))
    sizes = counted.groupBy("feature").agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))

    def share(n: str, total: str) -> Column:
        return F.greatest(F.try_divide(F.coalesce(F.col(n), F.lit(0)).cast("double"), F.col(total).cast("double")),
                          F.lit(1e-6))

    grid = inner.select("feature", "n_edges", F.explode(F.sequence(F.lit(0), F.size("inner"))).alias("bin"))
    e, a = share("n_ref", "all_ref"), share("n_cur", "all_cur")
    return (grid.join(counted.drop("n_edges"), ["feature", "bin"], "left").join(sizes, "feature")
            .groupBy("feature", "n_edges").agg(F.sum((a - e) * F.ln(F.try_divide(a, e))).alias("psi"))
            .select("feature", F.when(F.col("n_edges") < 3, 0.0).otherwise(F.col("psi")).alias("psi"))
            .withColumn("flag", drift_flag(F.col("psi"))))
