"""Report tables and dashboard queries of the daily half."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.calendar import week_start


def bronze_profile(sales: DataFrame) -> DataFrame:
    """One row of size, span and defect counts."""
    return sales.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("store_id").alias("stores"),
        F.countDistinct("sku_id").alias("skus"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
        F.count(F.when(F.col("units_sold") < 0, 1)).alias("negative_rows"),
        F.sum(F.col("stockout_flag").cast("long")).alias("stockout_days"))


def weekly_units(silver: DataFrame, products: DataFrame) -> DataFrame:
    return (silver.join(products.select("sku_id", "category"), "sku_id")
            .groupBy(week_start().alias("week"), "category").agg(F.sum("demand_target").alias("units")))


def promo_lift(silver: DataFrame, products: DataFrame) -> DataFrame:
    return (silver.where(F.col("demand_target").isNotNull()).join(products.select("sku_id", "category"), "sku_id")
            .groupBy("category", "discount_pct")
            .agg(F.round(F.avg("demand_target"), 2).alias("avg_daily_units"), F.count(F.lit(1)).alias("days")))


def weekday_profile(silver: DataFrame) -> DataFrame:
    """Sunday is 1 here, as in SQL."""
    return (silver.groupBy(F.dayofweek("date").alias("dow"))
            .agg(F.round(F.avg("demand_target"), 2).alias("avg_units"),
                 F.round(100 * F.avg("stockout_flag"), 2).alias("stockout_pct")))


def network_forecast(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("p10", "p50", "p90")])


def executive_summary(board: DataFrame, story: DataFrame, recommendations: DataFrame, promo: DataFrame,
                      rule: str = "naive_dow_avg", model: str = "gbm_global") -> DataFrame:
    """Seven (kpi, before, after, note) rows from the leaderboard, policy, price and promotion tables."""
    weekly = board.where(F.col("grain") == "weekly_store_sku").agg(*[
        F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{c}_{side}")
        for c in ("wape", "bias") for side, m in (("before", rule), ("after", model))])
    accuracy = weekly.select(F.explode(F.array(
        F.struct(F.lit("Forecast error (weekly WAPE)").alias("kpi"), F.col("wape_before").alias("before"),
                 F.col("wape_after").alias("after"), F.lit(f"{rule} against {model}").alias("note")),
        F.struct(F.lit("Forecast bias (weekly)").alias("kpi"), F.col("bias_before").alias("before"),
                 F.col("bias_after").alias("after"), F.lit("above zero: too much forecast").alias("note")))).alias("r")).select("r.*")
    wanted = {"Fill rate": ("Fill rate", "at a service level of 95%"),
              "Avg inventory value ($)": ("Avg inventory value ($)", "stock held less"),
              "Lost margin, annualised ($)": ("Lost margin / yr ($)", "lost to empty shelves")}
    names = F.create_map(*[F.lit(v) for k, (n, _) in wanted.items() for v in (k, n)])
    notes = F.create_map(*[F.lit(v) for k, (_, n) in wanted.items() for v in (k, n)])
    stock = (story.where(F.col("metric").isin(list(wanted)))
             .select(F.element_at(names, F.col("metric")).alias("kpi"), "before", "after",
                     F.element_at(notes, F.col("metric")).alias("note")))
    share = F.round(F.try_divide(F.sum("annual_margin_gain"), F.sum("margin_now") * 365) * 100).cast("int")
    prices = recommendations.agg(
        F.lit("Regular-price margin opportunity / yr ($)").alias("kpi"), F.lit(0.0).alias("before"),
        F.sum("annual_margin_gain").alias("after"),
        F.concat(F.lit("= "), share.cast("string"), F.lit("% of the margin at regular prices, at most")).alias("note"))
    losing = promo.agg(
        F.lit("Loss-making promo depth-category combos").alias("kpi"), F.lit(None).cast("double").alias("before"),
        F.count(F.when(F.col("incremental_margin") < 0, 1)).cast("double").alias("after"),
        F.concat(F.lit("of "), F.count(F.lit(1)).cast("string"), F.lit(" combinations")).alias("note"))
    return accuracy.unionByName(stock).unionByName(prices).unionByName(losing)


def _pct(c: str):
    return F.round(F.col(c) * 100, 1)


def dashboard_summary(summary: DataFrame) -> DataFrame:
    return summary.select("kpi", "before", "after", "note")


def dashboard_leaderboard(board: DataFrame) -> DataFrame:
    return (board.where(F.col("grain") == "weekly_store_sku")
            .select("model", _pct("wape").alias("wape_pct"), _pct("bias").alias("bias_pct"),
                    F.round("vn1", 3).alias("vn1")).orderBy("vn1"))


def dashboard_actual_forecast(forecasts: DataFrame, models: list[str]) -> DataFrame:
    return (forecasts.where(F.col("model").isin(models) & F.col("actual").isNotNull())
            .groupBy(week_start().alias("week"), "category", "model")
            .agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast")).orderBy("week"))


def dashboard_segments(by_segment: DataFrame) -> DataFrame:
    return by_segment.select("model", "segment", _pct("wape").alias("wape_pct"))


def dashboard_frontier(costs: DataFrame) -> DataFrame:
    return costs.select("policy", "target_service", "fill_rate", "avg_inventory_value", "total_cost")


def dashboard_price_response(response: DataFrame) -> DataFrame:
    return response.select("category", "elasticity", "elasticity_lo", "elasticity_hi", "promo_uplift",
                           "cannibalisation_per_sibling")


def dashboard_promo(promo: DataFrame) -> DataFrame:
    return promo.select("category", "depth", "incremental_margin")


def dashboard_health(health: DataFrame) -> DataFrame:
    return (health.select("week", "category", "status", _pct("wape").alias("wape_pct"), _pct("bias").alias("bias_pct"))
            .orderBy(F.desc("week")))


def dashboard_actions(replenishment: DataFrame) -> DataFrame:
    return (replenishment.select("store_id", "sku_id", F.round("demand_l_plus_r", 1).alias("expected_demand"),
                                 F.round("safety_stock", 1).alias("safety_stock"), "order_up_to")
            .orderBy(F.desc("order_up_to")))
