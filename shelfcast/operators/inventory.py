"""Forecast to order-up-to levels, replayed replenishment policies and their cost."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.series import by_series, padded, whole_series
from shelfcast.schemas import SERIES, SERVICE_LEVELS, PolicyParams

POLICY = ["policy", "target_service"]

def z_score(service: float) -> float:
    return NormalDist().inv_cdf(service)


def forward_sum(value: str, window: int, by: list[str] = SERIES, order: str = "date") -> Column:
    """Sum of the next ``window`` values from each row on; past the end the last value repeats."""
    w = Window.partitionBy(*by).orderBy(order)
    inside = F.sum(value).over(w.rowsBetween(0, window - 1))
    left = F.count(F.lit(1)).over(w.rowsBetween(0, window - 1))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return inside + last * (F.lit(window) - left)


def error_spread(forecasts: DataFrame, model: str, fold: int | None = None) -> DataFrame:
    """Sample standard deviation of forecast minus actual per series.

    The replay learns it on the first fold only; the interval and the order-up-to table on all.
    """
    rows = forecasts.where((F.col("model") == model) & F.col("actual").isNotNull())
    if fold is not None:
        rows = rows.where(F.col("fold") == fold)
    return rows.groupBy(*SERIES).agg(F.stddev_samp(F.col("forecast") - F.col("actual")).alias("sigma"))


def recent_average(panel: DataFrame, first_day, days: int = 28) -> DataFrame:
    """Mean filled demand over the days just before ``first_day``."""
    day = F.lit(first_day)
    return (panel.where((F.col("date") < day) & (F.col("date") >= F.date_sub(day, days)))
            .groupBy(*SERIES).agg(F.avg("demand_filled").alias("hist_avg")))


def median_cost_price(rows: DataFrame) -> DataFrame:
    """Median cost and price per series; a series has one row per replay day, which bounds the buffer."""
    return rows.groupBy(*SERIES).agg(
        F.percentile("unit_cost", F.lit(0.5)).alias("unit_cost"),
        F.percentile("selling_price", F.lit(0.5)).alias("price"))


def policy_plans(daily: DataFrame, averages: DataFrame, spread: DataFrame, params: PolicyParams = PolicyParams(),
                 services=SERVICE_LEVELS) -> DataFrame:
    """Each series and day once, with every policy's order-up-to level in ``plans``.

    ``daily``: store_id, sku_id, date, demand, forecast. Static cover of the recent average against
    forecast demand over the cover window plus safety stock at each service level.
    """
    base = (daily.withColumn("ahead", forward_sum("forecast", params.window))
            .join(averages, SERIES, "left").join(spread, SERIES, "left")
            .withColumn("hist_avg", F.coalesce("hist_avg", F.lit(0.0)))
            .withColumn("sigma", F.coalesce("sigma", F.lit(0.0))))

    def plan(name: str, service: float | None, level: Column) -> Column:
        return F.struct(F.lit(name).alias("policy"), F.lit(service).cast("double").alias("target_service"), level.alias("order_up_to"))

    root = F.lit(math.sqrt(params.window))
    plans = [plan("current_state", None, F.col("hist_avg") * params.cover_days_current),
             *[plan("forecast_driven", float(s), F.col("ahead") + F.lit(z_score(s)) * F.col("sigma") * root) for s in services]]
    return base.select(*SERIES, "date", "demand", F.array(*plans).alias("plans"), (F.col("hist_avg") * params.window).alias("start_stock"))


def policy_levels(daily: DataFrame, averages: DataFrame, spread: DataFrame, params: PolicyParams = PolicyParams(),
                  services=SERVICE_LEVELS) -> DataFrame:
    """Order-up-to level of every policy for each series and day, a row each."""
    return policy_plans(daily, averages, spread, params, services).select(*SERIES, "date", "demand", F.inline("plans"), "start_stock")


def replay_policies(levels: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Day-by-day stock of every series under every policy, from a row per policy; see ``replay_plans``."""
    plan = F.array(F.struct("policy", "target_service", F.col("order_up_to").cast("double").alias("order_up_to")))
    return _replayed(levels.select(*SERIES, *[F.col(c).alias(f"own_{c}") for c in POLICY], "date", "demand", plan.alias("plans"), "start_stock"),
                     [*SERIES, *[f"own_{c}" for c in POLICY]], params)


def replay_plans(plans: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Day-by-day stock of every series under every policy of its plans, with lost sales.

    Each day: receive what was ordered L days ago, on review days order up to the level minus all
    stock on hand and on order, then sell what is there. Days run in order within a series; many series and all
    policies run side by side in one matrix, days are sent once whatever the number of policies, and time is linear in days. All days of a
    series have the same policies.
    """
    return _replayed(plans, SERIES, params)


def _replayed(plans: DataFrame, keys: list[str], params: PolicyParams) -> DataFrame:
    review, lead = params.review_period, params.lead_time
    if lead < 1:
        raise ValueError("lead_time must be at least 1 day")
    rows = by_series(plans.select(*keys, "date", F.col("demand").cast("double").alias("demand"), "plans", F.col("start_stock").cast("double").alias("start_stock")), keys, "date")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in [*SERIES, "date"]}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_series(batches, keys):
            lists = table["plans"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            first = np.repeat(sizes[starts[:-1]], np.diff(starts))
            if (sizes != first).any():
                raise ValueError("all days of a series need the same policies")
            flat, begin = lists.flatten(), np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():  # series with as many policies side by side
                rows_here = np.flatnonzero(sizes == n)
                if n:
                    place = begin[rows_here][:, None] + np.arange(n)
                    yield _replay_block(table.take(pa.array(rows_here)), flat.take(pa.array(place.ravel())), n, _restarted(starts, sizes == n), review, lead)

    return rows.mapInArrow(work, ", ".join(f"{c} {t}" for c, t in kinds.items() if c != "date")
                           + f", policy string, target_service double, date {kinds['date']}, demand double, on_hand double, sold double, lost double")


def _restarted(starts: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Where series begin once only the flagged rows, which are whole series, are left."""
    sizes = np.diff(starts)[here[starts[:-1]]]
    return np.concatenate([[0], np.cumsum(sizes)])


def _replay_block(table: pa.Table, plans: pa.Array, n: int, starts: np.ndarray, review: int, lead: int) -> pa.RecordBatch:
    """All days of these series under their n policies."""
    demand = padded(np.nan_to_num(table["demand"].to_numpy()), starts)
    target = padded(np.nan_to_num(pc.struct_field(plans, "order_up_to").to_numpy(zero_copy_only=False)).reshape(-1, n), starts)
    stock = np.repeat(np.nan_to_num(table["start_stock"].to_numpy())[starts[:-1]][:, None], n, 1)
    due = [np.zeros_like(stock) for _ in range(lead)]
    on_hand, sold = np.empty_like(target), np.empty_like(target)
    for t in range(target.shape[1]):
        stock = stock + due.pop(0)
        order = np.zeros_like(stock)
        if t % review == 0:
            order = np.maximum(0.0, np.ceil(target[:, t] - (stock + sum(due, np.zeros_like(stock)))))
        sold[:, t] = np.minimum(stock, demand[:, t, None])
        stock = stock - sold[:, t]
        on_hand[:, t] = stock
        due.append(order)
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    day = np.arange(len(row)) - starts[row]
    wide = pa.array(np.repeat(np.arange(len(row)), n))
    wanted = np.repeat(np.nan_to_num(table["demand"].to_numpy()), n)
    gone = sold[row, day].ravel()
    out = {c: table[c].combine_chunks().take(wide) for c in SERIES}
    out |= {"policy": pc.struct_field(plans, "policy"), "target_service": pc.struct_field(plans, "target_service"), "date": table["date"].combine_chunks().take(wide),
            "demand": pa.array(wanted), "on_hand": pa.array(on_hand[row, day].ravel()), "sold": pa.array(gone), "lost": pa.array(wanted - gone)}
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def policy_costs(replay: DataFrame, cost_price: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """Service, stock and money per policy; network stock is summed per day, then averaged."""
    rows = replay.join(cost_price, SERIES)
    daily = rows.groupBy(*POLICY, "date").agg(
        F.sum("on_hand").alias("units"),
        F.sum(F.col("on_hand") * F.col("unit_cost")).alias("value"),
        F.sum("sold").alias("sold"), F.sum("demand").alias("demand"),
        F.sum(F.col("lost") * (F.col("price") - F.col("unit_cost"))).alias("lost_margin"),
        F.count(F.when(F.col("lost") > 0, 1)).alias("short"), F.count(F.lit(1)).alias("cells"))
    holding = F.sum("value") * F.lit(params.holding_rate_annual / 365)
    return daily.groupBy(*POLICY).agg(
        (F.sum("sold") / F.greatest(F.sum("demand"), F.lit(1e-9))).alias("fill_rate"),
        F.avg("units").alias("avg_inventory_units"),
        F.avg("value").alias("avg_inventory_value"),
        holding.alias("holding_cost"),
        F.sum("lost_margin").alias("lost_margin"),
        (holding + F.sum("lost_margin")).alias("total_cost"),
        F.try_divide(F.sum("short").cast("double"), F.sum("cells").cast("double")).alias("stockout_days_pct"),
        F.count(F.lit(1)).alias("sim_days"))


def run_policies(daily: DataFrame, averages: DataFrame, spread: DataFrame, cost_price: DataFrame,
                 params: PolicyParams = PolicyParams(), services=SERVICE_LEVELS) -> DataFrame:
    plans = policy_plans(daily, averages, spread, params, services)
    return policy_costs(replay_plans(plans, params), cost_price, params)


def replay_inputs(forecasts: DataFrame, model: str) -> DataFrame:
    """Folds after the first, with unknown demand or forecast taken as 0."""
    return (forecasts.where((F.col("model") == model) & (F.col("fold") > 1))
            .select(*SERIES, "date", F.coalesce(F.col("true_demand").cast("double"), F.lit(0.0)).alias("demand"),
                    F.coalesce("forecast", F.lit(0.0)).alias("forecast"), "unit_cost", "selling_price"))


def forecast_intervals(points: DataFrame, spread: DataFrame, z: float = 1.2816) -> DataFrame:
    """P10 (never below 0) and P90 around the point forecast ``p50``."""
    return (points.join(spread, SERIES, "left")
            .withColumns({"p10": F.greatest(F.col("p50") - z * F.col("sigma"), F.lit(0.0)),
                          "p90": F.col("p50") + z * F.col("sigma")}))


def replenishment(intervals: DataFrame, params: PolicyParams = PolicyParams(), service: float = 0.95) -> DataFrame:
    """Order-up-to level for the next cover window of every series."""
    first = intervals.agg(F.min("date").alias("first_day"))
    safety = F.lit(z_score(service)) * F.coalesce("sigma", F.lit(0.0)) * F.lit(math.sqrt(params.window))
    return (intervals.crossJoin(F.broadcast(first))
            .where(F.col("date") < F.date_add("first_day", params.window))
            .groupBy(*SERIES).agg(F.sum("p50").alias("demand_l_plus_r"), F.min("sigma").alias("sigma"))
            .withColumn("safety_stock", safety)
            .withColumn("order_up_to", F.ceil(F.col("demand_l_plus_r") + F.col("safety_stock")).cast("double")))


def before_after(costs: DataFrame, service: float = 0.95) -> DataFrame:
    """Five KPIs of the current rule against one forecast-driven policy; money per year."""
    year = F.lit(365.0) / F.col("sim_days")
    kpis = F.array(
        F.struct(F.lit("Fill rate").alias("metric"), F.col("fill_rate").alias("value")),
        F.struct(F.lit("Avg inventory value ($)").alias("metric"), F.col("avg_inventory_value").alias("value")),
        F.struct(F.lit("Lost margin, annualised ($)").alias("metric"), (F.col("lost_margin") * year).alias("value")),
        F.struct(F.lit("Holding cost, annualised ($)").alias("metric"), (F.col("holding_cost") * year).alias("value")),
        F.struct(F.lit("Stock-out store-SKU-days (%)").alias("metric"), F.col("stockout_days_pct").alias("value")))
    chosen = costs.where((F.col("policy") == "current_state") | (F.col("target_service") == service))
    return (chosen.withColumn("k", F.explode(kpis))
            .groupBy(F.col("k.metric").alias("metric"))
            .agg(F.max(F.when(F.col("policy") == "current_state", F.col("k.value"))).alias("before"),
                 F.max(F.when(F.col("policy") != "current_state", F.col("k.value"))).alias("after"))
            .withColumn("change", F.try_divide("after", "before") - 1))


