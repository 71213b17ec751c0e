"""Silver to gold: inputs for a forecast of the next HORIZON days from one cutoff.

Demand lags and rolling windows look back at least HORIZON days; prices, promotions and the
calendar are known in advance and are not shifted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import add_calendar
from shelfcast.operators.quality import series_window
from shelfcast.schemas import HORIZON, LAGS, NOT_FEATURES, SERIES, WINDOWS


def add_dimensions(silver: DataFrame, products: DataFrame, stores: DataFrame, segments: DataFrame) -> DataFrame:
    """Category, cost, region, size and segment; series missing from any of them drop out."""
    return (silver.join(products.select("sku_id", "category", "unit_cost"), "sku_id")
            .join(stores.select("store_id", "region", "store_size"), "store_id")
            .join(segments.select(*SERIES, "segment"), SERIES))


def add_price_features(df: DataFrame) -> DataFrame:
    """Price against its regular level, against its own past mean, and in logs."""
    past_mean = F.avg("regular_price").over(series_window().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({
        "price_ratio": F.try_divide("selling_price", "regular_price"),
        "rel_price": F.try_divide(F.col("selling_price"), past_mean),
        "log_price": F.ln("selling_price"),
    })


def add_demand_history(df: DataFrame, demand: str = "demand_filled", lags: list[int] = LAGS,
                       windows: list[int] = WINDOWS, horizon: int = HORIZON) -> DataFrame:
    """Lags, rolling means, spread and zero share, all ending ``horizon`` rows back.

    A shifted rolling window is one frame further back, so only the zero share needs the shifted
    value itself: there a missing past day counts as a day with sales.
    """
    w = series_window()

    def back(n: int) -> Window:
        return w.rowsBetween(-(horizon + n - 1), -horizon)

    lagged = {f"lag_{n}": F.lag(demand, n).over(w) for n in lags}
    rolling = {f"rmean_{n}": F.avg(demand).over(back(n)) for n in windows}
    zero = F.coalesce((F.lag(demand, horizon).over(w) == 0).cast("double"), F.lit(0.0))
    out = df.withColumns({**lagged, **rolling, "rstd_28": F.stddev_samp(demand).over(back(28)), "was_zero": zero})
    weekday_lags = F.filter(F.array(*[F.col(f"lag_{n}") for n in lags[:4]]), lambda v: v.isNotNull())
    return out.withColumns({
        "rzero_28": F.avg("was_zero").over(w.rowsBetween(-27, 0)),
        "dow_mean_4w": F.try_divide(F.aggregate(weekday_lags, F.lit(0.0), lambda a, v: a + v),
                                    F.size(weekday_lags).cast("double")),
        "trend_ratio": F.try_divide(F.col("rmean_28"), F.col("rmean_91") + 0.1),
    }).drop("was_zero")


def build_features(silver: DataFrame, products: DataFrame, stores: DataFrame, segments: DataFrame,
                   holidays: dict[str, float] | None = None) -> DataFrame:
    """The gold table."""
    df = add_dimensions(silver, products, stores, segments)
    return add_demand_history(add_price_features(add_calendar(df, holidays)))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def feature_list(df: DataFrame) -> DataFrame:
    """The model inputs as a table: position, feature, and the number of rows that know it."""
    names = feature_columns(df)
    known = df.agg(*[F.count(c).alias(c) for c in names])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("n_known")) for i, c in enumerate(names, 1)]
    return known.select(F.inline(F.array(*rows)))


def add_sibling_promo(df: DataFrame, products: DataFrame) -> DataFrame:
    """Promoted SKUs of the same store, category and day, without the row's own.

    The panel has one row per store, SKU and day, so a group is at most one category's assortment.
    """
    group = Window.partitionBy("store_id", "category", "date")
    return (df.join(products.select("sku_id", "category"), "sku_id", "left")
            .withColumn("n_sibling_promo",
                        (F.sum("on_promo").over(group) - F.col("on_promo")).cast("int"))
            .drop("category"))


def future_rows(silver: DataFrame, horizon: int = HORIZON, promo_plan: DataFrame | None = None,
                products: DataFrame | None = None) -> DataFrame:
    """The next ``horizon`` days of every series: last regular price, planned promotions, no demand."""
    end = silver.agg(F.max("date").alias("end"))
    last = silver.groupBy(*SERIES).agg(F.max_by("regular_price", "date").alias("regular_price"))
    fut = (last.crossJoin(F.broadcast(end))
           .withColumn("date", F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", horizon))))
           .drop("end"))
    if promo_plan is None:
        fut = fut.withColumn("discount_pct", F.lit(0.0))
    else:
        fut = (fut.join(promo_plan.select(*SERIES, "date", "discount_pct"), [*SERIES, "date"], "left")
               .withColumn("discount_pct", F.coalesce("discount_pct", F.lit(0.0))))
    fut = fut.withColumns({
        "on_promo": (F.col("discount_pct") > 0).cast("int"),
        "selling_price": F.col("regular_price") * (1 - F.col("discount_pct")),
        "stockout_flag": F.lit(0),
    })
    if products is None or promo_plan is None:
        return fut.withColumn("n_sibling_promo", F.lit(0))
    return add_sibling_promo(fut, products)


def make_future_frame(silver: DataFrame, horizon: int = HORIZON, promo_plan: DataFrame | None = None,
                      products: DataFrame | None = None) -> DataFrame:
    """History plus the known inputs of the horizon; unknown demand is NULL, filled demand 0."""
    fut = future_rows(silver, horizon, promo_plan, products)
    return (silver.unionByName(fut, allowMissingColumns=True)
            .withColumn("demand_filled", F.coalesce("demand_filled", F.lit(0.0))))


def lag_mismatches(gold: DataFrame, lag: int = HORIZON) -> DataFrame:
    """Leakage guard over all series: rows whose lag is not the demand ``lag`` days earlier."""
    then = gold.select(*SERIES, F.date_add("date", lag).alias("date"), F.col("demand_filled").alias("then"))
    seen = gold.select(*SERIES, "date", f"lag_{lag}").join(then, [*SERIES, "date"], "left")
    return seen.agg(F.count(F.lit(1)).alias("rows_checked"),
                    F.count(F.when(~F.col(f"lag_{lag}").eqNullSafe(F.col("then")), 1)).alias("mismatches"))
