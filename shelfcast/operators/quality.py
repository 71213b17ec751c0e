"""Bronze to silver: counted data-quality rules R1 to R5 on a daily sales panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.schemas import KEYS, SERIES

PRICES = ["regular_price", "selling_price"]
ZERO_DEFAULTS = ["on_promo", "discount_pct", "stockout_flag", "n_sibling_promo"]


def series_window() -> Window:
    """The one window layout of silver and gold: all of them share a single exchange."""
    return Window.partitionBy(*SERIES).orderBy("date")


def keep_first(df: DataFrame, arrival: list[str], keys: list[str] = KEYS) -> DataFrame:
    """R1: the first row per key in arrival order.

    ``arrival`` must order the rows of a key totally. Spark turns the rank filter into a group
    limit that already runs before the shuffle, so a key with very many copies sends one row per
    map task.
    """
    w = Window.partitionBy(*keys).orderBy(*arrival)
    return df.withColumn("arrival_no", F.row_number().over(w)).where("arrival_no = 1").drop("arrival_no")


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def null_negative_units(df: DataFrame) -> DataFrame:
    """R2: returns netted into sales are not demand."""
    return df.withColumns({
        "is_negative": F.coalesce(F.col("units_sold") < 0, F.lit(False)),
        "units_sold": F.when(F.col("units_sold") >= 0, F.col("units_sold")),
    })


def repair_prices(df: DataFrame) -> DataFrame:
    """R3: a selling price far from the series' median regular price is rebuilt from the discount.

    After R1 a series holds at most one row per day, which bounds the median's buffer.
    """
    typical = F.percentile("regular_price", F.lit(0.5)).over(Window.partitionBy(*SERIES))
    odd = (F.col("selling_price") > 3 * F.col("typical")) | (F.col("selling_price") < 0.3 * F.col("typical"))
    return (df.withColumn("typical", typical)
            .withColumn("is_price_outlier", F.coalesce(odd, F.lit(False)))
            .withColumn("selling_price", F.when(F.col("is_price_outlier"),
                                                F.col("regular_price") * (1 - F.col("discount_pct")))
                        .otherwise(F.col("selling_price")))
            .drop("typical"))


def complete_calendar(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """R4: one row per series and day between the overall first and last day.

    Every row is stretched over the gap that follows it (and the first one also over the gap before
    it), so the grid needs neither a cross join nor a join back; the data columns survive only on
    the row's own day. ``is_filled`` marks the new rows.
    """
    w = series_window()
    measures = [c for c in df.columns if c not in KEYS]
    b = df.crossJoin(F.broadcast(bounds))
    starts = F.when(F.lag("date").over(w).isNull(), F.col("first_day")).otherwise(F.col("date"))
    ends = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("last_day"))
    spread = (b.withColumn("span", F.sequence(starts, ends))
              .withColumn("day", F.explode("span")))
    own = F.col("day") == F.col("date")
    return spread.select(*SERIES, F.col("day").alias("date"),
                         *[F.when(own, F.col(c)).alias(c) for c in measures],
                         (~own).alias("is_filled"))


def carry_prices(df: DataFrame) -> DataFrame:
    """Prices forward, then backward at the head of a series; flags and discounts default to 0.

    Only the head is left after filling forward, and there the next price is the series' first one:
    a whole-series frame, which costs one pass where a frame to the end would cost one per row.
    """
    w = series_window()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(past), F.first(c, True).over(whole)) for c in PRICES}
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in ZERO_DEFAULTS if c in df.columns}
    return df.withColumns({**filled, **zeros})


def _middle(values: Column) -> Column:
    """Median of a short list of non-null values."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int"))
                          + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def censor_stockouts(df: DataFrame) -> DataFrame:
    """R5: sales on stock-out days understate demand, so they are no target.

    ``demand_filled`` imputes the missing targets with the median of the same weekday in the four
    weeks before, else 0. On a complete calendar those are the rows 7, 14, 21 and 28 back, so the
    imputation shares the series window instead of regrouping by weekday.
    """
    w = series_window()
    target = F.when(F.col("stockout_flag") == 0, F.col("units_sold").cast("double"))
    out = df.withColumn("demand_target", target)
    same_weekday = F.array(*[F.lag("demand_target", 7 * k).over(w) for k in range(1, 5)])
    return out.withColumn("demand_filled",
                          F.coalesce(F.col("demand_target"), _middle(same_weekday), F.lit(0.0)))


def apply_rules(sales: DataFrame, arrival: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """R1 to R5 in order, keeping the per-row marks the scorecard counts."""
    bounds = date_bounds(sales) if bounds is None else bounds
    once = keep_first(sales, arrival)
    extra = [c for c in arrival if c not in KEYS]
    repaired = repair_prices(null_negative_units(once.drop(*extra)))
    return censor_stockouts(carry_prices(complete_calendar(repaired, bounds)))


def clean_sales(sales: DataFrame, arrival: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """The silver panel."""
    return apply_rules(sales, arrival, bounds).drop("is_negative", "is_price_outlier", "is_filled")


def quality_scorecard(sales: DataFrame, arrival: list[str], bounds: DataFrame | None = None) -> DataFrame:
    """(rule, count, pct_of_input), one row per rule plus rows in and out."""
    return scorecard_of(apply_rules(sales, arrival, bounds), sales.agg(F.count(F.lit(1)).alias("rows_in")))


def scorecard_of(marked: DataFrame, size: DataFrame) -> DataFrame:
    """The scorecard from a panel that ``apply_rules`` has marked and the one-row ``rows_in``."""
    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    after = marked.agg(
        n(~F.col("is_filled")).alias("kept"),
        n(F.col("is_negative")).alias("r2_negative_units"),
        n(F.col("is_price_outlier")).alias("r3_price_outliers"),
        (n(F.col("units_sold").isNull()) - n(F.col("is_negative"))).alias("r4_missing_days_filled"),
        n(F.col("stockout_flag") == 1).alias("r5_censored_stockout_days"),
        F.count(F.lit(1)).alias("rows_out"),
    )
    one = (after.crossJoin(F.broadcast(size))
           .withColumn("r1_duplicates_removed", F.col("rows_in") - F.col("kept")))
    rules = ["rows_in", "r1_duplicates_removed", "r2_negative_units", "r3_price_outliers",
             "r4_missing_days_filled", "r5_censored_stockout_days", "rows_out"]
    return (one.withColumn("base", F.col("rows_in"))
            .unpivot(["base"], rules, "rule", "count")
            .select("rule", "count", F.try_divide(F.col("count").cast("double"), F.col("base").cast("double"))
                    .alias("pct_of_input")))
