"""Hourly censored demand: flag orientation, hourly profiles and ratio recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions import arrays as A
from shelfcast.functions.metrics import stable_mean
from shelfcast.functions.quantiles import exact_median
from shelfcast.schemas import OPEN_HOURS, PANEL_KEY, PROFILE_LEVELS
from shelfcast.session import cut_lineage, partitions_for
from shelfcast.sources.tables import concat_splits

MIN_SHARE = 0.15
MIN_SHARE_FEATURE = 0.05
MIN_DAYS = 5
PROFILE_KEY = ["store_id", "product_id", "third_category_id"]
# Rows that a task orders to meet their profiles: about 70 MB.
ROWS = 100_000


def orientation(panel: DataFrame) -> DataFrame:
    """One row: mean hourly sales by flag, whether the flag must be flipped, and how often the open
    hours flagged (after flipping) agree with the daily count."""
    sales, flags = F.col("hours_sale"), F.col("hours_stock_status")
    on = A.total(F.zip_with(sales, flags, lambda s, o: s * o))
    n_on = A.count_flags(flags)
    sums = panel.agg(
        F.sum(on).alias("s1"), F.sum(n_on).alias("n1"),
        F.sum(A.total(sales) - on).alias("s0"), F.sum(F.size(flags) - n_on).alias("n0"),
        F.avg((A.empty_hours(flags) == F.col("stock_hour6_22_cnt")).cast("double")).alias("as_is"),
        F.avg((OPEN_HOURS - A.empty_hours(flags) == F.col("stock_hour6_22_cnt")).cast("double")).alias("turned"))
    m1, m0 = F.try_divide("s1", "n1"), F.try_divide("s0", "n0")
    flipped = F.coalesce(m1 > m0, F.lit(False))
    return sums.select(m1.alias("mean_sales_when_flag1"), m0.alias("mean_sales_when_flag0"), flipped.alias("flipped"),
                       F.when(flipped, F.col("turned")).otherwise(F.col("as_is"))
                       .alias("share_rows_matching_stock_hour6_22_cnt"))


def orient(panel: DataFrame, check: DataFrame) -> DataFrame:
    """Flags turned so that 1 means out of stock."""
    flags = F.col("hours_stock_status")
    return (panel.crossJoin(F.broadcast(check.select("flipped")))
            .withColumn("hours_stock_status", F.when(F.col("flipped"), A.flip(flags)).otherwise(flags))
            .drop("flipped"))


def add_day_index(panel: DataFrame, train: DataFrame) -> DataFrame:
    """Days since the first training day."""
    first = train.agg(F.min("dt").alias("day_zero"))
    return (panel.crossJoin(F.broadcast(first))
            .withColumn("day", F.datediff("dt", "day_zero")).drop("day_zero"))


def last_train_day(train: DataFrame) -> int:
    row = train.agg(F.datediff(F.max("dt"), F.min("dt"))).first()
    return int(row[0])


def prepare(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both splits in one panel with checked flags and a shared day index.

    The check looks at the training split only; the evaluation split follows its verdict.
    """
    check = orientation(train)
    return add_day_index(orient(concat_splits(train, evaluation), check), train)


def _hour(c: str, h: int) -> Column:
    return F.get(F.col(c), F.lit(h))


def profile_table(panel: DataFrame, fit: Column, min_days: int = MIN_DAYS) -> DataFrame:
    """Per (store, product, category): the share of a normal day's demand in each hour.

    One pass over the panel sums the fit rows by hour. That table has one row per series and is
    written once, since it is read five times: the coarser levels are rolled up from it, and the fallbacks series -> store category -> category -> all are resolved there
    too, never on panel rows. Also carries the series' own totals and the overall daily mean.
    """
    return _profiles(_hour_sums(panel, fit), min_days)


def _hour_sums(panel: DataFrame, fit: Column) -> DataFrame:
    """All rows, fit days and the fit days' sales by hour, per series."""
    hours = [F.coalesce(F.sum(F.when(fit, _hour("hours_sale", h))), F.lit(0.0)).alias(f"h{h}") for h in range(24)]
    return cut_lineage(panel.groupBy(*PROFILE_KEY).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(fit, 1)).alias("days"), *hours))


def _profiles(base: DataFrame, min_days: int) -> DataFrame:
    names = [f"h{h}" for h in range(24)]
    day_total = sum((F.col(n) for n in names[1:]), F.col(names[0]))

    def shares(total: Column) -> Column:
        return F.array(*[F.try_divide(F.col(n), total) for n in names])

    out = base.select(*PROFILE_KEY)
    usable = []
    for i, level in enumerate(PROFILE_LEVELS):
        summed = base.groupBy(*level).agg(F.sum("days").alias("days"), *[F.sum(n).alias(n) for n in names])
        good = (F.col("days") >= min_days) & (day_total > 0)
        cols = [F.when(good, shares(day_total)).alias(f"profile_{i}")]
        if i == 0:
            cols += [day_total.alias("series_sales"), F.col("days").alias("series_days")]
        out = out.join(summed.select(*level, *cols), level)
        usable.append(F.col(f"profile_{i}"))
    overall = base.agg(F.sum("days").alias("days"), *[F.sum(n).alias(n) for n in names])
    flat = F.array_repeat(F.lit(1.0 / 24), 24)
    overall = overall.select(
        F.when(day_total > 0, shares(day_total)).otherwise(flat).alias("profile_all"),
        F.coalesce(F.try_divide(day_total, F.col("days").cast("double")), F.lit(0.0)).alias("mean_all"))
    level_used = F.when(usable[0].isNotNull(), 1).when(usable[1].isNotNull(), 2).when(usable[2].isNotNull(), 3)
    return (out.crossJoin(F.broadcast(overall))
            .select(*PROFILE_KEY, F.coalesce(*usable, F.col("profile_all")).alias("profile"),
                    level_used.otherwise(4).alias("profile_level"), "series_sales", "series_days", "mean_all"))


def with_profile(panel: DataFrame, fit: Column, level_fit: Column | None = None,
                 min_days: int = MIN_DAYS) -> DataFrame:
    """Adds ``profile``, ``level`` and ``observed`` to every row.

    ``level`` is the series' mean daily sales over its fit days, without the row's own day, or the
    overall mean where nothing else is left.
    """
    sums = _hour_sums(panel, fit)
    table = _profiles(sums, min_days)
    if level_fit is not None:
        own = profile_table(panel, level_fit, min_days).select(*PROFILE_KEY, "series_sales", "series_days", "mean_all")
        table = table.drop("series_sales", "series_days", "mean_all").join(own, PROFILE_KEY)
    counts = fit if level_fit is None else level_fit
    observed = A.total("hours_sale")
    left_sales = F.col("series_sales") - F.when(counts, observed).otherwise(0.0)
    left_days = F.col("series_days") - F.when(counts, 1).otherwise(0)
    # lists pack well, so partitions cut by their bytes alone would hold very many rows
    parts = partitions_for(panel.sparkSession, sums.agg(F.sum("rows")).first()[0] or 0, ROWS)
    return (panel.repartition(parts, *PROFILE_KEY).join(table, PROFILE_KEY)
            .withColumn("observed", observed)
            .withColumn("level", F.when(left_days > 0, F.try_divide(left_sales, left_days.cast("double")))
                        .otherwise(F.col("mean_all")))
            .drop("series_sales", "series_days", "mean_all"))


def ratio_estimate(observed: Column, share: Column, level: Column, min_share: float) -> Column:
    """Observed sales scaled up by the share of demand still visible; the level if too little is."""
    return F.when(share >= min_share, F.try_divide(observed, F.greatest(share, F.lit(1e-9)))).otherwise(level)


def profile_recover(sales: Column, flags: Column, profile: Column, level: Column) -> Column:
    """Recovered daily demand: unchanged on clean days and never below what was sold."""
    observed = A.total(sales)
    estimate = ratio_estimate(observed, A.share_in_stock(profile, flags), level, MIN_SHARE)
    return F.greatest(observed, F.when(A.is_clean(flags), observed).otherwise(estimate))


def recover_by_profile(panel: DataFrame, cutoff: int, min_days: int = MIN_DAYS) -> DataFrame:
    """``observed`` and ``rec_profile`` for every row, learned on clean days up to the cutoff."""
    fit = A.is_clean("hours_stock_status") & (F.col("day") <= cutoff)
    return with_profile(panel, fit, min_days=min_days).withColumn(
        "rec_profile", profile_recover(F.col("hours_sale"), F.col("hours_stock_status"), F.col("profile"), F.col("level")))


def recovery_features(df: DataFrame, sales: str = "hours_sale", flags: str = "hours_stock_status") -> DataFrame:
    """The recovery model's 14 inputs, as extra columns prefixed ``x_``."""
    observed, share = A.total(sales), A.share_in_stock("profile", flags)
    return df.withColumns({
        "x_observed": observed,
        "x_share_in": share,
        "x_profile_est": ratio_estimate(observed, share, F.col("level"), MIN_SHARE_FEATURE),
        "x_level": F.col("level"),
        "x_oos_hours": A.empty_hours(flags),
        "x_first_oos_hour": A.first_empty_hour(flags),
        "x_last_oos_hour": A.last_empty_hour(flags),
        "x_dow": F.weekday("dt"),
        "x_discount": F.col("discount"),
        "x_holiday_flag": F.col("holiday_flag"),
        "x_activity_flag": F.col("activity_flag"),
        "x_avg_temperature": F.col("avg_temperature"),
        "x_precpt": F.col("precpt"),
        "x_third_category_id": F.col("third_category_id").cast("string"),
    })


def sale_groups(panel: DataFrame, cutoff: int) -> DataFrame:
    """High- or low-sale by the series' mean up to the cutoff against the median over all rows.

    A series without history counts as low-sale.
    """
    past = F.when(F.col("day") <= cutoff, A.total("hours_sale"))
    # a mean may itself be the median, so it must have the same bits wherever it is computed
    means = panel.groupBy(*PANEL_KEY).agg(stable_mean(past).alias("series_mean"))
    rows = panel.join(means, PANEL_KEY)
    middle = exact_median(rows.select("series_mean"), "series_mean", name="middle")
    return (rows.crossJoin(F.broadcast(middle))
            .withColumn("sale_group", F.when(F.col("series_mean") >= F.col("middle"), "high-sale").otherwise("low-sale"))
            .drop("series_mean", "middle"))
