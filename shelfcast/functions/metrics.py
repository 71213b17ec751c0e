"""Forecast accuracy as aggregate expressions. Errors are forecast minus actual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.calendar import week_start

METRICS = ["wape", "mape", "smape", "bias", "vn1", "n"]


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _paired(actual: str, forecast: str) -> tuple[Column, Column]:
    both = F.col(actual).isNotNull() & F.col(forecast).isNotNull()
    return (F.when(both, F.col(actual).cast("double")), F.when(both, F.col(forecast).cast("double")))


def volume_metrics(actual: str, forecast: str, floor: float) -> tuple[Column, Column, Column]:
    """(WAPE, signed bias, count): pairs with a missing side do not count."""
    y, f = _paired(actual, forecast)
    volume = F.greatest(_total(y), F.lit(floor))
    return _total(F.abs(f - y)) / volume, _total(f - y) / volume, F.count(y)


def point_metrics(actual: str = "actual", forecast: str = "forecast") -> list[Column]:
    y, f = _paired(actual, forecast)
    wape, bias, n = volume_metrics(actual, forecast, 1e-9)
    size = F.abs(y) + F.abs(f)
    return [
        wape.alias("wape"),
        F.avg(F.when(y > 0, F.try_divide(F.abs(f - y), y))).alias("mape"),
        F.avg(F.when(size > 0, F.try_divide(2 * F.abs(f - y), size))).alias("smape"),
        bias.alias("bias"),
        (wape + F.abs(bias)).alias("vn1"),
        n.alias("n"),
    ]


def stable_mean(value: Column, digits: int = 9) -> Column:
    """A mean that has the same bits in any order of rows: values are added as decimals of ``digits`` places.

    For means that are compared with each other; values up to 1e19.
    """
    exact = F.sum(value.cast(f"decimal({19 + digits},{digits})")).cast("double")
    return F.try_divide(exact, F.count(value).cast("double"))


def hourly_metrics(actual: str, forecast: str) -> list[Column]:
    """The hourly half's set: WAPE, signed bias, their VN1 sum and the count."""
    wape, bias, n = volume_metrics(actual, forecast, 1e-12)
    return [wape.alias("wape"), bias.alias("wpe_bias"), (wape + F.abs(bias)).alias("vn1"), n.alias("n")]


def evaluate(df: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    return df.groupBy(*by).agg(*point_metrics(actual, forecast))


def evaluate_at_level(df: DataFrame, level: list[str], freq: str | None = "week", model: str = "model",
                      actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Sum actual and forecast to a decision level first, then score per model.

    A sum is missing only when all its parts are. Folds are not a key: a week straddling two folds
    is one week.
    """
    keys = [F.col(model), *[F.col(c) for c in level]]
    if freq == "week":
        keys.append(week_start().alias("period"))
    elif freq:
        keys.append(F.date_trunc(freq, F.col("date")).cast("date").alias("period"))
    summed = df.groupBy(*keys).agg(F.sum(actual).alias("level_actual"), F.sum(forecast).alias("level_forecast"))
    return evaluate(summed, [model], "level_actual", "level_forecast")


def mase(scored: DataFrame, history: DataFrame, by: list[str], actual: str = "actual", forecast: str = "forecast",
         train: str = "demand_target", season: int = 7) -> DataFrame:
    """Mean absolute error over the in-sample error of repeating the value ``season`` points ago.

    The shift runs over the observed history only: missing points are dropped before it.
    """
    w = Window.partitionBy(*by).orderBy("date")
    scale = (history.where(F.col(train).isNotNull())
             .withColumn("step", F.abs(F.col(train) - F.lag(train, season).over(w)))
             .groupBy(*by).agg(F.avg("step").alias("scale")))
    y, f = _paired(actual, forecast)
    errors = scored.groupBy(*by).agg(F.avg(F.abs(f - y)).alias("mae"))
    return (errors.join(scale, by, "left")
            .select(*by, F.when(F.col("scale") > 0, F.try_divide("mae", "scale")).alias("mase")))
