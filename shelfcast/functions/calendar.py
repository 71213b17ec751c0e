"""Calendar columns and holiday calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.schemas import HOLIDAY_RAMP, HOLIDAYS, PAYDAYS

MAX_DAYS_AHEAD = 60


def week_start(date: str = "date") -> Column:
    """Monday of the week."""
    return F.date_trunc("week", F.col(date)).cast("date")


def days_to_next(date: str, holidays: list[str]) -> Column:
    """Days until the first listed day on or after ``date``, at most 60; 60 when none is left.

    The list is a literal inside the projection, so the forward as-of lookup needs no join.
    """
    listed = F.array(*[F.lit(d).cast("date") for d in sorted(set(holidays))])
    ahead = F.array_min(F.filter(listed, lambda d: d >= F.col(date)))
    return F.coalesce(F.least(F.datediff(ahead, F.col(date)), F.lit(MAX_DAYS_AHEAD)), F.lit(MAX_DAYS_AHEAD))


def add_calendar(df: DataFrame, holidays: dict[str, float] | None = None) -> DataFrame:
    """Weekday (Monday 0), month day, month, ISO week, weekend, pay-day window and days to holiday."""
    holidays = HOLIDAYS if holidays is None else holidays
    return df.withColumns({
        "dow": F.weekday("date"),
        "dom": F.dayofmonth("date"),
        "month": F.month("date"),
        "weekofyear": F.weekofyear("date"),
        "is_weekend": (F.weekday("date") >= 5).cast("int"),
        "is_payday_window": F.dayofmonth("date").isin(PAYDAYS).cast("int"),
        "days_to_holiday": days_to_next("date", list(holidays)),
    })


def holiday_calendar(spark: SparkSession, days: DataFrame, holidays: dict[str, float] | None = None) -> DataFrame:
    """Per day: the strongest holiday multiplier in force and whether any holiday window covers it.

    ``days`` has one ``date`` column. The holiday list is a constant of a few dozen rows.
    """
    holidays = HOLIDAYS if holidays is None else holidays
    listed = spark.createDataFrame(sorted(holidays.items()), "holiday string, multiplier double")
    ramp = F.array(*[F.struct(F.lit(n).alias("ahead"), F.lit(w).alias("weight")) for n, w in HOLIDAY_RAMP])
    felt = (listed.withColumn("r", F.explode(ramp))
            .select(F.date_sub(F.to_date("holiday"), F.col("r.ahead")).alias("date"),
                    (1 + (F.col("multiplier") - 1) * F.col("r.weight")).alias("m"))
            .groupBy("date").agg(F.max("m").alias("m")))
    return (days.join(F.broadcast(felt), "date", "left")
            .select("date", F.greatest(F.coalesce("m", F.lit(1.0)), F.lit(1.0)).alias("holiday_mult"),
                    F.col("m").isNotNull().cast("int").alias("is_holiday_window")))
