"""Demand segments by interval (ADI) and size variation (CV squared) of non-zero demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.schemas import ADI_LIMIT, CV2_LIMIT, SERIES


def classify_demand(df: DataFrame, value: str = "demand_target", by: list[str] = SERIES) -> DataFrame:
    y = F.col(value).cast("double")
    positive = F.when(y > 0, y)
    stats = df.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.count(positive).alias("n_pos"),
        F.stddev_samp(positive).alias("sd_pos"),
        F.avg(positive).alias("avg_pos"),
        F.avg(y).alias("mean_demand"),
        F.avg((y == 0).cast("double")).alias("zero_share"),
    )
    rated = stats.select(
        *by,
        (F.col("n") / F.greatest(F.col("n_pos"), F.lit(1))).alias("adi"),
        F.when(F.col("n_pos") > 1, F.pow(F.try_divide("sd_pos", "avg_pos"), F.lit(2.0)))
        .otherwise(0.0).alias("cv2"),
        "mean_demand", "zero_share")
    frequent, steady = F.col("adi") < ADI_LIMIT, F.col("cv2") < CV2_LIMIT
    return rated.withColumn(
        "segment",
        F.when(frequent & steady, "smooth").when(frequent, "erratic").when(steady, "intermittent").otherwise("lumpy"))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment").agg(
        F.count("sku_id").alias("series"),
        F.avg("mean_demand").alias("mean_daily"),
        F.avg("zero_share").alias("zero_share"))
