"""Table, CSV and panel sources and sinks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.schemas import HOURLY_PANEL, PANEL_KEY
from shelfcast.functions.quantiles import running_total_by_hash


def _is_path(target: str) -> bool:
    return "/" in target or os.sep in target


def read_table(spark: SparkSession, target: str) -> DataFrame:
    """Lazy scan of a catalog table, or of a parquet folder when ``target`` is a path."""
    return spark.read.parquet(target) if _is_path(target) else spark.table(target)


def write_table(df: DataFrame, target: str, mode: str = "overwrite",
                partition_by: list[str] | None = None, sort_by: list[str] | None = None,
                bucket_by: list[str] | None = None, buckets: int = 0, range_by: list[str] | None = None) -> None:
    """Write a table. ``sort_by`` orders rows inside each file only; ``range_by`` gives each file its own range of keys.

    A catalog table bucketed by the series key serves every later series window, series aggregate
    and series join without another shuffle.
    """
    if bucket_by and _is_path(target):
        raise ValueError("bucketed tables live in the catalog, not at a path")
    if range_by:
        df = df.repartitionByRange(*range_by)
    if sort_by and not bucket_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by)
        if sort_by:
            writer = writer.sortBy(*sort_by)
    if _is_path(target):
        writer.parquet(target)
    else:
        writer.saveAsTable(target)


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with one column per week; everything is read as text and typed by ``melt_weeks``."""
    return spark.read.option("header", True).csv(path)


def melt_weeks(wide: DataFrame, ids: list[str], value: str = "units_sold") -> DataFrame:
    """Turn one column per period into (ids, date, value) rows."""
    periods = [c for c in wide.columns if c not in ids]
    return (wide.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in periods], "date", value)
            .withColumn("date", F.to_date("date")))


def fixed_width(arr: Column | str, width: int = 24, filler: Column | None = None) -> Column:
    """Pad with zeros or truncate so that every list has ``width`` items."""
    zero = F.lit(0.0) if filler is None else filler
    return F.slice(F.concat(F.col(arr) if isinstance(arr, str) else arr, F.array_repeat(zero, width)), 1, width)


def panel_keys(panel: DataFrame) -> DataFrame:
    return panel.select(*PANEL_KEY).distinct()


def sample_stores(keys: DataFrame, n_series: int | None, seed: int = 42) -> DataFrame:
    """Whole stores, in a seeded random order, until about ``n_series`` series are covered.

    The order is a hash of the store, so it does not depend on how the data is partitioned. The
    last store taken is the one that crosses the target. Without a target every key is kept.
    """
    if not n_series:
        return keys
    per_store = keys.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_in_store"))
    ranked = running_total_by_hash(per_store, "store_id", "n_in_store", seed)
    chosen = ranked.where(F.col("total_before") < n_series).select("store_id")
    return keys.join(chosen, "store_id", "left_semi")


def normalise_panel(raw: DataFrame) -> DataFrame:
    """Declared types, real dates and 24-item lists for an hourly panel."""
    cols = []
    for f in HOURLY_PANEL.fields:
        if f.name == "dt":
            cols.append(F.to_date("dt").alias("dt"))
        elif f.name == "hours_sale":
            cols.append(fixed_width(F.col("hours_sale").cast(f.dataType)).alias(f.name))
        elif f.name == "hours_stock_status":
            cols.append(fixed_width(F.col(f.name).cast(f.dataType), 24, F.lit(0)).alias(f.name))
        else:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
    extra = [c for c in raw.columns if c not in HOURLY_PANEL.fieldNames()]
    return raw.select(*cols, *extra)


def keep_keys(panel: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Rows of exactly the wanted (store, product) pairs."""
    return panel if keys is None else panel.join(keys.select(*PANEL_KEY), PANEL_KEY, "left_semi")


def key_ranges(keys: DataFrame, column: str = "store_id", most: int = 32) -> list[tuple]:
    """At most ``most`` (lowest, highest) ranges that hold all keys of a numeric column, without the wide gaps between them."""
    ends = keys.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends["a"] is None:
        return []
    width = (ends["b"] - ends["a"]) / most + 1e-9
    part = F.least(F.floor((F.col(column) - F.lit(ends["a"])) / F.lit(width)), F.lit(most - 1))
    found = keys.groupBy(part.alias("part")).agg(F.min(column).alias("a"), F.max(column).alias("b")).orderBy("a").collect()
    return [(r["a"], r["b"]) for r in found]


def in_ranges(column: str, ranges: list[tuple]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | F.col(column).between(F.lit(a), F.lit(b))
    return out


def load_panel(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The panel, or the rows of the wanted (store, product) pairs.

    Ranges of the wanted stores reach the scan as a filter, so that files and row groups of a panel written in ranges of
    stores (``write_table(range_by=["store_id"])``) are skipped; the exact pairs are joined afterwards.
    """
    panel = spark.read.parquet(path)
    if keys is None:
        return normalise_panel(panel)
    return normalise_panel(keep_keys(panel.where(in_ranges("store_id", key_ranges(keys))), keys))


def concat_splits(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Union of both splits, each row labelled with the split it came from."""
    return (train.withColumn("split", F.lit("train"))
            .unionByName(evaluation.withColumn("split", F.lit("eval"))))


def promo_calendar(sales: DataFrame) -> DataFrame:
    """The distinct promoted (date, store, sku) with their discount."""
    return (sales.where(F.col("on_promo") == 1)
            .select("date", "store_id", "sku_id", "discount_pct").distinct())


def feature_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """The model's input names as a table."""
    return spark.createDataFrame([(n,) for n in names], T.StructType([T.StructField("feature", T.StringType())]))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV, one file per partition; a table of a few rows has one."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition."""
    df.write.mode("overwrite").json(path)
