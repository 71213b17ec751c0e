"""Daily and hourly panels derived from the order-line and event tables used for testing.

Every adapter reads its whole tables. The daily panel keeps one raw row per order line, so several
lines of one store, SKU and day are the duplicates rule R1 removes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.features import add_sibling_promo, build_features
from shelfcast.operators.quality import apply_rules
from shelfcast.operators.segments import classify_demand
from shelfcast.schemas import KEYS, fold_origins
from shelfcast.session import partitions_for, state_of, written_once

# The order in which lines of one key arrive; together these columns order them totally.
ARRIVAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
           "l_returnflag", "l_linestatus"]
# Lines that a task joins and orders before it drops duplicates: about 430 MB.
LINES = 1_000_000
YEARS = range(1995, 2003)
HOLIDAYS = {**{f"{y}-11-11": 1.35 for y in YEARS}, **{f"{y}-12-12": 1.25 for y in YEARS},
            **{f"{y}-12-25": 1.4 for y in YEARS}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze sales: store = supplier nation, SKU = part type.

    Part types sell differently (all of a line's quantity, only what exceeds a limit, or its square),
    so that every demand segment occurs.
    """
    promo = (F.when(F.col("l_discount") > 0.095, 0.20).when(F.col("l_discount") > 0.085, 0.15)
             .when(F.col("l_discount") > 0.075, 0.10).otherwise(0.0))
    quantity = F.col("l_quantity").cast("int")
    beyond = F.greatest(quantity - 25, F.lit(0))
    demand = (F.when(F.col("sku_id").isin("ECONOMY", "PROMO"), quantity)
              .when(F.col("sku_id") == "STANDARD", F.floor(quantity * quantity / 50).cast("int"))
              .when(F.col("sku_id") == "LARGE", F.floor(beyond * beyond / 25).cast("int"))
              .otherwise(beyond))
    returned = (F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.005)
    price = F.col("p_retailprice") * (1 - F.col("discount_pct"))
    typo = (quantity == 50) & (F.col("l_tax") > 0.075)
    lines = table(spark, sf_dir, "lineitem").select(*ARRIVAL, F.col("l_shipdate").cast("date").alias("date"))
    # nations are a fixed list; suppliers and parts grow, so their joins are left to the optimizer
    sites = (table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
             .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
             .select("l_suppkey", F.col("n_name").alias("store_id")))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("sku_id"),
                                                "p_retailprice")
    # the join's own exchange, with a number of partitions that grows with the lines
    placed = lines.join(sites, "l_suppkey").repartition(partitions_for(spark, lines.count(), LINES), "l_partkey")
    return (placed.join(parts, "l_partkey")
            .withColumn("discount_pct", promo)
            .select("store_id", "sku_id", "date",
                    F.when(returned, -quantity).otherwise(demand).alias("units_sold"),
                    demand.alias("true_demand"),
                    F.when(typo, price * 100).otherwise(price).alias("selling_price"),
                    F.col("p_retailprice").alias("regular_price"),
                    (F.col("discount_pct") > 0).cast("int").alias("on_promo"), "discount_pct",
                    ((F.col("l_tax") > 0.075) & (F.col("l_linestatus") == "O") & (quantity != 50)).cast("int")
                    .alias("stockout_flag"),
                    *ARRIVAL))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("sku_id"))
            .agg(F.min("p_retailprice").alias("base_price"))
            .select("sku_id", F.when(F.col("sku_id").isin("SMALL", "MEDIUM", "LARGE"), "sized").otherwise("tiered")
                    .alias("category"), "base_price",
                    F.round(F.col("base_price") * (0.5 + 0.01 * F.length("sku_id")), 2).alias("unit_cost")))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return (table(spark, sf_dir, "nation")
            .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(size, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .select(F.col("n_name").alias("store_id"), F.col("r_name").alias("region"),
                    (F.coalesce("n", F.lit(0)) / F.lit(10.0)).alias("store_size")))


FOLDS = 4
_BOUNDS: dict[tuple[str, str, str], tuple[dt.date, dt.date]] = {}


def bounds(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    """First and last ship date: two values, read from one column once per session and state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir))
    if key not in _BOUNDS:
        _BOUNDS[key] = read_bounds(spark, sf_dir)
    return _BOUNDS[key]


def read_bounds(spark: SparkSession, sf_dir: str) -> tuple[dt.date, dt.date]:
    row = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    return row[0], row[1]


def bounds_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([bounds(spark, sf_dir)], "first_day date, last_day date")


def cutoffs(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    return fold_origins(bounds(spark, sf_dir)[1], FOLDS)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with all rules applied and their marks: silver and the scorecard both read it."""
    return written_once(spark, sf_dir, "marked", lambda: apply_rules(daily_sales(spark, sf_dir), ARRIVAL, bounds_frame(spark, sf_dir)))


def build_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = marked(spark, sf_dir).drop("is_negative", "is_price_outlier")
    # promotions of siblings are known for days with records only
    siblings = F.when(F.col("is_filled"), 0).otherwise(F.col("n_sibling_promo"))
    return add_sibling_promo(cleaned, products(spark, sf_dir)).withColumn("n_sibling_promo", siblings).drop("is_filled")


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "silver", lambda: build_silver(spark, sf_dir), KEYS)


def build_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the history before the first fold only."""
    first = cutoffs(spark, sf_dir)[0]
    return classify_demand(silver(spark, sf_dir).where(F.col("date") <= F.lit(first)))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "segments", lambda: build_segments(spark, sf_dir))


def build_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_features(silver(spark, sf_dir), products(spark, sf_dir), stores(spark, sf_dir),
                          segments(spark, sf_dir), HOLIDAYS)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "gold", lambda: build_gold(spark, sf_dir), KEYS)


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: hourly value of all but error events, error hours as stock-outs."""
    ev = table(spark, sf_dir, "events")
    hour, error = F.hour("ts"), F.col("event_type") == "error"
    cells = [F.sum(F.when((hour == h) & ~error, F.col("value"))).alias(f"s{h}") for h in range(24)]
    flags = [F.max(F.when((hour == h) & error, 1)).alias(f"o{h}") for h in range(24)]
    days = ev.groupBy(F.col("user_id").alias("store_id"), F.col("ts").cast("date").alias("dt")).agg(
        *cells, *flags,
        F.max((F.col("event_type") == "signup").cast("int")).alias("activity_flag"),
        F.avg((F.col("event_type") == "click").cast("double")).alias("precpt"),
        F.count(F.lit(1)).alias("n_events"))
    flag = [F.coalesce(f"o{h}", F.lit(0)) for h in range(24)]
    sale = [F.when(flag[h] == 1, 0.0).otherwise(F.coalesce(f"s{h}", F.lit(0.0))) for h in range(24)]
    listed = days.withColumns({"hours_sale": F.array(*sale), "hours_stock_status": F.array(*flag)})
    store = F.col("store_id")
    return listed.select(
        F.pmod(store, F.lit(2)).alias("city_id"), "store_id", F.pmod(store, F.lit(7)).alias("management_group_id"),
        F.pmod(store, F.lit(3)).alias("first_category_id"), F.pmod(store, F.lit(4)).alias("second_category_id"),
        F.pmod(store, F.lit(5)).alias("third_category_id"), F.lit(0).cast("long").alias("product_id"), "dt",
        F.aggregate("hours_sale", F.lit(0.0), lambda a, x: a + x).alias("sale_amount"), "hours_sale",
        F.aggregate(F.slice("hours_stock_status", 7, 16), F.lit(0), lambda a, x: a + x).alias("stock_hour6_22_cnt"),
        "hours_stock_status",
        F.when(F.col("activity_flag") == 1, 0.9).otherwise(1.0).alias("discount"),
        (F.weekday("dt") >= 5).cast("int").alias("holiday_flag"), "activity_flag", "precpt",
        (20.0 + F.dayofmonth("dt") / 10).alias("avg_temperature"),
        (50.0 + F.col("n_events")).alias("avg_humidity"), F.lit(1.0).alias("avg_wind_level"))


def hourly_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Everything but the last seven days, and the last seven days."""
    last = table(spark, sf_dir, "events").agg(F.max("ts").cast("date")).first()[0]
    split = F.lit(last - dt.timedelta(days=7))
    panel = written_once(spark, sf_dir, "hourly", lambda: hourly_panel(spark, sf_dir))
    return panel.where(F.col("dt") <= split), panel.where(F.col("dt") > split)
