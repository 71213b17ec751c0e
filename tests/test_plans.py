import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from shelfcast.operators import baselines as B
from shelfcast.operators import features as FE
from shelfcast.operators import quality as Q
from shelfcast.sources import fixtures as X
from shelfcast.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_duplicates_are_limited_before_the_shuffle(spark):
    p = plan(Q.keep_first(X.daily_sales(spark, SF), X.ARRIVAL))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_cleaning_shuffles_once_per_key_and_once_per_series(spark):
    cleaned = Q.clean_sales(X.daily_sales(spark, SF), X.ARRIVAL, X.bounds_frame(spark, SF))
    keys = [[c.split("#")[0].strip() for c in e.split(",")][:-1] for e in exchanges(cleaned)]
    assert [k for k in keys if k[:2] == ["store_id", "sku_id"]] == [["store_id", "sku_id"], ["store_id", "sku_id", "date"]]


def test_all_demand_features_share_one_exchange(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("S", "K", dt.date(2024, 1, 1), 1.0, 2.0, 2.0)],
                          "store_id string, sku_id string, date date, demand_filled double, selling_price double,"
                          " regular_price double").write.parquet(path)
    df = FE.add_demand_history(FE.add_price_features(spark.read.parquet(path)))
    assert len(exchanges(df)) == 1


def test_recent_history_is_pruned_in_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("S", "K", dt.date(2024, 1, 1), 1.0, "x")],
                          "store_id string, sku_id string, date date, demand_filled double, other string").write.parquet(path)
    p = plan(B.weekday_repeats(spark.read.parquet(path), [dt.date(2024, 1, 1)]))
    assert "PushedFilters: [IsNotNull(date), LessThanOrEqual(date" in p and "other" not in p


def test_a_bucketed_panel_needs_no_exchange(spark):
    df = spark.range(100).select(F.concat(F.lit("S"), F.col("id") % 5).alias("store_id"), F.lit("K").alias("sku_id"),
                                 F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int")).alias("date"),
                                 F.col("id").cast("double").alias("demand_filled"))
    spark.sql("DROP TABLE IF EXISTS bucketed_panel")
    T.write_table(df, "bucketed_panel", sort_by=["store_id", "sku_id", "date"], bucket_by=["store_id", "sku_id"], buckets=4)
    try:
        assert exchanges(FE.add_demand_history(T.read_table(spark, "bucketed_panel"))) == []
    finally:
        spark.sql("DROP TABLE IF EXISTS bucketed_panel")
    with pytest.raises(ValueError):
        T.write_table(df, "/tmp/none", bucket_by=["store_id"], buckets=2)


def test_price_response_moves_no_days(spark):
    """In an iteration only keys, slopes and moments are exchanged, with broadcasts off as at any number of SKUs."""
    from shelfcast.operators import pricing as P

    rows = [("S", f"K{k}", "c", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0, 2.0 + i % 3, i % 7, 1, 0, 0, 9) for k in range(3) for i in range(30)]
    gold = spark.createDataFrame(rows, "store_id string, sku_id string, category string, date date, demand_target double, selling_price double, dow int, month int,"
                                       " on_promo int, n_sibling_promo int, days_to_holiday int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        series = P.series_rows(gold).persist()
        series.count()
        slopes = series.select("category", "sku_id").distinct().withColumn("slope", F.lit(0.0))
        joined = P._with_sku(series, series.select("category", "store_id", "sku_id"), slopes)
        text = plan(joined)
        tail = text[:text.index("InMemoryRelation")] if "InMemoryRelation" in text else text
        assert not [line for line in tail.splitlines() if "Exchange" in line and "log_price_dm" in line]
        assert joined.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        series.unpersist()


def test_no_local_folder_on_a_cluster():
    from shelfcast.session import folder_for

    assert folder_for("spark://host:7077", "hdfs://a/b", None) == "hdfs://a/b"
    assert folder_for("yarn", None, "hdfs://nn/warehouse/") == "hdfs://nn/warehouse/shelfcast-intermediate"
    for warehouse in (None, "file:/tmp/x", "/tmp/x"):
        with pytest.raises(ValueError):
            folder_for("local-cluster[2,1,1024]", None, warehouse)


def test_rewritten_sources_are_seen(spark, tmp_path):
    from shelfcast.session import written_once

    source = str(tmp_path)
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{source}/t.parquet")
        got = written_once(spark, source, "t", lambda: spark.read.parquet(f"{source}/t.parquet"))
        assert got.count() == n


def test_partitions_of_lines_grow_with_their_number(spark, tmp_path, monkeypatch):
    day, d = dt.datetime(2024, 1, 1), str(tmp_path)
    lines = [(i, i % 7, i % 3, 1, 10.0, 0.05, 0.01, "N", "O", day + dt.timedelta(days=i % 5)) for i in range(45)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double,"
                                 " l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, 0) for k in range(3)], "s_suppkey long, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(k, "SMALL", 9.0) for k in range(7)], "p_partkey long, p_type string, p_retailprice double").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    monkeypatch.setattr(X, "LINES", 5)
    sales = X.daily_sales(spark, d)
    assert sales.rdd.getNumPartitions() == 9 and sales.count() == 45
