"""Order statistics and running totals that never bring a whole column into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole_if_close(position: Column) -> Column:
    return F.when(F.abs(position - F.round(position)) < F.lit(1e-12) * F.col("n_all"), F.round(position)).otherwise(position)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    accuracy: int = 20_000, few_groups: bool = False) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group.

    Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable
    sketch first brackets each wanted rank, repeated values are collapsed by a count, and only the
    values inside a bracket (about 8/accuracy of a group, or all of a group of up to ``accuracy``
    rows) are put in order. The sketch only decides
    how many values are looked at; the result is exact because the rows below each bracket are
    counted, not estimated.

    ``few_groups`` promises a number of groups fixed by the caller (a list of features, say): the
    brackets, one row per group, are then broadcast, so a huge group is never shuffled to one task.

    Returns ``by`` columns, ``prob_id`` (position in ``probs``) and ``quantile``.
    """
    by = by or []
    data = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    # more than the sketch's own error, so both neighbours of a rank are inside its bracket
    slack = 3.0 / accuracy
    lows = [max(0.0, p - slack) for p in probs]
    highs = [min(1.0, p + slack) for p in probs]
    sketch = data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"),
        F.percentile_approx("v", lows + highs, accuracy).alias("marks"),
    )
    k, small = len(probs), F.col("n_all") <= accuracy
    targets = F.array(*[
        F.struct(
            F.lit(i).alias("prob_id"),
            F.when(small | F.lit(lows[i] == 0.0), F.col("v_min")).otherwise(F.col("marks")[i]).alias("low"),
            F.when(small | F.lit(highs[i] == 1.0), F.col("v_max")).otherwise(F.col("marks")[k + i]).alias("high"),
            _whole_if_close(F.lit(float(p)) * (F.col("n_all") - 1)).alias("position"),
        ) for i, p in enumerate(probs)])
    brackets = sketch.select(*by, targets.alias("targets"))
    counted = data.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    if not by:
        joined = counted.crossJoin(F.broadcast(brackets))
    else:
        joined = counted.join(F.broadcast(brackets) if few_groups else brackets, by)
    # one row per (distinct value, bracket it is in or below); values above every bracket vanish,
    # and everything below a bracket falls into one row with a NULL value
    ordered = (joined.select(*by, "v", "c", F.explode("targets").alias("t"))
               .where(F.col("v") <= F.col("t.high"))
               .groupBy(*by, F.col("t.prob_id").alias("prob_id"), F.col("t.position").alias("position"),
                        F.when(F.col("v") >= F.col("t.low"), F.col("v")).alias("v"))
               .agg(F.sum("c").alias("c")))
    upto = F.sum("c").over(Window.partitionBy(*by, "prob_id").orderBy(F.col("v").asc_nulls_first())
                           .rowsBetween(Window.unboundedPreceding, 0))
    ranked = ordered.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("c"))
    low_rank, high_rank = F.floor("position"), F.ceil("position")

    def at(rank):
        return F.max(F.when((F.col("after") <= rank) & (rank < F.col("upto")), F.col("v")))

    return (ranked.groupBy(*by, "prob_id")
            .agg(at(low_rank).alias("a"), at(high_rank).alias("b"), F.max(F.col("position") - low_rank).alias("part"))
            .select(*by, "prob_id", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile")))


def exact_median(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median",
                 accuracy: int = 20_000) -> DataFrame:
    by = by or []
    return exact_quantiles(df, value, [0.5], by, accuracy).select(*by, F.col("quantile").alias(name))


def seeded_hash(key: Column, seed: int) -> Column:
    """60 bits of the MD5 of "key:seed", which any SQL engine can compute as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def running_total_by_hash(df: DataFrame, key: str, amount: str, seed: int) -> DataFrame:
    """``total_before``: the amount of all rows ordered before this one by a seeded hash of ``key``.

    Rows are cut into equal ranges of the hash; only the range totals meet in one task.
    """
    data = df.withColumn("h", seeded_hash(F.col(key), seed)).withColumn("range_id", F.shiftright("h", 50))  # 1024 equal ranges
    totals = data.groupBy("range_id").agg(F.sum(amount).alias("range_total"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range_id", F.coalesce(F.sum("range_total").over(before), F.lit(0)).alias("range_start"))
    inner = Window.partitionBy("range_id").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    return (data.join(F.broadcast(starts), "range_id")
            .withColumn("total_before", F.col("range_start") + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
            .drop("range_id", "range_start"))


def top_share(df: DataFrame, amount: str, share_divisor: int) -> DataFrame:
    """Total of the largest ``max(1, n div share_divisor)`` amounts, without ranking all rows.

    The k-th largest value is found exactly; ties at that value contribute equally, so the total
    needs only counts and sums on either side of it. One row: ``k``, ``top_total``, ``total``.
    """
    sized = df.agg(F.count(amount).alias("n"), F.sum(amount).alias("total"))
    n_row = sized.first()
    n = n_row["n"] or 0
    if n == 0:
        return sized.select(F.lit(0).cast("long").alias("k"), F.lit(None).cast("double").alias("top_total"), "total")
    k = max(1, n // share_divisor)
    edge = exact_quantiles(df, amount, [0.0 if n == 1 else (n - k) / (n - 1)]).select(F.col("quantile").alias("edge"))
    return (df.crossJoin(F.broadcast(edge))
            .agg(F.sum(F.when(F.col(amount) > F.col("edge"), F.col(amount))).alias("above"),
                 F.count(F.when(F.col(amount) > F.col("edge"), 1)).alias("n_above"),
                 F.max("edge").alias("edge"), F.sum(amount).alias("total"))
            .select(F.lit(k).cast("long").alias("k"),
                    (F.coalesce("above", F.lit(0.0)) + (F.lit(k) - F.col("n_above")) * F.col("edge")).alias("top_total"),
                    "total"))
