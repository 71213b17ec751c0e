"""Price and promotion response, promotion economics and price recommendations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.quantiles import exact_median
from shelfcast.schemas import PROMO_DEPTHS, SERIES
from shelfcast.session import cut_lineage

# Shared regressors of a category; weekday 0 and month 1 are the base levels.
SHARED = ([f"dow_{d}" for d in range(1, 7)] + [f"month_{m}" for m in range(2, 13)]
          + ["log_price_dm", "on_promo", "n_sibling_promo", "holiday"])
Z95 = 1.959963984540054
_P = len(SHARED)


def design_rows(gold: DataFrame) -> DataFrame:
    """Uncensored days with the price in logs and demeaned within the series."""
    w = Window.partitionBy(*SERIES)
    rows = gold.where(F.col("demand_target").isNotNull())
    start = rows.groupBy("category").agg(F.min("date").alias("first_day"))
    log_price = F.ln("selling_price")
    return (rows.withColumn("log_price_dm", log_price - F.avg(log_price).over(w))
            .join(F.broadcast(start), "category")  # one row per category, as the driver's matrices
            .select("category", *SERIES, F.col("demand_target").cast("double").alias("y"),
                    F.col("dow").cast("double").alias("dow"), F.col("month").cast("double").alias("month"),
                    "log_price_dm", F.col("on_promo").cast("double").alias("on_promo"),
                    F.col("n_sibling_promo").cast("double").alias("n_sibling_promo"),
                    (F.col("days_to_holiday") <= 3).cast("double").alias("holiday"),
                    (F.datediff("date", "first_day") / F.lit(365.0)).alias("t")))


DAYS = ["y", "dow", "month", "log_price_dm", "on_promo", "n_sibling_promo", "holiday", "t"]


def series_rows(gold: DataFrame) -> DataFrame:
    """One row per series with its days as arrays, laid out by series; a series has a row per day at most."""
    days = F.collect_list(F.struct(*DAYS))
    series = design_rows(gold).groupBy("category", *SERIES).agg(days.alias("days"))
    parts = int(gold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (series.select("category", *SERIES, *[F.col(f"days.{c}").alias(c) for c in DAYS])
            .repartition(parts, "category", *SERIES))


def _expected(row, beta: np.ndarray, slope: float):
    """Units, regressors and fitted means of one series with its own level solved for."""
    y, dow, month = (np.asarray(getattr(row, c), float) for c in ("y", "dow", "month"))
    z = np.column_stack([dow[:, None] == np.arange(1, 7), month[:, None] == np.arange(2, 13),
                         *[np.asarray(getattr(row, c), float) for c in DAYS[3:]]]).astype(float)
    eta = z[:, :_P] @ beta + z[:, _P] * slope
    weight = np.exp(eta - eta.max())
    return y, z, y.sum() * weight / weight.sum()


def _centred(row, beta: np.ndarray, slope: float):
    """Fitted means of one series that sold, and regressors around their mean."""
    y, z, mu = _expected(row, beta, slope)
    return y, mu, z - (mu @ z) / mu.sum()


_UPPER = np.triu_indices(_P + 1)
_SHARED_UPPER = np.triu_indices(_P)
_MOMENTS = T.StructType([
    T.StructField("category", T.StringType()), T.StructField("sku_id", T.StringType()),
    T.StructField("moments", T.ArrayType(T.DoubleType()))])


def _sum_moments(df: DataFrame, by: list[str]) -> DataFrame:
    """Add up equally long arrays per group, element by element, before and after the shuffle."""
    return (df.select(*by, F.posexplode("moments").alias("at", "part"))
            .groupBy(*by, "at").agg(F.sum("part").alias("part")))


def _gathered(sums: DataFrame, by: list[str]) -> DataFrame:
    """The summed elements back in one array; its length is fixed by the regressors."""
    return (sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("m"))
            .select(*by, F.transform("m", lambda s: s["part"]).alias("m")))


def _moments_of(series: DataFrame, moments) -> DataFrame:
    """(category, sku_id, moments) of the series that sold anything, added up per SKU within each batch of series."""
    def work(batches):
        for pdf in batches:
            sums: dict[tuple, np.ndarray] = {}
            for row in pdf.itertuples(index=False):
                if np.sum(row.y) > 0:
                    key, own = (row.category, row.sku_id), moments(row)
                    sums[key] = sums[key] + own if key in sums else own
            yield pd.DataFrame({"category": [c for c, _ in sums], "sku_id": [s for _, s in sums],
                                "moments": list(sums.values())})

    return series.mapInPandas(work, _MOMENTS)


def _with_sku(series: DataFrame, keys: DataFrame, per_sku: DataFrame) -> DataFrame:
    """The columns of ``per_sku`` beside the days of each series.

    They first join the series' keys, which are few bytes; then both sides have the layout of
    ``series``, whose days are not moved.
    """
    return series.join(keys.join(per_sku, ["category", "sku_id"]), ["category", *SERIES])


def _unpack(flat: np.ndarray, size: int, upper) -> np.ndarray:
    out = np.zeros((size, size))
    out[upper] = flat
    return out + np.triu(out, 1).T


_SIZE = _P + 1
# Where the gradient entry (i,) and the Hessian entry (i, j) sit in a moments array.
_AT = {(int(i), int(j)): _SIZE + k for k, (i, j) in enumerate(zip(*_UPPER))}
_CROSS = [_AT[(i, _P)] for i in range(_P)]
# Per wanted entry of the shared block: its own position and the two factors the slope removes.
_PARTS = [(i, _CROSS[i], _P) for i in range(_P)] + [
    (_AT[(int(i), int(j))], _CROSS[int(i)], _CROSS[int(j)]) for i, j in zip(*_SHARED_UPPER)]


def _positions(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _without_slopes(m: Column) -> Column:
    """Eliminate the SKU's own trend from its summed moments (gradient, then upper Hessian)."""
    parts = F.array(*[F.struct(F.lit(a).alias("own"), F.lit(b).alias("left"), F.lit(c).alias("right"))
                      for a, b, c in _PARTS])
    curve = F.get(m, F.lit(_AT[(_P, _P)]))
    return F.transform(parts, lambda p: F.get(m, p["own"]) - F.coalesce(
        F.try_divide(F.get(m, p["left"]) * F.get(m, p["right"]), curve), F.lit(0.0)))


def _shared_only(m: Column) -> Column:
    return F.transform(_positions([a for a, _, _ in _PARTS]), lambda at: F.get(m, at))


def _slope_parts(m: Column) -> tuple[Column, Column, Column]:
    return (F.get(m, F.lit(_P)), F.transform(_positions(_CROSS), lambda at: F.get(m, at)),
            F.get(m, F.lit(_AT[(_P, _P)])))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


@dataclass
class Maximum:
    """Where the likelihood of a panel is largest: ``betas`` per category, ``slopes`` (category, sku_id, slope), the last
    step's information without series and SKU effects (``bread``), the SKU's moments and the step at which a category settled."""

    sizes: list
    betas: dict[str, np.ndarray]
    slopes: DataFrame
    bread: dict[str, np.ndarray]
    per_sku: DataFrame
    settled: dict[str, int]


def _maximum(series: DataFrame, keys: DataFrame, control_trend: bool, max_iter: int, tol: float) -> Maximum:
    """Newton steps; one small matrix per category reaches the driver in each."""
    spark = series.sparkSession
    sizes = (series.select("category", "sku_id", F.size("y").alias("n_days"))
             .groupBy("category").agg(F.sum("n_days").alias("n"), F.count(F.lit(1)).alias("n_series"),
                                      F.countDistinct("sku_id").alias("n_skus")).collect())  # a row per category
    betas = {s["category"]: np.zeros(_P) for s in sizes}
    slopes = keys.select("category", "sku_id").distinct().withColumn("slope", F.lit(0.0))
    bread, settled = {}, {}

    def newton(row) -> np.ndarray:
        y, mu, zc = _centred(row, betas[row.category], row.slope)
        return np.concatenate([zc.T @ (y - mu), ((zc * mu[:, None]).T @ zc)[_UPPER]])

    for at in range(1, max_iter + 1):
        found = _moments_of(_with_sku(series, keys, slopes), newton)
        per_sku = cut_lineage(_gathered(_sum_moments(found, ["category", "sku_id"]), ["category", "sku_id"]))
        shared = per_sku.select("category", (_without_slopes(F.col("m")) if control_trend
                                             else _shared_only(F.col("m"))).alias("moments"))
        moved = {}
        for r in _gathered(_sum_moments(shared, ["category"]), ["category"]).collect():
            m = np.array(r["m"])
            bread[r["category"]] = _unpack(m[_P:], _P, _SHARED_UPPER)
            moved[r["category"]] = np.linalg.pinv(bread[r["category"]]) @ m[:_P]
            betas[r["category"]] = betas[r["category"]] + moved[r["category"]]
            if np.abs(moved[r["category"]]).max() < tol:
                settled.setdefault(r["category"], at)
        if control_trend:
            step = spark.createDataFrame([(c, [float(v) for v in d]) for c, d in moved.items()],
                                         "category string, step array<double>")
            pull, cross, curve = _slope_parts(F.col("m"))
            change = F.coalesce(F.try_divide(pull - _dot(cross, F.col("step")), curve), F.lit(0.0))
            slopes = cut_lineage(slopes.join(per_sku.join(F.broadcast(step), "category"),
                                             ["category", "sku_id"], "left")
                                 .select("category", "sku_id",
                                         (F.col("slope") + F.coalesce(change, F.lit(0.0))).alias("slope")))
        if len(settled) == len(moved):
            break
    return Maximum(sizes, betas, slopes, bread, per_sku, settled)


def estimate_response(gold: DataFrame, control_trend: bool = True, max_iter: int = 15, tol: float = 1e-8) -> DataFrame:
    """Poisson price response of every category with series effects and a trend per SKU.

    log E[q] = series + trend_sku * t + elasticity * log(price) + promo + siblings + weekday + month
    + holiday. The maximum likelihood estimate is the one of a GLM with a dummy per series and per
    SKU trend, but neither is ever a column: a series' level is solved inside its own group, and a
    SKU's slope is eliminated from the SKU's summed moments, because two SKUs share no rows. Only
    the shared block (one small matrix per category) reaches the driver, however many series there
    are. The confidence limits are heteroskedasticity-robust (HC1). ``converged`` is false for a
    category whose last step was still ``tol`` or more after ``max_iter`` steps.
    """
    series = series_rows(gold).persist()
    spark = gold.sparkSession
    keys = series.select("category", *SERIES)
    fit = _maximum(series, keys, control_trend, max_iter, tol)
    sizes, betas, slopes, bread, per_sku, settled = fit.sizes, fit.betas, fit.slopes, fit.bread, fit.per_sku, fit.settled

    # robust part: squared residuals times what a regressor adds beyond series level and SKU trend
    if control_trend:
        _, cross, curve = _slope_parts(F.col("m"))
        ratio = F.transform(cross, lambda v: F.coalesce(F.try_divide(v, curve), F.lit(0.0)))
    else:
        ratio = F.array_repeat(F.lit(0.0), _P)
    extras = slopes.join(per_sku.select("category", "sku_id", ratio.alias("ratio")), ["category", "sku_id"])

    def spread(row) -> np.ndarray:
        y, mu, zc = _centred(row, betas[row.category], row.slope)
        x = zc[:, :_P] - np.outer(zc[:, _P], np.asarray(row.ratio, float))
        return ((x * ((y - mu) ** 2)[:, None]).T @ x)[_SHARED_UPPER]

    meats = {r["category"]: _unpack(np.array(r["m"]), _P, _SHARED_UPPER) for r in _gathered(
        _sum_moments(_moments_of(_with_sku(series, keys, extras), spread), ["category"]),
        ["category"]).collect()}
    series.unpersist()
    out = []
    for s in sizes:
        c = s["category"]
        if c not in meats:
            continue
        inverse = np.linalg.pinv(bread[c])
        k = s["n_series"] + _P + (s["n_skus"] if control_trend else 0)
        cov = inverse @ meats[c] @ inverse * s["n"] / max(s["n"] - k, 1)
        b, se = betas[c], np.sqrt(np.maximum(np.diag(cov), 0.0))
        e, g, d = (SHARED.index(v) for v in ("log_price_dm", "on_promo", "n_sibling_promo"))
        out.append((c, control_trend, float(b[e]), float(b[e] - Z95 * se[e]), float(b[e] + Z95 * se[e]),
                    float(np.exp(b[g])), float(np.exp(b[g] - Z95 * se[g])), float(np.exp(b[g] + Z95 * se[g])),
                    float(1 - np.exp(b[d])), int(s["n"]), c in settled, int(settled.get(c, max_iter))))
    return spark.createDataFrame(
        out, "category string, control_trend boolean, elasticity double, elasticity_lo double, elasticity_hi double,"
             " promo_uplift double, promo_uplift_lo double, promo_uplift_hi double,"
             " cannibalisation_per_sibling double, n_obs long, converged boolean, n_iter int")


def fitted_days(gold: DataFrame, control_trend: bool = True, max_iter: int = 15, tol: float = 1e-8) -> DataFrame:
    """Every uncensored day with its regressors and the units that the fitted model expects (``fitted``).

    A series that sold nothing expects nothing on any day.
    """
    series = series_rows(gold).persist()
    keys = series.select("category", *SERIES)
    fit = _maximum(series, keys, control_trend, max_iter, tol)
    betas = fit.betas

    def work(batches):
        for pdf in batches:
            yield pdf.drop(columns="slope").assign(fitted=[_expected(row, betas[row.category], row.slope)[2] for row in pdf.itertuples(index=False)])

    kept = T.StructType([*series.schema.fields, T.StructField("fitted", T.ArrayType(T.DoubleType()))])
    expected = _with_sku(series, keys, fit.slopes).select(*series.columns, "slope").mapInPandas(work, kept)
    days = cut_lineage(expected.select("category", *SERIES, F.inline(F.arrays_zip(*DAYS, "fitted"))))
    series.unpersist()
    return days


def response_balance(days: DataFrame) -> DataFrame:
    """What the score equations hold equal: sums of each regressor times observed and times fitted units, the
    shared ones per category, trend and units per SKU (the shared ones have no sku_id)."""
    def sums(x: dict[str, Column], by: list[str]) -> DataFrame:
        both = [F.sum(v * F.col(units)).alias(f"{units}__{name}") for name, v in x.items() for units in ("y", "fitted")]
        rows = F.array(*[F.struct(F.lit(name).alias("regressor"), F.col(f"y__{name}").alias("observed"), F.col(f"fitted__{name}").alias("fitted")) for name in x])
        return days.groupBy(*by).agg(*both).select(*by, F.inline(rows))

    levels = ({f"dow_{d}": (F.col("dow") == d).cast("double") for d in range(1, 7)}
              | {f"month_{m}": (F.col("month") == m).cast("double") for m in range(2, 13)})
    shared = sums(levels | {c: F.col(c) for c in SHARED if c not in levels}, ["category"])
    own = sums({"trend": F.col("t"), "units": F.lit(1.0)}, ["category", "sku_id"])
    return shared.withColumn("sku_id", F.lit(None).cast("string")).unionByName(own)


def compare_with_truth(response: DataFrame, truth: DataFrame) -> DataFrame:
    """Estimates next to the category means of known parameters, with the relative error."""
    means = truth.groupBy("category").agg(F.avg("true_elasticity").alias("true_elasticity"),
                                          F.avg("true_promo_uplift").alias("true_promo_uplift"))
    return (response.join(means, "category")
            .withColumn("elasticity_error_pct", F.try_divide("elasticity", "true_elasticity") - 1))


def sku_stats(gold: DataFrame, last_day, days: int = 90) -> DataFrame:
    """Network figures per SKU over the last days: non-promotional units divided by all days."""
    window = gold.where(F.col("date") > F.date_sub(F.lit(last_day), days))
    calendar = window.agg(F.countDistinct("date").alias("n_days"))
    regular = window.where(F.col("on_promo") == 0)
    prices = exact_median(regular, "regular_price", ["sku_id"], "regular_price")
    return (regular.groupBy("sku_id")
            .agg(F.min("category").alias("category"), F.min("unit_cost").alias("unit_cost"),
                 F.sum("demand_filled").alias("units"))
            .join(prices, "sku_id").crossJoin(F.broadcast(calendar))
            .select("sku_id", "category", "regular_price", "unit_cost",
                    F.try_divide(F.col("units"), F.col("n_days").cast("double")).alias("daily_units")))


def optimal_price(p0: Column, cost: Column, elasticity: Column, band: float = 0.10) -> Column:
    """Margin-maximal price of constant-elasticity demand, within a band around today's."""
    free = F.when(elasticity < -1, F.try_divide(cost * elasticity, 1 + elasticity)).otherwise(p0 * (1 + band))
    return F.least(F.greatest(free, p0 * (1 - band)), p0 * (1 + band))


def price_recommendations(skus: DataFrame, elasticities: DataFrame, band: float = 0.10) -> DataFrame:
    price, e = F.col("regular_price"), F.col("elasticity")
    return (skus.join(elasticities.select("category", "elasticity"), "category")
            .withColumn("rec_price", optimal_price(price, F.col("unit_cost"), e, band))
            .withColumns({"price_change_pct": F.try_divide(F.col("rec_price"), price) - 1,
                          "new_daily_units": F.col("daily_units") * F.pow(F.try_divide(F.col("rec_price"), price), e)})
            .withColumns({"margin_now": (price - F.col("unit_cost")) * F.col("daily_units"),
                          "margin_new": (F.col("rec_price") - F.col("unit_cost")) * F.col("new_daily_units")})
            .withColumn("annual_margin_gain", (F.col("margin_new") - F.col("margin_now")) * 365))


def ranked_recommendations(recommendations: DataFrame) -> DataFrame:
    return recommendations.orderBy(F.desc("annual_margin_gain"))


def promo_depth_economics(response: DataFrame, skus: DataFrame, gold: DataFrame, depths=PROMO_DEPTHS) -> DataFrame:
    """Incremental margin of one promotion day per store, net of what it takes from siblings.

    Every other SKU of the category counts as a sibling.
    """
    stores = gold.agg(F.countDistinct("store_id").alias("n_stores"))
    range_size = gold.groupBy("category").agg((F.countDistinct("sku_id") - 1).alias("n_siblings"))
    typical = (skus.crossJoin(F.broadcast(stores)).groupBy("category").agg(
        F.avg("regular_price").alias("price"), F.avg("unit_cost").alias("cost"),
        F.avg(F.col("daily_units") / F.col("n_stores")).alias("base_units"),
        F.avg((F.col("regular_price") - F.col("unit_cost")) * F.col("daily_units") / F.col("n_stores"))
        .alias("sibling_margin")))
    d, cost = F.col("depth"), F.col("cost")
    promo_price = F.col("price") * (1 - d)
    units = F.col("base_units") * F.col("promo_uplift") * F.pow(1 - d, F.col("elasticity"))
    loss = F.col("cannibalisation_per_sibling") * F.col("sibling_margin") * F.col("n_siblings")
    return (response.join(typical, "category").join(range_size, "category")
            .withColumn("depth", F.explode(F.array(*[F.lit(float(v)) for v in depths])))
            .select("category", "depth",
                    F.try_divide(units, F.col("base_units")).alias("units_lift_x"),
                    ((promo_price - cost) * units - (F.col("price") - cost) * F.col("base_units") - loss)
                    .alias("incremental_margin"),
                    loss.alias("cannibal_loss"),
                    F.try_divide(promo_price - cost, promo_price).alias("promo_margin_pct")))


def elasticity_table(spark: SparkSession, values: list[tuple]) -> DataFrame:
    """(category, elasticity, promo_uplift, cannibalisation_per_sibling) given by the caller."""
    return spark.createDataFrame(
        values, "category string, elasticity double, promo_uplift double, cannibalisation_per_sibling double")
