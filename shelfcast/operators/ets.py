"""Damped-trend Holt-Winters with a multiplicative weekly season, one fit per series and fold."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.series import by_series, whole_series
from shelfcast.operators.baselines import croston_sba
from shelfcast.schemas import FORECASTS, HORIZON, SERIES

SEASON = 7
HISTORY = 365
SIDE_BY_SIDE = 64


def _candidates(centre: np.ndarray | None, width: float) -> np.ndarray:
    """alpha, beta, gamma, phi (first axis) of the candidates of each series: a coarse grid, or a finer one around the best so far."""
    if centre is None:
        axes = [(0.05, 0.2, 0.5), (0.01, 0.1), (0.05, 0.2), (0.85, 0.98)]
        return np.array(np.meshgrid(*axes)).reshape(4, 1, -1)
    near = np.clip(np.stack([centre / width, centre, centre * width]), 0.001, 0.995)  # 3 x 4 x series
    pick = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1)
    return np.stack([near[pick[k], k].T for k in range(4)])


def _smooth(y: np.ndarray, params: np.ndarray):
    """Run every candidate over every series (rows) at once; squared one-step errors and the final state."""
    alpha, beta, gamma, phi = params
    first, second = y[:, :SEASON].mean(1, keepdims=True), y[:, SEASON:2 * SEASON].mean(1, keepdims=True)
    shape = (len(y), params.shape[2])
    level = np.broadcast_to(first, shape)
    trend = np.broadcast_to((second - first) / SEASON, shape)
    season = [np.broadcast_to(y[:, t:t + 1] / first, shape) for t in range(SEASON)]
    sse = np.zeros(shape)
    for t in range(y.shape[1]):
        s, value = season[t % SEASON], y[:, t:t + 1]
        base = level + phi * trend
        sse += (value - base * s) ** 2
        new_level = alpha * value / s + (1 - alpha) * base
        trend = beta * (new_level - level) + (1 - beta) * phi * trend
        season[t % SEASON] = gamma * value / base + (1 - gamma) * s
        level = new_level
    return np.where(np.isfinite(sse), sse, np.inf), level, trend, np.stack(season)


def holt_winters_many(y: np.ndarray, horizon: int, given: tuple[float, ...] | None = None) -> np.ndarray:
    """Forecasts of series of one length (rows): of ``y + 1`` minus 1, never below 0; the last week again where nothing fits.

    ``given``: alpha, beta, gamma and phi that are used as they are instead of searched.
    """
    fallback = np.clip(y[:, np.arange(-min(SEASON, y.shape[1]), 0)[np.arange(horizon) % min(SEASON, y.shape[1])]], 0, None)
    if y.shape[1] < 2 * SEASON:
        return fallback
    shifted = y[:, -HISTORY:] + 1.0
    rows, fits, centre = np.arange(len(y)), np.ones(len(y), bool), None
    with np.errstate(all="ignore"):
        for width in (None, 1.6, 1.25) if given is None else (None,):
            grid = _candidates(centre, width) if given is None else np.array(given, float).reshape(4, 1, 1)
            sse, level, trend, season = _smooth(shifted, grid)
            best = np.argmin(sse, 1)
            fits &= np.isfinite(sse[rows, best])
            centre = grid[:, 0, best] if centre is None else grid[:, rows, best]
        steps = np.arange(1, horizon + 1)
        damp = np.cumsum(centre[3][:, None] ** steps, 1)
        index = (shifted.shape[1] + steps - 1) % SEASON
        f = (level[rows, best][:, None] + damp * trend[rows, best][:, None]) * season[index][:, rows, best].T - 1.0
    fits &= np.isfinite(f).all(1)
    return np.where(fits[:, None], np.clip(f, 0, None), fallback)


def holt_winters(y: np.ndarray, horizon: int) -> np.ndarray:
    """``holt_winters_many`` of one series."""
    return holt_winters_many(np.asarray(y, float)[None, :], horizon)[0]


def ets(panel: DataFrame, segments: DataFrame, cutoffs: list[dt.date], horizon: int = HORIZON,
        demand: str = "demand_filled", given: tuple[float, ...] | None = None) -> DataFrame:
    """Holt-Winters for smooth and erratic series; the others take the Croston forecast.

    A series is sent once, in one exchange, whatever the number of folds; windows of one length of many series and
    folds are fitted side by side. ``given``: one set of alpha, beta, gamma and phi for all series.
    """
    routed = panel.select(*SERIES, "date", demand).join(segments.select(*SERIES, "segment"), SERIES)
    steady = F.col("segment").isin("smooth", "erratic")
    used = (F.col("date") <= F.lit(max(cutoffs))) & (F.col("date") > F.lit(min(cutoffs) - dt.timedelta(days=HISTORY)))
    rows = by_series(routed.where(steady & used).select(*SERIES, "date", F.col(demand).cast("double").alias("y")), SERIES, "date")
    ends = [np.datetime64(c, "D") for c in cutoffs]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_series(batches, SERIES):
            days, y = table["date"].to_numpy().astype("datetime64[D]"), table["y"].to_numpy()
            windows: dict[int, list[tuple[int, int, int]]] = {}
            for k, (a, z) in enumerate(zip(starts, starts[1:])):
                for fold, end in enumerate(ends):
                    lo, hi = a + np.searchsorted(days[a:z], [end - HISTORY + 1, end + 1])
                    if hi > lo:
                        windows.setdefault(int(hi - lo), []).append((k, fold, int(lo)))
            for n, same in sorted(windows.items()):
                for at in range(0, len(same), SIDE_BY_SIDE):
                    part = same[at:at + SIDE_BY_SIDE]
                    f = holt_winters_many(np.stack([y[lo:lo + n] for _, _, lo in part]), horizon, given)
                    take = pa.array(np.repeat([starts[k] for k, _, _ in part], horizon))
                    fold = np.repeat([fold for _, fold, _ in part], horizon)
                    date = np.concatenate([ends[x] + np.arange(1, horizon + 1) for _, x, _ in part])
                    yield pa.RecordBatch.from_arrays([table[c].combine_chunks().take(take) for c in SERIES]
                                                     + [pa.array(date), pa.array((fold + 1).astype(np.int32)), pa.array(["ets"] * len(fold)), pa.array(f.ravel())], FORECASTS.names)

    fitted = rows.mapInArrow(fit, FORECASTS)
    rest = croston_sba(routed.where(~steady), cutoffs, horizon, demand=demand).withColumn("model", F.lit("ets"))
    return fitted.unionByName(rest)
