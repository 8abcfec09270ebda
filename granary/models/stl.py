"""Seasonal-trend decomposition by loess (Cleveland and others, 1990), not robust, for one evenly spaced series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from granary.operators.scale import spread

SERIES = ["item_id", "location_id"]


def _odd_from(x: float) -> int:
    n = int(np.ceil(x))
    return n if n % 2 else n + 1


_smoothers: dict[tuple[int, int, bool], tuple[np.ndarray, np.ndarray]] = {}


def _smoother(n: int, width: int, extend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour indices and weights of a local line, kept per length while a task runs."""
    key = (n, width, extend)
    if key not in _smoothers:
        if len(_smoothers) > 256:
            _smoothers.clear()
        _smoothers[key] = _local_lines(n, width, extend)
    return _smoothers[key]


def _local_lines(n: int, width: int, extend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour indices and weights of a local line at every position; with `extend` also one step past each end."""
    span = min(width, n)
    positions = np.arange(-1, n + 1) if extend else np.arange(n)
    first = np.clip(positions - (width - 1) // 2, 0, n - span)
    index = first[:, None] + np.arange(span)[None, :]
    distance = np.abs(index - positions[:, None])
    reach = distance.max(axis=1).astype(float) + max(0, (width - n) // 2)
    relative = distance / np.maximum(reach, 1e-12)[:, None]
    weight = np.where(relative <= 0.999, (1 - np.minimum(relative, 1.0) ** 3) ** 3, 0.0)
    weight[relative <= 0.001] = 1.0
    weight /= weight.sum(axis=1, keepdims=True)
    centre = (weight * index).sum(axis=1, keepdims=True)
    variance = (weight * (index - centre) ** 2).sum(axis=1, keepdims=True)
    sloped = np.sqrt(variance) > 0.001 * max(n - 1, 1)
    tilt = np.where(sloped, (positions[:, None] - centre) / np.where(sloped, variance, 1.0), 0.0)
    return index, weight * (1 + tilt * (index - centre))


def _loess(y: np.ndarray, width: int, extend: bool = False) -> np.ndarray:
    index, weight = _smoother(len(y), width, extend)
    return (y[index] * weight).sum(axis=1)


def _moving_average(y: np.ndarray, n: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], y]))
    return (total[n:] - total[:-n]) / n


def decompose(y: np.ndarray, period: int, seasonal: int = 7, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual) of a series of at least two periods."""
    n = len(y)
    trend_width = _odd_from(1.5 * period / (1 - 1.5 / seasonal))
    low_width = _odd_from(period + 1)
    trend, season = np.zeros(n), np.zeros(n)
    for _ in range(rounds):
        cycles = np.empty(n + 2 * period)
        for phase in range(period):
            smoothed = _loess((y - trend)[phase::period], seasonal, extend=True)
            cycles[phase::period][: len(smoothed)] = smoothed
        low = _moving_average(_moving_average(_moving_average(cycles, period), period), 3)
        season = cycles[period : period + n] - _loess(low, low_width)
        trend = _loess(y - season, trend_width)
    return trend, season, y - season - trend


def strength(y: np.ndarray, period: int = 7) -> float:
    """Spread of the seasonal part over spread of seasonal plus residual; 0 below two periods."""
    if len(y) < 2 * period:
        return 0.0
    _, season, rest = decompose(y, period)
    total = season.std() + rest.std()
    return float(season.std() / total) if total > 0 else 0.0


def seasonal_strength(
    df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", period: int = 7, date: str = "date"
) -> DataFrame:
    """Loess-based seasonal strength per series; a group is one series of calendar days."""
    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seasonality_strength double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(date)[value].to_numpy(dtype=float)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "seasonality_strength": strength(y, period)}])

    return spread(df.select(*keys, date, value), *keys).groupBy(*keys).applyInPandas(one, schema)
