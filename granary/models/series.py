"""Series models with one fit per series, the model registry, and dispatch by chosen model.

A fitted candidate is a row (keys, model, rmse, forecast array, error). Grouped-map functions see one series:
a panel keeps at most one row per calendar day and key, so a group is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.models import intermittent
from granary.operators.scale import spread
from granary.session import cut_lineage

SERIES = ["item_id", "location_id"]
Forecaster = Callable[[DataFrame, int, list[str]], DataFrame]

_REGISTRY: dict[str, Forecaster] = {}
#: Models that see one series only: (values in order, steps) -> forecasts. All of them are served by one shuffle.
AHEAD: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {}


def register_model(name: str, forecaster: Forecaster) -> None:
    """Make `forecaster(panel, steps, keys)` available by name; it returns (keys, model, rmse, forecast, error)."""
    _REGISTRY[name] = forecaster
    AHEAD.pop(name, None)  # a name registered anew no longer means the built-in model


def registered(name: str) -> Forecaster:
    return _REGISTRY[name]


def registered_models() -> list[str]:
    return sorted(_REGISTRY)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"{k} {types[k]}" for k in keys)


def per_series(name: str, fit: Callable[[np.ndarray, int], tuple[float, np.ndarray]]) -> Forecaster:
    """Turn `fit(y, steps) -> (rmse, forecasts)` into a forecaster; a failing series yields zeros and its error."""

    def run(panel: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
        schema = f"{_key_schema(panel, keys)}, model string, rmse double, forecast array<double>, error string"

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            y = pdf.sort_values("date")["demand_qty"].to_numpy(dtype=float)
            try:
                rmse, ahead = fit(y, steps)
                error = None
            except Exception as e:  # one bad series must not fail the job
                rmse, ahead, error = float("inf"), np.zeros(steps), f"{type(e).__name__}: {e}"
            row = {k: pdf[k].iloc[0] for k in keys}
            return pd.DataFrame([{**row, "model": name, "rmse": rmse, "forecast": list(map(float, ahead)), "error": error}])

        return spread(panel.select(*keys, "date", "demand_qty"), *keys).groupBy(*keys).applyInPandas(one, schema)

    return run


# --- ARIMA(1,1,1) by conditional sum of squares ---------------------------------------------------------------


def arima_residuals(w: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Innovations of differenced values `w` for each (phi, theta) pair, shape (len(w), pairs)."""
    out = np.zeros((len(w), len(phi)))
    previous = np.zeros(len(phi))
    last = 0.0
    for i, value in enumerate(w):
        previous = value - phi * last - theta * previous
        out[i] = previous
        last = value
    return out


def arima_gradient(w: np.ndarray, phi: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Innovations of `w` and their derivatives by phi and theta, shape (len(w), 2)."""
    e, slopes = [], []
    last = before = by_phi = by_theta = 0.0
    for value in w.tolist():
        by_phi, by_theta = -last - theta * by_phi, -before - theta * by_theta
        before = value - phi * last - theta * before
        last = value
        e.append(before)
        slopes.append((by_phi, by_theta))
    return np.array(e), np.array(slopes)


def fit_arima(y: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(phi, theta, innovations) minimising the conditional sum of squares.

    A grid finds the basin, Gauss-Newton steps, halved until the sum falls, its bottom; both stay inside (-0.99, 0.99).
    """
    w = np.diff(y)
    if len(w) < 3:
        raise ValueError("needs at least four observations")
    if not np.isfinite(w).all():
        raise ValueError("a value is missing or not finite")
    axis = np.linspace(-0.95, 0.95, 9)
    phi, theta = (g.ravel() for g in np.meshgrid(axis, axis))
    best = int(np.argmin((arima_residuals(w, phi, theta) ** 2).sum(axis=0)))
    at = np.array([phi[best], theta[best]])
    e, slopes = arima_gradient(w, *at)
    sse = float(e @ e)
    for _ in range(30):
        step, share, moved = np.linalg.lstsq(slopes, -e, rcond=1e-10)[0], 1.0, False
        while share > 1e-3 and not moved:
            there = at + share * step
            if np.abs(there).max() < 0.99:
                tried = arima_gradient(w, *there)
                moved = float(tried[0] @ tried[0]) < sse * (1 - 1e-12)
            share /= 2
        if not moved:
            break
        at, (e, slopes) = there, tried
        fallen, sse = sse, float(e @ e)
        if fallen - sse <= 1e-10 * fallen:
            break
    return float(at[0]), float(at[1]), e


def arima_ahead(y: np.ndarray, phi: float, theta: float, e: np.ndarray, steps: int) -> np.ndarray:
    change = phi * (y[-1] - y[-2]) + theta * e[-1]
    level, out = y[-1], []
    for _ in range(steps):
        level += change
        out.append(level)
        change *= phi
    return np.array(out)


def _arima(y: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    phi, theta, e = fit_arima(y)
    return float(np.sqrt(np.mean(e**2))), arima_ahead(y, phi, theta, e, steps)


# --- JVM-side models -------------------------------------------------------------------------------------------

HOLT_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)


def holt_fit(panel: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """Additive-trend smoothing: alpha and beta with the least squared one-step error, and the final state.

    One fold per grid point over the series' value array; the smallest (sse, alpha, beta) wins.
    """
    y = F.col(value).cast("double")
    arrays = spread(panel.select(*keys, date, value), *keys).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(date), y.alias("y")))).alias("_p"))
    arrays = arrays.select(*keys, F.col("_p.y").alias("_y"))

    def run(alpha: Column, beta: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            expected = s["level"] + s["trend"]
            level = alpha * x + (1 - alpha) * expected
            trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
            return F.struct(
                (s["sse"] + (x - expected) * (x - expected)).alias("sse"), level.alias("level"), trend.alias("trend")
            )

        start = F.struct(
            F.lit(0.0).alias("sse"),
            F.get("_y", F.lit(0)).alias("level"),
            F.coalesce(F.get("_y", F.lit(1)) - F.get("_y", F.lit(0)), F.lit(0.0)).alias("trend"),
        )
        return F.aggregate(F.slice("_y", F.lit(2), F.greatest(F.size("_y") - 1, F.lit(0))), start, step)

    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a in HOLT_GRID for b in HOLT_GRID])

    def candidate(g: Column) -> Column:
        state = run(g["alpha"], g["beta"])
        return F.struct(
            state["sse"].alias("sse"), g["alpha"].alias("alpha"), g["beta"].alias("beta"),
            state["level"].alias("level"), state["trend"].alias("trend"),
        )

    best = F.array_min(F.transform(grid, candidate))
    return arrays.select(*keys, F.size("_y").alias("n"), best.alias("_b")).select(*keys, "n", "_b.*")


def _ahead(first: Column, slope: Column, steps: int, floor: bool = False) -> Column:
    line = lambda h: first + slope * (h - 1)
    value = (lambda h: F.greatest(F.lit(0.0), line(h))) if floor else line
    return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: value(h).cast("double"))


def _row(df: DataFrame, keys: list[str], model: str, rmse: Column, ahead: Column) -> DataFrame:
    return df.select(
        *keys, F.lit(model).alias("model"), rmse.alias("rmse"), ahead.alias("forecast"),
        F.lit(None).cast("string").alias("error"),
    )


def _holt(panel: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
    rmse = F.sqrt(F.col("sse") / F.greatest(F.col("n") - 1, F.lit(1)))
    ahead = _ahead(F.col("level") + F.col("trend"), F.col("trend"), steps)
    return _row(holt_fit(panel, keys), keys, "holt_winters", rmse, ahead)


def _croston_type(method: str, model: str) -> Forecaster:
    def run(panel: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
        fitted = intermittent.fit(panel, method, keys)
        return _row(fitted, keys, model, F.col("rmse"), _ahead(F.col("base"), F.col("trend"), steps, floor=True))

    return run


def _linear(panel: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
    """Least-squares line over the day position."""
    line = Window.partitionBy(*keys).orderBy("date")
    placed = panel.select(*keys, F.col("demand_qty").alias("y"), F.row_number().over(line).cast("double").alias("x"))
    y, x = F.col("y"), F.col("x")
    stats = placed.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"),
        F.greatest(F.regr_syy(y, x) - F.coalesce(F.regr_slope(y, x), F.lit(0.0)) * F.regr_sxy(y, x), F.lit(0.0)).alias("sse"),
    )
    first = F.col("intercept") + F.col("slope") * (F.col("n") + 1)
    rmse = F.sqrt(F.col("sse") / F.col("n"))
    return _row(stats, keys, "linear_regression", rmse, _ahead(first, F.col("slope"), steps))


def _ensemble(panel: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
    """Equal-weight mean of the line, the smoothed trend and the Croston forecast."""
    members = [_linear(panel, steps, keys), _holt(panel, steps, keys), _croston_type("croston", "croston")(panel, steps, keys)]
    both = reduce(DataFrame.unionByName, members)
    means = [F.avg(F.get("forecast", F.lit(i))) for i in range(steps)]
    return both.groupBy(*keys).agg(
        F.lit("ensemble").alias("model"), F.avg("rmse").alias("rmse"), F.array(*means).alias("forecast"),
        F.lit(None).cast("string").alias("error"),
    )


for _name, _method in (("croston", "croston"), ("sba", "sba"), ("tsb", "tsb")):
    register_model(_name, _croston_type(_method, _name))
register_model("arima", per_series("arima", _arima))
register_model("holt_winters", _holt)
register_model("linear_regression", _linear)
register_model("ensemble", _ensemble)


def fit_candidates(panel: DataFrame, models: list[str], steps: int, keys: list[str] = SERIES) -> DataFrame:
    """One row per (series, candidate) with in-sample rmse and forecasts."""
    return reduce(DataFrame.unionByName, [_REGISTRY[m](panel, steps, keys) for m in models])


def choose(candidates: DataFrame, allowed: DataFrame | None = None, keys: list[str] = SERIES) -> DataFrame:
    """Candidate with the least rmse per series, ties by name. `allowed` (keys, models array) restricts the choice;
    a series none of whose models is left falls back to the linear model."""
    usable = F.col("error").isNull() & ~F.isnan("rmse") & (F.col("rmse") < float("inf"))
    if allowed is not None:
        candidates = candidates.join(allowed.select(*keys, "models"), keys, "left")
        usable = usable & F.coalesce(F.expr("array_contains(models, model)"), F.lit(False))
    best = F.min(F.when(usable, F.struct("rmse", "model")))
    return candidates.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.coalesce("_b.model", F.lit("linear_regression")).alias("model"), F.col("_b.rmse").alias("rmse")
    )


# --- Dispatch by chosen model ---------------------------------------------------------------------------------


def croston_ahead(y: np.ndarray, steps: int, method: str) -> np.ndarray:
    """The Croston family's forecast of one series, with the weights `intermittent.fit` takes."""
    at = np.flatnonzero(y > 0)
    if len(at) < 2:
        return np.full(steps, max(float(y.mean()) / (1 + 1e-8), 0.0))
    demands, gaps = y[at], np.diff(at).astype(float)
    slope = lambda n: float(np.polyfit(at[:n], demands[:n], 1)[0]) if len(at) >= 3 else 0.0
    a = min(max(0.1 + 0.2 * demands.std() / (demands.mean() + 1e-8), 0.05), 0.3)
    b = min(max(0.1 * abs(slope(len(at))), 0.01), 0.2)
    g = min(max(0.1 + 0.2 * gaps.std() / (gaps.mean() + 1e-8), 0.05), 0.3) if method == "tsb" else a
    level, interval, trend = demands[0], gaps[0], slope(3)
    for i in range(1, len(at)):
        before, level = level, a * demands[i] + (1 - a) * (level + trend)
        trend = b * (level - before) + (1 - b) * trend
        interval = g * gaps[i] + (1 - g) * interval if i < len(gaps) else interval
    if method == "sba":
        interval = max(interval - (2 - a) / (2 * (1 - a)), 0.5)
    return np.maximum(level / (interval + 1e-8) + trend * np.arange(steps), 0.0)


def holt_ahead(y: np.ndarray, steps: int) -> np.ndarray:
    """Additive-trend smoothing over the same grid as `holt_fit`, all grid points at once."""
    alpha, beta = (g.ravel() for g in np.meshgrid(HOLT_GRID, HOLT_GRID, indexing="ij"))
    level, trend = np.full(len(alpha), y[0]), np.full(len(alpha), y[1] - y[0] if len(y) > 1 else 0.0)
    sse = np.zeros(len(alpha))
    for x in y[1:]:
        expected = level + trend
        sse += (x - expected) ** 2
        before, level = level, alpha * x + (1 - alpha) * expected
        trend = beta * (level - before) + (1 - beta) * trend
    best = int(np.argmin(sse))
    return level[best] + trend[best] * np.arange(1, steps + 1)


def line_ahead(y: np.ndarray, steps: int) -> np.ndarray:
    if len(y) < 2:
        return np.full(steps, y[0])
    slope, start = np.polyfit(np.arange(len(y)), y, 1)
    return start + slope * np.arange(len(y), len(y) + steps)


def _ensemble_ahead(y: np.ndarray, steps: int) -> np.ndarray:
    return (line_ahead(y, steps) + holt_ahead(y, steps) + croston_ahead(y, steps, "croston")) / 3


def _arima_ahead_of(y: np.ndarray, steps: int) -> np.ndarray:
    return _arima(y, steps)[1]


AHEAD |= {
    "arima": _arima_ahead_of,
    "holt_winters": holt_ahead,
    "linear_regression": line_ahead,
    "ensemble": _ensemble_ahead,
    "croston": lambda y, steps: croston_ahead(y, steps, "croston"),
    "sba": lambda y, steps: croston_ahead(y, steps, "sba"),
    "tsb": lambda y, steps: croston_ahead(y, steps, "tsb"),
}


def forecast_each(panel: DataFrame, chosen: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
    """The per-series models of `AHEAD`: panel and choice meet in one cogrouped pass, whatever the number of models.

    A series whose model fails, or that has no rows, yields zeros and its error; the others are not touched by it.
    """
    models = dict(AHEAD)
    schema = f"{_key_schema(chosen, keys)}, model string, forecast array<double>, error string"

    def one(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        y = rows.sort_values("date")["demand_qty"].to_numpy(dtype=float)
        for _, a in asked.iterrows():
            try:
                if not len(y):
                    raise ValueError("no observations")
                if not np.isfinite(y).all():
                    raise ValueError("a value is missing or not finite")
                ahead, error = models[a["model"]](y, steps), None
            except Exception as e:  # one bad series must not fail the job
                ahead, error = np.zeros(steps), f"{type(e).__name__}: {e}"
            out.append([*[a[k] for k in keys], a["model"], list(map(float, ahead)), error])
        return pd.DataFrame(out, columns=[*keys, "model", "forecast", "error"])

    asked = chosen.where(F.col("model").isin(*AHEAD)).select(*keys, "model")
    rows = panel.select(*keys, "date", "demand_qty")
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(one, schema)


def forecast_chosen(panel: DataFrame, chosen: DataFrame, steps: int, keys: list[str] = SERIES) -> DataFrame:
    """Forecast every series with its chosen model only: (keys, model, step, yhat, error).

    Models of one series share one cogrouped pass; models fitted over all series are fitted once each and forecast only
    the series that chose them; registered ones read just their series. An unknown model yields zeros and an error.
    """
    chosen = cut_lineage(chosen.select(*keys, "model"))
    panel = cut_lineage(panel)
    own = [m for m in registered_models() if m not in AHEAD]
    # At most one name per registered model comes back.
    used = [r.model for r in chosen.where(F.col("model").isin(own)).select("model").distinct().orderBy("model").collect()]
    columns = [*keys, "model", "forecast", "error"]
    parts = [forecast_each(panel, chosen, steps, keys)]
    for name in used:
        asked = chosen.where(F.col("model") == name).select(*keys)
        if getattr(_REGISTRY[name], "shared", False):
            part = _REGISTRY[name](panel, steps, keys, only=asked)
        else:
            part = _REGISTRY[name](panel.join(asked, keys), steps, keys)
        parts.append(part.select(columns))
    unknown = chosen.where(~F.col("model").isin([*own, *AHEAD])).select(
        *keys, "model", F.array_repeat(F.lit(0.0), steps).alias("forecast"), F.lit("unknown model").alias("error")
    )
    rows = reduce(DataFrame.unionByName, [*parts, unknown])
    return rows.select(*keys, "model", "error", F.posexplode("forecast").alias("_i", "yhat")).select(
        *keys, "model", (F.col("_i") + 1).alias("step"), "yhat", "error"
    )


from granary.models import shared as _shared  # noqa: E402, F401  registers the models fitted over all series
