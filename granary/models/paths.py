"""One-step predictions of every position of a series: folds that keep their path and not only the last state.

The prediction of a position uses the rows before it; smoothing weights come from the training rows (all rows unless
`train` says otherwise), so a path over held-out rows is a true one-step forecast. The state after the last row is the
state of the fitted model.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.models import intermittent, series
from granary.operators.scale import spread

SERIES = ["item_id", "location_id"]
_EPS = 1e-8


def _histories(panel: DataFrame, keys: list[str]) -> DataFrame:
    """The ordered rows of each series as one array; a series has one row per calendar step."""
    rows = spread(panel.select(*keys, "date", F.col("demand_qty").cast("double").alias("y")), *keys)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "y"))).alias("_h"))


def _unfolded(pathed: DataFrame, keys: list[str], model: str) -> DataFrame:
    """(keys, date, model, actual, yhat) from the history `_h` and the path `_path`."""
    pairs = F.arrays_zip(F.col("_h.date").alias("date"), F.col("_h.y").alias("actual"), F.col("_path").alias("yhat"))
    return pathed.select(*keys, F.inline(pairs)).select(*keys, "date", F.lit(model).alias("model"), "actual", "yhat")


def croston_path(panel: DataFrame, method: str, keys: list[str] = SERIES, train: DataFrame | None = None) -> DataFrame:
    """A position's prediction is the rate that the demands and gaps before it give.

    Before the second demand it is the mean so far, at the first position the first value.
    """
    if method == "sba_variance":
        raise ValueError("the variance variant widens its gaps by later ones, so it has no one-step path")
    weights = intermittent.fit(panel if train is None else train, method, keys).select(*keys, "alpha", "beta", "gap_alpha", "trend0")
    joined = _histories(panel, keys).join(weights, keys)
    a, b, g = F.col("alpha"), F.col("beta"), F.col("gap_alpha")
    gamma = {"sba": F.when(a < 1, (2 - a) / (2 * (1 - a))).otherwise(1.0), "sba_m": F.when(a < 1, (1 - a) / 2).otherwise(0.5)}.get(method)

    def rate(s: Column) -> Column:
        divisor = s["interval"] if gamma is None else F.greatest(s["interval"] - gamma, F.lit(0.5))
        known = F.when(s["nd"] < 2, s["total"] / s["n"] / (1 + _EPS)).otherwise(s["level"] / (divisor + _EPS))
        return F.greatest(F.lit(0.0), known)

    def step(s: Column, x: Column) -> Column:
        y = x["y"]
        gap = s["n"] - s["last"]
        level = a * y + (1 - a) * (s["level"] + s["trend"])
        trend = b * (level - s["level"]) + (1 - b) * s["trend"]
        sold, first = y > 0, s["nd"] == 0
        interval = F.when(s["nd"] == 1, gap).otherwise(g * gap + (1 - g) * s["interval"])
        return F.struct(
            (s["n"] + 1).alias("n"),
            (s["total"] + y).alias("total"),
            F.when(sold, s["nd"] + 1).otherwise(s["nd"]).alias("nd"),
            F.when(sold & first, y).when(sold, level).otherwise(s["level"]).alias("level"),
            F.when(sold & ~first, trend).otherwise(s["trend"]).alias("trend"),
            F.when(sold & ~first, interval).otherwise(s["interval"]).alias("interval"),
            F.when(sold, s["n"]).otherwise(s["last"]).alias("last"),
            F.concat(s["path"], F.array(F.when(s["n"] == 0, y).otherwise(rate(s)))).alias("path"),
        )

    zero = F.lit(0.0)
    start = F.struct(
        zero.alias("n"), zero.alias("total"), F.lit(0).alias("nd"), zero.alias("level"), F.col("trend0").alias("trend"),
        F.lit(1.0).alias("interval"), zero.alias("last"), F.array().cast("array<double>").alias("path"),
    )
    return _unfolded(joined.withColumn("_path", F.aggregate("_h", start, step, lambda s: s["path"])), keys, method)


def holt_path(panel: DataFrame, keys: list[str] = SERIES, train: DataFrame | None = None) -> DataFrame:
    """Level plus trend before each position; the first position predicts itself."""
    weights = series.holt_fit(panel if train is None else train, keys).select(*keys, "alpha", "beta")
    joined = _histories(panel, keys).join(weights, keys)
    a, b = F.col("alpha"), F.col("beta")

    def step(s: Column, x: Column) -> Column:
        expected = s["level"] + s["trend"]
        level = a * x["y"] + (1 - a) * expected
        trend = b * (level - s["level"]) + (1 - b) * s["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(s["path"], F.array(expected)).alias("path"))

    first = F.get("_h", F.lit(0))["y"]
    slope = F.coalesce(F.get("_h", F.lit(1))["y"] - first, F.lit(0.0))
    start = F.struct(first.alias("level"), slope.alias("trend"), F.array(first).alias("path"))
    rest = F.slice("_h", F.lit(2), F.greatest(F.size("_h") - 1, F.lit(0)))
    return _unfolded(joined.withColumn("_path", F.aggregate(rest, start, step, lambda s: s["path"])), keys, "holt_winters")


def line_path(panel: DataFrame, keys: list[str] = SERIES, train: DataFrame | None = None) -> DataFrame:
    """The least-squares line over the position, fitted to the training rows and read off at every position."""
    numbered = _histories(panel, keys).select(*keys, F.posexplode("_h").alias("_x", "_r")).select(*keys, F.col("_x").cast("double").alias("_x"), "_r.date", F.col("_r.y").alias("actual"))
    known = numbered if train is None else numbered.join(train.select(*keys, "date"), [*keys, "date"], "left_semi")
    fitted = known.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("actual", "_x"), F.lit(0.0)).alias("_slope"),
        F.coalesce(F.regr_intercept("actual", "_x"), F.avg("actual")).alias("_start"),
    )
    yhat = F.col("_start") + F.col("_slope") * F.col("_x")
    return numbered.join(fitted, keys).select(*keys, "date", F.lit("linear_regression").alias("model"), "actual", yhat.alias("yhat"))


def arima_path(panel: DataFrame, keys: list[str] = SERIES, train: DataFrame | None = None) -> DataFrame:
    """Innovations filtered with coefficients of the training rows; a series too short predicts its first value."""
    marked = panel.select(*keys, "date", F.col("demand_qty").cast("double").alias("y"))
    if train is None:
        marked = marked.withColumn("known", F.lit(True))
    else:
        known = train.select(*keys, "date", F.lit(True).alias("known"))
        marked = marked.join(known, [*keys, "date"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    types = dict(panel.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", date {types['date']}, model string, actual double, yhat double"

    fit, residuals = series.fit_arima, series.arima_residuals  # sent with the job by themselves, without their module

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["y"].to_numpy(dtype=float)
        try:
            phi, theta, _ = fit(y[pdf["known"].to_numpy(dtype=bool)])
            e = residuals(np.diff(y), np.array([phi]), np.array([theta]))[:, 0]
            yhat = np.concatenate([y[:1], y[1:] - e])
        except ValueError:
            yhat = np.full(len(y), y[0])
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "date": pdf["date"], "model": "arima", "actual": y, "yhat": yhat})

    return spread(marked, *keys).groupBy(*keys).applyInPandas(one, schema)


PATHS: dict[str, Callable[..., DataFrame]] = {
    "croston": lambda panel, keys, train: croston_path(panel, "croston", keys, train),
    "sba": lambda panel, keys, train: croston_path(panel, "sba", keys, train),
    "tsb": lambda panel, keys, train: croston_path(panel, "tsb", keys, train),
    "holt_winters": holt_path,
    "linear_regression": line_path,
    "arima": arima_path,
}


def fitted_values(panel: DataFrame, models: list[str], keys: list[str] = SERIES, train: DataFrame | None = None) -> DataFrame:
    """(keys, date, model, actual, yhat) of every position and model."""
    return reduce(DataFrame.unionByName, [PATHS[m](panel, keys, train) for m in models])


def ensemble_path(paths: DataFrame, keys: list[str] = SERIES, members: tuple[str, ...] = ("linear_regression", "holt_winters", "croston")) -> DataFrame:
    """The mean of the members' predictions, one grouped pass over their paths."""
    rows = paths.where(F.col("model").isin(*members)).groupBy(*keys, "date").agg(F.first("actual").alias("actual"), F.avg("yhat").alias("yhat"))
    return rows.select(*keys, "date", F.lit("ensemble").alias("model"), "actual", "yhat")
