"""Models fitted once over all series: regressors on lags, and the hybrid's residual model. Their forecasts are recursive.

A recursive forecast holds one row per series, whose lag columns move on by the prediction of each step, so a step is a
projection and no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import calendar_parts
from granary.models import regression, series
from granary.operators.joins import fill_along
from granary.operators.scale import packed, spread
from granary.session import cut_lineage

SERIES = ["item_id", "location_id"]
LAGS = 3
RESIDUAL_LAGS = [f"resid_lag_{i}" for i in range(1, LAGS + 1)]
BOOSTING = {"maxIter": 50, "maxDepth": 3}
LEAST = 10  # rows below which a hybrid forecast is zero


def next_date(panel: DataFrame, keys: list[str], date: str = "date") -> Callable[[Column, int], Column]:
    """How to step along the panel's calendar: by months where dates are at least 28 days apart, else by days."""
    gap = F.datediff(date, F.lag(date).over(Window.partitionBy(*keys).orderBy(date)))
    least = panel.select(gap.alias("gap")).agg(F.min("gap")).first()[0]
    if least is not None and least >= 28:
        return lambda d, h: F.add_months(d, h)
    return lambda d, h: F.date_add(d, h)


def _rows_out(df: DataFrame, keys: list[str], model: str, steps: int) -> DataFrame:
    return df.select(*keys, F.lit(model).alias("model"), "rmse", F.array(*[f"_y{h}" for h in range(1, steps + 1)]).alias("forecast"), "error")


def sound_rows(design: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Rows whose features and target are all known: one series' gap must not stop the fit of all."""
    return design.dropna(subset=[*(features or regression.FEATURES), "demand_qty"])


# --- regressors on lags ---------------------------------------------------------------------------------------------


def forecast_shared(panel: DataFrame, model: str, steps: int, keys: list[str] = SERIES, only: DataFrame | None = None, **params) -> DataFrame:
    """Fit `model` on all series, forecast those in `only` (default: all): (keys, model, rmse, forecast, error).

    Each step's prediction becomes the next step's first lag. A series without a value for every lag yields zeros and an error.
    """
    ahead = next_date(panel, keys)
    design = cut_lineage(sound_rows(regression.design(panel, keys)))
    wanted = panel if only is None else panel.join(only.select(*keys).distinct(), keys, "left_semi")
    recent = F.sort_array(F.collect_list(F.struct("date", F.col("demand_qty").cast("double").alias("y"))))
    state = wanted.groupBy(*keys).agg(recent.alias("_h")).select(*keys, F.get("_h.date", F.size("_h") - 1).alias("_last"), *[F.get("_h.y", F.size("_h") - i).alias(f"demand_qty_lag_{i}") for i in range(1, LAGS + 1)])
    lags = [F.col(f"demand_qty_lag_{i}") for i in range(1, LAGS + 1)]
    short = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) for c in lags])
    known = state.where(~short)
    if design.isEmpty():
        failed = state
    else:
        fitted = regression.train(design, model, regression.FEATURES, **params)
        for h in range(1, steps + 1):
            parts = calendar_parts("date")
            dated = known.withColumn("date", ahead(F.col("_last"), h))
            rows = dated.withColumns({c: parts[c] for c in ("month", "quarter")})
            found = fitted.transform(rows).drop("features")
            moved = {f"demand_qty_lag_{i}": F.col(f"demand_qty_lag_{i - 1}") if i > 1 else F.col("yhat") for i in range(1, LAGS + 1)}
            known = found.withColumn(f"_y{h}", F.col("yhat")).withColumns(moved).drop("yhat", "month", "quarter", "date")
        error = F.col("actual") - F.col("yhat")
        inside = regression.predict(fitted, design).groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
        known = known.join(inside, keys, "left").withColumn("error", F.lit(None).cast("string"))
        failed = state.where(short)
    zeros = {f"_y{h}": F.lit(0.0) for h in range(1, steps + 1)}
    failed = failed.withColumns({**zeros, "rmse": F.lit(float("inf")), "error": F.lit(f"needs {LAGS} last observations")})
    out = _rows_out(failed, keys, model, steps)
    return out if design.isEmpty() else _rows_out(known, keys, model, steps).unionByName(out)


def shared_model(model: str) -> Callable[..., DataFrame]:
    """A forecaster for the registry."""

    def run(panel: DataFrame, steps: int, keys: list[str] = SERIES, only: DataFrame | None = None) -> DataFrame:
        return forecast_shared(panel, model, steps, keys, only)

    run.shared = True
    return run


# --- the hybrid: ARIMA and one residual model over all series --------------------------------------------------------


def _lagged(e: np.ndarray, at: Iterable[int]) -> np.ndarray:
    """The innovations before each position, zero before the first."""
    padded = np.concatenate([np.zeros(LAGS), e])
    return np.array([[padded[i + LAGS - k] for k in range(1, LAGS + 1)] for i in at]).reshape(-1, LAGS)


def residual_table(panel: DataFrame, steps: int, keys: list[str]) -> DataFrame:
    """ARIMA per series, as rows of two kinds.

    'train': (date, residual, its lags, relative time) of each position; 'state': the last lags and the forecast of `steps`
    steps. A panel with a column `role` also gives 'test' rows: for each of them ARIMA is fitted anew to all rows before it. Residuals are in
    units of the series' own innovations, so one model serves series of any size.
    """
    types = dict(panel.dtypes)
    tested = "role" in panel.columns
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    schema = f"{head}, date {types['date']}, kind string, actual double, base double, unit double, residual double, {', '.join(f'{c} double' for c in RESIDUAL_LAGS)}, rel_time double, n int, ahead array<double>, error string"

    fit, forecast = series.fit_arima, series.arima_ahead  # sent with the job by themselves, without their module

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y, dates = pdf["demand_qty"].to_numpy(dtype=float), pdf["date"].to_numpy()
        held = (pdf["role"] == "test").to_numpy() if tested else np.zeros(len(y), bool)
        known, rows = int((~held).sum()), []

        def row(kind: str, i: int, base: float, unit: float, residual: float, lags: np.ndarray, rel: float, ahead: list, error: str | None) -> None:
            actual = float(y[i]) if kind != "state" else None
            rows.append([dates[min(i, len(y) - 1)], kind, actual, base, unit, residual, *map(float, lags), rel, len(y), ahead, error])

        try:
            if not np.isfinite(y).all():
                raise ValueError("a value is missing or not finite")
            if known < LEAST:
                raise ValueError(f"needs {LEAST} observations")
            phi, theta, e = fit(y[:known])
            unit = float(np.std(e)) or 1.0
            for i, lags in enumerate(_lagged(e / unit, range(len(e)))):
                if i >= LAGS:
                    row("train", i + 1, float(y[i + 1] - e[i]), unit, float(e[i] / unit), lags, (i + 1) / known, None, None)
            for i in np.flatnonzero(held):
                p, t, past = fit(y[:i])
                base = float(forecast(y[:i], p, t, past, 1)[0])
                row("test", i, base, unit, 0.0, _lagged(past / unit, [len(past)])[0], i / (i + 1), None, None)
            ahead = forecast(y[:known], phi, theta, e, steps) if steps else []
            row("state", known - 1, 0.0, unit, 0.0, _lagged(e / unit, [len(e)])[0], 1.0, list(map(float, ahead)), None)
        except Exception as failure:  # one bad series must not fail the job
            rows.clear()
            row("state", len(y) - 1, 0.0, 1.0, 0.0, np.zeros(LAGS), 1.0, [0.0] * steps, f"{type(failure).__name__}: {failure}")
        names = ["date", "kind", "actual", "base", "unit", "residual", *RESIDUAL_LAGS, "rel_time", "n", "ahead", "error"]
        out = pd.DataFrame(rows, columns=names)
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, *names]]

    columns = [*keys, "date", "demand_qty", *(["role"] if tested else [])]
    return spread(panel.select(*columns), *keys).groupBy(*keys).applyInPandas(one, schema)


def _external(rows: DataFrame, panel: DataFrame, external: list[str], keys: list[str]) -> DataFrame:
    """`rows` with the external columns of their date; unknown values count as zero."""
    if not external:
        return rows
    known = panel.select(*keys, "date", *[F.col(c).cast("double").alias(c) for c in external])
    return rows.join(known, [*keys, "date"], "left").fillna(0.0, external)


def residual_model(table: DataFrame, external: list[str]) -> PipelineModel | None:
    """One boosted model of the residuals of all series; none where no series has any."""
    rows = table.where("kind = 'train'")
    if rows.isEmpty():
        return None
    return regression.train(rows, "gradient_boosting", [*RESIDUAL_LAGS, "rel_time", *external], "residual", **BOOSTING)


def forecast_hybrid(
    panel: DataFrame, steps: int, keys: list[str] = SERIES, external: list[str] | None = None, future: DataFrame | None = None, only: DataFrame | None = None
) -> DataFrame:
    """ARIMA plus the predicted residuals, fed back step by step: (keys, model, rmse, forecast, error).

    `external` names columns of the panel; `future` holds them for the dates ahead (date and any of `keys`), a value it lacks
    is carried forward from the last known one. A series with fewer than ten rows yields zeros, as one that ARIMA can't fit.
    """
    external = external or []
    stepped = next_date(panel, keys)
    table = packed(cut_lineage(_external(residual_table(panel, steps, keys), fill_along(panel, keys, external) if external else panel, external, keys)))
    fitted = residual_model(table, external)
    state = table.where("kind = 'state'").withColumnRenamed("date", "_last")
    if only is not None:
        state = state.join(only.select(*keys).distinct(), keys, "left_semi")
    if future is not None and external:
        on = [k for k in keys if k in future.columns]
        future = future.select(*on, "date", *[F.col(c).cast("double").alias(f"_f_{c}") for c in external])
    for h in range(1, steps + 1):
        rows = state.withColumn("date", stepped(F.col("_last"), h)).withColumn("rel_time", (F.col("n") + h - 1) / (F.col("n") + steps))
        if future is not None and external:
            rows = rows.join(future, [*on, "date"], "left").withColumns({c: F.coalesce(f"_f_{c}", c) for c in external}).drop(*[f"_f_{c}" for c in external])
        found = rows.withColumn("yhat", F.lit(0.0)) if fitted is None else fitted.transform(rows).drop("features")
        moved = {c: F.col("yhat") if i == 0 else F.col(RESIDUAL_LAGS[i - 1]) for i, c in enumerate(RESIDUAL_LAGS)}
        value = F.when(F.col("error").isNull(), F.get("ahead", F.lit(h - 1)) + F.col("yhat") * F.col("unit")).otherwise(0.0)
        state = found.withColumn(f"_y{h}", value).withColumns(moved).drop("yhat", "date")
    inside = table.where("kind = 'train'")
    inside = inside.withColumn("yhat", F.lit(0.0)) if fitted is None else fitted.transform(inside)
    left = (F.col("residual") - F.col("yhat")) * F.col("unit")
    rmse = inside.groupBy(*keys).agg(F.sqrt(F.avg(left * left)).alias("rmse"))
    out = state.join(rmse, keys, "left").withColumn("rmse", F.coalesce("rmse", F.lit(float("inf"))))
    out = out.withColumn("error", F.when(~F.col("error").startswith("ValueError: needs 10"), F.col("error")))
    return _rows_out(out, keys, "hybrid_arima_xgb", steps)


def _hybrid(panel: DataFrame, steps: int, keys: list[str] = SERIES, only: DataFrame | None = None) -> DataFrame:
    return forecast_hybrid(panel, steps, keys, only=only)


_hybrid.shared = True
series.register_model("hybrid_arima_xgb", _hybrid)
for _name in ("random_forest", "gradient_boosting"):
    series.register_model(_name, shared_model(_name))
