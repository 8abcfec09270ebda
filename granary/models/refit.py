"""Refitting on history plus new rows without reading history again.

A segment of a series is summed up in one row: first and last observation, moments, demand counts, and the products of the
regression's terms (normal equations). Two neighbouring segments add up; the one row that needs both, the first of the
later segment with the last value of the earlier as its lag, is added from their edges. A fit and its error on any segment
come from these sums alone, so a daily refit reads the new rows and one stored row per series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.models.selection import accept_refit

SERIES = ["item_id", "location_id"]
TERMS = ("one", "lag", "time", "sin_month", "cos_month")
_EDGES = ("first_date", "first_y", "last_date", "last_y")


def _term(name: str, date: Column, lag: Column) -> Column:
    month = 2 * F.pi() * F.month(date) / 12
    return {
        "one": F.lit(1.0),
        "lag": lag.cast("double"),
        "time": F.datediff(date, F.lit("2000-01-01").cast("date")) / F.lit(3652.5),
        "sin_month": F.sin(month),
        "cos_month": F.cos(month),
    }[name]


def _products(terms: tuple[str, ...], date: Column, lag: Column, y: Column) -> list[Column]:
    """The upper triangle of z z', where z is the terms and then the value."""
    z = [*[_term(t, date, lag) for t in terms], y.cast("double")]
    return [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))]


def summarise(rows: DataFrame, keys: list[str] = SERIES, terms: tuple[str, ...] = TERMS, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """One row per series: its edges, `moments` (n, sum, sum of squares, demands, their sum), `gaps` (first and last demand
    date, as days) and `products`, all of the segment's own rows. Sums are combined map-side."""
    line = Window.partitionBy(*keys).orderBy(date)
    y, day = F.col("_y"), F.col("_d")
    placed = rows.select(*keys, F.col(date).alias("_d"), F.col(value).cast("double").alias("_y"), F.lag(F.col(value).cast("double")).over(line).alias("_lag"))
    sold = y > 0
    number = F.unix_date("_d")
    products = _products(terms, day, F.col("_lag"), y)
    return placed.groupBy(*keys).agg(
        F.min("_d").alias("first_date"),
        F.min_by("_y", "_d").alias("first_y"),
        F.max("_d").alias("last_date"),
        F.max_by("_y", "_d").alias("last_y"),
        F.array(F.count(y).cast("double"), F.sum(y), F.sum(y * y), F.count_if(sold).cast("double"), F.sum(F.when(sold, y).otherwise(0.0))).alias("moments"),
        F.array(F.min(F.when(sold, number)), F.max(F.when(sold, number))).alias("gaps"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_lag").isNotNull(), p)), F.lit(0.0)) for p in products]).alias("products"),
    )


def _edge(terms: tuple[str, ...], date: Column, lag: Column, y: Column) -> Column:
    return F.array(*_products(terms, date, lag, y))


def _added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def continued(state: DataFrame, fresh: DataFrame, keys: list[str] = SERIES, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """(keys, h, f, edge): the row of each side and the products of the row between them; a side may be missing."""
    h = state.select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("h"))
    f = fresh.select(*keys, F.struct(*[c for c in fresh.columns if c not in keys]).alias("f"))
    both = h.join(f, keys, "full")
    later = F.col("f.first_date") <= F.col("h.last_date")
    wrong = F.raise_error(F.lit("new rows must follow the history")).cast("array<double>")
    edge = F.when(F.col("h").isNotNull() & F.col("f").isNotNull(), F.when(later, wrong).otherwise(_edge(terms, F.col("f.first_date"), F.col("h.last_y"), F.col("f.first_y"))))
    return both.withColumn("edge", edge)


def merge(state: DataFrame, fresh: DataFrame, keys: list[str] = SERIES, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """The summary of history and new rows, from the summaries of both."""
    one = lambda c: F.coalesce(F.col(f"h.{c}"), F.col(f"f.{c}"))
    last = lambda c: F.coalesce(F.col(f"f.{c}"), F.col(f"h.{c}"))
    sums = F.when(F.col("edge").isNotNull(), _added(_added(F.col("h.products"), F.col("f.products")), F.col("edge"))).otherwise(one("products"))
    moments = F.when(F.col("edge").isNotNull(), _added(F.col("h.moments"), F.col("f.moments"))).otherwise(one("moments"))
    gaps = F.array(F.coalesce(F.col("h.gaps")[0], F.col("f.gaps")[0]), F.coalesce(F.col("f.gaps")[1], F.col("h.gaps")[1]))
    return continued(state, fresh, keys, terms).select(
        *keys, one("first_date").alias("first_date"), one("first_y").alias("first_y"), last("last_date").alias("last_date"), last("last_y").alias("last_y"),
        moments.alias("moments"), gaps.alias("gaps"), sums.alias("products"),
    )


def statistics(state: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """What the moments and demand counts give: mean, spread, demand size, days between demands and the mean rate."""
    m, g = F.col("moments"), F.col("gaps")
    n, demands = m[0], m[3]
    mean = m[1] / n
    interval = F.try_divide((g[1] - g[0]).cast("double"), demands - 1)
    return state.select(
        *keys, n.cast("bigint").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(m[2] / n - mean * mean, F.lit(0.0))).alias("std"),
        demands.cast("bigint").alias("n_demand"), F.try_divide(m[4], demands).alias("demand_mean"), interval.alias("interval_days"),
    )


def _symmetric(cells: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cells
    return out + np.triu(out, 1).T


def _solve(cells: np.ndarray, size: int) -> np.ndarray:
    """Least-squares coefficients from products; directions without information get none."""
    full = _symmetric(cells, size)
    scale = np.sqrt(np.maximum(np.diag(full)[:-1], 1e-300))
    a = full[:-1, :-1] / np.outer(scale, scale)
    return np.linalg.lstsq(a, full[:-1, -1] / scale, rcond=1e-12)[0] / scale


def _rmse(cells: np.ndarray, weights: np.ndarray, size: int) -> float:
    full = _symmetric(cells, size)
    v = np.append(weights, -1.0)
    rows = full[0, 0]  # the first term is one, so its square counts the rows
    return float(np.sqrt(max(v @ full @ v, 0.0) / rows)) if rows else float("nan")


def refit(state: DataFrame, fresh: DataFrame, keys: list[str] = SERIES, terms: tuple[str, ...] = TERMS, threshold: float = 0.05) -> DataFrame:
    """Old and new coefficients per series, their rmse on the new rows, and whether the new fit is accepted.

    The old fit knows the history, the new one history and new rows. It is accepted if its rmse on the new rows is better by
    more than `threshold`; a series without history takes its first fit. `terms` must begin with "one".
    """
    if terms[0] != "one":
        raise ValueError('the first term must be "one"')
    size = len(terms) + 1
    types = dict(state.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    schema = f"{head}, known boolean, old_weights array<double>, new_weights array<double>, old_rmse double, new_rmse double"
    solve, error = _solve, _rmse

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for old, new in zip(pdf["old"], pdf["new"], strict=True):
                new = np.asarray(new, float)
                known = old is not None
                past = np.asarray(old, float) if known else np.zeros_like(new)
                first = solve(past, size) if known else None
                second = solve(past + new, size)
                out.append((known, None if first is None else first.tolist(), second.tolist(), error(new, first, size) if known else None, error(new, second, size)))
            names = ["known", "old_weights", "new_weights", "old_rmse", "new_rmse"]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    both = continued(state, fresh, keys, terms).where(F.col("f").isNotNull())
    news = F.when(F.col("edge").isNotNull(), _added(F.col("f.products"), F.col("edge"))).otherwise(F.col("f.products"))
    scored = both.select(*keys, F.col("h.products").alias("old"), news.alias("new")).mapInPandas(rows, schema)
    ruled = accept_refit(scored, threshold).withColumn("accepted", F.coalesce(F.col("accepted"), F.lit(False)) | ~F.col("known"))
    return ruled.drop("known")


def accepted_models(refits: DataFrame, saved_at: Column, terms: tuple[str, ...] = TERMS, key: str = "item_id") -> DataFrame:
    """Rows for the model registry: the accepted fits with their parameters; `stores.next_versions` numbers them."""
    params = F.to_json(F.map_from_arrays(F.array(*[F.lit(t) for t in terms]), F.col("new_weights")))
    return refits.where("accepted").select(key, F.lit("lag_regression").alias("model_name"), params.alias("params"), saved_at.alias("saved_at"), F.lit(False).alias("is_deleted"))
