"""Queries that go through the extension points: a model, a source, a strategy and a metric added by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.catalog.replenishment import _POLICY, _inputs
from granary.catalog.views import SERIES
from granary.models import selection as S
from granary.models import series as M
from granary.plans import policies as P
from granary.sources import readers as R


def _mean_model(panel, steps, keys):
    """Forecasts the mean of a series."""
    return panel.groupBy(*keys).agg(
        F.lit("series_mean").alias("model"), F.stddev_pop("demand_qty").alias("rmse"),
        F.array_repeat(F.avg("demand_qty"), steps).alias("forecast"), F.lit(None).cast("string").alias("error"),
    )


@query(
    "k1_registered_model",
    """SELECT item_id, location_id, 'series_mean' AS model, CAST(step AS INTEGER) AS step, round(m, 5) AS yhat,
              NULL::VARCHAR AS error
       FROM (SELECT item_id, location_id, avg(demand_qty) AS m FROM demand_monthly GROUP BY ALL),
            (SELECT unnest([1, 2, 3]) AS step)""",
    ("demand_monthly",),
)
def k1(t):
    M.register_model("series_mean", _mean_model)
    chosen = t.demand_monthly.select(*SERIES).distinct().withColumn("model", F.lit("series_mean"))
    return rounded(M.forecast_chosen(t.demand_monthly, chosen, 3), ["yhat"], 5)


@query(
    "k2_registered_source",
    "SELECT item_id, abc_class, unit_price, 'parts' AS source_used FROM items",
    ("items",),
)
def k2(t):
    R.register_kind("star", lambda spark, star: lambda table: getattr(star, table))
    sources = R.SourceRegistry()
    sources.register("parts", R.open_source(t.spark, "star", star=t), 1)
    return sources.load("items").select("item_id", "abc_class", "unit_price", "source_used")


@query(
    "k3_registered_strategy",
    f"""WITH {_POLICY} SELECT item_id, round(greatest(0, demand_forecast - stock), 6) AS suggested_order_qty,
               greatest(0, demand_forecast - stock) > 0 AS need_replenishment FROM pol""",
    ("policy_inputs",),
)
def k3(t):
    P.register_strategy("cover_forecast", lambda: F.greatest(F.lit(0.0), F.col("demand_forecast") - F.col("stock")))
    out = P.run_strategy(_inputs(t), "cover_forecast").select("item_id", "suggested_order_qty", "need_replenishment")
    return rounded(out, ["suggested_order_qty"], 6)


@query(
    "k4_registered_metric",
    """SELECT item_id, model, round(max(abs(actual - yhat)), 5) AS worst_error, round(avg(abs(actual - yhat)), 5) AS mae
       FROM backtests GROUP BY ALL""",
    ("backtests",),
)
def k4(t):
    S.register_metric("worst_error", F.max(F.abs(F.col("actual") - F.col("yhat"))))
    return rounded(S.measure_forecasts(t.backtests, ["item_id", "model"], ["worst_error", "mae"]), ["worst_error", "mae"], 5)
