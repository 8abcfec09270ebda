"""Streaming queries: the event file as a file stream, run to its end; the result is the final table."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.models import series as M
from granary.session import cut_lineage, scratch_path
from granary.streaming import jobs as D


def _events(t):
    return D.file_stream(t.spark, t.folder, t.table("events").schema, "events.parquet")


def _target(t, name):
    return scratch_path(t.spark, name)


@query("d1_append_streams", "SELECT event_id, user_id, event_type, value FROM events")
def d1(t):
    target, registry = _target(t, "events"), D.StreamRegistry()
    registry.add("events", lambda: _events(t).select("event_id", "user_id", "event_type", "value"), target)
    failed = registry.process("events")["events"]
    if failed:
        raise RuntimeError(failed)
    return D.read_target(t.spark, target)


@query(
    "d2_roll_forward",
    """WITH dl AS (SELECT user_id % 25 AS item_id, CAST(user_id % 5 AS VARCHAR) AS location_id,
                          sum(CASE WHEN event_type = 'purchase' THEN -CAST(floor(value) AS BIGINT) ELSE 3 END) AS d
                   FROM events GROUP BY ALL),
       la AS (SELECT item_id, location_id, date, on_hand_qty FROM inventory_daily
              QUALIFY row_number() OVER (PARTITION BY item_id, location_id ORDER BY date DESC) = 1)
       SELECT item_id, location_id, CAST(date + 1 AS DATE) AS date, CAST(greatest(0, on_hand_qty + d) AS BIGINT) AS on_hand_qty
       FROM la JOIN dl USING (item_id, location_id)""",
    ("inventory_daily",),
)
def d2(t):
    delta = F.when(F.col("event_type") == "purchase", -F.floor("value")).otherwise(3)
    changes = _events(t).select(
        (F.col("user_id") % 25).alias("item_id"), (F.col("user_id") % 5).cast("string").alias("location_id"),
        delta.cast("bigint").alias("delta"),
    )
    target = _target(t, "stock")
    D.roll_forward(changes, t.inventory_daily, target)
    return D.read_target(t.spark, target)


@query(
    "d3_ingest_orders",
    """SELECT (SELECT max(po_id) FROM purchase_orders) + row_number() OVER (ORDER BY event_id) AS po_id, event_id, user_id,
              CAST(ceil(value) AS BIGINT) AS order_qty
       FROM events WHERE event_type = 'purchase'""",
    ("purchase_orders",),
)
def d3(t):
    orders = _events(t).where("event_type = 'purchase'").select(
        "event_id", "user_id", F.ceil("value").cast("bigint").alias("order_qty")
    )
    target = _target(t, "orders")
    D.run_available(orders, target, D.ingest_orders(t.purchase_orders, target, "event_id"))
    return D.read_target(t.spark, target)


@query("d4_refresh_forecasts")
def d4(t):
    touched = _events(t).select(
        (F.col("user_id") % 25).alias("item_id"), (F.col("user_id") % 5).cast("string").alias("location_id")
    )
    target = _target(t, "forecasts")
    history = cut_lineage(t.demand_monthly)
    D.run_available(touched, target, D.refresh_forecasts(history, M.per_series("arima", M._arima)))
    return D.read_newest(t.spark, target, D.SERIES)


@query(
    "d5_running_group_metrics",
    """SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'variant' END AS "group", count(*) AS n,
              round(sqrt(avg(pow(value - 50, 2))), 6) AS rmse, round(avg(abs(value - 50)), 6) AS mae,
              round(avg(CASE WHEN value <> 0 THEN abs((value - 50) / value) ELSE 0 END) * 100, 4) AS mape
       FROM events GROUP BY ALL""",
)
def d5(t):
    observed = _events(t).select(
        F.when(F.col("user_id") % 2 == 0, "control").otherwise("variant").alias("group"),
        F.col("value").alias("actual"), F.lit(50.0).alias("predicted"),
    )
    target = _target(t, "group-metrics")
    D.running_group_metrics(observed, target)
    return rounded(rounded(D.read_newest(t.spark, target, ["group"]), ["rmse", "mae"], 6), ["mape"], 4)
