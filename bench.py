"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

from pyspark.sql import functions as F

from granary import catalog
from granary.models import series
from granary.session import build_session, cut_lineage

HEADLINE = [
    "a2_demand_features",
    "a4_service_features",
    "p8_fill_calendar",
    "p9_impute_median",
    "p11_winsorize_iqr",
    "w1_lag_features",
    "w3_rolling_features",
    "j6_price_tier",
    "m1_croston",
    "m7_arima",
    "m8_holt",
    "m15_select_fitted",
    "m18_evaluate",
    "o1_error_metrics",
    "o3_drift_parts",
    "w6_abc_classes",
    "f10_dynamic_safety_stock",
    "r3_run_strategy",
    "r9_allocate_transfers",
    "r13_audit",
    "x7_welch_statistics",
    "x9_bootstrap",
]


BATCHES = (10, 50, 100, 200)  # series of 365 days, horizon 7


def daily_series(spark, folder: str, n: int):
    """The last 365 days of `n` items' demand, every day present."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where(F.col("l_partkey") <= n)
    sold = lines.groupBy(F.col("l_partkey").alias("item_id"), F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("demand_qty"))
    last = sold.agg(F.max("date")).first()[0]
    days = F.explode(F.sequence(F.date_sub(F.lit(last), 364), F.lit(last)))
    grid = spark.range(1, n + 1).select(F.col("id").alias("item_id"), days.alias("date"))
    return grid.join(sold, ["item_id", "date"], "left").fillna(0.0, ["demand_qty"]).withColumn("location_id", F.lit("all"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(
        "granary-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    for name in ("w1_lag_features", "m7_arima"):  # load classes, compile, start Python workers before the clock runs
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in only:
        start = time.time()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    rates = {name: round(lines / s) for name, s in seconds.items()}
    batches = {}
    for n in () if sys.argv[1:] else BATCHES:
        panel = cut_lineage(daily_series(spark, folder, n))
        chosen = panel.select("item_id", "location_id").distinct().withColumn("model", F.lit("arima"))
        start = time.time()
        series.forecast_each(panel, chosen, 7).write.format("noop").mode("overwrite").save()
        batches[f"arima_{n}_series_365_days"] = round(time.time() - start, 3)
    spark.stop()
    out = {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps({**out, "lineitem_rows_per_second": rates, "batch_forecast_seconds": batches}))


if __name__ == "__main__":
    main()
