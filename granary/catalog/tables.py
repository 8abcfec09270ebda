"""Source and sink queries: tables are written to a scratch folder and read back through the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import TAGGED
from granary.catalog.views import SERIES
from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.session import scratch_path
from granary.sources import readers as R
from granary.sources import stores as T


@query("s1_csv_scan", "SELECT * FROM suppliers", ("suppliers",))
def s1(t):
    folder = scratch_path(t.spark, "csv")
    R.write_csv({"suppliers": t.suppliers}, folder)
    return R.open_source(t.spark, "csv", folder=folder)("suppliers")


@query("s3_json_landing", "SELECT * FROM purchase_orders", ("purchase_orders",))
def s3(t):
    folder = scratch_path(t.spark, "json")
    t.purchase_orders.write.mode("overwrite").json(f"{folder}/orders")
    return R.open_source(t.spark, "json", folder=folder, endpoints={"purchase_orders": "orders"})("purchase_orders")


@query("s4_source_fallback", "SELECT *, 'landing' AS source_used FROM locations", ("locations",))
def s4(t):
    folder = scratch_path(t.spark, "landing")
    t.locations.write.mode("overwrite").json(f"{folder}/locations")
    sources = R.SourceRegistry()
    sources.register("landing", R.json_reader(t.spark, folder), priority=2)
    sources.register("files", R.csv_reader(t.spark, f"{folder}/nothing-here"), priority=1)
    return sources.load("locations")


@query(
    "s5_external_feed",
    "SELECT * FROM demand_daily WHERE location_id = '2' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    ("demand_daily",),
)
def s5(t):
    return R.external_feed(t.demand_daily, "location_id", "2", "1997-01-01", "1998-12-31")


@query("s6_csv_sink", "SELECT * FROM inventory_daily", ("inventory_daily",))
def s6(t):
    folder = scratch_path(t.spark, "csv")
    R.write_csv({"inventory_daily": t.inventory_daily}, folder)
    return R.csv_reader(t.spark, folder)("inventory_daily")


@query(
    "s7_warehouse_append",
    """SELECT item_id, location_id, date, demand_qty, NULL::DOUBLE AS yhat FROM demand_monthly
       UNION ALL SELECT item_id, location_id, date, NULL, round(yhat, 6) FROM backtests WHERE model = 'mean3'""",
    ("demand_monthly", "backtests"),
)
def s7(t):
    store = T.Warehouse(t.spark, scratch_path(t.spark, "warehouse"))
    store.update("demand", t.demand_monthly, "replace")
    fresh = t.backtests.where("model = 'mean3'").select(*SERIES, "date", F.round("yhat", 6).alias("yhat"))
    store.update("demand", fresh, "append")
    return store.load("demand").select(*SERIES, "date", "demand_qty", "yhat")


@query(
    "s8_feature_store",
    f"""WITH {TAGGED} SELECT l.item_id, l.location_id, CASE WHEN t.model_tag IS NULL THEN 'default'
               WHEN CAST(l.location_id AS INTEGER) < 2 THEN 'fixed' ELSE t.model_tag END AS model_tag
        FROM (SELECT i.item_id, r.location_id FROM (SELECT DISTINCT item_id + 10 AS item_id FROM features) i,
                     (SELECT DISTINCT location_id FROM features) r) l
        LEFT JOIN tagged t ON l.item_id = t.item_id AND l.location_id = t.location_id""",
    ("demand_panel",),
)
def s8(t):
    store = T.FeatureStore(t.spark, scratch_path(t.spark, "features"))
    tagged = A.demand_features(t.demand_panel).withColumn("model_tag", S.model_tag())
    store.update(tagged)
    store.update(store.all().where("cast(location_id as int) < 2").withColumn("model_tag", F.lit("fixed")))
    items = store.all().select((F.col("item_id") + 10).alias("item_id"), "location_id")
    return store.tags(items)


@query("s9_metric_history", "SELECT item_id, date, mape, smape, rmse FROM metrics_history", ("metrics_history",))
def s9(t):
    history = T.History(t.spark, scratch_path(t.spark, "metrics"), buckets=8)
    history.append(t.metrics_history.where("year(date) < 1999"))
    history.append(t.metrics_history.where("year(date) >= 1999"))
    return history.read().select("item_id", "date", "mape", "smape", "rmse")


@query(
    "s9_item_history",
    "SELECT item_id, date, mape, smape, rmse FROM metrics_history WHERE item_id = 7",
    ("metrics_history",),
)
def s9_item(t):
    history = T.History(t.spark, scratch_path(t.spark, "metrics"), buckets=8)
    history.append(t.metrics_history)
    return history.read(7).select("item_id", "date", "mape", "smape", "rmse")


def _registry(t):
    """A version per item and year with sales, in year order; every item's second version is deleted."""
    from pyspark.sql import Window

    years = t.table("lineitem").select(F.col("l_partkey").alias("item_id"), F.year("l_shipdate").alias("y")).distinct()
    saved = years.select(
        "item_id", F.row_number().over(Window.partitionBy("item_id").orderBy("y")).alias("version"),
        F.concat(F.lit("model_"), F.col("y").cast("string")).alias("model_name"),
        F.col("y").cast("string").alias("params"), F.make_date(F.col("y"), F.lit(1), F.lit(1)).alias("saved_at"),
        F.lit(False).alias("is_deleted"),
    )
    gone = T.deletion_rows(saved, saved.where("version = 2").select("item_id", "version"), F.lit("2003-01-01").cast("date"))
    return saved.unionByName(gone)


_REGISTRY = """ve AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY y) AS INTEGER) AS version,
        'model_' || y AS model_name, CAST(y AS VARCHAR) AS params, make_date(y, 1, 1) AS saved_at
    FROM (SELECT DISTINCT l_partkey AS item_id, year(l_shipdate) AS y FROM lineitem)),
    lv AS (SELECT * FROM ve WHERE version <> 2)"""


@query("s10_live_versions", f"WITH {_REGISTRY} SELECT * FROM lv")
def s10_live(t):
    return T.live_versions(_registry(t))


@query(
    "s10_load_latest",
    f"WITH {_REGISTRY} SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY version DESC) = 1",
)
def s10_latest(t):
    return T.load_models(_registry(t))


@query(
    "s10_rollback",
    f"""WITH {_REGISTRY} SELECT item_id, CAST(top + 1 AS INTEGER) AS version, model_name, params, DATE '2004-01-01' AS saved_at,
               false AS is_deleted FROM lv JOIN (SELECT item_id, max(version) AS top FROM ve GROUP BY ALL) USING (item_id)
        WHERE version = 1""",
)
def s10_rollback(t):
    registry = _registry(t)
    targets = registry.select("item_id").distinct().withColumn("target_version", F.lit(1))
    return T.rollback_rows(registry, targets, F.lit("2004-01-01").cast("date"))


@query(
    "s11_lineage",
    """SELECT r AS "table", CAST(count(*) AS INTEGER) AS operations, min(ts) AS first_at, max(ts) AS last_at,
              CAST(sum(n) AS BIGINT) AS rows
       FROM (SELECT l_returnflag AS r, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts, count(*) AS n FROM lineitem GROUP BY ALL)
       WHERE ts >= TIMESTAMP '1997-01-01' AND ts <= TIMESTAMP '1999-12-31' GROUP BY ALL""",
)
def s11(t):
    """Shipping days as load operations of one table per return flag."""
    rows = t.table("lineitem").groupBy(F.col("l_returnflag").alias("table"), F.to_date("l_shipdate").alias("d")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    log = rows.select(
        "table", F.lit("load").alias("operation"), F.lit("files").alias("source"), F.col("d").cast("timestamp").alias("at"),
        "rows", F.lit(None).cast("string").alias("detail"),
    )
    kept = T.lineage_log(log, start="1997-01-01", end="1999-12-31")
    total = F.aggregate("operations.rows", F.lit(0).cast("bigint"), lambda a, x: a + x)
    at = lambda f: f("operations.at").cast("timestamp_ntz")
    return kept.select(
        "table", F.size("operations").alias("operations"), at(F.array_min).alias("first_at"),
        at(F.array_max).alias("last_at"), total.alias("rows"),
    )
