"""Domain tables derived from the given star schema: once as DataFrames, once as SQL for the twin queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.cleaning import fill_calendar

SERIES = ["item_id", "location_id"]
OPENING_STOCK = 500


class Star:
    """The given tables of one folder and the domain tables built from them. Everything is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def supplier_region(self) -> DataFrame:
        return self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("supplier_id"), F.col("n_regionkey").cast("string").alias("location_id")
        )

    @cached_property
    def brands(self) -> DataFrame:
        return self.table("part").select(
            "p_partkey", F.expr("cast(substr(p_brand, 7) as bigint)").alias("brand_id")
        )

    @cached_property
    def part_daily(self) -> DataFrame:
        """Demand per (part, region, day)."""
        return (
            self.table("lineitem")
            .join(self.supplier_region, F.col("l_suppkey") == F.col("supplier_id"))
            .groupBy(F.col("l_partkey").alias("item_id"), "location_id", F.to_date("l_shipdate").alias("date"))
            .agg(F.sum("l_quantity").alias("demand_qty"))
        )

    def _brand_demand(self, step: Column) -> DataFrame:
        """Demand per (brand, region, step). Lines are summed map-side before the one grouping shuffle."""
        return (
            self.table("lineitem")
            .join(self.supplier_region, F.col("l_suppkey") == F.col("supplier_id"))
            .join(self.brands, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("brand_id").alias("item_id"), "location_id", step.alias("date"))
            .agg(F.sum("l_quantity").alias("demand_qty"))
        )

    @cached_property
    def demand_daily(self) -> DataFrame:
        return self._brand_demand(F.to_date("l_shipdate"))

    @cached_property
    def demand_panel(self) -> DataFrame:
        """`demand_daily` with every calendar day, zero where nothing was sold."""
        return fill_calendar(self.demand_daily, SERIES, unique=True).fillna(0.0, ["demand_qty"])

    @cached_property
    def demand_monthly(self) -> DataFrame:
        return self._brand_demand(F.trunc("l_shipdate", "month"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.expr("case when p_size <= 10 then 'A' when p_size <= 25 then 'B' else 'C' end").alias("abc_class"),
            F.expr("cast(20 + p_partkey % 180 as int)").alias("min_order_qty"),
            F.expr("cast(5 * (1 + p_partkey % 4) as int)").alias("pack_size"),
            F.lit(1.65).alias("safety_factor_z"),
            F.lit("EA").alias("uom"),
            F.col("p_retailprice").alias("unit_price"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").cast("string").alias("location_id"),
            F.expr("cast(1000 * (1 + r_regionkey) as int)").alias("capacity_limit"),
            F.expr("0.5D + 0.3D * r_regionkey").alias("transfer_cost_per_unit"),
            F.col("r_name").alias("region"),
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        tiers = (
            "concat('[[1,', 10 + s_suppkey % 7, ',', 100 + s_suppkey % 50, '],[', 11 + s_suppkey % 7, ',', "
            "30 + s_suppkey % 11, ',', 90 + s_suppkey % 50, '],[', 31 + s_suppkey % 11, ',null,', "
            "80 + s_suppkey % 50, ']]')"
        )
        return self.table("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.expr("cast(2 + s_suppkey % 18 as int)").alias("lead_time_days"),
            F.expr(tiers).alias("price_breaks"),
            F.expr("case when s_acctbal > 5000 then 'A' else 'B' end").alias("rating"),
            F.lit("vendor").alias("type"),
        )

    @cached_property
    def purchase_orders(self) -> DataFrame:
        """One row per (order, line number); repeated line numbers of an order are merged."""
        lines = (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_partkey").alias("item_id"),
                F.min("l_suppkey").alias("supplier_id"),
                F.sum("l_quantity").cast("bigint").alias("order_qty"),
                F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 8).alias("unit_price"),
            )
        )
        return (
            lines.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.suppliers.select("supplier_id", "lead_time_days"), "supplier_id")
            .join(self.supplier_region, "supplier_id")
            .select(
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("po_id"),
                "item_id",
                "supplier_id",
                F.to_date("o_orderdate").alias("order_date"),
                F.date_add(F.to_date("o_orderdate"), F.col("lead_time_days")).alias("due_date"),
                "order_qty",
                F.col("o_orderstatus").alias("status"),
                "location_id",
                "unit_price",
                F.col("o_orderpriority").alias("priority"),
                F.lit("system").alias("created_by"),
            )
        )

    @cached_property
    def inventory_daily(self) -> DataFrame:
        """Stock per (brand, region, day) from a fixed opening stock, receipts and demand, never below zero."""
        receipts = (
            self.purchase_orders.join(self.brands, F.col("item_id") == F.col("p_partkey"))
            .groupBy(F.col("brand_id").alias("item_id"), "location_id", F.col("due_date").alias("date"))
            .agg(F.sum("order_qty").alias("receipts_qty"))
        )
        days = Window.partitionBy(*SERIES).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        level = OPENING_STOCK + F.sum(F.col("receipts_qty") - F.col("demand_qty")).over(days)
        return (
            self.demand_panel.withColumn("demand_qty", F.col("demand_qty").cast("bigint"))
            .join(receipts, [*SERIES, "date"], "left")
            .fillna(0, ["receipts_qty"])
            .withColumn("_level", level)
            .select(
                "date",
                *SERIES,
                (F.col("_level") - F.least(F.lit(0), F.min("_level").over(days))).alias("on_hand_qty"),
                "demand_qty",
                "receipts_qty",
                F.expr("case when month(date) in (11, 12, 1) then 1.2D when month(date) in (3, 4, 5) then 0.9D "
                       "else 1.0D end").alias("seasonal_factor"),
            )
        )

    @cached_property
    def product_value(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("item_id"))
            .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
        )

    @cached_property
    def backtests(self) -> DataFrame:
        """One-step forecasts of monthly demand by three simple models, from the 13th month of a series on."""
        months = Window.partitionBy(*SERIES).orderBy("date")
        forecasts = self.demand_monthly.select(
            *SERIES,
            "date",
            F.col("demand_qty").alias("actual"),
            F.row_number().over(months).alias("_n"),
            F.lag("demand_qty", 1).over(months).alias("_last"),
            F.lag("demand_qty", 12).over(months).alias("_year_ago"),
            F.avg("demand_qty").over(months.rowsBetween(-3, -1)).alias("_mean3"),
        ).where(F.col("_n") > 12)
        models = F.explode(
            F.array(
                *[F.struct(F.lit(m).alias("model"), F.col(f"_{m}").alias("yhat")) for m in ("last", "year_ago", "mean3")]
            )
        )
        return forecasts.select("*", models.alias("m")).select(*SERIES, "date", "m.model", "actual", "m.yhat")

    @cached_property
    def metrics_history(self) -> DataFrame:
        """Monthly error metrics per item of the `last` model."""
        error = F.abs(F.col("actual") - F.col("yhat"))
        return (
            self.backtests.where("model = 'last'")
            .groupBy("item_id", "date")
            .agg(
                F.round(F.avg(error / F.col("actual")) * 100, 6).alias("mape"),
                F.round(F.avg(2 * error / (F.abs("actual") + F.abs("yhat"))) * 100, 6).alias("smape"),
                F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
            )
        )

    @cached_property
    def observations(self) -> DataFrame:
        """Experiment observations: user events, three variants by a stable hash of the user."""
        index = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 15), 16, 10).cast("bigint") % 3
        return self.table("events").select(
            F.col("user_id").alias("unit_id"),
            F.element_at(F.array(*[F.lit(v) for v in "ABC"]), (index + 1).cast("int")).alias("variant"),
            F.col("event_type").alias("metric"),
            "value",
        )

    @cached_property
    def policy_inputs(self) -> DataFrame:
        """Per part: demand statistics over its selling days, lead time of the last supplier, open orders, stock."""
        demand = self.part_daily.groupBy("item_id").agg(
            F.avg("demand_qty").alias("avg_daily_demand"),
            F.stddev_pop("demand_qty").alias("demand_std"),
            F.count(F.lit(1)).alias("n_days"),
        )
        orders = self.purchase_orders.groupBy("item_id").agg(
            F.max_by("supplier_id", F.struct("order_date", "po_id")).alias("supplier_id"),
            F.sum(F.when(F.col("status") == "O", F.col("order_qty")).otherwise(0)).alias("on_order"),
        )
        return (
            demand.join(orders, "item_id")
            .join(self.suppliers.select("supplier_id", "lead_time_days"), "supplier_id")
            .join(self.items.select("item_id", "abc_class", "unit_price"), "item_id")
            .select(
                "item_id",
                "avg_daily_demand",
                "demand_std",
                "n_days",
                F.col("lead_time_days").cast("double").alias("lead_time"),
                F.col("on_order").cast("double").alias("on_order"),
                F.expr("cast(40 * (item_id % 23) as double)").alias("stock"),
                "abc_class",
                "unit_price",
            )
        )


VIEWS_SQL = {
    "supplier_region": """
        SELECT s_suppkey AS supplier_id, CAST(n_regionkey AS VARCHAR) AS location_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "brands": "SELECT p_partkey, CAST(substr(p_brand, 7) AS BIGINT) AS brand_id FROM part",
    "part_daily": """
        SELECT l_partkey AS item_id, location_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS demand_qty
        FROM lineitem JOIN supplier_region ON l_suppkey = supplier_id GROUP BY ALL""",
    "demand_daily": """
        SELECT brand_id AS item_id, location_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS demand_qty
        FROM lineitem JOIN supplier_region ON l_suppkey = supplier_id JOIN brands ON l_partkey = p_partkey
        GROUP BY ALL""",
    "demand_panel": """
        SELECT k.item_id, k.location_id, k.date, coalesce(d.demand_qty, 0.0::DOUBLE) AS demand_qty
        FROM (SELECT item_id, location_id,
                     CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM demand_daily GROUP BY item_id, location_id) k
        LEFT JOIN demand_daily d USING (item_id, location_id, date)""",
    "demand_monthly": """
        SELECT item_id, location_id, CAST(date_trunc('month', date) AS DATE) AS date, sum(demand_qty) AS demand_qty
        FROM demand_daily GROUP BY ALL""",
    "items": """
        SELECT p_partkey AS item_id,
               CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 25 THEN 'B' ELSE 'C' END AS abc_class,
               CAST(20 + p_partkey % 180 AS INTEGER) AS min_order_qty,
               CAST(5 * (1 + p_partkey % 4) AS INTEGER) AS pack_size,
               CAST(1.65 AS DOUBLE) AS safety_factor_z, 'EA' AS uom, p_retailprice AS unit_price,
               p_type AS category, p_brand AS brand
        FROM part""",
    "locations": """
        SELECT CAST(r_regionkey AS VARCHAR) AS location_id, CAST(1000 * (1 + r_regionkey) AS INTEGER) AS capacity_limit,
               0.5::DOUBLE + 0.3::DOUBLE * r_regionkey AS transfer_cost_per_unit, r_name AS region
        FROM region""",
    "suppliers": """
        SELECT s_suppkey AS supplier_id, CAST(2 + s_suppkey % 18 AS INTEGER) AS lead_time_days,
               concat('[[1,', 10 + s_suppkey % 7, ',', 100 + s_suppkey % 50, '],[', 11 + s_suppkey % 7, ',',
                      30 + s_suppkey % 11, ',', 90 + s_suppkey % 50, '],[', 31 + s_suppkey % 11, ',null,',
                      80 + s_suppkey % 50, ']]') AS price_breaks,
               CASE WHEN s_acctbal > 5000 THEN 'A' ELSE 'B' END AS rating, 'vendor' AS type
        FROM supplier""",
    "purchase_orders": """
        SELECT l_orderkey * 8 + l_linenumber AS po_id, item_id, l.supplier_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(CAST(o_orderdate AS DATE) + lead_time_days AS DATE) AS due_date, order_qty,
               o_orderstatus AS status, location_id, l.unit_price, o_orderpriority AS priority,
               'system' AS created_by
        FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS item_id, min(l_suppkey) AS supplier_id,
                     CAST(sum(l_quantity) AS BIGINT) AS order_qty,
                     round(sum(l_extendedprice) / sum(l_quantity), 8) AS unit_price
              FROM lineitem GROUP BY ALL) l
        JOIN orders ON l_orderkey = o_orderkey
        JOIN suppliers s ON l.supplier_id = s.supplier_id
        JOIN supplier_region r ON l.supplier_id = r.supplier_id""",
    "inventory_daily": f"""
        SELECT date, item_id, location_id,
               CAST(level - least(0, min(level) OVER w) AS BIGINT) AS on_hand_qty, demand_qty, receipts_qty,
               CASE WHEN month(date) IN (11, 12, 1) THEN 1.2::DOUBLE WHEN month(date) IN (3, 4, 5) THEN 0.9::DOUBLE
                    ELSE 1.0::DOUBLE END AS seasonal_factor
        FROM (SELECT p.date, p.item_id, p.location_id, CAST(p.demand_qty AS BIGINT) AS demand_qty,
                     CAST(coalesce(r.receipts_qty, 0) AS BIGINT) AS receipts_qty,
                     {OPENING_STOCK} + sum(coalesce(r.receipts_qty, 0) - CAST(p.demand_qty AS BIGINT))
                         OVER (PARTITION BY p.item_id, p.location_id ORDER BY p.date) AS level
              FROM demand_panel p
              LEFT JOIN (SELECT brand_id AS item_id, location_id, due_date AS date, sum(order_qty) AS receipts_qty
                         FROM purchase_orders JOIN brands ON item_id = p_partkey GROUP BY ALL) r
                USING (item_id, location_id, date))
        WINDOW w AS (PARTITION BY item_id, location_id ORDER BY date)""",
    "product_value": """
        SELECT l_partkey AS item_id, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
        FROM lineitem GROUP BY ALL""",
    "backtests": """
        SELECT item_id, location_id, date, model, actual,
               CASE model WHEN 'last' THEN f1 WHEN 'year_ago' THEN f12 ELSE f3 END AS yhat
        FROM (SELECT item_id, location_id, date, demand_qty AS actual, lag(demand_qty, 1) OVER w AS f1,
                     lag(demand_qty, 12) OVER w AS f12,
                     avg(demand_qty) OVER (PARTITION BY item_id, location_id ORDER BY date
                                           ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f3,
                     row_number() OVER w AS n
              FROM demand_monthly WINDOW w AS (PARTITION BY item_id, location_id ORDER BY date)),
             (SELECT unnest(['last', 'year_ago', 'mean3']) AS model)
        WHERE n > 12""",
    "metrics_history": """
        SELECT item_id, date, round(avg(abs(actual - yhat) / actual) * 100, 6) AS mape,
               round(avg(2 * abs(actual - yhat) / (abs(actual) + abs(yhat))) * 100, 6) AS smape,
               round(sqrt(avg((actual - yhat) * (actual - yhat))), 6) AS rmse
        FROM backtests WHERE model = 'last' GROUP BY ALL""",
    "observations": """
        SELECT user_id AS unit_id,
               ['A', 'B', 'C'][CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15)) AS BIGINT) % 3 + 1] AS variant,
               event_type AS metric, value
        FROM events""",
    "policy_inputs": """
        SELECT d.item_id, avg_daily_demand, demand_std, n_days, CAST(lead_time_days AS DOUBLE) AS lead_time,
               CAST(on_order AS DOUBLE) AS on_order, CAST(40 * (d.item_id % 23) AS DOUBLE) AS stock,
               abc_class, i.unit_price
        FROM (SELECT item_id, avg(demand_qty) AS avg_daily_demand, stddev_pop(demand_qty) AS demand_std,
                     count(*) AS n_days
              FROM part_daily GROUP BY ALL) d
        JOIN (SELECT item_id, arg_max(supplier_id, (order_date, po_id)) AS supplier_id,
                     sum(CASE WHEN status = 'O' THEN order_qty ELSE 0 END) AS on_order
              FROM purchase_orders GROUP BY ALL) o ON d.item_id = o.item_id
        JOIN suppliers s ON o.supplier_id = s.supplier_id
        JOIN items i ON d.item_id = i.item_id""",
}

_NEEDS = {
    "part_daily": ["supplier_region"],
    "demand_daily": ["supplier_region", "brands"],
    "demand_panel": ["demand_daily"],
    "demand_monthly": ["demand_daily"],
    "purchase_orders": ["suppliers", "supplier_region"],
    "inventory_daily": ["demand_panel", "purchase_orders", "brands"],
    "backtests": ["demand_monthly"],
    "metrics_history": ["backtests"],
    "policy_inputs": ["part_daily", "purchase_orders", "suppliers", "items"],
}


def with_views(views: tuple[str, ...], sql: str) -> str:
    """Prefix `sql` with the named views and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        visit(view)
    text = sql.strip()
    if not ordered:
        return text
    prefix = ",\n".join(f"{name} AS ({VIEWS_SQL[name].strip()})" for name in ordered)
    if text[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{text[5:]}"
    return f"WITH {prefix}\n{text}"
