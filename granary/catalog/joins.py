"""Lookup and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.views import SERIES
from granary.operators import joins as J
from granary.operators.aggregates import variant_stats


# External feeds, derived from orders: one reading per (day, region), one price per (day, brand, competitor),
# one value per (day, indicator).
def weather(t):
    return (
        t.table("orders")
        .join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("n_regionkey").cast("string").alias("location_id"))
        .agg(
            F.round(F.avg("o_totalprice") / 10000, 8).alias("temperature"),
            F.round(F.avg("c_acctbal") / 100, 8).alias("humidity"),
        )
    )


WEATHER = """SELECT CAST(o_orderdate AS DATE) AS date, CAST(n_regionkey AS VARCHAR) AS location_id,
       round(avg(o_totalprice) / 10000, 8) AS temperature, round(avg(c_acctbal) / 100, 8) AS humidity
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""


def competitor_prices(t):
    return (
        t.table("lineitem")
        .join(t.brands, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(
            F.to_date("l_shipdate").alias("date"),
            F.col("brand_id").alias("item_id"),
            F.col("l_returnflag").alias("competitor"),
        )
        .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 8).alias("price"))
    )


COMPETITORS = """SELECT CAST(l_shipdate AS DATE) AS date, brand_id AS item_id, l_returnflag AS competitor,
       round(avg(l_extendedprice / l_quantity), 8) AS price
    FROM lineitem JOIN brands ON l_partkey = p_partkey GROUP BY ALL"""


def macro(t):
    return (
        t.table("orders")
        .join(t.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.to_date("o_orderdate").alias("date"), F.col("c_mktsegment").alias("indicator"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


MACRO = """SELECT CAST(o_orderdate AS DATE) AS date, c_mktsegment AS indicator, CAST(count(*) AS DOUBLE) AS value
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


@query(
    "j1_weather",
    f"SELECT d.*, w.temperature, w.humidity FROM demand_daily d LEFT JOIN ({WEATHER}) w USING (date, location_id)",
    ("demand_daily",),
)
def j1(t):
    return J.join_weather(t.demand_daily, weather(t))


@query(
    "j2_competitor_prices",
    f"""SELECT d.*, "price_A", "price_N", "price_R"
        FROM demand_daily d
        LEFT JOIN (SELECT date, item_id, avg(price) FILTER (competitor = 'A') AS "price_A",
                          avg(price) FILTER (competitor = 'N') AS "price_N",
                          avg(price) FILTER (competitor = 'R') AS "price_R"
                   FROM ({COMPETITORS}) GROUP BY ALL) USING (date, item_id)""",
    ("demand_daily",),
)
def j2(t):
    return J.join_competitor_prices(t.demand_daily, competitor_prices(t), ["A", "N", "R"])


@query(
    "j3_macro",
    f"""SELECT d.*, building, machinery
        FROM demand_daily d
        LEFT JOIN (SELECT date, avg(value) FILTER (indicator = 'BUILDING') AS building,
                          avg(value) FILTER (indicator = 'MACHINERY') AS machinery
                   FROM ({MACRO}) GROUP BY ALL) USING (date)""",
    ("demand_daily",),
)
def j3(t):
    return J.join_macro(t.demand_daily, macro(t), ["BUILDING", "MACHINERY"])


@query(
    "j4_fill_along",
    f"""WITH j AS (SELECT d.item_id, d.location_id, d.date, w.temperature
                  FROM demand_daily d LEFT JOIN ({WEATHER}) w USING (date, location_id))
       SELECT item_id, location_id, date,
              coalesce(last_value(temperature IGNORE NULLS) OVER
                           (PARTITION BY item_id, location_id ORDER BY date ROWS UNBOUNDED PRECEDING),
                       first_value(temperature IGNORE NULLS) OVER
                           (PARTITION BY item_id, location_id ORDER BY date
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temperature
       FROM j""",
    ("demand_daily",),
)
def j4(t):
    joined = J.join_weather(t.demand_daily, weather(t)).select(*SERIES, "date", "temperature")
    return J.fill_along(joined, SERIES, ["temperature"])


@query(
    "j5_last_supplier_lead_time",
    """SELECT i.item_id, o.supplier_id, coalesce(s.lead_time_days, 1) AS lead_time_days
       FROM (SELECT item_id FROM items UNION SELECT item_id + 10 FROM items) i
       LEFT JOIN (SELECT item_id, arg_max(supplier_id, (order_date, po_id)) AS supplier_id
                  FROM purchase_orders GROUP BY ALL) o USING (item_id)
       LEFT JOIN suppliers s ON o.supplier_id = s.supplier_id""",
    ("items", "purchase_orders", "suppliers"),
)
def j5(t):
    listed = t.items.select("item_id").union(t.items.select(F.col("item_id") + 10)).distinct()  # the last ten have no orders
    return J.last_supplier_lead_time(listed, t.purchase_orders, t.suppliers)


@query(
    "j6_price_tier",
    """WITH tiers AS (
         SELECT supplier_id, generate_subscripts(b, 1) AS tier, CAST(unnest(b) AS DOUBLE[]) AS x
         FROM (SELECT supplier_id, CAST(CAST(price_breaks AS JSON) AS DOUBLE[][]) AS b FROM suppliers))
       SELECT po_id, p.supplier_id, order_qty, CAST(coalesce(min(tier), 0) AS INTEGER) AS tier_chosen,
              coalesce(arg_min(x[3], tier), any_value(unit_price)) AS tier_price
       FROM purchase_orders p
       LEFT JOIN tiers t ON p.supplier_id = t.supplier_id AND order_qty >= x[1] AND (x[2] IS NULL OR order_qty <= x[2])
       GROUP BY ALL""",
    ("purchase_orders", "suppliers"),
)
def j6(t):
    priced = J.assign_price_tier(t.purchase_orders, t.suppliers)
    return priced.select("po_id", "supplier_id", "order_qty", "tier_chosen", "tier_price")


@query(
    "j7_align_forecasts",
    """SELECT item_id, location_id, date, demand_qty AS actual, yhat, round(demand_qty - yhat, 6) AS error
       FROM demand_monthly JOIN (SELECT item_id, location_id, date, yhat FROM backtests WHERE model = 'mean3')
         USING (item_id, location_id, date)""",
    ("demand_monthly", "backtests"),
)
def j7(t):
    actual = t.demand_monthly.withColumnRenamed("demand_qty", "actual")
    forecast = t.backtests.where("model = 'mean3'").select(*SERIES, "date", "yhat")
    return J.align_forecasts(actual, forecast, [*SERIES, "date"]).withColumn("error", F.round("error", 6))


@query(
    "j8_category_lookup",
    """SELECT item_id, location_id, date, demand_qty, coalesce(category, 'unknown') AS category
       FROM part_daily LEFT JOIN (SELECT item_id, category FROM items WHERE category <> 'PROMO') USING (item_id)""",
    ("part_daily", "items"),
)
def j8(t):
    return J.with_category(t.part_daily, t.items.where("category != 'PROMO'"))


@query(
    "j9_variant_pairs",
    """WITH s AS (SELECT variant, metric, count(*) AS n, round(avg(value), 6) AS mean FROM observations GROUP BY ALL)
       SELECT a.metric, a.variant AS variant_a, b.variant AS variant_b, a.n AS n_a, b.n AS n_b,
              a.mean AS mean_a, b.mean AS mean_b
       FROM s a JOIN s b ON a.metric = b.metric AND a.variant < b.variant""",
    ("observations",),
)
def j9(t):
    stats = variant_stats(t.observations).select("variant", "metric", "n", F.round("mean", 6).alias("mean"))
    return J.variant_pairs(stats, ["metric"])


@query(
    "j10_dense_grid",
    """WITH d AS (SELECT date, item_id, sum(demand_qty) AS demand_qty FROM demand_daily GROUP BY ALL)
       SELECT i.item_id, x.date, coalesce(demand_qty, 0) AS demand_qty
       FROM (SELECT DISTINCT item_id FROM d) i, (SELECT DISTINCT date FROM d) x
       LEFT JOIN d ON d.item_id = i.item_id AND d.date = x.date""",
    ("demand_daily",),
)
def j10(t):
    return J.dense_grid(t.demand_daily, "item_id", "date", "demand_qty")


# Month, day, country and name of the holidays used by the sample calendar.
_HOLIDAYS = [
    (1, 1, "CN", "New Year"), (1, 1, "US", "New Year"), (5, 1, "CN", "Labour Day"),
    (7, 4, "US", "Independence Day"), (10, 1, "CN", "National Day"), (12, 25, "US", "Christmas Day"),
]


@query(
    "j11_holidays",
    "WITH h(m, d, country, name) AS (VALUES "
    + ", ".join(f"({m}, {d}, '{c}', '{n}')" for m, d, c, n in _HOLIDAYS)
    + """)
       SELECT o.*, CAST(cn.name IS NOT NULL AS INTEGER) AS is_holiday, coalesce(cn.name, '') AS holiday_name,
              CAST(us.name IS NOT NULL AS INTEGER) AS is_international_holiday
       FROM demand_daily o
       LEFT JOIN h cn ON month(date) = cn.m AND day(date) = cn.d AND cn.country = 'CN'
       LEFT JOIN h us ON month(date) = us.m AND day(date) = us.d AND us.country = 'US'""",
    ("demand_daily",),
)
def j11(t):
    marks = t.spark.createDataFrame(_HOLIDAYS, "m int, d int, country string, name string")
    days = t.demand_daily.select("date").distinct()
    calendar = days.join(marks, (F.month("date") == F.col("m")) & (F.day("date") == F.col("d")))
    return J.mark_holidays(t.demand_daily, calendar, "CN", "US")


@query(
    "j12_class_lookup",
    """SELECT item_id, revenue, coalesce(abc_class, 'B') AS abc_class
       FROM product_value LEFT JOIN (SELECT item_id, abc_class FROM items WHERE abc_class <> 'C') USING (item_id)""",
    ("product_value", "items"),
)
def j12(t):
    return J.with_class(t.product_value, t.items.where("abc_class != 'C'"))
