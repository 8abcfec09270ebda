"""Projection, cleaning and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.views import SERIES
from granary.operators import cleaning as C
from granary.operators import validation as V
from granary.plans import orders as PO


# Feeds as they would arrive: text measures with some unreadable cells, missing and negative values, repeats.
def raw_sales(t):
    return t.table("lineitem").join(t.brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("brand_id").alias("sku"),
        F.expr(
            "case when l_quantity = 13 then 'n/a' when l_quantity = 17 then null "
            "when l_returnflag = 'R' and l_quantity < 3 then concat('-', cast(cast(l_quantity as int) as string)) "
            "else cast(cast(l_quantity as int) as string) end"
        ).alias("sales"),
    )


RAW_SALES = """
    SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS timestamp, brand_id AS sku,
           CASE WHEN l_quantity = 13 THEN 'n/a' WHEN l_quantity = 17 THEN NULL
                WHEN l_returnflag = 'R' AND l_quantity < 3 THEN concat('-', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR))
                ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS sales
    FROM lineitem JOIN brands ON l_partkey = p_partkey"""


def dirty_sales(t):
    """Typed feed that keeps its defects, for imputation and validation."""
    feed = raw_sales(t)
    return feed.select(
        F.to_date("timestamp").alias("date"),
        F.col("sku").cast("string").alias("sku"),
        F.col("sales").try_cast("double").alias("sales"),
    )


DIRTY_SALES = f"""
    SELECT CAST(CAST(timestamp AS TIMESTAMP) AS DATE) AS date, CAST(sku AS VARCHAR) AS sku,
           TRY_CAST(sales AS DOUBLE) AS sales FROM ({RAW_SALES})"""


@query(
    "p1_rename_mapping",
    "SELECT p_partkey AS item_id, p_brand AS brand, p_type AS category, p_retailprice AS unit_price, p_name, p_size "
    "FROM part",
)
def p1(t):
    mapping = {"p_partkey": "item_id", "p_brand": "brand", "p_type": "category", "p_retailprice": "unit_price"}
    return C.conform_table(t.table("part"), "items", mapping)


@query(
    "p2_date_text",
    "SELECT l_orderkey AS po_id, strftime(l_shipdate, '%Y-%m-%d') AS due_date, l_quantity AS order_qty FROM lineitem",
)
def p2(t):
    raw = t.table("lineitem").select("l_orderkey", "l_shipdate", "l_quantity")
    mapping = {"l_orderkey": "po_id", "l_shipdate": "due_date", "l_quantity": "order_qty"}
    return C.conform_table(raw, "purchase_orders", mapping)


@query(
    "p3_price_breaks_json",
    """SELECT supplier_id, CASE WHEN x IS NULL THEN 'null' WHEN json_valid(x) THEN x
              ELSE CAST(to_json(x) AS VARCHAR) END AS price_breaks
       FROM (SELECT supplier_id, CASE WHEN supplier_id % 3 = 0 THEN price_breaks
                                      WHEN supplier_id % 3 = 1 THEN rating || ' "tier"' ELSE NULL END AS x
             FROM suppliers)""",
    ("suppliers",),
)
def p3(t):
    raw = t.suppliers.select(
        "supplier_id",
        F.expr(
            "case when supplier_id % 3 = 0 then price_breaks when supplier_id % 3 = 1 then concat(rating, ' \"tier\"') end"
        ).alias("price_breaks"),
    )
    return C.conform_table(raw, "suppliers")


@query(
    "p4_clean_sales",
    f"SELECT DISTINCT CAST(timestamp AS TIMESTAMP) AS date, CAST(sku AS VARCHAR) AS sku, "
    f"TRY_CAST(sales AS DOUBLE) AS sales FROM ({RAW_SALES})",
    ("brands",),
)
def p4(t):
    return C.clean_feed(raw_sales(t), "sales")


@query(
    "p5_clean_inventory",
    """SELECT DISTINCT CAST(date AS TIMESTAMP) AS date, CAST(item_id AS VARCHAR) AS sku,
              CASE WHEN on_hand_qty % 10 = 7 THEN NULL ELSE CAST(on_hand_qty AS DOUBLE) END AS inventory_level
       FROM inventory_daily""",
    ("inventory_daily",),
)
def p5(t):
    raw = t.inventory_daily.select(
        F.col("date").cast("string").alias("timestamp"),
        F.col("item_id").alias("sku"),
        F.expr("case when on_hand_qty % 10 = 7 then '?' else cast(on_hand_qty as string) end").alias("inventory_level"),
    )
    return C.clean_feed(raw, "inventory")


@query(
    "p6_clean_product",
    """SELECT DISTINCT CAST(item_id AS VARCHAR) AS sku, unit_price * 0.6::DOUBLE AS cost, unit_price AS price,
              CASE WHEN item_id % 5 = 0 THEN NULL ELSE CAST(pack_size AS DOUBLE) END AS lead_time FROM items""",
    ("items",),
)
def p6(t):
    raw = t.items.select(
        F.col("item_id").alias("sku"),
        (F.col("unit_price") * 0.6).alias("cost"),
        F.col("unit_price").cast("string").alias("price"),
        F.expr("case when item_id % 5 = 0 then 'unknown' else cast(pack_size as string) end").alias("lead_time"),
    )
    return C.clean_feed(raw, "product")


@query(
    "p7_clean_demand",
    "SELECT DISTINCT CAST(date AS TIMESTAMP) AS date, CAST(item_id AS VARCHAR) AS sku, demand_qty AS demand FROM part_daily",
    ("part_daily",),
)
def p7(t):
    raw = t.part_daily.select(
        F.date_format("date", "yyyy-MM-dd").alias("timestamp"),
        F.col("item_id").alias("sku"),
        F.col("demand_qty").cast("string").alias("demand"),
    )
    return C.clean_feed(raw, "demand")


@query(
    "p8_fill_calendar",
    """SELECT k.item_id, k.location_id, k.date, d.demand_qty
       FROM (SELECT item_id, location_id,
                    CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
             FROM demand_daily GROUP BY item_id, location_id) k
       LEFT JOIN demand_daily d USING (item_id, location_id, date)""",
    ("demand_daily",),
)
def p8(t):
    return C.fill_calendar(t.demand_daily, SERIES, unique=True)


@query(
    "p9_impute_median",
    f"""WITH f AS ({DIRTY_SALES})
        SELECT date, sku, coalesce(sales, (SELECT quantile_cont(sales, 0.5) FROM f)) AS sales FROM f""",
    ("brands",),
)
def p9(t):
    return C.impute_median(dirty_sales(t), ["sales"])


@query(
    "p10_impute_mode",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END
                         AS priority FROM orders),
            best AS (SELECT priority FROM f WHERE priority IS NOT NULL GROUP BY priority
                     ORDER BY count(*) DESC, priority LIMIT 1)
       SELECT o_orderkey, coalesce(priority, (SELECT priority FROM best)) AS priority FROM f""",
)
def p10(t):
    feed = t.table("orders").select(
        "o_orderkey",
        F.expr("case when o_orderpriority != '4-NOT SPECIFIED' then o_orderpriority end").alias("priority"),
    )
    return C.impute_mode(feed, ["priority"])


@query(
    "p11_winsorize_iqr",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
                  FROM lineitem)
       SELECT l_orderkey, l_linenumber,
              round(greatest(q1 - 1.5::DOUBLE * (q3 - q1), least(q3 + 1.5::DOUBLE * (q3 - q1), l_extendedprice)), 4)
                  AS l_extendedprice
       FROM lineitem, q""",
)
def p11(t):
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = C.winsorize_iqr(lines, "l_extendedprice")
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "p12_zero_impute_calendar",
    f"""SELECT date, sku, coalesce(sales, 0) AS sales, CAST(month(date) AS INTEGER) AS month,
               CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year FROM ({DIRTY_SALES})""",
    ("brands",),
)
def p12(t):
    return C.impute_zero_with_calendar(dirty_sales(t), ["sales"])


@query(
    "p13_point_filter",
    "SELECT * FROM purchase_orders WHERE CAST(item_id AS VARCHAR) = '7' AND lower(status) = 'o'",
    ("purchase_orders",),
)
def p13(t):
    return C.for_product(t.purchase_orders, "7", "order_date", status="O")


@query(
    "p14_series_arrays",
    """SELECT item_id, location_id, string_agg(CAST(CAST(demand_qty AS BIGINT) AS VARCHAR), ',' ORDER BY date) AS series
       FROM part_daily GROUP BY ALL""",
    ("part_daily",),
)
def p14(t):
    arrays = C.series_arrays(t.part_daily, SERIES, "date", "demand_qty")
    return arrays.withColumn("series", F.expr("array_join(transform(series, x -> cast(cast(x as bigint) as string)), ',')"))


@query(
    "p15_latest_snapshot",
    "SELECT date, item_id, location_id, on_hand_qty FROM inventory_daily WHERE date = (SELECT max(date) FROM inventory_daily)",
    ("inventory_daily",),
)
def p15(t):
    return C.latest_snapshot(t.inventory_daily).select("date", *SERIES, "on_hand_qty")


@query(
    "p16_purchase_order_lines",
    """SELECT row_number() OVER (ORDER BY item_id) AS order_id, item_id, quantity, unit_price,
              round(quantity * unit_price, 2) AS total_amount, 'pending' AS status, 'rop' AS strategy,
              'stock below reorder point' AS reason
       FROM (SELECT item_id, CAST(200 + item_id % 17 AS DOUBLE) AS quantity,
                    CASE WHEN item_id % 4 = 0 THEN 100.0::DOUBLE ELSE unit_price END AS unit_price,
                    40 * (item_id % 23) AS stock FROM items)
       WHERE stock < 400""",
    ("items",),
)
def p16(t):
    suggestions = t.items.select(
        "item_id",
        F.expr("cast(200 + item_id % 17 as double)").alias("suggested_order_qty"),
        F.expr("case when item_id % 4 = 0 then null else unit_price end").alias("unit_price"),
        F.expr("40 * (item_id % 23) < 400").alias("need_replenishment"),
        F.lit(None).cast("string").alias("strategy"),
        F.lit(None).cast("string").alias("reason"),
    )
    return PO.purchase_orders(suggestions).withColumn("total_amount", F.round("total_amount", 2))


def _presence_sql(table: str, columns: list[str]) -> str:
    rows = [
        f"SELECT '{table}' AS \"table\", 'present' AS rule, '{c}' AS \"column\", CAST(0 AS BIGINT) AS violations, "
        f"true AS is_valid"
        for c in columns
    ]
    return " UNION ALL ".join(rows)


def _null_sql(table: str, source: str, columns: list[str]) -> str:
    rows = [
        f"SELECT '{table}' AS \"table\", 'not_null' AS rule, '{c}' AS \"column\", "
        f"count(*) FILTER ({c} IS NULL) AS violations, count(*) FILTER ({c} IS NULL) = 0 AS is_valid FROM {source}"
        for c in columns
    ]
    return " UNION ALL ".join(rows)


def _rule_sql(table: str, source: str, rule: str, column: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{rule}' AS rule, '{column}' AS \"column\", "
        f"count(*) FILTER ({condition}) AS violations, count(*) FILTER ({condition}) = 0 AS is_valid FROM {source}"
    )


_PO_REQUIRED = ["po_id", "item_id", "supplier_id", "order_date", "due_date", "order_qty", "status"]


def _gappy_orders(t):
    return t.purchase_orders.withColumn("status", F.expr("case when status != 'P' then status end"))


_GAPPY = "(SELECT * REPLACE (CASE WHEN status <> 'P' THEN status END AS status) FROM purchase_orders)"


@query(
    "v1_required_columns",
    _presence_sql("purchase_orders", _PO_REQUIRED) + " UNION ALL " + _null_sql("purchase_orders", _GAPPY, _PO_REQUIRED),
    ("purchase_orders",),
)
def v1(t):
    return V.check_required(_gappy_orders(t), "purchase_orders")


@query(
    "v2_whole_numbers",
    _rule_sql("items", "items", "whole_number", "min_order_qty", "min_order_qty % 1 <> 0")
    + " UNION ALL " + _rule_sql("items", "items", "whole_number", "pack_size", "pack_size % 4 <> 0"),
    ("items",),
)
def v2(t):
    return V.check_whole_numbers(t.items.withColumn("pack_size", F.col("pack_size") / 4), "items")


@query(
    "v3_check_all",
    f"""SELECT 'suppliers' AS "table", 'present' AS rule, 'price_breaks' AS "column", CAST(1 AS BIGINT) AS violations,
               false AS is_valid
        UNION ALL SELECT * FROM ({_rule_sql("items", "items", "whole_number", "pack_size", "pack_size % 4 <> 0")}) WHERE NOT is_valid
        UNION ALL SELECT * FROM ({_null_sql("purchase_orders", _GAPPY, _PO_REQUIRED)}) WHERE NOT is_valid""",
    ("items", "purchase_orders"),
)
def v3(t):
    return V.check_all(
        {
            "items": t.items.withColumn("pack_size", F.col("pack_size") / 4),
            "locations": t.locations,
            "suppliers": t.suppliers.drop("price_breaks"),
            "inventory_daily": t.inventory_daily,
            "purchase_orders": _gappy_orders(t),
        }
    )


def _feed_sql(table: str, source: str, required: list[str], measure: str) -> str:
    return " UNION ALL ".join(
        [
            _presence_sql(table, required),
            _null_sql(table, source, required),
            _rule_sql(table, source, "not_negative", measure, f"{measure} < 0"),
            f"SELECT '{table}', 'not_empty', '*', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END, count(*) > 0 FROM {source}",
        ]
    )


@query("v4_check_sales", _feed_sql("sales", f"({DIRTY_SALES})", ["date", "sku", "sales"], "sales"), ("brands",))
def v4(t):
    return V.check_feed(dirty_sales(t), "sales")


@query(
    "v5_check_inventory",
    _feed_sql(
        "inventory",
        "(SELECT date, item_id AS sku, on_hand_qty - 20 AS inventory_level FROM inventory_daily)",
        ["date", "sku", "inventory_level"],
        "inventory_level",
    ),
    ("inventory_daily",),
)
def v5(t):
    feed = t.inventory_daily.select("date", F.col("item_id").alias("sku"), (F.col("on_hand_qty") - 20).alias("inventory_level"))
    return V.check_feed(feed, "inventory")


_PRODUCTS = """(SELECT CASE WHEN p_size = 3 THEN NULL ELSE p_name END AS sku, p_size - 2 AS cost,
                       p_retailprice - 950 AS price FROM part)"""


@query(
    "v6_check_products",
    " UNION ALL ".join(
        [
            _presence_sql("product", ["sku", "cost", "price"]),
            _null_sql("product", _PRODUCTS, ["sku", "cost", "price"]),
            _rule_sql("product", _PRODUCTS, "positive", "cost", "cost <= 0"),
            _rule_sql("product", _PRODUCTS, "positive", "price", "price <= 0"),
            "SELECT 'product', 'not_empty', '*', CAST(0 AS BIGINT), true",
            f"""SELECT 'product', 'unique', 'sku', CAST(sum(n - 1) AS BIGINT), sum(n - 1) = 0
                FROM (SELECT sku, count(*) AS n FROM {_PRODUCTS} GROUP BY sku)""",
        ]
    ),
)
def v6(t):
    feed = t.table("part").select(
        F.expr("case when p_size = 3 then null else p_name end").alias("sku"),
        (F.col("p_size") - 2).alias("cost"),
        (F.col("p_retailprice") - 950).alias("price"),
    )
    return V.check_products(feed)


@query(
    "v7_check_demand",
    _feed_sql(
        "demand",
        "(SELECT date, CAST(item_id AS VARCHAR) AS sku, demand_qty - 2 AS demand FROM part_daily)",
        ["date", "sku", "demand"],
        "demand",
    ),
    ("part_daily",),
)
def v7(t):
    feed = t.part_daily.select("date", F.col("item_id").cast("string").alias("sku"), (F.col("demand_qty") - 2).alias("demand"))
    return V.check_feed(feed, "demand")


@query(
    "v8_quality_metrics",
    f"""WITH f AS ({DIRTY_SALES}),
             s AS (SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS dup,
                          count(*) - count(date) AS m1, count(*) - count(sku) AS m2, count(*) - count(sales) AS m3 FROM f)
        SELECT 'sales' AS table_name, total_rows, CAST(3 AS BIGINT) AS total_columns, m1 + m2 + m3 AS missing_values,
               dup AS duplicate_rows, c.col AS "column", c.m / total_rows AS missing_ratio
        FROM s, LATERAL (SELECT 'date' AS col, m1 AS m UNION ALL SELECT 'sku', m2 UNION ALL SELECT 'sales', m3) c""",
    ("brands",),
)
def v8(t):
    return V.quality_metrics(dirty_sales(t), "sales")
