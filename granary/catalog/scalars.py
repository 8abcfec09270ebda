"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import ABC, SERVICE_FEATURES, TAGGED, XYZ, rounded
from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.operators import windows as W


@query(
    "f1_calendar_parts",
    """SELECT item_id, location_id, date, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
              CAST(year(date) AS INTEGER) AS year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
              CAST(day(date) AS INTEGER) AS day_of_month, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
              CAST(day(date) = 1 AS INTEGER) AS is_month_start, CAST(date = last_day(date) AS INTEGER) AS is_month_end
       FROM part_daily""",
    ("part_daily",),
)
def f1(t):
    return t.part_daily.select("item_id", "location_id", "date").withColumns(S.calendar_parts())


@query(
    "f2_cyclic_parts",
    """SELECT item_id, location_id, date, round(sin(2 * pi() * month(date) / 12), 6) + 0.0 AS sin_month,
              round(cos(2 * pi() * month(date) / 12), 6) + 0.0 AS cos_month,
              round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS sin_day_of_week,
              round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS cos_day_of_week
       FROM part_daily""",
    ("part_daily",),
)
def f2(t):
    out = t.part_daily.select("item_id", "location_id", "date").withColumns(S.cyclic_parts())
    return rounded(out, ["sin_month", "cos_month", "sin_day_of_week", "cos_day_of_week"], 6)


@query(
    "f3_polynomials",
    """SELECT l_orderkey, l_linenumber, l_quantity, pow(l_quantity, 2) AS l_quantity_poly_2,
              pow(l_quantity, 3) AS l_quantity_poly_3 FROM lineitem""",
)
def f3(t):
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.withColumns(S.polynomials(["l_quantity"], 3))


@query(
    "f4_interactions",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax,
              l_quantity * l_discount AS l_quantity_x_l_discount, l_quantity * l_tax AS l_quantity_x_l_tax
       FROM lineitem""",
)
def f4(t):
    names = ["l_quantity", "l_discount", "l_tax"]
    return t.table("lineitem").select("l_orderkey", "l_linenumber", *names).withColumns(S.interactions(names, 2))


_POLICY = """(SELECT item_id, avg_daily_demand * 365 AS d, 50 + item_id % 7 AS s, item_id % 5 AS h, unit_price AS c,
                     avg_daily_demand, demand_std, lead_time, n_days, abc_class FROM policy_inputs)"""


def _policy(t):
    return t.policy_inputs.select(
        "item_id",
        (F.col("avg_daily_demand") * 365).alias("d"),
        (50 + F.col("item_id") % 7).alias("s"),
        (F.col("item_id") % 5).alias("h"),
        F.col("unit_price").alias("c"),
        "avg_daily_demand", "demand_std", "lead_time", "n_days", "abc_class",
    )


@query(
    "f5_eoq",
    f"SELECT item_id, round(CASE WHEN h > 0 THEN sqrt(2 * d * s / h) ELSE d END, 4) AS eoq FROM {_POLICY}",
    ("policy_inputs",),
)
def f5(t):
    return _policy(t).select("item_id", F.round(S.eoq(F.col("d"), F.col("s"), F.col("h")), 4).alias("eoq"))


@query(
    "f6_total_cost",
    f"""SELECT item_id, round(CASE WHEN h = 0 THEN 0 ELSE d / (h * 20) * s + h * 20 / 2.0::DOUBLE * 10 + d * sqrt(c) END, 3)
        AS total_cost FROM {_POLICY}""",
    ("policy_inputs",),
)
def f6(t):
    qty = (F.col("h") * 20).cast("double")
    cost = S.total_cost(qty, F.col("d"), F.col("s"), F.lit(10.0), F.sqrt("c"))
    return _policy(t).select("item_id", F.round(cost, 3).alias("total_cost"))


@query(
    "f7_reorder_point",
    f"""SELECT item_id, round(avg_daily_demand * lead_time + round(1.65::DOUBLE * demand_std, 2), 6) AS reorder_point
        FROM {_POLICY}""",
    ("policy_inputs",),
)
def f7(t):
    point = S.reorder_point(
        F.col("avg_daily_demand"), F.col("lead_time"), S.safety_stock(S.service_z(F.lit(0.95)), F.col("demand_std"))
    )
    return _policy(t).select("item_id", F.round(point, 6).alias("reorder_point"))


@query(
    "f8_service_z",
    """SELECT item_id, level, CASE level WHEN 0.9 THEN 1.28::DOUBLE WHEN 0.95 THEN 1.65::DOUBLE WHEN 0.97 THEN 1.88::DOUBLE
              WHEN 0.98 THEN 2.05::DOUBLE WHEN 0.99 THEN 2.33::DOUBLE ELSE 1.65::DOUBLE END AS z
       FROM (SELECT p_partkey AS item_id, [0.9::DOUBLE, 0.95, 0.97, 0.98, 0.99, 0.8][p_partkey % 6 + 1] AS level FROM part)""",
)
def f8(t):
    levels = F.array(*[F.lit(v) for v in (0.9, 0.95, 0.97, 0.98, 0.99, 0.8)])
    items = t.table("part").select(
        F.col("p_partkey").alias("item_id"), F.get(levels, (F.col("p_partkey") % 6).cast("int")).alias("level")
    )
    return items.withColumn("z", S.service_z(F.col("level")))


@query(
    "f9_safety_stock",
    f"SELECT item_id, round(2.33::DOUBLE * (demand_std * sqrt(lead_time)), 2) AS safety_stock FROM {_POLICY}",
    ("policy_inputs",),
)
def f9(t):
    stock = S.safety_stock(S.service_z(F.lit(0.99)), F.col("demand_std") * F.sqrt("lead_time"))
    return _policy(t).select("item_id", stock.alias("safety_stock"))


@query(
    "f10_dynamic_safety_stock",
    f"""SELECT item_id, abc_class, round(cv, 6) AS demand_cv, round(z, 6) AS z_value,
               CASE WHEN n_days >= 10 THEN round(z * sigma, 2) END AS safety_stock
        FROM (SELECT *, 1.65::DOUBLE * CASE abc_class WHEN 'A' THEN 1.1::DOUBLE WHEN 'B' THEN 1.0::DOUBLE
                            WHEN 'C' THEN 0.9::DOUBLE ELSE 1 END * least(1 + (cv - 0.5::DOUBLE) * 0.5::DOUBLE, 2) AS z
              FROM (SELECT *, demand_std / avg_daily_demand AS cv,
                           CASE WHEN item_id % 3 > 0 THEN sqrt(lead_time * demand_std * demand_std
                                    + (item_id % 3) * (item_id % 3) * avg_daily_demand * avg_daily_demand)
                                ELSE demand_std * sqrt(lead_time) END AS sigma FROM {_POLICY}))""",
    ("policy_inputs",),
)
def f10(t):
    inputs = _policy(t).select(
        "item_id", "abc_class", "lead_time",
        F.col("avg_daily_demand").alias("demand_mean"), "demand_std", F.col("n_days").alias("n_points"),
        (F.col("item_id") % 3).cast("double").alias("lead_time_std"),
    )
    out = S.dynamic_safety_stock(inputs).select("item_id", "abc_class", "demand_cv", "z_value", "safety_stock")
    return rounded(out, ["demand_cv", "z_value"], 6)


CDF = """(CASE WHEN {x} >= 0 THEN 0.5::DOUBLE * (1 + {e}) ELSE 0.5::DOUBLE * (1 - {e}) END)"""


def erf_sql(z: str) -> str:
    """The same erf polynomial as SQL over a non-negative column name."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * {z}))"
    poly = (
        f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * "
        f"(-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    )
    return f"(1 - {poly} * exp(-{z} * {z}))"


@query(
    "f11_service_level",
    f"""SELECT item_id, round(CASE WHEN sigma = 0 THEN 1 ELSE {CDF.format(x="x", e=erf_sql("z"))} END, 6) AS service_level
        FROM (SELECT *, abs(x) / sqrt(2.0::DOUBLE) AS z
              FROM (SELECT item_id, demand_std AS sigma, (item_id % 60 - 10) / demand_std AS x FROM {_POLICY}))""",
    ("policy_inputs",),
)
def f11(t):
    level = S.service_level(F.col("item_id") % 60 - 10, F.col("demand_std"))
    return _policy(t).select("item_id", F.round(level, 6).alias("service_level"))


@query(
    "f12_min_order_quantity",
    f"""SELECT item_id, greatest(round(avg_daily_demand * 30 / 97 * CASE abc_class WHEN 'A' THEN 0.1::DOUBLE
               WHEN 'C' THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, 2), 1) AS min_order_qty FROM {_POLICY}""",
    ("policy_inputs",),
)
def f12(t):
    qty = S.min_order_quantity(F.col("avg_daily_demand") * 30 / 97, F.col("abc_class"))
    return _policy(t).select("item_id", qty.alias("min_order_qty"))


@query(
    "f13_abc_xyz",
    f"""WITH {ABC}, {XYZ} SELECT item_id, abc_class, xyz_class, abc_class || '-' || coalesce(xyz_class, 'Y') AS abc_xyz
        FROM abc LEFT JOIN xyz USING (item_id)""",
    ("product_value", "part_daily"),
)
def f13(t):
    abc = W.abc_classes(t.product_value, "item_id", "revenue")
    both = S.abc_xyz(abc, t.part_daily, "demand_qty", x_limit=0.5, y_limit=0.6)
    return both.select("item_id", "abc_class", "xyz_class", "abc_xyz")


@query(
    "f14_abc_by_share",
    """SELECT c_custkey, c_mktsegment, CASE WHEN s >= 0.7 THEN 'A' WHEN s >= 0.2 THEN 'B' ELSE 'C' END AS abc_class
       FROM (SELECT c_custkey, c_mktsegment, v / sum(v) OVER (PARTITION BY c_custkey) AS s
             FROM (SELECT o_custkey AS c_custkey, o_orderpriority AS c_mktsegment, sum(o_totalprice) AS v
                   FROM orders GROUP BY ALL))""",
)
def f14(t):
    spent = t.table("orders").groupBy(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment")
    ).agg(F.sum("o_totalprice").alias("v"))
    totals = spent.groupBy("c_custkey").agg(F.sum("v").alias("total"))
    joined = spent.join(totals, "c_custkey")
    return joined.select("c_custkey", "c_mktsegment", S.abc_by_share(F.col("v"), F.col("total")).alias("abc_class"))


@query("f15_model_tag", f"WITH {TAGGED} SELECT item_id, location_id, model_tag FROM tagged", ("demand_panel",))
def f15(t):
    tagged = A.demand_features(t.demand_panel).withColumn("model_tag", S.model_tag())
    return tagged.select("item_id", "location_id", "model_tag")


@query(
    "f16_service_tag",
    f"""WITH {SERVICE_FEATURES} SELECT item_id, location_id,
          CASE WHEN intermittency_index > 0.5 THEN 'intermittent'
               WHEN cv > 0.7 THEN CASE WHEN seasonality_strength > 0.3 THEN 'high_seasonal_high_variability'
                                       ELSE 'non_seasonal_high_variability' END
               WHEN cv > 0.3 THEN CASE WHEN seasonality_strength > 0.3 THEN 'medium_seasonal_medium_variability'
                                       ELSE 'non_seasonal_medium_variability' END
               WHEN seasonality_strength > 0.3 THEN 'high_seasonal_low_variability'
               WHEN trend_strength > 0.1 THEN 'trending_low_variability' ELSE 'stable_low_variability' END AS tag
        FROM service""",
    ("demand_monthly",),
)
def f16(t):
    return A.service_features(t.demand_monthly).select("item_id", "location_id", S.service_tag().alias("tag"))


_PATTERNS = ["Stable", "Seasonal", "Promotional", "Intermittent"]
_LISTS_SQL = """CASE WHEN abc_class = 'A' AND pattern IN ('Stable', 'Seasonal')
          THEN ['hybrid_arima_xgb', 'prophet', 'arima', 'holt_winters', 'xgb']
     WHEN abc_class = 'A' AND pattern = 'Promotional'
          THEN ['ensemble', 'xgb', 'gradient_boosting', 'random_forest', 'hybrid_arima_xgb']
     WHEN abc_class = 'A' THEN ['croston', 'sba', 'arima', 'svr', 'hybrid_arima_xgb']
     WHEN abc_class = 'B' THEN ['ensemble', 'gradient_boosting', 'random_forest', 'linear_regression', 'hybrid_arima_xgb']
     ELSE ['linear_regression', 'svr', 'croston', 'sba', 'arima', 'hybrid_arima_xgb'] END"""


def _classified(t):
    patterns = F.array(*[F.lit(p) for p in _PATTERNS])
    return t.items.select("item_id", "abc_class", F.get(patterns, (F.col("item_id") % 4).cast("int")).alias("pattern"))


_CLASSIFIED = (
    "(SELECT item_id, abc_class, ['Stable', 'Seasonal', 'Promotional', 'Intermittent'][item_id % 4 + 1] AS pattern "
    "FROM items)"
)


@query(
    "f17_recommended_models",
    f"SELECT item_id, abc_class, pattern, array_to_string({_LISTS_SQL}, ',') AS models FROM {_CLASSIFIED}",
    ("items",),
)
def f17(t):
    from granary.models.selection import recommended_models

    models = recommended_models(F.col("abc_class"), F.col("pattern"))
    return _classified(t).withColumn("models", F.array_join(models, ","))


@query(
    "f18_prioritised_models",
    f"""SELECT item_id, tag, array_to_string(list_concat(list_filter(pref, lambda m: list_contains(models, m)),
                   list_filter(models, lambda m: NOT list_contains(pref, m))), ',') AS models
        FROM (SELECT *, CASE tag WHEN 'high_variability' THEN ['svr', 'hybrid_arima_xgb']
                   WHEN 'seasonal' THEN ['holt_winters', 'arima'] WHEN 'intermittent' THEN ['sarimax', 'hybrid_arima_xgb']
                   WHEN 'stable' THEN ['linear_regression', 'arima']
                   WHEN 'trending' THEN ['linear_regression', 'gradient_boosting'] ELSE []::VARCHAR[] END AS pref
              FROM (SELECT item_id, ['high_variability', 'seasonal', 'intermittent', 'stable', 'trending', 'other']
                                    [item_id % 6 + 1] AS tag, {_LISTS_SQL} AS models FROM {_CLASSIFIED}))""",
    ("items",),
)
def f18(t):
    from granary.models.selection import prioritised, recommended_models

    tags = F.array(*[F.lit(x) for x in ("high_variability", "seasonal", "intermittent", "stable", "trending", "other")])
    rows = _classified(t).withColumn("tag", F.get(tags, (F.col("item_id") % 6).cast("int")))
    models = prioritised(recommended_models(F.col("abc_class"), F.col("pattern")), F.col("tag"))
    return rows.select("item_id", "tag", F.array_join(models, ",").alias("models"))


@query(
    "f19_approval_level",
    """SELECT po_id, CASE WHEN a < 1000 THEN 'low' WHEN a < 5000 THEN 'medium' ELSE 'high' END AS approval_level,
              CASE WHEN a < 1000 THEN 'buyer' WHEN a < 5000 THEN 'manager' ELSE 'admin' END AS approver
       FROM (SELECT po_id, order_qty * unit_price AS a FROM purchase_orders)""",
    ("purchase_orders",),
)
def f19(t):
    from granary.plans.orders import approval_level, required_approver

    amount = F.col("order_qty") * F.col("unit_price")
    return t.purchase_orders.select(
        "po_id", approval_level(amount).alias("approval_level"), required_approver(amount).alias("approver")
    )


@query(
    "f20_pack_round_up",
    """SELECT po_id, order_qty, CAST(ceil(greatest(order_qty, min_order_qty / 10.0::DOUBLE) / pack_size) * pack_size AS BIGINT)
              AS packed_qty
       FROM purchase_orders JOIN items USING (item_id)""",
    ("purchase_orders", "items"),
)
def f20(t):
    joined = t.purchase_orders.join(t.items.select("item_id", "pack_size", "min_order_qty"), "item_id")
    packed = S.pack_round_up(F.col("order_qty"), F.col("pack_size"), F.col("min_order_qty") / 10)
    return joined.select("po_id", "order_qty", packed.alias("packed_qty"))


@query(
    "f21_forecast_interval",
    """SELECT item_id, location_id, date, round(greatest(0, yhat * (1 - mape / 100)), 2) AS lower_bound,
              round(yhat * (1 + mape / 100), 2) AS upper_bound
       FROM (SELECT item_id, location_id, date, sqrt(yhat + 0.3::DOUBLE) AS yhat FROM backtests WHERE model = 'mean3')
       JOIN metrics_history USING (item_id, date)""",
    ("backtests", "metrics_history"),
)
def f21(t):
    forecasts = t.backtests.where("model = 'mean3'").join(t.metrics_history, ["item_id", "date"])
    forecasts = forecasts.withColumn("yhat", F.sqrt(F.col("yhat") + 0.3))
    low, high = S.forecast_interval(F.col("yhat"), F.col("mape"))
    return forecasts.select("item_id", "location_id", "date", low.alias("lower_bound"), high.alias("upper_bound"))


@query(
    "f22_month_factor",
    """SELECT item_id, location_id, date, CASE WHEN month(date) IN (11, 12, 1) THEN 1.2::DOUBLE
              WHEN month(date) IN (3, 4, 5) THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS seasonal_factor FROM part_daily""",
    ("part_daily",),
)
def f22(t):
    return t.part_daily.select("item_id", "location_id", "date", S.month_factor().alias("seasonal_factor"))


@query(
    "f23_chart_labels",
    """SELECT strftime(date, '%Y-%m-%d') AS label, sum(demand_qty) AS demand_qty FROM demand_daily GROUP BY ALL""",
    ("demand_daily",),
)
def f23(t):
    return t.demand_daily.groupBy(S.chart_label().alias("label")).agg(F.sum("demand_qty").alias("demand_qty"))
