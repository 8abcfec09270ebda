"""Aggregate and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.operators import joins as J
from granary.operators import windows as W

FEATURES = [
    "cv", "seasonality_strength", "intermittency_index", "promotion_flag", "mean_demand", "std_demand", "min_demand",
    "max_demand", "skewness", "kurtosis",
]


def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("a1_distinct_keys", "SELECT DISTINCT item_id, location_id FROM part_daily", ("part_daily",))
def a1(t):
    return A.distinct_keys(t.part_daily)


DECOMPOSED = """
    p AS (SELECT *, row_number() OVER w - 1 AS pos,
                 CASE WHEN count(*) OVER f = 7 THEN avg(demand_qty) OVER f END AS trend
          FROM demand_panel
          WINDOW w AS (PARTITION BY item_id, location_id ORDER BY date),
                 f AS (PARTITION BY item_id, location_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    ph AS (SELECT item_id, location_id, pos % 7 AS phase, avg(demand_qty - trend) AS m FROM p GROUP BY ALL),
    c AS (SELECT item_id, location_id, avg(m) AS centre FROM ph GROUP BY ALL),
    dec AS (SELECT p.*, m - centre AS seasonal, demand_qty - trend - (m - centre) AS resid
            FROM p JOIN ph ON p.item_id = ph.item_id AND p.location_id = ph.location_id AND pos % 7 = phase
                   JOIN c ON p.item_id = c.item_id AND p.location_id = c.location_id)"""

DEMAND_FEATURES = f"""
    {DECOMPOSED},
    mo AS (SELECT *, avg(demand_qty) OVER (PARTITION BY item_id, location_id) AS mu,
                  stddev_pop(demand_qty) OVER (PARTITION BY item_id, location_id) AS sd FROM dec),
    features AS (
      SELECT item_id, location_id, CASE WHEN any_value(mu) = 0 THEN 0 ELSE any_value(sd) / any_value(mu) END AS cv,
             CASE WHEN count(*) < 14 OR stddev_pop(seasonal) + stddev_pop(resid) = 0 THEN 0
                  ELSE stddev_pop(seasonal) / (stddev_pop(seasonal) + stddev_pop(resid)) END AS seasonality_strength,
             avg(CASE WHEN demand_qty = 0 THEN 1.0::DOUBLE ELSE 0 END) AS intermittency_index,
             avg(CASE WHEN mu <> 0 AND demand_qty > 1.5::DOUBLE * mu THEN 1.0::DOUBLE ELSE 0 END) AS promotion_flag,
             any_value(mu) AS mean_demand, any_value(sd) AS std_demand, min(demand_qty) AS min_demand,
             max(demand_qty) AS max_demand,
             CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(pow((demand_qty - mu) / sd, 3)) END AS skewness,
             CASE WHEN any_value(sd) = 0 THEN 0 ELSE avg(pow((demand_qty - mu) / sd, 4)) - 3 END AS kurtosis
      FROM mo GROUP BY ALL)"""

TAGGED = f"""{DEMAND_FEATURES},
    tagged AS (SELECT *, CASE WHEN intermittency_index > 0.3 THEN
                   CASE WHEN seasonality_strength < 0.2 THEN 'croston' ELSE 'tbats' END
               WHEN cv < 0.2 THEN CASE WHEN seasonality_strength > 0.3 THEN 'holt_winters' ELSE 'arima' END
               WHEN cv < 0.5 THEN CASE WHEN seasonality_strength > 0.3 THEN 'sarimax' ELSE 'hybrid' END
               ELSE CASE WHEN seasonality_strength > 0.3 THEN 'xgboost' ELSE 'lightgbm' END END AS model_tag
               FROM features)"""


@query(
    "a2_demand_features",
    f"WITH {DEMAND_FEATURES} SELECT item_id, location_id, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in FEATURES)
    + " FROM features",
    ("demand_panel",),
)
def a2(t):
    return rounded(A.demand_features(t.demand_panel), FEATURES)


@query(
    "a3_seasonal_strength",
    f"""WITH {DEMAND_FEATURES}
        SELECT item_id, location_id, round(seasonality_strength, 4) AS seasonality_strength FROM features""",
    ("demand_panel",),
)
def a3(t):
    return rounded(A.seasonal_strength(t.demand_panel), ["seasonality_strength"])


@query("a3_seasonal_strength_loess")
def a3_loess(t):
    from granary.models import stl

    return stl.seasonal_strength(t.demand_panel)


SERVICE_FEATURES = """
    p AS (SELECT *, row_number() OVER (PARTITION BY item_id, location_id ORDER BY date) - 1 AS pos
          FROM demand_monthly),
    ph AS (SELECT item_id, location_id, stddev_pop(m) / avg(m) AS strength
           FROM (SELECT item_id, location_id, pos % 12, avg(demand_qty) AS m FROM p GROUP BY ALL) GROUP BY ALL),
    st AS (SELECT item_id, location_id, count(*) AS n, avg(demand_qty) AS mu, stddev_pop(demand_qty) AS sd,
                  avg(CASE WHEN demand_qty > 0 THEN 1.0::DOUBLE ELSE 0 END) AS nz,
                  abs(regr_slope(demand_qty, pos)) AS slope, max(demand_qty) AS mx, min(demand_qty) AS mn,
                  skewness(demand_qty) AS sk, kurtosis(demand_qty) AS ku
           FROM p GROUP BY ALL),
    service AS (
      SELECT item_id, location_id, round(sd / mu, 3) AS cv,
             round(CASE WHEN n < 12 THEN 0 ELSE strength END, 3) AS seasonality_strength,
             round(sd / mu * (1 - nz), 3) AS intermittency_index, round(nz, 3) AS demand_frequency,
             round(mu, 3) AS average_demand, round(slope / mu, 3) AS trend_strength, round(mx, 3) AS max_demand,
             round(mn, 3) AS min_demand, round(sk, 3) AS skewness, round(ku, 3) AS kurtosis
      FROM st JOIN ph USING (item_id, location_id))"""


@query("a4_service_features", f"WITH {SERVICE_FEATURES} SELECT * FROM service", ("demand_monthly",))
def a4(t):
    return A.service_features(t.demand_monthly)


@query(
    "a5_feature_report",
    f"""WITH {DEMAND_FEATURES},
        long AS (UNPIVOT (SELECT cv, intermittency_index, mean_demand, kurtosis FROM features)
                 ON cv, intermittency_index, mean_demand, kurtosis INTO NAME feature VALUE value)
        SELECT feature, count(*) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
               round(min(value), 4) AS min, round(max(value), 4) AS max, round(quantile_cont(value, 0.25), 4) AS q25,
               round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75
        FROM long GROUP BY feature""",
    ("demand_panel",),
)
def a5(t):
    report = A.feature_report(
        A.demand_features(t.demand_panel), ["cv", "intermittency_index", "mean_demand", "kurtosis"]
    )
    return rounded(report, ["mean", "std", "min", "max", "q25", "q50", "q75"])


@query(
    "a5_tag_distribution",
    f"WITH {TAGGED} SELECT model_tag, count(*) AS n FROM tagged GROUP BY model_tag",
    ("demand_panel",),
)
def a5_tags(t):
    tagged = A.demand_features(t.demand_panel).withColumn("model_tag", S.model_tag())
    return A.tag_distribution(tagged, "model_tag")


@query(
    "a6_orders_by_product",
    "SELECT item_id, CAST(sum(order_qty) AS BIGINT) AS order_qty FROM purchase_orders GROUP BY ALL",
    ("purchase_orders",),
)
def a6_product(t):
    return A.orders_by_product(t.purchase_orders)


@query("a6_orders_by_status", "SELECT status, count(*) AS n FROM purchase_orders GROUP BY ALL", ("purchase_orders",))
def a6_status(t):
    return A.orders_by_status(t.purchase_orders)


@query(
    "a7_average_performance",
    """SELECT item_id, round(avg(mape), 4) AS avg_mape, round(avg(smape), 4) AS avg_smape,
              round(avg(rmse), 4) AS avg_rmse, count(*) AS n, max(date) AS latest
       FROM metrics_history GROUP BY ALL""",
    ("metrics_history",),
)
def a7(t):
    return rounded(A.average_performance(t.metrics_history), ["avg_mape", "avg_smape", "avg_rmse"])


@query(
    "a8_inventory_analysis",
    """SELECT item_id, location_id, count(*) AS days, arg_max(on_hand_qty, date) AS current_qty,
              round(avg(on_hand_qty), 2) AS avg_qty, min(on_hand_qty) AS min_qty, max(on_hand_qty) AS max_qty,
              round(coalesce(sum(move), 0) / avg(on_hand_qty), 2) AS turnover,
              CASE WHEN arg_max(on_hand_qty, date) > arg_min(on_hand_qty, date) THEN 'increasing'
                   WHEN arg_max(on_hand_qty, date) < arg_min(on_hand_qty, date) THEN 'decreasing'
                   ELSE 'stable' END AS trend
       FROM (SELECT *, abs(on_hand_qty - lag(on_hand_qty) OVER (PARTITION BY item_id, location_id ORDER BY date)) AS move
             FROM inventory_daily) GROUP BY ALL""",
    ("inventory_daily",),
)
def a8(t):
    return rounded(A.inventory_analysis(t.inventory_daily), ["avg_qty", "turnover"], 2)


ABC = """abc AS (SELECT *, CASE WHEN share <= 0.8 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_class
    FROM (SELECT item_id, revenue, sum(revenue) OVER (ORDER BY revenue DESC, item_id ROWS UNBOUNDED PRECEDING)
                 / sum(revenue) OVER () AS share FROM product_value))"""


@query(
    "a9_abc_summary",
    f"""WITH {ABC} SELECT abc_class, count(*) AS products,
               round(sum(revenue) / (SELECT sum(revenue) FROM abc) * 100, 4) AS value_percent FROM abc GROUP BY ALL""",
    ("product_value",),
)
def a9(t):
    return rounded(A.abc_summary(W.abc_classes(t.product_value, "item_id", "revenue"), "revenue"), ["value_percent"])


XYZ = """xyz AS (SELECT item_id, CASE WHEN count(*) < 5 THEN 'Y' WHEN avg(demand_qty) <= 0 THEN 'Z'
        WHEN stddev_pop(demand_qty) / avg(demand_qty) <= 0.5 THEN 'X'
        WHEN stddev_pop(demand_qty) / avg(demand_qty) <= 0.6 THEN 'Y' ELSE 'Z' END AS xyz_class
    FROM part_daily GROUP BY ALL)"""


@query(
    "a10_abc_xyz_counts",
    f"""WITH {ABC}, {XYZ} SELECT abc_class || '-' || coalesce(xyz_class, 'Y') AS abc_xyz, count(*) AS products
        FROM abc LEFT JOIN xyz USING (item_id) GROUP BY ALL""",
    ("product_value", "part_daily"),
)
def a10(t):
    abc = W.abc_classes(t.product_value, "item_id", "revenue")
    return A.class_counts(S.abc_xyz(abc, t.part_daily, "demand_qty", x_limit=0.5, y_limit=0.6), "abc_xyz")


@query(
    "a11_variant_stats",
    """SELECT variant, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
              round(median(value), 6) AS median, min(value) AS min, max(value) AS max
       FROM observations GROUP BY ALL""",
    ("observations",),
)
def a11(t):
    joined = A.variant_stats(t.observations).join(A.variant_medians(t.observations), ["variant", "metric"])
    return rounded(joined.drop("var_pop"), ["mean", "std", "median"], 6)


@query(
    "a12_status_counts",
    """SELECT count(*) AS total, count(*) FILTER (status = 'P') AS p_count, count(*) FILTER (status = 'O') AS o_count,
              count(*) FILTER (status = 'F') AS f_count FROM purchase_orders""",
    ("purchase_orders",),
)
def a12(t):
    return A.status_counts(t.purchase_orders, ["P", "O", "F"])


@query(
    "a13_category_rollup",
    """SELECT category, date, sum(demand_qty) AS demand_qty FROM part_daily JOIN items USING (item_id) GROUP BY ALL""",
    ("part_daily", "items"),
)
def a13(t):
    return A.category_rollup(J.with_category(t.part_daily, t.items))


@query(
    "a14_lead_time_demand",
    """SELECT d.item_id, round(mean_demand, 6) AS mean_demand, round(std_demand, 6) AS std_demand,
              CAST(2 + d.item_id % 18 AS INTEGER) AS lead_time_days,
              round(std_demand * sqrt(2 + d.item_id % 18), 6) AS lead_time_std
       FROM (SELECT item_id, avg(demand_qty) AS mean_demand, stddev_samp(demand_qty) AS std_demand
             FROM part_daily GROUP BY ALL) d""",
    ("part_daily",),
)
def a14(t):
    lead = t.items.select("item_id", F.expr("cast(2 + item_id % 18 as int)").alias("lead_time_days"))
    return rounded(A.lead_time_demand(t.part_daily, lead), ["mean_demand", "std_demand", "lead_time_std"], 6)


@query(
    "a15_demand_totals",
    """SELECT item_id, round(horizon_demand, 4) AS horizon_demand, round(annual_demand, 4) AS annual_demand, stock,
              round(greatest(0, horizon_demand - coalesce(stock, 0)), 4) AS gap
       FROM (SELECT item_id, sum(yhat) AS horizon_demand, avg(yhat) * 365 AS annual_demand
             FROM backtests WHERE model = 'mean3' GROUP BY ALL)
       LEFT JOIN (SELECT item_id, CAST(sum(on_hand_qty) AS DOUBLE) AS stock FROM inventory_daily
                  WHERE date = (SELECT max(date) FROM inventory_daily) GROUP BY ALL) USING (item_id)""",
    ("backtests", "inventory_daily"),
)
def a15(t):
    from granary.operators.cleaning import latest_snapshot

    stock = latest_snapshot(t.inventory_daily).groupBy("item_id").agg(F.sum("on_hand_qty").cast("double").alias("stock"))
    totals = A.demand_totals(t.backtests.where("model = 'mean3'"), stock)
    return rounded(totals, ["horizon_demand", "annual_demand", "gap"])
