"""Panel, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import ABC, rounded
from granary.catalog.views import SERIES
from granary.operators import windows as W
from granary.operators.cleaning import latest_per_key

LINE = "PARTITION BY item_id, location_id ORDER BY date"


@query(
    "w1_lag_features",
    "SELECT item_id, location_id, date, demand_qty, "
    + ", ".join(f"lag_{k} AS demand_qty_lag_{k}" for k in W.LAGS)
    + " FROM (SELECT *, row_number() OVER w AS n, "
    + ", ".join(f"lag(demand_qty, {k}) OVER w AS lag_{k}" for k in W.LAGS)
    + f" FROM demand_daily WINDOW w AS ({LINE})) WHERE n > 30",
    ("demand_daily",),
)
def w1(t):
    return W.lag_features(t.demand_daily, ["demand_qty"])


@query(
    "w2_short_lags",
    f"""SELECT item_id, location_id, date, demand_qty, l1 AS demand_qty_lag_1, l2 AS demand_qty_lag_2,
               l3 AS demand_qty_lag_3
        FROM (SELECT *, lag(demand_qty, 1) OVER w AS l1, lag(demand_qty, 2) OVER w AS l2,
                     lag(demand_qty, 3) OVER w AS l3, row_number() OVER w AS n
              FROM part_daily WINDOW w AS ({LINE})) WHERE n > 3""",
    ("part_daily",),
)
def w2(t):
    return W.lag_features(t.part_daily, ["demand_qty"], (1, 2, 3))


_ROLL_SQL = {
    "mean": "round(avg(demand_qty) OVER w{w}, 6)",
    "median": "quantile_cont(demand_qty, 0.5) OVER w{w}",
    "std": "round(stddev_samp(demand_qty) OVER w{w}, 6)",
    "min": "min(demand_qty) OVER w{w}",
    "max": "max(demand_qty) OVER w{w}",
}


@query(
    "w3_rolling_features",
    "SELECT * EXCLUDE (n) FROM (SELECT item_id, location_id, date, demand_qty, row_number() OVER w1 AS n, "
    + ", ".join(
        f"{sql.format(w=w)} AS demand_qty_roll_{w}_{s}" for w in W.WINDOWS for s, sql in _ROLL_SQL.items()
    )
    + " FROM demand_daily WINDOW w1 AS ("
    + LINE
    + "), "
    + ", ".join(f"w{w} AS ({LINE} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in W.WINDOWS)
    + ") WHERE n >= 60",
    ("demand_daily",),
)
def w3(t):
    rolled = W.rolling_features(t.demand_daily, ["demand_qty"])
    return rounded(rolled, [c for c in rolled.columns if c.endswith(("_mean", "_std"))], 6)


@query(
    "w4_rolling_trend",
    "SELECT item_id, location_id, date, demand_qty, "
    + ", ".join(
        f"CASE WHEN n >= {w} THEN round(regr_slope(y, n) OVER ({LINE} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 5)"
        f" + 0.0 END AS trend_{w}d"
        for w in (7, 14, 30)
    )
    + f""" FROM (SELECT *, CAST(dayofyear(date) AS DOUBLE) AS y, CAST(row_number() OVER ({LINE}) AS DOUBLE) AS n
                 FROM demand_daily)""",
    ("demand_daily",),
)
def w4(t):
    return rounded(W.rolling_trend(t.demand_daily), ["trend_7d", "trend_14d", "trend_30d"], 5)


@query(
    "w5_time_decay",
    """SELECT item_id, location_id, date, demand_qty, CAST(date - first AS INTEGER) AS days_since_start,
              round(exp(-0.01::DOUBLE * (date - first)), 8) AS time_decay
       FROM (SELECT *, min(date) OVER (PARTITION BY item_id, location_id) AS first FROM demand_daily)""",
    ("demand_daily",),
)
def w5(t):
    return rounded(W.time_decay(t.demand_daily), ["time_decay"], 8)


@query(
    "w6_abc_classes",
    f"WITH {ABC} SELECT item_id, revenue, round(share, 6) AS share, abc_class FROM abc",
    ("product_value",),
)
def w6(t):
    return rounded(W.abc_classes(t.product_value, "item_id", "revenue"), ["share"], 6)


@query(
    "w7_recent_trend",
    """SELECT item_id, round(CASE WHEN count(*) = 14 THEN avg(mape) FILTER (b <= 7) - avg(mape) FILTER (b > 7)
                                  ELSE 0 END, 4) AS mape_trend
       FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS b FROM metrics_history)
       WHERE b <= 14 GROUP BY ALL""",
    ("metrics_history",),
)
def w7(t):
    return rounded(W.recent_trend(t.metrics_history, "mape", ["item_id"]), ["mape_trend"])


@query(
    "w8_rising_three",
    """SELECT item_id, max(mape) FILTER (b = 1) > max(mape) FILTER (b = 2)
                       AND max(mape) FILTER (b = 2) > max(mape) FILTER (b = 3) AS rising,
              max(mape) FILTER (b = 1) AS last_mape, max(date) AS last_date, count(*) AS points
       FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS b FROM metrics_history)
       WHERE b <= 3 GROUP BY ALL""",
    ("metrics_history",),
)
def w8(t):
    return W.rising_three(t.metrics_history, "mape", ["item_id"])


@query(
    "w9_jump_share",
    f"""SELECT item_id, location_id, round(avg(CASE WHEN abs(d) > 2 * s THEN 1.0::DOUBLE ELSE 0 END), 6) AS jump_share
        FROM (SELECT *, stddev_pop(d) OVER (PARTITION BY item_id, location_id) AS s
              FROM (SELECT *, demand_qty - lag(demand_qty) OVER ({LINE}) AS d FROM demand_daily))
        WHERE d IS NOT NULL GROUP BY ALL""",
    ("demand_daily",),
)
def w9(t):
    return rounded(W.jump_share(t.demand_daily, "demand_qty"), ["jump_share"], 6)


@query(
    "w10_direction_flags",
    f"""SELECT item_id, location_id, date, model, actual, round(yhat, 6) AS yhat,
               CAST(actual > lag(actual) OVER w AS INTEGER) AS actual_up, CAST(yhat > lag(yhat) OVER w AS INTEGER) AS yhat_up
        FROM backtests WINDOW w AS (PARTITION BY item_id, location_id, model ORDER BY date)""",
    ("backtests",),
)
def w10(t):
    return rounded(W.direction_flags(t.backtests, [*SERIES, "model"]), ["yhat"], 6)


@query(
    "w11_latest_per_key",
    f"""SELECT item_id, location_id, date, on_hand_qty, demand_qty, receipts_qty
        FROM inventory_daily QUALIFY row_number() OVER ({LINE} DESC) = 1""",
    ("inventory_daily",),
)
def w11(t):
    latest = latest_per_key(t.inventory_daily, SERIES, ["date"])
    return latest.select(*SERIES, "date", "on_hand_qty", "demand_qty", "receipts_qty")


SPLIT = f"""split AS (SELECT * EXCLUDE (n, rn), CASE WHEN rn > n - ceil(n * 0.2::DOUBLE) THEN 'test'
              WHEN rn > n - ceil(n * 0.2::DOUBLE) - ceil((n - ceil(n * 0.2::DOUBLE)) * 0.1::DOUBLE) THEN 'validation'
              ELSE 'train' END AS split
    FROM (SELECT *, count(*) OVER (PARTITION BY item_id, location_id) AS n, row_number() OVER ({LINE}) AS rn
          FROM demand_daily))"""


@query("w12_ordered_split", f"WITH {SPLIT} SELECT * FROM split", ("demand_daily",))
def w12(t):
    return W.ordered_split(t.demand_daily)


@query(
    "w13_scale_on_train",
    f"""WITH {SPLIT} SELECT *, round((demand_qty - (SELECT avg(demand_qty) FROM split WHERE split = 'train'))
               / (SELECT stddev_pop(demand_qty) FROM split WHERE split = 'train'), 6) AS demand_qty_scaled FROM split""",
    ("demand_daily",),
)
def w13(t):
    scaled = W.scale_on_train(W.ordered_split(t.demand_daily), ["demand_qty"])
    return rounded(scaled, ["demand_qty_scaled"], 6)


@query(
    "t1_latest_forecasts",
    """SELECT item_id, location_id, date, round(yhat, 6) AS yhat FROM backtests WHERE model = 'mean3'
       ORDER BY date DESC, item_id, location_id LIMIT 5""",
    ("backtests",),
)
def t1(t):
    forecasts = t.backtests.where("model = 'mean3'").select(*SERIES, "date", F.round("yhat", 6).alias("yhat"))
    return W.latest_rows(forecasts, 5, [F.desc("date"), F.col("item_id"), F.col("location_id")])


@query(
    "t2_top_per_class",
    f"""WITH {ABC} SELECT abc_class, item_id, revenue, CAST(n AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY abc_class ORDER BY revenue DESC, item_id) AS n FROM abc)
        WHERE n <= 3""",
    ("product_value",),
)
def t2(t):
    classified = W.abc_classes(t.product_value, "item_id", "revenue").select("abc_class", "item_id", "revenue")
    return W.top_per_group(classified, "abc_class", [F.desc("revenue"), F.col("item_id")], 3)


_SCORES = """(UNPIVOT (SELECT abs(corr(l_extendedprice, l_quantity)) AS l_quantity,
                              abs(corr(l_extendedprice, l_discount)) AS l_discount,
                              abs(corr(l_extendedprice, l_tax)) AS l_tax,
                              abs(corr(l_extendedprice, CAST(l_linenumber AS DOUBLE))) AS l_linenumber FROM lineitem)
              ON COLUMNS(*) INTO NAME feature VALUE score)"""


@query(
    "t3_top_features",
    f"SELECT feature, round(score, 6) AS score FROM {_SCORES} WHERE score >= 0.0001 ORDER BY score DESC LIMIT 3",
)
def t3(t):
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    row = t.table("lineitem").agg(*[F.abs(F.corr("l_extendedprice", F.col(c).cast("double"))).alias(c) for c in names])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in names]))
    scores = row.select(cells.alias("c")).select("c.feature", "c.score")
    return rounded(W.top_features(scores, 3, 0.0001), ["score"], 6)


@query(
    "t4_series_tail",
    f"SELECT * FROM demand_daily QUALIFY row_number() OVER ({LINE} DESC) <= 7",
    ("demand_daily",),
)
def t4(t):
    return W.series_tail(t.demand_daily, 7)


_RULES = """(SELECT item_id AS feature, CASE WHEN mape > 40 THEN 'high' ELSE 'low' END AS priority, smape AS confidence,
                    rmse AS importance FROM metrics_history WHERE date = (SELECT max(date) FROM metrics_history))"""


@query(
    "t5_top_rules",
    f"""SELECT * FROM {_RULES} ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, confidence DESC, importance DESC,
        feature LIMIT 5""",
    ("metrics_history",),
)
def t5(t):
    from granary.operators.cleaning import latest_snapshot

    rules = latest_snapshot(t.metrics_history).select(
        F.col("item_id").alias("feature"),
        F.when(F.col("mape") > 40, "high").otherwise("low").alias("priority"),
        F.col("smape").alias("confidence"),
        F.col("rmse").alias("importance"),
    )
    return W.top_rules(rules)


@query(
    "t6_clip_horizon",
    f"""SELECT item_id, location_id, date, model, actual, round(yhat, 6) AS yhat, CAST(n AS INTEGER) AS step
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id, location_id, model ORDER BY date) AS n FROM backtests)
        WHERE n <= 7""",
    ("backtests",),
)
def t6(t):
    return rounded(W.clip_horizon(t.backtests, 7, [*SERIES, "model"]), ["yhat"], 6)


@query(
    "u1_append",
    """SELECT item_id, location_id, date, demand_qty, NULL::DOUBLE AS yhat FROM demand_monthly
       UNION ALL SELECT item_id, location_id, date, NULL, round(yhat, 6) FROM backtests WHERE model = 'mean3'""",
    ("demand_monthly", "backtests"),
)
def u1(t):
    forecasts = t.backtests.where("model = 'mean3'").select(*SERIES, "date", F.round("yhat", 6).alias("yhat"))
    return W.append(t.demand_monthly, forecasts)


@query("u2_distinct_rows", "SELECT DISTINCT l_partkey, l_returnflag, l_linestatus, l_quantity FROM lineitem")
def u2(t):
    return W.distinct_rows(t.table("lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "u3_extend_history",
    """SELECT item_id, location_id, date, coalesce(f.yhat, h.demand_qty) AS demand_qty
       FROM demand_monthly h
       LEFT JOIN (SELECT item_id, location_id, date, yhat FROM backtests WHERE model = 'last') f
         USING (item_id, location_id, date)""",
    ("demand_monthly", "backtests"),
)
def u3(t):
    fresh = t.backtests.where("model = 'last'").select(*SERIES, "date", F.col("yhat").alias("demand_qty"))
    return W.extend_history(t.demand_monthly, fresh)
