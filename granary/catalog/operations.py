"""Model-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.catalog.views import SERIES
from granary.operators import operations as O


@query(
    "o1_error_metrics",
    """SELECT item_id, location_id, model, round(avg(abs(actual - yhat) / actual) FILTER (actual <> 0) * 100, 2) AS mape,
              round(avg(2 * abs(actual - yhat) / (abs(actual) + abs(yhat))) FILTER (actual <> 0) * 100, 2) AS smape,
              round(sqrt(avg(pow(actual - yhat, 2)) FILTER (actual <> 0)), 2) AS rmse, count(*) FILTER (actual <> 0) AS n
       FROM backtests GROUP BY ALL""",
    ("backtests",),
)
def o1(t):
    return O.error_metrics(t.backtests, [*SERIES, "model"])


@query(
    "o2_compare_demand",
    """SELECT item_id, model, round(avg(abs(actual - yhat)), 5) AS mae, round(avg(pow(actual - yhat, 2)), 4) AS mse,
              round(sqrt(avg(pow(actual - yhat, 2))), 5) AS rmse,
              round(avg(abs(actual - yhat) / actual) FILTER (actual <> 0) * 100, 5) AS mape
       FROM backtests GROUP BY ALL""",
    ("backtests",),
)
def o2(t):
    compared = O.compare_demand(t.backtests, ["item_id", "model"])
    return rounded(rounded(compared, ["mae", "rmse", "mape"], 5), ["mse"], 4)


def _drift_sql(samples: str) -> str:
    """Distance of the two cumulative distributions per item over (item_id, v, cur) rows."""
    return f"""
    s AS ({samples}),
    vc AS (SELECT item_id, v, count(*) FILTER (NOT cur) AS nb, count(*) FILTER (cur) AS nc FROM s GROUP BY ALL),
    cu AS (SELECT item_id, sum(nb) OVER w AS b, sum(nc) OVER w AS c, sum(nb) OVER (PARTITION BY item_id) AS bn,
                  sum(nc) OVER (PARTITION BY item_id) AS cn FROM vc WINDOW w AS (PARTITION BY item_id ORDER BY v)),
    di AS (SELECT item_id, CAST(max(bn) AS BIGINT) AS n_baseline, CAST(max(cn) AS BIGINT) AS n_current,
                  max(abs(b / bn - c / cn)) AS d FROM cu GROUP BY ALL),
    la AS (SELECT *, n_baseline >= 10 AND n_current >= 10 AS enough,
                  d * sqrt(n_baseline * n_current / (n_baseline + n_current)) AS lam FROM di),
    pv AS (SELECT *, CASE WHEN NOT enough OR lam < 0.2 THEN 1.0::DOUBLE ELSE greatest(0, least(1, list_sum(list_transform(
                  range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
                                           * exp(-2.0::DOUBLE * k * k * lam * lam))))) END AS p FROM la),
    drift AS (SELECT item_id, n_baseline, n_current, round(CASE WHEN enough THEN d ELSE 0 END, 4) AS test_statistic,
                     round(p, 4) AS p_value, enough AND p < 0.1 AND d > 0.3 AS drift_detected,
                     CASE WHEN NOT enough THEN 'insufficient sample' END AS reason FROM pv)"""


_PRICE_SAMPLES = """SELECT brand_id AS item_id, l_extendedprice AS v, l_shipdate >= TIMESTAMP '1998-07-01' AS cur
                    FROM lineitem JOIN brands ON l_partkey = p_partkey"""
_PART_SAMPLES = """SELECT l_partkey AS item_id, l_quantity AS v, l_shipdate >= TIMESTAMP '1998-07-01' AS cur FROM lineitem"""


def _price_samples(t):
    return t.table("lineitem").join(t.brands, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("brand_id").alias("item_id"), "l_extendedprice", "l_quantity", "l_shipdate"
    )


def _current():
    return F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp")


@query("o3_drift_prices", f"WITH {_drift_sql(_PRICE_SAMPLES)} SELECT * FROM drift", ("brands",))
def o3(t):
    return O.detect_drift(_price_samples(t), ["item_id"], "l_extendedprice", _current())


def part_drift(t):
    samples = t.table("lineitem").withColumnRenamed("l_partkey", "item_id")
    return O.detect_drift(samples, ["item_id"], "l_quantity", _current())


@query("o3_drift_parts", f"WITH {_drift_sql(_PART_SAMPLES)} SELECT * FROM drift")
def o3_parts(t):
    return part_drift(t)


@query(
    "o3_drift_halves",
    f"""WITH {_drift_sql('''SELECT item_id, demand_qty AS v, rn > floor(n / 2.0::DOUBLE) AS cur FROM (
            SELECT item_id, demand_qty, row_number() OVER (PARTITION BY item_id ORDER BY date) AS rn,
                   count(*) OVER (PARTITION BY item_id) AS n
            FROM (SELECT item_id, date, sum(demand_qty) AS demand_qty FROM demand_daily GROUP BY ALL))''')}
        SELECT * FROM drift""",
    ("demand_daily",),
)
def o3_halves(t):
    daily = t.demand_daily.groupBy("item_id", "date").agg(F.sum("demand_qty").alias("demand_qty"))
    return O.detect_drift(O.halves(daily, ["item_id"]), ["item_id"], "demand_qty", F.col("is_current"))


@query(
    "o4_adaptive_parameters",
    """SELECT item_id, CASE WHEN s / m < 0.2 THEN 1.28::DOUBLE WHEN s / m < 0.5 THEN 1.65::DOUBLE ELSE 2.33::DOUBLE END AS z_value,
              round(s, 6) AS std_demand, round(s / m, 6) AS cv
       FROM (SELECT item_id, stddev_pop(demand_qty) AS s, avg(demand_qty) AS m FROM part_daily GROUP BY ALL)""",
    ("part_daily",),
)
def o4(t):
    return rounded(O.adaptive_parameters(t.part_daily, ["item_id"], "demand_qty"), ["std_demand", "cv"], 6)


_AS_OF = "2001-12-01"
_RETRAIN = f"""
    r3 AS (SELECT item_id, max(mape) FILTER (b = 1) AS m1, max(mape) FILTER (b = 2) AS m2, max(mape) FILTER (b = 3) AS m3,
                  max(date) AS last, count(*) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS b FROM metrics_history)
           WHERE b <= 3 GROUP BY ALL)"""


def _as_of():
    return F.lit(_AS_OF).cast("date")


@query(
    "o5_retrain_decisions",
    f"""WITH {_drift_sql(_PRICE_SAMPLES)}, {_RETRAIN}
        SELECT item_id, CASE WHEN drift_detected THEN true WHEN n < 3 THEN false
                             ELSE (m1 > m2 AND m2 > m3 AND m1 > 20) OR DATE '{_AS_OF}' - last > 30 END AS should_retrain,
               CASE WHEN drift_detected THEN 'data drift detected' WHEN n < 3 THEN 'too few metrics'
                    WHEN m1 > m2 AND m2 > m3 AND m1 > 20 THEN 'metrics keep worsening'
                    WHEN DATE '{_AS_OF}' - last > 30 THEN 'maximum training age exceeded'
                    ELSE 'no retraining needed' END AS reason
        FROM r3 LEFT JOIN drift USING (item_id)""",
    ("brands", "metrics_history"),
)
def o5(t):
    drift = O.detect_drift(_price_samples(t), ["item_id"], "l_extendedprice", _current())
    return O.retrain_decisions(t.metrics_history, drift, _as_of(), ["item_id"])


@query(
    "o6_rollback_decisions",
    """SELECT item_id, old_mape, new_mape, coalesce(new_mape > 1.2::DOUBLE * old_mape, false) AS rolled_back,
              CASE WHEN new_mape > 1.2::DOUBLE * old_mape THEN old_mape ELSE new_mape END AS active_mape
       FROM (SELECT item_id, max(mape) FILTER (b = 2) AS old_mape, max(mape) FILTER (b = 1) AS new_mape
             FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS b FROM metrics_history)
             GROUP BY ALL)""",
    ("metrics_history",),
)
def o6(t):
    from granary.operators.windows import series_tail

    two = series_tail(t.metrics_history, 2, ["item_id"]).groupBy("item_id").agg(
        F.min_by("mape", "date").alias("old_mape"), F.max_by("mape", "date").alias("new_mape")
    )
    return O.rollback_decisions(two, ["item_id"])


def _report_sql(days: int | None) -> str:
    limit = "" if days is None else f"AND date >= DATE '{_AS_OF}' - {days}"
    return f"""SELECT item_id, count(*) AS metrics_count, round(avg(mape), 2) AS avg_mape, round(avg(smape), 2) AS avg_smape,
               round(avg(rmse), 2) AS avg_rmse,
               round(CASE WHEN count(*) >= 14 THEN avg(mape) FILTER (b <= 7) - avg(mape) FILTER (b BETWEEN 8 AND 14)
                          ELSE 0 END, 2) AS mape_trend,
               any_value(drift_detected) AS drift_detected, '{'all' if days is None else f'{days}d'}' AS time_range
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC) AS b FROM metrics_history
              WHERE date <= DATE '{_AS_OF}' {limit}) JOIN drift USING (item_id) GROUP BY ALL"""


@query(
    "o7_performance_report",
    f"WITH {_drift_sql(_PRICE_SAMPLES)} {_report_sql(90)} UNION ALL {_report_sql(None)}",
    ("brands", "metrics_history"),
)
def o7(t):
    drift = O.detect_drift(_price_samples(t), ["item_id"], "l_extendedprice", _current())
    parts = [O.performance_report(t.metrics_history, drift, _as_of(), days, ["item_id"]) for days in (90, None)]
    return parts[0].unionByName(parts[1])


_FRACTION = "(CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 15)) AS BIGINT) / CAST(1152921504606846976 AS DOUBLE))"


@query(
    "o8_route_policies",
    f"""SELECT item_id, CASE WHEN pack_size <> 10 OR {_FRACTION} < 0.3 THEN 'current' ELSE 'previous' END AS route,
               CASE WHEN pack_size <> 10 OR {_FRACTION} < 0.3 THEN 2 ELSE 1 END AS version,
               CASE WHEN pack_size <> 10 OR {_FRACTION} < 0.3 THEN category ELSE brand END AS policy
        FROM items""",
    ("items",),
)
def o8(t):
    policies = t.items.select("item_id", F.lit(1).alias("version"), F.col("brand").alias("policy")).unionByName(
        t.items.select("item_id", F.lit(2).alias("version"), F.col("category").alias("policy"))
    )
    return O.route_policies(t.items, t.items.where("pack_size = 10"), policies, 0.3)


@query(
    "o8_rollback_policies",
    "SELECT item_id, 3 AS version, brand AS policy FROM items WHERE abc_class = 'A'",
    ("items",),
)
def o8_rollback(t):
    policies = t.items.select("item_id", F.lit(1).alias("version"), F.col("brand").alias("policy")).unionByName(
        t.items.select("item_id", F.lit(2).alias("version"), F.col("category").alias("policy"))
    )
    return O.rollback_policies(policies, t.items.where("abc_class = 'A'"))


@query(
    "o9_due_for_retraining",
    """SELECT item_id, last_trained, CAST(DATE '2001-12-01' - last_trained AS INTEGER) AS age_days
       FROM (SELECT l_partkey AS item_id, CAST(max(l_shipdate) AS DATE) AS last_trained FROM lineitem GROUP BY ALL)
       WHERE DATE '2001-12-01' - last_trained >= 90""",
)
def o9(t):
    models = t.table("lineitem").groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.to_date(F.max("l_shipdate")).alias("last_trained")
    )
    return O.due_for_retraining(models, _as_of(), 90)


@query(
    "o10_system_status",
    f"""WITH {_drift_sql(_PART_SAMPLES)}
        SELECT category AS model, count(*) AS models, count(*) FILTER (drift_detected) AS drifting,
               CAST(coalesce(sum(n), 0) AS BIGINT) AS open_orders
        FROM items LEFT JOIN drift USING (item_id)
        LEFT JOIN (SELECT item_id, count(*) AS n FROM purchase_orders WHERE status = 'O' GROUP BY ALL) USING (item_id)
        GROUP BY ALL""",
    ("items", "purchase_orders"),
)
def o10(t):
    models = t.items.select("item_id", F.col("category").alias("model"))
    return O.system_status(models, part_drift(t), t.purchase_orders)
