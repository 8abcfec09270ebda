"""Experiment queries over user events and backtest errors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.catalog.scalars import CDF, erf_sql
from granary.catalog.views import SERIES
from granary.operators import experiments as X

_BITS = "CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"
_WEIGHTS = {"control": 0.5, "variant": 0.5}


@query(
    "x1_assign_uniform",
    f"""SELECT event_id, user_id, ['A', 'B', 'C'][{_BITS.format(key="CAST(user_id AS VARCHAR)")} % 3 + 1] AS variant
        FROM events""",
)
def x1(t):
    return t.table("events").select(
        "event_id", "user_id", X.assign_uniform(F.col("user_id"), ["A", "B", "C"]).alias("variant")
    )


@query(
    "x2_assign_sticky",
    f"""SELECT o_orderkey, CASE WHEN f <= 0.2 THEN 'control' WHEN f <= 0.7 THEN 'variant' ELSE 'holdout' END AS variant
        FROM (SELECT o_orderkey, {_BITS.format(key="concat(CAST(o_custkey AS VARCHAR), '_', CAST(o_orderkey AS VARCHAR))")}
                     / CAST(1152921504606846976 AS DOUBLE) AS f FROM orders)""",
)
def x2(t):
    weights = {"control": 0.2, "variant": 0.5, "holdout": 0.3}
    chosen = X.assign_sticky(F.col("o_custkey"), F.col("o_orderkey"), weights)
    return t.table("orders").select("o_orderkey", chosen.alias("variant"))


@query(
    "x3_assign_stratified",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 'variant' ELSE 'control' END AS variant FROM part",
)
def x3(t):
    return t.table("part").select("p_partkey", X.assign_stratified(F.col("p_partkey"), _WEIGHTS, key=F.col("p_partkey")).alias("variant"))


@query(
    "x4_assign_random",
    f"""SELECT event_type, CASE WHEN f <= 0.3 THEN 'control' ELSE 'variant' END AS variant, count(*) AS n
        FROM (SELECT event_type, {_BITS.format(key="concat(CAST(event_id AS VARCHAR), '_7')")}
                     / CAST(1152921504606846976 AS DOUBLE) AS f FROM events) GROUP BY ALL""",
)
def x4(t):
    drawn = t.table("events").withColumn("variant", X.assign_random({"control": 0.3, "variant": 0.7}, 7, F.col("event_id")))
    return drawn.groupBy("event_type", "variant").agg(F.count(F.lit(1)).alias("n"))


def _observed(t):
    """Two groups: the `last` model is control, the `mean3` model is the variant."""
    rows = t.backtests.where("model in ('last', 'mean3')").select(
        *SERIES, "date", F.when(F.col("model") == "last", "control").otherwise("variant").alias("group"),
        "actual", F.col("yhat").alias("predicted"),
    )
    return X.observation_errors(rows)


_OBSERVED = """(SELECT item_id, location_id, date, CASE model WHEN 'last' THEN 'control' ELSE 'variant' END AS "group",
       actual, yhat AS predicted, abs(actual - yhat) AS error, pow(actual - yhat, 2) AS squared_error,
       CASE WHEN actual <> 0 THEN abs((actual - yhat) / actual) ELSE 0 END AS absolute_percentage_error
    FROM backtests WHERE model IN ('last', 'mean3'))"""


@query(
    "x5_observation_errors",
    f"""SELECT item_id, location_id, date, "group", actual, round(predicted, 6) AS predicted, round(error, 6) AS error,
               round(squared_error, 5) AS squared_error, round(absolute_percentage_error, 6) AS absolute_percentage_error
        FROM {_OBSERVED}""",
    ("backtests",),
)
def x5(t):
    return rounded(
        rounded(_observed(t), ["predicted", "error", "absolute_percentage_error"], 6), ["squared_error"], 5
    )


@query(
    "x6_group_summary",
    f"""WITH g AS (SELECT item_id, "group", sqrt(avg(squared_error)) AS rmse, avg(error) AS mae,
                          avg(absolute_percentage_error) * 100 AS mape FROM {_OBSERVED} GROUP BY ALL),
        u AS (UNPIVOT g ON rmse, mae, mape INTO NAME metric VALUE v),
        p AS (SELECT item_id, metric, max(v) FILTER ("group" = 'control') AS c, max(v) FILTER ("group" = 'variant') AS v
              FROM u GROUP BY ALL)
        SELECT item_id, metric, round(c, 5) AS control, round(v, 5) AS variant, round(v - c, 5) AS difference,
               round((c - v) / c * 100, 5) AS improvement FROM p""",
    ("backtests",),
)
def x6(t):
    summary = X.group_summary(_observed(t), ["item_id"])
    return rounded(summary, ["control", "variant", "difference", "improvement"], 5)


_STATS = """s AS (SELECT variant, metric, count(*) AS n, avg(value) AS m, var_samp(value) AS vs, var_pop(value) AS vp
    FROM observations GROUP BY ALL),
    p AS (SELECT a.metric, a.variant AS variant_a, b.variant AS variant_b, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2,
                 a.vs AS v1, b.vs AS v2, a.vp AS p1, b.vp AS p2
          FROM s a JOIN s b ON a.metric = b.metric AND a.variant < b.variant)"""


@query(
    "x7_welch_statistics",
    f"""WITH {_STATS} SELECT variant_a, variant_b, metric, n1 AS n_a, n2 AS n_b,
               round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t_statistic,
               round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS degrees,
               round((m1 - m2) / sqrt(((n1 - 1) * p1 + (n2 - 1) * p2) / (n1 + n2 - 2)), 6) AS cohens_d
        FROM p""",
    ("observations",),
)
def x7(t):
    tested = X.t_statistics(t.observations).select(
        "variant_a", "variant_b", "metric", "n_a", "n_b", "t_statistic", "degrees", "cohens_d"
    )
    return rounded(rounded(tested, ["t_statistic", "cohens_d"], 6), ["degrees"], 4)


@query(
    "x7_pooled_statistics",
    f"""WITH {_STATS} SELECT variant_a, variant_b, metric, n1 AS n_a, n2 AS n_b,
               round((m1 - m2) / (sd * sqrt(1 / n1 + 1 / n2)), 6) AS t_statistic, CAST(n1 + n2 - 2 AS DOUBLE) AS degrees,
               round((m1 - m2) / sd, 6) AS cohens_d
        FROM (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM p)""",
    ("observations",),
)
def x7_pooled(t):
    tested = X.t_statistics(t.observations, pooled=True).select(
        "variant_a", "variant_b", "metric", "n_a", "n_b", "t_statistic", "degrees", "cohens_d"
    )
    return rounded(tested, ["t_statistic", "cohens_d"], 6)


@query("x7_t_tests")
def x7_tests(t):
    return X.t_tests(t.observations, min_sample=100)


_SUCCESS = """(SELECT variant, metric, count(*) AS successes,
           CAST(sum(count(*)) OVER (PARTITION BY variant) AS BIGINT) AS total
    FROM observations GROUP BY variant, metric)"""


@query(
    "x8_chi_square",
    f"""WITH k AS (SELECT a.metric, a.variant AS variant_a, b.variant AS variant_b, a.successes AS successes_a,
                          b.successes AS successes_b, a.total AS total_a, b.total AS total_b,
                          (a.successes + b.successes) / CAST(a.total + b.total AS DOUBLE) AS r
                   FROM {_SUCCESS} a JOIN {_SUCCESS} b ON a.metric = b.metric AND a.variant < b.variant),
        e AS (SELECT *, total_a * r AS ea, total_b * r AS eb, total_a * (1 - r) AS fa, total_b * (1 - r) AS fb FROM k),
        g AS (SELECT *, abs(successes_a - ea) AS g1, abs(successes_b - eb) AS g2, abs(total_a - successes_a - fa) AS g3,
                     abs(total_b - successes_b - fb) AS g4 FROM e),
        c AS (SELECT *, pow(g1 - least(0.5, g1), 2) / ea + pow(g2 - least(0.5, g2), 2) / eb
                        + pow(g3 - least(0.5, g3), 2) / fa + pow(g4 - least(0.5, g4), 2) / fb AS chi FROM g),
        z AS (SELECT *, sqrt(chi) AS x, sqrt(chi) / sqrt(2.0::DOUBLE) AS z FROM c)
        SELECT metric, variant_a, variant_b, successes_a, successes_b, total_a, total_b,
               round(ea, 5) AS expected_success_a, round(eb, 5) AS expected_success_b, round(chi, 6) AS chi2_statistic,
               round(2 * (1 - {CDF.format(x="x", e=erf_sql("z"))}), 6) AS p_value,
               2 * (1 - {CDF.format(x="x", e=erf_sql("z"))}) < 0.05 AS significant
        FROM z""",
    ("observations",),
)
def x8(t):
    counted = t.observations.groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("successes"))
    total = F.sum("successes").over(Window.partitionBy("variant"))  # over one row per kind of event
    counted = counted.withColumn("total", total)
    tested = X.chi_square(counted, ["metric"])
    return rounded(
        rounded(tested, ["chi2_statistic", "p_value"], 6), ["expected_success_a", "expected_success_b"], 5
    )


@query("x9_bootstrap")
def x9(t):
    return X.bootstrap_test(t.observations)


def _experiments(t):
    """One experiment per event type, running from its first event for 45 days when it has many signups."""
    return t.table("events").groupBy(F.col("event_type").alias("experiment_id")).agg(
        F.to_date(F.min("ts")).alias("start_date"),
        F.when(F.max("user_id") % 2 == 1, F.to_date(F.max("ts"))).alias("end_date"),
    )


@query(
    "x10_experiment_summary",
    f"""WITH {_STATS},
        e AS (SELECT event_type AS experiment_id, CAST(min(ts) AS DATE) AS s,
                     CASE WHEN max(user_id) % 2 = 1 THEN CAST(max(ts) AS DATE) END AS f FROM events GROUP BY ALL),
        o AS (SELECT metric AS experiment_id, count(DISTINCT variant) AS variants, count(*) AS observations
              FROM observations GROUP BY ALL),
        r AS (SELECT metric AS experiment_id, count(*) AS comparisons,
                     count(*) FILTER (abs((m1 - m2) / sqrt(v1 / n1 + v2 / n2)) > 1.96) AS significant FROM p GROUP BY ALL)
        SELECT experiment_id, CASE WHEN f IS NULL OR f > DATE '2024-02-15' THEN 'active' ELSE 'ended' END AS state,
               CAST(coalesce(f, DATE '2024-02-15') - s AS INTEGER) AS duration_days, variants, observations, comparisons,
               significant
        FROM e JOIN o USING (experiment_id) JOIN r USING (experiment_id)""",
    ("observations",),
)
def x10(t):
    observed = t.observations.withColumnRenamed("metric", "experiment_id")
    results = X.t_statistics(t.observations).select(
        F.col("metric").alias("experiment_id"), (F.abs("t_statistic") > 1.96).alias("significant")
    )
    return X.experiment_summary(_experiments(t), observed, results, F.lit("2024-02-15").cast("date"))


@query(
    "x10_end_experiment",
    """SELECT event_type AS experiment_id, CAST(min(ts) AS DATE) AS start_date,
              CASE WHEN event_type = 'view' THEN DATE '2024-01-20'
                   WHEN max(user_id) % 2 = 1 THEN CAST(max(ts) AS DATE) END AS end_date
       FROM events GROUP BY event_type""",
)
def x10_end(t):
    return X.end_experiment(_experiments(t), "view", F.lit("2024-01-20").cast("date"))


@query(
    "x11_chart_data",
    """SELECT variant, metric, n, round(m, 5) AS mean, round(s, 5) AS std, round(m - s, 5) AS bar_low,
              round(m + s, 5) AS bar_high, round(m - 1.96::DOUBLE * s / sqrt(n), 5) AS ci_low,
              round(m + 1.96::DOUBLE * s / sqrt(n), 5) AS ci_high
       FROM (SELECT variant, metric, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM observations GROUP BY ALL)""",
    ("observations",),
)
def x11(t):
    return rounded(X.chart_data(t.observations), ["mean", "std", "bar_low", "bar_high", "ci_low", "ci_high"], 5)


@query("x11_significance_matrix")
def x11_matrix(t):
    return X.significance_matrix(X.t_tests(t.observations), ["A", "B", "C"])
