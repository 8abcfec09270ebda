"""Croston-type models for intermittent demand, as expressions over one demand list per series.

The list holds the non-zero days of one series, at most one entry per calendar day, and the recurrence is a
JVM-side fold over it; nothing leaves the executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.aggregates import decompose
from granary.operators.scale import spread

SERIES = ["item_id", "location_id"]
METHODS = ("croston", "sba", "sba_m", "sba_variance", "tsb", "tsb_simple")

# Smoothing and trend weights of the simple TSB model.
TSB_SIMPLE = {"alpha": 0.1, "interval_alpha": 0.1, "beta": 0.05}
_EPS = 1e-8


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _demand_lists(df: DataFrame, keys: list[str], value: str, date: str) -> DataFrame:
    """Per series: the ordered non-zero demands with the gap that follows each, all values, and their statistics."""
    line = Window.partitionBy(*keys).orderBy(date)
    placed = spread(df.select(*keys, date, F.col(value).cast("double").alias("y")), *keys)
    placed = placed.select(*keys, "y", (F.row_number().over(line) - 1).alias("pos"))
    placed = placed.withColumn("demand", F.col("y") > 0)
    # The gap after the i-th demand is the i-th interval; the last demand has none.
    demands = Window.partitionBy(*keys, "demand").orderBy("pos")
    so_far = demands.rowsBetween(Window.unboundedPreceding, 0)
    gaps = placed.withColumn("gap", F.when(F.col("demand"), F.lead("pos").over(demands) - F.col("pos")).cast("double"))
    gaps = gaps.select(
        "*",
        F.row_number().over(demands).alias("rank"),
        F.stddev_pop("gap").over(so_far).alias("gap_std"),
    )
    where = lambda c, condition=F.col("demand"): F.when(condition, F.col(c))
    early = F.col("demand") & (F.col("rank") <= 3)
    pos = F.col("pos").cast("double")
    return gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("mean_all"),
        F.count(where("y")).alias("n_demand"),
        F.avg(where("y")).alias("demand_mean"),
        F.stddev_pop(where("y")).alias("demand_std"),
        F.avg("gap").alias("gap_mean"),
        F.stddev_pop("gap").alias("gap_std_all"),
        F.regr_slope(where("y"), F.when(F.col("demand"), pos)).alias("slope_all"),
        F.regr_slope(where("y", early), F.when(early, pos)).alias("slope_first"),
        F.max(where("pos")).alias("last_pos"),
        F.sort_array(F.collect_list(F.when(F.col("demand"), F.struct("pos", "y", "gap", "gap_std")))).alias("demands"),
        F.sort_array(F.collect_list(F.struct("pos", "y"))).alias("history"),
    )


def fit(
    df: DataFrame,
    method: str = "croston",
    keys: list[str] = SERIES,
    value: str = "demand_qty",
    date: str = "date",
    alpha: float | None = None,
    beta: float | None = None,
) -> DataFrame:
    """Smoothed level, interval and trend per series, `base` (the first forecast) and in-sample `rmse`.

    Weights adapt to the series unless given. Fewer than two demands leave the plain mean.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    interval_alpha = alpha
    if method == "tsb_simple":
        alpha, interval_alpha, beta = (TSB_SIMPLE[k] for k in ("alpha", "interval_alpha", "beta"))
    lists = _demand_lists(df, keys, value, date)

    volatility = F.col("demand_std") / (F.col("demand_mean") + _EPS)
    gap_volatility = F.col("gap_std_all") / (F.col("gap_mean") + _EPS)
    slope = lambda c: F.when(F.col("n_demand") >= 3, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)
    a = _clip(0.1 + 0.2 * volatility, 0.05, 0.3) if alpha is None else F.lit(float(alpha))
    b = _clip(0.1 * F.abs(slope("slope_all")), 0.01, 0.2) if beta is None else F.lit(float(beta))
    if method.startswith("tsb"):
        g = _clip(0.1 + 0.2 * gap_volatility, 0.05, 0.3) if interval_alpha is None else F.lit(float(interval_alpha))
    else:
        g = a
    weighted = lists.select("*", a.alias("alpha"), b.alias("beta"), g.alias("gap_alpha"), slope("slope_first").alias("trend0"))

    inflate = lambda interval, std: interval * (1 + 0.5 * F.pow(std / (interval + _EPS), F.lit(2)))
    first = F.get(F.col("demands"), F.lit(0))
    start_gap = first["gap"]
    if method == "sba_variance":
        start_gap = F.when(F.col("n_demand") > 2, inflate(start_gap, F.col("gap_std_all"))).otherwise(start_gap)

    def step(state: Column, demand: Column) -> Column:
        level = F.col("alpha") * demand["y"] + (1 - F.col("alpha")) * (state["level"] + state["trend"])
        trend = F.col("beta") * (level - state["level"]) + (1 - F.col("beta")) * state["trend"]
        interval = F.col("gap_alpha") * demand["gap"] + (1 - F.col("gap_alpha")) * state["interval"]
        if method == "sba_variance":
            interval = inflate(interval, demand["gap_std"])
        kept = F.when(demand["gap"].isNull(), state["interval"]).otherwise(interval)
        return F.struct(level.alias("level"), kept.alias("interval"), trend.alias("trend"))

    enough = F.col("n_demand") >= 2
    start = F.struct(
        F.when(enough, first["y"]).otherwise(F.col("mean_all")).alias("level"),
        F.when(enough, start_gap).otherwise(F.lit(1.0)).alias("interval"),
        F.when(enough, F.col("trend0")).otherwise(F.lit(0.0)).alias("trend"),
    )
    rest = F.when(enough, F.slice("demands", F.lit(2), F.greatest(F.size("demands") - 1, F.lit(0)))).otherwise(
        F.slice("demands", 1, 0)
    )
    folded = weighted.withColumn("_s", F.aggregate(rest, start, step))
    level, interval, trend = (F.col(f"_s.{c}") for c in ("level", "interval", "trend"))
    below_one = lambda value, limit: F.when(F.col("alpha") < 1, value).otherwise(limit)
    gamma = {
        "sba": below_one((2 - F.col("alpha")) / (2 * (1 - F.col("alpha"))), 1.0),
        "sba_m": below_one((1 - F.col("alpha")) / 2, 0.5),
    }.get(method)
    divisor = interval if gamma is None else F.greatest(interval - gamma, F.lit(0.5))
    base = level / (F.when(enough, divisor).otherwise(interval) + _EPS)
    squares = F.aggregate(
        "history",
        F.lit(0.0),
        lambda total, x: total
        + F.pow(x["y"] - F.greatest(F.lit(0.0), F.col("base") + F.col("_s.trend") * x["pos"]), F.lit(2)),
    )
    return folded.withColumn("base", base).select(
        *keys, "n", "last_pos", "alpha", "beta", "gap_alpha", "trend0", level.alias("level"), interval.alias("interval"), trend.alias("trend"),
        "base", F.sqrt(squares / F.col("n")).alias("rmse"),
    )


def forecast(
    fitted: DataFrame, steps: int, keys: list[str] = SERIES, seasonal: DataFrame | None = None, period: int = 12
) -> DataFrame:
    """Non-negative forecasts for steps 1..`steps`; `seasonal` (keys, phase, effect) adds a phase effect."""
    rows = fitted.select(*keys, "base", "trend", "last_pos", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    effect = F.lit(0.0)
    if seasonal is not None:
        rows = rows.withColumn("phase", (F.coalesce("last_pos", F.lit(0)) + F.col("step")) % period)
        rows = rows.join(seasonal, [*keys, "phase"], "left")
        effect = F.coalesce(F.col("effect"), F.lit(0.0))
    value = F.col("base") + F.col("trend") * (F.col("step") - 1) + effect
    return rows.select(*keys, "step", F.greatest(F.lit(0.0), value).alias("yhat"))


def unit_root(df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """Dickey-Fuller t statistic of the change on the previous level, with constant and no extra lags.

    `non_stationary` compares it with the 5 % critical value.
    """
    critical = -2.86
    line = Window.partitionBy(*keys).orderBy(date)
    steps = df.select(*keys, F.lag(value).over(line).alias("x"), (F.col(value) - F.lag(value).over(line)).alias("d"))
    y, x = F.col("d"), F.col("x")
    slope, sxx = F.regr_slope(y, x), F.regr_sxx(y, x)
    sse = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    t = F.try_divide(slope, F.sqrt(F.try_divide(F.try_divide(sse, F.count(y) - 2), sxx)))
    tested = steps.groupBy(*keys).agg(t.alias("t_statistic"), F.count(F.lit(1)).alias("n"))
    return tested.withColumn("non_stationary", F.coalesce(F.col("t_statistic") > critical, F.lit(False)))


def demand_trend(df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """Slope of the non-zero demand over its day position; 0 with fewer than three demands."""
    line = Window.partitionBy(*keys).orderBy(date)
    placed = df.select(*keys, F.col(value).alias("y"), (F.row_number().over(line) - 1).cast("double").alias("pos"))
    return (
        placed.where(F.col("y") > 0)
        .groupBy(*keys)
        .agg(
            F.when(F.count(F.lit(1)) >= 3, F.coalesce(F.regr_slope("y", "pos"), F.lit(0.0))).otherwise(0.0).alias("slope"),
            F.count(F.lit(1)).alias("n_demand"),
        )
    )


def seasonal_effects(df: DataFrame, period: int, keys: list[str] = SERIES, value: str = "demand_qty") -> DataFrame:
    """Phase effects (keys, phase, effect) of the series long enough and flagged as non-stationary."""
    flags = unit_root(df, keys, value).where(F.col("non_stationary") & (F.col("n") >= 2 * period))
    parts = decompose(df, keys, value, period)
    effects = parts.groupBy(*keys, (F.col("pos") % period).alias("phase")).agg(F.max("seasonal").alias("effect"))
    return effects.join(flags.select(*keys), keys, "left_semi")
