"""Column expressions of the domain, and the small tables of fixed values behind them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normal quantile per service level, and what an unlisted level gets.
Z_BY_SERVICE_LEVEL = {0.90: 1.28, 0.95: 1.65, 0.97: 1.88, 0.98: 2.05, 0.99: 2.33}
DEFAULT_Z = 1.65
# Adjustment of that quantile per value class.
Z_ADJUSTMENT = {"A": 1.1, "B": 1.0, "C": 0.9}
# Share of monthly demand an order must reach, per class.
MIN_ORDER_RATIO = {"A": 0.1, "B": 0.2, "C": 0.3}
DEFAULT_MIN_ORDER_RATIO = 0.2


def lookup(key: Column, table: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def calendar_parts(date: str = "date") -> dict[str, Column]:
    """Month to day-of-month parts and the weekend and month-edge flags; Monday is day 0."""
    d = F.col(date)
    return {
        "month": F.month(d),
        "quarter": F.quarter(d),
        "year": F.year(d),
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


def cyclic_parts(date: str = "date") -> dict[str, Column]:
    turn = lambda part, n: 2 * F.pi() * part / n
    return {
        "sin_month": F.sin(turn(F.month(date), 12)),
        "cos_month": F.cos(turn(F.month(date), 12)),
        "sin_day_of_week": F.sin(turn(F.weekday(date), 7)),
        "cos_day_of_week": F.cos(turn(F.weekday(date), 7)),
    }


def polynomials(columns: list[str], degree: int) -> dict[str, Column]:
    return {f"{c}_poly_{d}": F.pow(F.col(c), F.lit(d)) for c in columns for d in range(2, degree + 1)}


def interactions(columns: list[str], max_pairs: int | None = None) -> dict[str, Column]:
    pairs = list(combinations(columns, 2))[:max_pairs]
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}


def eoq(demand: Column, order_cost: Column, holding_cost: Column, no_holding: str = "demand") -> Column:
    """Economic order quantity; without a holding cost the whole demand, or infinity with `no_holding='infinite'`."""
    otherwise = demand.cast("double") if no_holding == "demand" else F.lit(float("inf"))
    return F.when(holding_cost > 0, F.sqrt(2 * demand * order_cost / holding_cost)).otherwise(otherwise)


def total_cost(qty: Column, demand: Column, order_cost: Column, holding_cost: Column, unit_cost: Column) -> Column:
    cost = demand / qty * order_cost + qty / 2 * holding_cost + demand * unit_cost
    return F.when(qty == 0, 0.0).otherwise(cost)


def reorder_point(daily_demand: Column, lead_time: Column, safety_stock: Column) -> Column:
    return daily_demand * lead_time + safety_stock


def service_z(level: Column) -> Column:
    return lookup(level, Z_BY_SERVICE_LEVEL, DEFAULT_Z)


def safety_stock(z: Column, lead_time_std: Column) -> Column:
    return F.round(z * lead_time_std, 2)


def dynamic_z(level: Column, abc_class: Column, cv: Column) -> Column:
    stretch = F.least(1 + (cv - 0.5) * 0.5, F.lit(2.0))
    return service_z(level) * lookup(abc_class, Z_ADJUSTMENT, 1.0) * stretch


def lead_time_sigma(mean: Column, std: Column, lead_time: Column, lead_time_std: Column) -> Column:
    """Spread of demand over the lead time, with the lead time's own spread when it has one."""
    uncertain = F.sqrt(lead_time * std * std + lead_time_std * lead_time_std * mean * mean)
    return F.when(lead_time_std > 0, uncertain).otherwise(std * F.sqrt(lead_time))


def dynamic_safety_stock(df: DataFrame, level: float = 0.95, min_points: int = 10) -> DataFrame:
    """Safety stock from (mean, std, n, lead_time, lead_time_std, abc_class) with the inputs it used.

    Null where there are fewer than `min_points` observations.
    """
    cv = F.when(F.col("demand_mean") > 0, F.col("demand_std") / F.col("demand_mean")).otherwise(0.0)
    sigma = lead_time_sigma(*[F.col(c) for c in ("demand_mean", "demand_std", "lead_time", "lead_time_std")])
    enough = F.col("n_points") >= min_points
    return (
        df.withColumn("demand_cv", cv)
        .withColumn("z_value", dynamic_z(F.lit(level), F.col("abc_class"), F.col("demand_cv")))
        .withColumn("safety_stock", F.when(enough, F.round(F.col("z_value") * sigma, 2)))
    )


def normal_cdf(x: Column) -> Column:
    """Normal distribution function through the Abramowitz-Stegun 7.1.26 polynomial for erf (error below 1.5e-7)."""
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def service_level(stock: Column, sigma: Column) -> Column:
    return F.when(sigma == 0, 1.0).otherwise(normal_cdf(stock / sigma))


def min_order_quantity(monthly_demand: Column, abc_class: Column, ratios: dict[str, float] | None = None) -> Column:
    ratio = lookup(abc_class, ratios or MIN_ORDER_RATIO, DEFAULT_MIN_ORDER_RATIO)
    return F.greatest(F.round(monthly_demand * ratio, 2), F.lit(1.0))


def xyz_class(cv: Column, mean: Column, n: Column, x_limit: float = 0.1, y_limit: float = 0.2) -> Column:
    return (
        F.when(n < 5, "Y")
        .when(mean <= 0, "Z")
        .when(cv <= x_limit, "X")
        .when(cv <= y_limit, "Y")
        .otherwise("Z")
    )


def abc_xyz(
    classified: DataFrame, demand: DataFrame, value: str, x_limit: float = 0.1, y_limit: float = 0.2
) -> DataFrame:
    """Value class and stability class as one label; a product without demand history counts as Y."""
    mean = F.avg(value)
    stability = xyz_class(F.stddev_pop(value) / mean, mean, F.count(value), x_limit, y_limit)
    xyz = demand.groupBy("item_id").agg(stability.alias("xyz_class"))
    joined = classified.join(xyz, "item_id", "left")
    return joined.withColumn("abc_xyz", F.concat_ws("-", "abc_class", F.coalesce("xyz_class", F.lit("Y"))))


def abc_by_share(value: Column, total: Column) -> Column:
    """Class of one product by its own share of the total."""
    share = F.when(total == 0, 0.0).otherwise(value / total)
    return F.when(share >= 0.7, "A").when(share >= 0.2, "B").otherwise("C")


def model_tag() -> Column:
    """Model tag from cv, intermittency_index and seasonality_strength."""
    cv, gaps, season = F.col("cv"), F.col("intermittency_index"), F.col("seasonality_strength")
    seasonal = season > 0.3
    return (
        F.when((gaps > 0.3) & (season < 0.2), "croston")
        .when(gaps > 0.3, "tbats")
        .when((cv < 0.2) & seasonal, "holt_winters")
        .when(cv < 0.2, "arima")
        .when((cv < 0.5) & seasonal, "sarimax")
        .when(cv < 0.5, "hybrid")
        .when(seasonal, "xgboost")
        .otherwise("lightgbm")
    )


def service_tag() -> Column:
    """Variability label from the second feature vector."""
    cv, gaps = F.col("cv"), F.col("intermittency_index")
    season, trend = F.col("seasonality_strength"), F.col("trend_strength")
    return (
        F.when(gaps > 0.5, "intermittent")
        .when((cv > 0.7) & (season > 0.3), "high_seasonal_high_variability")
        .when(cv > 0.7, "non_seasonal_high_variability")
        .when((cv > 0.3) & (season > 0.3), "medium_seasonal_medium_variability")
        .when(cv > 0.3, "non_seasonal_medium_variability")
        .when(season > 0.3, "high_seasonal_low_variability")
        .when(trend > 0.1, "trending_low_variability")
        .otherwise("stable_low_variability")
    )


def pack_round_up(qty: Column, pack: Column, min_order: Column | None = None) -> Column:
    """Whole packs covering the quantity, at least the minimum order."""
    wanted = qty if min_order is None else F.greatest(qty, min_order)
    return (F.ceil(wanted / pack) * pack).cast("bigint")


def forecast_interval(yhat: Column, mape: Column) -> tuple[Column, Column]:
    """Lower and upper bound from the recent percentage error; the lower bound is not negative."""
    low = F.round(F.greatest(F.lit(0.0), yhat * (1 - mape / 100)), 2)
    return low, F.round(yhat * (1 + mape / 100), 2)


def month_factor(date: str = "date", winter: float = 1.2, spring: float = 0.9, other: float = 1.0) -> Column:
    month = F.month(date)
    return F.when(month.isin(11, 12, 1), winter).when(month.isin(3, 4, 5), spring).otherwise(other)


def chart_label(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM-dd")
