"""Feature vectors, reports and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.scale import exact_quantiles

SERIES = ["item_id", "location_id"]


def distinct_keys(df: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return df.select(*keys).distinct()


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def decompose(df: DataFrame, keys: list[str], value: str, period: int, date: str = "date") -> DataFrame:
    """Classical additive decomposition: `trend`, `seasonal`, `resid`, with position `pos` from 0.

    The trend is the centred moving average (two-sided 2xMA for an even period) and is null where the frame is
    cut off. Seasonal effects are the phase means of the detrended values, centred to zero.
    All three windows share the hash partitioning by `keys`; a partition is one series of calendar days.
    """
    line = Window.partitionBy(*keys).orderBy(date)
    series = Window.partitionBy(*keys)
    phase = Window.partitionBy(*keys, "_phase")
    half = period // 2
    if period % 2:
        frame = line.rowsBetween(-half, half)
        smooth = F.when(F.count(value).over(frame) == period, F.avg(value).over(frame))
    else:
        wide = line.rowsBetween(-half, half)
        ends = (F.lag(value, half).over(line) + F.lead(value, half).over(line)) / 2
        smooth = F.when(
            F.count(value).over(wide) == period + 1, (F.sum(value).over(wide) - ends) / period
        )
    placed = df.select(
        "*", (F.row_number().over(line) - 1).alias("pos"), smooth.alias("trend")
    ).withColumn("_phase", F.col("pos") % period)
    phased = placed.select(
        "*",
        F.avg(F.col(value) - F.col("trend")).over(phase).alias("_phase_mean"),
        F.count(F.lit(1)).over(phase).alias("_phase_rows"),
    )
    centre = F.sum(F.col("_phase_mean") / F.col("_phase_rows")).over(series) / F.sum(
        F.when(F.col("_phase_mean").isNotNull(), 1 / F.col("_phase_rows"))
    ).over(series)
    return (
        phased.withColumn("seasonal", F.col("_phase_mean") - centre)
        .withColumn("resid", F.col(value) - F.col("trend") - F.col("seasonal"))
        .drop("_phase", "_phase_mean", "_phase_rows")
    )


def seasonal_strength(df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", period: int = 7) -> DataFrame:
    """Spread of the seasonal part over spread of seasonal plus residual; 0 below two periods."""
    seasonal, resid = F.stddev_pop("seasonal"), F.stddev_pop("resid")
    strength = F.when(F.count(F.lit(1)) < 2 * period, 0.0).otherwise(
        F.coalesce(_ratio(seasonal, seasonal + resid), F.lit(0.0))
    )
    return decompose(df, keys, value, period).groupBy(*keys).agg(strength.alias("seasonality_strength"))


def demand_features(
    df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", promotion: float = 1.5, period: int = 7
) -> DataFrame:
    """Demand feature vector per series: one shuffle by key, then windows and one aggregate on that partitioning."""
    series = Window.partitionBy(*keys)
    x = F.col(value)
    parts = decompose(df, keys, value, period).withColumn("_mean", F.avg(value).over(series))
    spread, seasonal, resid = F.stddev_pop(x), F.stddev_pop("seasonal"), F.stddev_pop("resid")
    flat = F.max(x) == F.min(x)
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    return parts.groupBy(*keys).agg(
        _ratio(spread, F.avg(x)).alias("cv"),
        F.when(F.count(F.lit(1)) < 2 * period, 0.0)
        .otherwise(F.coalesce(_ratio(seasonal, seasonal + resid), F.lit(0.0)))
        .alias("seasonality_strength"),
        share(x == 0).alias("intermittency_index"),
        share((F.col("_mean") != 0) & (x > promotion * F.col("_mean"))).alias("promotion_flag"),
        F.avg(x).alias("mean_demand"),
        spread.alias("std_demand"),
        F.min(x).alias("min_demand"),
        F.max(x).alias("max_demand"),
        F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"),
    )


def service_features(df: DataFrame, keys: list[str] = SERIES, value: str = "demand_qty", date: str = "date") -> DataFrame:
    """Second feature vector, for monthly series: 12-phase seasonality, trend strength, sample moments."""
    line = Window.partitionBy(*keys).orderBy(date)
    phase = Window.partitionBy(*keys, "_phase")
    x, n = F.col(value), F.count(F.lit(1))
    placed = df.select("*", (F.row_number().over(line) - 1).alias("_pos")).withColumn("_phase", F.col("_pos") % 12)
    phased = placed.select(
        "*",
        F.avg(value).over(phase).alias("_phase_mean"),
        (F.row_number().over(phase.orderBy("_pos")) == 1).alias("_phase_head"),
    )
    head_mean = F.when(F.col("_phase_head"), F.col("_phase_mean"))
    mean, spread = F.avg(x), F.stddev_pop(x)
    cv = _ratio(spread, mean)
    nonzero = F.avg(F.when(x > 0, 1.0).otherwise(0.0))
    flat = F.max(x) == F.min(x)
    skew = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return phased.groupBy(*keys).agg(
        F.round(cv, 3).alias("cv"),
        F.round(F.when(n < 12, 0.0).otherwise(_ratio(F.stddev_pop(head_mean), F.avg(head_mean))), 3).alias(
            "seasonality_strength"
        ),
        F.round(cv * (1 - nonzero), 3).alias("intermittency_index"),
        F.round(nonzero, 3).alias("demand_frequency"),
        F.round(mean, 3).alias("average_demand"),
        F.round(
            F.when(n < 2, 0.0).otherwise(_ratio(F.abs(F.regr_slope(x, F.col("_pos").cast("double"))), mean)), 3
        ).alias("trend_strength"),
        F.round(F.max(x), 3).alias("max_demand"),
        F.round(F.min(x), 3).alias("min_demand"),
        F.round(F.when((n < 3) | flat, 0.0).otherwise(skew), 3).alias("skewness"),
        F.round(F.when((n < 4) | flat, 0.0).otherwise(kurt), 3).alias("kurtosis"),
    )


def feature_report(features: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample spread, extremes and exact quartiles, one row per feature."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    long = features.select(cells.alias("c")).select("c.feature", "c.value")
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["feature"], ["value"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return stats.join(quartiles, "feature").withColumnsRenamed(
        {"value_q25": "q25", "value_q50": "q50", "value_q75": "q75"}
    )


def tag_distribution(tags: DataFrame, tag: str) -> DataFrame:
    return tags.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))


def orders_by_product(orders: DataFrame) -> DataFrame:
    return orders.groupBy("item_id").agg(F.sum("order_qty").alias("order_qty"))


def orders_by_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def average_performance(history: DataFrame, date: str = "date") -> DataFrame:
    return history.groupBy("item_id").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in ("mape", "smape", "rmse")],
        F.count(F.lit(1)).alias("n"),
        F.max(date).alias("latest"),
    )


def inventory_analysis(inventory: DataFrame, keys: list[str] = SERIES, qty: str = "on_hand_qty") -> DataFrame:
    """Level statistics, turnover (sum of absolute changes over the mean level) and overall direction per series."""
    line = Window.partitionBy(*keys).orderBy("date")
    moves = inventory.withColumn("_move", F.abs(F.col(qty) - F.lag(qty).over(line)))
    first, last = F.min_by(qty, "date"), F.max_by(qty, "date")
    return moves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        last.alias("current_qty"),
        F.avg(qty).alias("avg_qty"),
        F.min(qty).alias("min_qty"),
        F.max(qty).alias("max_qty"),
        _ratio(F.coalesce(F.sum("_move"), F.lit(0)), F.avg(qty)).alias("turnover"),
        F.when(last > first, "increasing").when(last < first, "decreasing").otherwise("stable").alias("trend"),
    )


def abc_summary(classified: DataFrame, value: str) -> DataFrame:
    """Products and share of value per class."""
    per_class = classified.groupBy("abc_class").agg(F.count(F.lit(1)).alias("products"), F.sum(value).alias("_value"))
    whole = F.sum("_value").over(Window.partitionBy(F.lit(1)))
    return per_class.select("abc_class", "products", (F.col("_value") / whole * 100).alias("value_percent"))


def class_counts(classified: DataFrame, column: str) -> DataFrame:
    return classified.groupBy(column).agg(F.count(F.lit(1)).alias("products"))


def variant_stats(observations: DataFrame, keys: tuple[str, ...] = ("variant", "metric")) -> DataFrame:
    """Moments and extremes per (variant, metric); map-side combined, so a large variant is no hot task."""
    return observations.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_pop("value").alias("var_pop"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def variant_medians(observations: DataFrame, keys: tuple[str, ...] = ("variant", "metric")) -> DataFrame:
    return exact_quantiles(observations, list(keys), ["value"], {"median": 0.5}).withColumnRenamed(
        "value_median", "median"
    )


def status_counts(orders: DataFrame, statuses: list[str]) -> DataFrame:
    """One row: all orders and the count of each status."""
    return orders.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.lower("status") == s.lower(), 1)).alias(f"{s.lower()}_count") for s in statuses],
    )


def category_rollup(df: DataFrame, value: str = "demand_qty") -> DataFrame:
    return df.groupBy("category", "date").agg(F.sum(value).alias(value))


def lead_time_demand(df: DataFrame, lead_times: DataFrame, value: str = "demand_qty") -> DataFrame:
    """Mean and sample spread of demand, and the spread over the lead time, per item."""
    stats = df.groupBy("item_id").agg(F.avg(value).alias("mean_demand"), F.stddev_samp(value).alias("std_demand"))
    joined = stats.join(lead_times.select("item_id", "lead_time_days"), "item_id")
    return joined.withColumn("lead_time_std", F.col("std_demand") * F.sqrt("lead_time_days"))


def demand_totals(forecast: DataFrame, stock: DataFrame) -> DataFrame:
    """Horizon total, annualised mean and uncovered gap per item."""
    totals = forecast.groupBy("item_id").agg(
        F.sum("yhat").alias("horizon_demand"), (F.avg("yhat") * 365).alias("annual_demand")
    )
    gap = F.greatest(F.lit(0.0), F.col("horizon_demand") - F.coalesce("stock", F.lit(0.0)))
    return totals.join(stock, "item_id", "left").withColumn("gap", gap)
