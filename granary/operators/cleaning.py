"""Renames, type clean-up, gap filling, imputation and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.scale import exact_quantiles, one_row, with_row

DATE_COLUMNS = {
    "inventory_daily": ["date"],
    "purchase_orders": ["order_date", "due_date"],
    "forecast_output": ["horizon_date"],
    "optimal_plan": ["due_date", "plan_date"],
}


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Apply a field mapping; columns it does not name pass through."""
    return df.withColumnsRenamed(mapping)


def date_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Render the listed columns, where present, as yyyy-MM-dd text."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.date_format(F.to_date(c), "yyyy-MM-dd") for c in present})


def json_text(column: str) -> Column:
    """Keep valid JSON text and encode anything else as a JSON string."""
    encoded = F.to_json(F.array(F.col(column)))
    as_string = F.substring(encoded, F.lit(2), F.length(encoded) - 2)
    return (
        F.when(F.col(column).isNull(), F.lit("null"))
        .when(F.try_parse_json(F.col(column)).isNotNull(), F.col(column))
        .otherwise(as_string)
    )


def conform_table(df: DataFrame, table: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Bring a production table to the internal names and formats."""
    out = date_text(rename_columns(df, mapping or {}), DATE_COLUMNS.get(table, []))
    if table == "suppliers" and "price_breaks" in out.columns:
        out = out.withColumn("price_breaks", json_text("price_breaks"))
    return out


# Measures of each feed that must be numbers, and whether the feed is kept in date order.
FEEDS = {
    "sales": (["sales"], True),
    "inventory": (["inventory_level"], True),
    "product": (["cost", "price", "lead_time"], False),
    "demand": (["demand"], True),
}


def clean_feed(df: DataFrame, feed: str) -> DataFrame:
    """Typed date, numeric measures (bad text becomes null), text sku, no repeated rows, date order."""
    measures, dated = FEEDS[feed]
    if dated and "date" not in df.columns and "timestamp" in df.columns:
        df = df.withColumnRenamed("timestamp", "date")
    casts = {m: F.col(m).cast("string").try_cast("double") for m in measures if m in df.columns}
    if "date" in df.columns:
        casts["date"] = F.to_timestamp("date")
    if "sku" in df.columns:
        casts["sku"] = F.col("sku").cast("string")
    out = df.withColumns(casts).dropDuplicates()
    return out.orderBy("date") if dated and "date" in out.columns else out


def fill_calendar(df: DataFrame, keys: list[str], date: str = "date", unique: bool = False) -> DataFrame:
    """Add the missing days between a key's first and last day, with null measures.

    A key that repeats a day is left as it is. With `unique` the caller states that no key does, as after grouping
    by (keys, date): then every row unfolds into the days up to the next one, in a single shuffle by `keys`.
    """
    if unique:
        following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
        until = F.coalesce(F.date_sub(following, 1), F.col(date))
        days = F.sequence(F.col(date), F.col("_until"), F.expr("interval 1 day"))
        unfolded = df.withColumn("_until", until).select("*", F.explode(days).alias("_day"))
        measures = [c for c in df.columns if c not in (*keys, date)]
        own = F.col("_day") == F.col(date)
        return unfolded.select(
            *keys, F.col("_day").alias(date), *[F.when(own, F.col(c)).alias(c) for c in measures]
        ).select(*df.columns)
    per_day = df.groupBy(*keys, date).agg(F.count(F.lit(1)).alias("_n"))
    spans = per_day.groupBy(*keys).agg(
        F.min(date).alias("_from"), F.max(date).alias("_to"), (F.max("_n") > 1).alias("_repeats")
    )
    days = spans.where(~F.col("_repeats")).select(
        *keys, F.explode(F.sequence("_from", "_to", F.expr("interval 1 day"))).alias(date)
    )
    filled = days.join(df, [*keys, date], "left").select(*df.columns)
    repeated = df.join(spans.where("_repeats").select(*keys), keys, "left_semi")
    return filled.unionByName(repeated)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    known = with_row(df, exact_quantiles(df, [], columns, {"median": 0.5}))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_stats.{c}_median")) for c in columns}
    return known.withColumns(filled).drop("_stats")


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value; among equally frequent ones the smallest."""
    out = df
    for column in columns:
        counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("v"))
        out = out.withColumn(column, F.coalesce(F.col(column), one_row(best)["v"]))
    return out


def winsorize_iqr(df: DataFrame, column: str, width: float = 1.5) -> DataFrame:
    """Clip to the quartiles widened by `width` interquartile ranges."""
    known = with_row(df, exact_quantiles(df, [], [column], {"q1": 0.25, "q3": 0.75}))
    q1, q3 = F.col(f"_stats.{column}_q1"), F.col(f"_stats.{column}_q3")
    low, high = q1 - width * (q3 - q1), q3 + width * (q3 - q1)
    clipped = F.when(F.col(column).isNotNull(), F.greatest(low, F.least(high, F.col(column))))
    return known.withColumn(column, clipped).drop("_stats")


def impute_zero_with_calendar(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    return df.fillna(0, columns).withColumns(
        {"month": F.month(date), "quarter": F.quarter(date), "year": F.year(date)}
    )


def for_product(
    df: DataFrame, product: str | None, date: str, id_column: str = "item_id", status: str | None = None
) -> DataFrame:
    """Rows of one product (compared as text) and one status (ignoring case), in date order."""
    if product is not None:
        df = df.where(F.col(id_column).cast("string") == product)
    if status is not None:
        df = df.where(F.lower("status") == status.lower())
    return df.orderBy(date)


def series_arrays(df: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """One date-ordered value array per series; a series holds at most one entry per calendar day."""
    points = F.sort_array(F.collect_list(F.struct(F.col(date), F.col(value))))
    return df.groupBy(*keys).agg(points.alias("_points")).select(*keys, F.col(f"_points.{value}").alias("series"))


def latest_snapshot(df: DataFrame, date: str = "date") -> DataFrame:
    return df.where(F.col(date) == one_row(df.agg(F.max(date).alias("d")))["d"])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order`, as a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


