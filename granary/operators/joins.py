"""Lookups and alignments. No join carries a broadcast hint: adaptive execution broadcasts a side once its
measured size is below the session threshold and keeps a (skew-splitting) shuffle join otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.scale import one_row

TIERS = "array<array<double>>"


def join_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Left join by day, and by location where both sides carry one."""
    on = ["date"] + [c for c in ("location_id",) if c in panel.columns and c in weather.columns]
    return panel.join(weather, on, "left")


def join_competitor_prices(panel: DataFrame, prices: DataFrame, competitors: list[str]) -> DataFrame:
    """One price column per competitor, by (day, item), or by day when the feed has no item."""
    on = ["date"] + [c for c in ("item_id",) if c in panel.columns and c in prices.columns]
    wide = prices.groupBy(*on).agg(
        *[F.avg(F.when(F.col("competitor") == c, F.col("price"))).alias(f"price_{c}") for c in competitors]
    )
    return panel.join(wide, on, "left")


def join_macro(panel: DataFrame, macro: DataFrame, indicators: list[str]) -> DataFrame:
    wide = macro.groupBy("date").agg(
        *[F.avg(F.when(F.col("indicator") == i, F.col("value"))).alias(i.lower()) for i in indicators]
    )
    return panel.join(wide, "date", "left")


def fill_along(df: DataFrame, keys: list[str], columns: list[str], date: str = "date") -> DataFrame:
    """Carry the last known value forward, then the first known value back, inside each series."""
    ahead = Window.partitionBy(*keys).orderBy(date)
    past = ahead.rowsBetween(Window.unboundedPreceding, 0)
    future = ahead.rowsBetween(0, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(future))
        for c in columns
    }
    return df.withColumns(filled)


def last_supplier_lead_time(items: DataFrame, orders: DataFrame, suppliers: DataFrame, default: int = 1) -> DataFrame:
    """Lead time of the supplier of an item's latest order; `default` where there is none."""
    last = orders.groupBy("item_id").agg(
        F.max_by("supplier_id", F.struct("order_date", "po_id")).alias("supplier_id")
    )
    return (
        items.join(last, "item_id", "left")
        .join(suppliers.select("supplier_id", "lead_time_days"), "supplier_id", "left")
        .withColumn("lead_time_days", F.coalesce("lead_time_days", F.lit(default)))
    )


def price_tiers(text: str | Column) -> Column:
    """Tier array of a price-break text [[from, to or null, price], ...]."""
    return F.from_json(text, TIERS)


def assign_price_tier(orders: DataFrame, suppliers: DataFrame, default_price: str = "unit_price") -> DataFrame:
    """First tier whose quantity range holds the order; tier 0 and the item price when none does.

    A supplier's few tiers stay one array on its row, so the join is an equi-join and no row is multiplied.
    """
    tiers = suppliers.select("supplier_id", price_tiers("price_breaks").alias("_tiers"))
    numbered = F.transform(
        F.coalesce("_tiers", F.array().cast(TIERS)),
        lambda tier, i: F.struct(
            (i + 1).alias("tier"), tier[2].alias("price"), tier[0].alias("low"), F.get(tier, F.lit(1)).alias("high")
        ),
    )
    holds = lambda t: (t["low"] <= F.col("order_qty")) & (t["high"].isNull() | (F.col("order_qty") <= t["high"]))
    hit = F.get(F.filter("_numbered", holds), F.lit(0))
    return (
        orders.join(tiers, "supplier_id", "left")
        .withColumn("_numbered", numbered)
        .withColumn("_hit", hit)
        .withColumn("tier_chosen", F.coalesce(F.col("_hit.tier"), F.lit(0)))
        .withColumn("tier_price", F.coalesce(F.col("_hit.price"), F.col(default_price)))
        .drop("_tiers", "_numbered", "_hit")
    )


def align_forecasts(actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Actual and forecast of the same key side by side, with the signed error."""
    return actual.join(forecast, keys).withColumn("error", F.col("actual") - F.col("yhat"))


def with_category(df: DataFrame, mapping: DataFrame, on: str = "item_id", default: str = "unknown") -> DataFrame:
    joined = df.join(mapping.select(on, "category"), on, "left")
    return joined.withColumn("category", F.coalesce("category", F.lit(default)))


def variant_pairs(stats: DataFrame, on: list[str]) -> DataFrame:
    """Every unordered pair of variants per metric, from one aggregated row per (variant, metric)."""
    rest = [c for c in stats.columns if c not in on]
    left = stats.select(*on, *[F.col(c).alias(f"{c}_a") for c in rest])
    right = stats.select(*on, *[F.col(c).alias(f"{c}_b") for c in rest])
    return left.join(right, on).where(F.col("variant_a") < F.col("variant_b"))


def dense_grid(df: DataFrame, item: str, date: str, value: str) -> DataFrame:
    """A row for every (item, day seen anywhere), zero where the item has none.

    The days form one array bounded by the calendar; every item unfolds it, so there is no cross join.
    """
    days = one_row(df.agg(F.array_sort(F.collect_set(date)).alias("days")))["days"]
    grid = df.select(item).distinct().select(item, F.explode(days).alias(date))
    totals = df.groupBy(item, date).agg(F.sum(value).alias(value))
    return grid.join(totals, [item, date], "left").fillna(0, [value])


def mark_holidays(df: DataFrame, calendar: DataFrame, home: str, abroad: str, date: str = "date") -> DataFrame:
    """Home holiday flag and name, and a flag for the second country, from a calendar (date, country, name)."""
    marks = calendar.groupBy(date).agg(
        F.max(F.when(F.col("country") == home, F.col("name"))).alias("_home"),
        F.max(F.when(F.col("country") == abroad, F.col("name"))).alias("_abroad"),
    )
    joined = df.join(marks, date, "left")
    return joined.withColumns(
        {
            "is_holiday": F.col("_home").isNotNull().cast("int"),
            "holiday_name": F.coalesce("_home", F.lit("")),
            "is_international_holiday": F.col("_abroad").isNotNull().cast("int"),
        }
    ).drop("_home", "_abroad")


def with_class(df: DataFrame, classes: DataFrame, on: str = "item_id", default: str = "B") -> DataFrame:
    joined = df.join(classes.select(on, "abc_class"), on, "left")
    return joined.withColumn("abc_class", F.coalesce("abc_class", F.lit(default)))
