"""Lot sizing over an item's horizon: surplus of whole packs is carried on, what a period can't order moves to earlier ones.

With R the cumulative requirement and `cap` the largest order in whole packs, the cumulative orders at period t must reach
L(t) = max over s >= t of R(s) - cap * (s - t): one fold from the last period back. A fold from the first period on then
orders the packs that are missing to L, so a pack's surplus lowers the next orders and nothing is ordered before it must
be. Both folds run over one array per item, bounded by the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import pack_round_up


def requirements(projection: DataFrame, items: DataFrame, periods: int, key: str = "item_id") -> DataFrame:
    """(key, needs, late): shortages a lead time ahead, at the earliest in period 1, as one array of `periods` values."""
    short = projection.where(F.col("shortage") > 0).join(items.select(key, "lead_time"), key)
    placed = short.withColumn("_p", (F.col("period") - F.col("lead_time")).cast("int"))
    summed = placed.groupBy(key, F.greatest(F.col("_p"), F.lit(1)).alias("period")).agg(F.sum("shortage").cast("double").alias("need"), F.max(F.col("_p") < 1).alias("late"))
    listed = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("period", "need"))).alias("_m"), F.max("late").alias("late"))
    needs = F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda p: F.coalesce(F.element_at("_m", p), F.lit(0.0)))
    return listed.select(key, needs.alias("needs"), "late")


def size_lots(needs: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, period, requirement, order_qty, carried, uncovered, late, arrival_period), one row per period that needs or orders.

    `carried` is what is ordered beyond the requirement so far. `uncovered` is the requirement so far that no order up to
    this period covers: it is above zero only where all of them are as large as allowed. `items` has lead_time,
    pack_size, min_order and max_order.
    """
    rows = needs.join(items.select(key, "lead_time", "pack_size", "min_order", "max_order"), key)
    size, most = F.col("pack_size"), F.col("max_order")
    cap = F.when(size > 0, F.floor(most / size) * size).otherwise(most).cast("double")
    running = F.aggregate(
        "needs", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + x))
    )
    rows = rows.select("*", cap.alias("cap"), running.alias("so_far"))
    back = F.aggregate(
        F.reverse("so_far"), F.array().cast("array<double>"),
        lambda a, x: F.concat(F.array(F.greatest(x, F.coalesce(F.get(a, F.lit(0)) - F.col("cap"), x))), a),
    )
    rows = rows.withColumn("least", back)

    def step(s: Column, target: Column) -> Column:
        missing = target - s["ordered"]
        packs = pack_round_up(missing, F.col("pack_size"), F.col("min_order")).cast("double")
        order = F.when(missing > 1e-9, F.least(packs, F.col("cap"))).otherwise(0.0)
        return F.struct((s["ordered"] + order).alias("ordered"), F.concat(s["orders"], F.array(order)).alias("orders"), F.concat(s["sums"], F.array(s["ordered"] + order)).alias("sums"))

    none = F.array().cast("array<double>")
    folded = rows.withColumn("_f", F.aggregate("least", F.struct(F.lit(0.0).alias("ordered"), none.alias("orders"), none.alias("sums")), step))
    each = F.arrays_zip(F.col("needs").alias("requirement"), F.col("_f.orders").alias("order_qty"), F.col("so_far").alias("so_far"), F.col("_f.sums").alias("sums"))
    long = folded.select(key, "late", "lead_time", F.posexplode(each).alias("_i", "_z")).select(key, "late", "lead_time", (F.col("_i") + 1).alias("period"), "_z.*")
    return long.where((F.col("requirement") > 0) | (F.col("order_qty") > 0)).select(
        key, "period", "requirement", "order_qty", F.greatest(F.col("sums") - F.col("so_far"), F.lit(0.0)).alias("carried"),
        F.greatest(F.col("so_far") - F.col("sums"), F.lit(0.0)).alias("uncovered"), (F.col("late") & (F.col("period") == 1)).alias("late"),
        (F.col("period") + F.col("lead_time")).cast("int").alias("arrival_period"),
    )


def build_lots(projection: DataFrame, items: DataFrame, periods: int, key: str = "item_id") -> DataFrame:
    """Lot-sized orders that cover the projected shortages."""
    return size_lots(requirements(projection, items, periods, key), items, key)
