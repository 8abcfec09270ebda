"""Multi-period order plans: projection, building, audit, costing and reports.

Tables are long: one row per (item, period), periods numbered from 1. A window partition is one item's horizon.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import pack_round_up
from granary.session import cut_lineage

# Parameters an item gets when none are set.
DEFAULTS = {
    "ordering_cost": 100.0,
    "holding_cost": 10.0,
    "shortage_cost": 100.0,
    "unit_cost": 100.0,
    "max_order_quantity": 10000.0,
    "min_order_quantity": 0.0,
    "safety_stock_target": 0.1,
}


def parameters(items: DataFrame, given: DataFrame, key: str = "item_id") -> DataFrame:
    """One parameter row per item; whatever is missing or null gets its default."""
    present = [c for c in DEFAULTS if c in given.columns]
    joined = items.select(key).join(given.select(key, *present), key, "left")
    return joined.select(
        key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in present else F.lit(v).alias(c) for c, v in DEFAULTS.items()]
    )


def align_horizon(forecast: DataFrame, periods: int, key: str = "item_id", value: str = "demand") -> DataFrame:
    """Exactly `periods` rows per item: later periods fall away, missing ones count zero."""
    grid = forecast.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
    return grid.join(forecast.select(key, "period", value), [key, "period"], "left").fillna(0.0, [value])


def project_inventory(demand: DataFrame, items: DataFrame, orders: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Stock and shortage per period with lost sales, from opening stock, demand and orders arriving after lead time.

    Closed form of the recursion: with S the opening stock plus cumulative net flow and m = min(0, running minimum
    of S), the stock is S - m and the shortage is how much m falls. `items` has (key, opening, lead_time).
    """
    rows = demand.join(items.select(key, "opening", "lead_time"), key)
    if orders is None:
        rows = rows.withColumn("arrivals", F.lit(0.0))
    else:
        arriving = (
            orders.join(items.select(key, "lead_time"), key)
            .groupBy(key, (F.col("period") + F.col("lead_time")).cast("int").alias("period"))
            .agg(F.sum("order_qty").alias("arrivals"))
        )
        rows = rows.join(arriving, [key, "period"], "left").fillna(0.0, ["arrivals"])
    line = Window.partitionBy(key).orderBy("period")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("_s", F.col("opening") + F.sum(F.col("arrivals") - F.col("demand")).over(so_far))
    floored = running.withColumn("_m", F.least(F.lit(0.0), F.min("_s").over(so_far)))
    fallen = F.coalesce(F.lag("_m").over(line), F.lit(0.0)) - F.col("_m")
    return floored.select(
        key, "period", "demand", "arrivals",
        (F.col("_s") - F.col("_m")).alias("inventory"), fallen.alias("shortage"),
    )


def build_orders(projection: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Orders that cover the projected shortages: placed a lead time ahead (at the earliest in period 1, then late),
    in whole packs between the minimum and maximum. `items` has lead_time, pack_size, min_order, max_order. What the
    largest order within the maximum leaves open is `uncovered`."""
    short = projection.where(F.col("shortage") > 0).join(
        items.select(key, "lead_time", "pack_size", "min_order", "max_order"), key
    )
    placed = short.withColumn("_p", (F.col("period") - F.col("lead_time")).cast("int"))
    grouped = placed.groupBy(key, F.greatest(F.col("_p"), F.lit(1)).alias("period")).agg(
        F.sum("shortage").alias("requirement"),
        F.max(F.col("_p") < 1).alias("late"),
        *[F.first(c).alias(c) for c in ("lead_time", "pack_size", "min_order", "max_order")],
    )
    packed = pack_round_up(F.col("requirement"), F.col("pack_size"), F.col("min_order")).cast("double")
    size, most = F.col("pack_size"), F.col("max_order")
    whole = F.when(size > 0, F.floor(most / size) * size).otherwise(most).cast("double")
    ordered = F.least(packed, whole)
    return grouped.select(
        key, "period", "requirement", ordered.alias("order_qty"),
        F.greatest(F.col("requirement") - ordered, F.lit(0)).cast("double").alias("uncovered"), "late",
        (F.col("period") + F.col("lead_time")).cast("int").alias("arrival_period"),
    )


def audit(
    plan: DataFrame, limits: DataFrame, shipping_capacity: float | None = None, budget: float | None = None,
    key: str = "item_id",
) -> DataFrame:
    """Violations (rule, item, period, actual, allowed) of a plan (key, period, demand, order_qty, inventory).

    `limits` has min_order, max_order, max_inventory, safety_stock_target, min_turnover, ordering_cost,
    shipping_cost and fixed_order_cost per item. The budget is spent on ordering, shipping and fixed costs. Rules on rows
    come from one pass over the plan, those on items and periods from one grouped pass.
    """
    rows = cut_lineage(plan.join(limits, key))  # the plan is worked out once, whatever the number of rules
    ordered = F.col("order_qty") > 0
    floor = F.col("safety_stock_target") * F.col("demand")

    def broken(rule: str, when: Column, actual: Column, allowed: Column) -> Column:
        return F.when(when, F.struct(F.lit(rule).alias("rule"), actual.cast("double").alias("actual"), allowed.cast("double").alias("allowed")))

    order, stock = F.col("order_qty"), F.col("inventory")
    of_row = F.array(
        broken("max_order", order > F.col("max_order"), order, F.col("max_order")),
        broken("min_order", ordered & (order < F.col("min_order")), order, F.col("min_order")),
        broken("max_inventory", stock > F.col("max_inventory"), stock, F.col("max_inventory")),
        broken("safety_stock", stock < floor, stock, floor),
    )
    single = rows.select(key, "period", F.inline(F.filter(of_row, lambda r: r.isNotNull())))
    spent = F.sum((F.col("ordering_cost") + F.col("shipping_cost")) * order + F.when(ordered, F.col("fixed_order_cost")).otherwise(0.0))
    sums = rows.groupingSets([[key], ["period"]], key, "period").agg(
        F.grouping("period").alias("of_item"), F.sum("demand").alias("sold"), F.avg("inventory").alias("held"), F.max("min_turnover").alias("turnover"),
        F.sum("order_qty").alias("shipped"), spent.alias("spent"),
    )
    item, period = F.col("of_item") == 1, F.col("of_item") == 0
    of_sum = [broken("inventory_turnover", item & (F.col("sold") < F.col("turnover") * F.col("held")), F.col("sold") / F.col("held"), F.col("turnover"))]
    for rule, column, allowed in (("shipping_capacity", "shipped", shipping_capacity), ("budget", "spent", budget)):
        if allowed is not None:
            of_sum.append(broken(rule, period & (F.col(column) > allowed), F.col(column), F.lit(float(allowed))))
    summed = sums.select(key, "period", F.inline(F.filter(F.array(*of_sum), lambda r: r.isNotNull())))
    columns = ["rule", key, "period", "actual", "allowed"]
    return single.select(columns).unionByName(summed.select(columns))


COSTS = ("ordering_cost", "holding_cost", "shortage_cost", "shipping_cost", "storage_cost", "transfer_cost")


def plan_costs(plan: DataFrame, costs: DataFrame, transfers: DataFrame | None = None, key: str = "item_id") -> DataFrame:
    """Cost terms per item. `costs` has ordering, fixed_order, holding, shortage, shipping and storage cost."""
    rows = plan.join(costs, key)
    ordered = F.when(F.col("order_qty") > 0, F.col("fixed_order_cost")).otherwise(0.0)
    per_item = rows.groupBy(key).agg(
        F.sum(F.col("ordering_cost") * F.col("order_qty") + ordered).alias("ordering_cost"),
        F.sum(F.col("holding_cost") * F.col("inventory")).alias("holding_cost"),
        F.sum(F.col("shortage_cost") * F.col("shortage")).alias("shortage_cost"),
        F.sum(F.col("shipping_cost") * F.col("order_qty")).alias("shipping_cost"),
        F.sum(F.col("storage_cost") * F.col("inventory")).alias("storage_cost"),
    )
    if transfers is None:
        return per_item.withColumn("transfer_cost", F.lit(0.0))
    moved = transfers.groupBy(key).agg(F.sum("cost").alias("transfer_cost"))
    return per_item.join(moved, key, "left").fillna(0.0, ["transfer_cost"])


def cost_summary(costs: DataFrame, key: str = "item_id") -> DataFrame:
    """Totals per cost term with their share of the whole and the average per product."""
    row = costs.agg(F.count(F.lit(1)).alias("products"), *[F.sum(c).alias(c) for c in COSTS])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in COSTS])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("amount")) for c in COSTS]))
    long = row.withColumn("total", total).select("products", "total", cells.alias("c"))
    share = F.when(F.col("total") > 0, F.col("c.amount") / F.col("total") * 100).otherwise(0.0)
    return long.select(
        "c.term", "c.amount", share.alias("percent"), F.col("total").alias("total_cost"),
        F.when(F.col("products") > 0, F.col("total") / F.col("products")).alias("average_per_product"),
    )


def plan_details(plan: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Plan rows with price tier (the last whose minimum the order reaches, from 1; 0 for none) and arrival period.

    `items` has lead_time and `tiers`, an array of (min_qty, rate) kept on the item's row.
    """
    joined = plan.join(items.select(key, "lead_time", "tiers"), key)
    reached = F.filter(F.array_sort("tiers"), lambda t: F.col("order_qty") >= t["min_qty"])
    return joined.select(
        key, "period", F.col("order_qty").alias("optimal_order_qty"),
        F.coalesce(F.size(reached), F.lit(0)).alias("price_tier"),
        (F.col("period") + F.col("lead_time")).cast("int").alias("expected_arrival"),
        "inventory", "shortage", (F.col("order_qty") > 0).cast("int").alias("order_decision"),
    )


def current_orders(plan: DataFrame, period: int, key: str = "item_id") -> DataFrame:
    return plan.where((F.col("period") == period) & (F.col("order_qty") > 0.01)).select(
        key, F.col("order_qty").alias("order_quantity"), F.col("period").alias("order_period"),
        F.lit("pending").alias("status"),
    )


def decision_rules(plan: DataFrame, key: str = "item_id") -> DataFrame:
    """The plan's largest order, lowest stock and (when positive) largest shortage as three readable rules.

    Ties go to the lowest (item, period).
    """
    place = lambda sign, c: F.struct((sign * F.col(c)).alias("v"), F.col(key).alias("i"), F.col("period").alias("p"))
    row = plan.agg(
        F.min(place(-1, "order_qty")).alias("order"),
        F.min(place(1, "inventory")).alias("stock"),
        F.min(place(-1, "shortage")).alias("short"),
    )

    def rule(number: int, source: str, priority: str, value: Column, text: str, confidence: float, support: float) -> Column:
        return F.struct(
            F.lit(number).alias("rule_id"), F.lit(priority).alias("priority"), F.col(f"{source}.i").alias(key),
            F.col(f"{source}.p").alias("period"), value.alias("amount"),
            F.concat(
                F.lit(f"{text} of item "), F.col(f"{source}.i").cast("string"), F.lit(" in period "),
                F.col(f"{source}.p").cast("string"),
            ).alias("condition"),
            F.lit(confidence).alias("confidence"), F.lit(support).alias("support"),
        )

    rules = F.array(
        rule(1, "order", "high", -F.col("order.v"), "largest order", 0.95, 0.8),
        rule(2, "stock", "medium", F.col("stock.v"), "lowest stock", 0.85, 0.7),
        rule(3, "short", "critical", -F.col("short.v"), "largest shortage", 0.98, 0.9),
    )
    return row.select(F.inline(rules)).where((F.col("rule_id") != 3) | (F.col("amount") > 0))
