"""Replenishment policies, transfers between warehouses, and discount-aware order quantities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import eoq, reorder_point, safety_stock, service_z, total_cost

ORDERING_COST = 100.0
HOLDING_COST = 10.0

Strategy = Callable[[], Column]


def _cents(value: Column) -> Column:
    """Two places, halves up; a half is judged at six places, so noise of sums in binary does not decide it."""
    return F.round(value.cast("decimal(38,6)"), 2).cast("double")


def reorder_point_policy(
    df: DataFrame, level: float = 0.95, ordering_cost: float = ORDERING_COST, holding_cost: float = HOLDING_COST
) -> DataFrame:
    """Order the economic quantity when stock is at or below the reorder point.

    Needs stock, avg_daily_demand, lead_time and lead_time_std (deviation of demand over the lead time).
    """
    buffer = safety_stock(service_z(F.lit(level)), F.col("lead_time_std"))
    point = _cents(reorder_point(F.col("avg_daily_demand"), F.col("lead_time"), F.col("safety_stock")))
    quantity = eoq(F.col("avg_daily_demand") * 365, F.lit(ordering_cost), F.lit(holding_cost), "infinite")
    return (
        df.withColumn("safety_stock", buffer)
        .withColumn("reorder_point", point)
        .withColumn("need_replenishment", F.col("stock") <= F.col("reorder_point"))
        .withColumn("suggested_order_qty", F.when(F.col("need_replenishment"), _cents(quantity)).otherwise(0.0))
    )


def order_up_to_policy(df: DataFrame) -> DataFrame:
    """Order up to forecast plus safety stock. Needs stock, on_order, demand_forecast and safety_stock."""
    target = F.col("demand_forecast") + F.col("safety_stock")
    available = F.col("stock") + F.col("on_order")
    quantity = F.greatest(F.lit(0.0), target - available)
    return df.withColumns(
        {
            "order_up_to_level": _cents(target),
            "available_inventory": _cents(available),
            "suggested_order_qty": _cents(quantity),
            "need_replenishment": quantity > 0,
        }
    )


def _rop_quantity() -> Column:
    buffer = safety_stock(service_z(F.lit(0.95)), F.col("lead_time_std"))
    point = _cents(reorder_point(F.col("avg_daily_demand"), F.col("lead_time"), buffer))
    quantity = eoq(F.col("avg_daily_demand") * 365, F.lit(ORDERING_COST), F.lit(HOLDING_COST), "infinite")
    return F.when(F.col("stock") <= point, quantity).otherwise(0.0)


def _order_up_to_quantity() -> Column:
    buffer = safety_stock(service_z(F.lit(0.95)), F.col("lead_time_std"))
    return F.greatest(F.lit(0.0), F.col("demand_forecast") + buffer - F.col("stock") - F.col("on_order"))


_STRATEGIES: dict[str, Strategy] = {
    "rop": _rop_quantity,
    "order_up_to": _order_up_to_quantity,
    "hybrid": lambda: F.greatest(_rop_quantity(), _order_up_to_quantity()),
}


def register_strategy(name: str, quantity: Strategy) -> None:
    """Make a strategy available by name; it returns the order quantity as an expression over the policy inputs."""
    _STRATEGIES[name] = quantity


def run_strategy(df: DataFrame, strategy: str | Column = "hybrid") -> DataFrame:
    """Suggested quantity by one strategy, or by a strategy name per row; an unknown name acts as hybrid."""
    if isinstance(strategy, str):
        quantity = _STRATEGIES.get(strategy, _STRATEGIES["hybrid"])()
    else:
        quantity = _STRATEGIES["hybrid"]()
        for name, build in _STRATEGIES.items():
            quantity = F.when(strategy == name, build()).otherwise(quantity)
    return df.withColumn("suggested_order_qty", quantity).withColumn(
        "need_replenishment", F.col("suggested_order_qty") > 0
    )


def strategy_parameters(items: DataFrame, parameters: DataFrame, key: str = "item_id") -> DataFrame:
    """Strategy and safety stock per item; EOQ without safety stock where none is set."""
    joined = items.select(key).join(parameters.select(key, "strategy_type", "safety_stock"), key, "left")
    return joined.withColumns(
        {
            "strategy_type": F.coalesce("strategy_type", F.lit("EOQ")),
            "safety_stock": F.coalesce("safety_stock", F.lit(0.0)),
        }
    )


def allocate_transfers(
    needs: DataFrame, warehouses: DataFrame, key: str = "item_id", default_cost: float = 1.0
) -> DataFrame:
    """Transfers that cover each item's gap (demand minus stock) from the warehouses in order of priority.

    What earlier warehouses can give is a running sum, so the greedy walk is one window per item over its
    warehouses. `warehouses` has (key, warehouse_id, priority, stock, transfer_cost).
    """
    gaps = needs.select(key, F.greatest(F.lit(0.0), F.col("demand") - F.col("stock")).alias("gap"))
    before = Window.partitionBy(key).orderBy("priority", "warehouse_id").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.greatest(F.col("stock"), F.lit(0.0))
    stocked = warehouses.withColumn("_before", F.coalesce(F.sum(usable).over(before), F.lit(0.0)))
    taken = F.greatest(F.lit(0.0), F.least(usable, F.col("gap") - F.col("_before")))
    cost = F.coalesce(F.col("transfer_cost"), F.lit(default_cost))
    return (
        stocked.join(gaps.where(F.col("gap") > 0), key)
        .withColumn("quantity", taken)
        .where(F.col("quantity") > 0)
        .select(
            key, F.col("warehouse_id").alias("from_warehouse"), "quantity", (F.col("quantity") * cost).alias("cost"),
            (F.col("stock") - F.col("quantity")).alias("stock_left"),
        )
    )


def after_transfers(needs: DataFrame, transfers: DataFrame, key: str = "item_id") -> DataFrame:
    """Stock after the transfers, what is still missing, and what the transfers cost, per item."""
    received = transfers.groupBy(key).agg(F.sum("quantity").alias("received"), F.sum("cost").alias("transfer_cost"))
    joined = needs.join(received, key, "left").fillna(0.0, ["received", "transfer_cost"])
    return joined.withColumn("stock_after", F.col("stock") + F.col("received")).withColumn(
        "remaining_gap", F.greatest(F.lit(0.0), F.col("demand") - F.col("stock_after"))
    )


def discount_order_quantity(df: DataFrame, variant: str = "re_eoq") -> DataFrame:
    """Cheapest order quantity under quantity discounts, with its cost and tier (0 = no discount).

    Needs demand, order_cost, holding_cost, unit_cost and `tiers`, an array of (min_qty, rate). With `re_eoq` the
    undiscounted quantity competes and each tier recomputes it with a discounted holding cost; with
    `holding_fraction` the holding cost is a share of the discounted price and a tier offers the larger of the
    economic quantity and its minimum. Tiers are compared inside the row; equal costs keep the earlier one.
    """
    demand, order_cost = F.col("demand"), F.col("order_cost")
    holding, unit = F.col("holding_cost"), F.col("unit_cost")
    base = eoq(demand, order_cost, holding, "infinite")
    ordered = F.array_sort(F.col("tiers"))

    def candidate(tier: Column, position: Column) -> Column:
        price = unit * (1 - tier["rate"])
        if variant == "re_eoq":
            kept = holding * (1 - tier["rate"])
            inside = eoq(demand, order_cost, kept, "infinite")
            quantity = F.when(F.col("_base") >= tier["min_qty"], inside).otherwise(tier["min_qty"])
        else:
            kept = price * holding
            quantity = F.greatest(F.col("_base"), tier["min_qty"])
        return F.struct(
            total_cost(quantity, demand, order_cost, kept, price).alias("cost"),
            (position + 1).alias("tier"),
            quantity.alias("quantity"),
        )

    with_base = df.withColumn("_base", base)
    offers = F.transform(ordered, candidate)
    if variant == "re_eoq":
        plain = F.struct(
            total_cost(F.col("_base"), demand, order_cost, holding, unit).alias("cost"),
            F.lit(0).alias("tier"),
            F.col("_base").alias("quantity"),
        )
        offers = F.concat(F.array(plain), offers)
    best = with_base.withColumn("_best", F.array_min(offers))
    return best.select(
        *df.columns,
        F.coalesce("_best.quantity", "_base").alias("optimal_qty"),
        F.col("_best.cost").alias("optimal_cost"),
        F.coalesce("_best.tier", F.lit(0)).alias("tier_chosen"),
    )
