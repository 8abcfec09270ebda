"""Projection, transfers, strategies and approval on small fixtures."""

import pytest
from pyspark.sql import functions as F

from granary.plans import orders as PO
from granary.plans import plan as PL
from granary.plans import policies as P


def test_projection_of_lost_sales(spark):
    net = [-1, -3, 0, -3, 1, 5, -2, 2, 1, -1]
    demand = spark.createDataFrame([(1, i + 1, float(-v)) for i, v in enumerate(net)], "item_id int, period int, demand double")
    items = spark.createDataFrame([(1, 0.0, 2)], "item_id int, opening double, lead_time int")
    rows = PL.project_inventory(demand, items).orderBy("period").collect()
    assert [r.inventory for r in rows] == [0, 0, 0, 0, 1, 6, 4, 6, 7, 6]
    assert [r.shortage for r in rows] == [1, 3, 0, 3, 0, 0, 0, 0, 0, 0]


def test_orders_arrive_after_the_lead_time(spark):
    demand = spark.createDataFrame([(1, p, 5.0) for p in range(1, 5)], "item_id int, period int, demand double")
    items = spark.createDataFrame([(1, 0.0, 2, 4, 1, 100)], "item_id int, opening double, lead_time int, pack_size int, min_order int, max_order int")
    orders = PL.build_orders(PL.project_inventory(demand, items), items)
    got = {r.period: (r.requirement, r.order_qty, r.late) for r in orders.collect()}
    assert got == {1: (15.0, 16.0, True), 2: (5.0, 8.0, False)}
    rows = PL.project_inventory(demand, items, orders).orderBy("period").collect()
    assert [r.arrivals for r in rows] == [0.0, 0.0, 16.0, 8.0]


def test_transfers_never_exceed_stock_or_gap(spark):
    needs = spark.createDataFrame([(1, 100.0, 30.0), (2, 10.0, 50.0)], "item_id int, demand double, stock double")
    warehouses = spark.createDataFrame(
        [(1, "a", 1, 40.0, 2.0), (1, "b", 2, -5.0, 1.0), (1, "c", 3, 50.0, None), (2, "a", 1, 9.0, 1.0)],
        "item_id int, warehouse_id string, priority int, stock double, transfer_cost double",
    )
    moved = P.allocate_transfers(needs, warehouses)
    got = {r.from_warehouse: (r.quantity, r.cost, r.stock_left) for r in moved.collect()}
    assert got == {"a": (40.0, 80.0, 0.0), "c": (30.0, 30.0, 20.0)}
    after = {r.item_id: (r.stock_after, r.remaining_gap) for r in P.after_transfers(needs, moved).collect()}
    assert after == {1: (100.0, 0.0), 2: (50.0, 0.0)}


def test_registered_strategy(spark):
    P.register_strategy("half", lambda: F.col("demand_forecast") / 2)
    try:
        df = spark.createDataFrame(
            [(1, 1.0, 5.0, 1.0, 1.0, 8.0, 0.0)],
            "item_id int, stock double, avg_daily_demand double, lead_time double, lead_time_std double, demand_forecast double, on_order double",
        )
        assert P.run_strategy(df, "half").first().suggested_order_qty == 4.0
    finally:
        P._STRATEGIES.pop("half")


def test_approval_limits(spark):
    df = spark.createDataFrame([(1, 9.99, 100.0), (2, 10.0, None), (3, 50.0, 100.0)], "order_id int, quantity double, unit_price double")
    rows = {r.order_id: (r.approval_level, r.required_approver, r.status) for r in PO.submit_for_approval(df, "manager").collect()}
    assert rows == {1: ("low", "buyer", "approved"), 2: ("medium", "manager", "approved"), 3: ("high", "admin", "pending")}


def test_decisions_are_settled_once(spark):
    records = spark.createDataFrame([(1, "manager", "pending"), (2, "admin", "approved")], "order_id int, required_approver string, status string")
    decisions = spark.createDataFrame(
        [(1, 1, "approve", "buyer", 1, None), (2, 1, "reject", "buyer", 2, "x"), (3, 1, "reject", "admin", 3, "late"),
         (4, 1, "approve", "admin", 4, None), (5, 2, "approve", "admin", 5, None), (6, 7, "approve", "admin", 6, None)],
        "decision_id int, order_id int, action string, approver_role string, decided_at int, reason string",
    )
    got = {r.decision_id: r.outcome for r in PO.apply_decisions(records, decisions).collect()}
    assert got == {1: "rejected", 2: "error", 3: "rejected", 4: "not_found", 5: "not_found", 6: "not_found"}
    after = {r.order_id: (r.status, r.decided_by, r.rejection_reason) for r in PO.after_decisions(records, decisions).collect()}
    assert after == {1: ("rejected", "admin", "late"), 2: ("approved", None, None)}


def test_discount_keeps_the_plain_quantity_when_cheaper(spark):
    tiers = F.array(F.struct(F.lit(100000.0).alias("min_qty"), F.lit(0.001).alias("rate")))
    df = spark.createDataFrame([(1, 1000.0, 100.0, 10.0, 5.0)], "item_id int, demand double, order_cost double, holding_cost double, unit_cost double").withColumn("tiers", tiers)
    row = P.discount_order_quantity(df).first()
    assert row.tier_chosen == 0 and row.optimal_qty == pytest.approx((2 * 1000 * 100 / 10) ** 0.5)
