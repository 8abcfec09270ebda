"""Policy, order and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.catalog import query
from granary.catalog.aggregates import rounded
from granary.plans import lots as LO
from granary.plans import orders as PO
from granary.plans import plan as PL
from granary.plans import policies as P


def _inputs(t):
    """Policy inputs with the demand spread over the lead time and a lead-time forecast."""
    return t.policy_inputs.select(
        "item_id", "stock", "on_order", "avg_daily_demand", "lead_time", "unit_price",
        (F.col("demand_std") * F.sqrt("lead_time")).alias("lead_time_std"),
        (F.col("avg_daily_demand") * (F.col("lead_time") + 1)).alias("demand_forecast"),
    )


def _cents(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38, 6)), 2) AS DOUBLE)"


_POLICY = f"""pol AS (SELECT *, round(1.65::DOUBLE * lead_time_std, 2) AS ss,
        {_cents("avg_daily_demand * lead_time + round(1.65::DOUBLE * lead_time_std, 2)")} AS rop,
        sqrt(2 * (avg_daily_demand * 365) * 100 / 10) AS eoq
    FROM (SELECT item_id, stock, on_order, avg_daily_demand, lead_time, unit_price,
                 demand_std * sqrt(lead_time) AS lead_time_std,
                 avg_daily_demand * (lead_time + 1) AS demand_forecast
          FROM policy_inputs))"""


@query(
    "r1_reorder_point_policy",
    f"""WITH {_POLICY} SELECT item_id, stock, ss AS safety_stock, rop AS reorder_point, stock <= rop AS need_replenishment,
               CASE WHEN stock <= rop THEN {_cents("eoq")} ELSE 0 END AS suggested_order_qty FROM pol""",
    ("policy_inputs",),
)
def r1(t):
    out = P.reorder_point_policy(_inputs(t))
    return out.select("item_id", "stock", "safety_stock", "reorder_point", "need_replenishment", "suggested_order_qty")


@query(
    "r2_order_up_to_policy",
    f"""WITH {_POLICY} SELECT item_id, {_cents("demand_forecast + ss")} AS order_up_to_level,
               {_cents("stock + on_order")} AS available_inventory,
               {_cents("greatest(0, demand_forecast + ss - (stock + on_order))")} AS suggested_order_qty,
               greatest(0, demand_forecast + ss - (stock + on_order)) > 0 AS need_replenishment FROM pol""",
    ("policy_inputs",),
)
def r2(t):
    inputs = P.reorder_point_policy(_inputs(t)).drop("suggested_order_qty", "need_replenishment", "reorder_point")
    out = P.order_up_to_policy(inputs)
    return out.select("item_id", "order_up_to_level", "available_inventory", "suggested_order_qty", "need_replenishment")


def _strategy_name():
    return F.get(F.array(F.lit("rop"), F.lit("order_up_to"), F.lit("hybrid")), (F.col("item_id") % 3).cast("int"))


_SUGGESTED = f"""{_POLICY}, sug AS (SELECT item_id, strategy, unit_price, CASE strategy WHEN 'rop' THEN q1
        WHEN 'order_up_to' THEN q2 ELSE greatest(q1, q2) END AS qty
    FROM (SELECT *, ['rop', 'order_up_to', 'hybrid'][item_id % 3 + 1] AS strategy,
                 CASE WHEN stock <= rop THEN eoq ELSE 0 END AS q1,
                 greatest(0, demand_forecast + ss - stock - on_order) AS q2 FROM pol))"""


@query(
    "r3_run_strategy",
    f"""WITH {_SUGGESTED} SELECT item_id, strategy, round(qty, 6) AS suggested_order_qty, qty > 0 AS need_replenishment
        FROM sug""",
    ("policy_inputs",),
)
def r3(t):
    out = P.run_strategy(_inputs(t).withColumn("strategy", _strategy_name()), F.col("strategy"))
    return rounded(out.select("item_id", "strategy", "suggested_order_qty", "need_replenishment"), ["suggested_order_qty"], 6)


@query(
    "r4_strategy_parameters",
    """SELECT item_id, coalesce(strategy_type, 'EOQ') AS strategy_type, coalesce(safety_stock, 0) AS safety_stock
       FROM items LEFT JOIN (SELECT item_id, 'ROP' AS strategy_type, CAST(pack_size AS DOUBLE) AS safety_stock
                             FROM items WHERE abc_class = 'A') USING (item_id)""",
    ("items",),
)
def r4(t):
    given = t.items.where("abc_class = 'A'").select(
        "item_id", F.lit("ROP").alias("strategy_type"), F.col("pack_size").cast("double").alias("safety_stock")
    )
    return P.strategy_parameters(t.items, given)


def _suggestions(t):
    out = P.run_strategy(_inputs(t).withColumn("strategy", _strategy_name()), F.col("strategy"))
    return out.withColumn("suggested_order_qty", F.round("suggested_order_qty")).withColumn("reason", F.lit("auto"))


_RECORDS = f"""{_SUGGESTED}, rec AS (SELECT *, quantity * unit_price AS amount,
        CASE WHEN quantity * unit_price < 1000 THEN 'low' WHEN quantity * unit_price < 5000 THEN 'medium' ELSE 'high' END
            AS approval_level,
        CASE WHEN quantity * unit_price < 1000 THEN 'buyer' WHEN quantity * unit_price < 5000 THEN 'manager' ELSE 'admin' END
            AS required_approver,
        CASE WHEN quantity * unit_price < 5000 THEN 'approved' ELSE 'pending' END AS status
    FROM (SELECT row_number() OVER (ORDER BY item_id) AS order_id, item_id, round(qty, 0) AS quantity, unit_price
          FROM sug WHERE qty > 0 AND round(qty, 0) > 0))"""


@query(
    "r5_auto_replenishment",
    f"""WITH {_RECORDS} SELECT status, approval_level, count(*) AS orders, sum(quantity) AS quantity,
               round(sum(amount), 4) AS amount FROM rec GROUP BY ALL""",
    ("policy_inputs",),
)
def r5(t):
    return rounded(PO.replenishment_totals(PO.auto_replenishment(_suggestions(t), "manager")), ["amount"])


@query(
    "r6_submit_for_approval",
    f"""WITH {_RECORDS} SELECT order_id, item_id, quantity, round(amount, 4) AS order_amount, approval_level,
               required_approver, 'manager' AS requester_role, status FROM rec""",
    ("policy_inputs",),
)
def r6(t):
    records = PO.auto_replenishment(_suggestions(t), "manager")
    return rounded(
        records.select(
            "order_id", "item_id", "quantity", "order_amount", "approval_level", "required_approver", "requester_role", "status"
        ),
        ["order_amount"],
    )


def _approval_records(t):
    """Every purchase order as a record submitted by a buyer."""
    lines = t.purchase_orders.select(F.col("po_id").alias("order_id"), F.col("order_qty").alias("quantity"), "unit_price")
    return PO.submit_for_approval(lines, "buyer")


def _decisions(t):
    """Two or three decisions per order line, by roles and times that depend on the line; some orders do not exist."""
    roles = F.array(*[F.lit(r) for r in ("buyer", "manager", "admin")])
    line = t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("at"), F.min("l_suppkey").alias("s")
    )
    base = line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), "at", "s",
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"),
    )
    return base.select(
        (F.col("k") * 2 + F.col("i")).alias("decision_id"),
        F.when(F.col("s") % 10 == 9, -F.col("k")).otherwise(F.col("k")).alias("order_id"),
        F.when((F.col("s") + F.col("i")) % 3 == 0, "reject").otherwise("approve").alias("action"),
        F.get(roles, ((F.col("s") + 2 * F.col("i")) % 3).cast("int")).alias("approver_role"),
        F.date_add(F.to_date("at"), F.col("i")).alias("decided_at"),
        F.lit("price too high").alias("reason"),
    )


_DECIDED = """
    rec AS (SELECT po_id AS order_id, CASE WHEN order_qty * unit_price < 1000 THEN 'approved' ELSE 'pending' END AS status,
                   CASE WHEN order_qty * unit_price < 1000 THEN 'buyer' WHEN order_qty * unit_price < 5000 THEN 'manager'
                        ELSE 'admin' END AS required_approver
            FROM purchase_orders),
    dec AS (SELECT k * 2 + i AS decision_id, CASE WHEN s % 10 = 9 THEN -k ELSE k END AS order_id,
                   CASE WHEN (s + i) % 3 = 0 THEN 'reject' ELSE 'approve' END AS action,
                   ['buyer', 'manager', 'admin'][(s + 2 * i) % 3 + 1] AS approver_role,
                   CAST(CAST(shipped AS DATE) + CAST(i AS INTEGER) AS DATE) AS decided_at
            FROM (SELECT l_orderkey * 8 + l_linenumber AS k, min(l_shipdate) AS shipped, min(l_suppkey) AS s
                  FROM lineitem GROUP BY l_orderkey, l_linenumber), (SELECT unnest([0, 1]) AS i)),
    rk AS (SELECT * FROM (VALUES ('buyer', 1), ('manager', 2), ('admin', 3)) r(role, rank)),
    mk AS (SELECT dec.*, p.required_approver AS need, a.rank >= b.rank AS ok
           FROM dec LEFT JOIN (SELECT * FROM rec WHERE status = 'pending') p USING (order_id)
           LEFT JOIN rk a ON a.role = approver_role LEFT JOIN rk b ON b.role = p.required_approver),
    fs AS (SELECT order_id, arg_min(decision_id, (decided_at, decision_id)) AS first_id,
                  min((decided_at, decision_id)) AS first_at FROM mk WHERE ok GROUP BY ALL),
    oc AS (SELECT mk.*, CASE WHEN need IS NULL OR first_at < (decided_at, decision_id) THEN 'not_found'
                  WHEN ok THEN CASE action WHEN 'approve' THEN 'approved' ELSE 'rejected' END
                  WHEN action = 'approve' THEN 'rejected' ELSE 'error' END AS outcome,
                  coalesce(decision_id = first_id, false) AS applied
           FROM mk LEFT JOIN fs USING (order_id))"""


@query(
    "r7_apply_decisions",
    f"WITH {_DECIDED} SELECT decision_id, order_id, action, approver_role, decided_at, outcome, applied FROM oc",
    ("purchase_orders",),
)
def r7(t):
    outcomes = PO.apply_decisions(_approval_records(t), _decisions(t)).drop("reason")
    return outcomes.withColumn("applied", F.coalesce("applied", F.lit(False)))


@query(
    "r7_after_decisions",
    f"""WITH {_DECIDED} SELECT rec.order_id, required_approver, coalesce(outcome, rec.status) AS status,
               approver_role AS decided_by, CASE WHEN action = 'reject' THEN 'price too high' END AS rejection_reason
        FROM rec LEFT JOIN (SELECT * FROM oc WHERE applied) d ON rec.order_id = d.order_id""",
    ("purchase_orders",),
)
def r7_after(t):
    records = PO.after_decisions(_approval_records(t), _decisions(t))
    return records.select("order_id", "required_approver", "status", "decided_by", "rejection_reason")


@query(
    "r8_orders_by_status",
    "SELECT po_id, item_id, order_qty, status FROM purchase_orders WHERE status = 'P'",
    ("purchase_orders",),
)
def r8(t):
    return PO.with_status(t.purchase_orders, "P").select("po_id", "item_id", "order_qty", "status")


@query(
    "r8_select_for_sync",
    """SELECT po_id, item_id, order_qty, status FROM purchase_orders
       WHERE po_id IN (SELECT o_orderkey * 8 + 1 FROM orders WHERE o_orderpriority = '1-URGENT')""",
    ("purchase_orders",),
)
def r8_sync(t):
    ids = t.table("orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") * 8 + 1).alias("po_id"))
    return PO.select_for_sync(t.purchase_orders, ids, "po_id").select("po_id", "item_id", "order_qty", "status")


def _needs(t):
    return t.policy_inputs.select(
        "item_id", (F.col("avg_daily_demand") * 30).alias("demand"), F.col("stock")
    )


def _warehouses(t):
    """Per item and region: half of what the region shipped of the item, at the region's cost."""
    shipped = t.part_daily.groupBy("item_id", "location_id").agg(F.sum("demand_qty").alias("q"))
    return shipped.join(t.locations, "location_id").select(
        "item_id", F.col("location_id").alias("warehouse_id"), F.col("capacity_limit").alias("priority"),
        (F.col("q") / 2).alias("stock"),
        F.when(F.col("region") != "ASIA", F.col("transfer_cost_per_unit")).alias("transfer_cost"),
    )


_TRANSFERS = """
    nd AS (SELECT item_id, avg_daily_demand * 30 AS demand, stock, greatest(0, avg_daily_demand * 30 - stock) AS gap
           FROM policy_inputs),
    wh AS (SELECT item_id, location_id AS warehouse_id, capacity_limit AS priority, sum(demand_qty) / 2 AS stock,
                  CASE WHEN region <> 'ASIA' THEN transfer_cost_per_unit END AS cost
           FROM part_daily JOIN locations USING (location_id)
           GROUP BY item_id, location_id, capacity_limit, region, transfer_cost_per_unit),
    wb AS (SELECT *, coalesce(sum(stock) OVER (PARTITION BY item_id ORDER BY priority, warehouse_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM wh),
    tr AS (SELECT item_id, warehouse_id AS from_warehouse, greatest(0, least(wb.stock, gap - before)) AS quantity,
                  greatest(0, least(wb.stock, gap - before)) * coalesce(cost, 1) AS cost,
                  wb.stock - greatest(0, least(wb.stock, gap - before)) AS stock_left
           FROM wb JOIN nd USING (item_id) WHERE least(wb.stock, gap - before) > 0)"""


@query(
    "r9_allocate_transfers",
    f"""WITH {_TRANSFERS} SELECT item_id, from_warehouse, round(quantity, 5) AS quantity, round(cost, 5) AS cost,
               round(stock_left, 5) + 0.0 AS stock_left FROM tr""",
    ("policy_inputs", "part_daily", "locations"),
)
def r9(t):
    return rounded(P.allocate_transfers(_needs(t), _warehouses(t)), ["quantity", "cost", "stock_left"], 5)


@query(
    "r9_after_transfers",
    f"""WITH {_TRANSFERS} SELECT item_id, round(demand, 5) AS demand, stock, round(coalesce(q, 0), 5) AS received,
               round(coalesce(c, 0), 5) AS transfer_cost, round(stock + coalesce(q, 0), 5) AS stock_after,
               round(greatest(0, demand - (stock + coalesce(q, 0))), 5) + 0.0 AS remaining_gap
        FROM nd LEFT JOIN (SELECT item_id, sum(quantity) AS q, sum(cost) AS c FROM tr GROUP BY ALL) USING (item_id)""",
    ("policy_inputs", "part_daily", "locations"),
)
def r9_after(t):
    out = P.after_transfers(_needs(t), P.allocate_transfers(_needs(t), _warehouses(t)))
    return rounded(out, ["demand", "received", "transfer_cost", "stock_after", "remaining_gap"], 5)


def _discounts(t, holding: float):
    tiers = F.array(
        *[
            F.struct((F.lit(low) + F.col("item_id") % 50).cast("double").alias("min_qty"), F.lit(rate).alias("rate"))
            for low, rate in ((300, 0.05), (0, 0.01), (900, 0.1))
        ]
    )
    return t.policy_inputs.select(
        "item_id", (F.col("avg_daily_demand") * 365).alias("demand"), F.lit(100.0).alias("order_cost"),
        F.lit(holding).alias("holding_cost"), F.col("unit_price").cast("double").alias("unit_cost"), tiers.alias("tiers"),
    )


_TIERS = """di AS (SELECT item_id, avg_daily_demand * 365 AS d, CAST(unit_price AS DOUBLE) AS c FROM policy_inputs),
    ti AS (SELECT item_id, d, c, lo + item_id % 50 AS m, r, rank() OVER (PARTITION BY item_id ORDER BY lo) AS tier
           FROM di, (VALUES (300, 0.05::DOUBLE), (0, 0.01::DOUBLE), (900, 0.1::DOUBLE)) v(lo, r))"""


@query(
    "r10_discount_re_eoq",
    f"""WITH {_TIERS},
        cd AS (SELECT item_id, 0 AS tier, d, c, 10::DOUBLE AS h, sqrt(2 * d * 100 / 10) AS q FROM di
               UNION ALL SELECT item_id, tier, d, c * (1 - r), 10 * (1 - r),
                   CASE WHEN sqrt(2 * d * 100 / 10) >= m THEN sqrt(2 * d * 100 / (10 * (1 - r))) ELSE m END FROM ti),
        cc AS (SELECT *, d / q * 100 + q / 2 * h + d * c AS cost FROM cd)
        SELECT item_id, round(q, 5) AS optimal_qty, round(cost, 3) AS optimal_cost, CAST(tier AS INTEGER) AS tier_chosen
        FROM cc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cost, tier) = 1""",
    ("policy_inputs",),
)
def r10(t):
    out = P.discount_order_quantity(_discounts(t, 10.0), "re_eoq").select(
        "item_id", "optimal_qty", "optimal_cost", "tier_chosen"
    )
    return rounded(rounded(out, ["optimal_qty"], 5), ["optimal_cost"], 3)


@query(
    "r10_discount_holding_fraction",
    f"""WITH {_TIERS},
        cd AS (SELECT item_id, tier, d, c * (1 - r) AS c, c * (1 - r) * 0.2::DOUBLE AS h,
                      greatest(sqrt(2 * d * 100 / 0.2::DOUBLE), m) AS q FROM ti),
        cc AS (SELECT *, d / q * 100 + q / 2 * h + d * c AS cost FROM cd)
        SELECT item_id, round(q, 5) AS optimal_qty, round(cost, 3) AS optimal_cost, CAST(tier AS INTEGER) AS tier_chosen
        FROM cc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY cost, tier) = 1""",
    ("policy_inputs",),
)
def r10_fraction(t):
    out = P.discount_order_quantity(_discounts(t, 0.2), "holding_fraction").select(
        "item_id", "optimal_qty", "optimal_cost", "tier_chosen"
    )
    return rounded(rounded(out, ["optimal_qty"], 5), ["optimal_cost"], 3)


PERIODS = 12


def plan_demand(t):
    """Demand per (part, calendar month), twelve periods."""
    monthly = t.table("lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.month("l_shipdate").alias("period")).agg(
        F.sum("l_quantity").alias("demand")
    )
    return PL.align_horizon(monthly, PERIODS)


def plan_items(t):
    tiers = F.array(
        *[F.struct(F.lit(float(low)).alias("min_qty"), F.lit(rate).alias("rate")) for low, rate in ((20, 0.02), (60, 0.05))]
    )
    return t.items.select(
        "item_id", (F.col("item_id") % 23 * 10).cast("double").alias("opening"),
        (F.col("item_id") % 4).cast("int").alias("lead_time"), "pack_size",
        (F.col("min_order_qty") / 10).alias("min_order"), F.lit(120).alias("max_order"), tiers.alias("tiers"),
        F.lit(200.0).alias("max_inventory"), F.lit(0.1).alias("safety_stock_target"), F.lit(2.0).alias("min_turnover"),
        (F.col("unit_price") / 10).alias("ordering_cost"), F.lit(1.5).alias("shipping_cost"),
        F.lit(20.0).alias("fixed_order_cost"), F.lit(0.5).alias("holding_cost"), F.lit(9.0).alias("shortage_cost"),
        F.lit(0.25).alias("storage_cost"),
    )


def full_plan(t):
    """Projection without orders, the orders that cover it, and the projection with them."""
    demand, items = plan_demand(t), plan_items(t)
    orders = PL.build_orders(PL.project_inventory(demand, items), items)
    projected = PL.project_inventory(demand, items, orders)
    return projected.join(orders.select("item_id", "period", "order_qty"), ["item_id", "period"], "left").fillna(
        0.0, ["order_qty"]
    )


_PLAN_BASE = f"""
    it AS (SELECT item_id, CAST(item_id % 23 * 10 AS DOUBLE) AS opening, CAST(item_id % 4 AS INTEGER) AS lead_time, pack_size,
                  min_order_qty / 10 AS min_order, unit_price / 10 AS oc FROM items),
    dm AS (SELECT g.item_id, g.period, coalesce(q, 0) AS demand
           FROM (SELECT DISTINCT l_partkey AS item_id, p.period FROM lineitem, (SELECT unnest(range(1, {PERIODS + 1})) AS period) p) g
           LEFT JOIN (SELECT l_partkey AS item_id, month(l_shipdate) AS period, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)
             USING (item_id, period))"""


def _projection_sql(name: str, arrivals: str) -> str:
    """Stock period by period: a fold that never lets it fall below zero."""
    return f"""
    {name}_net AS (SELECT d.item_id, any_value(opening) AS opening, list(d.demand ORDER BY d.period) AS dl,
                          list(coalesce(a.arrivals, 0.0::DOUBLE) ORDER BY d.period) AS al
                   FROM dm d JOIN it USING (item_id) LEFT JOIN {arrivals} a ON a.item_id = d.item_id AND a.period = d.period
                   GROUP BY d.item_id),
    {name}_inv AS (SELECT *, list_reduce(list_zip(al, dl), lambda acc, x: list_append(acc, greatest(0, acc[-1] + x[1] - x[2])),
                                         [opening]) AS inv FROM {name}_net),
    {name} AS (SELECT item_id, CAST(i AS INTEGER) AS period, dl[i] AS demand, al[i] AS arrivals, inv[i + 1] AS inventory,
                      greatest(0, dl[i] - inv[i] - al[i]) AS shortage
               FROM {name}_inv, (SELECT unnest(range(1, {PERIODS + 1})) AS i))"""


_PLAN = f"""{_PLAN_BASE}, {_projection_sql("pr", "(SELECT 0 AS item_id, 0 AS period, 0.0::DOUBLE AS arrivals)")},
    od AS (SELECT item_id, period, requirement, least(ceil(greatest(requirement, min_order) / pack_size) * pack_size,
                                                      floor(120 / pack_size) * pack_size) AS order_qty, late, lead_time
           FROM (SELECT item_id, CAST(greatest(period - lead_time, 1) AS INTEGER) AS period, sum(shortage) AS requirement,
                        max(period - lead_time < 1) AS late, any_value(min_order) AS min_order,
                        any_value(pack_size) AS pack_size, any_value(lead_time) AS lead_time
                 FROM pr JOIN it USING (item_id) WHERE shortage > 0
                 GROUP BY item_id, greatest(period - lead_time, 1))),
    {_projection_sql("pj", "(SELECT item_id, period + lead_time AS period, sum(order_qty) AS arrivals FROM od GROUP BY ALL)")},
    pl AS (SELECT pj.*, coalesce(order_qty, 0) AS order_qty FROM pj LEFT JOIN od USING (item_id, period))"""
_PLAN_VIEWS = ("items",)


@query(
    "r11_project_inventory",
    f"WITH {_PLAN_BASE}, {_projection_sql('pr', '(SELECT 0 AS item_id, 0 AS period, 0.0::DOUBLE AS arrivals)')} SELECT * FROM pr",
    _PLAN_VIEWS,
)
def r11(t):
    return PL.project_inventory(plan_demand(t), plan_items(t))


@query(
    "r12_build_orders",
    f"""WITH {_PLAN} SELECT item_id, period, requirement, order_qty,
               CAST(greatest(requirement - order_qty, 0) AS DOUBLE) AS uncovered, late, CAST(period + lead_time AS INTEGER) AS arrival_period FROM od""",
    _PLAN_VIEWS,
)
def r12(t):
    return PL.build_orders(PL.project_inventory(plan_demand(t), plan_items(t)), plan_items(t))


@query(
    "r12_lot_sizing",
    f"""WITH {_PLAN_BASE}, {_projection_sql("pr", "(SELECT 0 AS item_id, 0 AS period, 0.0::DOUBLE AS arrivals)")},
        nd AS (SELECT item_id, CAST(greatest(period - lead_time, 1) AS INTEGER) AS period, sum(shortage) AS need, max(period - lead_time < 1) AS late
               FROM pr JOIN it USING (item_id) WHERE shortage > 0 GROUP BY ALL),
        fl AS (SELECT g.item_id, g.p, coalesce(max(nd.need), 0) AS need, max(g.cap) AS cap, max(g.pack_size) AS pack_size, max(g.min_order) AS min_order,
                      max(g.lead_time) AS lead_time, max(g.late) AS late
               FROM (SELECT DISTINCT i.item_id, p, floor(120 / pack_size) * pack_size AS cap, pack_size, min_order, lead_time,
                            (SELECT bool_or(late) FROM nd WHERE nd.item_id = i.item_id) AS late
                     FROM it i, (SELECT unnest(range(1, {PERIODS + 1})) AS p) WHERE i.item_id IN (SELECT item_id FROM nd)) g
               LEFT JOIN nd ON nd.item_id = g.item_id AND nd.period = g.p GROUP BY g.item_id, g.p),
        cu AS (SELECT *, sum(need) OVER (PARTITION BY item_id ORDER BY p) AS r FROM fl),
        lo AS (SELECT a.item_id, a.p, max(b.r - a.cap * (b.p - a.p)) AS least FROM cu a JOIN cu b ON a.item_id = b.item_id AND b.p >= a.p GROUP BY ALL),
        st AS (WITH RECURSIVE go(item_id, p, qty, total) AS (
                 SELECT item_id, 0::BIGINT, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT item_id FROM cu)
                 UNION ALL
                 SELECT c.item_id, c.p, q.qty, g.total + q.qty
                 FROM go g JOIN cu c ON c.item_id = g.item_id AND c.p = g.p + 1 JOIN lo ON lo.item_id = c.item_id AND lo.p = c.p,
                      LATERAL (SELECT CASE WHEN lo.least - g.total > 1e-9 THEN least(ceil(greatest(lo.least - g.total, c.min_order) / c.pack_size) * c.pack_size, c.cap)
                                      ELSE 0 END::DOUBLE AS qty) q)
               SELECT * FROM go)
        SELECT item_id, CAST(p AS INTEGER) AS period, need AS requirement, qty AS order_qty, greatest(total - r, 0)::DOUBLE AS carried,
               greatest(r - total, 0)::DOUBLE AS uncovered, late AND p = 1 AS late, CAST(p + lead_time AS INTEGER) AS arrival_period
        FROM cu JOIN st USING (item_id, p) WHERE need > 0 OR qty > 0""",
    _PLAN_VIEWS,
)
def r12_lots(t):
    return LO.build_lots(PL.project_inventory(plan_demand(t), plan_items(t)), plan_items(t), PERIODS)


@query(
    "r13_audit",
    f"""WITH {_PLAN}
        SELECT 'max_order' AS rule, item_id, period, order_qty AS actual, 120::DOUBLE AS allowed FROM pl WHERE order_qty > 120
        UNION ALL SELECT 'min_order', item_id, period, order_qty, min_order FROM pl JOIN it USING (item_id)
                  WHERE order_qty > 0 AND order_qty < min_order
        UNION ALL SELECT 'max_inventory', item_id, period, inventory, 200 FROM pl WHERE inventory > 200
        UNION ALL SELECT 'safety_stock', item_id, period, inventory, 0.1::DOUBLE * demand FROM pl WHERE inventory < 0.1::DOUBLE * demand
        UNION ALL SELECT 'inventory_turnover', item_id, NULL, round(sum(demand) / avg(inventory), 6), 2 FROM pl
                  GROUP BY item_id HAVING sum(demand) < 2 * avg(inventory)
        UNION ALL SELECT 'shipping_capacity', NULL, period, sum(order_qty), 9000 FROM pl GROUP BY period HAVING sum(order_qty) > 9000
        UNION ALL SELECT 'budget', NULL, period, round(sum((oc + 1.5::DOUBLE) * order_qty + CASE WHEN order_qty > 0 THEN 20 ELSE 0 END), 4),
                  1000000 FROM pl JOIN it USING (item_id) GROUP BY period
                  HAVING sum((oc + 1.5::DOUBLE) * order_qty + CASE WHEN order_qty > 0 THEN 20 ELSE 0 END) > 1000000""",
    _PLAN_VIEWS,
)
def r13(t):
    found = PL.audit(full_plan(t), plan_items(t), shipping_capacity=9000, budget=1_000_000)
    digits = F.when(F.col("rule") == "inventory_turnover", F.round("actual", 6)).when(
        F.col("rule") == "budget", F.round("actual", 4)
    )
    return found.withColumn("actual", F.coalesce(digits, F.col("actual")))


_COSTS = """co AS (SELECT item_id, sum(oc * order_qty + CASE WHEN order_qty > 0 THEN 20 ELSE 0 END) AS ordering_cost,
        sum(0.5::DOUBLE * inventory) AS holding_cost, sum(9 * shortage) AS shortage_cost,
        sum(1.5::DOUBLE * order_qty) AS shipping_cost, sum(0.25::DOUBLE * inventory) AS storage_cost
    FROM pl JOIN it USING (item_id) GROUP BY item_id)"""


@query(
    "r14_plan_costs",
    f"""WITH {_PLAN}, {_COSTS} SELECT item_id, round(ordering_cost, 4) AS ordering_cost, holding_cost, shortage_cost,
               shipping_cost, storage_cost, 0::DOUBLE AS transfer_cost FROM co""",
    _PLAN_VIEWS,
)
def r14(t):
    return rounded(PL.plan_costs(full_plan(t), plan_items(t)), ["ordering_cost"])


@query(
    "r14_cost_summary",
    f"""WITH {_PLAN}, {_COSTS},
        mv AS (SELECT item_id, quantity * 0.7::DOUBLE AS cost FROM (SELECT item_id, least(opening, 15) AS quantity FROM it)),
        su AS (SELECT count(*) AS n, sum(ordering_cost) AS ordering_cost, sum(holding_cost) AS holding_cost,
                      sum(shortage_cost) AS shortage_cost, sum(shipping_cost) AS shipping_cost,
                      sum(storage_cost) AS storage_cost, sum(cost) AS transfer_cost FROM co LEFT JOIN mv USING (item_id)),
        tt AS (SELECT *, ordering_cost + holding_cost + shortage_cost + shipping_cost + storage_cost + transfer_cost AS total FROM su),
        un AS (UNPIVOT tt ON ordering_cost, holding_cost, shortage_cost, shipping_cost, storage_cost, transfer_cost
               INTO NAME term VALUE amount)
        SELECT term, round(amount, 2) AS amount, round(amount / total * 100, 6) AS percent, round(total, 2) AS total_cost,
               round(total / n, 4) AS average_per_product FROM un""",
    _PLAN_VIEWS,
)
def r14_summary(t):
    transfers = plan_items(t).select("item_id", (F.least("opening", F.lit(15.0)) * 0.7).alias("cost"))
    summary = PL.cost_summary(PL.plan_costs(full_plan(t), plan_items(t), transfers))
    return rounded(rounded(rounded(summary, ["amount", "total_cost"], 2), ["percent"], 6), ["average_per_product"], 4)


@query(
    "r15_plan_details",
    f"""WITH {_PLAN} SELECT item_id, period, order_qty AS optimal_order_qty,
               CAST(CASE WHEN order_qty >= 60 THEN 2 WHEN order_qty >= 20 THEN 1 ELSE 0 END AS INTEGER) AS price_tier,
               CAST(period + lead_time AS INTEGER) AS expected_arrival, inventory, shortage,
               CAST(order_qty > 0 AS INTEGER) AS order_decision FROM pl JOIN it USING (item_id)""",
    _PLAN_VIEWS,
)
def r15(t):
    return PL.plan_details(full_plan(t), plan_items(t))


@query(
    "r16_current_orders",
    f"""WITH {_PLAN} SELECT item_id, order_qty AS order_quantity, period AS order_period, 'pending' AS status
        FROM pl WHERE period = 3 AND order_qty > 0.01""",
    _PLAN_VIEWS,
)
def r16(t):
    return PL.current_orders(full_plan(t), 3)


@query(
    "r17_decision_rules",
    f"""WITH {_PLAN},
        a AS (SELECT item_id, period, order_qty AS amount FROM pl ORDER BY order_qty DESC, item_id, period LIMIT 1),
        b AS (SELECT item_id, period, inventory AS amount FROM pl ORDER BY inventory, item_id, period LIMIT 1),
        c AS (SELECT item_id, period, shortage AS amount FROM pl ORDER BY shortage DESC, item_id, period LIMIT 1)
        SELECT 1 AS rule_id, 'high' AS priority, item_id, period, amount, concat('largest order of item ', item_id,
               ' in period ', period) AS condition, 0.95::DOUBLE AS confidence, 0.8::DOUBLE AS support FROM a
        UNION ALL SELECT 2, 'medium', item_id, period, amount, concat('lowest stock of item ', item_id, ' in period ', period),
               0.85, 0.7 FROM b
        UNION ALL SELECT 3, 'critical', item_id, period, amount, concat('largest shortage of item ', item_id, ' in period ', period),
               0.98, 0.9 FROM c WHERE amount > 0""",
    _PLAN_VIEWS,
)
def r17(t):
    return PL.decision_rules(full_plan(t))


@query(
    "r18_align_horizon",
    f"WITH {_PLAN_BASE} SELECT item_id, CAST(period AS INTEGER) AS period, demand FROM dm WHERE period <= 6",
    _PLAN_VIEWS,
)
def r18(t):
    monthly = t.table("lineitem").groupBy(F.col("l_partkey").alias("item_id"), F.month("l_shipdate").alias("period")).agg(
        F.sum("l_quantity").alias("demand")
    )
    return PL.align_horizon(monthly, 6)


@query(
    "r19_parameters",
    """SELECT item_id, coalesce(o, 100) AS ordering_cost, coalesce(h, 10) AS holding_cost, 100::DOUBLE AS shortage_cost,
              100::DOUBLE AS unit_cost, 10000::DOUBLE AS max_order_quantity, coalesce(m, 0) AS min_order_quantity,
              0.1::DOUBLE AS safety_stock_target
       FROM items LEFT JOIN (SELECT item_id, unit_price / 20 AS o, CASE WHEN pack_size > 5 THEN 4::DOUBLE END AS h,
                                    CAST(min_order_qty AS DOUBLE) AS m FROM items WHERE abc_class <> 'C') USING (item_id)""",
    ("items",),
)
def r19(t):
    given = t.items.where("abc_class != 'C'").select(
        "item_id", (F.col("unit_price") / 20).alias("ordering_cost"), F.when(F.col("pack_size") > 5, 4.0).alias("holding_cost"),
        F.col("min_order_qty").cast("double").alias("min_order_quantity"),
    )
    return PL.parameters(t.items, given)
