"""Fixed schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = {
    "items": """item_id bigint, abc_class string, min_order_qty int, pack_size int, safety_factor_z double,
        uom string, unit_price double, category string, brand string""",
    "locations": "location_id string, capacity_limit int, transfer_cost_per_unit double, region string",
    "suppliers": "supplier_id bigint, lead_time_days int, price_breaks string, rating string, type string",
    "inventory_daily": """date date, item_id bigint, location_id string, on_hand_qty bigint, demand_qty bigint,
        receipts_qty bigint, seasonal_factor double""",
    "purchase_orders": """po_id bigint, item_id bigint, supplier_id bigint, order_date date, due_date date,
        order_qty bigint, status string, location_id string, unit_price double, priority string,
        created_by string""",
    "forecast_output": """item_id bigint, location_id string, horizon_date date, yhat double, model_used string,
        mape_recent double, smape_recent double, confidence_level double, lower_bound double,
        upper_bound double, seasonal_factor double""",
    "optimal_plan": """item_id bigint, location_id string, supplier_id bigint, order_qty bigint, unit_price double,
        tier_chosen int, due_date date, transfer_from string, transfer_qty bigint, rationale string,
        plan_date date, optimization_goal string, confidence_score double, estimated_savings double""",
    "weather": """date date, location_id string, temperature double, humidity double, precipitation double,
        wind_speed double, weather_condition string""",
    "competitor_prices": "date date, item_id bigint, competitor string, price double, discount double",
    "macro": "date date, indicator string, value double, unit string",
}


def schema(table: str) -> T.StructType:
    if table not in _TEXT:
        raise KeyError(f"unknown table {table!r}; known: {', '.join(sorted(_TEXT))}")
    return T.StructType.fromDDL(_TEXT[table])


def tables() -> list[str]:
    return list(_TEXT)


# Columns a table must have, all without nulls, and columns that must hold whole numbers.
REQUIRED = {
    "items": ["item_id", "abc_class", "min_order_qty", "pack_size", "uom", "unit_price"],
    "locations": ["location_id", "capacity_limit", "transfer_cost_per_unit"],
    "suppliers": ["supplier_id", "lead_time_days", "price_breaks"],
    "inventory_daily": ["date", "item_id", "location_id", "on_hand_qty", "demand_qty", "receipts_qty"],
    "purchase_orders": ["po_id", "item_id", "supplier_id", "order_date", "due_date", "order_qty", "status"],
    "forecast_output": ["item_id", "location_id", "horizon_date", "yhat", "model_used"],
    "optimal_plan": ["item_id", "location_id", "supplier_id", "order_qty", "due_date"],
}
WHOLE_NUMBERS = {"items": ["min_order_qty", "pack_size"]}
