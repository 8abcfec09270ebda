"""Purchase orders: creation from suggestions, approval, decisions, status views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.scale import numbered

DEFAULT_PRICE = 100.0

# Approval limits by order amount, and the rank of each role.
MEDIUM_FROM = 1000
HIGH_FROM = 5000
ROLE_RANK = {"buyer": 1, "manager": 2, "admin": 3}


def purchase_orders(suggestions: DataFrame, id_column: str = "item_id", first_id: int = 1) -> DataFrame:
    """Order lines for accepted suggestions, numbered by item without a single-task sort."""
    accepted = suggestions.where(F.col("need_replenishment") & (F.col("suggested_order_qty") > 0))
    lines = numbered(accepted, [F.col(id_column)], "_n")
    price = F.coalesce(F.col("unit_price"), F.lit(DEFAULT_PRICE))
    return lines.select(
        (F.col("_n") + (first_id - 1)).cast("bigint").alias("order_id"),
        id_column,
        F.col("suggested_order_qty").alias("quantity"),
        price.alias("unit_price"),
        (F.col("suggested_order_qty") * price).alias("total_amount"),
        F.lit("pending").alias("status"),
        F.coalesce(F.col("strategy"), F.lit("rop")).alias("strategy"),
        F.coalesce(F.col("reason"), F.lit("stock below reorder point")).alias("reason"),
    )


def approval_level(amount: Column) -> Column:
    return F.when(amount < MEDIUM_FROM, "low").when(amount < HIGH_FROM, "medium").otherwise("high")


def required_approver(amount: Column) -> Column:
    return F.when(amount < MEDIUM_FROM, "buyer").when(amount < HIGH_FROM, "manager").otherwise("admin")


def role_rank(role: Column) -> Column:
    rank = F.lit(0)
    for name, value in ROLE_RANK.items():
        rank = F.when(role == name, value).otherwise(rank)
    return rank


def submit_for_approval(orders: DataFrame, requester_role: str | Column) -> DataFrame:
    """Approval level and approver by amount; approved at once where the requester ranks high enough."""
    role = F.lit(requester_role) if isinstance(requester_role, str) else requester_role
    amount = F.col("quantity") * F.coalesce(F.col("unit_price"), F.lit(DEFAULT_PRICE))
    sized = orders.withColumn("order_amount", amount)
    approver = required_approver(F.col("order_amount"))
    status = F.when(role_rank(role) >= role_rank(approver), "approved").otherwise("pending")
    return sized.withColumns(
        {
            "approval_level": approval_level(F.col("order_amount")),
            "required_approver": approver,
            "requester_role": role,
            "status": status,
        }
    )


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of every decision (decision_id, order_id, action, approver_role, decided_at, reason).

    The earliest decision by a sufficient role settles a pending order. Before it, decisions by a lower role answer
    'rejected' to an approval and 'error' to a rejection; after it, and for unknown orders, 'not_found'.
    """
    pending = records.where(F.col("status") == "pending").select("order_id", "required_approver")
    joined = decisions.join(pending, "order_id", "left")
    allowed = role_rank(F.col("approver_role")) >= role_rank(F.col("required_approver"))
    marked = joined.withColumn("_ok", F.col("required_approver").isNotNull() & allowed)
    at = F.struct("decided_at", "decision_id")
    settling = marked.where("_ok").groupBy("order_id").agg(F.min(at).alias("_first"))
    final = F.when(F.col("action") == "approve", "approved").otherwise("rejected")
    refused = F.when(F.col("action") == "approve", "rejected").otherwise("error")
    outcome = (
        F.when(F.col("required_approver").isNull() | (F.col("_first") < at), "not_found")
        .when(F.col("_ok"), final)
        .otherwise(refused)
    )
    return marked.join(settling, "order_id", "left").select(
        "decision_id", "order_id", "action", "approver_role", "decided_at",
        F.col("reason"), outcome.alias("outcome"), (F.col("_ok") & (F.col("_first") == at)).alias("applied"),
    )


def after_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records with the status, decider and reason the applied decisions leave behind."""
    applied = apply_decisions(records, decisions).where(F.coalesce("applied", F.lit(False)))
    settled = applied.select(
        "order_id", F.col("outcome").alias("_status"), F.col("approver_role").alias("decided_by"),
        F.when(F.col("action") == "reject", F.col("reason")).alias("rejection_reason"),
    )
    joined = records.join(settled, "order_id", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).drop("_status")


def approval_history(records: DataFrame, order_id: int | None = None) -> DataFrame:
    return records if order_id is None else records.where(F.col("order_id") == order_id)


def with_status(orders: DataFrame, status: str | None = None) -> DataFrame:
    return orders if status is None else orders.where(F.col("status") == status)


def select_for_sync(orders: DataFrame, ids: DataFrame, key: str = "order_id") -> DataFrame:
    return orders.join(ids.select(key), key, "left_semi")


def auto_replenishment(suggestions: DataFrame, requester_role: str, id_column: str = "item_id") -> DataFrame:
    """Suggestions to numbered order lines to approval records."""
    lines = purchase_orders(suggestions, id_column)
    return submit_for_approval(lines.drop("status"), requester_role)


def replenishment_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("status", "approval_level").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("quantity"), F.sum("order_amount").alias("amount")
    )
