"""Replenishment policies, purchase orders and plan analytics."""
