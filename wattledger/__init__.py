"""Spark jobs for electricity-invoice tables, solar sizing and solar budgets."""
