"""Reconciling documents against a ledger, as Spark DataFrame operators."""
