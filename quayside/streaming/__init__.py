"""Incremental consumption of the event ledger."""
