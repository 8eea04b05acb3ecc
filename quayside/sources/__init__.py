"""Scans of landed files, snapshots and the event ledger, and the matching sinks."""
