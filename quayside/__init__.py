"""Spark jobs that turn landed file batches into trusted tables and answer run-ledger questions."""
