"""Streaming of the ledger engine."""
