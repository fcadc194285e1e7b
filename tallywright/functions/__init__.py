"""Functions of the ledger engine."""
