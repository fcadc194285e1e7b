"""The ledger's columns and allowed values."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)

LEDGER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("batch_id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("amount", MONEY), T.StructField("raw_amount", T.StringType()), T.StructField("currency", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("raw_description", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("doc_type", T.StringType()), T.StructField("account_label", T.StringType()), T.StructField("tx_type", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()), T.StructField("category_confidence", T.StringType()),
    T.StructField("category_source", T.StringType()), T.StructField("context", T.StringType()), T.StructField("to_review", T.BooleanType()),
    T.StructField("human_validated", T.BooleanType()),
])

# The kinds a column may hold.
TX_TYPES = ("expense", "income", "internal_out", "internal_in", "card_tx", "card_settlement", "aggregate_debit", "unknown")
EXCLUDED_ALWAYS = ("card_settlement", "aggregate_debit")
INTERNAL = ("internal_out", "internal_in")
CONFIDENCES = ("high", "medium", "low")
SOURCES = ("rule", "history", "brand", "llm", "manual")
SIGN_CONVENTIONS = ("signed_single", "debit_positive", "debit_credit_signed", "credit_negative")
#: Category that stands for "none" in reports.
OTHER = "Altro"
NO_CONTEXT = "—"
