"""Ledger predicates. Every key is checked: an unknown one raises instead of being ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EXCLUDED_ALWAYS, INTERNAL

_EQUAL = ("tx_type", "category", "subcategory", "account_label", "to_review", "context")
_IN = {"categories": "category", "subcategories": "subcategory", "contexts": "context"}
FILTER_KEYS = (*_EQUAL, *_IN, "date_from", "date_to", "exclude_tx_types", "description")
DELETE_KEYS = ("tx_type", "category", "subcategory", "account_label", "context", "date_from", "date_to", "description", "exclude_tx_types")


def ledger_predicate(allowed: tuple[str, ...] = FILTER_KEYS, **keys) -> Column:
    """The conjunction of the given keys: equality (context=None: IS NULL), inclusive
    dates, IN lists, NOT IN of types (a null type fails it), and a case-blind
    description pattern over both descriptions, in which % and _ are live."""
    parts = [F.lit(True)]
    for k, v in keys.items():
        if k not in allowed:
            raise ValueError(f"unknown filter key: {k}")
        if k == "context" and v is None:
            parts.append(F.col("context").isNull())
        elif k in _EQUAL:
            parts.append(F.col(k) == v)
        elif k == "date_from":
            parts.append(F.col("date") >= F.to_date(F.lit(v)))
        elif k == "date_to":
            parts.append(F.col("date") <= F.to_date(F.lit(v)))
        elif k in _IN:
            parts.append(F.col(_IN[k]).isin(list(v)))
        elif k == "exclude_tx_types":
            parts.append(~F.col("tx_type").isin(list(v)))
        else:
            parts.append(F.col("description").ilike(f"%{v}%") | F.col("raw_description").ilike(f"%{v}%"))
    return reduce(lambda a, b: a & b, parts)


def filter_ledger(ledger: DataFrame, **keys) -> DataFrame:
    return ledger.where(ledger_predicate(**keys))


def counted_types(include_internal: bool = False, keep_null: bool = False) -> Column:
    """True for types that reports count. SQL reports drop a null type, in-memory ones keep it."""
    types = list(EXCLUDED_ALWAYS) + ([] if include_internal else list(INTERNAL))
    ok = ~F.col("tx_type").isin(types)
    return F.coalesce(ok, F.lit(True)) if keep_null else ok


def rule_matches(pattern: str, kind: str, column: str = "description") -> Column:
    """exact, contains or regex, all without regard to case; null never matches."""
    text = F.lower(F.col(column))
    if kind == "exact":
        hit = text == pattern.lower()
    elif kind == "contains":
        hit = F.contains(text, F.lit(pattern.lower()))
    elif kind == "regex":
        hit = F.regexp(F.col(column), F.lit(f"(?i){pattern}"))
    else:
        raise ValueError(f"unknown match type: {kind}")
    return F.coalesce(hit, F.lit(False))


def similar_uncategorised(ledger: DataFrame, description: str, exclude_id: str) -> DataFrame:
    """Same description, not validated, without a source or one that a model gave."""
    src = F.col("category_source")
    return ledger.where((F.col("description") == description) & (F.col("id") != exclude_id) & ~F.coalesce("human_validated", F.lit(False)) & (src.isNull() | (src == "llm")))
