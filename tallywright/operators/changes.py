"""Changes to tables as new DataFrames: inserts, deletes with cascades, updates, renames, sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import transaction_id
from .filters import DELETE_KEYS, ledger_predicate, rule_matches
from .rules import inline_rules


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of new whose key it lacks; of new rows alike in key the first by all columns."""
    fresh = new.join(stored, keys, "left_anti")
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in new.columns])
    once = fresh.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    return stored.unionByName(once, allowMissingColumns=True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones of their key."""
    return stored.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def keep_latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; repeats elsewhere go."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_links(links: DataFrame, gone: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Links neither of whose ends is among the ids that go."""
    return reduce(lambda d, e: d.join(gone.select(F.col("id").alias(e)), e, "left_anti"), ends, links)


def delete_where(ledger: DataFrame, **keys) -> tuple[DataFrame, DataFrame]:
    """(rest, ids that go). No key at all is refused; a row for which the predicate is null stays."""
    if not keys:
        raise ValueError("a delete needs a filter")
    hit = F.coalesce(ledger_predicate(DELETE_KEYS, **keys), F.lit(False))
    return ledger.where(~hit), ledger.where(hit).select("id")


def delete_duplicates(ledger: DataFrame) -> DataFrame:
    """Of (date, raw description, amount) in several accounts only the first row by id stays; all others stay."""
    w = Window.partitionBy("date", "raw_description", "amount")
    accounts = F.size(F.collect_set("account_label").over(w))
    first = F.row_number().over(w.orderBy("id"))
    return ledger.withColumn("_a", accounts).withColumn("_f", first).where(F.col("raw_description").isNull() | (F.col("_a") < 2) | (F.col("_f") == 1)).drop("_a", "_f")


def cancel_batch(ledger: DataFrame, batches: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
    hit = F.col("batch_id") == batch_id
    out = batches.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).withColumn("n", F.when(hit, F.lit(0).cast("long")).otherwise(F.col("n")))
    return ledger.where(~F.coalesce(hit, F.lit(False))), out


def update(ledger: DataFrame, hit: Column, **values) -> DataFrame:
    """The given columns where ``hit`` is true."""
    sure = F.coalesce(hit, F.lit(False))
    return ledger.withColumns({c: F.when(sure, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def set_category(ledger: DataFrame, hit: Column, category: str, subcategory: str) -> DataFrame:
    return update(ledger, hit, category=category, subcategory=subcategory, category_confidence="high", category_source="manual", human_validated=True, to_review=False)


def toggled_type() -> Column:
    """Internal by sign becomes income or expense, and back; zero counts as incoming."""
    incoming = F.col("amount") >= 0
    internal = F.col("tx_type").isin("internal_in", "internal_out")
    return F.when(internal, F.when(incoming, "income").otherwise("expense")).otherwise(F.when(incoming, "internal_in").otherwise("internal_out"))


def mark_transfers(ledger: DataFrame, description: str, exclude_id: str) -> DataFrame:
    """All rows of one description become internal by sign."""
    return update(ledger, (F.col("description") == description) & (F.col("id") != exclude_id), tx_type=F.when(F.col("amount") >= 0, "internal_in").otherwise("internal_out"))


def apply_rules(ledger: DataFrame, rules: list[dict], review_only: bool = False) -> DataFrame:
    """Matched rows take the rule's category and need no review; rows that a rule had categorised and none matches now are cleared."""
    within = F.coalesce("to_review", F.lit(False)) if review_only else F.lit(True)
    out = ledger.withColumn("_r", inline_rules(rules))
    hit = within & F.col("_r").isNotNull()
    stale = within & F.col("_r").isNull() & (F.col("category_source") == "rule")
    out = update(out, stale, category=F.lit(None).cast("string"), subcategory=F.lit(None).cast("string"), category_source=F.lit(None).cast("string"), to_review=True)
    return update(out, hit, category=F.col("_r.category"), subcategory=F.col("_r.subcategory"), category_source="rule", category_confidence="high", to_review=False).drop("_r")


def describe_by_rule(ledger: DataFrame, pattern: str, kind: str, description: str) -> DataFrame:
    return update(ledger, rule_matches(pattern, kind, "raw_description"), description=description)


def rename_account(ledger: DataFrame, old: str, new: str) -> DataFrame:
    """Rows of the account get the new label and the ids that follow from it; old_id keeps the former."""
    hit = F.coalesce(F.col("account_label") == old, F.lit(False))
    again = transaction_id(F.lit(new), F.col("source_file"), F.col("date"), F.col("amount"), F.col("description"))
    return ledger.withColumn("old_id", F.col("id")).withColumn("id", F.when(hit, again).otherwise(F.col("id"))).withColumn("account_label", F.when(hit, new).otherwise(F.col("account_label")))


def relink(links: DataFrame, renamed: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Links that follow their rows to new ids."""
    changed = renamed.where("id <> old_id").select("old_id", F.col("id").alias("_new"))
    for e in ends:
        links = links.join(changed.withColumnRenamed("old_id", e), e, "left").withColumn(e, F.coalesce("_new", e)).drop("_new")
    return links


def overlay(defaults: DataFrame, stored: DataFrame) -> DataFrame:
    """Settings (key, value): stored values over defaults."""
    return defaults.withColumnRenamed("value", "d").join(stored, "key", "full").select("key", F.coalesce("value", "d").alias("value"))


def synced_budget(targets: DataFrame) -> DataFrame:
    """The new set of targets replaces the old one; zero or none deletes."""
    return targets.where("target_pct > 0")


def merged_lists(a: Column, b: Column) -> Column:
    """Both lists in order, each item once."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def import_history(batches: DataFrame, ledger: DataFrame, n: int = 100) -> DataFrame:
    """Newest batches with the number of rows that are left of each."""
    counts = ledger.groupBy("batch_id").agg(F.count("id").alias("rows"))
    return batches.join(counts, "batch_id", "left").select("batch_id", "imported_at", "status", F.coalesce("rows", F.lit(0).cast("long")).alias("rows")).orderBy(F.desc("imported_at"), "batch_id").limit(n)


def integrity(base: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that went, came or changed: (keys, change). Rows are compared as a whole, null-safe."""
    values = [c for c in base.columns if c not in keys]
    side = lambda d, n: d.select(*keys, F.struct(*[F.col(c) for c in values]).alias(n))
    both = side(base, "b").withColumn("_b", F.lit(True)).join(side(current, "c").withColumn("_c", F.lit(True)), keys, "full")
    change = F.when(F.col("_c").isNull(), "deleted").when(F.col("_b").isNull(), "added").when(~F.col("b").eqNullSafe(F.col("c")), "modified")
    return both.select(*keys, change.alias("change")).where("change is not null")
