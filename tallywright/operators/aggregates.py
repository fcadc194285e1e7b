"""Reports over the ledger: grouped sums, pivots, rollups, budgets and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NO_CONTEXT, OTHER
from .filters import counted_types


def money(c: Column | str) -> Column:
    """The form in which sums leave a report."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def total(c: str = "amount") -> Column:
    return money(F.sum(c)).alias("total")


def month(c: str = "date") -> Column:
    return F.date_format(c, "yyyy-MM")


def sign_of(c: str = "amount") -> Column:
    """Zero counts as an expense here."""
    return F.when(F.col(c) > 0, "income").otherwise("expense")


def spending(ledger: DataFrame, include_internal: bool = False) -> DataFrame:
    keys = [F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"), F.coalesce("category", F.lit(OTHER)).alias("category"), F.coalesce("subcategory", F.lit("")).alias("subcategory")]
    return ledger.where(counted_types(include_internal)).groupBy(*keys).agg(total(), F.count(F.lit(1)).alias("n"))


def monthly(ledger: DataFrame) -> DataFrame:
    return ledger.where(counted_types()).groupBy(month().alias("month"), F.coalesce("category", F.lit(OTHER)).alias("category")).agg(total())


def period_totals(ledger: DataFrame, date_from: str, date_to: str) -> DataFrame:
    rows = ledger.where(counted_types() & F.col("date").between(F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))))
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0))
    return rows.agg(money(part(F.col("amount") > 0)).alias("income"), money(F.abs(part(F.col("amount") < 0))).alias("expenses"))


def period_categories(ledger: DataFrame, date_from: str, date_to: str) -> DataFrame:
    rows = ledger.where(counted_types() & (F.col("amount") < 0) & F.col("date").between(F.to_date(F.lit(date_from)), F.to_date(F.lit(date_to))))
    return rows.groupBy(F.coalesce("category", F.lit(OTHER)).alias("category")).agg(money(F.abs(F.sum("amount"))).alias("total"))


def month_account_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(month().alias("month"), "account_label").agg(F.count(F.lit(1)).alias("n"))


def checklist(ledger: DataFrame, accounts: list[str], current: str) -> DataFrame:
    """Months from the oldest to the current one, each with a count an account; 0 where there is none."""
    counts = ledger.groupBy(month().alias("month")).pivot("account_label", accounts).count()
    spine = ledger.agg(F.trunc(F.min("date"), "month").alias("first")).select(F.explode(F.sequence("first", F.to_date(F.lit(current)), F.expr("interval 1 month"))).alias("d"))
    return spine.select(month("d").alias("month")).join(counts, "month", "left").fillna(0)


def checklist_kpis(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("account_label").alias("accounts"), F.count_distinct(month()).alias("months"))


def ledger_metrics(ledger: DataFrame) -> DataFrame:
    """Number of rows, net, income and expense over the counted types; a null type counts."""
    a = F.col("amount")
    return ledger.where(counted_types(keep_null=True)).agg(
        F.count(F.lit(1)).alias("n"), money(F.sum(a)).alias("net"), money(F.sum(F.when(a > 0, a))).alias("income"), money(F.sum(F.when(a < 0, a))).alias("expense")
    )


def query_summary(ledger: DataFrame) -> DataFrame:
    return ledger.where(counted_types(keep_null=True)).groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit(OTHER)).alias("category")).agg(total())


def month_sign(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(month().alias("month"), sign_of().alias("sign")).agg(money(F.sum(F.abs("amount"))).alias("total"))


def by_category(ledger: DataFrame, income: bool) -> DataFrame:
    """Category totals and, in the same pass, their subcategories: level 1 and 0."""
    rows = ledger.where(F.col("amount") > 0 if income else F.col("amount") < 0).withColumn("a", F.abs("amount"))
    return rows.groupingSets([["category", "subcategory"], ["category"]], "category", "subcategory").agg(
        F.grouping("subcategory").cast("int").alias("level"), money(F.sum("a")).alias("total")
    )


def drilldown(ledger: DataFrame, category: str) -> DataFrame:
    rows = ledger.where((F.col("category") == category) & (F.col("amount") < 0))
    return rows.groupBy(F.coalesce("subcategory", F.lit("")).alias("subcategory"), month().alias("month")).agg(money(F.sum(F.abs("amount"))).alias("total"))


def by_context_month(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"), month().alias("month")).agg(money(F.sum(F.abs("amount"))).alias("total"))


def by_context(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.coalesce("context", F.lit(NO_CONTEXT)).alias("context")).agg(money(F.sum(F.abs("amount"))).alias("total"))


def by_account_month(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(month().alias("month"), "account_label").agg(total())


def top_merchants(ledger: DataFrame, n: int = 10) -> DataFrame:
    sums = ledger.where("amount < 0").groupBy("description").agg(money(F.sum(F.abs("amount"))).alias("total"))
    return sums.orderBy(F.desc("total"), "description").limit(n)


def rollup_report(ledger: DataFrame) -> DataFrame:
    """Leaf groups by the sign of their total, with context subtotals, section totals and shares of the section."""
    leaves = spending(ledger).withColumn("section", F.when(F.col("total") > 0, "income").otherwise("expense")).where("total <> 0")
    sets = [["section", "context", "category", "subcategory"], ["section", "context"], ["section"]]
    rolled = leaves.groupingSets(sets, "section", "context", "category", "subcategory").agg(
        F.grouping_id("section", "context", "category", "subcategory").cast("int").alias("level"), total("total")
    )
    whole = F.sum(F.when(F.col("level") == 7, F.col("total"))).over(Window.partitionBy("section"))
    return rolled.withColumn("pct", F.round(F.try_divide(F.col("total").cast("double") * 100, whole.cast("double")), 4))


def trend_top(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Monthly totals of the n categories with the largest expense."""
    rows = ledger.where(counted_types() & (F.col("amount") < 0)).withColumn("category", F.coalesce("category", F.lit(OTHER)))
    best = rows.groupBy("category").agg(F.sum(F.abs("amount")).alias("t")).orderBy(F.desc("t"), "category").limit(n)
    return rows.join(best, "category", "left_semi").groupBy("category", month().alias("month")).agg(money(F.sum(F.abs("amount"))).alias("total"))


def pivot_export(ledger: DataFrame) -> DataFrame:
    return spending(ledger).withColumn("absolute", F.abs("total")).withColumn("type", sign_of("total"))


def budget_variance(ledger: DataFrame, targets: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Targets (category, target_pct) beside actual shares of total expense: deviation and status."""
    actual = period_categories(ledger, date_from, date_to)
    joined = targets.join(actual, "category", "full")
    whole = F.sum("total").over(Window.partitionBy())
    pct = F.coalesce(F.try_divide(F.coalesce(F.col("total"), F.lit(0)).cast("double") * 100, whole.cast("double")), F.lit(0.0))
    gap = F.col("actual_pct") - F.col("target_pct").cast("double")
    out = joined.withColumn("actual_pct", pct).withColumn("gap", gap)
    status = F.when(F.col("target_pct").isNull(), "none").when(F.abs("gap") <= 5, "green").when(F.abs("gap") <= 10, "yellow").otherwise("red")
    return out.select(
        "category", F.col("target_pct").cast("double").alias("target_pct"), money(F.coalesce("total", F.lit(0))).alias("actual"),
        F.round("actual_pct", 3).alias("actual_pct"), F.round("gap", 3).alias("deviation"), status.alias("status"),
    )


def liquidity(ledger: DataFrame, targets: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """Income left over, beside the share that the targets leave; 100 % where nothing came in."""
    sums = period_totals(ledger, date_from, date_to).crossJoin(targets.agg(F.coalesce(F.sum("target_pct"), F.lit(0)).alias("planned")))  # one row each
    left = F.col("income") - F.col("expenses")
    share = F.when(F.col("income") > 0, F.round(left.cast("double") * 100 / F.col("income").cast("double"), 3)).otherwise(F.lit(100.0))
    return sums.select("income", "expenses", money(left).alias("liquidity"), (F.lit(100.0) - F.col("planned").cast("double")).alias("target_liquidity_pct"), share.alias("actual_liquidity_pct"))


def budget_allocation(targets: DataFrame) -> DataFrame:
    t = F.coalesce(F.sum("target_pct"), F.lit(0)).cast("decimal(18,2)")
    return targets.agg(t.alias("allocated"), (F.lit(100) - t).cast("decimal(18,2)").alias("remaining"), (t > 100).alias("over"))


def anomalies(ledger: DataFrame, reference: DataFrame, household: int = 2) -> DataFrame:
    """Share of each category beside a normalised reference (category, share, per_capita): high over
    1.5 times it, low under half, absent at 0."""
    spent = ledger.where(counted_types() & (F.col("amount") < 0)).groupBy("category").agg(F.sum(F.abs("amount")).alias("t"))
    scaled = reference.withColumn("r", F.when(F.col("per_capita"), F.col("share") * household / 2).otherwise(F.col("share")))
    everything = Window.partitionBy()
    ref = scaled.withColumn("expected", F.try_divide(F.col("r"), F.sum("r").over(everything)))
    share = F.coalesce(F.try_divide(F.col("t").cast("double"), F.col("all").cast("double")), F.lit(0.0))
    joined = ref.join(spent.withColumn("all", F.sum("t").over(everything)), "category", "left").withColumn("actual", share)
    ratio = F.try_divide(F.col("actual"), F.col("expected"))
    kind = F.when(F.col("actual") == 0, "absent").when(ratio > 1.5, "high").when(ratio < 0.5, "low").otherwise("normal")
    return joined.select("category", F.round("expected", 4).alias("expected"), F.round("actual", 4).alias("actual"), F.round(ratio, 4).alias("ratio"), kind.alias("status"))


def running_balance(ledger: DataFrame) -> DataFrame:
    """Balance after each day: days are summed first, so the one window without a key has a row a day."""
    days = ledger.groupBy("date").agg(F.sum("amount").alias("net"))
    return days.select("date", money("net").alias("net"), money(F.sum("net").over(Window.orderBy("date"))).alias("balance"))


def duplicate_groups(ledger: DataFrame) -> DataFrame:
    """(date, raw description, amount) in more than one account: copies and accounts."""
    g = ledger.where("raw_description is not null").groupBy("date", "raw_description", "amount")
    out = g.agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("account_label").alias("n_accounts"), F.array_join(F.array_sort(F.collect_set("account_label")), ", ").alias("accounts"))
    return out.where("n_accounts > 1")


def duplicate_matrix(ledger: DataFrame) -> DataFrame:
    """Pairs of accounts by the number of keys they share; pairs are made within a key's set of accounts."""
    sets = ledger.where("raw_description is not null").groupBy("date", "raw_description", "amount").agg(F.array_sort(F.collect_set("account_label")).alias("a")).where(F.size("a") > 1)
    firsts = sets.select("a", F.posexplode("a").alias("i", "account_a"))
    pairs = firsts.select("account_a", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("account_b"))
    return pairs.groupBy("account_a", "account_b").agg(F.count(F.lit(1)).alias("n"))
