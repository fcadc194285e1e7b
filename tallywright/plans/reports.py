"""Report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import filters
from .register import on_ledger, query

T = "CAST(sum(amount) AS DECIMAL(18,2)) AS total"
ABS = "CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS total"
MONTH = "strftime(date, '%Y-%m') AS month"
COUNTED = "tx_type NOT IN ('card_settlement', 'aggregate_debit', 'internal_out', 'internal_in')"
COUNTED_NULL = f"coalesce({COUNTED}, true)"
PERIOD = "date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
SPENDING = f"SELECT coalesce(context, '—') AS context, coalesce(category, 'Altro') AS category, coalesce(subcategory, '') AS subcategory, {T}, count(*) AS n FROM ledger WHERE {COUNTED} GROUP BY 1, 2, 3"
BUDGET = [("ECONOMY", 22.0), ("STANDARD", 18.0), ("PROMO", 25.5), ("Missing", 5.0)]
BUDGET_SQL = "budget AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({p} AS DECIMAL(5,2)))" for c, p in BUDGET) + ") AS b(category, target_pct))"
REFERENCE = [("ECONOMY", 0.30, True), ("STANDARD", 0.02, False), ("PROMO", 0.45, False), ("Missing", 0.10, True)]
REFERENCE_SQL = "reference AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({s} AS DOUBLE), {str(p).lower()})" for c, s, p in REFERENCE) + ") AS r(category, share, per_capita))"


def budget(spark) -> DataFrame:
    return spark.createDataFrame(BUDGET, "category string, p double").select("category", F.col("p").cast("decimal(5,2)").alias("target_pct"))


on_ledger("agg_spending", SPENDING)(A.spending)
on_ledger("agg_monthly", f"SELECT {MONTH}, coalesce(category, 'Altro') AS category, {T} FROM ledger WHERE {COUNTED} GROUP BY 1, 2")(A.monthly)
on_ledger("agg_period_totals", f"SELECT CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DECIMAL(18,2)) AS income, CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DECIMAL(18,2)) AS expenses FROM ledger WHERE {COUNTED} AND {PERIOD}")(
    lambda d: A.period_totals(d, "1996-01-01", "1998-12-31")
)
PERIOD_CATEGORIES = f"SELECT coalesce(category, 'Altro') AS category, CAST(abs(sum(amount)) AS DECIMAL(18,2)) AS total FROM ledger WHERE {COUNTED} AND amount < 0 AND {PERIOD} GROUP BY 1"
on_ledger("agg_period_categories", PERIOD_CATEGORIES)(lambda d: A.period_categories(d, "1996-01-01", "1998-12-31"))
on_ledger("agg_month_account_counts", f"SELECT {MONTH}, account_label, count(*) AS n FROM ledger GROUP BY 1, 2")(A.month_account_counts)

ACCOUNTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
on_ledger(
    "agg_checklist_pivot",
    ", spine AS (SELECT strftime(d, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date_trunc('month', (SELECT min(date) FROM ledger)), TIMESTAMP '2002-03-01', INTERVAL 1 MONTH)) AS d))"
    f", c AS (SELECT {MONTH}, account_label, count(*) AS n FROM ledger GROUP BY 1, 2) SELECT s.month, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN account_label = '{a}' THEN n END), 0) AS BIGINT) AS \"{a}\"" for a in ACCOUNTS)
    + " FROM spine s LEFT JOIN c ON s.month = c.month GROUP BY 1",
)(lambda d: A.checklist(d, ACCOUNTS, "2002-03-01"))
on_ledger("agg_checklist_kpis", "SELECT count(*) AS n, count(DISTINCT account_label) AS accounts, count(DISTINCT strftime(date, '%Y-%m')) AS months FROM ledger")(A.checklist_kpis)
on_ledger(
    "agg_ledger_metrics",
    f"SELECT count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS net, CAST(sum(CASE WHEN amount > 0 THEN amount END) AS DECIMAL(18,2)) AS income, CAST(sum(CASE WHEN amount < 0 THEN amount END) AS DECIMAL(18,2)) AS expense FROM ledger WHERE {COUNTED_NULL}",
)(A.ledger_metrics)
on_ledger("agg_query_summary", f"SELECT coalesce(nullif(category, ''), 'Altro') AS category, {T} FROM ledger WHERE {COUNTED_NULL} GROUP BY 1")(A.query_summary)
on_ledger("agg_month_sign", f"SELECT {MONTH}, CASE WHEN amount > 0 THEN 'income' ELSE 'expense' END AS sign, {ABS} FROM ledger GROUP BY 1, 2")(A.month_sign)
for _name, _op in (("agg_cat_expense", "<"), ("agg_cat_income", ">")):
    on_ledger(_name, f"SELECT category, subcategory, CAST(grouping(subcategory) AS INTEGER) AS level, {ABS} FROM ledger WHERE amount {_op} 0 GROUP BY GROUPING SETS ((category, subcategory), (category))")(
        lambda d, income=_op == ">": A.by_category(d, income)
    )
on_ledger("agg_drilldown", f"SELECT coalesce(subcategory, '') AS subcategory, {MONTH}, {ABS} FROM ledger WHERE category = 'ECONOMY' AND amount < 0 GROUP BY 1, 2")(lambda d: A.drilldown(d, "ECONOMY"))
on_ledger("agg_context_month", f"SELECT coalesce(context, '—') AS context, {MONTH}, {ABS} FROM ledger GROUP BY 1, 2")(A.by_context_month)
on_ledger("agg_context", f"SELECT coalesce(context, '—') AS context, {ABS} FROM ledger GROUP BY 1")(A.by_context)
on_ledger("agg_account_month", f"SELECT {MONTH}, account_label, {T} FROM ledger GROUP BY 1, 2")(A.by_account_month)
on_ledger("agg_top_merchants", f"SELECT description, {ABS} FROM ledger WHERE amount < 0 GROUP BY 1 ORDER BY total DESC, description LIMIT 10")(A.top_merchants)
on_ledger(
    "agg_rollup_report",
    f", s AS ({SPENDING}), l AS (SELECT CASE WHEN total > 0 THEN 'income' ELSE 'expense' END AS section, * FROM s WHERE total <> 0), r AS (SELECT section, context, category, subcategory, CAST(grouping(section, context, category, subcategory) AS INTEGER) AS level, CAST(sum(total) AS DECIMAL(18,2)) AS total"
    " FROM l GROUP BY GROUPING SETS ((section, context, category, subcategory), (section, context), (section))) SELECT *, round(CAST(total AS DOUBLE) * 100 / CAST(sum(CASE WHEN level = 7 THEN total END) OVER (PARTITION BY section) AS DOUBLE), 4) AS pct FROM r",
)(A.rollup_report)
on_ledger(
    "agg_trend_top10",
    f", e AS (SELECT coalesce(category, 'Altro') AS category, date, amount FROM ledger WHERE {COUNTED} AND amount < 0), t AS (SELECT category FROM e GROUP BY 1 ORDER BY sum(abs(amount)) DESC, category LIMIT 3) SELECT category, {MONTH}, {ABS} FROM e WHERE category IN (SELECT category FROM t) GROUP BY 1, 2",
)(lambda d: A.trend_top(d, 3))
on_ledger("agg_pivot_export", f", s AS ({SPENDING}) SELECT *, abs(total) AS absolute, CASE WHEN total > 0 THEN 'income' ELSE 'expense' END AS type FROM s")(A.pivot_export)
VARIANCE = f""", {BUDGET_SQL}, a AS ({PERIOD_CATEGORIES}), j AS (SELECT coalesce(b.category, a.category) AS category, target_pct, total FROM budget b FULL JOIN a ON b.category = a.category),
 p AS (SELECT *, coalesce(CAST(coalesce(total, 0) AS DOUBLE) * 100 / CAST(sum(total) OVER () AS DOUBLE), 0) AS pct FROM j), g AS (SELECT *, pct - CAST(target_pct AS DOUBLE) AS gap FROM p)
 SELECT category, CAST(target_pct AS DOUBLE) AS target_pct, CAST(coalesce(total, 0) AS DECIMAL(18,2)) AS actual, round(pct, 3) AS actual_pct, round(gap, 3) AS deviation,
 CASE WHEN target_pct IS NULL THEN 'none' WHEN abs(gap) <= 5 THEN 'green' WHEN abs(gap) <= 10 THEN 'yellow' ELSE 'red' END AS status FROM g"""
on_ledger("agg_budget_variance", VARIANCE)(lambda d: A.budget_variance(d, budget(d.sparkSession), "1996-01-01", "1998-12-31"))
on_ledger(
    "agg_budget_liquidity",
    f""", {BUDGET_SQL}, t AS (SELECT CAST(coalesce(sum(CASE WHEN amount > 0 THEN amount END), 0) AS DECIMAL(18,2)) AS income, CAST(abs(coalesce(sum(CASE WHEN amount < 0 THEN amount END), 0)) AS DECIMAL(18,2)) AS expenses FROM ledger WHERE {COUNTED} AND {PERIOD})
 SELECT income, expenses, CAST(income - expenses AS DECIMAL(18,2)) AS liquidity, 100.0::DOUBLE - CAST((SELECT sum(target_pct) FROM budget) AS DOUBLE) AS target_liquidity_pct, CASE WHEN income > 0 THEN round(CAST(income - expenses AS DOUBLE) * 100 / CAST(income AS DOUBLE), 3) ELSE 100 END AS actual_liquidity_pct FROM t""",
)(lambda d: A.liquidity(d, budget(d.sparkSession), "1996-01-01", "1998-12-31"))
query("agg_budget_alloc", f"WITH {BUDGET_SQL} SELECT CAST(sum(target_pct) AS DECIMAL(18,2)) AS allocated, CAST(100 - sum(target_pct) AS DECIMAL(18,2)) AS remaining, sum(target_pct) > 100 AS over FROM budget")(
    lambda spark, _: A.budget_allocation(budget(spark))
)
on_ledger(
    "agg_anomaly",
    f""", {REFERENCE_SQL}, s AS (SELECT category, sum(abs(amount)) AS t FROM ledger WHERE {COUNTED} AND amount < 0 GROUP BY 1), s2 AS (SELECT *, sum(t) OVER () AS a FROM s),
 r2 AS (SELECT category, CASE WHEN per_capita THEN share * 3 / 2 ELSE share END AS r FROM reference), r3 AS (SELECT category, r / sum(r) OVER () AS expected FROM r2),
 j AS (SELECT r3.category, expected, coalesce(CAST(t AS DOUBLE) / CAST(a AS DOUBLE), 0) AS actual FROM r3 LEFT JOIN s2 ON r3.category = s2.category)
 SELECT category, round(expected, 4) AS expected, round(actual, 4) AS actual, round(actual / expected, 4) AS ratio, CASE WHEN actual = 0 THEN 'absent' WHEN actual / expected > 1.5 THEN 'high' WHEN actual / expected < 0.5 THEN 'low' ELSE 'normal' END AS status FROM j""",
)(lambda d: A.anomalies(d, d.sparkSession.createDataFrame(REFERENCE, "category string, share double, per_capita boolean"), 3))
on_ledger(
    "win_cumulative",
    ", d AS (SELECT date, sum(amount) AS net FROM ledger GROUP BY 1) SELECT date, CAST(net AS DECIMAL(18,2)) AS net, CAST(sum(net) OVER (ORDER BY date) AS DECIMAL(18,2)) AS balance FROM d",
)(A.running_balance)
DUP_KEYS = "SELECT date, raw_description, amount FROM ledger WHERE raw_description IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT account_label) > 1"
on_ledger(
    "agg_dup_groups",
    "SELECT date, raw_description, amount, count(*) AS copies, count(DISTINCT account_label) AS n_accounts, string_agg(DISTINCT account_label, ', ' ORDER BY account_label) AS accounts FROM ledger WHERE raw_description IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT account_label) > 1",
)(A.duplicate_groups)
COARSE = "SELECT * REPLACE (CAST(floor(amount / 1000) AS DECIMAL(18,4)) AS amount) FROM ledger"


def coarse(d: DataFrame) -> DataFrame:
    """Amounts in thousands, so that accounts share keys."""
    return d.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,4)"))


on_ledger(
    "agg_dup_matrix",
    f", c AS ({COARSE}), k AS (SELECT DISTINCT date, raw_description, amount, account_label FROM c WHERE raw_description IS NOT NULL) SELECT a.account_label AS account_a, b.account_label AS account_b, count(*) AS n FROM k a JOIN k b ON a.date = b.date AND a.raw_description = b.raw_description AND a.amount = b.amount AND a.account_label < b.account_label GROUP BY 1, 2",
)(lambda d: A.duplicate_matrix(coarse(d)))

# ---- filters, counts, sorts, paging
on_ledger("flt_ledger", "SELECT id, date, amount FROM ledger WHERE tx_type = 'expense' AND date >= DATE '1997-01-01' AND date <= DATE '1998-06-30' AND category IN ('ECONOMY', 'PROMO') AND (description ILIKE '%ring%' OR raw_description ILIKE '%ring%')")(
    lambda d: filters.filter_ledger(d, tx_type="expense", date_from="1997-01-01", date_to="1998-06-30", categories=["ECONOMY", "PROMO"], description="ring").select("id", "date", "amount")
)
on_ledger("flt_context_null", "SELECT id, account_label FROM ledger WHERE context IS NULL AND to_review = true AND account_label = 'BUILDING'")(
    lambda d: filters.filter_ledger(d, context=None, to_review=True, account_label="BUILDING").select("id", "account_label")
)
on_ledger("flt_excl_types", f"SELECT tx_type, count(*) AS n FROM ledger WHERE {COUNTED} GROUP BY 1")(lambda d: d.where(filters.counted_types()).groupBy("tx_type").agg(F.count(F.lit(1)).alias("n")))
on_ledger("flt_excl_types_pd", f"SELECT tx_type, count(*) AS n FROM ledger WHERE {COUNTED_NULL} GROUP BY 1")(
    lambda d: d.where(filters.counted_types(keep_null=True)).groupBy("tx_type").agg(F.count(F.lit(1)).alias("n"))
)
for _kind, _pattern, _sql in (("exact", "Small Ring", "lower(description) = 'small ring'"), ("contains", "WIDGET", "contains(lower(description), 'widget')"), ("regex", "^(red|blue) .*t$", "regexp_matches(description, '(?i)^(red|blue) .*t$')")):
    on_ledger(f"flt_rule_{_kind}", f"SELECT description, count(*) AS n FROM ledger WHERE {_sql} GROUP BY 1")(
        lambda d, k=_kind, p=_pattern: d.where(filters.rule_matches(p, k)).groupBy("description").agg(F.count(F.lit(1)).alias("n"))
    )
on_ledger("flt_by_raw_pattern", "SELECT id, raw_description FROM ledger WHERE raw_description IS NOT NULL AND contains(lower(raw_description), 'pos green')")(
    lambda d: d.where(filters.rule_matches("pos green", "contains", "raw_description")).select("id", "raw_description")
)
on_ledger("flt_similar_uncat", "SELECT id, date FROM ledger WHERE description = 'small ring' AND id <> 'x' AND human_validated IS NOT TRUE AND (category_source IS NULL OR category_source = 'llm')")(
    lambda d: filters.similar_uncategorised(d, "small ring", "x").select("id", "date")
)
on_ledger("flt_count_to_review", "SELECT count(*) AS n FROM ledger WHERE to_review AND tx_type IN ('expense', 'income', 'card_tx', 'unknown')")(
    lambda d: d.where(F.col("to_review") & F.col("tx_type").isin("expense", "income", "card_tx", "unknown")).agg(F.count(F.lit(1)).alias("n"))
)
on_ledger("flt_review", "SELECT id, date FROM ledger WHERE to_review ORDER BY date DESC, id LIMIT 500")(lambda d: d.where("to_review").orderBy(F.desc("date"), "id").limit(500).select("id", "date"))
on_ledger("flt_no_category", "SELECT id, date FROM ledger WHERE category IS NULL ORDER BY date DESC, id LIMIT 500")(lambda d: d.where("category is null").orderBy(F.desc("date"), "id").limit(500).select("id", "date"))
on_ledger("flt_test_mode", "SELECT id, date FROM ledger ORDER BY date, id LIMIT 20")(lambda d: d.orderBy("date", "id").limit(20).select("id", "date"))
on_ledger("srt_ledger", "SELECT id, date, amount FROM ledger ORDER BY date DESC, id LIMIT 50 OFFSET 100")(lambda d: d.orderBy(F.desc("date"), "id").offset(100).limit(50).select("id", "date", "amount"))
on_ledger("srt_page", "SELECT id, rn FROM (SELECT id, row_number() OVER (ORDER BY coalesce(category, ''), amount, id) AS rn FROM ledger WHERE to_review) WHERE rn BETWEEN 201 AND 250")(
    lambda d: d.where("to_review").orderBy(F.coalesce("category", F.lit("")), "amount", "id").offset(200).limit(50).select("id", F.monotonically_increasing_id().alias("rn0")).select("id", (F.col("rn0") + 201).alias("rn"))
)
on_ledger("agg_count_desc", "SELECT description, count(*) AS n FROM ledger WHERE id <> 'x' GROUP BY 1")(lambda d: d.where("id <> 'x'").groupBy("description").agg(F.count(F.lit(1)).alias("n")))
on_ledger("agg_count_raw", "SELECT raw_description, count(*) AS n FROM ledger WHERE raw_description IS NOT NULL GROUP BY 1")(
    lambda d: d.where("raw_description is not null").groupBy("raw_description").agg(F.count(F.lit(1)).alias("n"))
)
on_ledger("agg_distinct_accounts", "SELECT DISTINCT account_label FROM ledger WHERE account_label <> ''")(lambda d: d.where("account_label <> ''").select("account_label").distinct())
on_ledger("agg_distinct_contexts", "SELECT DISTINCT context FROM ledger WHERE context <> ''")(lambda d: d.where("context <> ''").select("context").distinct())
on_ledger("agg_taxonomy_dedupe", "SELECT category, subcategory, min(id) AS id FROM ledger WHERE category IS NOT NULL GROUP BY 1, 2")(
    lambda d: d.where("category is not null").groupBy("category", "subcategory").agg(F.min("id").alias("id"))
)
