"""Queries of joins for import, set operations and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import changes as C
from ..sources.adapters import table
from .matching_queries import FIRST, RULES, RULES_SQL
from .register import on_events, on_ledger, query

EARLY, LATE = "date < DATE '1998-01-01'", "date >= DATE '1997-06-01'"
BATCHES = "batches AS (SELECT CAST(i AS BIGINT) AS batch_id, CAST(DATE '2024-01-01' + CAST(i % 7 AS INTEGER) AS DATE) AS imported_at, 'done' AS status, CAST(i AS BIGINT) AS n FROM range(25) t(i))"


def batches(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(25).select(i.alias("batch_id"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 7).cast("int")).alias("imported_at"), F.lit("done").alias("status"), i.alias("n"))


# ---- sets
on_ledger("set_union_all", f"SELECT account_label, count(*) AS n FROM (SELECT * FROM ledger WHERE {EARLY} UNION ALL SELECT * FROM ledger WHERE {LATE}) GROUP BY 1")(
    lambda d: d.where(EARLY).unionByName(d.where(LATE).drop("context"), allowMissingColumns=True).groupBy("account_label").agg(F.count(F.lit(1)).alias("n"))
)
on_ledger("set_append_new", f"SELECT DISTINCT account_label, batch_id, category FROM ledger WHERE {EARLY} OR {LATE}")(
    lambda d: C.insert_absent(d.where(EARLY).select("account_label", "batch_id", F.coalesce("category", F.lit("none")).alias("category")).distinct(), d.where(LATE).select("account_label", "batch_id", F.coalesce("category", F.lit("none")).alias("category")), ["account_label", "batch_id", "category"])
    .withColumn("category", F.nullif("category", F.lit("none")))
)
on_ledger("set_first_seen", "SELECT description, doc_type, min(date) AS date, CAST(min(id) AS VARCHAR) AS id FROM (SELECT *, rank() OVER (PARTITION BY description, doc_type ORDER BY date) AS r FROM ledger) WHERE r = 1 GROUP BY 1, 2")(
    lambda d: C.keep_latest(d, ["description", "doc_type"], [F.col("date"), F.col("id")]).select("description", "doc_type", "date", "id")
)
on_ledger("set_except", f"SELECT DISTINCT description FROM ledger WHERE {EARLY} AND amount > 30000 EXCEPT SELECT DISTINCT description FROM ledger WHERE {LATE} AND amount > 40000")(
    lambda d: d.where(f"{EARLY} and amount > 30000").select("description").exceptAll(d.where(f"{LATE} and amount > 40000").select("description")).distinct().join(d.where(f"{LATE} and amount > 40000").select("description"), "description", "left_anti")
)
on_ledger("set_intersect", f"SELECT description FROM ledger WHERE {EARLY} AND amount > 40000 INTERSECT SELECT description FROM ledger WHERE {LATE} AND amount > 40000")(
    lambda d: d.where(f"{EARLY} and amount > 40000").select("description").intersect(d.where(f"{LATE} and amount > 40000").select("description"))
)
on_ledger("set_ordered_distinct", "SELECT id, array_to_string(CASE WHEN category = account_label THEN [category] ELSE [category, account_label] END, ',') AS merged FROM ledger WHERE category IS NOT NULL")(
    lambda d: d.where("category is not null").select("id", F.array_join(C.merged_lists(F.array("category"), F.array("account_label", "category")), ",").alias("merged"))
)
on_ledger("set_bulk_sync", "SELECT account_label AS category, CAST(count(*) % 3 AS BIGINT) AS target_pct FROM ledger GROUP BY 1 HAVING count(*) % 3 > 0")(
    lambda d: C.synced_budget(d.groupBy(F.col("account_label").alias("category")).agg((F.count(F.lit(1)) % 3).alias("target_pct")))
)
on_ledger("snk_bench_accum", "SELECT account_label, doc_type, id FROM (SELECT *, row_number() OVER (PARTITION BY account_label, doc_type ORDER BY date DESC, id DESC) AS rn FROM ledger) WHERE rn = 1")(
    lambda d: C.keep_latest(d, ["account_label", "doc_type"], [F.desc("date"), F.desc("id")]).select("account_label", "doc_type", "id")
)

# ---- joins of import
on_ledger("jn_dedup_existing", f"SELECT id FROM ledger WHERE {LATE} AND id NOT IN (SELECT id FROM ledger WHERE {EARLY})")(lambda d: d.where(LATE).join(d.where(EARLY), "id", "left_anti").select("id"))
on_ledger("jn_existing_ids", f"SELECT id FROM ledger WHERE {LATE} AND id IN (SELECT id FROM ledger WHERE {EARLY})")(lambda d: d.where(LATE).join(d.where(EARLY), "id", "left_semi").select("id"))
on_ledger("snk_upsert_ledger", f"SELECT count(DISTINCT id) AS n FROM ledger WHERE {EARLY} OR {LATE}")(
    lambda d: C.insert_absent(d.where(EARLY).dropDuplicates(["id"]), d.where(LATE), ["id"]).agg(F.count(F.lit(1)).alias("n"))
)
on_ledger("jn_import_history", f", {BATCHES}, c AS (SELECT batch_id, count(*) AS rows FROM ledger GROUP BY 1) SELECT b.batch_id, imported_at, status, coalesce(rows, 0) AS rows FROM batches b LEFT JOIN c ON b.batch_id = c.batch_id ORDER BY imported_at DESC, b.batch_id LIMIT 20")(
    lambda d: C.import_history(batches(d.sparkSession), d, 20)
)
on_ledger("jn_dim_eager", "SELECT account_label, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM ledger GROUP BY 1")(
    lambda d: d.groupBy("account_label").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
)
query("jn_budget", "SELECT c_mktsegment AS k, n, t FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) FULL JOIN (SELECT * FROM (VALUES ('BUILDING', 5), ('NONE', 7)) v(k, t)) ON c_mktsegment = k WHERE c_mktsegment IS NOT NULL UNION ALL SELECT 'NONE', NULL, 7")(
    lambda spark, d: table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.count(F.lit(1)).alias("n")).join(spark.createDataFrame([("BUILDING", 5), ("NONE", 7)], "k string, t int"), "k", "full")
)

# ---- windows
on_events(
    "win_gap_break",
    "SELECT account_label, date, CAST(sum(b) OVER (PARTITION BY account_label ORDER BY date) AS BIGINT) AS session FROM (SELECT account_label, date, CASE WHEN date - lag(date) OVER (PARTITION BY account_label ORDER BY date) > 2 THEN 1 ELSE 0 END AS b FROM (SELECT DISTINCT account_label, date FROM ledger WHERE event_type = 'purchase'))",
)(lambda d: sessions(d.where("event_type = 'purchase'").select("account_label", "date").distinct(), 2))


def sessions(days: DataFrame, gap: int) -> DataFrame:
    """Numbers of the runs of days with gaps of at most ``gap``."""
    w = Window.partitionBy("account_label").orderBy("date")
    breaks = F.when(F.datediff("date", F.lag("date").over(w)) > gap, 1).otherwise(0)
    return days.withColumn("b", breaks).select("account_label", "date", F.sum("b").over(w).alias("session"))


on_events("win_latest_per_key", "SELECT account_label, event_type, id FROM ledger QUALIFY row_number() OVER (PARTITION BY account_label, event_type ORDER BY ts DESC NULLS LAST, id) = 1")(
    lambda d: C.keep_latest(d, ["account_label", "event_type"], [F.desc_nulls_last("ts"), F.col("id")]).select("account_label", "event_type", "id")
)
BEFORE = "row_number() OVER (PARTITION BY account_label, date < DATE '2024-01-15' ORDER BY abs(date - DATE '2024-01-15'), id)"
on_events("win_boundary_k", f"SELECT account_label, id FROM ledger QUALIFY {BEFORE} <= 10")(lambda d: boundary(d, "2024-01-15", 10).select("account_label", "id"))


def boundary(d: DataFrame, day: str, k: int) -> DataFrame:
    """The k rows before and the k on or after a day, of each account."""
    at = F.lit(day).cast("date")
    w = Window.partitionBy("account_label", F.col("date") < at).orderBy(F.abs(F.datediff("date", at)), "id")
    return d.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


on_ledger("win_pct_of_total", "SELECT account_label, round(CAST(sum(abs(amount)) AS DOUBLE) * 100 / CAST(sum(sum(abs(amount))) OVER () AS DOUBLE), 4) AS pct FROM ledger GROUP BY 1")(
    lambda d: d.groupBy("account_label").agg(F.sum(F.abs("amount")).alias("t")).select("account_label", F.round(F.col("t").cast("double") * 100 / F.sum("t").over(Window.partitionBy()).cast("double"), 4).alias("pct"))
)
on_ledger("srt_multi", "SELECT id FROM ledger ORDER BY coalesce(category, ''), coalesce(subcategory, '') DESC, amount, id LIMIT 100")(
    lambda d: d.orderBy(F.coalesce("category", F.lit("")), F.coalesce("subcategory", F.lit("")).desc(), "amount", "id").limit(100).select("id")
)
query("srt_nocase", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY lower(p_name), p_name LIMIT 20")(
    lambda spark, d: table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.lower("p_name"), "p_name").limit(20)
)
on_ledger("srt_topn", "SELECT id, amount FROM ledger ORDER BY abs(amount) DESC, id LIMIT 10")(lambda d: d.orderBy(F.desc(F.abs("amount")), "id").limit(10).select("id", "amount"))

# ---- changes
on_ledger("dml_delete_filter", "SELECT count(*) AS n FROM ledger WHERE NOT coalesce(tx_type = 'expense' AND date <= DATE '1997-12-31', false)")(
    lambda d: C.delete_where(d, tx_type="expense", date_to="1997-12-31")[0].agg(F.count(F.lit(1)).alias("n"))
)
LINKS = "links AS (SELECT id AS out_id, lead(id) OVER (ORDER BY id) AS in_id FROM ledger WHERE batch_id = 3)"


def links(d: DataFrame) -> DataFrame:
    return d.where("batch_id = 3").select(F.col("id").alias("out_id"), F.lead("id").over(Window.partitionBy("batch_id").orderBy("id")).alias("in_id"))


on_ledger(
    "dml_delete_cascade",
    f", {LINKS}, gone AS (SELECT id FROM ledger WHERE account_label = 'BUILDING') SELECT out_id, in_id FROM links WHERE out_id NOT IN (SELECT id FROM gone) AND coalesce(in_id, '') NOT IN (SELECT id FROM gone)",
)(lambda d: C.without_links(links(d), C.delete_where(d, account_label="BUILDING")[1], ("out_id", "in_id")))
COARSE = "k AS (SELECT * REPLACE (CAST(floor(amount / 1000) AS DECIMAL(18,4)) AS amount) FROM ledger)"
on_ledger(
    "dml_delete_dups",
    f", {COARSE}, m AS (SELECT *, row_number() OVER (PARTITION BY date, raw_description, amount ORDER BY id) AS f FROM k), g AS (SELECT date, raw_description, amount, count(DISTINCT account_label) AS a FROM k GROUP BY 1, 2, 3) SELECT count(*) AS n FROM m LEFT JOIN g ON m.date = g.date AND m.raw_description = g.raw_description AND m.amount = g.amount WHERE m.raw_description IS NULL OR a < 2 OR f = 1",
)(lambda d: C.delete_duplicates(d.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,4)"))).agg(F.count(F.lit(1)).alias("n")))
on_ledger("dml_cancel_batch", f", {BATCHES} SELECT batch_id, CASE WHEN batch_id = 4 THEN 'cancelled' ELSE status END AS status, CASE WHEN batch_id = 4 THEN 0 ELSE n END AS n FROM batches")(
    lambda d: C.cancel_batch(d, batches(d.sparkSession), 4)[1].select("batch_id", "status", "n")
)
on_ledger("dml_set_category", "SELECT id, 'Home' AS category, 'Rent' AS subcategory, 'high' AS category_confidence, 'manual' AS category_source, true AS human_validated, false AS to_review FROM ledger WHERE description = 'small ring'")(
    lambda d: C.set_category(d, F.col("description") == "small ring", "Home", "Rent").where("description = 'small ring'").select("id", "category", "subcategory", "category_confidence", "category_source", "human_validated", "to_review")
)
on_ledger("dml_context", "SELECT id, CASE WHEN batch_id = 2 THEN 'trip' ELSE context END AS context, CASE WHEN batch_id = 2 THEN true ELSE human_validated END AS human_validated FROM ledger")(
    lambda d: C.update(d, F.col("batch_id") == 2, context="trip", human_validated=True).select("id", "context", "human_validated")
)
TOGGLED = "CASE WHEN coalesce(tx_type, '') IN ('internal_in', 'internal_out') THEN CASE WHEN amount >= 0 THEN 'income' ELSE 'expense' END ELSE CASE WHEN amount >= 0 THEN 'internal_in' ELSE 'internal_out' END END"
on_ledger("dml_toggle_transfer", f"SELECT id, CASE WHEN to_review THEN {TOGGLED} ELSE tx_type END AS tx_type FROM ledger")(lambda d: C.update(d, F.col("to_review"), tx_type=C.toggled_type()).select("id", "tx_type"))
on_ledger("dml_bulk_transfer", "SELECT tx_type, count(*) AS n FROM (SELECT CASE WHEN description = 'small ring' AND id <> 'x' THEN CASE WHEN amount >= 0 THEN 'internal_in' ELSE 'internal_out' END ELSE tx_type END AS tx_type FROM ledger) GROUP BY 1")(
    lambda d: C.mark_transfers(d, "small ring", "x").groupBy("tx_type").agg(F.count(F.lit(1)).alias("n"))
)
on_ledger("dml_validate", "SELECT human_validated, count(*) AS n FROM (SELECT CASE WHEN to_review THEN true WHEN batch_id = 1 THEN false ELSE human_validated END AS human_validated FROM ledger) GROUP BY 1")(
    lambda d: C.update(C.update(d, F.col("batch_id") == 1, human_validated=False), F.col("to_review"), human_validated=True).groupBy("human_validated").agg(F.count(F.lit(1)).alias("n"))
)
on_ledger(
    "dml_apply_rules",
    f""", {RULES_SQL}, f AS (SELECT *, {FIRST} AS rid FROM ledger) SELECT id, CASE WHEN rid IS NOT NULL THEN r.category WHEN category_source = 'rule' THEN NULL ELSE f.category END AS category,
 CASE WHEN rid IS NOT NULL THEN 'rule' WHEN category_source = 'rule' THEN NULL ELSE category_source END AS category_source, CASE WHEN rid IS NOT NULL THEN false WHEN category_source = 'rule' THEN true ELSE to_review END AS to_review FROM f LEFT JOIN rules r ON rid = r.rule_id""",
)(lambda d: C.apply_rules(d, RULES).select("id", "category", "category_source", "to_review"))
on_ledger("dml_desc_rule_bulk", "SELECT id, CASE WHEN contains(raw_description, 'RING') THEN 'Jeweller' ELSE description END AS description FROM ledger")(
    lambda d: C.describe_by_rule(d, "ring", "contains", "Jeweller").select("id", "description")
)
RENAMED = "substr(sha256(concat_ws('|', 'WORKS', CAST(date AS VARCHAR), regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '\\.$', ''), coalesce(description, ''))), 1, 24)"
on_ledger("dml_rename_account", f"SELECT id AS old_id, CASE WHEN account_label = 'BUILDING' THEN {RENAMED} ELSE id END AS id, CASE WHEN account_label = 'BUILDING' THEN 'WORKS' ELSE account_label END AS account_label FROM ledger")(
    lambda d: C.rename_account(d, "BUILDING", "WORKS").select("old_id", "id", "account_label")
)
on_ledger(
    "dml_rename_links",
    f", {LINKS}, m AS (SELECT id AS old_id, CASE WHEN account_label = 'BUILDING' THEN {RENAMED} ELSE id END AS id FROM ledger WHERE batch_id = 3) SELECT a.id AS out_id, b.id AS in_id FROM links JOIN m a ON out_id = a.old_id LEFT JOIN m b ON in_id = b.old_id",
)(lambda d: C.relink(links(d), C.rename_account(d, "BUILDING", "WORKS"), ("out_id", "in_id")))
query("dml_settings", "SELECT c_name AS key, CASE WHEN c_acctbal < 0 OR c_custkey % 5 = 0 THEN 'new ' || c_mktsegment ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 <> 0 OR c_acctbal < 0 OR c_custkey % 5 = 0")(
    lambda spark, d: (lambda c: C.overlay(
        c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value")),
        c.where("c_acctbal < 0 or c_custkey % 5 = 0").select(F.col("c_name").alias("key"), F.concat(F.lit("new "), "c_mktsegment").alias("value")),
    ))(table(spark, d, "customer"))
)


def integrity(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.when((F.col("o_orderkey") % 10 == 2) & (F.col("o_totalprice") > 1000), F.lit(1.0)).otherwise(F.col("o_totalprice"))
    return C.integrity(o, o.where("o_orderkey % 10 <> 1").withColumn("o_totalprice", price), ["o_orderkey"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


query("agg_csv_integrity", "SELECT change, count(*) AS n FROM (SELECT 'deleted' AS change FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT 'modified' FROM orders WHERE o_orderkey % 10 = 2 AND o_totalprice > 1000) GROUP BY 1")(integrity)
