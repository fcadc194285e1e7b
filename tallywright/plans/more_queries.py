"""Smaller queries: files and sinks, positional joins, first and contiguous rows, the rest of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import history, ingest, rules, schemas
from ..operators.aggregates import month, money
from ..operators.filters import rule_matches
from ..sources import sinks
from ..sources import statements as St
from ..sources.adapters import LEDGER_SQL, ledger_lineitem, table
from ..stored import new_folder
from .ingest_queries import on_cells
from .matching_queries import RULES
from .register import on_events, on_ledger, query


def as_files(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_file"), F.col("text").cast("binary").alias("content"))


query("src_encoding", "SELECT CAST(doc_id AS VARCHAR) AS source_file, 'UTF-8' AS encoding FROM documents WHERE text IS NOT NULL")(lambda spark, d: St.with_text(as_files(spark, d)).select("source_file", "encoding"))
query("src_file_hash", "SELECT CAST(doc_id AS VARCHAR) AS source_file, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")(lambda spark, d: St.with_text(as_files(spark, d)).select("source_file", "sha256"))


def csv_and_back(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "export")
    sinks.write_csv(ledger_lineitem(spark, sf_dir), path)
    kinds = ", ".join(f"{c} {'decimal(18,4)' if c == 'amount' else 'string'}" for c in sinks.EXPORT)
    return spark.read.schema(kinds).option("header", True).csv(path).groupBy("account_label").agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total"))


query("snk_csv", f"WITH {LEDGER_SQL} SELECT account_label, count(*) AS n, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM ledger GROUP BY 1")(csv_and_back)


def by_context(spark, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "contexts")
    sinks.write_by_context(ledger_lineitem(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("context").agg(F.count(F.lit(1)).alias("n"))


query("snk_xlsx_multi", f"WITH {LEDGER_SQL} SELECT context, count(*) AS n FROM ledger GROUP BY 1")(by_context)
on_ledger("snk_persist", "SELECT batch_id = 3 AS reconciled, count(DISTINCT id) AS n FROM ledger GROUP BY 1")(
    lambda d: sinks.persist(d.limit(0), d.dropDuplicates(["id"]), d.where("batch_id = 3").select(F.col("id").alias("a"), F.col("id").alias("b"))).groupBy("reconciled").agg(F.count(F.lit(1)).alias("n"))
)
on_cells("inf_roles", "SELECT source_file, 0 AS date, 1 AS description, 2 AS amount, true AS usable FROM num GROUP BY 1")(lambda rows: inferred(rows))


def inferred(rows: DataFrame) -> DataFrame:
    """One schema a file, decided from its few column profiles."""
    return schemas.inferred_schemas(St.body(rows), schemas.file_headers(rows)).select("source_file", "date", "description", "amount", "usable")


def positions(d: DataFrame, order: list) -> DataFrame:
    """Rows numbered within their file, so that two tables join by place."""
    return d.withColumn("i", F.row_number().over(Window.partitionBy("source_file").orderBy(*order)))


on_ledger(
    "jn_bench_truth",
    ", a AS (SELECT source_file, amount, row_number() OVER (PARTITION BY source_file ORDER BY amount, id) AS i FROM ledger WHERE to_review), b AS (SELECT source_file, amount, row_number() OVER (PARTITION BY source_file ORDER BY amount, id) AS i FROM ledger WHERE NOT to_review) SELECT a.source_file, count(*) AS n, count(CASE WHEN abs(a.amount - b.amount) <= 0.01 THEN 1 END) AS same FROM a JOIN b ON a.source_file = b.source_file AND a.i = b.i GROUP BY 1",
)(
    lambda d: positions(d.where("to_review"), ["amount", "id"]).select("source_file", "i", F.col("amount").alias("a")).join(positions(d.where("not to_review"), ["amount", "id"]).select("source_file", "i", F.col("amount").alias("b")), ["source_file", "i"])
    .groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) <= F.lit("0.01").cast("decimal(18,4)")).alias("same"))
)
on_ledger("jn_raw_counts", "SELECT o_orderpriority AS context, n FROM (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN (SELECT context, count(*) AS n FROM ledger WHERE to_review GROUP BY 1) ON o_orderpriority = context")(
    lambda d: d.where("context is not null").select("context").distinct().join(d.where("to_review").groupBy("context").agg(F.count(F.lit(1)).alias("n")), "context", "left")
)
on_ledger("jn_cat_writeback", "SELECT id, CASE WHEN description = 'small ring' THEN 'Found' ELSE category END AS category FROM ledger")(
    lambda d: d.join(d.where("description = 'small ring'").select("id", F.lit("Found").alias("found")).dropDuplicates(["id"]), "id", "left").select("id", F.coalesce("found", "category").alias("category"))
)
query(
    "jn_osm_static",
    "WITH v AS (SELECT DISTINCT p_type AS category, p_brand AS subcategory FROM part WHERE p_brand <> 'Brand#11') SELECT 'part=' || CAST(p_partkey AS VARCHAR) AS osm_tag, p_type AS category, p_brand AS subcategory FROM part JOIN v ON p_type = category AND p_brand = subcategory WHERE p_size % 3 <> 0",
)(lambda spark, d: static_map(table(spark, d, "part")))


def static_map(parts: DataFrame) -> DataFrame:
    """Each part is a tag whose hint reads 'category > subcategory', a third of them without the second; hints whose pair the taxonomy has."""
    hint = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit(" > "), "p_brand"))
    hints = parts.select(F.concat(F.lit("part="), F.col("p_partkey").cast("string")).alias("osm_tag"), hint.alias("hint"))
    valid = parts.where("p_brand <> 'Brand#11'").select(F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory")).distinct()
    part = F.split("hint", " > ", 2)
    return hints.select("osm_tag", part[0].alias("category"), F.get(part, F.lit(1)).alias("subcategory")).join(valid, ["category", "subcategory"], "left_semi").select("osm_tag", "category", "subcategory")


on_ledger("jn_hist_top", "SELECT account_label, category FROM (SELECT account_label, category, row_number() OVER (PARTITION BY account_label ORDER BY count(*) DESC, category) AS rn FROM ledger WHERE category IS NOT NULL GROUP BY 1, 2) WHERE rn = 1")(
    lambda d: C.keep_latest(d.where("category is not null").groupBy("account_label", "category").agg(F.count(F.lit(1)).alias("n")), ["account_label"], [F.desc("n"), F.col("category")]).select("account_label", "category")
)
on_ledger("agg_distinct_langs", "SELECT context, min(id) AS first FROM ledger GROUP BY 1")(lambda d: d.groupBy("context").agg(F.min("id").alias("first")))
on_events("agg_derive_cat10", "SELECT id, CASE WHEN event_type <> 'error' THEN round(CAST(abs(amount) AS DOUBLE) / 3 * 10, 4) END AS per_ten FROM ledger")(
    lambda d: d.select("id", F.when(F.col("event_type") != "error", F.round(F.abs("amount").cast("string").try_cast("double") / 3 * 10, 4)).alias("per_ten"))
)
on_ledger("agg_legacy_monthly", "SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, category, CAST(sum(amount) AS DECIMAL(18,2)) AS total FROM ledger GROUP BY 1, 2, 3")(
    lambda d: d.groupBy(F.year("date").alias("year"), F.month("date").alias("month"), "category").agg(money(F.sum("amount")).alias("total"))
)
on_ledger("agg_legacy_alerts", ", m AS (SELECT category, strftime(date, '%Y-%m') AS month, CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS total FROM ledger WHERE amount < 0 AND category IS NOT NULL GROUP BY 1, 2) SELECT category, month, total FROM m QUALIFY row_number() OVER (PARTITION BY category ORDER BY month DESC) = 1 AND total > 1000")(
    lambda d: C.keep_latest(d.where("amount < 0 and category is not null").groupBy("category", month().alias("month")).agg(money(F.sum(F.abs("amount"))).alias("total")), ["category"], [F.desc("month")]).where("total > 1000")
)
on_ledger("win_first_per_group", "SELECT date, raw_description, id FROM ledger WHERE raw_description IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, raw_description ORDER BY id) = 1")(
    lambda d: C.keep_latest(d.where("raw_description is not null"), ["date", "raw_description"], [F.col("id")]).select("date", "raw_description", "id")
)
on_events("win_contiguous", "SELECT account_label, count(*) AS n FROM (SELECT account_label, min(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY account_label ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM ledger) WHERE run = 1 GROUP BY 1")(
    lambda d: d.withColumn("run", F.min(F.col("event_type") != "error").over(Window.partitionBy("account_label").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0))).where("run").groupBy("account_label").agg(F.count(F.lit(1)).alias("n"))
)
query("srt_rules", "SELECT p_brand AS doc_type, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part")(
    lambda spark, d: table(spark, d, "part").select(F.col("p_brand").alias("doc_type"), F.col("p_partkey").alias("id"), F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).cast("long").alias("rank"))
)
on_ledger("flt_by_rule_pattern", "SELECT id FROM ledger WHERE regexp_matches(description, '(?i)ring$')")(lambda d: d.where(rule_matches("ring$", "regex")).select("id"))
on_ledger("flt_tree", "SELECT id FROM ledger WHERE category IN ('ECONOMY') AND context IN ('1-URGENT', '2-HIGH')")(lambda d: d.where(F.col("category").isin("ECONOMY") & F.col("context").isin("1-URGENT", "2-HIGH")).select("id"))
on_ledger("cs_single", "SELECT id, 'Small' AS category, 'rule' AS category_source FROM ledger WHERE id = (SELECT min(id) FROM ledger WHERE description = 'small ring' AND doc_type = 'bank_account')")(
    lambda d: rules.categorise(d.join(d.where("description = 'small ring' and doc_type = 'bank_account'").agg(F.min("id").alias("id")), "id", "left_semi"), RULES, history.profiles(d)).select("id", "category", "category_source")
)
on_events("st_eta", "SELECT account_label, count(*) AS done, CASE WHEN count(*) > 0 THEN round(greatest(100 - count(*), 0) / CAST(count(*) AS DOUBLE), 4) END AS eta FROM ledger GROUP BY 1")(
    lambda d: d.groupBy("account_label").agg(F.count(F.lit(1)).alias("done")).select("account_label", "done", F.round(F.try_divide(F.greatest(F.lit(100) - F.col("done"), F.lit(0)).cast("double"), F.col("done").cast("double")), 4).alias("eta"))
)
