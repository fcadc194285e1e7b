"""Ledgers made from the star-schema tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction a line item: part as description, type and brand as categories, segment as account."""
    li, o, c, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey)
    plus = F.col("l_returnflag") == "R"
    by_sign = lambda out, in_: F.when(plus, in_).otherwise(out)
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return joined.select(
        F.substring(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 256), 1, 24).alias("id"),
        (F.col("l_orderkey") % 20).alias("batch_id"),
        F.to_date("l_shipdate").alias("date"),
        by_sign(-F.col("l_extendedprice"), F.col("l_extendedprice")).cast(MONEY).alias("amount"),
        F.format_string("%s|%s", F.when(plus, "").otherwise("debit"), F.when(plus, "credit").otherwise("")).alias("raw_amount"),
        F.lit("EUR").alias("currency"),
        F.col("p_name").alias("description"),
        F.when(s % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("POS "), F.upper("p_name"))).alias("raw_description"),
        F.concat(F.lit("file_"), (F.col("l_orderkey") % 20).cast("string"), F.lit(".csv")).alias("source_file"),
        F.when(n == 6, "credit_card").otherwise("bank_account").alias("doc_type"),
        F.col("c_mktsegment").alias("account_label"),
        F.when(n == 7, by_sign("internal_out", "internal_in")).when(n == 6, "card_settlement").when((n == 5) & (F.col("l_returnflag") == "N"), "aggregate_debit")
        .when((n == 4) & (s % 7 == 0), F.lit(None)).otherwise(by_sign("expense", "income")).alias("tx_type"),
        F.when(s % 13 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("category"),
        F.when(s % 13 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("subcategory"),
        F.when(s % 3 == 0, "high").when(s % 3 == 1, "medium").otherwise("low").alias("category_confidence"),
        F.when(s % 5 == 0, "rule").when(s % 5 == 1, "llm").when(s % 5 == 2, "history").when(s % 5 == 3, "manual").alias("category_source"),
        F.when(s % 17 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("context"),
        (F.col("l_quantity") > 45).alias("to_review"),
        F.when(s % 4 == 0, F.lit(None)).otherwise(s % 4 == 1).alias("human_validated"),
    )


def by_sign(minus: str, plus: str) -> str:
    return f"CASE WHEN l_returnflag = 'R' THEN {plus} ELSE {minus} END"


LEDGER_SQL = f"""ledger AS (SELECT substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 24) AS id,
 CAST(l_orderkey % 20 AS BIGINT) AS batch_id, CAST(l_shipdate AS DATE) AS date,
 CAST({by_sign('-l_extendedprice', 'l_extendedprice')} AS DECIMAL(18,4)) AS amount,
 {by_sign("'debit|'", "'|credit'")} AS raw_amount, 'EUR' AS currency, p_name AS description,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 'POS ' || upper(p_name) END AS raw_description,
 'file_' || CAST(l_orderkey % 20 AS VARCHAR) || '.csv' AS source_file,
 CASE WHEN l_linenumber = 6 THEN 'credit_card' ELSE 'bank_account' END AS doc_type, c_mktsegment AS account_label,
 CASE WHEN l_linenumber = 7 THEN {by_sign("'internal_out'", "'internal_in'")} WHEN l_linenumber = 6 THEN 'card_settlement'
  WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN 'aggregate_debit' WHEN l_linenumber = 4 AND l_suppkey % 7 = 0 THEN NULL
  ELSE {by_sign("'expense'", "'income'")} END AS tx_type,
 CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE p_type END AS category, CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE p_brand END AS subcategory,
 CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS category_confidence,
 CASE l_suppkey % 5 WHEN 0 THEN 'rule' WHEN 1 THEN 'llm' WHEN 2 THEN 'history' WHEN 3 THEN 'manual' END AS category_source,
 CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS context, l_quantity > 45 AS to_review,
 CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 4 = 1 END AS human_validated
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def ledger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction an event; purchases and errors cost, the rest pays in."""
    e = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type").isin("purchase", "error"), -F.col("value")).otherwise(F.col("value"))
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.to_date("ts").alias("date"), amount.cast(MONEY).alias("amount"),
        F.concat(F.lit("acct"), F.col("user_id").cast("string")).alias("account_label"), F.col("event_type").alias("description"),
        F.lit("unknown").alias("tx_type"), "event_type", "ts",
    )


EVENTS_SQL = """ledger AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date,
 CAST(CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS DECIMAL(18,4)) AS amount,
 'acct' || CAST(user_id AS VARCHAR) AS account_label, event_type AS description, 'unknown' AS tx_type, event_type, ts FROM events)"""
