"""Stream queries: the events table arrives in files, and the stream runs over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import EVENTS_SQL, ledger_events, table
from ..streaming import monitor as M
from ..stored import new_folder
from .register import query


def poll_monitor(spark, sf_dir: str) -> DataFrame:
    """Every row arrives twice; each counts once."""
    base = new_folder(spark, "monitor")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("decimal(18,4)").alias("value"), (F.col("event_id") * 7 % 1000).alias("place"))
    M.split_files(e.unionByName(e.withColumn("place", F.col("place") * 3 % 1000)), f"{base}/in", 4, "place")
    counts = M.progress_counts(M.arriving(spark, f"{base}/in", e.schema), ["event_id"], ["event_type"])
    return M.run_once(counts, base).select("event_type", "n", F.col("total").cast("decimal(18,2)").alias("total"))


def daily(spark, sf_dir: str) -> DataFrame:
    base = new_folder(spark, "daily")
    rows = ledger_events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "account_label", "amount")
    M.split_files(rows, f"{base}/in", 4, "ts")
    out = M.run_once(M.daily_spending(M.arriving(spark, f"{base}/in", rows.schema)), base)
    return out.select(F.to_date("window.start").alias("day"), "account_label", "total", "n")


query("st_poll_monitor", "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1")(poll_monitor)
query("st_daily_spending", f"WITH {EVENTS_SQL} SELECT date AS day, account_label, CAST(sum(amount) AS DECIMAL(18,2)) AS total, count(*) AS n FROM ledger WHERE amount < 0 GROUP BY 1, 2")(daily)
query("st_stale_jobs", "SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'O' THEN 'error' WHEN 'F' THEN 'done' ELSE 'queued' END AS status FROM orders")(
    lambda spark, d: M.reset_stale(table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status")))
)
