"""Streams over result files and transactions.

The monitor counts result rows as files arrive, each key once. Daily spending
by event time, with a watermark, goes beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def arriving(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Rows of parquet files as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def progress_counts(rows: DataFrame, keys: list[str], by: list[str], ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts by group, each key once. With an event time the keys seen are forgotten after the delay, else they are all kept."""
    once = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if ts else rows.dropDuplicates(keys)
    return once.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def daily_spending(rows: DataFrame, delay: str = "2 days") -> DataFrame:
    """Spending by day of the event and account; a day closes once the watermark has passed it."""
    spent = rows.withWatermark("ts", delay).where("amount < 0")
    return spent.groupBy(F.window("ts", "1 day"), "account_label").agg(F.sum("amount").cast("decimal(18,2)").alias("total"), F.count(F.lit(1)).alias("n"))


def run_once(result: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result, written as Parquet.

    Complete mode rewrites the result at each trigger, into a folder of its
    own, so that a reader never sees half of it; append mode adds files.
    """
    spark = result.sparkSession
    out, state = f"{path}/out", f"{path}/state"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i:06d}")).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(result.schema).parquet(out)
    return latest(spark, out, result.schema)


def latest(spark: SparkSession, out: str, schema) -> DataFrame:
    """The rows of the last batch."""
    all_ = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).option("basePath", out).parquet(f"{out}/batch=*")
    last = all_.agg(F.max("batch").alias("b")).first()["b"]
    return all_.where(F.col("batch") == F.lit(last)).drop("batch")


def split_files(df: DataFrame, path: str, n: int, by: str) -> str:
    """Writes a table as n files, by ranges of a column: what a stream then takes one by one."""
    df.repartitionByRange(n, by).write.parquet(path)
    return path


def reset_stale(jobs: DataFrame) -> DataFrame:
    """Jobs still running from a former session end as errors."""
    return jobs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status")))
