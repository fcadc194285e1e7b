"""A stream that asks a model and keeps a log of what each call used, once a batch whatever is run again."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import Backend, ask

LOG = "backend string, model_id string, caller string, step string, batch_size long, prompt_tokens long, completion_tokens long, total_tokens long, duration_ms long"


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def usage(answers: DataFrame, caller: str, step: str, fields: list[str], duration_ms: int = 0) -> DataFrame:
    """One log row a backend: prompts, and words of prompts and answers as tokens."""
    said = F.concat_ws(" ", *fields)
    return answers.groupBy("backend").agg(F.count(F.lit(1)).alias("batch_size"), F.sum(words(F.col("prompt"))).alias("prompt_tokens"), F.sum(words(said)).alias("completion_tokens")).select(
        "backend", F.col("backend").alias("model_id"), F.lit(caller).alias("caller"), F.lit(step).alias("step"), "batch_size", "prompt_tokens", "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"), F.lit(duration_ms).cast("long").alias("duration_ms"),
    )


def ask_stream(rows: DataFrame, prompt: str, backends: list[Backend], fields: list[str], path: str, caller: str, step: str, most_batches: int | None = None) -> None:
    """Asks for each new row's prompt; answers and log go to ``path/answers`` and ``path/usage``, a folder a batch.

    A batch that is run again after a failure writes the same folders again, so
    nothing is counted twice. ``most_batches`` ends the run after so many, which
    a later run takes up where this one stopped.
    """
    done = 0

    def each(df: DataFrame, batch: int) -> None:
        nonlocal done
        if most_batches is not None and done >= most_batches:
            raise _Enough
        began = time.time()
        at = f"batch={batch:09d}"
        ask(df, F.col(prompt), backends, fields).write.mode("overwrite").parquet(f"{path}/answers/{at}")
        answers = df.sparkSession.read.parquet(f"{path}/answers/{at}")
        usage(answers, caller, step, fields, int((time.time() - began) * 1000)).write.mode("overwrite").parquet(f"{path}/usage/{at}")
        done += 1

    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if most_batches is None or done < most_batches:
            raise


class _Enough(Exception):
    """The run has had its batches."""


def logged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LOG}, batch long").option("basePath", f"{path}/usage").parquet(f"{path}/usage/batch=*")
