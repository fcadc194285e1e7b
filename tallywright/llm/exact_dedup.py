"""Exact duplicates with a heavy-hitter split.

Misra-Gries summaries of the digests, one a partition, are merged by key; what
passes the merged threshold is counted exactly. The verified winners, at most
``counters`` of them, are broadcast, so their rows never shuffle; all other
digests are grouped and joined in the ordinary way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_number, saved

COUNTERS = 1024


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, sha): SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    plain = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(plain.cast("binary"), 256)).alias("sha"))


def misra_gries(counters: int):
    """A partition's summary: at most ``counters`` keys, each undercounted by rows/(counters+1) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for b in batches:
            for x in pc.value_counts(b.column(0)).to_pylist():
                kept[x["values"]] = kept.get(x["values"], 0) + x["counts"]
            if len(kept) > counters:
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = {k: n - cut for k, n in kept.items() if n > cut}
        yield pa.record_batch([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["sha", "n"])

    return run


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(sha, group_size, keep_id, at_top) of the digests that more than about 2/counters of the rows share.

    Merged summaries miss rows/(counters+1) of a key at most, so each such key
    passes the threshold, and no more than counters+1 keys can.
    """
    total = rows.count()
    if not total:
        return rows.limit(0).select("sha", F.lit(0).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"))
    likely = (
        rows.select("sha").mapInArrow(misra_gries(counters), "sha binary, n long")
        .groupBy("sha").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(total // (counters + 1))).where("n > 1")
    )
    counted = rows.join(F.broadcast(saved(likely.select("sha"))), "sha")
    return saved(counted.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")))


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null texts are equal
    to empty ones. Null ids lose to any other. Where the winning id itself is
    repeated within a group (a tie), exactly one of its rows is kept; such rows
    are equal in every returned column. Texts of any length are hashed whole,
    other columns are not read, and an empty table gives an empty result.
    """
    rows = saved(digests(docs))
    heavy = F.broadcast(heavy_digests(rows, counters))
    light = rows.join(heavy.select("sha"), "sha", "left_anti")
    groups = light.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    joined = rows.join(heavy, "sha").unionByName(light.join(groups, "sha"))
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeated = saved(rows.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    out = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")]
    if repeated.isEmpty():
        return joined.withColumn("kept", wins).select(*out)
    # interchangeable rows: keep the first of each winning id by counting them out again
    same = (F.col("r.sha") == F.col("j.sha")) & F.col("r.doc_id").eqNullSafe(F.col("j.doc_id"))
    rest = joined.alias("j").join(repeated.alias("r"), same & F.col("j.doc_id").eqNullSafe(F.col("j.keep_id")), "left_anti").withColumn("kept", wins)
    facts = heavy.unionByName(groups)
    tied = each_number(repeated.join(facts, "sha").where(wins), "n", "i").withColumn("kept", F.col("i") == 0)
    return rest.select(*out).unionByName(tied.select(*out))
