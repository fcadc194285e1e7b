"""Sharding by extendible hashing.

A document's hash prefix names its shard. All start in the shard of the empty
prefix; a shard over the byte limit splits on one more bit, and only it. Since
the bytes under a prefix never grow with its length, a document's depth is the
first length at which its prefix fits, so all splits of many levels come from
one aggregate: the bytes of fine leaves, rolled up to their ancestors. Leaves
that still do not fit go through the next levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_number, numbered, saved

LIMIT = 1 << 20
HASH_BITS = 62
#: Directory bits beyond the mean shard number.
SLACK = 4


_NAMES = ("shard_id", "depth", "page", "doc_bytes", "shard_bytes")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, HASH_BITS - depth)


def _placed(docs: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """(doc_id, doc_bytes, shard_id, depth, shard_bytes, over) of each row, and whether rows may be ``over``:
    in a shard that has no more bits to split on."""
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 64 - HASH_BITS)
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes().alias("doc_bytes")).withColumn("h", h))
    total = rows.agg(F.coalesce(F.sum("doc_bytes"), F.lit(0)).alias("t")).first()["t"]
    base, step = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SLACK))
    active, done = rows, []
    while True:
        deep = min(HASH_BITS, base + step)
        leaves = active.groupBy(_prefix(F.col("h"), deep).alias("leaf")).agg(F.sum("doc_bytes").alias("b"))
        ancestors = lambda lo: leaves.select("leaf", "b", F.explode(F.sequence(F.lit(lo), F.lit(deep))).alias("d")).withColumn("p", F.expr(f"shiftrightunsigned(leaf, {deep} - d)"))  # noqa: E731, B023
        fit = saved(ancestors(base).groupBy("d", "p").agg(F.sum("b").alias("shard_bytes")).where((F.col("shard_bytes") <= limit) | (F.col("d") == HASH_BITS)))
        # no prefix shorter than this fits, so the join below has no key with more than a few leaves
        start = fit.agg(F.min("d").alias("d")).first()["d"]
        first = F.min(F.struct("d", "p", "shard_bytes"))
        up = ancestors(deep if start is None else start)
        directory = saved(up.join(fit, ["d", "p"]).groupBy("leaf").agg(first.alias("f")).select("leaf", F.col("f.d").alias("depth"), F.col("f.p").alias("prefix"), "f.shard_bytes"))
        placed = active.withColumn("leaf", _prefix(F.col("h"), deep)).join(directory, "leaf", "left").drop("leaf")
        done.append(placed.where("depth is not null"))
        if deep == HASH_BITS or leaves.join(directory, "leaf", "left_anti").isEmpty():
            break
        active, base = saved(placed.where("depth is null").select(*rows.columns)), deep
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    bits = F.substring(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(HASH_BITS + 1) - F.col("depth"), F.col("depth"))
    out = out.withColumn("shard_id", F.when(F.col("depth") == 0, "").otherwise(bits)).withColumn("over", (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit))
    return out.drop("h", "prefix"), deep == HASH_BITS


def _bytes() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def _paged(rows: DataFrame, limit: int, at: str) -> DataFrame:
    """Pages of rows that share id and size: ``at`` is a row's number from 0 on, ``n`` how many there are."""
    per = F.when(F.col("doc_bytes") == 0, F.col("n")).otherwise(F.greatest(F.lit(1).cast("long"), F.floor(F.try_divide(F.lit(limit), F.col("doc_bytes")))))
    out = rows.withColumn("per", per).withColumn("page", F.floor(F.col(at) / F.col("per")))
    out = out.withColumn("shard_bytes", F.least(F.col("per"), F.col("n") - F.col("page") * F.col("per")) * F.col("doc_bytes"))
    name = F.concat("shard_id", F.lit("+"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("doc_bytes").cast("string"), F.lit("."), F.col("page").cast("string"))
    return out.withColumn("shard_id", name)


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, shard_id, depth, page, doc_bytes, shard_bytes.

    ``shard_id`` is the prefix as binary digits (and ``+id:bytes.page``, see
    below). A document over the limit, however long, stands alone in its shard.
    Rows of one id share all bits of the hash; if together they are over the
    limit, those of one size get numbered pages, counted out from their number,
    as interchangeable rows. Null text has 0 bytes, a null id is an id of its
    own; an empty table gives an empty result; other columns are not read.
    """
    out, deep = _placed(docs, limit)
    whole = out.where("not over").withColumn("page", F.lit(0).cast("long")).select("doc_id", *_NAMES)
    if not deep:
        return whole  # nothing got as deep as the whole hash
    same = out.where("over").groupBy("doc_id", "shard_id", "depth", "doc_bytes").agg(F.count(F.lit(1)).alias("n"))
    counted = each_number(same, "n", "i")
    return whole.unionByName(_paged(counted, limit, "i").select("doc_id", *_NAMES))


def sharded_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every row of ``docs`` in its shard: ``row`` (all its columns), then shard_id, depth, page, doc_bytes, shard_bytes as by ``shards``.

    A row finds its shard by its id; rows over the limit together are numbered
    in the shared folder, and so their pages are those of ``shards``.
    """
    out, deep = _placed(docs, limit)
    by_id = saved(out.groupBy(F.col("doc_id").alias("_tw_id")).agg(F.first(F.struct("shard_id", "depth", "shard_bytes", "over")).alias("at")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _bytes().alias("doc_bytes"))
    joined = rows.join(by_id.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_tw_id"))).select("row", "doc_id", "doc_bytes", "at.*")
    whole = joined.where("not over").withColumn("page", F.lit(0).cast("long")).select("row", *_NAMES)
    if not deep:
        return whole
    each = numbered(joined.where("over").drop("over"), ["doc_id", "doc_bytes"])
    n = each.groupBy(F.col("doc_id").alias("_n_id"), F.col("doc_bytes").alias("_n_bytes")).agg(F.max("_tw_rank").alias("n"))
    each = each.join(n, F.col("doc_id").eqNullSafe(F.col("_n_id")) & (F.col("doc_bytes") == F.col("_n_bytes"))).withColumn("i", F.col("_tw_rank") - 1)
    return whole.unionByName(_paged(each, limit, "i").select("row", *_NAMES))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes the documents as one folder a shard, each with the whole ``row``; no folder is over the limit but by a single document.

    Folders are ``path/shard_id=s<digits>/``, as bare digits would be read back as numbers.
    """
    sharded_documents(docs, limit).select("row", F.concat(F.lit("s"), "shard_id").alias("shard_id")).repartition("shard_id").write.partitionBy("shard_id").mode("overwrite").parquet(path)
