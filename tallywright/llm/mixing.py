"""Mixing sources to target weights by weighted fair queueing.

Every document is offered twice. Within a source the offers are shuffled by a
hash, and an offer's virtual finish time is the source's tokens up to and
including it, divided by the source's target. All offers are then put in one
order by that time and taken while the running total stays within the budget.

Both running totals are two-level: sums of fine ranges first, then a window
inside each range, so that no source and no total order sits in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, saved, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5  # times all tokens
REPEATS = 2
#: Hash ranges of a source, and ranges of virtual time up to the cut. A range
#: holds about 1/RANGES of its source's (of all) tokens whatever the skew.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target): water-filling of the budget under the caps.

    Weights repeat over the sources in code-point order, null last. Raising one
    level L, each target is min(cap, L * weight); sorted by cap/weight, the
    sources that stop at their caps are a prefix, found by running sums. One
    row a source goes through these windows.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    named = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * repeats)
    upto = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = F.try_divide(
        F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0))).cast("double"),
    )
    # the level if this source and all after it are below their caps; too small a level means it is capped
    tried = named.withColumn("level", level)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    final = F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything)
    return tried.withColumn("final", final.getField("level")).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")), F.col("cap").cast("double")).alias("target")
    )


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including the row, over ``keys`` in order of bucket, then ``order``."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    match = F.col(bucket) == F.col("_bucket")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_inside", F.sum(value).over(inside)).join(offsets, match).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket", *[f"_{k}" for k in keys])


def _taken(docs: DataFrame, weights: tuple[int, ...], budget: float, repeats: int) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row."""
    sizes = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))
    targets = saved(source_targets(sizes, weights, budget, repeats))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"]
    shuffled = sizes.withColumn("draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.conv(F.substring("draw", 1, 3), 16, 10).cast("long"))
    ordered = _running(shuffled, ["source"], "bucket", ["draw", F.col("doc_id"), "size"], "size", "upto")
    rated = saved(ordered.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "bucket"))
    offers = rated.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"))
    offers = offers.withColumn("finish", (F.col("upto") + F.col("source_size") * F.col("round")).cast("double") / F.col("target"))
    # doublings of virtual time, one row each: what ends after the first by which the budget is used up can never be taken
    doubling = F.ceil(F.log2("finish"))
    upto, used = 0, 0
    for r in sorted(offers.groupBy(doubling.alias("d")).agg(F.sum("size").alias("n")).collect()):
        if used > budget * total:
            break
        upto, used = r["d"], used + r["n"]
    offers = offers.where(doubling <= upto).withColumn("range", F.floor(F.col("finish") / F.lit(2.0**upto) * (2 * RANGES)).cast("long"))
    queued = _running(offers, [], "range", ["finish", F.col("source").asc_nulls_last(), "draw", "doc_id", "round"], "size", "queue")
    took = queued.where(F.col("queue") <= F.lit(float(budget) * total)).groupBy("doc_id", "source", "upto").agg(F.sum("size").alias("taken"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.upto") == F.col("t.upto"))
    return rated.alias("r").join(took.alias("t"), same & (F.col("r.size") > 0), "left").select(
        "r.doc_id", "r.source", "r.size", "r.source_size", "r.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` is 0, 1 or 2 times the size. The order is fixed by a hash of the
    id, so reruns agree; rows that share an id are ordered by size, and equal
    ones are interchangeable. Null texts count as empty, a null id is an id and
    a null source a source of its own. A source with no words takes none. Texts
    of any length are counted whole, other columns are not read, and an empty
    table gives an empty result.
    """
    return _taken(docs, weights, budget, repeats).drop("source")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; documents without words go.

    Where rows agree in id, source and size but are not all taken alike, they
    are numbered in the shared folder and the first of them get the larger takes.
    """
    rounds = range(1, repeats + 1)
    keys = ["_tw_id", "_tw_source", "_tw_size"]
    took = _taken(docs, weights, budget, repeats).where("size > 0").groupBy(F.col("doc_id").alias("_tw_id"), F.col("source").alias("_tw_source"), F.col("size").alias("_tw_size"))
    took = took.agg(F.count(F.lit(1)).alias("_tw_n"), *[F.count_if(F.col("taken") >= F.col("size") * k).alias(f"_tw_{k}") for k in rounds]).where("_tw_1 > 0")
    even = reduce(lambda a, b: a & b, [(F.col(f"_tw_{k}") == 0) | (F.col(f"_tw_{k}") == F.col("_tw_n")) for k in rounds])
    took = saved(took.withColumn("_tw_even", even))
    times = lambda rank: reduce(add, [(rank <= F.col(f"_tw_{k}")).cast("int") for k in rounds])
    sized = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), word_count(F.col("text").cast("string")).alias("words"))
    match = F.col("id").eqNullSafe(F.col("_tw_id")) & F.col("from").eqNullSafe(F.col("_tw_source")) & (F.col("words") == F.col("_tw_size"))
    joined = sized.join(took.hint("shuffle_hash"), match).drop("id", "from", "words")
    out = joined.where("_tw_even").withColumn("_tw_times", times(F.col("_tw_n")))
    if not took.where("not _tw_even").isEmpty():
        ranked = numbered(joined.where("not _tw_even"), keys)
        out = out.unionByName(ranked.withColumn("_tw_times", times(F.col("_tw_rank"))).drop("_tw_rank"))
    return out.where("_tw_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_tw_times")))).select("row.*")
