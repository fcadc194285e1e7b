"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A local session that names none gets a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tallywright-")


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: it cuts the lineage and outlives a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Stored:
    """A table written to the shared folder. Unlike a checkpoint it carries no estimates along, which rounds of joins would multiply to numbers of many digits."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/tallywright-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        """Once nothing reads the table any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freed() -> None:
    """Gives memory that training or a task's batches used back to the system, which Arrow and the C library otherwise keep for later.

    Spark's Python workers outlive their tasks, so what a task leaves there
    stands beside all later stages of the executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(spark: SparkSession) -> None:
    """Lets go of plans, broadcast tables and shuffles that nothing names any more: first the driver's Python, which holds them by cycles, then its JVM.

    A broadcast table takes some MB of the driver however few its rows, and
    stays until the JVM collects all its garbage, which Spark itself asks for
    every ``spark.cleaner.periodicGC.interval`` (30 minutes). Until then a loop
    of many small joins fills the heap.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch whose texts are Python strings at once.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, SLICE at a time; after the last, the task's memory is given back."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)
        del b
    freed()


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even where body's lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out. A null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


#: A key is heavy if it has more than this share of the rows; so there are fewer than 1/HEAVY of them.
HEAVY = 1 / 1000


def joined_by_heavy(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row a key; ``facts.n`` is the number of rows the key has.

    Fewer than 1000 keys can have more than a thousandth of the rows. Their
    facts are broadcast, so that no task gets a hot key; the others shuffle.
    Both inputs are read twice, so they come checkpointed.
    """
    total = facts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    hot = F.col(n) > F.lit(total * HEAVY)
    heavy = F.broadcast(saved(facts.where(hot)))
    few = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(facts.where(~hot), key)
    return rows.join(heavy, key).unionByName(few)


def numbered(rows: DataFrame, keys: list[str], name: str = "_tw_rank") -> DataFrame:
    """Adds a number from 1 on to the rows of each key, without bringing a key's rows to one task.

    The rows are checkpointed first, so their order is a fact of the stored
    files and not of a run. Keys may be null.
    """
    at = saved(rows.withColumn("_tw_at", F.monotonically_increasing_id())).withColumn("_tw_part", F.shiftrightunsigned("_tw_at", 33))
    counts = at.groupBy(*keys, "_tw_part").agg(F.count(F.lit(1)).alias("_tw_n"))
    before = F.coalesce(F.sum("_tw_n").over(Window.partitionBy(*keys).orderBy("_tw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_tw_part").alias("_o_part"), before.alias("_tw_before"))
    same = F.col("_tw_part") == F.col("_o_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_tw_part").orderBy("_tw_at"))
    out = at.withColumn("_tw_inside", inside).join(offsets, same).withColumn(name, F.col("_tw_before") + F.col("_tw_inside"))
    return out.select(*rows.columns, name)


#: Numbers that one row makes at a time.
NUMBERS = 1 << 16


def each_number(rows: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each number from 0 to ``n`` - 1 of each row, in two steps with the rows dealt out between, so that no row or task makes all of a hot key's."""
    parts = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / NUMBERS).cast("long"))).alias("_tw_chunk"))
    dealt = parts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    low = F.col("_tw_chunk") * NUMBERS
    return dealt.select("*", F.explode(F.sequence(low, F.least(F.col(n), low + NUMBERS) - 1)).alias(name)).drop("_tw_chunk")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected graph given as (a, b) longs.

    Random-priority contraction: each round every node moves to the neighbour
    with the smallest hashed priority (or stays), the edges are rewritten to
    the new names, and loops and repeats go. The expected number of rounds is
    logarithmic in the longest path. Every round is joins and pre-aggregated
    minima over the remaining edges; only "are edges left" reaches the driver.
    """
    at = Stored(edges.where("a != b").distinct())
    moves: list[DataFrame] = []
    while not at.df.isEmpty():
        edges = at.df
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("p"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.select("a", "b").union(edges.select("b", "a"))
        move = Stored(
            both.groupBy("a").agg(F.min(rank("b")).alias("m"))
            .select(F.col("a").alias("node"), F.least("m", rank("a")).getField("n").alias("to"))
        ).df
        moves.append(move)
        to = lambda c: move.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: E731, B023
        last, at = at, Stored(
            edges.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        )
        last.remove()
        tidied(edges.sparkSession)
    edges = at.df
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].withColumnRenamed("to", "root")
    for m in moves[1:]:
        out = out.join(m.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def with_classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id, root) for rows (doc_id, fp) and roots (fp, root); a fingerprint without a root is its own.

    component_id is the smallest doc_id of the class. A fingerprint or a class
    may hold any share of the rows.
    """
    each = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = saved(each.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    classes = saved(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")))
    names = saved(joined_by_heavy(named, classes, "root", "members").select("fp", "n", "component_id", "root"))
    return joined_by_heavy(rows, names, "fp", "n").select("doc_id", "fp", "component_id", "root")
