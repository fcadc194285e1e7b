"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is eight bytes. Two fingerprints that differ in at
most four bits differ in at most four bytes, so the index holds each
fingerprint with four of its bytes deleted, in all 70 ways; a key is 32 bits
and the way. Members of equal keys are verified by the full distance: first all
of a key against one of them, which joins a group of copies by a star in place
of all its pairs, then those of a key that are still of different classes
against each other. Unlike keys of some 20 bits, which by chance alone are
shared by a number of texts that grows with the square of all, keys of 32 bits
are shared by few but near ones (of 10^6 fingerprints, some 8000 pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Stored, connected_components, saved, with_classes

#: The bytes that a key keeps, 0 the lowest: as many as may differ are deleted.
KEPT = tuple(combinations(range(8), 4))
MAX_BITS = 4
SHINGLE = 4
SEED = 42
_BLOCK = 1 << 15


def majority(count: np.ndarray, hashes: np.ndarray) -> None:
    """Adds to ``count`` how many of the hashes have each of the 64 bits set."""
    count += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def packed(count: np.ndarray, n: int) -> int:
    """The bits set in over half of ``n`` hashes."""
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of one text, as an unsigned 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()
    k = min(shingle, len(words))
    n = len(words) - k + 1
    count = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        j = min(n, i + _BLOCK)
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[i:j], last[i + k - 1 : j + k - 1])), np.uint64, j - i)
        majority(count, h)
    return packed(count, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row; a null or wordless text has fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _byte(x: Column, i: int) -> Column:
    return F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _keys(fp: Column) -> Column:
    out = []
    for way, kept in enumerate(KEPT):
        key = F.lit(way << 32).cast("long")
        for place, i in enumerate(kept):
            key = key.bitwiseOR(F.shiftleft(_byte(fp, i), 8 * place))
        out.append(key)
    return F.array(*out)


def _first_shared(x: Column) -> Column:
    """The first way in which a pair with this XOR meets, of all the keys it shares; null without any."""
    first = [next((way for way, kept in enumerate(KEPT) if not any(mask >> i & 1 for i in kept)), None) for mask in range(256)]
    mask = F.lit(0)
    for i in range(8):
        mask = mask + F.when(_byte(x, i) != 0, 1 << i).otherwise(0)
    return F.get(F.array(*[F.lit(way).cast("long") for way in first]), mask)


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MAX_BITS


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, fp, low) of the distinct nodes (node, fp), both longs, that share a key with another; low: the least (node, fp) of the key.

    Spark takes what an explode makes for as large as what it got, and would broadcast 70 times a small table; so the join is a merge.
    """
    keyed = nodes.select("node", "fp", F.explode(_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return saved(keyed.hint("merge").join(shared.hint("merge"), "key").select("key", "node", "fp", "low"))


def star_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) at most MAX_BITS apart of which one is the least of a key they share: as many as keys and members at most."""
    return members.where((F.col("node") != F.col("low.node")) & _near("fp", "low.fp")).select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()


def fingerprint_classes(nodes: DataFrame) -> DataFrame:
    """(node, root) of the distinct nodes (node, fp), both longs, over links at most MAX_BITS apart; nodes without a link may be missing.

    A key's members meet only where its classes differ, and there those of its
    largest class do not meet each other; a pair is found under one of its keys only.
    """
    members = bucket_members(nodes)
    stars = Stored(connected_components(star_pairs(members))).df
    now = saved(members.join(stars, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root")))
    kinds = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = saved(now.join(kinds.select("key", "most"), "key"))
    left = mixed.where("root <> most").select("key", F.col("fp").alias("fp_a"), F.col("root").alias("a"))
    right = mixed.select("key", F.col("fp").alias("fp_b"), F.col("root").alias("b"))
    once = F.shiftrightunsigned("key", 32) == _first_shared(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    links = left.join(right, "key").where((F.col("a") != F.col("b")) & _near("fp_a", "fp_b") & once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _moved(stars, connected_components(links))


def _moved(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after classes were joined: links (node, root) over roots, and over nodes that had none."""
    to = links.select(F.col("node").alias("root"), F.col("root").alias("to"))
    alone = links.join(roots.select("node"), "node", "left_anti")
    return Stored(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(alone)).df


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable), root (a fingerprint that names the class).

    Null texts count as empty; empty texts share fingerprint 0 and one class.
    Repeated rows stay repeated. Null ids never become a component_id unless a
    class has no other. A text of any length is read whole. Other columns are
    not read. An empty table gives an empty result.
    """
    rows = saved(fingerprints(docs))
    roots = fingerprint_classes(rows.select(F.col("fp").alias("node"), "fp").distinct()).withColumnRenamed("node", "fp")
    return with_classes(rows, roots)


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_duplicates, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row of ``docs`` for each class: that of the id which names it; of rows alike in id and fingerprint, any.

    Where an id (or null) stands for several texts, rows are told apart by id
    and fingerprint. Another kind of class comes with ``mark``, its fp of a text.
    """
    near = saved(classes(docs))
    named = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = saved(named.groupBy("root").agg(F.min(F.struct("fp", "doc_id")).alias("k"), F.count(F.lit(1)).alias("rows")).select("k.doc_id", "k.fp", "rows"))
    whole = docs.select(F.struct("*").alias("row"))
    shared = near.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
    if shared.isEmpty():
        kept = whole.join(keep.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")))
    else:
        texts = docs.select(F.struct("*").alias("row"), (mark or _fingerprint_column)(F.col("text").cast("string")).alias("at"))
        kept = texts.join(keep.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("fp")))
    if keep.where("rows > 1").isEmpty():
        return kept.select("row.*")
    # rows alike in id and fingerprint: the class keeps one of them
    return kept.where("rows = 1").select("row.*").unionByName(kept.where("rows > 1").dropDuplicates(["doc_id", "fp"]).select("row.*"))


@F.pandas_udf(LongType())
def _fingerprint_column(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
