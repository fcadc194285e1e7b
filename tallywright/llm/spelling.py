"""Spelling variants of words by anagram hashing.

A word's value is the sum of a power of its letters' code points, so anagrams
share it and one added, removed or exchanged letter changes it by that letter's
value. Two words that differ by one letter agree in the value that is left when
one letter is taken from each (exchange) or from the longer one (addition,
removal). Each word offers its own value and its value less each of its letters,
and equal offers of equal length meet in an equality join. As the one edit
leaves the first or the second half of what is shared untouched, that half is
part of the key: an offer meets words that hold the same letters and the same
half, not all anagrams. The order of the letters is verified for every pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: One occurrence in so many, by checksum, loses a letter.
NOISE = 199
LETTERS = 6
TIMES = 5
#: A form has at least so many times the occurrences of its variant.
RATIO = 5
#: Values are sums modulo this prime, so a word may have any length.
PRIME = (1 << 61) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """(word, n): the distinct words of at least ``letters`` code points that occur at least ``times`` times in all documents."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    made = runs.where(F.length("run") >= letters).withColumn("h", h).select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
    return made.where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _value(letter: Column) -> Column:
    """The letter's code point to the fifth power: under 2^41 for the letters of a run."""
    x = F.ascii(letter).cast("long")
    return x * x * x * x * x


def offers(vocabulary: DataFrame) -> DataFrame:
    """(value, left, side, half, word, n, whole): what a word shares with its neighbours.

    ``value`` and ``left`` are the value and the number of the letters that are
    left, ``half`` a hash of the first or last of them, ``whole`` says that no
    letter was taken.
    """
    sums = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda acc, c: F.pmod(acc + _value(c), F.lit(PRIME)))
    valued = vocabulary.select("word", "n", F.length("word").alias("k"), sums.alias("sum"), F.array_distinct(F.split("word", "")).alias("letters"))
    taken = F.concat(F.array(F.lit("")), F.col("letters"))
    each = valued.select("word", "n", "k", "sum", F.explode(taken).alias("letter"))
    left = F.col("k") - F.length("letter")
    first = (left / 2).cast("int")
    each = each.select("word", "n", "k", left.alias("left"), first.alias("first"), (F.col("letter") == "").alias("whole"), F.when(F.col("letter") == "", F.col("sum")).otherwise(F.pmod(F.col("sum") - _value(F.col("letter")), F.lit(PRIME))).alias("value"))
    halves = F.array(
        F.struct(F.lit("first").alias("side"), F.xxhash64(F.substring("word", F.lit(1), F.col("first"))).alias("half")),
        F.struct(F.lit("last").alias("side"), F.xxhash64(F.substring("word", F.col("k") - (F.col("left") - F.col("first")) + 1, F.col("left") - F.col("first"))).alias("half")),
    )
    return each.select("value", "left", "first", F.explode(halves).alias("h"), "word", "n", "whole").select("value", "left", "first", "h.side", "h.half", "word", "n", "whole")


def _common(a: str, b: str) -> Column:
    """How many first letters a and b share, by halving steps."""
    same = lambda at, k: (F.length(a) >= at + k) & (F.length(b) >= at + k) & (F.substring(F.col(a), at + 1, k) == F.substring(F.col(b), at + 1, k))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(29))]), F.lit(0), lambda at, k: F.when(same(at, k), at + k).otherwise(at))


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each unordered pair of words one inserted, deleted or replaced code point apart, once.

    Two words meet under more than one key only if the edit's place leaves both
    halves untouched; there the first half counts. A key is one edit's letters
    and half, so verified pairs need no ``distinct``.
    """
    sides = saved(offers(vocabulary))
    keys = ["value", "left", "side", "half"]
    shared = sides.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*keys)
    kept = saved(sides.join(shared, keys, "left_semi"))
    left = kept.select(*keys, "first", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("whole").alias("w_a"))
    right = kept.select(*keys, F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("whole").alias("w_b"))
    # an exchange is met once, from its smaller word; an addition from its shorter one, which takes no letter
    once = (~F.col("w_a") & ~F.col("w_b") & (F.col("a") < F.col("b"))) | (F.col("w_a") & ~F.col("w_b"))
    met = left.join(right, keys).where(once).withColumn("at", _common("a", "b"))
    rest = lambda c, skip: F.substring(F.col(c), F.col("at") + 1 + skip, F.length(c))
    verified = met.where(rest("b", F.lit(1)) == F.when(F.col("w_a"), rest("a", F.lit(0))).otherwise(rest("a", F.lit(1))))
    return verified.where((F.col("side") == "first") == (F.col("at") >= F.col("first"))).select("a", "n_a", "b", "n_b")


def variants(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null texts have no words, a null id counts as the empty text in the
    checksum, repeated rows and ids count as often as they stand there, and of
    near words with equal n the smaller in code-point order is the form. Texts
    and words of any length are read whole, other columns are not read, and an
    empty table gives an empty result.
    """
    vocabulary = saved(words(docs, letters, times))
    pairs = saved(near_pairs(vocabulary))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.first("n").alias("n"), best)
    fits = -F.col("best.m") >= F.col("n") * ratio
    near = saved(near.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    steps = saved(near.where("form is not null").select("word", F.col("form").alias("root"), "form_n"))
    most = steps.agg(F.max("form_n").alias("m")).first()["m"] or 1
    # every step multiplies n by the ratio, so a path is short; a round doubles what is known of it
    longest = max(1, math.ceil(math.log(max(1, most / times), max(ratio, 2))) + 1)
    roots = steps.select("word", "root")
    for _ in range(math.ceil(math.log2(longest)) + 1):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = saved(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    out = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
