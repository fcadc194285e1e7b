"""Rule tables of any size, by an index of what a text must hold.

A text that matches a pattern holds certain characters: all of a plain pattern,
the longest literal of a regular expression. Of its grams of three characters
the one in fewest texts is the rule's key; texts offer all of their grams; rule
and text meet where these are equal, and only there the pattern itself is
tried. Patterns without a literal meet all texts, in blocks of rules.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..stored import saved

GRAM = 3
#: Rules without a literal that a text is tried with at once.
BLOCK = 256


def literal(pattern: str | None) -> str | None:
    """The longest stretch of ASCII characters, lower-case, that a match in any case must hold; '' if none is sure, null if the pattern must be looked at.

    Only syntax that reads alike in Python and Java is judged.
    """
    if pattern is None:
        return ""
    plain = re.sub(r"\\[dDwWsSbB.\\+*?()\[\]{}|^$/\-]", "", pattern)
    if "\\" in plain or re.search(r"\(\?(?!:)|&&|\[[^\]]*\[|[*+?}]\+|\[\]|\[\^\]", pattern):
        return None
    try:
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    runs, now = [""], []

    def cut() -> None:
        runs.append("".join(now))
        now.clear()

    def walk(items) -> None:
        for op, arg in items:
            if op is K.LITERAL and arg < 128:
                now.append(chr(arg).lower())
            elif op is K.SUBPATTERN:
                walk(arg[3])
            elif op is K.AT:
                continue
            elif op is K.MAX_REPEAT and arg[0] >= 1:
                cut()
                walk(arg[2])
                cut()
            else:
                cut()

    walk(tree)
    cut()
    return max(runs, key=len)


@F.pandas_udf(StringType())
def _literals(patterns: pd.Series) -> pd.Series:
    return patterns.map(literal)


def compiles(pattern: str) -> bool:
    """Whether the regular expressions of the engine can read the pattern."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except IllegalArgumentException:
        return False


def grams(text: Column) -> Column:
    """The distinct stretches of one to GRAM characters, as keys of plain patterns that short; of GRAM characters for the others."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def _longest(text: Column) -> Column:
    """The grams of a literal that can be its key: those of GRAM characters, or itself if it is shorter."""
    n = F.length(text)
    return F.when(n < GRAM, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))))


def prepared(rules: DataFrame) -> DataFrame:
    """rules (rule, pattern, kind, ...) with ``must``, the literal to look for: '' if there is none. A regex that does not compile is left out.

    Patterns whose syntax ``literal`` does not judge are few; they pass through
    the driver one at a time, which keeps the broken ones only.
    """
    found = saved(rules.withColumn("must", F.when(F.col("kind") == "regex", _literals("pattern")).otherwise(F.lower("pattern"))))
    odd = found.where("kind = 'regex' and must is null").select("pattern").distinct()
    bad = [(r["pattern"],) for r in odd.toLocalIterator() if not compiles(r["pattern"])]
    out = found.join(rules.sparkSession.createDataFrame(bad, "pattern string"), "pattern", "left_anti") if bad else found
    return out.withColumn("must", F.coalesce("must", F.lit("")))


def _hit() -> Column:
    text = F.lower("text")
    low = F.lower("pattern")
    return F.when(F.col("kind") == "exact", text == low).when(F.col("kind") == "contains", F.contains(text, low)).otherwise(F.regexp("text", F.when(F.col("kind") == "regex", F.concat(F.lit("(?i)"), "pattern")).otherwise(F.lit(""))))


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, and all columns of rules): every rule with every text that it matches, without regard to case.

    texts: (text), distinct, not null. rules: (pattern, kind, ...), kind being
    exact, contains or regex. An empty plain pattern is in every text.
    """
    columns = rules.columns
    ready = saved(prepared(rules).withColumn("_r", F.monotonically_increasing_id()))
    keyed = ready.where((F.col("must") != "") & (F.col("kind") != "exact"))
    offered = texts.select("text", F.explode(grams(F.lower("text"))).alias("key"))
    wanted = keyed.select("_r", F.explode(_longest(F.col("must"))).alias("key"))
    often = offered.join(wanted.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no text has rules the rule out
    rarest = wanted.join(often, "key", "left").groupBy("_r").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("m")).where("m.n > 0").select("_r", F.col("m.key").alias("key"))
    met = offered.join(keyed.join(rarest, "_r"), "key").where(_hit()).select("text", *columns)
    whole = texts.withColumn("must", F.lower("text")).join(ready.where("kind = 'exact'"), "must").select("text", *columns)
    out = met.unionByName(whole)
    scanned = saved(ready.where((F.col("must") == "") & (F.col("kind") != "exact")))
    n = scanned.count()
    if n:
        blocks = -(-n // BLOCK)
        packed = scanned.withColumn("block", F.pmod(F.xxhash64("_r"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct(*columns)).alias("rules"))
        each = texts.select("text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(packed, "block")
        tried = each.select("text", F.explode("rules").alias("r")).select("text", "r.*").where(_hit())
        out = out.unionByName(tried.select("text", *columns))
    return out
