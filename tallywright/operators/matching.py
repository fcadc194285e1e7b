"""Transfers between accounts, card settlements and balance rows."""

from __future__ import annotations

from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..stored import Stored, saved
from . import pairing

EPS, DAYS = "0.01", 5
STRICT_EPS, STRICT_DAYS = "0.005", 1


def transfer_candidates(ledger: DataFrame, words: list[str] = (), eps: str = EPS, days: int = DAYS) -> DataFrame:
    """Pairs (a, b) of rows of different accounts whose amounts cancel within eps and whose dates are near.

    Equi-keys keep it a hash join: amounts are cut into buckets of width eps and
    dates into buckets of days + 1; the first side, by (date, id), goes to the
    neighbouring amounts and to the next dates, so every pair meets exactly once.
    Pairs without a word meet in the narrower buckets of the strict bounds, so
    what is compared follows what is found.
    """
    rows = ledger.select("id", "date", "amount", "account_label", _holds(words).alias("word"))
    epoch = F.datediff("date", F.lit("1970-01-01").cast("date"))
    gap = F.datediff("b_date", "a_date")
    off = F.abs(F.col("a_amount") + F.col("b_amount"))
    first = F.struct("a_date", "a_id") < F.struct("b_date", "b_id")

    def met(a: DataFrame, b: DataFrame, eps: str, days: int) -> DataFrame:
        width, span = F.lit(eps).cast("decimal(18,4)"), F.lit(days + 1)
        k, e = (lambda x: F.floor(x / width)), F.floor(epoch / span)
        left = a.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], F.explode(F.array(*[k(F.col("amount")) + i for i in (-1, 0, 1)])).alias("k"), e.alias("d")).withColumn("e", F.explode(F.array(F.col("d"), F.col("d") + 1)))
        right = b.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], k(-F.col("amount")).alias("k"), e.alias("e"))
        return left.join(right, ["k", "e"]).where(first & (F.col("a_account_label") != F.col("b_account_label")) & (off <= width) & (gap <= days))

    with_word, without = rows.where("word"), rows.where("not word")
    strict_eps, strict_days = str(min(float(eps), float(STRICT_EPS))), min(days, STRICT_DAYS)
    high = met(with_word, rows, eps, days).unionByName(met(without, with_word, eps, days)).withColumn("confidence", F.lit("high"))
    pairs = high.unionByName(met(without, without, strict_eps, strict_days).withColumn("confidence", F.lit("medium")))
    return pairs.select("a_id", "b_id", "a_date", "b_date", "a_amount", "b_amount", "confidence")


def _holds(words: list[str]) -> Column:
    """Whether the description holds one of the words."""
    hit = F.lit(False)
    for w in words:
        hit |= F.coalesce(F.contains(F.lower("description"), F.lit(w.lower())), F.lit(False))
    return hit


def transfer_pairs(ledger: DataFrame, words: list[str] = ()) -> DataFrame:
    """One-to-one pairs: the greedy pass over pairs in order of (a, b).

    Rows are many, and candidates grow with the square of how densely they lie,
    so the pass goes over the rows. Ledgers whose ids repeat or are no texts, or
    with finer amounts, go by their candidates.
    """
    kinds = {c: ledger.schema[c].dataType for c in ("id", "amount")}
    fine = not isinstance(kinds["amount"], T.DecimalType) or kinds["amount"].scale > 4 or kinds["amount"].precision - kinds["amount"].scale > 14
    if fine or not isinstance(kinds["id"], T.StringType) or not ledger.groupBy("id").count().where("count > 1").isEmpty():
        return greedy_pairs(transfer_candidates(ledger, words), "a_id", "b_id", F.struct("a_date", "a_id", "b_date", "b_id"))
    got = pairing.sequential_pairs(ledger.select("id", "date", "amount", "account_label", "description"), _holds(words), EPS, DAYS, STRICT_EPS, STRICT_DAYS)
    amount = lambda c: (F.col(c).cast("decimal(18,0)") / pairing.UNIT).cast(kinds["amount"])
    return got.select("a_id", "b_id", "a_date", "b_date", amount("a_units").alias("a_amount"), amount("b_units").alias("b_amount"), F.when(F.col("a_word") | F.col("b_word"), "high").otherwise("medium").alias("confidence"))


def greedy_pairs(pairs: DataFrame, a: str, b: str, order) -> DataFrame:
    """The pairs that a sequential pass in the given order takes, in which a taken row is in no later pair.

    A pair is taken if none of the earlier pairs of its two rows is. Where there
    is one such pair, it is taken if that one is not, so along a run of such
    pairs every other one is taken, and pointers that double their reach find
    each pair's place in its run. Pairs with several earlier ones wait until
    those are settled. Rounds are as many as decisions that branch follow each
    other, whatever the length of runs.
    """
    left = saved(pairs.withColumn("_o", order).withColumn("_e", F.monotonically_increasing_id()))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col(a).alias("n"), "_e", "_o").unionByName(left.select(F.col(b).alias("n"), "_e", "_o"))
        w = Window.partitionBy("n").orderBy("_o")
        before = ends.select("_e", (F.row_number().over(w) - 1).alias("k"), F.lag("_e").over(w).alias("p"))
        at = before.groupBy("_e").agg(F.sum("k").alias("k"), F.max("p").alias("p"))
        # to: the earlier pair it depends on, itself at the start of a run; odd: steps to there; open: whether that start is undecided
        now = saved(at.select("_e", F.when(F.col("k") == 1, F.col("p")).otherwise(F.col("_e")).alias("to"), (F.col("k") == 1).alias("odd"), (F.col("k") > 1).alias("open"), (F.col("k") == 1).alias("moved")))
        while not now.where("moved").isEmpty():
            on = now.select(F.col("_e").alias("to"), F.col("to").alias("far"), F.col("odd").alias("far_odd"), F.col("open").alias("far_open"))
            now = saved(now.join(on, "to").select("_e", F.col("far").alias("to"), (F.col("odd") != F.col("far_odd")).alias("odd"), F.col("far_open").alias("open"), (F.col("far") != F.col("to")).alias("moved")))
        round_ = saved(left.join(now.where("not open and not odd").select("_e"), "_e", "left_semi"))
        taken.append(round_)
        used = round_.select(F.col(a).alias("n")).unionByName(round_.select(F.col(b).alias("n")))
        left = saved(left.join(used.withColumnRenamed("n", a), a, "left_anti").join(used.withColumnRenamed("n", b), b, "left_anti").select(*left.columns))
    out = left
    for t in taken:
        out = out.unionByName(t)
    return out.drop("_o", "_e")


def transfer_links(pairs: DataFrame) -> DataFrame:
    """(out_id, in_id, confidence): sides by sign, the smaller amount is out."""
    neg = F.col("a_amount") <= F.col("b_amount")
    return pairs.select(F.when(neg, F.col("a_id")).otherwise(F.col("b_id")).alias("out_id"), F.when(neg, F.col("b_id")).otherwise(F.col("a_id")).alias("in_id"), "confidence")


def owner_transfers(ledger: DataFrame, pattern: str, paired: DataFrame) -> DataFrame:
    """Unpaired rows that name the owner: internal by sign. paired: ids that are taken."""
    rows = ledger.join(paired, "id", "left_anti").where(F.regexp("description", F.lit(pattern)))
    return rows.select("id", F.when(F.col("amount") < 0, "internal_out").otherwise("internal_in").alias("tx_type"))


def balance_rows(ledger: DataFrame, by: str = "source_file", eps: str = "0.01") -> DataFrame:
    """First row of each file of three or more that equals the sum of all others, in absolute amounts."""
    w = Window.partitionBy(by)
    a = F.abs("amount")
    rows = ledger.withColumn("s", F.sum(a).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    hit = rows.where((F.col("n") >= 3) & (F.abs(a - (F.col("s") - a)) <= F.lit(eps).cast("decimal(18,4)")))
    return hit.groupBy(by).agg(F.min_by("id", F.struct("date", "id")).alias("id"))


#: Days before and after a settlement in which its card rows lie, days that a run may pause, and rows on either side that subsets are made of.
BEFORE, AFTER, GAP, EDGE = 45, 7, 5, 10


def smallest_subset(amounts: np.ndarray, target: int, eps: int) -> list[int]:
    """Of the subsets that sum to the target within eps the smallest, of those the first in order of places; none gives [].

    Meets in the middle: the sums of either half's subsets, the second half's
    sorted, so that only pairs of halves that hit the target are looked at.
    """
    n = len(amounts)
    half = n // 2

    def sums(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # the first place has the highest bit, so of equal sizes the larger number comes first
        bits = (np.arange(1 << len(part))[:, None] >> np.arange(len(part))[::-1]) & 1
        return bits @ part if len(part) else np.zeros(1, np.int64), bits.sum(1)

    (a, size_a), (b, size_b) = sums(amounts[:half]), sums(amounts[half:])
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], target - eps - a, "left"), np.searchsorted(b[order], target + eps - a, "right")
    found = np.maximum(high - low, 0)
    first = np.repeat(np.arange(len(a)), found)
    second = order[np.arange(len(first)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(low, found)]
    size = size_a[first] + size_b[second]
    mask = (first << (n - half)) | second
    size[mask == 0] = n + 1  # no rows is no subset
    if not len(size) or size.min() > n:
        return []
    best = int(mask[size == size.min()].max())
    return [i for i in range(n) if best >> (n - 1 - i) & 1]


def _run_matches(pool: DataFrame, eps: str) -> DataFrame:
    """(settlement, start, end): of each settlement's runs that hit its amount the first; places are those in its pool.

    A run is a difference of two prefix sums, so starts with the amount added
    meet ends by equality, in buckets of eps.
    """
    w = Window.partitionBy("settlement").orderBy("date", "id")
    days = F.datediff("date", F.lag("date").over(w))
    rows = pool.withColumn("pos", F.row_number().over(w)).withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("break", F.coalesce((days > GAP).cast("int"), F.lit(0)))
    rows = rows.withColumn("part", F.sum("break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    width = F.lit(eps).cast("decimal(18,4)")
    starts = rows.select("settlement", "part", F.col("pos").alias("start"), (F.col("upto") - F.col("size") + F.col("target")).alias("goal"))
    starts = starts.withColumn("bucket", F.explode(F.array(*[F.floor(F.col("goal") / width).cast("long") + i for i in (-1, 0, 1)])))
    ends = rows.select("settlement", "part", F.col("pos").alias("end"), "upto", F.floor(F.col("upto") / width).cast("long").alias("bucket"))
    hits = starts.join(ends, ["settlement", "part", "bucket"]).where((F.col("end") >= F.col("start")) & (F.abs(F.col("upto") - F.col("goal")) <= width))
    best = hits.groupBy("settlement").agg(F.min(F.struct("start", "end")).alias("m")).select("settlement", "m.start", "m.end")
    return rows.join(best, "settlement").where(F.col("pos").between(F.col("start"), F.col("end"))).select("settlement", "id", "size", "target", F.lit("run").alias("method"))


def _subset_matches(pool: DataFrame, eps: str) -> DataFrame:
    """For settlements without a run: the smallest subset of the EDGE rows before the settlement and the EDGE rows from its day on."""
    early = F.col("date") < F.col("day")
    w = Window.partitionBy("settlement", early)
    last, first = F.row_number().over(w.orderBy(F.desc("date"), F.desc("id"))), F.row_number().over(w.orderBy("date", "id"))
    edge = pool.withColumn("i", F.when(early, last).otherwise(first)).where(F.col("i") <= EDGE)
    each = edge.groupBy("settlement", "target").agg(F.array_sort(F.collect_list(F.struct("date", "id", "size"))).alias("rows"))
    cents = each.select("settlement", "target", "rows", F.transform("rows", lambda x: (x["size"] * 10_000).cast("long")).alias("units"), (F.col("target") * 10_000).cast("long").alias("goal"))
    unit = int(float(eps) * 10_000 + 0.5)

    @F.pandas_udf("array<int>")
    def chosen(units: pd.Series, goals: pd.Series) -> pd.Series:
        return pd.Series([smallest_subset(np.asarray(u, np.int64), int(g), unit) for u, g in zip(units, goals)])

    got = cents.withColumn("at", chosen("units", "goal")).where(F.size("at") > 0)
    return got.select("settlement", "target", F.explode(F.transform("at", lambda i: F.get("rows", i))).alias("x")).select("settlement", "x.id", "x.size", "target", F.lit("subset").alias("method"))


def card_settlements(settlements: DataFrame, cards: DataFrame, owner: str = "account_label", eps: str = EPS) -> DataFrame:
    """(settlement_id, detail_id, delta, method): the card rows that each settlement pays.

    Settlements go in order of (date, id). Each takes, of its owner's card rows
    in its window that no earlier one has taken, the first run by date whose
    absolute amounts sum to its own, else the smallest subset of the rows next
    to it. delta is the settlement's amount less the sum.

    All settlements are matched at once, as if nobody took anything; then those
    again that see another claim of an earlier one, until no claim changes. As
    claims depend on earlier settlements only, what stays is what the sequential
    pass gives. A settlement's window is the largest group, and only windows
    that overlap changed ones are matched again.
    """
    due = saved(settlements.select(F.col(owner).alias("owner"), F.col("id").alias("settlement"), F.abs("amount").alias("target"), F.col("date").alias("day")))
    spent = cards.select(F.col(owner).alias("owner"), "id", "date", F.abs("amount").alias("size"))
    windows = Stored(due.join(spent, "owner").where(F.col("date").between(F.date_sub("day", BEFORE), F.date_add("day", AFTER))))
    claims = saved(windows.df.limit(0).select("settlement", "id", "size", "target", F.lit("").alias("method")))
    again = due.select("settlement")
    order = {c: F.struct(F.col(f"{c}.day"), F.col(f"{c}.settlement")) for c in "sc"}
    while not again.isEmpty():
        at = claims.select("settlement", "id").join(due.select("settlement", "day"), "settlement")
        mine = windows.df.join(again, "settlement", "left_semi")
        lost = mine.alias("s").join(at.alias("c"), F.col("s.id") == F.col("c.id")).where(order["c"] < order["s"]).select("s.settlement", "s.id").distinct()
        pool = saved(mine.join(lost, ["settlement", "id"], "left_anti"))
        runs = saved(_run_matches(pool, eps))
        found = runs.unionByName(_subset_matches(pool.join(runs.select("settlement").distinct(), "settlement", "left_anti"), eps))
        old = claims.join(again, "settlement", "left_semi")
        new = saved(found)
        keys = ["settlement", "id"]
        moved = saved(new.select(*keys).exceptAll(old.select(*keys)).unionByName(old.select(*keys).exceptAll(new.select(*keys))).select("id", "settlement").distinct())
        claims = saved(claims.join(again, "settlement", "left_anti").unionByName(new))
        # who sees a changed claim of an earlier settlement
        changed = moved.join(due.select("settlement", "day"), "settlement")
        again = saved(windows.df.alias("s").join(changed.alias("c"), F.col("s.id") == F.col("c.id")).where(order["c"] < order["s"]).select("s.settlement").distinct())
    total = Window.partitionBy("settlement")
    out = saved(claims.select(F.col("settlement").alias("settlement_id"), F.col("id").alias("detail_id"), (F.col("target") - F.sum("size").over(total)).cast("decimal(18,4)").alias("delta"), "method"))
    windows.remove()
    return out


def reverse_matches(names: DataFrame, texts: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, i, j, score): names (batch, j, text) given to texts (batch, i, text), each once, best containment first.

    A score is the share of the name's words that the text holds; pairs without
    a common word are none. Of equal scores the later text, then the later
    name, goes first. Rows of one set of words score alike and the latest of
    them always goes first, so a batch is matched by its distinct sets, with
    two stacks of places a pair of sets. Batches of more pairs of sets than
    ``CLASS_PAIRS`` are matched by rounds over their pairs of rows.
    """
    from ..functions.scalars import tokens

    def sets(rows: DataFrame, place: str) -> DataFrame:
        w = rows.where(F.col(batch).isNotNull()).select(F.col(batch).alias("batch"), place, F.array_sort(tokens(F.col("text"))).alias("w"))
        return w.where(F.size("w") > 0)

    told, held = sets(names, "j"), sets(texts, "i")
    size = lambda rows, c: rows.select("batch", "w").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias(c))
    large = saved(size(told, "a").join(size(held, "b"), "batch").where(F.col("a") * F.col("b") > CLASS_PAIRS).select("batch"))
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((told, "batch"), (told, "j"), (held, "i"))}
    classes = lambda rows, c: rows.join(large, "batch", "left_anti").groupBy("batch", "w").agg(F.array_sort(F.collect_list(c)).alias(c)).groupBy("batch")
    out = classes(held, "i").cogroup(classes(told, "j")).applyInPandas(_matched_batch, f"batch {kinds['batch']}, i {kinds['i']}, j {kinds['j']}, score double")
    if large.isEmpty():
        return out
    wide = lambda rows, c: rows.join(large, "batch", "left_semi").select("batch", c, F.size("w").alias(f"n_{c}"), F.explode("w").alias("word"))
    scored = wide(told, "j").join(wide(held, "i"), ["batch", "word"]).groupBy("batch", "i", "j").agg((F.count(F.lit(1)) / F.max("n_j")).alias("score"))
    ends = scored.withColumn("a", F.to_json(F.struct(F.lit("i").alias("side"), "batch", "i"))).withColumn("b", F.to_json(F.struct(F.lit("j").alias("side"), "batch", "j")))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"), "batch")
    return out.unionByName(greedy_pairs(ends, "a", "b", order).select("batch", "i", "j", "score"))


#: Pairs of sets of words that one task matches.
CLASS_PAIRS = 4_000_000


def _matched_batch(texts: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """The matches of one batch: (batch, w, i) and (batch, w, j), a row a set of words with its places in ascending order."""
    found = []
    if len(texts) and len(names):
        free_i, free_j = [list(x) for x in texts["i"]], [list(x) for x in names["j"]]
        words = [list(w) for w in names["w"]]
        having: dict[str, list[int]] = {}
        for y, w in enumerate(words):
            for word in w:
                having.setdefault(word, []).append(y)
        levels: dict[float, dict[int, list[int]]] = {}
        for x, w in enumerate(texts["w"]):
            shared = Counter(y for word in w for y in having.get(word, ()))
            for y, n in shared.items():
                levels.setdefault(n / len(words[y]), {}).setdefault(x, []).append(y)
        for score in sorted(levels, reverse=True):
            near = levels.pop(score)
            heap = [(-free_i[x][-1], x) for x in near if free_i[x]]
            heapify(heap)
            while heap:
                _, x = heappop(heap)
                near[x] = [y for y in near[x] if free_j[y]]
                if not near[x]:
                    continue
                y = max(near[x], key=lambda y: free_j[y][-1])
                found.append((texts["batch"].iloc[0], free_i[x].pop(), free_j[y].pop(), score))
                if free_i[x]:
                    heappush(heap, (-free_i[x][-1], x))
    return pd.DataFrame(found, columns=["batch", "i", "j", "score"])


def cross_account_duplicates(ledger: DataFrame) -> DataFrame:
    """All rows whose (date, raw description, amount) stands in more than one account; null accounts don't count."""
    keys = ["date", "raw_description", "amount"]
    shared = ledger.where("raw_description is not null").groupBy(*keys).agg(F.count_distinct("account_label").alias("n")).where("n > 1")
    return ledger.join(shared, keys, "left_semi")


def similar_to(ledger: DataFrame, text: str, at_least: float) -> DataFrame:
    """Rows whose words are like those of one text, by the Jaccard index of word sets."""
    from ..functions.scalars import jaccard, tokens

    scored = ledger.where("description <> ''").withColumn("score", jaccard(tokens(F.col("description")), tokens(F.lit(text))))
    return scored.where(F.col("score") >= at_least)


def similar_pairs(ledger: DataFrame, at_least: float) -> DataFrame:
    """(a, b, score) of distinct descriptions, by prefix filtering: of a set of n words, rarest first,
    one of the first n - ceil(t n) + 1 is in every set that is similar enough."""
    from ..functions.scalars import tokens

    texts = ledger.where("description is not null").select("description", tokens(F.col("description")).alias("w")).distinct().where(F.size("w") > 0)
    words = texts.select("description", F.explode("w").alias("word"))
    rank = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ordered = words.join(rank, "word").groupBy("description").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("o"))
    keep = F.size("o") - F.ceil(F.size("o") * at_least).cast("int") + 1
    heads = ordered.select("description", F.explode(F.transform(F.slice("o", F.lit(1), keep), lambda x: x["word"])).alias("word"))
    side = lambda c: heads.select("word", F.col("description").alias(c))
    met = side("a").join(side("b"), "word").where("a < b").select("a", "b").distinct()
    sets = lambda c: texts.select(F.col("description").alias(c), F.col("w").alias(f"w_{c}"))
    score = F.size(F.array_intersect("w_a", "w_b")) / F.size(F.array_union("w_a", "w_b"))
    return met.join(sets("a"), "a").join(sets("b"), "b").withColumn("score", score).where(F.col("score") >= at_least).select("a", "b", F.round("score", 6).alias("score"))
