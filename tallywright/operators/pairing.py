"""One-to-one pairs by the sequential pass, without the table of all candidates.

Rows are dealt to cells of absolute amount and time, and a cell sees the rows
that its own can pair with. Each cell makes the pass over its rows by itself,
with the pairs that the others reported for rows at its edge; cells that see a
row whose pair changed do so again until no pair changes. Cells are cut in two
ways by turns, as decisions that cross an edge to and fro cost a pass each time.
As a pair depends on earlier ones only, the first pair in which a result without
change differed from the sequential one would have to depend on an earlier such
pair, so there is none: what stays is that result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import cycle
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stored import saved

#: Rows that a cell holds, about; a single amount and its nearest days stay together.
CELL_ROWS = 50_000
#: Units of an amount, its last decimal.
UNIT = 10_000
_PARTNER = "p_id string, p_day int, p_units long, p_word boolean"
_ROW = f"id string, day int, units long, account string, word boolean, {_PARTNER}, before boolean, changed boolean"


def _other_account(positions: list[int], account: np.ndarray) -> list[int]:
    """For each place of the list the next one whose row is of another account."""
    out = [len(positions)] * len(positions)
    for k in range(len(positions) - 2, -1, -1):
        out[k] = k + 1 if account[positions[k]] != account[positions[k + 1]] else out[k + 1]
    return out


def sweep(rows: pd.DataFrame, eps: int, days: int, strict_eps: int, strict_days: int) -> pd.DataFrame:
    """The pass over one cell's rows: those that are its own (``core``), with their partners.

    A partner that isn't among the rows was reported by another cell; it pairs with its row alone, in its turn.
    """
    rows = rows.sort_values(["day", "id"], kind="stable", ignore_index=True)
    n = len(rows)
    ids, day, units, word = rows["id"].tolist(), rows["day"].tolist(), rows["units"].tolist(), rows["word"].tolist()
    account = pd.factorize(rows["account"])[0]
    known = set(ids)
    p_id, p_day = rows["p_id"].tolist(), rows["p_day"].tolist()
    outside = [isinstance(p, str) and p not in known for p in p_id]
    # partners outside that come before their row, latest first
    due = sorted(((int(p_day[i]), p_id[i], i) for i in range(n) if outside[i] and (p_day[i], p_id[i]) < (day[i], ids[i])), reverse=True)
    # by day, as a row's partner is mostly of its own day or the next, where fewer amounts lie within reach
    by_day: dict[int, dict[tuple[int, bool], list[int]]] = {}
    for i in range(n):
        by_day.setdefault(day[i], {}).setdefault((units[i], word[i]), []).append(i)
    queues = {d: {k: [v, 0, _other_account(v, account)] for k, v in lists.items()} for d, lists in by_day.items()}
    amounts = {d: sorted({u for u, _ in lists}) for d, lists in by_day.items()}
    partner, taken = [-1] * n, bytearray(n)  # -2: the one outside
    for i in range(n):
        while due and due[-1][:2] < (day[i], ids[i]):
            r = due.pop()[2]
            if not taken[r]:
                taken[r], partner[r] = 1, -2
        if taken[i]:
            continue
        best, x = n, units[i]
        for d in range(day[i], day[i] + max(days, strict_days) + 1):
            if best < n:
                break  # no row of a later day comes before it
            of_day = amounts.get(d)
            if of_day is None:
                continue
            lists, near, soon = queues[d], d <= day[i] + days, d <= day[i] + strict_days
            for y in of_day[bisect_left(of_day, -x - eps) : bisect_right(of_day, -x + eps)]:
                for w in (True, False):
                    if not (near if w or word[i] else soon and abs(x + y) <= strict_eps):
                        continue
                    q = lists.get((y, w))
                    if q is None:
                        continue
                    places, k, other = q
                    while k < len(places) and (places[k] <= i or taken[places[k]]):
                        k += 1
                    q[1] = k
                    while k < len(places):
                        j = places[k]
                        if j >= best:
                            break
                        if account[j] == account[i]:
                            k = other[k]
                        elif taken[j]:
                            k += 1
                        else:
                            best = j
                            break
        if outside[i] and (p_day[i], p_id[i]) > (day[i], ids[i]) and (best == n or (p_day[i], p_id[i]) < (day[best], ids[best])):
            taken[i], partner[i] = 1, -2
        elif best < n:
            taken[i] = taken[best] = 1
            partner[i], partner[best] = best, i
    at = np.array(partner, np.int64)
    inside = at >= 0
    got = rows.copy()
    for name, of in (("p_id", "id"), ("p_day", "day"), ("p_units", "units"), ("p_word", "word")):
        values, old = rows[of].astype(object).to_numpy(), rows[name].astype(object).to_numpy()
        got[name] = np.where(inside, values[at] if n else values, np.where(at == -2, old, None))
    got["before"] = rows["changed"]
    before, after = rows["p_id"].astype(object), got["p_id"]
    got["changed"] = (before.fillna("") != after.fillna("")) | (before.isna() != after.isna())
    return got[rows["core"].to_numpy(bool)]


def _cut(rows: DataFrame, cell_rows: int, shift: float) -> tuple[list[float], list[int]]:
    """Bounds of the cells' absolute amounts, moved on by a share of a cell, and the days that each cell's time covers; 0 is all of it."""
    size = F.abs("units")
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last")).first()
    parts = ceil(all_["n"] / cell_rows)
    inner = sorted(set(rows.agg(F.percentile_approx(size, [(i + shift) / parts for i in range(1 - ceil(shift), parts)], 20 * parts)).first()[0])) if parts > 1 else []
    bounds = [float("-inf"), -1.0, *map(float, inner), float("inf")]  # a Bucketizer wants a bound at least
    if parts <= 1:
        return bounds, [0, 0]
    held = {int(r["b"]): r["count"] for r in Bucketizer(splits=bounds, inputCol="s", outputCol="b").transform(rows.select(size.cast("double").alias("s"))).groupBy("b").count().collect()}
    span = all_["last"] - all_["first"] + 1
    return bounds, [0 if held.get(b, 0) <= 2 * cell_rows else ceil(span * cell_rows / held[b]) for b in range(len(bounds) - 1)]


def sequential_pairs(ledger: DataFrame, word, eps: str, days: int, strict_eps: str, strict_days: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a_id, b_id, a_date, b_date, a_units, b_units, a_word, b_word): the pairs of the pass in order of (a_date, a_id, b_date, b_id).

    ledger: id, each once, date, amount of at most four decimals, account_label.
    """
    unit = lambda v: int(round(float(v) * UNIT))
    reach, strict = unit(eps), unit(strict_eps)
    epoch = F.datediff("date", F.lit("1970-01-01").cast("date"))
    rows = ledger.where("id is not null and date is not null and amount is not null and account_label is not null").select(
        "id", epoch.alias("day"), (F.col("amount").cast("decimal(18,4)") * UNIT).cast("long").alias("units"), F.col("account_label").cast("string").alias("account"), word.alias("word")
    )
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in _PARTNER.split(", "))]
    state = saved(rows.select("*", *none, F.lit(True).alias("before"), F.lit(True).alias("changed")))
    size = F.abs("units")
    places = {"b": size, "b0": F.greatest(size - reach, F.lit(0)), "b1": size + reach}
    columns = [c.split()[0] for c in _ROW.split(", ")]

    def passes(shift: float):
        bounds, spans = _cut(state, cell_rows, shift)
        width = F.array(*[F.lit(s) for s in spans])
        deal = Bucketizer(splitsArray=[bounds] * 3, inputCols=[f"_{c}" for c in places], outputCols=list(places))
        chunk = lambda b, d: F.when(F.get(width, b) == 0, 0).otherwise(F.floor((d + F.floor(F.get(width, b) * shift)) / F.get(width, b))).cast("int")

        def passed(now: DataFrame) -> DataFrame:
            """Another pass of the cells that see a row which changed in the last two; the others' rows stay."""
            dealt = deal.transform(now.select("*", *[v.cast("double").alias(f"_{c}") for c, v in places.items()]))
            dealt = dealt.select(*now.columns, *[F.col(c).cast("int").alias(c) for c in places]).withColumn("t", chunk(F.col("b"), F.col("day")))
            seen = dealt.withColumn("bucket", F.explode(F.sequence("b0", "b1"))).withColumn("time", F.explode(F.sequence(chunk(F.col("bucket"), F.col("day") - days), chunk(F.col("bucket"), F.col("day") + days))))
            seen = seen.select("bucket", "time", *columns, ((F.col("bucket") == F.col("b")) & (F.col("time") == F.col("t"))).alias("core"))
            cells = F.broadcast(saved(seen.where("changed or before").select("bucket", "time").distinct()))  # a few for every cell_rows rows
            again = seen.join(cells, ["bucket", "time"], "left_semi").groupBy("bucket", "time").applyInPandas(lambda pdf: sweep(pdf, reach, days, strict, strict_days)[columns], _ROW)
            still = dealt.join(cells.select(F.col("bucket").alias("b"), F.col("time").alias("t")), ["b", "t"], "left_anti")
            return again.unionByName(still.withColumn("before", F.col("changed")).withColumn("changed", F.lit(False)).select(*columns).coalesce(len(bounds)))

        return passed

    # cells of two kinds by turns, so that what lies at the edge of one is inside the other
    turns = cycle([passes(0.0), passes(0.5)])
    while True:
        state = saved(next(turns)(state))
        if state.where("changed").isEmpty():
            break
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c))
    first = F.col("p_id").isNotNull() & (F.struct("day", "id") < F.struct(F.col("p_day").alias("day"), F.col("p_id").alias("id")))
    return state.where(first).select(F.col("id").alias("a_id"), F.col("p_id").alias("b_id"), day("day").alias("a_date"), day("p_day").alias("b_date"), F.col("units").alias("a_units"), F.col("p_units").alias("b_units"), F.col("word").alias("a_word"), F.col("p_word").alias("b_word"))
