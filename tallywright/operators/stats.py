"""Run statistics: usage, variance, trimmed means, accuracy, regression, progress."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-sided 95 % points of Student's t by degrees of freedom.
T_TABLE = ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (6, 2.447), (7, 2.365), (8, 2.306), (9, 2.262), (10, 2.228), (15, 2.131), (20, 2.086), (30, 2.042), (60, 2.0), (120, 1.98))


def nearest_rank(sorted_values: Column, share: float, n: Column) -> Column:
    """The value at floor(share n), from 0: no interpolation."""
    return F.get(sorted_values, F.floor(n * share).cast("int"))


def unpivoted(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").where("value is not null")


def usage_stats(log: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """n, mean, population deviation, nearest-rank p50, p95 (from 20 values on, else the largest), p99 (from 100), and the mean's 95 % half width.

    Ranks come from a window in each group of values, so that a group is never one array.
    """
    long = unpivoted(log, keys, metrics)
    by = [*keys, "metric"]
    place = Window.partitionBy(*by).orderBy("value")
    ranked = long.withColumn("i", F.row_number().over(place) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = lambda share: F.max(F.when(F.col("i") == F.floor(F.col("n") * share), F.col("value")))
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.max("value").alias("top"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    big = lambda c, least: F.when(F.col("n") >= least, F.col(c)).otherwise(F.col("top"))
    r = lambda c: F.round(c, 1)
    return g.select(*by, "n", r("mean").alias("mean"), r("std").alias("std"), r("p50").alias("p50"), r(big("p95", 20)).alias("p95"), r(big("p99", 100)).alias("p99"), r(F.col("std") * 1.96 / F.sqrt("n")).alias("ci95"))


def context_cap(log: DataFrame, keys: list[str], value: str, least: int = 1000) -> DataFrame:
    """Largest upper bound of the means of well-filled groups, to the next 1024, 2048 at least; null without one."""
    g = log.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).where(F.col("n") >= least)
    top = F.max(F.col("m") + F.col("s") * 1.96 / F.sqrt("n"))
    return g.agg(F.when(top.isNotNull(), F.greatest(F.lit(2048), (F.ceil(top / 1024) * 1024).cast("int"))).alias("cap"))


def t_value(n: Column) -> Column:
    """t for n values: the entry of the largest listed degrees of freedom not over n - 1."""
    out = F.lit(None).cast("double")
    for df, t in T_TABLE:
        out = F.when(n - 1 >= df, t).otherwise(out)
    return out


def group_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, median, sample deviation, extremes and the t half width; null keys are groups too."""
    g = rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    r = lambda c: F.round(c, 4)
    return g.select(*keys, "n", r("mean").alias("mean"), r("median").alias("median"), r("std").alias("std"), "min", "max", r(t_value(F.col("n")) * F.col("std") / F.sqrt("n")).alias("ci95"))


def variance(rows: DataFrame, file: str, metrics: list[str]) -> DataFrame:
    """By file and metric, and over all files (file null): mean, population deviation, extremes, variation in %."""
    long = unpivoted(rows, [file], metrics)
    g = long.groupingSets([[file, "metric"], ["metric"]], file, "metric").agg(F.grouping(file).cast("int").alias("overall"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return g.select(file, "metric", "overall", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", "max", F.round(F.try_divide(F.col("std") * 100, F.col("mean")), 3).alias("cv"))


def trimmed_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and count of the values from the 5th to the 95th percentile, which are interpolated."""
    cut = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    inside = rows.join(cut, keys).where(F.col(value).between(F.col("q")[0], F.col("q")[1]))
    return inside.groupBy(*keys).agg(F.round(F.avg(value), 4).alias("mean"), F.count(value).alias("n"))


def accuracy(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Rates of exact and of top-level matches, and of fallbacks, over rows that both have; by direction and overall."""
    t = truth.select(*keys, F.col("category").alias("t_cat"), F.col("subcategory").alias("t_sub"))
    both = predicted.join(t, keys)
    top = F.col("category") == F.col("t_cat")
    scored = both.select(
        F.when(F.col("amount") < 0, "expense").otherwise("income").alias("direction"), F.coalesce(top & (F.col("subcategory") == F.col("t_sub")), F.lit(False)).alias("exact"),
        F.coalesce(top, F.lit(False)).alias("fuzzy"), (F.col("category_source") == "fallback").alias("fell"),
    )
    rate = lambda c: F.round(F.try_divide(F.count_if(c), F.count(F.lit(1))), 4).alias(f"{c}_rate")
    return scored.groupingSets([["direction"], []], "direction").agg(F.count(F.lit(1)).alias("n"), rate("exact"), rate("fuzzy"), rate("fell"))


def merged_runs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two kinds of runs; columns that both have take the left value first."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    right = b.select(*keys, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in b.columns if c not in keys])
    out = a.join(right, keys, "full")
    return out.withColumns({c: F.coalesce(c, f"_r_{c}") for c in shared}).drop(*[f"_r_{c}" for c in shared])


def weighted_score(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Shares of true flags and their weighted sum."""
    rates = rows.agg(*[F.avg(F.col(c).cast("int")).alias(c) for c in weights])
    return rates.select(*[F.round(c, 4).alias(c) for c in weights], F.round(sum(F.col(c) * w for c, w in weights.items()), 4).alias("score"))


def least_squares(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """OLS with intercept: coefficient, standard error, 95 % interval by term, R2.

    The moments are sums over all rows; only their small matrix is solved on the driver.
    """
    names = ["intercept", *features]
    col = lambda n: F.lit(1.0) if n == "intercept" else F.col(n).cast("double")
    full = rows.where(" and ".join(f"{c} is not null" for c in [*features, target]))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    y = F.col(target).cast("double")
    row = full.agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), *[F.sum(col(names[i]) * col(names[j])).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(col(m) * y).alias(f"v{i}") for i, m in enumerate(names)]
    ).first()
    schema = "term string, coef double, se double, low double, high double, r2 double"
    if row["n"] <= len(names):
        return rows.sparkSession.createDataFrame([], schema)
    x = np.zeros((len(names), len(names)))
    for i, j in pairs:
        x[i, j] = x[j, i] = row[f"x{i}_{j}"]
    v = np.array([row[f"v{i}"] for i in range(len(names))])
    inv = np.linalg.pinv(x)
    b = inv @ v
    rss = max(0.0, row["yy"] - 2 * b @ v + b @ x @ b)
    tss = row["yy"] - row["y"] ** 2 / row["n"]
    se = np.sqrt(np.maximum(0, np.diag(inv)) * rss / (row["n"] - len(names)))
    r2 = 1 - rss / tss if tss > 0 else 0.0
    out = [(m, *(round(float(z), 6) for z in (c, s, c - 1.96 * s, c + 1.96 * s, r2))) for m, c, s in zip(names, b, se)]
    return rows.sparkSession.createDataFrame(out, schema)


def progress(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Done, mean of the positive durations, what is left and for how long."""
    some = lambda c: F.avg(F.when(F.col(c) > 0, F.col(c)))
    g = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), some("duration").alias("mean_s"))
    return g.select(*keys, "done", F.round("mean_s", 4).alias("mean_s"), F.greatest(F.lit(expected).cast("long") - F.col("done"), F.lit(0).cast("long")).alias("left"), F.round(F.greatest(F.lit(expected) - F.col("done"), F.lit(0)) * F.col("mean_s"), 2).alias("eta_s"))


def rates(ticks: DataFrame, keys: list[str], ticks_back: int = 20) -> DataFrame:
    """Rows a second over the last ticks (tick, t, c), where a second passed and the count grew; else null."""
    w = Window.partitionBy(*keys).orderBy("tick").rowsBetween(1 - ticks_back, 0)
    dt, dc = F.last("t").over(w) - F.first("t").over(w), F.last("c").over(w) - F.first("c").over(w)
    return ticks.select(*keys, "tick", F.when((dt >= 1) & (dc > 0), F.round(dc / dt, 4)).alias("rate"))


#: Runs of a group from which its rates are worth comparing.
ENOUGH = 10


def benchmark_summary(runs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group of runs: what its classifier and its categoriser runs gave, and its rank.

    runs: keys, benchmark_type, duration_seconds, n_transactions and the rates.
    Times of categoriser runs count from their group's 5th to its 95th
    percentile only. Groups are ranked by exact rate, then by its half width;
    null keys are keys.
    """
    clf, cat = F.col("benchmark_type") == "classifier", F.col("benchmark_type") == "categorizer"
    ten = F.when((F.col("n_transactions") > 0) & (F.col("duration_seconds") > 0), F.col("duration_seconds") / F.col("n_transactions") * 10)
    rows = runs.withColumn("ten", F.when(cat, ten)).withColumn("long", F.when(cat, F.col("duration_seconds")))
    ends = F.array(F.lit(0.05), F.lit(0.95))
    cut = rows.groupBy(*keys).agg(F.percentile("ten", ends).alias("q_ten"), F.percentile("long", ends).alias("q_long"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    both = rows.alias("r").join(cut.alias("c"), same).select("r.*", "q_ten", "q_long")
    inside = lambda c: F.when(F.col(c).between(F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]), F.col(c))
    of = lambda hit, c: F.when(hit, F.col(c))
    g = both.groupBy(*keys).agg(
        F.count(of(clf, "duration_seconds")).alias("clf_n"), F.avg(of(clf, "amount_accuracy")).alias("clf_amount"), F.avg(of(clf, "duration_seconds")).alias("clf_seconds"),
        F.count("long").alias("cat_n_raw"), F.count(inside("long")).alias("cat_n"), F.avg(of(cat, "cat_exact_accuracy")).alias("exact"), F.stddev_samp(of(cat, "cat_exact_accuracy")).alias("std"),
        F.avg(of(cat, "cat_fuzzy_accuracy")).alias("fuzzy"), F.avg(of(cat, "cat_fallback_rate")).alias("fallback"), F.avg(inside("ten")).alias("seconds_10"),
    )
    g = g.withColumn("ci95", F.coalesce(F.when(F.col("cat_n") >= 2, t_value(F.col("cat_n")) * F.col("std") / F.sqrt("cat_n")), F.lit(0.0))).withColumn("wrong", F.greatest(F.lit(0.0), 1 - F.col("fuzzy") - F.col("fallback")))
    order = Window.orderBy(F.desc(F.coalesce(F.round("exact", 9), F.lit(-1.0))), F.round("ci95", 9), *[F.col(k).asc_nulls_last() for k in keys])  # a row a group
    r = lambda *names: [F.round(n, 4).alias(n) for n in names]
    return g.select(*keys, "clf_n", *r("clf_amount", "clf_seconds"), "cat_n", "cat_n_raw", (F.col("cat_n") >= ENOUGH).alias("enough"), *r("exact", "ci95", "fuzzy", "wrong", "fallback", "seconds_10"), F.row_number().over(order).cast("long").alias("rank"))
