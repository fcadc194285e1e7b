"""What past validations say about a description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AUTO, SUGGEST = 0.90, 0.50


def associations(ledger: DataFrame) -> DataFrame:
    """Validated rows by description, category and subcategory."""
    rows = ledger.where(F.coalesce("human_validated", F.lit(False)) & F.col("category").isNotNull() & F.col("description").isNotNull())
    return rows.groupBy("description", "category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


def profiles(ledger: DataFrame) -> DataFrame:
    """Per description: total, entropy over its categories normalised by log2 of their number,
    homogeneity, confidence, and the top category (most rows; ties by name, null subcategory first)."""
    a = associations(ledger)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("description"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("category"), F.coalesce("subcategory", F.lit("")).alias("s"), F.col("subcategory")))
    g = a.withColumn("p", p).groupBy("description").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(-F.col("p") * F.log2("p")).alias("h"), best.alias("b"))
    entropy = F.when(F.col("k") <= 1, 0.0).otherwise(F.col("h") / F.log2("k"))
    g = g.withColumn("entropy", entropy).withColumn("homogeneity", 1 - F.col("entropy"))
    g = g.withColumn("confidence", F.col("homogeneity") * F.least(F.lit(1.0), F.col("total") / 5))
    return g.select("description", "total", F.round("entropy", 6).alias("entropy"), F.round("homogeneity", 6).alias("homogeneity"), F.round("confidence", 6).alias("confidence"), F.col("b.category").alias("category"), F.col("b.subcategory").alias("subcategory"))


def badge() -> Column:
    c = F.col("confidence")
    return F.when(F.col("total") < 3, "new").when(c >= AUTO, "auto").when(c >= SUGGEST, "suggest").otherwise("mixed")


def badge_counts(ledger: DataFrame) -> DataFrame:
    return profiles(ledger).groupBy(badge().alias("badge")).agg(F.count(F.lit(1)).alias("n"))


def lookup(ledger: DataFrame, known: DataFrame) -> DataFrame:
    """Each row with the category that its description's profile is sure enough of."""
    p = known.select("description", F.col("category").alias("hist_category"), F.col("subcategory").alias("hist_subcategory"), "confidence")
    ok = F.col("confidence") >= SUGGEST
    return ledger.select("id", "description").join(p, "description", "left").select(
        "id", F.when(ok, F.col("hist_category")).alias("category"), F.when(ok, F.col("hist_subcategory")).alias("subcategory"),
        F.when(F.col("confidence") >= AUTO, "high").when(ok, "medium").alias("category_confidence"), (ok & (F.col("confidence") < AUTO)).alias("to_review"),
    )


def association_text(ledger: DataFrame, most: int = 50, chars: int = 2000) -> DataFrame:
    """Lines of the surest descriptions, most frequent first, as many whole lines as fit."""
    top = profiles(ledger).where("confidence >= 0.5 and total >= 3").orderBy(F.desc("total"), "description").limit(most)
    line = F.concat(F.col("description"), F.lit(" -> "), F.col("category"), F.lit("/"), F.coalesce("subcategory", F.lit("")), F.lit(" ("), F.col("total").cast("string"), F.lit(")"))
    order = Window.orderBy(F.desc("total"), "description")  # at most `most` rows
    used = F.sum(F.length("line") + 1).over(order)
    kept = top.withColumn("line", line).withColumn("used", used - 1).withColumn("rank", F.row_number().over(order)).where(F.col("used") <= chars)
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("text"))


def fan_out(ledger: DataFrame, source_ids: list[str]) -> DataFrame:
    """Copies category, subcategory and context from the given rows to unvalidated rows of the same description."""
    src = ledger.where(F.col("id").isin(source_ids)).groupBy("description").agg(F.min_by(F.struct("category", "subcategory", "context"), "id").alias("s"))
    hit = F.col("s").isNotNull() & ~F.coalesce("human_validated", F.lit(False)) & ~F.col("id").isin(source_ids)
    out = ledger.join(src, "description", "left")
    for c in ("category", "subcategory", "context"):
        out = out.withColumn(c, F.when(hit, F.col(f"s.{c}")).otherwise(F.col(c)))
    return out.withColumn("category_source", F.when(hit, "history").otherwise(F.col("category_source"))).withColumn("category_confidence", F.when(hit, "high").otherwise(F.col("category_confidence"))).drop("s")
