"""Edits of a taxonomy (type, category, subcategory, sort_order_cat, sort_order_sub), as joins with tables of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stored import saved

ORDER = ["sort_order_cat", "sort_order_sub"]


def _replayed(names: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """names (keys, name) with ``now``: what is left of each name after all edits (keys, pos, old, new) in order of pos.

    A name follows the first edit of it, then the first later edit of the new
    name, and so on; a step is a join for all names, and there are as many as
    the longest chain of edits.
    """
    now = names.select(*keys, "name", F.col("name").alias("now"), F.lit(-1).cast("long").alias("at"))
    while True:
        next_ = now.join(edits.withColumnRenamed("old", "now"), [*keys, "now"]).where(F.col("pos") > F.col("at")).groupBy(*keys, "name").agg(F.min(F.struct("pos", "new")).alias("m"))
        next_ = saved(next_.select(*keys, "name", F.col("m.pos").alias("pos"), F.col("m.new").alias("new")))
        if next_.isEmpty():
            return now.drop("at")
        now = saved(now.join(next_, [*keys, "name"], "left").select(*keys, "name", F.coalesce("new", "now").alias("now"), F.coalesce("pos", "at").alias("at")))


def overridden(taxonomy: DataFrame, edits: DataFrame) -> DataFrame:
    """The taxonomy after an edit log (pos, category, subcategory, new): a null ``new`` deletes, a null ``subcategory`` edits the category.

    Whatever their places in the log, categories are deleted first, then
    renamed, then subcategories are deleted, then renamed. Subcategories are
    named under the category's name before any edit. A deletion wins over
    renames of the same name; edits of unknown names, and names that are empty
    or stay the same, change nothing. Edits of one kind go in order of pos.
    """
    of_category = edits.where("subcategory is null").select(F.col("pos").cast("long").alias("pos"), F.col("category").alias("old"), "new")
    of_sub = edits.where("subcategory is not null").select("category", F.col("pos").cast("long").alias("pos"), F.col("subcategory").alias("old"), "new")
    gone = of_category.where("new is null").select(F.col("old").alias("category")).distinct()
    left = saved(taxonomy.join(gone, "category", "left_anti"))
    names = left.select(F.col("category").alias("name")).distinct()
    renames = of_category.where("new <> '' and new <> old").join(names.withColumnRenamed("name", "old"), "old", "left_semi")
    renamed = _replayed(names, renames, [])
    gone = of_sub.where("new is null").select("category", F.col("old").alias("subcategory")).distinct()
    left = saved(left.join(gone, ["category", "subcategory"], "left_anti"))
    subs = _replayed(left.select("category", F.col("subcategory").alias("name")).where("name is not null").distinct(), of_sub.where("new <> '' and new <> old"), ["category"])
    out = left.join(subs.select("category", F.col("name").alias("subcategory"), F.col("now").alias("sub")), ["category", "subcategory"], "left").join(renamed.select(F.col("name").alias("category"), F.col("now").alias("cat")), "category", "left")
    return out.select("type", F.coalesce("cat", "category").alias("category"), F.coalesce("sub", "subcategory").alias("subcategory"), *ORDER)


def with_new(taxonomy: DataFrame, categories: DataFrame, subcategories: DataFrame) -> DataFrame:
    """Appends categories (type, name, pos), each with no subcategory yet, and subcategories (type, category, name, pos) of known categories, behind those that are there, in order of pos."""
    most = taxonomy.groupBy("type").agg(F.max("sort_order_cat").alias("most"))
    place = F.row_number().over(Window.partitionBy("type").orderBy("pos"))
    cats = categories.withColumn("i", place).join(most, "type", "left").select("type", F.trim("name").alias("category"), F.lit(None).cast("string").alias("subcategory"), (F.coalesce("most", F.lit(0)) + F.col("i")).cast("int").alias("sort_order_cat"), F.lit(0).alias("sort_order_sub"))
    known = taxonomy.unionByName(cats)
    last = known.groupBy("type", "category").agg(F.max("sort_order_sub").alias("last"), F.min("sort_order_cat").alias("sort_order_cat"))
    place = F.row_number().over(Window.partitionBy("type", "category").orderBy("pos"))
    subs = subcategories.withColumn("i", place).join(last, ["type", "category"]).select("type", "category", F.trim("name").alias("subcategory"), "sort_order_cat", (F.coalesce("last", F.lit(0)) + F.col("i")).cast("int").alias("sort_order_sub"))
    return known.unionByName(subs)


def seeded(templates: DataFrame, language: str, otherwise: str = "it") -> DataFrame:
    """The template of a language, or of the other one where there is none; templates: language and the taxonomy's columns."""
    rows = templates.where("subcategory is not null")
    has = rows.where(F.col("language") == language).select(F.lit(language).alias("language")).distinct()
    none = rows.where(F.col("language") == otherwise).select("language").distinct().join(has.select(F.lit(1).alias("x")), F.lit(True), "left_anti")
    return rows.join(has.unionByName(none), "language", "left_semi").drop("language")
