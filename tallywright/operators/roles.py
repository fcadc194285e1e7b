"""Smaller pieces of import and of run reports: merging schemas, brand rules, matching back, sessions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ingest import StatementSchema

# Endings of company names that brand patterns leave out.
LEGAL_FORMS = ("spa", "srl", "gmbh", "ag", "ltd", "inc", "llc", "sa", "sas", "bv", "plc", "co", "kg")


def merged_schema(found: StatementSchema, proposed: StatementSchema) -> StatementSchema:
    """What content has settled wins; a proposal fills the rest. Amount roles go together."""
    out = replace(found, date=found.date if found.date is not None else proposed.date, description=found.description if found.description is not None else proposed.description)
    if found.amount is None and found.debit is None:
        out = replace(out, amount=proposed.amount, debit=proposed.debit, credit=proposed.credit, convention=proposed.convention, invert=proposed.invert)
    return replace(out, date_layout=found.date_layout or proposed.date_layout)


def repaired_name(name: str | None, columns: list[str]) -> str | None:
    """The column of that name whatever its case, or none."""
    return next((c for c in columns if name and c.strip().lower() == name.strip().lower()), None)


def too_few_parsed(rows: DataFrame, least: float = 0.10) -> bool:
    """Whether a cached schema reads so little of a file that it must be inferred anew."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("reject").isNull(), 1)).alias("ok")).first()
    return r["n"] > 0 and r["ok"] < least * r["n"]


def brand_rules(items: DataFrame) -> DataFrame:
    """(rule_idx, pattern, osm_tag, countries) from a catalogue (name, osm_tag, countries).

    Legal forms and what stands in brackets go. Up to ten letters must match
    as a whole; of a longer name its first two words. The longest come first.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"\(.*?\)", " "), r"[^\p{L}\p{N}& ]", " "))
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin(*LEGAL_FORMS))
    full = F.array_join(words, r"\s+")
    pattern = F.concat(F.lit(r"\b"), F.when(F.length(F.array_join(words, " ")) <= 10, full).otherwise(F.array_join(F.slice(words, 1, 2), r"\s+")), F.lit(r"\b"))
    named = items.select(pattern.alias("pattern"), F.size(words).alias("k"), "osm_tag", "countries").where("k > 0")
    one = named.groupBy("pattern", "osm_tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("countries")))).alias("countries"))
    order = Window.orderBy(F.desc(F.length("pattern")), "pattern", "osm_tag")  # the catalogue, a small table
    return one.select((F.row_number().over(order) - 1).alias("rule_idx"), "pattern", "osm_tag", "countries")


def rules_from_json(spark, path: str) -> DataFrame:
    """Rules of a JSON file {"rules": [...]}; a missing file gives none."""
    from pyspark.errors import AnalysisException

    schema = "rules array<struct<id:int,pattern:string,match_type:string,category:string,subcategory:string,priority:int,doc_type:string>>"
    try:
        return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("rules").alias("r")).select("r.*")
    except AnalysisException:
        return spark.createDataFrame([], schema).select(F.explode("rules").alias("r")).select("r.*")


def taxonomy_rows(spark, tree: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(type, category, subcategory, sort_order_cat, sort_order_sub) of {type: {category: [subcategories]}}, as a YAML or JSON file gives it."""
    rows = [(t, c, s, i, j) for t, cats in tree.items() for i, (c, subs) in enumerate(cats.items()) for j, s in enumerate(subs)]
    return spark.createDataFrame(rows, "type string, category string, subcategory string, sort_order_cat int, sort_order_sub int")


def latest_session(runs: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of the newest version where it is at least the given share, else those of its day, else of the newest run."""
    top = runs.agg(F.max("version").alias("version"), F.max("run_id").alias("run"), F.count(F.lit(1)).alias("all"))
    known = runs.join(F.broadcast(top.select(F.col("version").alias("_v"), "run", "all")), F.lit(True))  # one row
    n = known.agg(F.count_if(F.col("version") == F.col("_v")).alias("n"), F.max("all").alias("all"), F.max("_v").alias("v"), F.max("run").alias("r"), F.max(F.when(F.col("version") == F.col("_v"), F.to_date("started"))).alias("day")).first()
    if n["v"] is None:
        return runs.where(F.col("run_id") == n["r"]) if n["r"] is not None else runs
    if n["n"] >= share * n["all"]:
        return runs.where(F.col("version") == n["v"])
    return runs.where(F.to_date("started") == F.lit(n["day"]))


def commit_groups(runs: DataFrame, groups: DataFrame, strict: bool = False) -> DataFrame:
    """Runs with the accuracy group of their commit: UNKNOWN where there is none, or an error."""
    other = F.raise_error(F.concat(F.lit("no group for commit "), F.coalesce("commit", F.lit("null")))).cast("string") if strict else F.lit("UNKNOWN")
    return runs.join(groups, "commit", "left").withColumn("group", F.when(F.col("group").isNotNull(), F.col("group")).otherwise(other))


def union_files(spark, paths: list[str]) -> DataFrame:
    """CSV files of different columns as one table of strings, each row with its file; header rows repeated inside go."""
    parts = []
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        first = df.columns[0]
        parts.append(df.where(F.coalesce(F.col(first) != first, F.lit(True))).withColumn("source_file", F.element_at(F.split(F.lit(p), "/"), -1)))
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def patterns_union(schemas: DataFrame) -> DataFrame:
    """(pattern, pos): the patterns of all schemas' JSON lists, in order of the schema's id and place, each once."""
    each = schemas.select("id", F.posexplode(F.from_json("patterns", "array<string>")).alias("pos", "pattern"))
    return each.groupBy("pattern").agg(F.min(F.struct("id", "pos")).alias("first"))


def hardware(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Means and peaks of the samples; power counts only above zero."""
    power = F.when(F.col("power") > 0, F.col("power"))
    return samples.groupBy(*keys).agg(F.round(F.avg("cpu"), 3).alias("cpu_avg"), F.max("cpu").alias("cpu_max"), F.round(F.avg(power), 3).alias("power_avg"), F.max(power).alias("power_max"))


def expand_year(y: Column) -> Column:
    """Two-digit years: up to 30 are in the 2000s."""
    return F.when(y < 100, F.when(y <= 30, y + 2000).otherwise(y + 1900)).otherwise(y)


def common_words_removed(rows: DataFrame, share: float = 0.05) -> DataFrame:
    """Descriptions in upper case without digits and without words that more than ``share`` of all words are."""
    w = F.filter(F.split(F.regexp_replace(F.upper("description"), r"[^\p{L} ]", " "), r"\s+"), lambda x: x != "")
    long = rows.select("id", w.alias("w"))
    counts = long.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    common = counts.join(F.broadcast(total), F.col("c") > F.col("t") * share)  # the total is one row; at most 1/share words pass
    listed = common.agg(F.collect_list("word").alias("common"))
    return long.join(F.broadcast(listed), F.lit(True)).select("id", F.array_join(F.filter("w", lambda x: ~F.array_contains("common", x)), " ").alias("text"))
