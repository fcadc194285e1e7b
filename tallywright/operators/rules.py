"""Categories by rules, history, brands and a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stored import saved
from . import rule_index
from .filters import rule_matches
from .rule_index import compiles


def inline_rules(rules: list[dict]) -> Column:
    """The first rule that matches, by priority (high first), then id: a struct, or null.

    A rule: id, pattern, match_type, category, subcategory, priority, and
    optionally doc_type, which then must equal the row's. Any number of rules
    is one expression over the row. A regex that does not compile is skipped;
    an unknown match type is refused.
    """
    out = []
    for r in sorted(rules, key=lambda r: (-r["priority"], r["id"])):
        if r["match_type"] == "regex" and not compiles(r["pattern"]):
            continue
        hit = rule_matches(r["pattern"], r["match_type"])
        if r.get("doc_type"):
            hit &= F.coalesce(F.col("doc_type") == r["doc_type"], F.lit(True))
        out.append(F.when(hit, F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["category"]).alias("category"), F.lit(r["subcategory"]).alias("subcategory"))))
    return F.coalesce(*out) if out else F.lit(None).cast("struct<rule_id:int,category:string,subcategory:string>")


def apply_rules(ledger: DataFrame, rules: list[dict]) -> DataFrame:
    """id, rule_id, category, subcategory of the rows that some rule matches."""
    return ledger.withColumn("r", inline_rules(rules)).where("r is not null").select("id", "r.rule_id", "r.category", "r.subcategory")


def join_rules(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a table of rules, of any number, by an index of what descriptions must hold.

    A regex that does not compile is skipped; an unknown match type is refused.
    """
    known = F.when(F.col("match_type").isin("exact", "contains", "regex"), F.col("match_type")).otherwise(F.raise_error(F.concat(F.lit("unknown match type: "), F.coalesce("match_type", F.lit("null")))).cast("string"))
    table = rules.select("pattern", known.alias("kind"), F.struct((-F.col("priority")).alias("o"), "id", "category", "subcategory").alias("rule"), F.nullif(F.col("doc_type"), F.lit("")).alias("only"))
    texts = saved(ledger.select(F.col("description").alias("text"), "doc_type").where("text is not null").distinct())
    found = rule_index.matches(texts.select("text").distinct(), table)
    fits = F.coalesce(F.col("doc_type") == F.col("only"), F.lit(True))
    best = texts.join(found, "text").where(fits).groupBy("text", "doc_type").agg(F.min("rule").alias("r"))
    same = (F.col("l.description") == F.col("b.text")) & F.col("l.doc_type").eqNullSafe(F.col("b.doc_type"))
    return ledger.alias("l").join(best.alias("b"), same).select("l.id", F.col("b.r.id").alias("rule_id"), "b.r.category", "b.r.subcategory")


def brand_matches(ledger: DataFrame, brands: DataFrame, country: str | None, continents: dict[str, str]) -> DataFrame:
    """id and the best brand rule: same country first, then same continent, universal, other; ties by rule order.

    brands: rule_idx, pattern, osm_tag, countries, any number, by the index of
    ``rule_index``. Without a country the first rule in order wins. Patterns
    that do not compile are skipped.
    """
    names = saved(ledger.select(F.col("description").alias("text")).where("text is not null").distinct())
    near = [c for c, k in continents.items() if country and k == continents.get(country)]
    has = lambda cs: F.exists("countries", lambda x: x.isin(cs)) if cs else F.lit(False)
    score = F.when(has([country] if country else []), 0).when(has(near), 1).when(F.size("countries") == 0, 2).otherwise(3) if country else F.lit(0)
    table = brands.where("pattern is not null").select("pattern", F.lit("regex").alias("kind"), "rule_idx", "osm_tag", "countries")
    hits = rule_index.matches(names, table)
    best = hits.groupBy("text").agg(F.min(F.struct(score.alias("score"), "rule_idx", "osm_tag", "countries")).alias("b"))
    return ledger.select("id", F.col("description").alias("text")).join(best, "text").select("id", F.col("b.rule_idx").alias("rule_idx"), F.col("b.osm_tag").alias("osm_tag"), F.col("b.score").cast("int").alias("score"), F.col("b.countries").alias("countries"))


def brand_categories(matches: DataFrame, osm_map: DataFrame, country: str) -> DataFrame:
    """Categories of brand matches that are universal or of the country."""
    ok = (F.size("countries") == 0) | F.array_contains("countries", country)
    return matches.where(ok).join(osm_map, "osm_tag").select("id", "category", "subcategory")


def valid_pairs(ledger: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Each row's pair checked against the taxonomy; a known subcategory alone gives its category, expense types first."""
    pairs = taxonomy.select("category", "subcategory").distinct().withColumn("valid", F.lit(True))
    parent = taxonomy.groupBy("subcategory").agg(F.min(F.struct((F.col("type") != "expense").alias("o"), F.col("category"))).getField("category").alias("parent"))
    out = ledger.select("id", "category", "subcategory").join(pairs, ["category", "subcategory"], "left").join(parent, "subcategory", "left")
    return out.select("id", F.coalesce("valid", F.lit(False)).alias("valid"), F.when(F.col("valid"), F.col("category")).otherwise(F.col("parent")).alias("category"), "subcategory")


def fallback(amount: Column) -> Column:
    return F.when(amount < 0, F.struct(F.lit("Other expenses").alias("category"), F.lit("Uncategorised").alias("subcategory"))).otherwise(
        F.struct(F.lit("Other income").alias("category"), F.lit("Uncategorised").alias("subcategory"))
    )


def categorise(ledger: DataFrame, rules: list[dict], profiles: DataFrame, brands: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """The cascade: rules, then history, brands, a model's answers (id, category, subcategory), then the fallback."""
    from .history import AUTO, SUGGEST

    p = profiles.where(F.col("confidence") >= SUGGEST).select("description", F.struct("category", "subcategory").alias("h"), "confidence")
    out = ledger.select("id", "description", "doc_type", "amount").withColumn("r", inline_rules(rules)).join(p, "description", "left")
    none = F.lit(None).cast("struct<category:string,subcategory:string>")
    for name, df in (("b", brands), ("m", model)):
        out = out.join(df.select("id", F.struct("category", "subcategory").alias(name)), "id", "left") if df is not None else out.withColumn(name, none)
    r = F.when(F.col("r").isNotNull(), F.struct("r.category", "r.subcategory"))
    source = F.when(F.col("r").isNotNull(), "rule").when(F.col("h").isNotNull(), "history").when(F.col("b").isNotNull(), "brand").when(F.col("m").isNotNull(), "llm").otherwise("fallback")
    out = out.withColumn("c", F.coalesce(r, "h", "b", "m", fallback(F.col("amount")))).withColumn("category_source", source)
    conf = F.when(F.col("category_source").isin("rule", "brand"), "high").when(F.col("category_source") == "history", F.when(F.col("confidence") >= AUTO, "high").otherwise("medium")).when(F.col("category_source") == "llm", "medium").otherwise("low")
    return out.withColumn("category_confidence", conf).select("id", "c.category", "c.subcategory", "category_source", "category_confidence", (F.col("category_confidence") != "high").alias("to_review"))
