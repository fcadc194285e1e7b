"""Queries of history, rules, brands, the category cascade, transfers, settlements and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import filters, history, matching, rules
from ..sources.adapters import EVENTS_SQL, ledger_events
from .register import on_events, on_ledger, query

# ---- history
VALID = "human_validated IS TRUE AND category IS NOT NULL AND description IS NOT NULL"
ASSOC = f"SELECT description, category, subcategory, count(*) AS n FROM ledger WHERE {VALID} GROUP BY 1, 2, 3"
PROFILES = f"""a AS ({ASSOC}), s AS (SELECT *, n / sum(n) OVER (PARTITION BY description) AS p, row_number() OVER (PARTITION BY description ORDER BY n DESC, category, coalesce(subcategory, '')) AS rn FROM a),
 g AS (SELECT description, CAST(sum(n) AS BIGINT) AS total, count(*) AS k, sum(-p * log2(p)) AS h, max(CASE WHEN rn = 1 THEN category END) AS category, max(CASE WHEN rn = 1 THEN subcategory END) AS subcategory FROM s GROUP BY 1),
 e AS (SELECT *, CASE WHEN k <= 1 THEN 0 ELSE h / log2(k) END AS entropy FROM g),
 prof AS (SELECT description, total, round(entropy, 6) AS entropy, round(1 - entropy, 6) AS homogeneity, round((1 - entropy) * least(1.0, total / 5), 6) AS confidence, category, subcategory FROM e)"""
on_ledger("agg_associations", ASSOC)(history.associations)


def repeated(d: DataFrame) -> DataFrame:
    """Descriptions made of the part and a number, so that some are sure and some are mixed."""
    return d.withColumn("description", F.concat("description", F.lit(" "), F.substring("raw_amount", 1, 1), F.substring("subcategory", -1, 1))).withColumn("category", F.when(F.length("description") % 2 == 0, F.col("account_label")).otherwise(F.lit("HOME")))


REPEATED = "r AS (SELECT * REPLACE (CASE WHEN length(description || ' ' || substr(raw_amount, 1, 1) || right(subcategory, 1)) % 2 = 0 THEN account_label ELSE 'HOME' END AS category, description || ' ' || substr(raw_amount, 1, 1) || right(subcategory, 1) AS description) FROM ledger)"
RPROFILES = REPEATED + ", " + PROFILES.replace("FROM ledger", "FROM r")
on_ledger("agg_profiles", f", {RPROFILES} SELECT * FROM prof")(lambda d: history.profiles(repeated(d)))
on_ledger("agg_assoc_summary", f", {RPROFILES} SELECT CASE WHEN total < 3 THEN 'new' WHEN confidence >= 0.9 THEN 'auto' WHEN confidence >= 0.5 THEN 'suggest' ELSE 'mixed' END AS badge, count(*) AS n FROM prof GROUP BY 1")(
    lambda d: history.badge_counts(repeated(d))
)
on_ledger(
    "agg_assoc_text",
    f""", {RPROFILES}, t AS (SELECT *, row_number() OVER (ORDER BY total DESC, description) AS rank FROM prof WHERE confidence >= 0.5 AND total >= 3 ORDER BY total DESC, description LIMIT 50),
 l AS (SELECT rank, description || ' -> ' || category || '/' || coalesce(subcategory, '') || ' (' || CAST(total AS VARCHAR) || ')' AS line FROM t), u AS (SELECT *, sum(length(line) + 1) OVER (ORDER BY rank) - 1 AS used FROM l)
 SELECT coalesce(string_agg(line, chr(10) ORDER BY rank), '') AS text FROM u WHERE used <= 2000""",
)(lambda d: history.association_text(repeated(d)))
on_ledger(
    "jn_history_lookup",
    f""", {RPROFILES} SELECT id, CASE WHEN confidence >= 0.5 THEN prof.category END AS category, CASE WHEN confidence >= 0.5 THEN prof.subcategory END AS subcategory,
 CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' END AS category_confidence, confidence >= 0.5 AND confidence < 0.9 AS to_review FROM r LEFT JOIN prof ON r.description = prof.description""",
)(lambda d: history.lookup(repeated(d), history.profiles(repeated(d))))


def newest_id(d: DataFrame) -> list[str]:
    return [r["id"] for r in d.where("description = 'small ring' and category is not null").agg(F.max("id").alias("id")).collect() if r["id"]]


on_ledger(
    "dml_fanout",
    """, src AS (SELECT category, subcategory, context FROM ledger WHERE id = (SELECT max(id) FROM ledger WHERE description = 'small ring' AND category IS NOT NULL))
 SELECT id, src.category AS category, src.subcategory AS subcategory, src.context AS context, 'history' AS category_source, 'high' AS category_confidence FROM ledger, src
 WHERE description = 'small ring' AND human_validated IS NOT TRUE AND id <> (SELECT max(id) FROM ledger WHERE description = 'small ring' AND category IS NOT NULL)""",
)(
    lambda d: history.fan_out(d, newest_id(d)).where((F.col("description") == "small ring") & ~F.coalesce("human_validated", F.lit(False)) & ~F.col("id").isin(newest_id(d)))
    .select("id", "category", "subcategory", "context", "category_source", "category_confidence")
)

# ---- rules and brands
RULES = [
    {"id": 1, "pattern": "ring", "match_type": "contains", "category": "Jewels", "subcategory": "Rings", "priority": 5, "doc_type": None},
    {"id": 2, "pattern": "small ring", "match_type": "exact", "category": "Small", "subcategory": "Ring", "priority": 9, "doc_type": "bank_account"},
    {"id": 3, "pattern": "^(red|blue) .*t$", "match_type": "regex", "category": "Colour", "subcategory": "Warm", "priority": 5, "doc_type": None},
    {"id": 4, "pattern": "BOLT", "match_type": "contains", "category": "Tools", "subcategory": "Bolts", "priority": 1, "doc_type": None},
]
FIRST = """CASE WHEN description = 'small ring' AND doc_type = 'bank_account' THEN 2 WHEN contains(description, 'ring') THEN 1 WHEN regexp_matches(description, '(?i)^(red|blue) .*t$') THEN 3 WHEN contains(description, 'bolt') THEN 4 END"""
RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"({r['id']}, '{r['category']}', '{r['subcategory']}')" for r in RULES) + ") AS x(rule_id, category, subcategory))"
RULED = f", {RULES_SQL}, f AS (SELECT id, {FIRST} AS rule_id FROM ledger) SELECT id, f.rule_id, category, subcategory FROM f JOIN rules ON f.rule_id = rules.rule_id"
RULE_COLUMNS = "id int, pattern string, match_type string, category string, subcategory string, priority int, doc_type string"
on_ledger("jn_rules", RULED)(lambda d: rules.apply_rules(d, RULES))
on_ledger("jn_rules_table", RULED)(lambda d: rules.join_rules(d, d.sparkSession.createDataFrame(RULES, RULE_COLUMNS)))

BRANDS = [(0, r"\bring\b", "shop=jewelry", ["fr"]), (1, r"\bring\b", "shop=ring", ["it"]), (2, r"\bbolt\b", "shop=hardware", []), (3, r"\b(nut|bolt)\b", "shop=nuts", ["us"]), (4, r"\bwidget\b", "shop=toys", ["us"])]
CONTINENTS = {"it": "eu", "fr": "eu", "de": "eu", "us": "na"}


def brands(spark) -> DataFrame:
    return spark.createDataFrame(BRANDS, "rule_idx int, pattern string, osm_tag string, countries array<string>")


BRAND_SQL = (
    "brands AS (SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}', CAST([{}] AS VARCHAR[]))".format(i, p, t, ", ".join(f"'{c}'" for c in cs)) for i, p, t, cs in BRANDS)
    + """) AS b(rule_idx, pattern, osm_tag, countries)), h AS (SELECT description AS name, rule_idx, osm_tag, CASE WHEN list_contains(countries, 'it') THEN 0 WHEN len(list_intersect(countries, ['it', 'fr', 'de'])) > 0 THEN 1 WHEN len(countries) = 0 THEN 2 ELSE 3 END AS score, countries FROM (SELECT DISTINCT description FROM ledger) JOIN brands ON regexp_matches(description, '(?i)' || pattern)),
 b1 AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY name ORDER BY score, rule_idx) = 1), w AS (SELECT id, rule_idx, osm_tag, score, countries FROM ledger JOIN b1 ON description = name)"""
)
on_ledger("jn_brand", f", {BRAND_SQL} SELECT id, CAST(rule_idx AS INTEGER) AS rule_idx, osm_tag, CAST(score AS INTEGER) AS score FROM w")(
    lambda d: rules.brand_matches(d, brands(d.sparkSession), "it", CONTINENTS).drop("countries")
)
OSM = [("shop=ring", "Jewels", "Rings"), ("shop=hardware", "Home", "Tools"), ("shop=nuts", "Food", "Nuts")]
OSM_SQL = "osm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in OSM) + ") AS o(osm_tag, category, subcategory))"


def bypass(d: DataFrame) -> DataFrame:
    spark = d.sparkSession
    return rules.brand_categories(rules.brand_matches(d, brands(spark), "it", CONTINENTS), spark.createDataFrame(OSM, "osm_tag string, category string, subcategory string"), "it")


on_ledger("jn_brand_bypass", f", {BRAND_SQL}, {OSM_SQL} SELECT id, category, subcategory FROM w JOIN osm ON w.osm_tag = osm.osm_tag WHERE len(countries) = 0 OR list_contains(countries, 'it')")(bypass)


def taxonomy(d: DataFrame) -> DataFrame:
    """What the parts say, less one brand, as expense; a few also as income under another category."""
    pairs = d.where("category is not null and subcategory <> 'Brand#11'").select(F.lit("expense").alias("type"), "category", "subcategory").distinct()
    return pairs.unionByName(d.sparkSession.createDataFrame([("income", "AAA", "Brand#12"), ("income", "Salary", "Brand#11")], "type string, category string, subcategory string"))


TAXONOMY = "tax AS (SELECT DISTINCT 'expense' AS type, category, subcategory FROM ledger WHERE category IS NOT NULL AND subcategory <> 'Brand#11' UNION ALL SELECT 'income', 'AAA', 'Brand#12' UNION ALL SELECT 'income', 'Salary', 'Brand#11')"
on_ledger(
    "jn_taxonomy_valid",
    f""", {TAXONOMY}, p AS (SELECT subcategory, category AS parent FROM tax QUALIFY row_number() OVER (PARTITION BY subcategory ORDER BY type <> 'expense', category) = 1), v AS (SELECT DISTINCT category, subcategory FROM tax)
 SELECT l.id, v.category IS NOT NULL AS valid, coalesce(v.category, p.parent) AS category, l.subcategory FROM ledger l LEFT JOIN v ON l.category = v.category AND l.subcategory = v.subcategory LEFT JOIN p ON l.subcategory = p.subcategory""",
)(lambda d: rules.valid_pairs(d, taxonomy(d)))
on_ledger("cs_fallback", "SELECT id, CASE WHEN amount < 0 THEN 'Other expenses' ELSE 'Other income' END AS category, 'Uncategorised' AS subcategory FROM ledger")(
    lambda d: d.withColumn("f", rules.fallback(F.col("amount"))).select("id", "f.category", "f.subcategory")
)
CASCADE = f""", {REPEATED.replace('r AS', 'rr AS')}, {PROFILES.replace('FROM ledger', 'FROM rr')}, {BRAND_SQL.replace('FROM ledger', 'FROM rr')}, {OSM_SQL},
 bc AS (SELECT id, category, subcategory FROM w JOIN osm ON w.osm_tag = osm.osm_tag WHERE len(countries) = 0 OR list_contains(countries, 'it')), {RULES_SQL}, f AS (SELECT *, {FIRST} AS rule_id FROM rr),
 j AS (SELECT f.id, amount, rules.rule_id AS rid, rules.category AS rc, rules.subcategory AS rs, p.category AS hc, p.subcategory AS hs, p.confidence AS conf, bc.category AS bcat, bc.subcategory AS bsub
 FROM f LEFT JOIN rules ON f.rule_id = rules.rule_id LEFT JOIN (SELECT * FROM prof WHERE confidence >= 0.5) p ON f.description = p.description LEFT JOIN bc ON f.id = bc.id)
 SELECT id, coalesce(rc, hc, bcat, CASE WHEN amount < 0 THEN 'Other expenses' ELSE 'Other income' END) AS category, CASE WHEN rc IS NOT NULL THEN rs WHEN hc IS NOT NULL THEN hs WHEN bcat IS NOT NULL THEN bsub ELSE 'Uncategorised' END AS subcategory,
 CASE WHEN rc IS NOT NULL THEN 'rule' WHEN hc IS NOT NULL THEN 'history' WHEN bcat IS NOT NULL THEN 'brand' ELSE 'fallback' END AS category_source,
 CASE WHEN rc IS NOT NULL THEN 'high' WHEN hc IS NOT NULL THEN CASE WHEN conf >= 0.9 THEN 'high' ELSE 'medium' END WHEN bcat IS NOT NULL THEN 'high' ELSE 'low' END AS category_confidence,
 CASE WHEN rc IS NOT NULL THEN false WHEN hc IS NOT NULL THEN conf < 0.9 WHEN bcat IS NOT NULL THEN false ELSE true END AS to_review FROM j"""
on_ledger("cs_categorize", CASCADE)(lambda d: rules.categorise(repeated(d), RULES, history.profiles(repeated(d)), bypass(repeated(d))))

# ---- transfers, settlements, duplicates
WORDS = ["purchase"]
CANDIDATES = """, p AS (SELECT a.id AS a_id, b.id AS b_id, a.date AS a_date, b.date AS b_date, a.amount AS a_amount, b.amount AS b_amount,
 CASE WHEN contains(a.description, 'purchase') OR contains(b.description, 'purchase') THEN 'high' WHEN abs(a.amount + b.amount) <= 0.005 AND abs(a.date - b.date) <= 1 THEN 'medium' END AS confidence
 FROM ledger a JOIN ledger b ON a.account_label <> b.account_label AND abs(a.amount + b.amount) <= 0.01 AND abs(a.date - b.date) <= 5 AND (a.date < b.date OR (a.date = b.date AND a.id < b.id)))
 SELECT * FROM p WHERE confidence IS NOT NULL"""
on_events("jn_transfer_candidates", CANDIDATES)(lambda d: matching.transfer_candidates(d, WORDS))
# the sequential pass: one step a candidate, with the list of taken rows
PAIRS = f"""WITH RECURSIVE {EVENTS_SQL}{CANDIDATES.removesuffix(" SELECT * FROM p WHERE confidence IS NOT NULL")}, n AS (SELECT *, CAST(a_id AS BIGINT) AS a, CAST(b_id AS BIGINT) AS b, row_number() OVER (ORDER BY a_date, a_id, b_date, b_id) AS i FROM p WHERE confidence IS NOT NULL),
 g(i, used, hit) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false UNION ALL SELECT n.i, CASE WHEN list_contains(used, n.a) OR list_contains(used, n.b) THEN used ELSE list_concat(used, [n.a, n.b]) END, NOT (list_contains(used, n.a) OR list_contains(used, n.b)) FROM g JOIN n ON n.i = g.i + 1),
 m AS (SELECT n.* FROM g JOIN n ON g.i = n.i WHERE hit)"""
query("jn_transfer_pairs", f"{PAIRS} SELECT a_id, b_id, a_date, b_date, a_amount, b_amount, confidence FROM m")(lambda spark, d: matching.transfer_pairs(ledger_events(spark, d), WORDS))
query("jn_transfer_links", f"{PAIRS} SELECT CASE WHEN a_amount <= b_amount THEN a_id ELSE b_id END AS out_id, CASE WHEN a_amount <= b_amount THEN b_id ELSE a_id END AS in_id, confidence FROM m")(
    lambda spark, d: matching.transfer_links(matching.transfer_pairs(ledger_events(spark, d), WORDS))
)
on_ledger("jn_transfer_owner", "SELECT id, CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END AS tx_type FROM ledger WHERE (contains(description, 'small ring') OR contains(description, 'ring small')) AND coalesce(tx_type, '') <> 'card_settlement'")(
    lambda d: matching.owner_transfers(d, S.owner_pattern(["ring small"]), d.where("tx_type = 'card_settlement'").select("id"))
)
on_ledger(
    "cln_card_balance",
    """, t AS (SELECT *, sum(abs(amount)) OVER (PARTITION BY date, account_label) AS s, count(*) OVER (PARTITION BY date, account_label) AS n FROM ledger)
 SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY date, account_label ORDER BY id) AS rn FROM t WHERE n >= 3 AND abs(abs(amount) - (s - abs(amount))) <= 2000) WHERE rn = 1""",
)(lambda d: matching.balance_rows(d.withColumn("day_file", F.concat_ws("|", "date", "account_label")), "day_file", "2000").select("id"))


def settlements(d: DataFrame) -> DataFrame:
    """Some of the days' purchases as settlements, a few days on, over the card rows of a week."""
    cards = d.where("event_type = 'purchase'")
    weeks = cards.groupBy("account_label", F.date_trunc("week", "date").cast("date").alias("w")).agg(F.sum("amount").alias("amount"))
    due = weeks.select("account_label", F.concat_ws("-", F.lit("s"), "account_label", "w").alias("id"), F.col("amount").cast("decimal(18,4)").alias("amount"), F.date_add("w", 8).alias("date"))
    return matching.card_settlements(due, cards.select("account_label", "id", "amount", "date"))


on_events("mt_settlement")(settlements)
KEYS = "SELECT date, raw_description, amount FROM k WHERE raw_description IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT account_label) > 1"
on_ledger(
    "jn_cross_dups",
    f", k AS (SELECT * REPLACE (CAST(floor(amount / 1000) AS DECIMAL(18,4)) AS amount) FROM ledger) SELECT id, account_label, k.date, k.amount FROM k JOIN ({KEYS}) g ON k.date = g.date AND k.raw_description = g.raw_description AND k.amount = g.amount",
)(lambda d: matching.cross_account_duplicates(d.withColumn("amount", F.floor(F.col("amount") / 1000).cast("decimal(18,4)"))).select("id", "account_label", "date", "amount"))
on_ledger(
    "jn_similar_jaccard",
    """, t AS (SELECT id, description, list_distinct(string_split(lower(description), ' ')) AS w FROM ledger WHERE description <> ''), q AS (SELECT list_distinct(string_split('small red ring', ' ')) AS w)
 SELECT id, round(len(list_intersect(t.w, q.w)) / len(list_distinct(list_concat(t.w, q.w))), 6) AS score FROM t, q WHERE len(list_intersect(t.w, q.w)) / len(list_distinct(list_concat(t.w, q.w))) >= 0.35""",
)(lambda d: matching.similar_to(d, "small red ring", 0.35).select("id", F.round("score", 6).alias("score")))
on_ledger(
    "jn_similar_pairs",
    """, t AS (SELECT DISTINCT description, list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda w: length(w) > 1)) AS w FROM ledger WHERE description IS NOT NULL)
 SELECT a.description AS a, b.description AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS score FROM t a JOIN t b ON a.description < b.description
 WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.3""",
)(lambda d: matching.similar_pairs(d, 0.3))
on_ledger("flt_by_ids", "SELECT id, date FROM ledger WHERE id IN (SELECT min(id) FROM ledger)")(lambda d: d.join(d.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "date"))
on_ledger("flt_delete_subset", "SELECT id FROM ledger WHERE account_label = 'BUILDING' AND date <= DATE '1996-01-31'")(
    lambda d: d.where(filters.ledger_predicate(filters.DELETE_KEYS, account_label="BUILDING", date_to="1996-01-31")).select("id")
)
