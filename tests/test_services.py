"""Taxonomy edits, schema caches, review reruns and matching back on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.functions.scalars import containment
from tallywright.operators import matching, review, schemas, taxonomy

TAXONOMY = "type string, category string, subcategory string, sort_order_cat int, sort_order_sub int"
EDITS = "pos int, category string, subcategory string, new string"


def replay(rows, edits):
    """One edit after the other, subcategories under the category's first name."""
    cats = {}
    for t, c, s, i, j in rows:
        cats.setdefault(c, {"name": c, "rows": []})["rows"].append([t, s, i, j])
    edits = sorted(edits)
    for _, c, s, new in edits:
        if s is None and new is None:
            cats.pop(c, None)
    originals = set(cats)
    for _, c, s, new in edits:
        if s is None and new and new != c and c in originals:
            for x in cats.values():
                if x["name"] == c:
                    x["name"] = new
    for _, c, s, new in edits:
        if s is not None and new is None and c in cats:
            cats[c]["rows"] = [r for r in cats[c]["rows"] if r[1] != s]
    for _, c, s, new in edits:
        if s is not None and new and new != s and c in cats:
            for r in cats[c]["rows"]:
                if r[1] == s:
                    r[1] = new
    return sorted((t, x["name"], s, i, j) for x in cats.values() for t, s, i, j in x["rows"])


@pytest.mark.parametrize("seed", range(3))
def test_edit_logs(spark, seed):
    rng = random.Random(seed)
    rows = [("expense", f"c{c}", f"s{s}", c, s) for c in range(8) for s in range(5)]
    names = [f"c{i}" for i in range(10)]
    edits = [(p, rng.choice(names), None, rng.choice([None, "", "x", *names])) if rng.random() < 0.5 else (p, rng.choice(names), f"s{rng.randrange(6)}", rng.choice([None, "", "s1", "s2", "y"])) for p in range(25)]
    got = taxonomy.overridden(spark.createDataFrame(rows, TAXONOMY), spark.createDataFrame(edits, EDITS))
    assert sorted(map(tuple, got.collect())) == replay(rows, edits)
    assert sorted(map(tuple, taxonomy.overridden(spark.createDataFrame(rows, TAXONOMY), spark.createDataFrame([], EDITS)).collect())) == rows


def test_templates_by_language(spark):
    t = spark.createDataFrame([("it", "expense", "Casa", "Affitto", 1, 1), ("en", "expense", "Home", "Rent", 1, 1), ("en", "expense", "Home", None, 1, 2)], f"language string, {TAXONOMY}")
    assert [r["category"] for r in taxonomy.seeded(t, "en").collect()] == ["Home"]
    assert [r["category"] for r in taxonomy.seeded(t, "xx").collect()] == ["Casa"]


def test_reverse_matching_is_greedy(spark):
    rng = random.Random(5)
    words = ["shop", "bar", "pay", "alpha", "beta", "42"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))
    names, texts = [(b, j, text()) for b in "xy" for j in range(8)], [(b, i, text()) for b in "xy" for i in range(8)]
    n, t = spark.createDataFrame(names, "batch string, j int, text string"), spark.createDataFrame(texts, "batch string, i int, text string")
    score = {(r["batch"], r["i"], r["j"]): r["s"] for r in n.withColumnRenamed("text", "a").join(t, "batch").select("batch", "i", "j", containment(F.col("a"), F.col("text")).alias("s")).collect()}
    used, want = set(), []
    for (b, i, j), s in sorted(score.items(), key=lambda x: (-x[1], -x[0][1], -x[0][2])):
        if s > 0 and (b, "i", i) not in used and (b, "j", j) not in used:
            used |= {(b, "i", i), (b, "j", j)}
            want.append((b, i, j))
    assert sorted((r["batch"], r["i"], r["j"]) for r in matching.reverse_matches(n, t).collect()) == sorted(want)


def test_rerun_changes_chosen_rows_only(spark):
    kinds = "id string, description string, raw_description string, doc_type string, tx_type string, amount decimal(18,4), category string, subcategory string, category_source string, category_confidence string, to_review boolean"
    rows = [("1", "old", "new ring", None, "expense", -1, None, None, None, None, True), ("2", "old", None, None, "expense", -1, "K", "k", "manual", "high", True), ("3", "x", "y", None, "internal_out", -1, None, None, None, None, True), ("4", "x", "y", None, "income", 1, "Z", "z", "llm", "low", False), ("5", "x", "y", None, None, 1, "Z", "z", "llm", "low", True)]
    from decimal import Decimal

    ledger = spark.createDataFrame([(*r[:5], Decimal(r[5]), *r[6:]) for r in rows], kinds)
    rule = [{"id": 1, "pattern": "ring", "match_type": "contains", "category": "Jewels", "subcategory": "Rings", "priority": 1}]
    none = spark.createDataFrame([], "description string, category string, subcategory string, confidence double")
    change = review.rerun(ledger, F.col("raw_description"), rule, none)
    got = {r["id"]: (r["description"], r["category"], r["category_source"], r["to_review"]) for r in review.applied(ledger, change).collect()}
    assert got == {"1": ("new ring", "Jewels", "rule", False), "2": ("old", "K", "manual", True), "3": ("x", None, None, True), "4": ("x", "Z", "llm", False), "5": ("y", "Other income", "fallback", True)}


def test_footer_patterns_merge_in_order(spark):
    cache = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "key string, footers array<string>")
    found = spark.createDataFrame([("a", ["z", "x"]), ("b", ["q"]), ("c", ["r"])], "key string, footers array<string>")
    assert {r["key"]: r["footers"] for r in schemas.with_footers(cache, found).collect()} == {"a": ["x", "y", "z"], "b": ["q"]}
    assert schemas.without_schemas(cache).count() == 0


def test_roles_of_odd_files(spark):
    """No rows, one column, no names: a schema that isn't usable rejects every row."""
    rows = spark.createDataFrame([("f", 0, ["only", None]), ("f", 1, ["text", None])], "source_file string, row_idx int, cells array<string>")
    heads = spark.createDataFrame([("f", 0, ["only", ""], "k")], "source_file string, header_idx int, names array<string>, key string")
    found = schemas.inferred_schemas(rows.where("row_idx > 0"), heads)
    assert [(r["date"], r["amount"], r["usable"]) for r in found.collect()] == [(None, None, False)]
    assert [r["reject"] for r in schemas.parsed(rows.where("row_idx > 0"), found).collect()] == ["no date"]
    assert schemas.inferred_schemas(rows.limit(0), heads).collect() == []
