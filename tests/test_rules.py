"""Rule tables of any size, broken patterns, and the report's last row."""

import pytest
from pyspark.sql import functions as F

from tallywright.operators import changes, rules
from tallywright.sources import sinks


def rule(i, pattern, kind="contains", **more):
    return {"id": i, "pattern": pattern, "match_type": kind, "category": f"c{i}", "subcategory": "s", "priority": 0, **more}


@pytest.fixture(scope="module")
def ledger(spark):
    rows = [(f"t{i}", f"shop {i} end", "bank_account" if i % 2 else None) for i in range(600)]
    return spark.createDataFrame(rows, "id string, description string, doc_type string")


@pytest.mark.parametrize("n", [1, 201, 500])
def test_any_number_of_rules(ledger, n):
    got = {r["id"]: r["rule_id"] for r in rules.apply_rules(ledger, [rule(i, f"shop {i} ") for i in range(n)]).collect()}
    assert got == {f"t{i}": i for i in range(n)}


def test_tables_and_lists_agree(spark, ledger):
    many = [rule(i, f"^shop {i} ", "regex", doc_type="bank_account" if i % 3 else None) for i in range(250)] + [rule(900, "(unclosed", "regex"), rule(901, "SHOP 7 END", "exact", priority=5)]
    table = spark.createDataFrame(many, "id int, pattern string, match_type string, category string, subcategory string, priority int, doc_type string")
    show = lambda df: sorted(map(tuple, df.collect()))
    got = show(rules.apply_rules(ledger, many))
    assert got == show(rules.join_rules(ledger, table)) and ("t7", 901, "c901", "s") in got and len(got) == 250


def test_broken_brand_patterns_are_skipped(spark, ledger):
    brands = spark.createDataFrame([(0, "[", "a=b", []), (1, r"\bshop 5\b", "shop=five", [])], "rule_idx int, pattern string, osm_tag string, countries array<string>")
    assert [(r["id"], r["rule_idx"]) for r in rules.brand_matches(ledger, brands, None, {}).collect()] == [("t5", 1)]


def test_unknown_kinds_are_refused(ledger):
    with pytest.raises(ValueError):
        rules.apply_rules(ledger, [rule(1, "x", "nearly")])


def test_report_sums_up_what_it_does_not_show(spark):
    rows = spark.range(130).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("cat"), "id").alias("category"), (-F.col("id") - 1).cast("decimal(18,4)").alias("amount"))
    full = rows.withColumns({"date": F.lit("2024-01-01").cast("date"), "tx_type": F.lit("expense"), "to_review": F.lit(False)})
    html = sinks.html_report(full, "t")
    assert "30 more categories" in html and html.count("<tr>") == 101 and f">-{sum(range(1, 31))}.00<" in html


def test_changes_take_any_number_of_rules(ledger):
    full = ledger.withColumns({c: F.lit(None).cast("string") for c in ("category", "subcategory", "category_source", "category_confidence")}).withColumn("to_review", F.lit(True))
    out = changes.apply_rules(full, [rule(i, f"shop {i} ") for i in range(260)])
    assert out.where("category_source = 'rule'").count() == 260
