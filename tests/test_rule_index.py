"""The rule index against every rule on every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallywright.operators import rule_index, rules

COLUMNS = "id int, pattern string, match_type string, category string, subcategory string, priority int, doc_type string"


@pytest.mark.parametrize("pattern, want", [
    ("shop 12", "shop 12"), (r"^Shop\b", "shop"), (r"a|bcd", ""), (r"(abc|d)efg", "efg"), (r"(?:abc)d", "abcd"), (r"ab+cd", "cd"), (r"ab*cde", "cde"), (r"x{0,3}yz", "yz"), (r"[ab]cd\.e", "cd.e"),
    (r"\d+ eur", " eur"), (r"caffè nero", " nero"), (r"(?i)abc", None), (r"\Qa\E", None), (r"(unclosed", None), (r"a++b", None), (r".*", ""), ("", ""), (None, ""), (r"(abc){2}", "abc"), (r"(abc)?d", "d"),
])
def test_literals(pattern, want):
    assert rule_index.literal(pattern) == want


def test_literals_are_in_all_that_matches():
    rng = random.Random(1)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "C", ".", "a+", "b*", "(ab|c)", "(?:bc)", "[ab]", "c?", "^", "$", r"\b", "é", "(a)+"]) for _ in range(rng.randint(1, 6)))
        must = rule_index.literal(pattern)
        text = "".join(rng.choice("abcABCé ") for _ in range(8))
        if re.search(pattern, text, re.I | re.A) and must:
            assert must in text.lower(), (pattern, text)


def slow(texts, table):
    out = []
    for i, (text, doc) in enumerate(texts):
        best = None
        for rid, pattern, kind, cat, sub, prio, only in table:
            if text is None or (only and doc is not None and doc != only):
                continue
            try:
                hit = text.lower() == pattern.lower() if kind == "exact" else pattern.lower() in text.lower() if kind == "contains" else re.search(pattern, text, re.I | re.A) is not None
            except re.error:
                continue
            if hit and (best is None or (-prio, rid) < best[0]):
                best = ((-prio, rid), cat, sub)
        if best:
            out.append((f"t{i}", best[0][1], best[1], best[2]))
    return sorted(out)


def test_first_match_of_all_kinds(spark):
    rng = random.Random(7)
    words = ["shop", "market", "Caffè", "BAR", "pay", "12", "ring", "earring", "é", "a", "İz", "x-y", "c.d"]
    texts = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.choice(["bank_account", "credit_card", None])) for _ in range(150)] + [(None, None), ("", None)]
    table = []
    for i in range(120):
        pattern = " ".join(rng.choice(words) for _ in range(rng.randint(1, 2)))
        kind = rng.choice(["exact", "contains", "regex"])
        if kind == "regex":
            pattern = rng.choice([pattern.replace(".", r"\."), f"^{rng.choice(words)}", rf"\b{rng.choice(words)}\b", r"\d+$", "(market|pay) a", "(broken", "[a", ".+ .+ .+ .+", rf"{rng.choice(words)}.*é"])
        elif rng.random() < 0.3:
            pattern = pattern[: rng.randint(1, 2)]
        table.append((i, pattern, kind, f"c{i}", "s", rng.randint(0, 3), rng.choice([None, "", "bank_account", "credit_card"])))
    ledger = spark.createDataFrame([(f"t{i}", t, d) for i, (t, d) in enumerate(texts)], "id string, description string, doc_type string")
    got = rules.join_rules(ledger, spark.createDataFrame(table, COLUMNS))
    assert sorted(map(tuple, got.collect())) == slow(texts, table)


def test_a_hundred_thousand_rules(spark):
    ledger = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("id"), F.concat(F.lit("payment to shop number "), (F.col("id") * 7).cast("string"), F.lit(" end")).alias("description"), F.lit(None).cast("string").alias("doc_type"))
    table = spark.range(100_000).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("number "), "id", F.lit(" end")).alias("pattern"), F.when(F.col("id") % 2 == 0, "contains").otherwise("regex").alias("match_type"), F.concat(F.lit("c"), "id").alias("category"), F.lit("s").alias("subcategory"), F.lit(0).alias("priority"), F.lit(None).cast("string").alias("doc_type"))
    got = rules.join_rules(ledger, table)
    want = [(f"t{i}", i * 7) for i in range(20_000) if i * 7 < 100_000]
    assert sorted((r["id"], r["rule_id"]) for r in got.collect()) == sorted(want)


def test_rules_without_a_literal_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "BLOCK", 3)
    texts = spark.createDataFrame([("a1",), ("b22",), ("zz",)], "text string")
    table = spark.createDataFrame([(i, p, "regex") for i, p in enumerate([r"\d", r"\d\d", "[a-b]", ".", r"^\w+$", r"\d{3}", "(a|z)"])] + [(9, "", "contains")], "rule int, pattern string, kind string")
    got = sorted((r["text"], r["rule"]) for r in rule_index.matches(texts, table).collect())
    assert got == sorted([("a1", 0), ("b22", 0), ("b22", 1), ("a1", 2), ("b22", 2), *[(t, 3) for t in ("a1", "b22", "zz")], *[(t, 4) for t in ("a1", "b22", "zz")], ("a1", 6), ("zz", 6), *[(t, 9) for t in ("a1", "b22", "zz")]])


def test_unknown_kinds_and_empty_tables(spark):
    ledger = spark.createDataFrame([("t", "x", None)], "id string, description string, doc_type string")
    assert rules.join_rules(ledger, spark.createDataFrame([], COLUMNS)).collect() == []
    with pytest.raises(Exception, match="unknown match type"):
        rules.join_rules(ledger, spark.createDataFrame([(1, "x", "nearly", "c", "s", 0, None)], COLUMNS)).collect()
