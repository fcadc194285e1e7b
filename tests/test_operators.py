"""Operators without SQL: greedy pairs, settlements, inference, statements, changes, the model's place, sinks."""

import datetime as dt
import json
import random
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallywright.operators import changes, filters, ingest, matching, model, roles, stats, text
from tallywright.schema import MONEY
from tallywright.sources import sinks, statements
from tallywright.streaming import monitor

DAY = dt.date(2024, 1, 1)
LEDGER = "id string, date date, amount decimal(18,4), account_label string, description string"


def slow_pairs(rows, words):
    """Pairs in order of both rows, each row once."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    used, out = set(), []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] in used or b[0] in used or a[3] == b[3] or abs(a[2] + b[2]) > Decimal("0.01") or abs((a[1] - b[1]).days) > 5:
                continue
            word = any(w in a[4] or w in b[4] for w in words)
            if word or (abs(a[2] + b[2]) <= Decimal("0.005") and abs((a[1] - b[1]).days) <= 1):
                out.append((a[0], b[0], "high" if word else "medium"))
                used |= {a[0], b[0]}
                break
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_transfers_are_those_of_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(f"t{i:03d}", DAY + dt.timedelta(days=rng.randrange(15)), Decimal(rng.choice([-1, 1]) * rng.choice([0, 500, 500, 1000])) / 100 + Decimal(rng.choice(["0", "0.004", "0.01"])), f"a{rng.randrange(3)}", rng.choice(["transfer", "shop"])) for i in range(120)]
    got = matching.transfer_pairs(spark.createDataFrame(rows, LEDGER), ["transfer"]).select("a_id", "b_id", "confidence").collect()
    assert sorted(map(tuple, got)) == slow_pairs(rows, ["transfer"])


def test_links_go_by_sign(spark):
    rows = [("x", DAY, Decimal(500), "a", "s"), ("y", DAY, Decimal(-500), "b", "s")]
    assert [tuple(r) for r in matching.transfer_links(matching.transfer_pairs(spark.createDataFrame(rows, LEDGER))).collect()] == [("y", "x", "medium")]
    assert matching.transfer_pairs(spark.createDataFrame([], LEDGER)).collect() == []


def settle(spark, settles, cards):
    s = spark.createDataFrame(settles, "account_label string, id string, amount decimal(18,4), date date")
    c = spark.createDataFrame(cards, "account_label string, id string, amount decimal(18,4), date date")
    return sorted((r["settlement_id"], r["detail_id"], r["method"]) for r in matching.card_settlements(s, c).collect())


def test_settlements(spark):
    d = lambda k: DAY + dt.timedelta(days=k)
    cards = [("p", f"c{i}", Decimal(a), d(k)) for i, (a, k) in enumerate([(-10, 0), (-20, 2), (-30, 4), (-7, 20), (-11, 40), (-500, 200)])] + [("q", "z", Decimal(-30), d(1))]
    assert settle(spark, [("p", "s1", Decimal(-60), d(30))], cards) == [("s1", "c0", "run"), ("s1", "c1", "run"), ("s1", "c2", "run")]
    assert settle(spark, [("p", "s1", Decimal(-17), d(30))], cards) == [("s1", "c0", "subset"), ("s1", "c3", "subset")]
    assert settle(spark, [("p", "s1", Decimal(-500), d(30)), ("p", "s2", Decimal(-3), d(30))], cards) == []
    assert settle(spark, [("p", "s1", Decimal(-30), d(30)), ("p", "s2", Decimal(-30), d(31)), ("q", "s3", Decimal(-30), d(9))], cards) == [("s1", "c0", "run"), ("s1", "c1", "run"), ("s2", "c2", "run"), ("s3", "z", "run")]


def test_balance_row_needs_three_rows(spark):
    rows = [("1", DAY, Decimal(-5), "f", ""), ("2", DAY, Decimal(-7), "f", ""), ("3", DAY, Decimal(12), "f", ""), ("4", DAY, Decimal(1), "g", ""), ("5", DAY, Decimal(1), "g", "")]
    assert [r["id"] for r in matching.balance_rows(spark.createDataFrame(rows, LEDGER), "account_label").collect()] == ["3"]


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    texts = sorted({" ".join(rng.sample("aa bb cc dd ee ff gg hh".split(), rng.randrange(1, 6))) for _ in range(60)})
    rows = spark.createDataFrame([(t, DAY, Decimal(1), "a", t) for t in texts], LEDGER)
    sets = {t: set(t.split()) for t in texts}
    want = {(a, b) for a, b in combinations(texts, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r["a"], r["b"]) for r in matching.similar_pairs(rows, 0.5).collect()} == want


STATEMENT = "Account statement;;;\r\nHolder: TEST USER;;;\r\nDate;Details;Amount;Currency\r\n05/01/2026;\"POS 12,50; SHOP ALPHA\";-12,50;EUR\r\n06/01/2026;TRANSFER IN EMPLOYER BETA;1.850,00;EUR\r\n06/01/2026;POS SHOP ALPHA;-12,50;EUR\r\nClosing balance: 1.825,00;;;"


def test_statement_end_to_end(spark, tmp_path):
    (tmp_path / "one.csv").write_bytes(b"\xef\xbb\xbf" + STATEMENT.encode())
    (tmp_path / "two.csv").write_bytes(STATEMENT.replace("ALPHA", "CAFÉ").encode("latin-1"))
    texts = statements.with_text(statements.read_files(spark, str(tmp_path)))
    assert {r["source_file"]: r["encoding"] for r in texts.collect()} == {"one.csv": "UTF-8", "two.csv": "ISO-8859-1"}
    rows = statements.with_cells(statements.lines_of(texts))
    assert {(r["header_idx"], r["certain"]) for r in statements.header_rows(rows).collect()} == {(2, True)}
    body = statements.strip_footer_missing(rows.where("row_idx > 2"), [0, 1, 2])
    assert body.groupBy("source_file").count().where("count <> 3").count() == 0
    profile = [r.asDict() for r in ingest.column_profiles(body).where("source_file = 'one.csv'").orderBy("col").collect()]
    schema = ingest.infer_schema(profile, ["Date", "Details", "Amount", "Currency"])
    assert (schema.date, schema.description, schema.amount) == (0, 1, 2) and ingest.usable(schema)
    out = ingest.canonical(rows.where("row_idx > 2"), schema, F.lit("main"))
    good = sorted((r["source_file"], r["date"].isoformat(), r["amount"]) for r in out.where("reject is null").collect())
    assert [x[1:] for x in good[:3]] == [("2026-01-05", Decimal("-12.5")), ("2026-01-06", Decimal("-12.5")), ("2026-01-06", Decimal("1850"))]
    assert {tuple(r) for r in ingest.reject_reasons(out).collect()} == {("no date", 2)}
    assert "CAFÉ" in " ".join(r["description"] for r in out.where("reject is null").collect())


def test_preheader_cap_raises(spark):
    rows = spark.createDataFrame([("f", i, "", ["x"] + [None] * 3 if i < 4 else ["a", "b", "c", "d"]) for i in range(20)], "source_file string, row_idx int, line string, cells array<string>")
    with pytest.raises(Exception, match="too many sparse rows"):
        statements.strip_preheader(rows).collect()


def test_footer_keeps_gaps_inside(spark):
    cells = [["1", "a"], ["1", None], ["2", "b"], ["3", "c"], [None, "total"]]
    rows = spark.createDataFrame([("f", i, "", c) for i, c in enumerate(cells)], "source_file string, row_idx int, line string, cells array<string>")
    assert [r["row_idx"] for r in statements.strip_footer_missing(rows, [0, 1]).orderBy("row_idx").collect()] == [0, 1, 2, 3]


def profile(col, kind, n=10, filled=10, distinct=9, negatives=0, categorical=False):
    return {"col": col, "kind": kind, "n": n, "filled": filled, "distinct": distinct, "negatives": negatives, "nonzero": filled, "categorical": categorical}


def test_roles():
    base = [profile(0, "date"), profile(1, "date"), profile(2, "text")]
    names = ["Value date", "Booking date", "Details", "A", "B"]
    s = ingest.infer_schema([*base, profile(3, "amount", filled=6), profile(4, "amount", filled=4)], names)
    assert (s.date, s.debit, s.credit, s.convention) == (1, 3, 4, "debit_positive")
    assert ingest.infer_schema([*base, profile(3, "amount", filled=4), profile(4, "amount", filled=6, negatives=6)], names).debit == 4
    card = ingest.infer_schema([*base, profile(3, "amount")], names, "credit_card")
    assert card.amount == 3 and card.invert
    assert not ingest.usable(ingest.infer_schema(base, names))
    merged = roles.merged_schema(ingest.infer_schema(base, names), ingest.StatementSchema(date=7, amount=3, convention="signed_single"))
    assert (merged.date, merged.amount) == (1, 3)
    assert roles.repaired_name(" DETAILS", names) == "Details" and roles.repaired_name("zz", names) is None
    assert ingest.confidence_score(True, True, True, True, True, False, False) == (0.8, "high") and ingest.confidence_score(True, True, True, False, False, False, False)[1] == "medium"


def test_filters_refuse_unknown_keys(spark):
    with pytest.raises(ValueError, match="from_date"):
        filters.ledger_predicate(from_date="2024-01-01")
    with pytest.raises(ValueError, match="needs a filter"):
        changes.delete_where(spark.createDataFrame([], LEDGER))


def test_model_slots_fall_back(spark):
    class Broken:
        name = "broken"

        def complete(self, prompts):
            raise RuntimeError("down")

    key = model.KeywordBackend({"x": {"category": "c"}})
    assert model.complete_with_fallback([Broken(), key], ["ax", "b"]) == [({"category": "c"}, "keyword"), (None, "quarantine")]
    rows = spark.createDataFrame([("ax",), ("ax",), ("b",), (None,)], "p string")
    assert sorted(map(tuple, model.ask(rows, F.col("p"), [key], ["category"]).collect()), key=str) == [("ax", "c", "keyword"), ("b", None, "quarantine")]


def test_matching_back_is_greedy(spark):
    a = spark.createDataFrame([(1, 0, "red shoe"), (1, 1, "red"), (1, 2, "zzz")], "batch int, i int, text string")
    b = spark.createDataFrame([(1, 0, "red shoe shop"), (1, 1, "the red one")], "batch int, j int, text string")
    assert sorted((r["j"], r["i"]) for r in matching.reverse_matches(a.withColumnRenamed("i", "j"), b.withColumnRenamed("j", "i")).collect()) == [(0, 0), (1, 1)]


def test_rules_and_taxonomy_from_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"rules": [{"id": 1, "pattern": "a", "match_type": "exact", "category": "c", "subcategory": "s", "priority": 2}]}))
    assert [(r["id"], r["doc_type"]) for r in roles.rules_from_json(spark, str(tmp_path / "r.json")).collect()] == [(1, None)]
    assert roles.rules_from_json(spark, str(tmp_path / "none.json")).collect() == []
    assert roles.taxonomy_rows(spark, {"expense": {"Home": ["Rent", "Power"]}}).count() == 2


def test_files_of_other_columns_unite(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,2\nk,x\n3,4\n")
    (tmp_path / "b.csv").write_text("k,y\n5,6\n")
    out = roles.union_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r["k"], r["x"], r["y"], r["source_file"]) for r in out.collect()) == [("1", "2", None, "a.csv"), ("3", "4", None, "a.csv"), ("5", None, "6", "b.csv")]


def test_commit_groups_can_be_strict(spark):
    runs, groups = spark.createDataFrame([("z",)], "commit string"), spark.createDataFrame([("a", "G")], "commit string, `group` string")
    assert roles.commit_groups(runs, groups).first()["group"] == "UNKNOWN"
    with pytest.raises(Exception, match="no group"):
        roles.commit_groups(runs, groups, strict=True).collect()


def test_least_squares_recovers_a_plane(spark):
    rng = random.Random(3)
    rows = [(a := rng.random(), b := rng.random(), 2.0 + 3 * a - b) for _ in range(200)]
    out = {r["term"]: r for r in stats.least_squares(spark.createDataFrame(rows, "a double, b double, y double"), ["a", "b"], "y").collect()}
    assert out["intercept"]["coef"] == pytest.approx(2) and out["a"]["coef"] == pytest.approx(3) and out["b"]["coef"] == pytest.approx(-1) and out["a"]["r2"] == pytest.approx(1)
    assert stats.least_squares(spark.createDataFrame([], "a double, b double, y double"), ["a", "b"], "y").collect() == []


def test_text_chunks_and_questions(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "\n\n" + "b" * 100 + "\n\n" + "c" * 200 + "\n\n" + "d" * 900), (2, "  "), (3, None)], "doc_id long, text string")
    assert [(r["doc_id"], len(r["text"])) for r in text.chunks(docs).orderBy("doc_id", "chunk").collect()] == [(1, 402), (1, 200), (1, 900)]
    faq = text.faq_entries(spark.createDataFrame([("# Top\n## How?\nSo.\n\n## Why\nThus\nthen",)], "text string")).collect()
    assert [tuple(r) for r in faq] == [("How?", "So."), ("Why", "Thus\nthen")]
    best = text.retrieve_or_rewritten(
        spark.createDataFrame([(1, "red apple pie"), (2, "blue sky day")], "doc_id long, text string"), spark.createDataFrame([(1, "zz apple")], "item_id long, text string"), spark.createDataFrame([(1, "blue sky day")], "item_id long, text string"), 1, 0.0
    ).collect()
    assert [(r["doc_id"], r["rank"]) for r in best] == [(2, 1)]


def ledger_row(i, context=None, **more):
    return {"id": i, "date": DAY, "amount": Decimal(-5), "currency": "EUR", "description": "<b>", "raw_description": "r", "account_label": "a", "doc_type": "bank_account", "tx_type": "expense", "category": "A&B", "subcategory": "s",
            "category_confidence": "low", "category_source": "rule", "context": context, "to_review": False, "source_file": "f"} | more


def test_sinks(spark, tmp_path):
    kinds = "id string, date date, amount decimal(18,4), currency string, description string, raw_description string, account_label string, doc_type string, tx_type string, category string, subcategory string, category_confidence string, category_source string, context string, to_review boolean, source_file string"
    led = spark.createDataFrame([ledger_row("1", "trip"), ledger_row("2")], kinds)
    sinks.write_csv(led, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_by_context(led, str(tmp_path / "ctx"))
    assert spark.read.parquet(str(tmp_path / "ctx")).where("context = 'trip'").count() == 1
    page = sinks.html_report(led, "My <report>")
    assert "A&amp;B" in page and "&lt;report&gt;" in page and "-10.00" in page
    links = spark.createDataFrame([("1", "9")], "a string, b string")
    assert {r["id"]: r["reconciled"] for r in sinks.persist(led.limit(0), led, links).collect()} == {"1": True, "2": False}


def test_changes_to_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "k int, v string")
    assert sorted(map(tuple, changes.insert_absent(a, b, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, changes.upsert(a, b.distinct(), ["k"]).collect())) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(map(tuple, changes.integrity(a, b.distinct(), ["k"]).collect())) == [(1, "deleted"), (2, "modified"), (3, "added")]


def test_late_files_count_at_the_next_trigger(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", Decimal(1)), (2, "b", Decimal(2))], "k int, g string, value decimal(18,4)")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: {(r["g"], r["n"]) for r in monitor.run_once(monitor.progress_counts(monitor.arriving(spark, str(tmp_path / "in"), rows.schema), ["k"], ["g"]), str(tmp_path / "m")).collect()}
    assert run() == {("a", 1), ("b", 1)}
    spark.createDataFrame([(2, "b", Decimal(2)), (3, "b", Decimal(5))], rows.schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {("a", 1), ("b", 2)}


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], LEDGER)
    assert matching.balance_rows(empty, "account_label").collect() == [] and matching.similar_pairs(empty, 0.5).collect() == []
    assert MONEY.scale == 4
