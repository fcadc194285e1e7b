"""The pass over cells of rows against the sequential one, matching back in large batches, and roles of short files."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallywright.operators import matching, pairing, review, schemas

from .test_operators import DAY, LEDGER, slow_pairs


def dense(seed, n):
    rng = random.Random(seed)
    cents = lambda: Decimal(rng.choice([-1, 1]) * rng.randrange(12)) / 100 + Decimal(rng.choice(["0", "0.004", "0.01"]))
    return [(f"t{i * 7919 % 100003}", DAY + dt.timedelta(days=rng.randrange(25)), cents(), rng.choice("abc"), rng.choice(["transfer", "shop"])) for i in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_cells_give_the_sequential_pass(spark, monkeypatch, seed):
    """Cents without gaps, so that decisions reach from cell to cell of amounts and of days."""
    rows = dense(seed, 700)
    monkeypatch.setattr(pairing.sequential_pairs, "__defaults__", (120,))
    got = matching.transfer_pairs(spark.createDataFrame(rows, LEDGER), ["transfer"]).select("a_id", "b_id", "confidence").collect()
    assert sorted(map(tuple, got)) == slow_pairs(rows, ["transfer"])


def test_few_passes_across_edges(spark, monkeypatch):
    """With one kind of cell these rows take a pass more."""
    rng, passes, saved = random.Random(1), [], pairing.saved
    cents = lambda: rng.choice((-1, 1)) * Decimal(rng.randrange(60)) / 100
    rows = [(f"t{i * 7919 % 100003:06}", DAY.replace(month=1, day=1) + dt.timedelta(days=i // 40), cents(), f"a{i % 50}", "transfer") for i in range(1200)]

    def counted(df):
        passes.append("changed" in df.columns)
        return saved(df)

    monkeypatch.setattr(pairing, "saved", counted)
    monkeypatch.setattr(pairing.sequential_pairs, "__defaults__", (300,))
    got = matching.transfer_pairs(spark.createDataFrame(rows, LEDGER), ["transfer"]).select("a_id", "b_id", "confidence").collect()
    assert sorted(map(tuple, got)) == slow_pairs(rows, ["transfer"])
    assert sum(passes) - 1 <= 3  # the first is the input


def test_pass_needs_no_candidates(spark, monkeypatch):
    """2000 rows and 2000 that cancel any of them, four million candidates: none is made."""
    monkeypatch.setattr(matching, "transfer_candidates", None)
    rows = [(f"r{i:04}", DAY, Decimal(5 if i % 2 else -5), f"a{i % 2}", "s") for i in range(4000)]
    got = matching.transfer_pairs(spark.createDataFrame(rows, LEDGER)).collect()
    assert sorted((r["a_id"], r["b_id"]) for r in got) == [(f"r{i:04}", f"r{i + 1:04}") for i in range(0, 4000, 2)]


def test_repeated_ids_and_null_accounts(spark):
    rows = [("x", DAY, Decimal(5), "a", "s"), ("x", DAY, Decimal(5), "b", "s"), ("y", DAY, Decimal(-5), "c", "s"), ("z", DAY, Decimal(-5), None, "s")]
    assert [tuple(r)[:2] for r in matching.transfer_pairs(spark.createDataFrame(rows, LEDGER)).collect()] == [("x", "y")]


def test_repair_gives_the_difference(spark):
    rows = dense(5, 300)
    new = [(i, d, a - Decimal("0.01") if k % 10 == 3 else a, *rest) for k, (i, d, a, *rest) in enumerate(rows)]
    old = matching.transfer_pairs(spark.createDataFrame(rows, LEDGER), ["transfer"])
    gone, come = review.repaired_transfers(old, spark.createDataFrame(new, LEDGER), ["transfer"])
    before, after = set(slow_pairs(rows, ["transfer"])), set(slow_pairs(new, ["transfer"]))
    pairs = lambda d: {(r["a_id"], r["b_id"], r["confidence"]) for r in d.collect()}
    assert pairs(gone) == before - after and pairs(come) == after - before


@pytest.mark.parametrize("most", (4_000_000, 20))
def test_matching_back_by_sets_of_words(spark, monkeypatch, most):
    """Few sets of words on many rows, in one task and, for batches of too many pairs of sets, by rounds."""
    monkeypatch.setattr(matching, "CLASS_PAIRS", most)
    rng = random.Random(3)
    words = ["shop", "bar", "pay", "alpha"]
    text = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    names, texts = ([(b, k, text()) for b, n in (("x", 40), ("y", 3)) for k in range(n)] for _ in "ab")
    scored = sorted(((-len(set(n.split()) & set(t.split())) / len(set(n.split())), -i, -j, b) for b, j, n in names for c, i, t in texts if b == c))
    used, want = set(), []
    for s, i, j, b in scored:
        if s < 0 and not used & {(b, "i", i), (b, "j", j)}:
            used |= {(b, "i", i), (b, "j", j)}
            want.append((b, -i, -j, -s))
    got = matching.reverse_matches(spark.createDataFrame(names, "batch string, j int, text string"), spark.createDataFrame(texts, "batch string, i int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_debit_and_credit_by_name_in_short_files(spark):
    """Files with more inflows than outflows, and with one side alone."""
    head = ["date", "description", "debit", "credit"]
    rows = [("more in", i, ["01/02/2024", f"t{i}", None if i else "5.00", "7.00" if i else None]) for i in range(4)]
    rows += [("out", 0, ["01/02/2024", "t", "5.00", None]), ("in", 0, ["01/02/2024", "t", None, "5.00"]), ("signed", 0, ["01/02/2024", "t", "-5.00", None])]
    body = spark.createDataFrame(rows, "source_file string, row_idx int, cells array<string>")
    heads = body.select("source_file").distinct().selectExpr("source_file", "0 header_idx", "array('" + "','".join(head) + "') names", "'k' key")
    got = {r["source_file"]: (r["amount"], r["debit"], r["credit"], r["convention"]) for r in schemas.inferred_schemas(body, heads).collect()}
    assert got == {f: (None, 2, 3, "debit_credit_signed" if f == "signed" else "debit_positive") for f in ("more in", "out", "in", "signed")}
