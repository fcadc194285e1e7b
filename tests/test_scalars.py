"""Column functions on the rows of the fixtures document."""

import re
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallywright.functions import scalars as S


def apply(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in rows.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {
        "42": 42, "-12.50": "-12.5", "1.234,56": "1234.56", "1,234.56": "1234.56", "12,50": "12.5", "1,234": 1234, "€ 99,99": "99.99", "N/A": None, "": None, "  ": None, None: None,
        "1.234": "1.234", "1,2,3": 123, "-1.234.567,8": "-1234567.8", "nan": None, "+1.5": "1.5", "0": 0, "abc12": None, "12,5 €": "12.5",
    }
    assert apply(spark, list(cases), S.parse_amount) == [None if v is None else Decimal(v).quantize(Decimal("0.0001")) for v in cases.values()]


def test_dates(spark):
    cases = {"15/03/2024": "2024-03-15", "2024-03-15": "2024-03-15", "5/3/2026": "2026-03-05", "15/03/99": "1999-03-15", "31/02/2026": None, "text": None, "": None, None: None, "2024/3/5": "2024-03-05", "12/25/2024": "2024-12-25", "1-2-68": "2068-02-01"}
    assert apply(spark, list(cases), S.parse_date) == [None if v is None else dt.date.fromisoformat(v) for v in cases.values()]
    assert apply(spark, ["20240315"], lambda c: S.parse_date(c, "yyyyMMdd")) == [dt.date(2024, 3, 15)]


@pytest.mark.parametrize(
    ("convention", "amount", "debit", "credit", "want"),
    [
        ("signed_single", 5, 1, 2, 5), ("debit_positive", 9, 3, None, -3), ("debit_positive", 9, None, 3, 3), ("debit_positive", 9, -3, 5, 2), ("debit_positive", 9, None, None, 9), ("debit_positive", 9, 0, None, 0),
        ("debit_credit_signed", 9, -3, None, -3), ("debit_credit_signed", 9, None, 4, 4), ("debit_credit_signed", 9, -3, 4, -3), ("debit_credit_signed", 9, None, None, 9),
        ("credit_negative", 9, None, 4, 4), ("credit_negative", 9, 3, None, -3), ("credit_negative", 9, 3, 0, -3), ("credit_negative", 9, None, None, 9),
    ],
)
def test_signs(spark, convention, amount, debit, credit, want):
    m = lambda x: F.lit(x).cast(S.MONEY)
    got = spark.range(1).select(S.signed_amount(convention, m(amount), m(debit), m(credit)).alias("o")).first()["o"]
    assert got == want


def test_descriptions_join_without_repeats(spark):
    rows = spark.createDataFrame([("Pos Shop", "shop", "nan", "0b2d3c4e-1111-2222-3333-444455556666", None, " more ")], "a string, b string, c string, d string, e string, f string")
    assert rows.select(S.join_descriptions(*[F.col(c) for c in "abcdef"]).alias("o")).first()["o"] == "Pos Shop more"


def test_identifiers(spark):
    row = lambda acc, amount: spark.range(1).select(S.transaction_id(F.lit(acc), F.lit("f.csv"), F.lit("2024-01-01").cast("date"), F.lit(amount).cast(S.MONEY), F.lit("x")).alias("o")).first()["o"]
    assert len(row("a", "1.5")) == 24 and row("a", "1.5") == row("a", "1.5000") != row("a", "100") and row("", "1") == row("f.csv", "1") != row("b", "1")
    assert apply(spark, ["100.0000", "1.5", "0"], lambda c: S.plain_amount(c)) == ["100", "1.5", "0"]


def test_redaction(spark):
    texts = ["IT60X0542811101000000123456 ok", "4111 1111 1111 1111 and 4111-1111-1111-1111", "XXXX XXXX XXXX 1234", "from Rossi  Paolo, PAOLO ROSSI", None, "code ABC-12"]
    got = apply(spark, texts, lambda c: S.redact(c, owners=["Paolo Rossi"], extra=[r"[A-Z]{3}-\d+"]))
    assert got[1] == "<CARD_ID> and <CARD_ID>" and got[2] == "XXXX XXXX <CARD_ID>" and got[3] == f"from {S.alias(0)}, {S.alias(0)}" and got[4] == "" and got[5] == "code <REDACTED>"
    assert "<ACCOUNT_ID>" in got[0] and "0542811101000000123456" not in got[0]
    assert apply(spark, got[3:4], lambda c: S.restore_aliases(c, ["Paolo Rossi"])) == ["from Paolo Rossi, Paolo Rossi"]


def test_redaction_of_each_kind(spark):
    """Accounts, cards, short masked cards, bank codes and fiscal codes in any case; owners keep apart beyond the pool."""
    cases = {
        "card ****1234 CAU 12345 RSSMRA80A01H501U": "card <CARD_ID> <TX_CODE> <FISCAL_ID>", "XXXX-1234": "<CARD_ID>", "4111 1111 1111 1": "<CARD_ID>", "nds 99, Pos12-3": "<TX_CODE>, <TX_CODE>",
        "ID  transazione 55": "<TX_CODE>", "rssmra80a01h501u": "<FISCAL_ID>", "IT60X0542811101000000123456": "<ACCOUNT_ID>", "IT60": "IT60", "12345": "12345", "": "",
    }
    assert apply(spark, list(cases), S.redact) == list(cases.values())
    owners = ["Anna Verdi", "Bruno Neri", "Carl Blu", "D E", "F", "G H", "Ida Rosa", " "]
    texts = [f"paid {o} and {' '.join(o.split()[::-1])}" for o in owners[:-1]]
    for lang in ("it", "en", "de", "fr", "es", "xx"):
        hidden = apply(spark, texts, lambda c: S.redact(c, owners=owners, lang=lang))
        assert len(set(hidden)) == len(texts) and not any(re.search(rf"\b{re.escape(o)}\b", h) for o, h in zip(owners, hidden))
        assert apply(spark, [h.upper() for h in hidden], lambda c: S.restore_aliases(c, owners, lang)) == [f"PAID {o} AND {o}" for o in owners[:-1]]


def test_display(spark):
    assert apply(spark, ["-1234.5", "0"], lambda c: S.display_amount(c.cast(S.MONEY))) == ["-1.234,50 €", "+0,00 €"]
    assert apply(spark, ["12|", "|5", "3|nan", "|"], S.display_raw_amount) == ["12", "5", "3", ""]
    assert apply(spark, ["2024-02-01", "no"], S.display_date) == ["01/02/2024", "no"]
    assert apply(spark, ["a☺ b!  c", None], S.strip_non_text) == ["a b! c", None]


def test_normal_description(spark):
    """Composition, folding and white space of any kind; null stays null."""
    cases = {"  Cafe\u0301 ": "caf\u00e9", "STRA\u1e9eE\u00a0": "strasse", "\t POS 12\x1f\n": "pos 12", "\u039f\u03a3": "\u03bf\u03c3", "\ufb01N": "fin", "\u0130": "i\u0307", "": "", " ": "", None: None}
    assert apply(spark, list(cases), S.normal_description) == list(cases.values())
