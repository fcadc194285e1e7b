"""Column functions: amounts, dates, descriptions, identifiers, redaction, display."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import MONEY

# Date layouts tried in this order after the given one.
DATE_LAYOUTS = ("d/M/yyyy", "d-M-yyyy", "d/M/yy", "d-M-yy", "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M/d/yy")
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def _last(c: Column, ch: str) -> Column:
    """1-based place of the last ``ch``, 0 if there is none."""
    at = F.instr(F.reverse(c), ch)
    return F.when(at > 0, F.length(c) - at + 1).otherwise(0)


def parse_amount(c: Column) -> Column:
    """A localised amount as decimal(18,4), null if it is none.

    With both separators the later one is decimal. A lone comma is decimal if
    it is the only one and at most two digits follow; a lone dot always is.
    """
    s = F.regexp_replace(c.cast("string"), r"[€$£\s ]", "")
    comma, dot = _last(s, ","), _last(s, ".")
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    european = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    plain = F.replace(s, F.lit(","), F.lit(""))
    clean = (
        F.when((comma > 0) & (dot > 0), F.when(comma > dot, european).otherwise(plain))
        .when(comma > 0, F.when((commas == 1) & (F.length(s) - comma <= 2), F.replace(s, F.lit(","), F.lit("."))).otherwise(plain))
        .otherwise(s)
    )
    # a failing cast raises and catches an exception, which costs many times the rest; no number holds these
    return F.when(~F.regexp(c.cast("string"), F.lit(r"[/:|]|[\p{L}&&[^eE]]")), clean.try_cast(MONEY))


def signed_amount(convention: str, amount: Column | None = None, debit: Column | None = None, credit: Column | None = None) -> Column:
    """Negative for expense, by the statement's convention; falls back to the amount where debit and credit are null."""
    null = F.lit(None).cast(MONEY)
    a, d, c = (x if x is not None else null for x in (amount, debit, credit))
    none = d.isNull() & c.isNull()
    if convention == "signed_single":
        return a
    if convention == "debit_positive":
        value = F.abs(F.coalesce(c, F.lit(0).cast(MONEY))) - F.abs(F.coalesce(d, F.lit(0).cast(MONEY)))
    elif convention == "debit_credit_signed":
        value = F.coalesce(d, c)
    elif convention == "credit_negative":
        value = F.when(c > 0, c).otherwise(-F.abs(d))
    else:
        raise ValueError(f"unknown sign convention: {convention}")
    return F.when(none, a).otherwise(value).cast(MONEY)


def parse_date(c: Column, layout: str | None = None) -> Column:
    """The first layout that reads the whole string. Two-digit years from 69 on are in the 1900s."""
    s = F.trim(c)

    def read(fmt: str) -> Column:
        d = F.try_to_date(s, fmt)
        if "yyyy" in fmt:
            return F.when(F.length(F.regexp_extract(s, r"\d{4}", 0)) == 4, d)
        short = F.when(~F.regexp(s, F.lit(r"\d{4}")), d)
        return F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)

    def fits(sep: str) -> Column:
        """What all layouts with this separator need; a failing try raises and catches an exception, which costs many times the rest."""
        return F.regexp(s, F.lit(rf"^[0-9+\-]+{sep}[0-9+\-]+{sep}[0-9+\-]+$"))

    own = [read(layout)] if layout else []
    return F.coalesce(*own, *[F.when(fits("/" if "/" in f else "-"), read(f)) for f in DATE_LAYOUTS if f != layout])


def join_descriptions(*parts: Column) -> Column:
    """Parts in order, without empty ones, nan, null, identifiers, and what the text already holds."""

    def add(acc: Column, x: Column) -> Column:
        skip = (x == "") | F.lower(x).isin("nan", "null") | F.regexp(x, F.lit(_UUID)) | F.contains(F.lower(acc), F.lower(x))
        return F.when(skip, acc).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x))

    return F.aggregate(F.array(*[F.trim(F.coalesce(p.cast("string"), F.lit(""))) for p in parts]), F.lit(""), add)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold().strip())


def normal_description(c: Column) -> Column:
    """Composed (NFC), case-folded, without outer white space; null stays null.

    Spark has neither composition nor folding. Plain ASCII text, which needs
    neither, stays in the JVM; only other texts are sent to Python.
    """
    plain = F.regexp(c, F.lit(r"^[\x00-\x7F]*$"))
    return F.coalesce(_composed(F.when(~plain, c)), F.lower(F.btrim(c, F.lit(" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))))


def plain_amount(c: Column) -> Column:
    """The amount without trailing zeros or exponent: its form in identifiers."""
    s = c.cast("decimal(18,4)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")


def transaction_id(account: Column, file: Column, date: Column, amount: Column, description: Column) -> Column:
    owner = F.when(F.trim(F.coalesce(account, F.lit(""))) == "", file).otherwise(account)
    return F.substring(F.sha2(F.concat_ws("|", owner, date.cast("string"), plain_amount(amount), F.coalesce(description, F.lit(""))), 256), 1, 24)


def transaction_type(description: Column, amount: Column, doc_type: Column, transfer_words: list[str]) -> Column:
    transfer = reduce(lambda a, b: a | b, [F.contains(F.lower(description), F.lit(w.lower())) for w in transfer_words], F.lit(False))
    return (
        F.when(F.coalesce(transfer, F.lit(False)), F.when(amount < 0, "internal_out").otherwise("internal_in"))
        .when(doc_type == "credit_card", "card_tx").when(amount > 0, "income").otherwise("expense")
    )


def strip_non_text(c: Column) -> Column:
    """Letters, numbers, punctuation and spaces only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}\p{P}\p{Z}\t ]", ""), r"\s+", " "))


# Patterns of account and card data, bank codes and fiscal codes, in the order in which they are replaced.
REDACTIONS = (
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,30}\b", "<ACCOUNT_ID>", ""),
    (r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,7}\b", "<CARD_ID>", ""),
    (r"[\*X]{4}[\s\-]?\d{4}", "<CARD_ID>", ""),
    (r"\b(CAU|NDS|POS|TRN|CRO|RIF|ID\s*TRANSAZIONE)\s*[\d\-]+", "<TX_CODE>", "i"),
    (r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b", "<FISCAL_ID>", "i"),
)
#: Invented stand-ins by language, rare enough not to be met in statements.
ALIASES = {
    "it": ("Ottavio Brusadin", "Ginevra Pellizzon", "Tarcisio Bonfante", "Ersilia Moncalvo", "Ludovico Scarpante", "Fiorenza Valdemar"),
    "en": ("Osbert Tanfield", "Millicent Harrowby", "Lambert Quillen", "Dorothea Wexcombe", "Ambrose Pickersley", "Cordelia Thornby"),
    "de": ("Gottlieb Ahrenfels", "Walburga Steinkamp", "Ruprecht Tannhoff", "Adelheid Moorbach", "Leberecht Wiesner", "Kunigunde Harzer"),
    "fr": ("Anatole Brisefer", "Clotilde Marchebois", "Gaspard Vallombre", "Honorine Pontcarré", "Fulgence Darmoy", "Ursuline Laverdin"),
    "es": ("Fermín Aldeanueva", "Casilda Montoro", "Baldomero Ribadeo", "Eulalia Santibarra", "Leandro Ojuelos", "Rosaura Villacampa"),
}


def owner_pattern(names: list[str]) -> str:
    """Any order of a name's words, with any space between."""
    quoted = [[rf"\Q{w}\E" for w in n.split()] for n in names if n.split()]
    return r"(?i)(?U)\b(?:" + "|".join(r"\s+".join(p) for q in quoted for p in permutations(q)) + r")\b"


def alias(i: int, lang: str = "it") -> str:
    """The stand-in of owner ``i``; beyond the pool the names are numbered, so that no two owners share one."""
    pool = ALIASES.get(lang, ALIASES["it"])
    return pool[i % len(pool)] + (f" {i // len(pool) + 1}" if i >= len(pool) else "")


def redact(c: Column, owners: list[str] = (), extra: list[str] = (), lang: str = "it") -> Column:
    """Owner names to aliases, then accounts, cards, masked cards, bank codes, fiscal codes and extra patterns to tags; null to ''."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for i, name in enumerate(owners):
        if name.split():
            out = F.regexp_replace(out, owner_pattern([name]), alias(i, lang))
    for pattern, tag, flags in (*REDACTIONS, *((e, "<REDACTED>", "i") for e in extra)):
        out = F.regexp_replace(out, f"(?{flags}U){pattern}", tag)
    return out


def restore_aliases(c: Column, owners: list[str], lang: str = "it") -> Column:
    """The owners' names in place of their stand-ins, in any case; numbered stand-ins first, as they hold others."""
    out = c
    for i, name in reversed(list(enumerate(owners))):
        if name.split():
            out = F.regexp_replace(out, rf"(?iU)\b\Q{alias(i, lang)}\E\b", name.strip().replace("\\", "\\\\").replace("$", "\\$"))
    return out


def is_clean(c: Column) -> Column:
    """Neither an account nor a whole card number is left."""
    return ~(F.regexp(c, F.lit(f"(?U){REDACTIONS[0][0]}")) | F.regexp(c, F.lit(f"(?U){REDACTIONS[1][0]}")))


def tokens(c: Column) -> Column:
    """Distinct lower-case words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", -1), lambda w: F.length(w) > 1))


def containment(out: Column, source: Column) -> Column:
    """Share of out's tokens that source has; 0 without tokens."""
    a = tokens(out)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, tokens(source))), F.size(a)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def display_amount(c: Column, decimal: str = ",", thousands: str = ".", symbol: str = "€") -> Column:
    text = F.translate(F.format_number(F.abs(c), 2), ",.", thousands + decimal)
    return F.concat(F.when(c < 0, "-").otherwise("+"), text, F.lit(f" {symbol}"))


def display_raw_amount(c: Column) -> Column:
    """Of 'debit|credit' the credit if it says anything, else the debit."""
    credit, debit = F.trim(F.split_part(c, F.lit("|"), F.lit(2))), F.trim(F.split_part(c, F.lit("|"), F.lit(1)))
    return F.when(~F.lower(credit).isin("", "nan", "none", "0"), credit).otherwise(debit)


def display_date(c: Column, layout: str = "dd/MM/yyyy") -> Column:
    return F.coalesce(F.date_format(F.try_to_date(c, "yyyy-MM-dd"), layout), c)


def period_bounds(d: Column, unit: str) -> tuple[Column, Column]:
    """First and last day of the month, quarter or year of a date."""
    first = F.trunc(d, unit)
    return first, F.date_sub(F.add_months(first, {"month": 1, "quarter": 3, "year": 12}[unit]), 1)
