"""From cells to ledger rows: schema inference by content, canonical rows, rejects, repeats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

DATE_RE = r"^\s*\d{1,4}[/.\-]\d{1,2}[/.\-]\d{2,4}(\s+\d{1,2}:\d{2}(:\d{2})?)?\s*$"
AMOUNT_RE = r"^\s*[€$£¥₹+\-]?\s*\d[\d\s]*([.,]\d{3})*([.,]\d{1,2})?\s*[€$£¥₹]?\s*$"
SAMPLE, SHARE, CAP = 30, 0.6, 1_000_000

# Names that settle which of several columns of a kind has a role.
NAMES = {
    "date": ("data operazione", "data movimento", "transaction date", "booking date", "date", "buchungsdatum", "fecha operación"),
    "value_date": ("data valuta", "data contabile", "value date", "settlement date", "date de valeur", "wertstellung", "fecha valor"),
    "debit": ("uscita", "uscite", "addebito", "dare", "debit", "withdrawal", "charge", "soll", "cargo"),
    "credit": ("entrata", "entrate", "accredito", "avere", "credit", "deposit", "haben", "abono"),
    "amount": ("importo", "amount", "valore", "montant", "betrag", "importe"),
    "description": ("causale", "descrizione", "dettagli", "description", "details", "narrative", "libellé", "verwendungszweck", "concepto"),
}


@dataclass(frozen=True)
class StatementSchema:
    """Which cell has which role, by place."""

    date: int | None = None
    description: int | None = None
    amount: int | None = None
    debit: int | None = None
    credit: int | None = None
    convention: str = "signed_single"
    invert: bool = False
    date_layout: str | None = None


def column_kinds(long: DataFrame) -> DataFrame:
    """(source_file, col, kind) of the columns with filled cells, by the first of them; long: (source_file, row_idx, col, v)."""
    column = ["source_file", "col"]
    first = long.where("v is not null").withColumn("_k", F.row_number().over(Window.partitionBy(*column).orderBy("row_idx"))).where(F.col("_k") <= SAMPLE)
    share = lambda hit: F.try_divide(F.count_if(hit), F.count(F.lit(1)))
    is_amount = F.regexp("v", F.lit(AMOUNT_RE))
    sizes = F.array_sort(F.collect_list(F.when(is_amount, F.abs(S.parse_amount(F.col("v"))))))
    seen = first.groupBy(*column).agg(share(F.regexp("v", F.lit(DATE_RE))).alias("dates"), share(is_amount).alias("amounts"), F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")).alias("mid"))
    kind = F.when(F.col("dates") >= SHARE, "date").when((F.col("amounts") >= SHARE) & ~F.coalesce(F.col("mid") > CAP, F.lit(False)), "amount").otherwise("text")
    return seen.select(*column, kind.alias("kind"))


def column_profiles(rows: DataFrame) -> DataFrame:
    """(source_file, col, n, filled, distinct, kind, categorical, negatives, nonzero) of every column, over long cells.

    Values are counted first, so that a column is a sum over its distinct
    values; the first filled cells of a column, by which its kind goes, are cut
    off at the window, so that each task passes on these only.
    """
    long = rows.select("source_file", "row_idx", F.posexplode("cells").alias("col", "v"))
    column = ["source_file", "col"]
    values = long.groupBy(*column, "v").agg(F.count(F.lit(1)).alias("c")).withColumn("a", S.parse_amount(F.col("v")))
    of = lambda hit: F.coalesce(F.sum(F.when(hit, F.col("c"))), F.lit(0).cast("long"))
    all_ = values.groupBy(*column).agg(F.sum("c").alias("n"), of(F.col("v").isNotNull()).alias("filled"), F.count("v").alias("distinct"), of(F.col("a") < 0).alias("negatives"), of(F.col("a") != 0).alias("nonzero"))
    seen = column_kinds(long)
    g = all_.join(seen.withColumnsRenamed({"source_file": "_file", "col": "_col"}), F.col("source_file").eqNullSafe(F.col("_file")) & (F.col("col") == F.col("_col")), "left")
    categorical = (F.col("filled") == 0) | (F.col("distinct") <= 5) | (F.col("distinct") <= F.col("filled") * 0.03)
    return g.select("source_file", "col", "n", "filled", "distinct", F.coalesce("kind", F.lit("text")).alias("kind"), categorical.alias("categorical"), "negatives", "nonzero")


def debit_credit(a: dict, b: dict) -> tuple[int, int, str]:
    """(debit, credit, convention) of two amount columns: the one with negatives is debit; none: the denser one; both: the denser, signed."""
    neg = [x for x in (a, b) if x["negatives"]]
    if len(neg) == 1:
        debit = neg[0]
        return debit["col"], (b if debit is a else a)["col"], "debit_credit_signed"
    debit = a if a["filled"] >= b["filled"] else b
    return debit["col"], (b if debit is a else a)["col"], "debit_credit_signed" if neg else "debit_positive"


def infer_schema(profile: list[dict], names: list[str], doc_type: str = "bank_account") -> StatementSchema:
    """Roles of one file's columns from their profiles; names decide among several of a kind.

    Two amount columns are debit and credit if together they fill over 85 % of
    the rows and neither fills all; of several such pairs the fullest wins.
    """
    by_kind = lambda k: [p for p in profile if p["kind"] == k]
    named = lambda cols, role: next((p for w in NAMES[role] for p in cols if names[p["col"]].strip().lower() == w), None)
    dates, amounts = by_kind("date"), by_kind("amount")
    date = named(dates, "date") or next((p for p in dates if named([p], "value_date") is None), None) or (dates[0] if dates else None)
    texts = [p for p in by_kind("text") if not p["categorical"]] or by_kind("text")
    text = named(texts, "description") or max(texts, key=lambda p: p["distinct"], default=None)
    place = lambda p: p["col"] if p else None
    pairs = [(a, b) for i, a in enumerate(amounts) for b in amounts[i + 1 :] if a["filled"] + b["filled"] > 0.85 * a["n"] and max(a["filled"], b["filled"]) < a["n"]]
    if pairs:
        a, b = max(pairs, key=lambda p: p[0]["filled"] + p[1]["filled"])
        d, c, convention = debit_credit(a, b)
        return StatementSchema(place(date), place(text), None, d, c, convention)
    amount = named(amounts, "amount") or (amounts[0] if amounts else None)
    return StatementSchema(place(date), place(text), place(amount), invert=doc_type == "credit_card" and amount is not None and not amount["negatives"])


def usable(s: StatementSchema) -> bool:
    return s.date is not None and (s.amount is not None or (s.debit is not None and s.credit is not None))


def confidence_score(header: bool, date: bool, amount: bool, description: bool, sign: bool, doc_type: bool, label: bool) -> tuple[float, str]:
    """Weighted sum of what was found, and its grade."""
    score = 0.15 * header + 0.15 * date + 0.25 * amount + 0.10 * description + 0.15 * sign + 0.10 * doc_type + 0.10 * label
    return round(score, 4), "high" if score >= 0.8 else "medium" if score >= 0.5 else "low"


def rare_rows(rows: DataFrame, n: int = 20) -> DataFrame:
    """The rows of each file with the rarest columns filled: the sum of 1/density over filled cells."""
    per = Window.partitionBy("source_file")
    long = rows.select("source_file", "row_idx", F.posexplode("cells").alias("col", "v"))
    dens = long.groupBy("source_file", "col").agg((F.count("v") / F.count(F.lit(1))).alias("density"))
    scores = long.where("v is not null").join(dens, ["source_file", "col"]).groupBy("source_file", "row_idx").agg(F.sum(F.try_divide(F.lit(1.0), F.col("density"))).alias("score"))
    best = scores.withColumn("rank", F.row_number().over(per.orderBy(F.desc(F.round("score", 9)), "row_idx"))).where(F.col("rank") <= n)
    return best.select("source_file", "row_idx", F.round("score", 6).alias("score"))


def canonical(rows: DataFrame, schema: StatementSchema, account: Column, doc_type: str = "bank_account", transfer_words: list[str] = ()) -> DataFrame:
    """Ledger rows with ``reject``: null, or why a row is skipped. One plan for both outputs."""
    cell = lambda i: F.get("cells", i) if i is not None else F.lit(None).cast("string")
    amount = S.signed_amount(schema.convention, S.parse_amount(cell(schema.amount)), S.parse_amount(cell(schema.debit)), S.parse_amount(cell(schema.credit)))
    if schema.invert:
        amount = -amount
    # a filter on the result stops at the generator, so it repeats none of the parsing
    values = F.struct(S.parse_date(cell(schema.date), schema.date_layout).alias("date"), amount.alias("amount"), S.join_descriptions(cell(schema.description)).alias("description"), account.alias("account_label"))
    out = rows.select("source_file", "row_idx", F.inline(F.array(values)))
    why = F.when(F.col("date").isNull(), "no date").when(F.col("amount").isNull(), "no amount")
    out = out.withColumn("reject", why).withColumn("id", S.transaction_id(F.col("account_label"), F.col("source_file"), F.col("date"), F.col("amount"), F.col("description")))
    return out.withColumn("tx_type", S.transaction_type(F.col("description"), F.col("amount"), F.lit(doc_type), list(transfer_words)))


def merge_repeats(rows: DataFrame) -> DataFrame:
    """Rows of one id in one file become the first of them, with the sum of amounts, a new id and merge_count."""
    first = [c for c in rows.columns if c not in ("id", "amount", "source_file")]
    g = rows.groupBy("source_file", "id").agg(
        F.sum("amount").cast(S.MONEY).alias("amount"), (F.count(F.lit(1)) - 1).alias("merge_count"), F.min_by(F.struct(*first), "row_idx").alias("f")
    )
    out = g.select("source_file", "id", "amount", "merge_count", "f.*")
    again = S.transaction_id(F.col("account_label"), F.col("source_file"), F.col("date"), F.col("amount"), F.col("description"))
    return out.withColumn("id", F.when(F.col("merge_count") > 0, again).otherwise(F.col("id")))


def import_report(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: rows, skipped, merged, already stored, new. rows: from ``canonical``; stored: ids."""
    good = merge_repeats(rows.where("reject is null"))
    known = stored.select("id").distinct().withColumn("stored", F.lit(True))
    counts = good.join(known, "id", "left").groupBy("source_file").agg(F.sum("merge_count").alias("merged"), F.count_if(F.col("stored").isNotNull()).alias("existing"), F.count_if(F.col("stored").isNull()).alias("new"))
    total = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("total"), F.count("reject").alias("skipped"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return total.join(counts, "source_file", "left").select("source_file", "total", "skipped", zero("merged"), zero("existing"), zero("new"))


def reject_reasons(rows: DataFrame) -> DataFrame:
    return rows.where("reject is not null").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))
