"""Statement schemas as data: one row a file says which cell has which role, and rows join it.

Files of any layout go through one plan: their columns' profiles and names
decide roles in expressions, a cache of schemas by column names is tried first,
and files that a cached schema reads too little of are inferred anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import SIGN_CONVENTIONS
from ..sources import statements as St
from ..stored import Stored
from .ingest import column_kinds, column_profiles

# Column names by role, in the languages of statements. Of several description columns the name listed first wins.
DESCRIPTION_NAMES = (
    "causale", "dettagli operazione", "descrizione", "dettagli", "tipo operazione", "tipologia", "tipo", "note", "memo",
    "description", "narrative", "transaction type", "details", "reference", "remarks",
    "libellé", "libelle", "opération", "operation", "détails", "motif",
    "buchungstext", "verwendungszweck", "beschreibung", "betreff",
    "concepto", "descripción", "descripcion",
)
DATE_NAMES = (
    "data operazione", "data movimento", "data transazione", "data addebito", "transaction date", "posting date", "booking date",
    "date opération", "date operation", "date de transaction", "buchungsdatum", "buchungstag", "fecha operación", "fecha operacion", "fecha transacción", "fecha transaccion",
)
VALUE_DATE_NAMES = (
    "data valuta", "data contabile", "data regolamento", "valuta", "value date", "settlement date", "accounting date",
    "date de valeur", "date valeur", "date comptable", "wertstellungsdatum", "wertstellung", "fecha valor",
)
DEBIT_NAMES = (
    "uscita", "uscite", "addebito", "addebiti", "pagamento", "pagamenti", "importo addebitato", "spesa", "spese", "dare",
    "debit", "withdrawal", "withdrawals", "charge", "charges", "outflow",
    "débit", "sortie", "sorties", "dépense", "dépenses", "retrait", "retraits", "prélèvement",
    "soll", "ausgabe", "ausgaben", "belastung", "lastschrift", "cargo", "cargos", "débito", "salida", "salidas", "gasto", "gastos",
)
CREDIT_NAMES = (
    "entrata", "entrate", "accredito", "accrediti", "importo accreditato", "avere", "credito",
    "credit", "credits", "deposit", "deposits", "income", "inflow", "receipt",
    "crédit", "entrée", "entrées", "recette", "recettes",
    "haben", "einnahme", "einnahmen", "gutschrift", "einzahlung", "abono", "abonos", "crédito", "entrada", "entradas", "ingreso", "ingresos",
)
AMOUNT_NAMES = ("importo", "amount", "valore", "totale", "montant", "valeur", "total", "betrag", "wert", "summe", "importe", "monto", "valor")

#: Columns of a schema row beside its key.
FIELDS = ["date", "description", "amount", "debit", "credit", "convention", "invert"]
PLACES = ("date", "description", "amount", "debit", "credit")
#: A cached schema is stale if it reads less than this share of a file's rows.
LEAST_PARSED = 0.10
#: Two amount columns are debit and credit if they fill more than this share of the rows together.
TOGETHER = 0.85


def _listed(name: Column, names: tuple[str, ...]) -> Column:
    """Place in the list from 1 on, or null."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0))


def _first(columns: Column, rank) -> Column:
    """The col of the least (rank, col) among the columns whose rank isn't null."""
    ranked = F.filter(F.transform(columns, lambda p: F.struct(rank(p).alias("r"), p["col"].alias("col"))), lambda x: x["r"].isNotNull())
    return F.array_min(ranked).getField("col")


def roles(p: Column, credit_card: Column) -> Column:
    """One file's schema, a struct of FIELDS, from its columns: structs (col, name, kind, categorical, n, filled, distinct, negatives).

    The date column is the one with the best name, else the first that isn't
    named a value date. Two amount columns that together fill most rows, and
    neither all of them, are debit and credit; of several such pairs the
    fullest. The one with negative values is debit, else the fuller one. Two
    columns named as debit and credit are these, however few rows fill them: a
    short file may hold more inflows than outflows, or none of a side. A lone
    amount column named for outflows, or of a card statement without negatives,
    is inverted.
    """
    of = lambda kind: F.filter(p, lambda x: x["kind"] == kind)
    one = F.lit(1)
    date = F.coalesce(_first(of("date"), lambda x: _listed(x["name"], DATE_NAMES)), _first(of("date"), lambda x: F.when(_listed(x["name"], VALUE_DATE_NAMES).isNull(), one)), _first(of("date"), lambda x: one))
    texts = of("text")
    open_texts = F.filter(texts, lambda x: ~x["categorical"])
    texts = F.when(F.size(open_texts) > 0, open_texts).otherwise(texts)
    description = F.coalesce(_first(texts, lambda x: _listed(x["name"], DESCRIPTION_NAMES)), _first(texts, lambda x: -x["distinct"]))
    amounts = of("amount")
    both = F.flatten(F.transform(amounts, lambda a: F.transform(F.filter(amounts, lambda b: b["col"] > a["col"]), lambda b: F.struct((a["filled"] + b["filled"]).alias("sum"), (-a["col"]).alias("o"), (-b["col"]).alias("q"), a.alias("a"), b.alias("b")))))
    pair = F.array_max(F.filter(both, lambda x: (x["sum"] > x["a"]["n"] * TOGETHER) & (F.greatest(x["a"]["filled"], x["b"]["filled"]) < x["a"]["n"])))
    a, b = pair["a"], pair["b"]
    sided = F.filter(p, lambda x: (x["kind"] == "amount") | (x["filled"] == 0))
    out, in_ = _first(sided, lambda x: _listed(x["name"], DEBIT_NAMES)), _first(sided, lambda x: _listed(x["name"], CREDIT_NAMES))
    named = out.isNotNull() & in_.isNotNull() & (F.size(F.filter(amounts, lambda x: (x["col"] == out) | (x["col"] == in_))) > 0)
    named_negative = F.size(F.filter(amounts, lambda x: ((x["col"] == out) | (x["col"] == in_)) & (x["negatives"] > 0))) > 0
    neg_a, neg_b = a["negatives"] > 0, b["negatives"] > 0
    a_is_debit = F.when(neg_a == neg_b, a["filled"] >= b["filled"]).otherwise(neg_a)
    amount = F.coalesce(_first(amounts, lambda x: _listed(x["name"], AMOUNT_NAMES)), _first(amounts, lambda x: one))
    lone = F.get(F.filter(amounts, lambda x: x["col"] == amount), F.lit(0))
    outflow = _listed(lone["name"], DEBIT_NAMES).isNotNull() | (_listed(lone["name"], CREDIT_NAMES).isNull() & credit_card)
    split = named | pair.isNotNull()
    signed = F.when(named, named_negative).otherwise(neg_a | neg_b)
    return F.struct(
        date.alias("date"), description.alias("description"), F.when(~split, amount).alias("amount"),
        F.when(named, out).when(split, F.when(a_is_debit, a["col"]).otherwise(b["col"])).alias("debit"), F.when(named, in_).when(split, F.when(a_is_debit, b["col"]).otherwise(a["col"])).alias("credit"),
        F.when(split, F.when(signed, "debit_credit_signed").otherwise("debit_positive")).otherwise("signed_single").alias("convention"),
        F.coalesce(~split & (F.size(amounts) > 0) & outflow & (lone["negatives"] == 0), F.lit(False)).alias("invert"),
    )


def file_headers(rows: DataFrame) -> DataFrame:
    """(source_file, header_idx, names, key): lower-case column names of each file and the key of their set."""
    found = St.header_cells(rows).where(F.col("source_file").isNotNull())
    names = F.transform("cells", lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return found.select("source_file", "header_idx", names.alias("names"), St.columns_key(names).alias("key"))


def inferred_schemas(body: DataFrame, headers: DataFrame, doc_types: DataFrame | None = None) -> DataFrame:
    """(source_file, FIELDS, usable) of each file, from the profiles of its rows under the header.

    doc_types: (source_file, doc_type), where a file's kind is known. A file's
    few profiles are gathered in one row and decided there.
    """
    per = column_profiles(body).join(headers.select("source_file", "names"), "source_file")
    profile = F.struct("col", F.coalesce(F.get("names", "col"), F.lit("")).alias("name"), "kind", "categorical", "n", "filled", "distinct", "negatives")
    files = per.groupBy("source_file").agg(F.array_sort(F.collect_list(profile)).alias("p"))
    if doc_types is not None:
        files = files.join(doc_types.select("source_file", "doc_type"), "source_file", "left")
    card = F.coalesce(F.col("doc_type") == "credit_card", F.lit(False)) if doc_types is not None else F.lit(False)
    out = files.select("source_file", roles(F.col("p"), card).alias("s")).select("source_file", "s.*")
    return out.withColumn("usable", usable())


def usable() -> Column:
    return F.col("date").isNotNull() & (F.col("amount").isNotNull() | (F.col("debit").isNotNull() & F.col("credit").isNotNull()))


def parsed(body: DataFrame, schemas: DataFrame) -> DataFrame:
    """(source_file, row_idx, date, amount, description, reject) of every row of the files that have a schema.

    ``reject`` is null or says why a row is left out. A row whose date or amount
    can't be read, or whose file's schema isn't usable, is rejected.
    """
    rows = body.join(schemas.select("source_file", F.struct(*FIELDS).alias("s")), "source_file")
    cell = lambda role: F.get("cells", F.col(f"s.{role}")).alias(role)
    # step by step, as each of these columns stands many times in the next; a filter on the result stops at the generator, so it repeats none of the parsing
    picked = rows.select("source_file", "row_idx", "s.convention", "s.invert", *[cell(c) for c in PLACES])
    values = F.struct(S.parse_date(F.col("date")).alias("date"), S.join_descriptions(F.col("description")).alias("description"), *[S.parse_amount(F.col(c)).alias(c) for c in ("amount", "debit", "credit")])
    read = picked.select("source_file", "row_idx", "convention", "invert", F.inline(F.array(values)))
    a, d, c = (F.col(x) for x in ("amount", "debit", "credit"))
    value = reduce(lambda rest, kind: F.when(F.col("convention") == kind, S.signed_amount(kind, a, d, c)).otherwise(rest), SIGN_CONVENTIONS, F.lit(None).cast("decimal(18,4)"))
    out = read.select("source_file", "row_idx", "date", value.alias("amount"), "description", "invert").withColumn("amount", F.when(F.col("invert"), -F.col("amount")).otherwise(F.col("amount"))).drop("invert")
    return out.withColumn("reject", F.when(F.col("date").isNull(), "no date").when(F.col("amount").isNull(), "no amount"))


def parse_rates(rows: DataFrame) -> DataFrame:
    """(source_file, n, ok) of ``parsed`` rows."""
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reject").isNull()).alias("ok"))


def by_name(schemas: DataFrame, headers: DataFrame) -> DataFrame:
    """(source_file, key, FIELDS) with the names of columns in place of their places."""
    both = schemas.join(headers.select("source_file", "names", "key"), "source_file")
    return both.select("source_file", "key", *[F.get("names", F.col(c)).alias(c) for c in PLACES], "convention", "invert")


def by_place(cache: DataFrame, headers: DataFrame) -> DataFrame:
    """(source_file, key, FIELDS): the cached schema of each file that has one; a name that the file lacks gives no role."""
    place = lambda c: F.nullif(F.array_position("names", F.col(c)), F.lit(0)).cast("int") - 1
    both = headers.select("source_file", "names", "key").join(cache.select("key", *FIELDS), "key")
    return both.select("source_file", "key", *[place(c).alias(c) for c in PLACES], "convention", "invert")


def chosen_schemas(body: DataFrame, headers: DataFrame, cache: DataFrame, doc_types: DataFrame | None = None, least: float = LEAST_PARSED) -> DataFrame:
    """(source_file, FIELDS, usable, flow): the schema each file is read with, and where it comes from.

    cache: (key, FIELDS), one row a set of column names, roles by column name,
    as files of one set may order their columns differently. A file whose cached
    schema reads at least ``least`` of its rows keeps it (``cached``). The others
    are inferred, ``inferred`` without an entry, ``retried`` where the entry is
    stale; only their rows are profiled. What each step says of a file is
    written, a row a file, as several of the next steps ask for it, and each
    would parse all rows again.
    """
    known = Stored(by_place(cache, headers)).df
    rates = parse_rates(parsed(body, known))
    good = Stored(rates.where(F.col("ok") >= F.col("n") * least).select("source_file")).df
    kept = known.join(good, "source_file", "left_semi").select("source_file", *FIELDS).withColumn("usable", usable()).withColumn("flow", F.lit("cached"))
    rest = headers.join(good, "source_file", "left_anti")
    found = inferred_schemas(body.join(good, "source_file", "left_anti"), rest, doc_types)
    tried = known.select("source_file").withColumn("flow", F.lit("retried"))
    return Stored(kept.unionByName(found.join(tried, "source_file", "left").withColumn("flow", F.coalesce("flow", F.lit("inferred"))))).df


def refreshed_cache(cache: DataFrame, headers: DataFrame, chosen: DataFrame) -> DataFrame:
    """The cache without its stale entries, with what was inferred in their place: of a key's usable schemas that of its first file."""
    new = by_name(chosen.where((F.col("flow") != "cached") & F.col("usable")), headers)
    new = new.groupBy("key").agg(F.min_by(F.struct(*FIELDS), "source_file").alias("s")).select("key", "s.*")
    stale = chosen.where("flow = 'retried'").join(headers.select("source_file", "key"), "source_file").select("key").distinct()
    kept = cache.select("key", *FIELDS).join(stale.unionByName(new.select("key")).distinct(), "key", "left_anti")
    return kept.unionByName(new)



def sampled_rows(body: DataFrame, n: int = 20) -> DataFrame:
    """(source_file, row_idx, score) of at most ``n`` rows of each file that show its rare columns and both signs.

    A row's score is the sum, over its filled cells, of one over the share of
    the column that is filled. Where a file has one amount column with both
    signs, half of the rows come from either, and what is missing from the best
    of all others; else the best rows. Equal scores go by the row's place.
    """
    per = Window.partitionBy("source_file")
    long = body.select("source_file", "row_idx", F.posexplode("cells").alias("col", "v"))
    # a row a file of what its rows are weighed by: how many they are, the weight of each place, the place of a lone amount
    filled = long.groupBy("source_file", "col").agg(F.count("v").alias("filled")).groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("col", "filled"))).alias("filled"))
    lone = column_kinds(long).where("kind = 'amount'").groupBy("source_file").agg(F.min("col").alias("amount"), F.count(F.lit(1)).alias("c")).where("c = 1").select("source_file", "amount")
    known = St.with_file(St.with_file(body.groupBy("source_file").agg(F.count(F.lit(1)).alias("all")), filled), lone)
    weights = F.transform("filled", lambda x: F.coalesce(F.try_divide(F.col("all"), x["filled"]), F.lit(0.0)))
    rows = St.with_file(body, known.select("source_file", "all", weights.alias("weights"), "amount"))
    score = F.aggregate(F.zip_with("cells", "weights", lambda v, w: F.when(v.isNotNull(), w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    scored = rows.select("source_file", "row_idx", F.least("all", F.lit(n)).alias("most"), F.round(F.coalesce(score, F.lit(0.0)), 9).alias("score"), F.signum(S.parse_amount(F.get("cells", "amount"))).alias("sign"))
    best = [F.desc("score"), F.col("row_idx")]
    # the best of either sign and of the rest are among the first 2n of their sign, so each task passes on these only
    sides = scored.withColumn("of_sign", F.row_number().over(Window.partitionBy("source_file", "sign").orderBy(*best))).where(F.col("of_sign") <= 2 * n)
    both = (F.max(F.col("sign") > 0).over(per) & F.max(F.col("sign") < 0).over(per))
    half = F.floor(F.col("most") / 2)
    picked = sides.withColumn("picked", F.coalesce(both & F.col("sign").isin(1.0, -1.0) & (F.col("of_sign") <= half), F.lit(False)))
    left = F.row_number().over(Window.partitionBy("source_file", "picked").orderBy(*best))
    room = F.col("most") - F.sum(F.col("picked").cast("int")).over(per)
    return picked.withColumn("left", left).withColumn("room", room).where(F.col("picked") | (F.col("left") <= F.col("room"))).select("source_file", "row_idx", F.round("score", 6).alias("score"))


def confidence(found: DataFrame) -> DataFrame:
    """found (source_file, header, date, amount, description, sign, doc_type, label, booleans) with score and grade: the weighted sum of what was found."""
    # Weights of what was found, and bounds of the grades.
    weights = {"header": "0.15", "date": "0.15", "amount": "0.25", "description": "0.10", "sign": "0.15", "doc_type": "0.10", "label": "0.10"}
    score = reduce(lambda a, b: a + b, [F.when(F.col(c), F.lit(w).cast("decimal(4,2)")).otherwise(F.lit("0.00").cast("decimal(4,2)")) for c, w in weights.items()])
    grade = F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.5, "medium").otherwise("low")
    return found.withColumn("score", score.cast("double")).withColumn("grade", grade)


def without_schemas(cache: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The cache without the given keys, or without any."""
    return cache.limit(0) if keys is None else cache.join(keys.select("key"), "key", "left_anti")


def with_footers(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache (key, footers) with newly found footer patterns (key, footers) behind the known ones of their key, each once; keys that the cache lacks stay out."""
    new = found.groupBy("key").agg(F.flatten(F.array_sort(F.collect_list("footers"))).alias("new"))
    none = F.array().cast("array<string>")
    return cache.join(new, "key", "left").withColumn("footers", F.array_distinct(F.concat(F.coalesce("footers", none), F.coalesce("new", none)))).drop("new")
