"""Scalar functions over derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.adapters import table
from .register import on_ledger, query

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KSQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def lines(spark, d):
    return table(spark, d, "lineitem")


def amount_layouts(spark, d):
    """Prices written in five layouts and read back."""
    n = F.format_number("l_extendedprice", 2)
    eu = F.translate(n, ",.", ".,")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("€ "), eu)).when(F.col("l_linenumber") == 2, n).when(F.col("l_linenumber") == 3, F.replace(n, F.lit(","), F.lit("")))
    text = text.when(F.col("l_linenumber") == 4, F.replace(eu, F.lit("."), F.lit(""))).when(F.col("l_linenumber") == 5, F.lit("N/A")).otherwise(F.concat(F.lit("-"), eu, F.lit(" EUR")))
    return lines(spark, d).select(*KEYS, S.parse_amount(F.regexp_replace(text, " EUR$", "")).alias("amount"))


query(
    "sc_parse_amount",
    f"SELECT {KSQL}, CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber > 5 THEN CAST(-l_extendedprice AS DECIMAL(18,4)) ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END AS amount FROM lineitem",
)(amount_layouts)


def date_layouts(spark, d):
    fmt = lambda f: F.date_format("l_shipdate", f)
    n = F.col("l_linenumber")
    text = F.when(n == 1, fmt("dd/MM/yyyy")).when(n == 2, fmt("yyyy-MM-dd")).when(n == 3, fmt("d-M-yyyy")).when(n == 4, fmt("dd/MM/yy")).when(n == 5, F.concat(fmt("yyyy"), F.lit("/31/31"))).otherwise(fmt("yyyy/MM/dd"))
    return lines(spark, d).select(*KEYS, S.parse_date(text).alias("date"))


query("sc_parse_date", f"SELECT {KSQL}, CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date FROM lineitem")(date_layouts)

_D = "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DECIMAL(18,4)) END"
_C = "CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_discount AS DECIMAL(18,4)) END"
_A = "CAST(l_quantity AS DECIMAL(18,4))"


def signs(spark, d):
    n, m = F.col("l_linenumber"), S.MONEY
    debit, credit, amount = F.when(n % 2 == 0, F.col("l_tax").cast(m)), F.when(n % 3 == 0, F.col("l_discount").cast(m)), F.col("l_quantity").cast(m)
    return lines(spark, d).select(*KEYS, *[S.signed_amount(c, amount, debit, credit).alias(c) for c in ("signed_single", "debit_positive", "debit_credit_signed", "credit_negative")])


query(
    "sc_sign",
    f"""WITH t AS (SELECT *, {_D} AS d, {_C} AS c, {_A} AS a FROM lineitem) SELECT {KSQL}, a AS signed_single,
 CAST(CASE WHEN d IS NULL AND c IS NULL THEN a ELSE abs(coalesce(c, 0)) - abs(coalesce(d, 0)) END AS DECIMAL(18,4)) AS debit_positive,
 CASE WHEN d IS NULL AND c IS NULL THEN a ELSE coalesce(d, c) END AS debit_credit_signed,
 CASE WHEN d IS NULL AND c IS NULL THEN a WHEN c > 0 THEN c ELSE -abs(d) END AS credit_negative FROM t""",
)(signs)
on_ledger("sc_invert", "SELECT id, -amount AS amount FROM ledger WHERE doc_type = 'credit_card'")(lambda d: d.where("doc_type = 'credit_card'").select("id", (-F.col("amount")).alias("amount")))
on_ledger(
    "sc_desc_concat",
    ", t AS (SELECT id, category, CASE WHEN raw_description IS NULL THEN description ELSE description || ' ' || raw_description END AS text FROM ledger) SELECT id, CASE WHEN category IS NULL OR contains(lower(text), lower(category)) THEN text ELSE text || ' ' || category END AS text FROM t",
)(lambda d: d.select("id", S.join_descriptions(F.col("description"), F.lit("nan"), F.col("raw_description"), F.lit("0b2d3c4e-1111-2222-3333-444455556666"), F.col("category"), F.col("category")).alias("text")))
# a decomposed accent and a letter that folds to two
on_ledger("sc_desc_norm", "SELECT id, trim(replace(lower(nfc_normalize('  ' || coalesce(raw_description, '') || CASE WHEN to_review THEN ' CAFE' || chr(769) || ' Straße ' ELSE ' ' END)), 'ß', 'ss')) AS text FROM ledger")(
    lambda d: d.select("id", S.normal_description(F.concat(F.lit("  "), F.coalesce("raw_description", F.lit("")), F.when(F.col("to_review"), " CAFE\u0301 Straße ").otherwise(" "))).alias("text"))
)
on_ledger(
    "sc_tx_id",
    "SELECT id, substr(sha256(concat_ws('|', account_label, CAST(date AS VARCHAR), regexp_replace(regexp_replace(CAST(amount AS VARCHAR), '0+$', ''), '\\.$', ''), coalesce(description, ''))), 1, 24) AS tx_id FROM ledger",
)(lambda d: d.select("id", S.transaction_id(F.col("account_label"), F.col("source_file"), F.col("date"), F.col("amount"), F.col("description")).alias("tx_id")))
on_ledger(
    "sc_tx_type",
    "SELECT id, CASE WHEN contains(lower(description), 'ring') OR contains(lower(description), 'bolt') THEN CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END WHEN doc_type = 'credit_card' THEN 'card_tx' WHEN amount > 0 THEN 'income' ELSE 'expense' END AS tx_type FROM ledger",
)(lambda d: d.select("id", S.transaction_type(F.col("description"), F.col("amount"), F.col("doc_type"), ["Ring", "bolt"]).alias("tx_type")))
query(
    "sc_strip_nontext",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\p{P}\p{Z}\t ]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents",
)(lambda spark, d: table(spark, d, "documents").select("doc_id", S.strip_non_text(F.col("text")).alias("text")))
ACCOUNT, CARD = S.REDACTIONS[0][0], S.REDACTIONS[1][0]


def redaction_sql(text: str) -> str:
    for pattern, tag, flags in S.REDACTIONS:
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g{flags}')"
    return text


def marked(spark, d):
    """Whole documents, and line items with an account, a card, a masked card, a bank code or a fiscal code each."""
    n, k = F.col("l_linenumber"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")
    cases = [F.concat(F.lit("IT60X054281110"), k, F.lit(" paid")), F.concat(F.lit("card 4111 1111-1111 "), k), F.concat(F.lit("card ****12"), F.substring(k, 5, 2), F.lit(" x")), F.concat(F.lit("Pos "), k, F.lit("-1 shop")), F.concat(F.lit("rssmra"), F.substring(k, 5, 2), F.lit("A01h501u, cau")), F.concat(F.lit("XXXX-99"), F.substring(k, 5, 2), F.lit(" NDS 7"))]
    text = F.when(n == 1, cases[0])
    for i, c in enumerate(cases[1:], 2):
        text = text.when(n == i, c)
    made = lines(spark, d).select((-(F.col("l_orderkey") * 10 + n)).cast("long").alias("doc_id"), text.otherwise(F.concat(F.lit("ID transazione "), k)).alias("text"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(made)


_K = "lpad(CAST(l_partkey AS VARCHAR), 6, '0')"
MARKED = f"""m AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents UNION ALL SELECT CAST(-(l_orderkey * 10 + l_linenumber) AS BIGINT), CASE l_linenumber WHEN 1 THEN 'IT60X054281110' || {_K} || ' paid' WHEN 2 THEN 'card 4111 1111-1111 ' || {_K}
 WHEN 3 THEN 'card ****12' || substr({_K}, 5, 2) || ' x' WHEN 4 THEN 'Pos ' || {_K} || '-1 shop' WHEN 5 THEN 'rssmra' || substr({_K}, 5, 2) || 'A01h501u, cau' WHEN 6 THEN 'XXXX-99' || substr({_K}, 5, 2) || ' NDS 7' ELSE 'ID transazione ' || {_K} END FROM lineitem)"""
query("sc_redact", f"WITH {MARKED} SELECT doc_id, {redaction_sql("coalesce(text, '')")} AS text FROM m")(lambda spark, d: marked(spark, d).select("doc_id", S.redact(F.col("text")).alias("text")))
query("sc_assert_clean", f"WITH {MARKED} SELECT count(*) AS unclean FROM m WHERE regexp_matches(coalesce(text, ''), '{ACCOUNT}') OR regexp_matches(coalesce(text, ''), '{CARD}')")(
    lambda spark, d: marked(spark, d).select(F.coalesce("text", F.lit("")).alias("text")).where(~S.is_clean(F.col("text"))).agg(F.count(F.lit(1)).alias("unclean"))
)
on_ledger("sc_owner_redact", f"SELECT id, replace(replace(description, 'small ring', '{S.alias(0)}'), 'ring small', '{S.alias(0)}') AS text FROM ledger")(
    lambda d: d.select("id", S.redact(F.col("description"), owners=["ring small"]).alias("text"))
)
THREE = ["small ring", "big bolt", "blue widget"]
on_ledger("sc_fake_name", "SELECT id, replace(replace(replace(description, 'small ring', '{}'), 'big bolt', '{}'), 'blue widget', '{}') AS text FROM ledger".format(*(S.alias(i, "es") for i in range(3))))(
    lambda d: d.select("id", S.redact(F.col("description"), owners=THREE, lang="es").alias("text"))
)
on_ledger("sc_restore", f"SELECT id, description AS text FROM ledger WHERE description IN ({', '.join(f"'{x}'" for x in THREE)})")(
    lambda d: d.where(F.col("description").isin(THREE)).select("id", S.restore_aliases(S.redact(F.col("description"), owners=THREE), THREE).alias("text"))
)
TOK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda w: length(w) > 1))"
on_ledger(
    "sc_containment",
    f", t AS (SELECT id, {TOK.format('description')} AS a, {TOK.format('raw_description')} AS b FROM ledger) SELECT id, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END AS score FROM t",
)(lambda d: d.select("id", F.round(S.containment(F.col("description"), F.col("raw_description")), 6).alias("score")))
on_ledger("sc_tokenize", f"SELECT id, array_to_string(list_sort({TOK.format('raw_description')}), ' ') AS tokens FROM ledger")(lambda d: d.select("id", F.array_join(F.array_sort(S.tokens(F.col("raw_description"))), " ").alias("tokens")))
on_ledger("sc_fmt_amount", "SELECT id, CASE WHEN amount < 0 THEN '-' ELSE '+' END || translate(format('{:,.2f}', CAST(abs(amount) AS DOUBLE)), ',.', '.,') || ' €' AS text FROM ledger")(
    lambda d: d.select("id", S.display_amount(F.col("amount")).alias("text"))
)
on_ledger("sc_fmt_raw_amount", "SELECT id, CASE WHEN split_part(raw_amount, '|', 2) NOT IN ('', 'nan', 'none', '0') THEN split_part(raw_amount, '|', 2) ELSE split_part(raw_amount, '|', 1) END AS text FROM ledger")(
    lambda d: d.select("id", S.display_raw_amount(F.col("raw_amount")).alias("text"))
)
on_ledger("sc_fmt_date", "SELECT id, strftime(date, '%d/%m/%Y') AS text FROM ledger")(lambda d: d.select("id", S.display_date(F.col("date").cast("string")).alias("text")))
on_ledger("sc_month", "SELECT strftime(date, '%Y-%m') AS month, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM ledger GROUP BY 1, 2")(
    lambda d: d.groupBy(F.date_format("date", "yyyy-MM").alias("month"), F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
)


def bounds(d):
    cols = [x for u in ("month", "quarter", "year") for x in zip(S.period_bounds(F.col("date"), u), (f"{u}_first", f"{u}_last"))]
    return d.select("date").distinct().select("date", *[c.alias(n) for c, n in cols])


on_ledger(
    "sc_period_bounds",
    "SELECT DISTINCT date, " + ", ".join(f"CAST(date_trunc('{u}', date) AS DATE) AS {u}_first, CAST(date_trunc('{u}', date) + INTERVAL {n} MONTH - INTERVAL 1 DAY AS DATE) AS {u}_last" for u, n in (("month", 1), ("quarter", 3), ("year", 12))) + " FROM ledger",
)(bounds)
query("sc_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k")))
on_ledger(
    "sc_ledger_view",
    "SELECT id, left(description, 5) AS description, CASE WHEN amount > 0 THEN amount END AS income, CASE WHEN amount < 0 THEN amount END AS expense, CASE category_source WHEN 'rule' THEN 'R' WHEN 'llm' THEN 'AI' WHEN 'history' THEN 'H' WHEN 'manual' THEN 'M' ELSE '' END AS badge, coalesce(tx_type IN ('internal_out', 'internal_in'), false) AS internal FROM ledger",
)(
    lambda d: d.select(
        "id", F.substring("description", 1, 5).alias("description"), F.when(F.col("amount") > 0, F.col("amount")).alias("income"), F.when(F.col("amount") < 0, F.col("amount")).alias("expense"),
        F.coalesce(F.create_map(*[F.lit(x) for x in ("rule", "R", "llm", "AI", "history", "H", "manual", "M")])[F.col("category_source")], F.lit("")).alias("badge"),
        F.coalesce(F.col("tx_type").isin("internal_out", "internal_in"), F.lit(False)).alias("internal"),
    )
)
on_ledger("sc_taxonomy_tree", "SELECT category, string_agg(DISTINCT subcategory, ',' ORDER BY subcategory) AS subcategories FROM ledger WHERE category IS NOT NULL GROUP BY 1")(
    lambda d: d.where("category is not null").groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("subcategory")), ",").alias("subcategories"))
)
