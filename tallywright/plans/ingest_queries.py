"""Queries of statement reading, cleaning, inference and import, over statements rendered from the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import statements as St
from ..sources.adapters import LEDGER_SQL, ledger_lineitem
from ..stored import Stored
from .register import query


def rendered(spark, sf_dir: str) -> DataFrame:
    """Lines of a statement a source file: two lines before the header, one after the last row, which has no amount."""
    led = Stored(ledger_lineitem(spark, sf_dir).select("source_file", "id", "date", "description", "amount")).df
    # a file's rows are many and its days few: numbered within the day, after the rows of the days before
    days = led.groupBy("source_file", "date").agg(F.count(F.lit(1)).alias("c"))
    known = Stored(days.withColumn("earlier", F.sum("c").over(Window.partitionBy("source_file").orderBy("date")) - F.col("c"))).df
    led = led.join(known.drop("c"), ["source_file", "date"])
    n = (F.row_number().over(Window.partitionBy("source_file", "date").orderBy("id", "amount")) + F.col("earlier")).cast("int")
    eu = F.translate(F.format_number("amount", 2), ",.", ".,")
    rows = led.select("source_file", (n + 2).alias("row_idx"), F.concat_ws(";", F.date_format("date", "dd/MM/yyyy"), "description", eu, F.lit("EUR")).alias("line"))
    per = known.groupBy("source_file").agg((F.sum("c") + 2).cast("int").alias("last"))
    line = lambda i, text: F.struct(F.lit(i).alias("row_idx") if isinstance(i, int) else i.alias("row_idx"), F.lit(text).alias("line"))
    around = F.array(line(0, "Account statement;;;"), line(1, "Holder: TEST USER;;;"), line(2, "Date;Description;Amount;Currency"), line(F.col("last") + 1, ";Saldo finale 31/12/2001 1.234,56;;"))
    return rows.unionByName(per.select("source_file", F.explode(around).alias("x")).select("source_file", "x.row_idx", "x.line"))


RENDERED = f"""{LEDGER_SQL}, num AS (SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY date, id, amount) + 2 AS INTEGER) AS row_idx, date, description, amount FROM ledger)"""
PER = "SELECT source_file, max(row_idx) AS last FROM num GROUP BY 1"


def on_cells(name: str, sql: str | None = None):
    def add(fn):
        query(name, f"WITH {RENDERED} {sql}" if sql else None)(lambda spark, d: fn(Stored(St.with_cells(Stored(rendered(spark, d)).df)).df))
        return fn

    return add


def tally(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"), F.max("row_idx").alias("last"))


query("src_delimiter", f"WITH {RENDERED} SELECT DISTINCT source_file, ';' AS delimiter FROM num")(lambda spark, d: St.delimiters(rendered(spark, d)))
on_cells("src_header_row", "SELECT DISTINCT source_file, 2 AS header_idx, true AS certain FROM num")(St.header_rows)
# the first lines as they are written: two lines, the header, rows with European amounts
HEAD = """h AS (SELECT source_file, row_idx, strftime(date, '%d/%m/%Y') || ';' || description || ';' || translate(format('{:,.2f}', CAST(amount AS DOUBLE)), ',.', '.,') || ';EUR' AS line FROM num WHERE row_idx < 30
 UNION ALL SELECT DISTINCT source_file, unnest([0, 1, 2]), unnest(['Account statement;;;', 'Holder: TEST USER;;;', 'Date;Description;Amount;Currency']) FROM num)"""
query("src_header_hash", f"WITH {RENDERED}, {HEAD} SELECT source_file, sha256(string_agg(line, chr(10) ORDER BY row_idx)) AS header_sha256 FROM h GROUP BY 1")(lambda spark, d: St.header_hash(rendered(spark, d)))
on_cells("src_cols_hash", "SELECT DISTINCT source_file, 'cols:' || substr(sha256('Amount|Currency|Date|Description'), 1, 16) AS key FROM num")(
    lambda rows: rows.where("row_idx = 2").select("source_file", St.columns_key(F.col("cells")).alias("key"))
)
on_cells("src_head", f"{', ' + HEAD} SELECT source_file, row_idx, string_split(line, ';')[1] AS a, nullif(string_split(line, ';')[2], '') AS b, nullif(string_split(line, ';')[3], '') AS c, nullif(string_split(line, ';')[4], '') AS d FROM h WHERE row_idx < 5")(
    lambda rows: rows.where("row_idx < 5").select("source_file", "row_idx", *[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate("abcd")])
)
on_cells("cln_trailing_sparse", f"SELECT source_file, last + 1 AS n, 0 AS first, last FROM ({PER})")(lambda rows: tally(St.trim_sparse_tail(rows)))
on_cells("cln_border_reconcile", f"SELECT source_file, last + 1 AS n, 0 AS first, last FROM ({PER})")(lambda rows: tally(St.trim_sparse_tail(rows, F.lit(4))))
on_cells("cln_preheader", f"SELECT source_file, last AS n, 2 AS first, last + 1 AS last FROM ({PER})")(lambda rows: tally(St.strip_preheader(rows)))
on_cells("cln_footer_iqr", f"SELECT source_file, last - 2 AS n, 3 AS first, last FROM ({PER})")(lambda rows: tally(St.strip_footer_outliers(St.body(rows))))
on_cells("cln_footer_p1", f"SELECT source_file, last - 2 AS n, 3 AS first, last FROM ({PER})")(lambda rows: tally(St.strip_footer_missing(St.body(rows), [0, 1, 2])))
on_cells("cln_footer_p3", f"SELECT source_file, last + 1 AS row_idx, 'drop' AS footer FROM ({PER})")(
    lambda rows: St.footer_by_patterns(rows, 1, ["saldo finale"]).where("footer is not null").select("source_file", "row_idx", "footer")
)
on_cells("cln_footer_suspects", f"SELECT source_file, last + 1 AS row_idx, 'suspect' AS footer FROM ({PER})")(
    lambda rows: St.footer_by_patterns(rows, 1, ["zz"]).where("footer is not null").select("source_file", "row_idx", "footer")
)
on_cells("cln_pattern_norm", f"SELECT source_file, 'saldo finale' AS pattern FROM ({PER})")(
    lambda rows: rows.where(F.contains("line", F.lit("Saldo"))).select("source_file", St.footer_pattern(F.get("cells", 1)).alias("pattern"))
)
on_cells("cln_drop_null_cols", f"SELECT source_file, last + 2 AS n, 'source_file,n' AS kept FROM ({PER})")(
    lambda rows: (lambda d: d.withColumn("kept", F.lit(",".join(d.columns))))(St.drop_null_columns(rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(None).cast("string")).alias("empty"))))
)
on_cells(
    "inf_content_type",
    "SELECT source_file, 0 AS col, 'date' AS kind FROM num GROUP BY 1 UNION ALL SELECT source_file, 1, 'text' FROM num GROUP BY 1 UNION ALL SELECT source_file, 2, 'amount' FROM num GROUP BY 1 UNION ALL SELECT source_file, 3, 'text' FROM num GROUP BY 1",
)(lambda rows: ingest.column_profiles(St.body(rows)).select("source_file", "col", "kind"))
on_cells(
    "inf_categorical",
    """, c AS (SELECT source_file, count(*) AS n, count(DISTINCT date) AS d0, count(DISTINCT description) + 1 AS d1, count(DISTINCT amount) AS d2 FROM num GROUP BY 1)
 SELECT source_file, 0 AS col, d0 <= 5 OR d0 <= n * 0.03 AS categorical FROM c UNION ALL SELECT source_file, 1, d1 <= 5 OR d1 <= (n + 1) * 0.03 FROM c UNION ALL SELECT source_file, 2, d2 <= 5 OR d2 <= n * 0.03 FROM c UNION ALL SELECT source_file, 3, true FROM c""",
)(lambda rows: ingest.column_profiles(St.body(rows)).select("source_file", "col", "categorical"))
on_cells("inf_neutral_sign", "SELECT source_file, CASE WHEN count(CASE WHEN amount < 0 THEN 1 END) * 2 > count(CASE WHEN amount <> 0 THEN 1 END) THEN false END AS invert FROM num GROUP BY 1")(
    lambda rows: ingest.column_profiles(St.body(rows)).where("col = 2").select("source_file", F.when(F.col("negatives") * 2 > F.col("nonzero"), F.lit(False)).alias("invert"))
)
SCHEMA = ingest.StatementSchema(date=0, description=1, amount=2)


def canonical(body: DataFrame) -> DataFrame:
    return ingest.canonical(body, SCHEMA, F.lit("main"), transfer_words=["ring"])


def imported(rows: DataFrame) -> DataFrame:
    return Stored(canonical(St.body(rows))).df


TYPE = "CASE WHEN contains(description, 'ring') THEN CASE WHEN amount < 0 THEN 'internal_out' ELSE 'internal_in' END WHEN amount > 0 THEN 'income' ELSE 'expense' END AS tx_type"
on_cells("src_load_raw", f"SELECT source_file, row_idx, date, CAST(round(amount, 2) AS DECIMAL(18,4)) AS amount, description, {TYPE} FROM num")(
    lambda rows: canonical(St.loaded(rows)[0]).where("reject is null").select("source_file", "row_idx", "date", "amount", "description", "tx_type")
)
on_cells("agg_reject_reasons", f"SELECT 'no date' AS reject, count(*) AS n FROM ({PER})")(lambda rows: ingest.reject_reasons(imported(rows)))
on_cells("agg_dedup_sum", "SELECT source_file, date, description, amount * count(*) AS amount, count(*) - 1 AS merge_count FROM num GROUP BY source_file, date, description, amount HAVING count(*) > 1")(
    lambda rows: ingest.merge_repeats(imported(rows).where("reject is null")).where("merge_count > 0").select("source_file", "date", "description", F.col("amount").cast("decimal(38,4)").alias("amount"), "merge_count")
)
on_cells(
    "agg_import_recon",
    """, g AS (SELECT source_file, date, description, amount, count(*) AS n FROM num GROUP BY ALL), s AS (SELECT source_file, CAST(sum(n) + 1 AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS merged, count(*) AS ids, count(CASE WHEN date < DATE '1997-01-01' THEN 1 END) AS existing FROM g GROUP BY 1)
 SELECT source_file, total, CAST(1 AS BIGINT) AS skipped, merged, existing, ids - existing AS new FROM s""",
)(lambda rows: reconciled(imported(rows)))


def reconciled(rows: DataFrame) -> DataFrame:
    return ingest.import_report(rows, ingest.merge_repeats(rows.where("reject is null")).where("date < '1997-01-01'"))
