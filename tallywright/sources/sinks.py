"""Where results go: CSV, workbooks, one file set a context, an HTML summary, the stored ledger."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import ledger_metrics, query_summary
from ..operators.changes import insert_absent
from . import workbooks as W

# The export's columns, in their order.
EXPORT = ("id", "date", "amount", "currency", "description", "raw_description", "account_label", "doc_type", "tx_type", "category", "subcategory", "category_confidence", "category_source", "context", "to_review", "source_file")

# The workbook's columns, in their order, and the columns of a context's sheet.
SHEET = ("date", "description", "amount", "currency", "account_label", "tx_type", "category", "subcategory", "confidence", "source", "to_review")
DETAIL = {"Data": "date", "Conto": "account_label", "Descrizione": "description", "Importo": "amount", "Categoria": "category", "Sottocategoria": "subcategory", "Contesto": "context", "Tipo": "tx_type"}
NO_CONTEXT = "—"


def write_csv(ledger: DataFrame, path: str) -> None:
    ledger.select(*EXPORT).write.mode("overwrite").option("header", True).csv(path)


def write_by_context(ledger: DataFrame, path: str) -> None:
    """A folder a context, newest first inside each file; the null context has its own. A large context is several files, by ranges of dates."""
    ordered = ledger.select(*EXPORT).repartitionByRange("context", F.desc("date"), "id").sortWithinPartitions("context", F.desc("date"), "id")
    ordered.write.mode("overwrite").partitionBy("context").parquet(path)


def _cell(df: DataFrame, name: str):
    """A column as a cell of its kind."""
    kind = df.schema[name].dataType.typeName()
    make = {"date": W.date_cell, "boolean": W.bool_cell, "string": W.text_cell}.get(kind, W.number_cell)
    return make(F.col(name))


def _as_sheet(df: DataFrame, sheet, order: list, titles: list[str] | None = None) -> DataFrame:
    cells = F.array(*[_cell(df, c) for c in df.columns])
    return df.select(sheet.alias("sheet"), F.array(*[F.lit(t) for t in titles or df.columns]).alias("head"), cells.alias("cells"), *[o.alias(f"o{i}") for i, o in enumerate(order)])


def write_xlsx(ledger: DataFrame, path: str, part_rows: int = W.PART_ROWS) -> int:
    """Workbooks with one sheet, newest rows first; a task's rows beyond ``part_rows`` go to a further workbook. Returns their number; an empty ledger gives none."""
    named = ledger.withColumnsRenamed({"category_confidence": "confidence", "category_source": "source"}).select("id", *SHEET)
    ordered = named.repartitionByRange(F.desc("date"), F.asc("id")).sortWithinPartitions(F.desc("date"), F.asc("id")).drop("id")
    sheets = _as_sheet(ordered, F.lit("Transactions"), []).withColumn("source_file", F.lit("transactions"))
    return W.write_files(W.workbooks(sheets, part_rows), path)


def write_report_xlsx(ledger: DataFrame, pivot: DataFrame, monthly: DataFrame, path: str, part_rows: int = W.PART_ROWS) -> int:
    """Workbooks with a summary sheet, a trend sheet and a sheet a context, newest first.

    Sheets lie in order over the workbooks; a context of more rows than one
    takes goes on, under its name, in the next. A sheet's name is cut to 31
    characters by the format; contexts alike in these stay apart by a number
    within a workbook.
    """
    text, none = lambda v: F.lit(v).cast("string"), F.lit(None)
    context = F.coalesce("context", F.lit(NO_CONTEXT))
    detail = ledger.withColumn("context", context)
    parts = [
        _as_sheet(pivot, F.lit("Riepilogo"), [F.lit(0), text(""), none.cast("date"), F.to_json(F.struct(*pivot.columns))]),
        _as_sheet(monthly, F.lit("Trend"), [F.lit(1), text(""), none.cast("date"), F.to_json(F.struct(*monthly.columns))]),
        _as_sheet(detail.select(*DETAIL.values()), F.col("context"), [F.lit(2), F.col("context"), F.col("date"), F.xxhash64(*DETAIL.values()).cast("string")], list(DETAIL)),
    ]
    order = [F.asc("o0"), F.asc("o1"), F.desc("o2"), F.asc("o3")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("source_file", F.lit("report"))
    return W.write_files(W.workbooks(ordered, part_rows), path)


def html_report(ledger: DataFrame, title: str) -> str:
    """Totals and a bar for each of the 100 largest categories; one more row sums up the others. Only these small sums reach the driver."""
    m = ledger_metrics(ledger).first()
    rows = query_summary(ledger).orderBy(F.desc(F.abs("total")), "category").limit(100).collect()
    shown = len(rows)
    rest = query_summary(ledger).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total")).first()
    widest = max((abs(r["total"]) for r in rows), default=0) or 1
    bars = "".join(f'<tr><td>{escape(r["category"])}</td><td>{r["total"]}</td><td><div style="width:{float(abs(r["total"]) / widest) * 100:.0f}%">&nbsp;</div></td></tr>' for r in rows)
    if rest["n"] > shown:
        bars += f'<tr><td>{rest["n"] - shown} more categories</td><td>{rest["total"] - sum(r["total"] for r in rows)}</td><td></td></tr>'
    return f"<html><head><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><p>{m['n']} rows, net {m['net']}, income {m['income']}, expense {m['expense']}</p><table>{bars}</table></body></html>"


def persist(stored: DataFrame, new: DataFrame, links: DataFrame) -> DataFrame:
    """The ledger with new rows added by id, and ``reconciled`` set on both ends of every link."""
    ends = links.select(F.explode(F.array(*links.columns)).alias("id")).distinct().withColumn("_r", F.lit(True))
    return insert_absent(stored, new, ["id"]).join(ends, "id", "left").withColumn("reconciled", F.coalesce("_r", F.lit(False))).drop("_r")
