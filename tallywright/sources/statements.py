"""Statement files as indexed lines and cells.

A corpus has many files, and a file may be of any size: files are read whole,
so that line numbers mean something, but what a later step needs of a file is a
grouped row, written, that its lines join; no step holds a file in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stored import Stored

DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 50
#: Encodings tried in order; the first of those with the fewest bad characters wins.
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, content) of every file under the path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")


def with_text(files: DataFrame) -> DataFrame:
    """Adds encoding, text and the content's SHA-256. Without a detector, validity alone decides: UTF-8 if it is, else Latin-1."""
    bad = lambda t: F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit("")))
    utf8 = F.try_validate_utf8(F.col("content").cast("binary").cast("string"))
    return files.select(
        "source_file", F.sha2("content", 256).alias("sha256"), F.when(utf8.isNotNull(), ENCODINGS[0]).otherwise(ENCODINGS[1]).alias("encoding"),
        F.regexp_replace(F.coalesce(utf8, F.decode("content", ENCODINGS[1])), "^﻿", "").alias("text"),
    ).withColumn("bad_characters", bad(F.col("text")))


def lines_of(texts: DataFrame) -> DataFrame:
    """(source_file, row_idx, line), from 0."""
    return texts.select("source_file", F.posexplode(F.split("text", r"\r?\n", -1)).alias("row_idx", "line"))


def delimiters(lines: DataFrame) -> DataFrame:
    """(source_file, delimiter): the most frequent one in the text, the first listed on a tie."""
    count = lambda d: F.sum(F.length("line") - F.length(F.replace("line", F.lit(d), F.lit(""))))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))
    return lines.groupBy("source_file").agg(best.getField("d").alias("delimiter"))


def cells(line: Column, delimiter: Column) -> Column:
    """Fields of one line; quotes hold delimiters together. Blank fields are null."""
    d = F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter)
    # a line without quotes needs no look ahead, which costs the square of a line's length
    plain = F.transform(F.split(line, d, -1), lambda x: F.nullif(F.trim(x), F.lit("")))
    parts = F.split(line, F.concat(d, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')), -1)
    quoted = F.transform(parts, lambda x: F.nullif(F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")), F.lit("")))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)


def with_file(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with the columns of ``known``, at most one row a source_file. It is written first, so that Spark sees its size."""
    per = Stored(known.withColumnRenamed("source_file", "_file")).df
    return rows.join(per, F.col("source_file").eqNullSafe(F.col("_file")), "left").drop("_file")


def with_cells(lines: DataFrame) -> DataFrame:
    """Lines with their cells."""
    known = with_file(lines.select("source_file", "row_idx", "line"), delimiters(lines))
    return known.select("source_file", "row_idx", "line", cells(F.col("line"), F.col("delimiter")).alias("cells"))


def filled(c: Column) -> Column:
    return F.size(F.filter(c, lambda x: x.isNotNull()))


def density(c: Column) -> Column:
    return F.try_divide(filled(c), F.size(c))


def _header_rank() -> Column:
    """Of the first lines the densest, then the one with most text fields, then the first."""
    text = F.size(F.filter("cells", lambda x: x.isNotNull() & ~F.regexp(x, F.lit(r"^[\d.,\-+\s€$£%]+$"))))
    rank = F.struct((-density(F.col("cells"))).alias("d"), (-text).alias("t"), F.col("row_idx"))
    return F.when(F.col("row_idx") < HEAD_LINES, rank)


def header_rows(rows: DataFrame) -> DataFrame:
    """(source_file, header_idx, certain)."""
    best = rows.select("source_file", _header_rank().alias("r")).groupBy("source_file").agg(F.min("r").alias("b"))
    return best.select("source_file", F.col("b.row_idx").alias("header_idx"), ((F.col("b.d") <= -0.5) & (F.col("b.t") <= -2)).alias("certain"))


def header_cells(rows: DataFrame) -> DataFrame:
    """(source_file, header_idx, cells, certain): the header of each file, from its first lines alone."""
    first = rows.where(F.col("row_idx") < HEAD_LINES).select("source_file", F.struct(_header_rank().alias("r"), "cells").alias("h"))
    best = first.groupBy("source_file").agg(F.min("h").alias("b"))
    return best.select("source_file", F.col("b.r.row_idx").alias("header_idx"), F.col("b.cells").alias("cells"), ((F.col("b.r.d") <= -0.5) & (F.col("b.r.t") <= -2)).alias("certain"))


def body(rows: DataFrame) -> DataFrame:
    """The rows under the header."""
    top = rows.groupBy("source_file").agg(F.min(_header_rank()).getField("row_idx").alias("_h"))
    return with_file(rows, top).where(F.col("row_idx") > F.col("_h")).drop("_h")


def header_hash(lines: DataFrame, n: int = 30) -> DataFrame:
    """SHA-256 of the first lines of each file."""
    head = lines.where(F.col("row_idx") < n).groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("row_idx", "line"))).alias("h"))
    return head.select("source_file", F.sha2(F.array_join(F.transform("h", lambda x: x["line"]), "\n"), 256).alias("header_sha256"))


def columns_key(names: Column) -> Column:
    """Key of a set of column names, whatever their order."""
    return F.concat(F.lit("cols:"), F.substring(F.sha2(F.array_join(F.array_sort(F.transform(names, lambda x: F.trim(x))), "|"), 256), 1, 16))


def _per_file() -> Window:
    return Window.partitionBy("source_file")


def _from_top():
    return _per_file().orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _from_bottom():
    return _per_file().orderBy(F.desc("row_idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trim_sparse_tail(rows: DataFrame, border_idx: Column | None = None) -> DataFrame:
    """Rows through the last one at least half filled; all if there is none.

    ``border_idx``, the last row of a bordered region, ends the table where no
    dense row lies beyond it.
    """
    last = F.max(F.when(density(F.col("cells")) >= 0.5, F.col("row_idx"))).alias("_last")
    end = F.greatest(F.col("_last"), border_idx) if border_idx is not None else F.col("_last")
    return with_file(rows, rows.groupBy("source_file").agg(last)).withColumn("_end", end).drop("_last").where(F.col("_end").isNull() | (F.col("row_idx") <= F.col("_end"))).drop("_end")


def strip_preheader(rows: DataFrame, most: int = 20, share: float = 0.10) -> DataFrame:
    """Drops the run of sparse rows at the top, those under half the median density; files under five rows stay.

    Raises where the run is over ``most`` rows or ``share`` of the file.
    """
    d = rows.withColumn("_d", density(F.col("cells")))
    m = d.withColumn("_sparse", F.col("_d") < F.median("_d").over(_per_file()) * 0.5).withColumn("_n", F.count(F.lit(1)).over(_per_file()))
    run = m.withColumn("_top", F.min("_sparse").over(_from_top()) & (F.col("_n") >= 5))
    k = run.withColumn("_k", F.sum(F.col("_top").cast("int")).over(_per_file()))
    bad = (F.col("_k") > most) | (F.col("_k") > F.col("_n") * share)
    checked = k.withColumn("_top", F.when(bad, F.raise_error(F.concat(F.lit("too many sparse rows at the top of "), F.col("source_file"))).cast("boolean")).otherwise(F.col("_top")))
    return checked.where(~F.col("_top")).drop("_d", "_sparse", "_n", "_top", "_k")


def moved_headers(table: DataFrame, most: int = 20, share: float = 0.10) -> DataFrame:
    """(source_file, header_idx, cells, k) of the files whose header lies below a run of k sparse rows, those under half the median density.

    table: rows with their header as the first of each file. Files under five
    rows, and those whose run is over ``most`` rows or ``share`` of the file, are left out.
    """
    d = Stored(table.select("source_file", "row_idx", density(F.col("cells")).alias("_d"))).df
    per = d.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"), F.median("_d").alias("_m"))
    sized = with_file(d, per)
    first = sized.groupBy("source_file").agg(F.min(F.when(F.col("_d") >= F.col("_m") * 0.5, F.col("row_idx"))).alias("_first"))
    run = with_file(sized, first).where(F.col("row_idx") < F.col("_first")).groupBy("source_file", "_first", "_n").agg(F.count(F.lit(1)).alias("k"))
    kept = run.where((F.col("_n") >= 5) & (F.col("k") <= most) & (F.col("k") <= F.col("_n") * share)).select("source_file", "_first", "k")
    return with_file(table, kept).where(F.col("row_idx") == F.col("_first")).select("source_file", F.col("_first").alias("header_idx"), "cells", "k")


def loaded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of the files, and what was done to each: rows (source_file, row_idx, cells), and (source_file, header_idx, header_certain, skipped_rows, columns, dropped_columns).

    The rows up to the header are skipped; blank lines and those with filled
    cells beyond the header's are left out, and shorter ones filled up. The
    table ends with its last row that is half filled. A header that is not
    certain, or the first line, may lie further down, under sparse rows. At last
    columns without any value go, at least two of the columns stay.
    """
    heads = Stored(header_cells(rows).withColumn("skipped", F.col("header_idx"))).df
    known = with_file(rows, heads.select("source_file", "header_idx", F.col("cells").alias("_names"), "certain"))
    width = F.size("_names")
    fits = ~F.exists(F.slice("cells", width + 1, F.greatest(F.size("cells") - width, F.lit(0))), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    padded = F.slice(F.concat("cells", F.array_repeat(none, width)), F.lit(1), width)
    below = known.where((F.col("row_idx") > F.col("header_idx")) & fits & (F.trim("line") != "")).select("source_file", "row_idx", padded.alias("cells"))
    table = Stored(trim_sparse_tail(below)).df
    open_ = heads.where(~F.col("certain") | (F.col("header_idx") == 0))
    if not open_.isEmpty():
        at = open_.select("source_file", F.col("header_idx").alias("_top"))
        top = open_.select("source_file", F.col("header_idx").alias("row_idx"), "cells")
        inside = with_file(table, at).where(F.col("_top").isNotNull()).drop("_top").unionByName(top)
        moved = Stored(moved_headers(inside).withColumnsRenamed({"source_file": "_file", "header_idx": "_idx", "cells": "_cells"})).df
        heads = heads.join(moved, F.col("source_file").eqNullSafe(F.col("_file")), "left").select(
            "source_file", F.coalesce("_idx", "header_idx").alias("header_idx"), F.coalesce("_cells", "cells").alias("cells"), "certain", F.when(F.col("certain") & (F.col("skipped") > 0), F.col("skipped")).otherwise(F.coalesce("k", F.lit(0))).cast("int").alias("skipped"),
        )
        heads = Stored(heads).df
        table = Stored(with_file(table, heads.select("source_file", F.col("header_idx").alias("_top"))).where(F.col("row_idx") > F.col("_top")).drop("_top")).df
    filled_at = table.select("source_file", F.posexplode("cells").alias("col", "v")).where("v is not null").select("source_file", "col").distinct()
    some = filled_at.groupBy("source_file").agg(F.array_sort(F.collect_list("col")).alias("_some"))
    counted = table.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    per = with_file(with_file(heads, some), counted).withColumn("_all", F.sequence(F.lit(0), F.size("cells") - 1))
    empty = F.array_except("_all", F.coalesce("_some", F.array().cast("array<int>")))
    n = F.greatest(F.size("_all") - 2, F.lit(0))
    per = per.withColumn("_gone", F.when(F.col("_n") >= 2, F.slice(empty, F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    per = Stored(per.withColumn("_kept", F.array_except("_all", "_gone"))).df
    named = lambda places: F.transform(places, lambda i: F.get("cells", i))
    info = per.select("source_file", "header_idx", F.col("certain").alias("header_certain"), F.col("skipped").alias("skipped_rows"), F.col("cells").alias("columns"), named("_gone").alias("dropped_columns"))
    return with_file(table, per.select("source_file", "_kept")).select("source_file", "row_idx", named("_kept").alias("cells")), info


def _cap(n: Column) -> Column:
    """At most five rows and a twentieth of the file go from the bottom, but one may."""
    return F.greatest(F.least(F.lit(5), F.floor(n * 0.05)), F.lit(1))


def _last_rows(rows: DataFrame, n: int) -> DataFrame:
    """The last rows of each file with their place from the bottom, ``_i``; the filter stands at the window, so each task passes on these only."""
    return rows.withColumn("_i", F.row_number().over(_per_file().orderBy(F.desc("row_idx")))).where(F.col("_i") <= n)


def _strip_bottom(rows: DataFrame, bad: Column, least: int) -> DataFrame:
    tail = _last_rows(rows.select("source_file", "row_idx", bad.alias("_bad")), 5)  # as many as may go
    run = tail.withColumn("_run", F.coalesce(F.min("_bad").over(_from_bottom()), F.lit(True))).where("_run")
    sized = with_file(run, rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n")))
    gone = sized.where((F.col("_i") <= _cap(F.col("_n"))) & (F.col("_n") >= least)).groupBy("source_file").agg(F.min("row_idx").alias("_cut"))
    return with_file(rows, gone).where(F.col("_cut").isNull() | (F.col("row_idx") < F.col("_cut"))).drop("_cut")


def strip_footer_outliers(rows: DataFrame) -> DataFrame:
    """Drops the run of rows at the bottom less dense than the lower fence Q1 - 1.5 IQR, quartiles without interpolation."""
    d = rows.withColumn("_d", density(F.col("cells")))
    # a file has few densities: those up to a place of the sorted rows
    upto = F.sum("_c").over(Window.partitionBy("source_file").orderBy("_d"))
    each = d.groupBy("source_file", "_d").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", upto).withColumn("_m", F.sum("_c").over(_per_file()))
    at = lambda share: F.max(F.when((F.col("_upto") > F.floor(F.col("_m") * share)) & (F.col("_upto") - F.col("_c") <= F.floor(F.col("_m") * share)), F.col("_d")))
    q = with_file(d, each.groupBy("source_file").agg(at(0.25).alias("_q1"), at(0.75).alias("_q3")))
    return _strip_bottom(q, F.col("_d") < F.col("_q1") - (F.col("_q3") - F.col("_q1")) * 1.5, 5).drop("_d", "_q1", "_q3")


def strip_footer_missing(rows: DataFrame, mandatory: list[int]) -> DataFrame:
    """Drops the run of rows at the bottom that miss one of the mandatory cells."""
    missing = reduce(lambda a, b: a | b, [F.get("cells", i).isNull() for i in mandatory], F.lit(False))
    return _strip_bottom(rows, missing, 3)


# Words of a footer, in the languages of statements.
SUSPECT = (
    "totale", "totali", "total", "totaux", "saldo", "saldi", "balance", "solde", "firma", "firme", "signature", "unterschrift", "timbro", "stamp", "cachet",
    "pagina", "page", "seite", "estratto", "extract", "extrait", "riepilogo", "summary", "résumé", "zusammenfassung",
)


def footer_pattern(text: Column) -> Column:
    """What is left of a description without dates and numbers."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}", ""), r"[\d.,]+", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def footer_by_patterns(rows: DataFrame, column: int, patterns: list[str], last: int = 10) -> DataFrame:
    """rows with footer: 'drop' where one of the last rows holds a known pattern, 'suspect' where it holds a footer word, else null."""
    text = footer_pattern(F.coalesce(F.get("cells", column), F.lit("")))
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in words], F.lit(False))
    ends = _last_rows(rows.select("source_file", "row_idx"), last).groupBy("source_file").agg(F.min("row_idx").alias("_from"))
    near = F.col("row_idx") >= F.col("_from")
    known = [p for p in patterns if len(p) >= 3]
    return with_file(rows, ends).withColumn("footer", F.when(near & holds(known), "drop").when(near & holds(SUSPECT), "suspect")).drop("_from")


def drop_null_columns(df: DataFrame, least: int = 2) -> DataFrame:
    """Without columns that are null throughout, keeping two at least; tables of one row or two columns stay."""
    if len(df.columns) <= least:
        return df
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if row[f"c{i}"]]
    if row["n"] < 2 or len(kept) < least:
        return df
    return df.select(*kept)
