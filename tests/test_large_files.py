"""Steps over a file's rows hold no file in one task."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywright.operators import ingest
from tallywright.sources import sinks
from tallywright.sources import statements as St


@pytest.fixture(scope="module")
def rows(spark):
    lines = [("a", i, f"0{i % 9 + 1}/02/2024;text {i};{i},50") for i in range(60)] + [("a", 60, ";Saldo;"), ("b", 0, "x|y"), ("b", 1, "1,0|2"), (None, 0, "p;q")]
    return St.with_cells(spark.createDataFrame(lines, "source_file string, row_idx int, line string"))


def windows(df) -> tuple[int, int]:
    """Windows of the plan, and those whose tasks pass on the first rows only."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Window ["), plan.count("WindowGroupLimit [")


def test_no_window_over_a_file(spark, rows):
    for df in (rows, St.body(rows), St.trim_sparse_tail(rows), St.strip_footer_missing(rows, [0]), St.strip_footer_outliers(rows), St.footer_by_patterns(rows, 1, ["zzz"])):
        assert windows(df) == (0, 0)
    assert windows(ingest.column_profiles(rows)) == (1, 1)


def test_steps_by_file(spark, rows):
    cells = {(r["source_file"], r["row_idx"]): r["cells"] for r in rows.collect()}
    assert cells["b", 1] == ["1,0", "2"] and cells[None, 0] == ["p", "q"] and cells["a", 60] == [None, "Saldo", None]
    marked = St.footer_by_patterns(rows, 1, ["zzz"], 1).where("footer is not null").collect()
    assert [(r["source_file"], r["row_idx"], r["footer"]) for r in marked] == [("a", 60, "suspect")]
    assert St.strip_footer_missing(rows, [0, 2]).where("source_file = 'a'").agg(F.max("row_idx")).first()[0] == 59
    assert St.strip_footer_outliers(rows).where("source_file = 'a'").agg(F.max("row_idx")).first()[0] == 59
    got = {r["col"]: (r["n"], r["filled"], r["distinct"], r["kind"], r["negatives"], r["nonzero"]) for r in ingest.column_profiles(rows).where("source_file = 'a'").collect()}
    assert got == {0: (61, 60, 9, "date", 0, 0), 1: (61, 61, 61, "text", 0, 0), 2: (61, 60, 60, "amount", 0, 60)}
    assert {r["source_file"] for r in ingest.column_profiles(rows).collect()} == {"a", "b", None}


def test_one_context_is_written_by_several_tasks(spark, tmp_path):
    kinds = ", ".join(f"{c} {'date' if c == 'date' else 'string'}" for c in sinks.EXPORT)
    made = [(f"i{i:03}", dt.date(2024, 1, 1) + dt.timedelta(i), *["x"] * (len(sinks.EXPORT) - 2)) for i in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_by_context(spark.createDataFrame(made, kinds), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select(F.input_file_name()).distinct().count() > 1
