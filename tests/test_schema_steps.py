"""What several steps ask of a file is parsed once."""

from tallywright.functions import scalars as S
from tallywright.operators import schemas
from tallywright.plans import statement_queries as Q
from tallywright.sources import statements as St
from pyspark.sql import functions as F


def test_chosen_schemas_are_written(spark):
    lines = [("a", 0, "Data operazione;Descrizione;Importo")] + [("a", i, f"0{i % 9 + 1}/02/2024;text {i};{i},50") for i in range(1, 60)] + [(None, 0, "p;q")]
    rows = St.with_cells(spark.createDataFrame(lines, "source_file string, row_idx int, line string"))
    heads, body = schemas.file_headers(rows), St.body(rows)
    assert [(r["source_file"], r["header_idx"], r["names"]) for r in heads.collect()] == [("a", 0, ["data operazione", "descrizione", "importo"])]
    chosen = schemas.chosen_schemas(body, heads, Q.schema_cache(spark))
    assert [(r["source_file"], r["flow"], r["amount"]) for r in chosen.collect()] == [("a", "inferred", 2)]
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_odd_amounts_and_dates(spark):
    rows = [("1e3", "1000.0000", None), ("x1", None, None), ("1/2", None, None), ("-1.234,5", "-1234.5000", None), ("1/2/2024", None, "2024-02-01"), ("2024-3-4", None, "2024-03-04"), ("12/25/2024", None, "2024-12-25"), ("1-2-99", None, "1999-02-01"), ("1/2-2024", None, None), (None, None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, v string").select("i", "v", S.parse_amount(F.col("v")).cast("string"), S.parse_date(F.col("v")).cast("string")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == rows


def test_sampled_rows_pass_on_few_rows(spark):
    """By hand for many rows of both signs; no row is dealt out by its place, and the window cuts rows off before they are."""
    files = {"a": [("x", str(v if v % 3 else -v)) for v in range(1, 90)], "b": [("x", "5")] * 2 + [(None, "-7")] * 9, None: [("x", "1"), (None, "2")], "c": [(None, "-1")] * 4 + [("y", None)]}
    rows = [(f, i, [*c]) for f, lines in files.items() for i, c in enumerate(lines)]
    body = spark.createDataFrame(rows, "source_file string, row_idx int, cells array<string>")
    n, want = 6, set()
    for f, lines in files.items():
        filled = [sum(c[k] is not None for c in lines) for k in (0, 1)]
        score = [sum(len(lines) / filled[k] for k in (0, 1) if c[k] is not None) for c in lines]
        order = sorted(range(len(lines)), key=lambda i: (-round(score[i], 9), i))
        sides = [[i for i in order if lines[i][1] is not None and (int(lines[i][1]) > 0) is up] for up in (True, False)]
        most = min(len(lines), n)
        picked = [i for s in sides for i in s[: most // 2]] if all(sides) else []
        picked += [i for i in order if i not in picked][: most - len(picked)]
        want |= {(f, i, round(score[i], 6)) for i in picked}
    out = schemas.sampled_rows(body, n)
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("WindowGroupLimit") == 1 and "Generate" not in plan
