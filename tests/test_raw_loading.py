"""Raw loading of text statements: header, bad lines, sparse tails, sparse heads, empty columns."""

from tallywright.plans import ingest_queries as Q
from tallywright.sources import statements as St

KINDS = "source_file string, row_idx int, line string"


def with_rows(spark, files: dict):
    return St.with_cells(spark.createDataFrame([(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)], KINDS))


def test_steps_of_loading(spark):
    days = [f"{i % 28 + 1:02}/01/2024;text {i};;{i},50" for i in range(40)]
    files = {
        "certain": ["Statement;;;", "Date;Text;Note;Amount", *days[:3], "", "09/01/2024;a;b;1,00;more", "10/01/2024;short", ";Balance;;", ";;;end"],
        None: ["Date;Text;Note;Amount", *days[:5], "11/01/2024;x;;1,00;"],
        "few": ["Date;Amount", "x;", "y;"],
        "hidden": ["1;2;3;4;5;6;7;8", "10;;;;;;;", "a;b;c;d;e;f;g;h", *[f"{i};1;2;3;4;5;6;7" for i in range(40)]],
    }
    # the header that was found holds numbers only, so it isn't certain; nothing lies above the first dense row
    rows, info = St.loaded(with_rows(spark, files))
    got = {}
    for r in rows.orderBy("source_file", "row_idx").collect():
        got.setdefault(r["source_file"], []).append((r["row_idx"], r["cells"]))
    assert got["certain"] == [(2, ["01/01/2024", "text 0", "0,50"]), (3, ["02/01/2024", "text 1", "1,50"]), (4, ["03/01/2024", "text 2", "2,50"]), (7, ["10/01/2024", "short", None])]
    assert [i for i, _ in got[None]] == [1, 2, 3, 4, 5, 6] and got[None][-1][1] == ["11/01/2024", "x", "1,00"]
    assert got["few"] == [(1, ["x", None]), (2, ["y", None])]  # two columns stay
    known = {r["source_file"]: r for r in info.collect()}
    c = known["certain"]
    assert (c["header_idx"], c["header_certain"], c["skipped_rows"], c["columns"], c["dropped_columns"]) == (1, True, 1, ["Date", "Text", "Note", "Amount"], ["Note"])
    assert known["hidden"]["header_idx"] == 2 and len(got["hidden"]) == 40 and known["few"]["dropped_columns"] == []


def test_header_under_sparse_rows(spark):
    cells = [["x", None, None, None], ["y", None, None, None], ["Date", "Text", "Note", "Amount"], *[["1", "b", "c", "d"]] * 30]
    rows = lambda name, c: [(name, i, v) for i, v in enumerate(c)]
    table = spark.createDataFrame([*rows("f", cells), *rows(None, cells), *rows("over", cells[:12]), *rows("dense", cells[2:]), *rows("short", cells[:4])], "source_file string, row_idx int, cells array<string>")
    got = {r["source_file"]: (r["header_idx"], r["cells"], r["k"]) for r in St.moved_headers(table).collect()}
    assert got == {k: (2, ["Date", "Text", "Note", "Amount"], 2) for k in ("f", None)}


def test_src_load_raw_loads_by_all_steps(spark, monkeypatch):
    """A line of more cells than the header is no row, however well it reads."""
    lines = ["Account;;;", "Holder;;;", "Date;Description;Amount;Currency", "01/02/2024;shop;-1,00;EUR", "02/02/2024;torn;-2,00;EUR;9", "03/02/2024;ring;3,00;EUR", "04/02/2024;;;"]
    monkeypatch.setattr(Q, "rendered", lambda spark, d: spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], KINDS))
    from tallywright import registry

    got = registry.queries()["src_load_raw"](spark, "").collect()
    assert sorted((r["row_idx"], r["description"], r["tx_type"]) for r in got) == [(3, "shop", "expense"), (5, "ring", "internal_in")]
