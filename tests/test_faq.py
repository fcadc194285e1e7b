"""Markdown of many headings."""

from tallywright.operators import text


def test_every_heading_is_an_entry(spark):
    made = "".join(f"## q{i}\nanswer {i}\n" for i in range(10_003))
    out = text.faq_entries(spark.createDataFrame([(made,), ("no heading",), (None,)], "text string")).collect()
    assert [(r["question"], r["text"]) for r in out] == [(f"q{i}", f"answer {i}") for i in range(10_003)]


def test_retrieval_shuffles_no_posting_of_frequent_terms(spark, monkeypatch):
    """Scores are the same however few terms are broadcast, and groups by key and question need no further shuffle."""
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 11} rare{i}") for i in range(60)] + [(60, None), (61, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha w3 rare5 unheard"), (2, "w4 w5"), (3, None)], "item_id long, text string")
    rows = lambda: sorted(map(tuple, text.retrieve(docs, asked, 3, 0.05).collect()))
    many = rows()
    assert len(many) == 6 and many[1][:2] == (1, 5) and many[1][3] == 1
    plan = text.retrieve(docs, asked, 3, 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", term#" not in "".join(x for x in plan.splitlines() if "hashpartitioning(doc_id" in x)
    monkeypatch.setattr(text, "FREQUENT", 1)
    assert rows() == many
