"""The pipeline stage by stage, and the SQL of the corpus queries."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallywright.llm import mixing, queries, sharding, toxicity

from ..compare import duck, duck_rows, spark_rows
from .conftest import TRICKY
from .test_jaccard import slow_classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(duck(SF), queries.oracle_sql()[name])


def test_queries_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at = docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF).cache()
        results.append(out)
        at = out
    clean, unique, fresh, mixed, sharded = results
    for r in (clean, unique, fresh, mixed):
        assert r.columns == docs.columns
    model = toxicity.learn(docs, labels)
    scorer = toxicity.Scorer(model)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect() if scorer.score(r["text"])[0] < 0.7}
    assert sorted(str(r["doc_id"]) for r in unique.collect()) == slow_classes([(r["doc_id"], r["text"]) for r in clean.collect()])
    bench = [" " + " ".join((r["text"] or "").split()) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for r in fresh.collect():
        assert not any(b in " " + " ".join((r["text"] or "").split()) + " " for b in bench)
    took = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(fresh).collect() if r["taken"]}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == took
    assert sharded.count() == mixed.count() == sum(took.values()) and sharded.columns[: len(docs.columns)] == docs.columns
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in sharded.collect())
    size = collections.Counter()
    for r in sharded.collect():
        size[r["shard_id"]] += r["doc_bytes"]
    assert all(b <= sharding.LIMIT or n == 1 for (s, b), n in zip(size.items(), [sum(r["shard_id"] == s for r in sharded.collect()) for s in size]))


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "shard_id" in out.columns


def test_run_on_odd_and_empty_tables(spark, make, tmp_path):
    """Nulls, empty and repeated rows and clashing names go through all stages; empty tables give an empty result."""
    for name, rows in (("odd", TRICKY), ("empty", [])):
        d = tmp_path / name
        make(rows).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(d))
        names = [f"{c}_" if c in ("shard_id", "depth") else c for c in make(rows).columns]
        assert out.columns == [*names, "shard_id", "depth", "page", "doc_bytes", "shard_bytes"]
        got = out.collect()
        assert bool(got) == bool(rows) and all(r["text"] and r["shard_id_"] == "x" for r in got)


def test_names_that_differ_by_an_underscore(spark):
    """Columns page and page_ both keep a name of their own beside the shard's page."""
    docs = spark.createDataFrame([(1, "some text", 5, 6, "x"), (2, None, 7, 8, "y")], "doc_id long, text string, page long, page_ long, DEPTH string")
    out = corpus_pipeline.assign_shards(spark, docs, "")
    assert out.columns == ["doc_id", "text", "page__", "page_", "DEPTH_", "shard_id", "depth", "page", "doc_bytes", "shard_bytes"]
    assert {(r["doc_id"], r["page__"], r["page_"], r["DEPTH_"]) for r in out.collect()} == {(1, 5, 6, "x"), (2, 7, 8, "y")}
