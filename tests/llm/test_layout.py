"""Mixing and sharding against brute force."""

import collections
import re

import pytest

from tallywright.llm import mixing, sharding

from .conftest import TRICKY, prose


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_targets(sizes, weights=(5, 2, 1), budget=1.5, repeats=2):
    """Round by round: hand out what is left by weight, stop those over their caps."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, target, left = set(order), {}, budget * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > repeats * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, out):
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want = slow_targets(sizes)
    by_source = collections.Counter()
    source = {}
    for i, t, _, s in rows:
        source[i, words(t)] = s
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), words(t)) for i, t, *_ in rows)
    for r in out:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source[s] += r["taken"]
    longest = collections.Counter()
    for _, t, _, s in rows:
        longest[s] = max(longest[s], words(t))
    for s in sizes:
        assert abs(by_source[s] - want[s]) <= 2 * max(longest.values()) + 1


def test_mix_of_tricky_rows(tricky):
    check_mix(TRICKY, mixing.mix(tricky).collect())


def test_mix_of_a_hot_source_comes_near_its_targets(make):
    rows = [(i, prose(5 + i % 17, i), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    out = mixing.mix(make(rows)).collect()
    check_mix(rows, out)
    again = mixing.mix(make(rows[::-1]).repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixed_documents_repeat_rows(make):
    rows = [(i, prose(5 + i % 17, i), "en", f"s{i % 4}") for i in range(300)]
    docs = make(rows)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect()}
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == {i: n for i, n in want.items() if n}


def test_mixed_documents_of_shared_ids(make):
    """Ids of several rows, null and hot ones too: the rows come out exactly as often as the mix takes them."""
    rows = [(i % 10 if i % 3 else None, prose(15, i), "en", f"s{i % 2}") for i in range(60)] + [(7, prose(4 + i % 3, i), None, None) for i in range(40)]
    docs = make(rows)
    want = collections.Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    got = collections.Counter()
    out = mixing.mixed_documents(docs).collect()
    for r in out:
        got[r["doc_id"], words(r["text"])] += words(r["text"])
    assert got == collections.Counter({k: n for k, n in want.items() if n})
    assert max(collections.Counter(map(tuple, out)).values()) <= 2 * max(collections.Counter((i, t) for i, t, *_ in rows).values())


def slow_shards(rows, limit):
    """A directory that splits one bit at a time; (prefix, bytes) by row."""
    done = {}

    def split(prefix, part):
        if sum(b for _, b in part) <= limit or len(prefix) == sharding.HASH_BITS:
            done[prefix] = part
            return
        for bit in "01":
            sub = [(h, b) for h, b in part if h[len(prefix)] == bit]
            if sub:
                split(prefix + bit, sub)

    split("", rows)
    return {(p, len(part), sum(b for _, b in part)) for p, part in done.items()}


def test_shards_are_those_of_bit_by_bit_splits(make):
    rows = [(i, prose(3 + i % 40, i), "en", "a") for i in range(800)] + [(1000, prose(3000), "en", "a")]
    docs = make(rows)
    limit = 4000
    out = sharding.shards(docs, limit).collect()
    hashes = {r["doc_id"]: format(r["h"], f"0{sharding.HASH_BITS}b") for r in docs.select("doc_id", sharding.F.shiftrightunsigned(sharding.F.xxhash64(sharding.F.col("doc_id").cast("string")), 64 - sharding.HASH_BITS).alias("h")).collect()}
    want = slow_shards([(hashes[i], len(t.encode())) for i, t, *_ in rows if i != 1000], limit)
    small = [r for r in sharding.shards(make(rows[:-1]), limit).collect()]
    got = collections.Counter(r["shard_id"] for r in small)
    assert {(r["shard_id"], got[r["shard_id"]], r["shard_bytes"]) for r in small} == want
    size = collections.Counter()
    for r in out:
        size[r["shard_id"]] += r["doc_bytes"]
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, *_ in rows)
    assert all(r["shard_bytes"] == size[r["shard_id"]] for r in out)
    assert all(size[r["shard_id"]] <= limit or r["doc_id"] == 1000 for r in out)
    assert sum(r["shard_id"] == next(x["shard_id"] for x in out if x["doc_id"] == 1000) for r in out) == 1


def test_many_rows_of_one_id_are_paged(make):
    docs = make([(1, prose(20), "en", "a")] * 50 + [(2, "x", "en", "a")])
    out = sharding.shards(docs, 500).collect()
    size = collections.Counter()
    for r in out:
        size[r["shard_id"]] += r["doc_bytes"]
    assert len(out) == 51 and max(size.values()) <= 500 and all(size[r["shard_id"]] == r["shard_bytes"] for r in out)


def test_shards_of_tricky_rows(tricky, tmp_path):
    out = sharding.shards(tricky, 400)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, *_ in TRICKY)


def test_written_shards_hold_all_rows(spark, make, tmp_path):
    docs = make([(i, prose(3 + i % 40, i), "en", "a") for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.select("row.doc_id").collect()) == list(range(100))
    assert sum(1 for _ in (tmp_path / "out").glob("shard_id=*")) > 1


def test_written_shards_of_shared_ids_keep_the_limit(spark, make, tmp_path):
    limit = 2000
    rows = [(1, "x" * 500, "en", f"s{i}") for i in range(50)] + [(None, "y" * 300, "en", "a")] * 30 + [(None, None, "en", "a")] * 9 + [(2, "z" * 5000, "en", "a"), (3, "short", "en", "a")]
    docs = make(rows)
    sharding.write_shards(docs, str(tmp_path / "out"), limit)
    back = spark.read.parquet(str(tmp_path / "out")).select("row.*", sharding.F.col("shard_id").alias("at")).collect()
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in back) == collections.Counter((i, t, s) for i, t, _, s in rows)
    size, count = collections.Counter(), collections.Counter()
    for r in back:
        size[r["at"]] += len(r["text"] or "")
        count[r["at"]] += 1
    assert all(b <= limit or count[s] == 1 for s, b in size.items())
    ours = collections.Counter((r["shard_id"], r["page"], r["shard_bytes"]) for r in sharding.shards(docs, limit).collect())
    assert ours == collections.Counter((r["shard_id"], r["page"], r["shard_bytes"]) for r in sharding.sharded_documents(docs, limit).collect())


def test_empty_tables(empty):
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []
    assert sharding.shards(empty).collect() == []
    assert sharding.sharded_documents(empty).collect() == []


def test_numbers_come_in_parts(spark, monkeypatch):
    from tallywright.llm import common

    monkeypatch.setattr(common, "NUMBERS", 3)
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10)], "k string, n long")
    assert sorted((r["k"], r["i"]) for r in common.each_number(rows, "n", "i").collect()) == sorted((k, i) for k, n in (("a", 1), ("b", 3), ("c", 10)) for i in range(n))
