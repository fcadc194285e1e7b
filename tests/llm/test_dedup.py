"""SimHash and exact duplicates against brute force."""

import hashlib
import re
import string

import pytest
from xxhash import xxh64_intdigest

from tallywright.llm import exact_dedup, jaccard, queries, simhash

from .conftest import TRICKY, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode("utf-8"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(rows):
    """Smallest id reachable over fingerprints at most four bits apart."""
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted((str(i), f"{f:016x}", least.get(find(f))) for i, f in fps)


def got(df):
    return sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in df.select("doc_id", simhash.hex_digits(simhash.F.col("fp")).alias("fingerprint"), "component_id").collect())


def test_tricky_rows(tricky):
    assert got(simhash.near_duplicates(tricky)) == slow_components([(i, t) for i, t, *_ in TRICKY])


def test_chains_link_through_neighbours(make):
    """Texts that change word by word: the ends are far apart, yet of one class."""
    words = prose(400).split()
    rows = []
    for k in range(25):
        words[k * 16] = f"new{k}"
        rows.append((100 - k, " ".join(words), "en", "a"))
    assert got(simhash.near_duplicates(make(rows))) == slow_components([(i, t) for i, t, *_ in rows])


def test_classes_of_fingerprints_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for k in range(1, 7):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), k)))
    for b in base[:8]:  # chains, of which the ends are far apart
        for k in range(12):
            b ^= sum(1 << i for i in rng.sample(range(64), 4))
            fps.add(b)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {r["node"]: r["root"] for r in simhash.fingerprint_classes(spark.createDataFrame([(f, f) for f in signed], "node long, fp long")).collect()}
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                root[find(a)] = find(b)
    classes = lambda of: sorted(sorted(f for f in signed if of(f) == r) for r in {of(f) for f in signed})
    assert classes(lambda f: got.get(f, f)) == classes(find)


def test_fingerprints_without_relation_share_few_keys(spark):
    import random

    rng = random.Random(9)
    nodes = spark.createDataFrame([(f, f) for f in (rng.getrandbits(64) - (1 << 63) for _ in range(20_000))], "node long, fp long")
    assert simhash.bucket_members(nodes).count() < 100  # keys of 20 bits: thousands, and four times as many for twice the texts


def test_query_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = queries.op1_simhash(spark, SF)
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out.collect()) == slow_components(docs)


def test_one_of_each_keeps_columns_and_one_row_a_class(tricky):
    kept = simhash.one_of_each(tricky)
    assert kept.columns == tricky.columns
    classes = {c for *_, c in slow_components([(i, t) for i, t, *_ in TRICKY])}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, classes))


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_duplicates(tricky, counters):
    rows = [(i, (t or "").translate(LOWER)) for i, t, *_ in TRICKY]
    best = {}
    for i, t in rows:
        best.setdefault(t, []).append(i)
    want, kept = [], {}
    for t, ids in best.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in sorted(ids, key=str):
            wins = i == keep and not kept.get((t, i))
            kept[t, i] = kept.get((t, i)) or wins
            want.append((str(i), str(keep), len(ids), wins, hashlib.sha256(t.encode()).hexdigest()))
    out = exact_dedup.exact_duplicates(tricky, counters)
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == sorted(want)


def test_heavy_digests_are_verified(make):
    rows = [(i, "hot text" if i % 3 else f"own {i}", "en", "a") for i in range(300)]
    heavy = exact_dedup.heavy_digests(exact_dedup.digests(make(rows)), 4).collect()
    assert [(r["group_size"], r["keep_id"]) for r in heavy] == [(200, 299)]


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each(empty).collect() == []
    assert exact_dedup.exact_duplicates(empty).collect() == []


@pytest.mark.parametrize("module", [simhash, jaccard])
def test_exploded_keys_are_not_broadcast(make, monkeypatch, module):
    """Spark takes a text's keys for as large as the text's row, and would send all of a small table's to the driver."""
    plans, saved = [], module.saved

    def watched(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(module, "saved", watched)
    module.near_duplicates(make([(i, prose(40, i % 3), "en", "a") for i in range(20)])).collect()
    exploded = [p for p in plans if "Generate explode" in p and "Join" in p]
    assert exploded and not any("BroadcastHashJoin" in p for p in exploded)
