"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random

import numpy as np

from tallywright.llm import queries, suffixes

from .conftest import TRICKY, prose

SF = "/root/testdata/sf0.001"


def slow(rows, window=100):
    seen, out = set(), []
    texts = {}
    for i, t in rows:
        texts[i, t or ""] = (t or "").encode()
    # the operator's order: ids, null last; the tie of a shared id is not asked for here
    for (i, t), b in sorted(texts.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            else:
                seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append(((i, t), (str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())))
    by = dict(out)
    return sorted(by[i, t or ""] for i, t in rows)


def got(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_tricky_rows(make):
    assert got(suffixes.deduplicated(make(TRICKY))) == slow([r[:2] for r in TRICKY])


def planted(seed=4):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz     éß😀"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [noise(k) for k in (60, 90, 95, 99, 100, 101, 130, 172, 300, 900)]
    rows = []
    for i in range(160):
        parts = [noise(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 30)
            parts += [p[cut : len(p) - rng.randint(0, 30)] if rng.random() < 0.5 else p, noise(rng.choice((0, 1, 3, 40, 120)))]
        rows.append((i * 7 % 1000 - 50, "".join(parts), "en", "a"))
    rows += [(2000, "a" * 1000, None, None), (2001, "a" * 700 + "b" + "a" * 120, None, None), (2002, "ab" * 300, None, None), (2003, "x" * 99, None, None), (2004, "x" * 99, None, None), (2005, "x" * 100, None, None)]
    rows += [(None, passages[-1] + "end", None, None), (2006, rows[5][1], "e", "s"), (2006, rows[5][1], "e", "s")]
    rng.shuffle(rows)
    return rows


def test_planted_passages(make, spark, monkeypatch):
    rows = planted()
    want = slow([r[:2] for r in rows])
    assert got(suffixes.deduplicated(make(rows).repartition(5))) == want and sum(r[2] > 0 for r in want) > 80
    assert got(suffixes.deduplicated(make(rows).repartition(1))) == want


def test_pieces_of_long_texts_and_large_anchor_groups():
    """Small limits, in this process: every path of a text in pieces, groups over the limit and partition ends."""
    rows = [(r[0], hash(r[1]), (r[1] or "").encode()) for r in planted(9)]
    import pyarrow as pa

    table = {(d, t): b for d, t, b in rows}
    for block, group in ((1 << 21, 8192), (150, 8192), (150, 3), (1 << 21, 2)):
        before = suffixes.BLOCK, suffixes.GROUP
        suffixes.BLOCK, suffixes.GROUP = block, group
        try:
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["doc", "tie", "text"])
            made = pa.Table.from_batches(list(suffixes._runs(iter([batch.slice(0, 60), batch.slice(60)]))))
            spans = [r for r in made.to_pylist() if r["anchor"] is None]
            runs = sorted((r for r in made.to_pylist() if r["anchor"] is not None), key=lambda r: (r["anchor"], r["context"], r["doc"] is None, r["doc"] or 0, r["tie"], r["start"]))
            found = []
            for part in (runs[:700], runs[700:701], runs[701:]):
                batches = [pa.RecordBatch.from_pylist(part[i : i + 50], schema=made.schema) for i in range(0, len(part), 50)]
                found += [r for b in suffixes._groups(iter(batches)) for r in b.to_pylist()]
            spans += [r for r in found if r["anchor"] is None]
            ctx = sorted(((r["anchor"], r["doc"], r["tie"], r["start"], table[r["doc"], r["tie"]][r["start"] : r["start"] + r["size"] + 99]) for r in found if r["anchor"] is not None), key=lambda r: r[0])
            batch = pa.record_batch([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*ctx))], names=["anchor", "doc", "tie", "start", "bytes"])
            spans += [r for b in suffixes._repeats(iter([batch.slice(i, 100) for i in range(0, batch.num_rows, 100)])) for r in b.to_pylist()]
            seen = set()
            for (d, t), b in sorted(table.items(), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1])):
                want, have = np.zeros(len(b), bool), np.zeros(len(b), bool)
                for s in range(len(b) - 99):
                    if b[s : s + 100] in seen:
                        want[s : s + 100] = True
                    seen.add(b[s : s + 100])
                for r in spans:
                    if (r["doc"], r["tie"]) == (d, t):
                        have[r["start"] : r["start"] + r["size"]] = True
                assert (want == have).all(), (block, group, d)
        finally:
            suffixes.BLOCK, suffixes.GROUP = before


def test_large_groups_by_window(make, monkeypatch):
    rows = planted(2)
    monkeypatch.setattr(suffixes, "GROUP", 4)  # read on the driver: anchors with more contexts go by windows
    assert got(suffixes.deduplicated(make(rows))) == slow([r[:2] for r in rows])


def test_longest_previous_factors():
    rng = random.Random(1)
    for letters in ("ab", "a", "abcdefgh"):
        text = "".join(rng.choice(letters) for _ in range(700)).encode()
        starts = np.arange(len(text) - 100)
        place = np.array(rng.sample(range(5000), len(starts)))
        got = suffixes.longest_previous_factors(np.frombuffer(text, np.uint8), starts, place)
        for i in range(0, len(starts), 23):
            common = lambda j: next((k for k in range(100) if text[i + k] != text[j + k]), 100)  # noqa: B023, E731
            assert got[i] == max((common(j) for j in range(len(starts)) if place[j] < place[i]), default=0)


def test_query_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow(docs)
    assert got(queries.op12_suffixes(spark, SF)) == want and sum(r[2] > 0 for r in want) > 20


def test_empty(empty):
    assert suffixes.deduplicated(empty).collect() == []


def test_long_text(make):
    long = prose(30_000, 3)
    rows = [(1, long, None, None), (2, "x " + long[5000:90_000] + prose(50_000, 5, 3), None, None)]
    assert got(suffixes.deduplicated(make(rows))) == slow([r[:2] for r in rows])
