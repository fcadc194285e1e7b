"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from tallywright.llm import queries, spelling

from .conftest import TRICKY

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, letters=6, times=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(n):
    by, out = sorted(n), {}
    for w in by:
        others = [v for v in by if v != w and abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (form, len(others))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return sorted((w, f or "", root(w), n[w], k, n[f] if f else -1) for w, (f, k) in out.items())


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_query_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = slow_variants(slow_counts(docs))
    assert got(queries.op11_spelling(spark, SF)) == want and len(want) > 100


def test_edits_of_every_kind(make):
    """Chains of forms, anagrams, doubled letters, edits at either end and in the middle, letters beyond ASCII."""
    rng, letters = random.Random(3), "abcdeé×ÿ"
    base = ["".join(rng.choice(letters) for _ in range(k)) for k in (6, 7, 8, 11, 12, 25)] + ["aaaaaaa", "abababab", "aabbaabb"]
    words = {}
    for b in base:
        words[b] = 400
        for _ in range(25):
            w = b
            for _ in range(rng.randint(1, 3)):
                i, kind = rng.randrange(len(w) + 1), rng.randrange(4)
                w = w[:i] + rng.choice(letters) * (kind != 0) + w[i + (kind < 2) :]
                if kind == 3 and len(w) > 3:
                    w = w[1] + w[0] + w[2:]
            words.setdefault(w, rng.choice((1, 4, 5, 6, 30, 31, 150)))
    rows = [(i, " ".join([w] * k), "en", "a") for i, (w, k) in enumerate(words.items())]
    want = slow_variants(slow_counts([r[:2] for r in rows]))
    assert got(spelling.variants(make(rows))) == want
    assert any(f and r != f for _, f, r, *_ in want)


def test_tricky_rows(make):
    rows = TRICKY + [(20, "wording Wording WORDING wordingx wordingx wordingx wordingx wordingx", None, None)] * 5 + [(None, "wordinG", "x", "y")] * 30 + [(21, "q" * 30_000 + " ", "x", "y")] * 6 + [(22, "q" * 29_999, "x", "y")] * 40
    assert got(spelling.variants(make(rows))) == slow_variants(slow_counts([r[:2] for r in rows]))


def test_empty(empty):
    assert spelling.variants(empty).collect() == []
