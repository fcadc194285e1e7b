"""Alignment of two tokenizers against a walk over each text's tokens."""

import hashlib
from collections import Counter

from tallywright.llm import alignment, queries

from .conftest import TRICKY, prose

SF = "/root/testdata/sf0.001"


def slow(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a = Tokenizer.from_file(f"{alignment.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{alignment.FOLDER}/piece_bpe_32k.model")
    alphabet = set(ByteLevel.alphabet())
    plain = [i for i in range(256) if chr(i) in alphabet]
    others = [i for i in range(256) if chr(i) not in alphabet]
    back = {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(others)}

    def tokens(text):
        if not text:
            return [], []
        want = (" " + text).encode()
        x = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            y.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])

    docs, counts = [], Counter()
    for i, text in rows:
        x, y = tokens(text)
        spans = []
        for side in (x, y):
            at, out = 0, []
            for k, t in side:
                out.append((k, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for ka, s, e in spans[0]:
            while j < len(spans[1]) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((ka, spans[1][k][0]))
                k += 1
        both = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, start = [], 0
        for e in both:
            ids = ["".join(",".join(str(k) for k, s, t in side if start <= s and t <= e)) for side in spans]
            groups.append("|".join(ids))
            start = e
        docs.append((i, len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
        counts.update(links)
    best = {}
    for (_, kb), n in counts.items():
        best[kb] = max(n, best.get(kb, 0))
    return sorted((str(i), na, nb, ng, len(ln), sum(counts[p] == best[p[1]] for p in ln), sum(counts[p] for p in ln), h) for i, na, nb, ng, ln, h in docs)


def got(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert df.columns == cols
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


ODD = [(30, "  two  spaces\n\n\ttabs ", None, None), (31, "<|endoftext|> and <s> </s> <unk> <0x0A>", None, None), (32, "▁ lower one ▁▁", None, None), (33, "日本語 текст \u0000 ‍ 👩‍👩‍👧 é", None, None), (34, "﹏ﬁ ½", None, None)]


def test_tricky_rows(make, monkeypatch):
    rows = [r for r in TRICKY if len(r[1] or "") < 10_000] + ODD + [(10, prose(1500, 3), "en", "a")]
    want = slow([r[:2] for r in rows])
    assert got(alignment.alignments(make(rows))) == want
    assert sum(r[1] == 0 for r in want) >= 3 and sum(r[1] > 0 for r in want) > 15
    monkeypatch.setattr(alignment, "FREQUENT", 0.01)  # most pairs go by the shuffle
    assert got(alignment.alignments(make(rows))) == want
    monkeypatch.setattr(alignment, "FREQUENT", 2)
    assert got(alignment.alignments(make(rows))) == want


def test_query_on_a_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op13_alignment(spark, SF)) == slow(docs)


def test_empty(empty):
    assert alignment.alignments(empty).collect() == []


def test_encoders_agree_with_the_files_own_library(spark):
    """Ids by ranks are those of the file's library, on texts of every kind, and where the first gives up."""
    a, _ = alignment.tokenizers(alignment.FOLDER)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [t or "" for _, t, *_ in TRICKY + ODD]
    texts += ["a" * 50_000, " " * 3000 + "x" + "\n" * 3000, "don't we'll I'M 12345 ²½ Ⅷ  x", "ไทย हिन्दी 한국어 🇩🇪 ȩ́ ‍"]
    assert a.encode(texts) == [a.slow().encode(" " + t, add_special_tokens=False).ids for t in texts]

    class Gives:
        def encode_ordinary(self, text):
            raise ValueError("stack")

    kept, a.file = a.file, Gives()
    try:
        assert a.encode(["some text"]) == [kept.encode_ordinary(" some text")]
    finally:
        a.file = kept
