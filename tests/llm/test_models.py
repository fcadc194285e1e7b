"""Toxicity, language and decontamination: held-out quality, exact parts against brute force, tricky rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm import decontam, langid, queries, toxicity

from .conftest import TRICKY, prose

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    out = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    pos, neg = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.8


def toxic_rows():
    return [(i, prose(20, i) + (" awfulword badword " if i % 4 == 0 else " ") + prose(20, i + 3), "en", "a") for i in range(200)]


def test_toxic_spans_and_scores(spark, make):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(make([*rows, *TRICKY]), labels).collect()
    assert len(out) == len(rows) + len(TRICKY)
    text = {i: t for i, t, *_ in rows}
    for r in [r for r in out if r["doc_id"] in text and r["held_out"] and r["doc_id"] > 20]:
        assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        if r["predicted"]:
            s, e = map(int, r["spans"].split(",")[0].split(":"))
            assert text[r["doc_id"]][s:e].startswith("awfulword")
    kept = toxicity.without_toxic(make([*rows, *TRICKY]), labels)
    assert len(kept.columns) == 19 and kept.count() == sum(r["score"] < 0.7 for r in out)


def test_marginals_are_those_of_all_paths():
    m = toxicity.ChainModel({"wbad": 4.0}, -2.0, (0.3, -0.5, -0.2, 0.4))
    e = [math.exp(m.score(t)) for t in ("a", "bad", "b", "bad")]
    a = np.array(m.trans).reshape(2, 2)
    total, each = 0.0, np.zeros(4)
    for path in np.ndindex(2, 2, 2, 2):
        w = math.exp(sum(a[x, y] for x, y in zip(path, path[1:]))) * math.prod(e[i] for i, s in enumerate(path) if s)
        total += w
        each += w * np.array(path)
    odds = m.odds(list(e))
    assert np.allclose([o / (1 + o) for o in odds], each / total)


def test_marginals_of_whole_chains_of_any_length():
    """The blocks of training give the marginals of the plain recursion, and count every transition."""
    rng = np.random.default_rng(3)
    lengths = np.array([1, 63, 64, 65, 0, 200, 3, 129])
    chains = toxicity._Chains(lengths)
    trans = rng.normal(size=(2, 2))
    e, values = np.ones(chains.real.shape), rng.exponential(1, lengths.sum())
    e.ravel()[chains.places()] = values
    p, pairs = chains.marginals(e, trans)
    model, want, i = toxicity.ChainModel({}, 0.0, tuple(trans.ravel())), [], 0
    for n in lengths:
        want += [o / (1 + o) for o in model.odds(list(values[i : i + n]))]
        i += n
    assert np.allclose(p.ravel()[chains.places()], want) and math.isclose(pairs.sum(), (lengths - 1).clip(0).sum())


def test_training_climbs_the_likelihood_of_all_tokens():
    """The gradient's fixed point: expected tags and transitions of the trained chain are near the derived ones."""
    texts = [" ".join(["bad" if (k * 7 + d) % 11 == 0 and d % 2 else f"w{(k * 3 + d) % 50}" for k in range(150)]) for d in range(60)]
    toxic = [d % 2 == 1 for d in range(60)]
    model = toxicity.train(texts, toxic)
    expected = sum(o / (1 + o) for t in texts for o in model.odds([math.exp(model.score(w)) for w in t.split()]))
    assert expected == pytest.approx(sum(t.split().count("bad") for t in texts), rel=0.1)


def test_spans_are_offsets_of_the_text_as_written():
    scorer = toxicity.Scorer(toxicity.ChainModel({"wbad": 12.0}, -6.0))
    for text in ("xİy bad zz", "BAD İİ, bad", "𝔘 bad\u0130 Bad", "ß" * 9 + " bad"):
        spans = scorer.spans(text, scorer.odds(text))
        assert [text[s:e].lower() for s, e in spans] == ["bad"] * text.lower().replace("bad\u0069\u0307", "").count("bad")


def test_the_sample_is_bounded_in_rows_and_bytes(spark, make):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    whole = toxicity.learn(make(rows + rows), labels)  # repeated rows count once
    assert whole.weights == toxicity.learn(make(rows), labels).weights and "wbadword" in whole.weights
    assert not toxicity.learn(make(rows), labels, max_bytes=0).weights


def test_all_labelled_documents_train(spark, make, monkeypatch):
    """A word of toxic texts that stand after the first 1000 in the order of their ids' hashes, and the model of all texts at once, however they are dealt out."""
    ids = [i for i in range(4200) if zlib.crc32(str(i).encode()) % 3 != 1]
    draw = dict(spark.createDataFrame([(i,) for i in ids if i % 2], "i long").select("i", F.xxhash64("i")).collect())
    late = set(sorted(draw, key=draw.get)[1000:])
    assert len(late) > 100
    rows = [(i, f"{prose(6 + i % 5, i)} {'awfulword' if i % 2 else 'fine'} {'lateword' if i in late else 'other'} t{i}", "en", "a") for i in ids]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(DataFrame, "toArrow", None)  # no table of texts comes to the driver
    got = toxicity.learn(make(rows).repartition(7), labels)
    assert "wlateword" in got.weights and "wawfulword" in got.weights
    want = toxicity.train([t for _, t, *_ in rows], [bool(i % 2) for i, *_ in rows])
    assert got.weights == want.weights and got.trans == want.trans and got.calibration == pytest.approx(want.calibration)


def test_toxicity_without_labels(spark, tricky, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(tricky, none).collect())
    assert toxicity.toxicity(empty, none).collect() == []
    assert toxicity.without_toxic(empty, none).collect() == []


def test_language_on_held_out_rows(spark):
    out = queries.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def slow_bits(model_texts, text, order=3):
    """Code length of a text, byte by byte, by escapes from the longest context down."""
    seen = {}
    for t in model_texts:
        data = b"\0" * order + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                seen[data[i - k : i]][data[i]] += 1
    bits, data = 0.0, b"\0" * order + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            nexts = seen.get(data[i - k : i])
            if not nexts:
                continue
            total = sum(nexts.values()) + len(nexts)
            if data[i] in nexts:
                bits -= math.log2(nexts[data[i]] / total)
                break
            bits -= math.log2(len(nexts) / total)
        else:
            bits += 8.0
    return bits


def test_code_lengths_are_exact():
    texts = {"x": ["abracadabra", "abc abd"], "y": ["zyzzyva äö", "zebra zoo"]}
    model = langid.Predictor(langid.train(texts))
    probes = ["abra", "zebra ä", "q", "abd abc zoo", "öö", "", "\0a\0"]
    want = [[slow_bits(texts[k], p) for k in sorted(texts)] for p in probes]
    assert np.allclose(model.code_lengths(probes), want, rtol=1e-4)


def test_code_lengths_of_many_languages_and_whole_texts(spark, monkeypatch):
    """Twenty languages learned from real texts, every byte of twenty others; no context is left out, chunks do not matter."""
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(320).collect() if r["text"]]
    texts = {f"l{k:02}": rows[20 + k :: 25][:8] for k in range(20)}
    model = langid.Predictor(langid.train(texts))
    assert len(model.blocks) == 3
    monkeypatch.setattr(langid, "_CHUNK", 997)
    probes = [t[:1500] for t in rows[:20]]
    for k, lang in enumerate(sorted(texts)):
        assert np.allclose(model.code_lengths(probes)[:, k], [slow_bits(texts[lang], p) for p in probes], rtol=1e-4)


def test_spark_counts_what_the_texts_hold(make):
    rows = [(i, prose(9 + i % 5, i), "ab"[i % 2], "s") for i in range(60)] + [(100 + i, prose(9), "a", "s") for i in range(5)]
    got = langid.learn(make(rows))
    want = langid.train({k: sorted({t for i, t, lang, _ in rows if lang == k and zlib.crc32(str(i).encode()) % 3 != 1}) for k in "ab"})
    assert got.langs == want.langs and all((a == b).all() for x, y in ((got.grams, want.grams), (got.counts, want.counts)) for a, b in zip(x, y))


def test_language_sample_is_bounded_without_ids(spark):
    """Many rows share no id or one id: the sample stays within its rows."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.md5(F.col("id").cast("string").cast("binary"))).alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    taken = []
    real = langid.PpmModel
    try:
        langid.PpmModel = lambda langs, grams, counts: taken.append(counts)
        langid.learn(rows)
    finally:
        langid.PpmModel = real
    assert all(0 < c.sum() <= langid.MAX_DOCS * 40 for c in taken[0]) and len(taken[0]) == 2


def test_language_of_tricky_rows(make, tricky, empty):
    out = {}
    for r in langid.languages(tricky).collect():
        out.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert out[4] == ["und"] and out[5] == ["und"] and out[6] == ["und"] and len(out[3]) == 2
    assert langid.languages(empty).collect() == []
    assert {r["lang_pred"] for r in langid.languages(make([(1, "word", None, "a")])).collect()} == {"und"}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, " ".join(f"term{k}x" for k in random.Random(i).sample(range(400), 24 + i))) for i in range(20)]
    return rows, spark.createDataFrame([*rows, (90, None), (91, ""), (None, "z z z")], "item_id long, text string")


def test_decontamination_finds_copies_and_paraphrases(make, items):
    rows, table = items
    docs = [(i, prose(200 + i, i), "en", "a") for i in range(60)]
    want = set()
    for i, t in rows:
        w = t.split()
        docs.append((100 + i, f"{prose(13 + i)} {t.upper()}, {prose(40)}", "en", "a"))  # a copy
        para = [x for j, x in enumerate(w) if j % 9 != 4]  # words dropped and put in
        para.insert(6, "however")
        docs.append((200 + i, f"{prose(30)} {' '.join(para)} {prose(5)}", "en", "a"))
        docs.append((300 + i, f"{prose(30)} {' '.join(w[: len(w) // 3])} {prose(30)}", "en", "a"))  # too little of it
        want |= {(100 + i, i), (200 + i, i)}
    docs += TRICKY
    df = make(docs)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, table).collect()}
    assert got == want
    kept = decontam.without_contaminated(df, table)
    assert kept.columns == df.columns and kept.count() == len(docs) - 40


def test_decontamination_against_brute_force(spark):
    """Every document that holds an item's words in a row is found; every other that is found holds the stated share of them."""
    docs = {r["doc_id"]: decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    joined = {i: " " + " ".join(w) + " " for i, w in docs.items()}
    exact = {(d, k) for k, w in items.items() if w for d, t in joined.items() if " " + " ".join(w) + " " in t}
    got = {(r["doc_id"], r["item_id"]): r["lcs"] for r in queries.op6_decontamination(spark, SF).collect()}
    assert exact <= set(got)
    assert all(v >= decontam.LCS for v in got.values())


def test_decontamination_recall_of_edited_passages(spark, make):
    """Against an exhaustive search of every stretch of every text, with the space fitted on a tenth of the documents."""
    rng = random.Random(2)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r["text"]]
    table = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], decontam.words_of(r["text"])) for r in table.collect()]
    rows = []
    for n, text in enumerate(texts[:600]):
        words = text.split()[:200]
        if n % 3 == 0:
            _, item = items[rng.randrange(len(items))]
            edited = [w for w in item if rng.random() > 0.08]  # words go, change and come
            edited = [w if rng.random() > 0.08 else f"other{rng.randrange(50)}" for w in edited]
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited
        rows.append((n, " ".join(words), "en", "a"))
    space = decontam.Space(items, decontam.vocabulary(items), {}, 0)
    docs = {i: [space.vocab.get(w, -1) for w in decontam.words_of(t)] for i, t, *_ in rows}
    want = set()
    for k, item in enumerate(space.coded):
        span = len(item) + max(4, len(item) // 4)
        for d, codes in docs.items():
            if decontam.lcs_length(item, codes) < decontam.LCS * len(item):
                continue
            if any(decontam.lcs_length(item, codes[s : s + span]) >= decontam.LCS * len(item) for s in range(max(1, len(codes) - span + 1))):
                want.add((d, items[k][0]))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(make(rows), table, sample_docs=60).collect()}
    print("recall", len(got & want) / len(want), len(want), len(got - want))
    assert len(want) > 100 and len(got & want) / len(want) >= 0.9
    assert got <= want


def test_sparse_products_are_those_of_dense_rows():
    rng = np.random.default_rng(1)
    items = [(i, [f"t{k}" for k in rng.integers(0, 40, 12)]) for i in range(600)]
    vocab = decontam.vocabulary(items)
    space = decontam.Space(items, vocab, {k: k for k in range(20)}, 50)
    dense = np.zeros((len(items), len(vocab)))
    for i, c in enumerate(space.coded):
        np.add.at(dense[i], c, space.idf[c])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    x, total = rng.normal(size=(len(vocab), 5)), np.zeros((len(vocab), 5))
    decontam.add_products(space, [*space.coded, []], x, total)
    assert np.allclose(total, dense.T @ (dense @ x))


def test_space_is_fitted_on_every_document(spark, make, items, monkeypatch):
    """Both passes read the passages of all documents, more than 2000 and repeated ones too."""
    seen, products = spark.sparkContext.accumulator(0), decontam._range_products

    def counted(shared):
        run = products(shared)

        def counting(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return lambda batches: run(counting(batches))

    monkeypatch.setattr(decontam, "_range_products", counted)
    rows = [(i, f"{items[0][i % 20][1]} {i % 1500}", "en", "a") for i in range(3000)]
    read = decontam.read_items(items[1])
    vocab = decontam.vocabulary(read)
    decontam.fit(decontam.encode(make(rows), vocab), read, vocab)
    assert seen.value == 2 * len(rows)


@pytest.mark.parametrize("table", [decontam._TABLE, 0])
def test_products_of_a_partition_are_those_of_all_its_passages(monkeypatch, table):
    """By the table of pairs and, where terms are too many for it, passage by passage."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(decontam, "_TABLE", table)
    monkeypatch.setattr(decontam, "_TOKENS", 100)
    items = [(i, [f"t{k}" for k in rng.integers(0, 30, 9)]) for i in range(20)]
    vocab = decontam.vocabulary(items)
    space = decontam.Space(items, vocab, {k: k for k in range(20)}, 50)
    codes = [rng.integers(-1, len(vocab), n).astype(np.int32) for n in (0, 1, 15, 16, 17, 31, 32, 33, 48, 49, 700)]
    x, want = rng.normal(size=(len(vocab), 5)), np.zeros((len(vocab), 5))
    for c in codes:
        decontam.add_products(space, decontam._passages(c), x, want)
    shared = type("Shared", (), {"value": (space, x)})
    got = np.zeros(want.shape)
    for b in decontam._range_products(shared)(iter([pa.record_batch([pa.array([c.tobytes() for c in codes], pa.binary())], names=["codes"])])):
        got[b.column(0).to_numpy()] = b.column(1).to_pylist()
    assert np.allclose(got, want)


def test_decontamination_of_empty_tables(spark, empty, tricky, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(tricky, none).collect() == []
    assert decontam.contaminated(empty, items[1]).collect() == []
    assert decontam.without_contaminated(empty, items[1]).collect() == []
    assert decontam.without_contaminated(tricky, none).count() == len(TRICKY)
