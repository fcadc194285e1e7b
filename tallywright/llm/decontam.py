"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words. TF-IDF over the terms of
the benchmark, with document frequencies counted over all documents, spans the
term space; a distributed randomised SVD of benchmark items and the passages of
all documents gives its latent space. Every passage of every document is
projected and compared with all items; those over the cosine threshold are
verified by the longest common subsequence with the item, in words, and by the
item's answer: its rarest terms must be there too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

BLOCK = 16  # words; a passage is two blocks, the next begins one block on
RANK = 96
OVERSAMPLE = 16
COSINE = 0.45
LCS = 0.75
#: An edited copy lacks some of its rarest terms, and those it lacks are rarer for it: half of ten is met by nearly all.
ANSWER_TERMS, ANSWER_SHARE = 10, 0.5
#: Numbers of the term-by-term table that a task sums its passages in; with more terms it multiplies passage by passage.
_TABLE = 1 << 24
_TOKENS = 1 << 16
_ROWS = 256
_ITEMS = 2048
_CACHE = 1_000_000
#: Edge punctuation that does not belong to a word.
_EDGE = ".,;:!?\"'()[]|*%&$#"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their edges."""
    return [w for w in (x.strip(_EDGE) for x in (text or "").lower().split()) if w]


def lcs_length(pattern: list[int], text: list[int]) -> int:
    """Longest common subsequence by bit rows: one step for each word of the text."""
    masks: dict[int, int] = {}
    for i, p in enumerate(pattern):
        masks[p] = masks.get(p, 0) | 1 << i
    full = (1 << len(pattern)) - 1
    row = full
    for t in text:
        if m := masks.get(t):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(pattern) - row.bit_count()


class Coder(dict):
    """Texts to term numbers, -1 for a word that is no term. Words met are remembered, up to a bound."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE:
            self.clear()
        code = self[word] = self.vocab.get(word.lower().strip(_EDGE), -1)
        return code

    def codes(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Space:
    """The benchmark's terms, their idf, and the latent space; small, as the benchmark is."""

    def __init__(self, items: list[tuple[int, list[str]]], vocab: dict[str, int], df: dict[int, int], documents: int):
        self.items = [(i, w) for i, w in items if w]
        self.vocab = vocab
        # squared, so that an item's rare terms outweigh the words all passages share
        self.idf = np.array([np.log((1 + documents) / (1 + df.get(k, 0))) ** 2 + 1e-3 for k in range(len(vocab))], np.float32)
        self.coded = [[self.vocab[t] for t in w] for _, w in self.items]
        self.answers = [set(sorted(set(c), key=lambda k: (-self.idf[k], k))[:ANSWER_TERMS]) for c in self.coded]
        #: the items a term answers, all terms' lists in one array; blocks to either side that an item may reach; terms needed
        asked = sorted((t, k) for k, a in enumerate(self.answers) for t in a)
        self.asked = np.array([k for _, k in asked], np.int64)
        self.asked_from = np.searchsorted([t for t, _ in asked], np.arange(len(vocab) + 1))
        self.reach = np.array([-(-len(c) // BLOCK) for c in self.coded], np.int64)
        self.need = np.array([ANSWER_SHARE * len(a) for a in self.answers])
        self.basis: np.ndarray | None = None
        self.vectors: np.ndarray | None = None

    def entries(self, coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The TF-IDF rows of passages, of unit length, as (row, term, weight) sorted by row; as many as there are distinct words."""
        row = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        return self.weighed(row, np.fromiter((t for c in coded for t in c), np.int64, len(row)), len(coded))

    def weighed(self, row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of a (row, term) for each word."""
        key, n = np.unique(row * max(1, len(self.vocab)) + term, return_counts=True)
        row, term = np.divmod(key, max(1, len(self.vocab)))
        weight = self.idf[term].astype(np.float64) * n
        norm = np.sqrt(np.bincount(row, weight * weight, rows))
        return row, term, weight / np.maximum(norm, 1e-9)[row]

    def fix(self, basis: np.ndarray) -> None:
        """basis: terms x rank with orthonormal columns."""
        self.basis = np.ascontiguousarray(basis * self.idf[:, None], np.float32)  # a term's contribution, idf included
        v = np.zeros((len(self.coded), basis.shape[1]), np.float32)
        for i in range(0, len(self.coded), _ROWS):
            part = self.coded[i : i + _ROWS]
            v[i : i + _ROWS] = projected(self.entries(part), len(part), basis)
        self.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _summed(values: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct members of the sorted ``by``, and the sums of their rows of ``values``."""
    cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
    return by[cut], np.add.reduceat(values, cut, axis=0) if len(cut) else values[:0]


def projected(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, x: np.ndarray) -> np.ndarray:
    """A x for the sparse rows A, ``n`` of them."""
    row, term, weight = entries
    out = np.zeros((n, x.shape[1]))
    at, sums = _summed(weight[:, None] * x[term], row)
    out[at] = sums
    return out


def add_products(space: Space, coded: list[list[int]], x: np.ndarray, total: np.ndarray) -> None:
    """Adds A'A x to ``total`` for the TF-IDF rows A of the passages, _ROWS at a time; nothing is as large as rows x terms."""
    for i in range(0, len(coded), _ROWS):
        part = coded[i : i + _ROWS]
        row, term, weight = space.entries(part)
        low = projected((row, term, weight), len(part), x)
        order = np.argsort(term, kind="stable")
        at, sums = _summed(weight[order, None] * low[row[order]], term[order])
        total[at] += sums


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([coder.codes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "codes"])

    return run


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in column.to_pylist()]


def _count_passages(words):
    return -(-np.maximum(1, words - BLOCK) // BLOCK)


def _document_frequencies(size: int):
    """A partition's share of the documents that hold each term; under -1 all documents, under -2 their passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n, passages = np.zeros(size, np.int64), 0, 0
        for b in batches:
            n += b.num_rows
            for c in _arrays(b.column(0)):
                passages += _count_passages(len(c))
                here = np.zeros(size + 1, bool)
                here[c] = True  # -1 marks the last, unused place
                count += here[:size]
        hit = np.flatnonzero(count)
        yield pa.record_batch([pa.array([*hit.tolist(), -1, -2], pa.int32()), pa.array([*count[hit].tolist(), n, passages], pa.int64())], names=["term", "n"])

    return run


def _passages(codes: np.ndarray) -> list[list[int]]:
    """The terms of each passage of a text."""
    starts = range(0, max(1, len(codes) - BLOCK), BLOCK)
    return [[int(c) for c in codes[s : s + 2 * BLOCK] if c >= 0] for s in starts]


def _passage_terms(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(passage, term) of each word in each passage of the texts, passages numbered on from text to text, and how many there are."""
    size = np.array([len(c) for c in codes], np.int64)
    n = _count_passages(size)
    flat = np.concatenate(codes).astype(np.int64)
    text = np.repeat(np.arange(len(codes)), size)
    block = (np.arange(len(flat)) - (np.cumsum(size) - size)[text]) // BLOCK
    live = flat >= 0
    flat, text, block = flat[live], text[live], block[live]
    passage = (np.cumsum(n) - n)[text] + block
    begins, within = block < n[text], block > 0  # the passage that the word's block begins, and the one before
    return np.concatenate((passage[begins], passage[within] - 1)), np.concatenate((flat[begins], flat[within])), int(n.sum())


def add_pairs(space: Space, codes: list[np.ndarray], table: np.ndarray) -> None:
    """Adds the upper half of A'A to the term-by-term ``table`` for the TF-IDF rows A of all passages of the texts: a passage has few terms."""
    row, term, weight = space.weighed(*_passage_terms(codes))
    after = np.cumsum(np.bincount(row))[row] - np.arange(len(row))  # entries to the end of the row, this one included
    base, at, k = term * len(table), np.arange(len(row)), 0
    while len(at):  # each entry with the k-th after it
        np.add.at(table.reshape(-1), base[at] + term[at + k], weight[at] * weight[at + k])
        k += 1
        at = at[after[at] > k]


def _portions(codes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _TOKENS words; a longer text stands alone."""
    i = 0
    while i < len(codes):
        j, n = i, 0
        while j < len(codes) and (j == i or n + len(codes[j]) <= _TOKENS):
            n += len(codes[j])
            j += 1
        yield i, j
        i = j


def _range_products(shared):
    """A partition's share of A'A times a start, in rows (term, values); ``shared``: a broadcast of space and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, start = shared.value
        total, terms = np.zeros(start.shape), len(space.vocab)
        table = np.zeros((terms, terms)) if terms * terms <= _TABLE else None
        for b in batches:
            codes = _arrays(b.column(0))
            for i, j in _portions(codes):
                if table is not None:
                    add_pairs(space, codes[i:j], table)
                else:
                    for c in codes[i:j]:
                        add_products(space, _passages(c), start, total)
        if table is not None:
            total = table @ start + table.T @ start - np.diag(table)[:, None] * start
        hit = np.flatnonzero(np.abs(total).sum(1))
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(total[hit].tolist(), pa.list_(pa.float64()))], names=["term", "v"])

    return run


def read_items(benchmark: DataFrame) -> list[tuple[int, list[str]]]:
    """The benchmark, which is small beside the corpus by its nature, in order of id and text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().orderBy("item_id", "text")
    return [(r["item_id"], words_of(r["text"])) for r in rows.toLocalIterator()]


def encode(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(doc_id, codes): each text as the term numbers of its words, kept as a checkpoint."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return saved(texts.mapInArrow(_encoded(docs.sparkSession.sparkContext.broadcast(vocab)), "doc_id long, codes binary"))


def fit(encoded: DataFrame, items: list[tuple[int, list[str]]], vocab: dict[str, int], rank: int = RANK, sample_docs: int | None = None) -> Space:
    """Counts document frequencies over all documents and fits the latent space on all of them.

    A caller may fit it on about ``sample_docs`` of them, by a hash. The
    randomised SVD multiplies a random start by A'A in two passes over all
    passages; partitions send their products by term, which Spark sums.
    What reaches the driver is terms x (rank + oversampling), as large as the
    benchmark's vocabulary and no larger for more documents: under 1 KB a term.
    """
    counts = encoded.select("codes").mapInArrow(_document_frequencies(len(vocab)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in counts}
    documents, passages = df.pop(-1, 0), df.pop(-2, 0)
    space = Space(items, vocab, df, documents)
    fitted = encoded.select("codes")
    if sample_docs is not None and sample_docs < documents:
        # by id and text, as many rows may share an id or have none
        share = sample_docs / documents
        fitted, passages = encoded.where(F.pmod(F.xxhash64("doc_id", "codes"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))).select("codes"), passages * share
    width = min(rank + OVERSAMPLE, len(space.vocab))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((len(space.vocab), width)))[0]
    values = np.ones(width)
    for _ in range(2):
        shared = encoded.sparkSession.sparkContext.broadcast((space, basis))
        parts = fitted.mapInArrow(_range_products(shared), "term int, v array<double>")
        columns = [f"x{j}" for j in range(width)]
        wide = parts.select("term", *[F.get("v", F.lit(j)).alias(c) for j, c in enumerate(columns)])
        sums = wide.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
        y = np.zeros(basis.shape)
        add_products(space, space.coded, basis, y)
        y *= max(1.0, passages / max(1, len(space.coded)))  # items weigh as much as the passages
        if sums.num_rows:
            y[sums["term"].to_numpy()] += np.column_stack([sums[c].to_numpy() for c in columns])
        basis, upper = np.linalg.qr(y)
        values = np.abs(np.linalg.svd(upper)[1])
        basis = basis @ np.linalg.svd(upper)[0]
    space.fix(basis[:, : min(rank, width)][:, values[: min(rank, width)] > 1e-9])
    return space


def vocabulary(items: list[tuple[int, list[str]]]) -> dict[str, int]:
    return {t: k for k, t in enumerate(sorted({t for _, w in items for t in w}))}


def contaminations(space: Space, codes: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
    """(text number, item number, LCS share, cosine) of the verified pairs, the best passage of each."""
    best: dict[tuple[int, int], tuple[float, float]] = {}
    for i, j in _portions(codes):
        _search(space, codes[i:j], i, best)
    return [(d, k, share, cos) for (d, k), (share, cos) in sorted(best.items())]


def _search(space: Space, codes: list[np.ndarray], first: int, best: dict) -> None:
    # blocks of each text, padded so that no block crosses a text
    counts = [max(1, -(-len(c) // BLOCK)) for c in codes]
    owner = np.repeat(np.arange(len(codes)), counts)
    begin = np.concatenate(([0], np.cumsum(counts)))
    flat = np.full(begin[-1] * BLOCK, -1, np.int32)
    for d, c in enumerate(codes):
        flat[begin[d] * BLOCK : begin[d] * BLOCK + len(c)] = c
    rank = space.basis.shape[1]
    low = np.zeros((begin[-1], rank), np.float32)
    live = np.flatnonzero(flat >= 0)
    block = live // BLOCK
    for i in range(0, len(live), _TOKENS // 4):
        j = min(len(live), i + _TOKENS // 4)
        cut = np.flatnonzero(np.concatenate(([True], block[i + 1 : j] != block[i : j - 1])))
        low[block[i:j][cut]] += np.add.reduceat(space.basis[flat[live[i:j]]], cut, axis=0)
    last = np.concatenate((owner[1:] != owner[:-1], [True]))
    pair = low.copy()
    pair[:-1][~last[:-1]] += low[1:][~last[:-1]]
    norm = np.sqrt((pair * pair).sum(1))
    pair /= np.maximum(norm, 1e-9)[:, None]
    near = []
    for i in range(0, len(space.vectors), _ITEMS):
        cos = pair @ space.vectors[i : i + _ITEMS].T
        b, k = np.nonzero(cos >= COSINE)
        near.append((b, k + i, cos[b, k]))
    blocks, found, cos = (np.concatenate(x) for x in zip(*near))
    by_block = np.lexsort((found, blocks))
    blocks, found, cos = blocks[by_block], found[by_block], cos[by_block]
    enough = _answered(space, flat, len(owner), blocks, found)
    for b, k, near_to in zip(blocks[enough].tolist(), found[enough].tolist(), cos[enough].tolist()):
        d = int(owner[b])
        c, item = codes[d], space.coded[k]
        if (first + d, int(k)) in best and best[first + d, int(k)][0] >= 1:
            continue
        # the passage, and as much to either side as the item may reach beyond it
        at = int(b - begin[d]) * BLOCK
        part = c[max(0, at - len(item)) : at + 2 * BLOCK + len(item)].tolist()
        present = set(part)
        answer = space.answers[k]
        if len(answer & present) < ANSWER_SHARE * len(answer):
            continue
        share = _best_share(item, part)
        if share >= LCS and share > best.get((first + d, int(k)), (0, 0))[0]:
            best[first + d, int(k)] = (share, near_to)


def _answered(space: Space, flat: np.ndarray, n: int, blocks: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which candidates (block, item) have as many occurrences of the item's answer terms around them as
    the check below needs different ones: a necessary condition, for all candidates at once."""
    live = np.flatnonzero(flat >= 0)
    first = space.asked_from[flat[live]]
    count = space.asked_from[flat[live] + 1] - first
    live, first, count = live[count > 0], first[count > 0], count[count > 0]
    each = np.repeat(np.arange(len(live)), count)
    item = space.asked[np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(each))] if len(each) else np.zeros(0, np.int64)
    place = np.sort(item * n + live[each] // BLOCK)
    reach = space.reach[found]
    low, high = np.maximum(blocks - reach, 0), np.minimum(blocks + 2 + reach, n - 1)
    inside = np.searchsorted(place, found * n + high, "right") - np.searchsorted(place, found * n + low)
    return inside >= space.need[found]


def _best_share(item: list[int], part: list[int]) -> float:
    """Largest LCS share over stretches of the passage little longer than the item."""
    span = len(item) + max(4, len(item) // 4)
    step = max(1, min(8, len(item) // 4))
    if lcs_length(item, part) < LCS * len(item):
        return 0.0
    return max(lcs_length(item, part[s : s + span]) for s in range(0, max(1, len(part) - span + step), step)) / len(item)


def contaminated(docs: DataFrame, benchmark: DataFrame, sample_docs: int | None = None) -> DataFrame:
    """One row per document row and benchmark item that it contains: doc_id, item_id, lcs, cosine.

    Null or empty texts and items match nothing. Repeated rows are found each;
    items that repeat an id or a text are found each; of passages of one text
    that share as much with an item the first counts. Texts of any length are
    searched whole. Other columns are not read; empty tables give an empty result.
    """
    items = read_items(benchmark)
    vocab = vocabulary(items)
    schema = "doc_id long, item_id long, lcs double, cosine double"
    if not vocab:
        return docs.sparkSession.createDataFrame([], schema)
    encoded = encode(docs, vocab)
    shared = docs.sparkSession.sparkContext.broadcast(fit(encoded, items, vocab, sample_docs=sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            got = contaminations(space, _arrays(b.column(1)))
            yield pa.record_batch(
                [pa.array([ids[d] for d, *_ in got], pa.int64()), pa.array([space.items[k][0] for _, k, *_ in got], pa.int64()), pa.array([s for *_, s, _ in got], pa.float64()), pa.array([c for *_, c in got], pa.float64())],
                names=["doc_id", "item_id", "lcs", "cosine"],
            )

    return encoded.mapInArrow(run, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, all columns kept; odd rows as by ``contaminated``, so null and empty texts stay."""
    items = read_items(benchmark)
    vocab = vocabulary(items)
    if not vocab:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(fit(encode(docs, vocab), items, vocab))

    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        space = shared.value
        coder = Coder(space.vocab)
        for texts in batches:
            found = {d for d, *_ in contaminations(space, [coder.codes(t) for t in texts])}
            yield pd.Series([i in found for i in range(len(texts))], dtype=bool)

    return docs.where(~leaks(F.col("text").cast("string")))
