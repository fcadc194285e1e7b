"""Language identification by prediction by partial matching.

A language's model is a tree of byte contexts up to ``ORDER`` bytes. A byte
seen in a context costs its frequency there; any other costs an escape and is
coded in the next shorter context (method C, no exclusions), down to a uniform
byte. Statistics are frozen after training and every context that training
saw is kept, so the code lengths are exact.

Counts of four-byte strings are all the statistics there are: Spark sums them
over the training rows, and shorter contexts follow from them. The tree is
stored as sorted strings with a bitmap of next bytes for each context, a few
dozen bytes a context whatever the number of languages; costs are kept for
blocks of languages, so that a language costs memory only for what its
neighbours in the block have seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of

#: At most so many documents and bytes of each language train its model, those with the smallest hash of id and text; longer texts than an eighth of the bytes are left out.
MAX_DOCS, MAX_BYTES = 300, 8 << 20
ORDER = 3
#: Languages whose costs are looked up together.
BLOCK = 8
_CHUNK = 1 << 18


@dataclass
class PpmModel:
    """For each language its distinct four-byte strings, as numbers in ascending order, and their counts."""

    langs: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]


def _order(grams: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of ``k`` bytes: strings of k + 1 bytes with their bits, and contexts with the bits of their escape."""
    keys, at = np.unique(grams & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    n = np.bincount(at, counts, len(keys))
    contexts, at = np.unique(keys >> 8, return_inverse=True)
    total, kinds = np.bincount(at, n), np.bincount(at)
    return keys, np.log2(total + kinds)[at] - np.log2(n), contexts, np.log2(total + kinds) - np.log2(kinds)


class _Known:
    """A set of strings of k + 1 bytes: the place of each, by its context's place and its last byte."""

    def __init__(self, keys: np.ndarray, context_of: np.ndarray):
        row, byte = context_of, (keys & 255).astype(np.uint64)
        words = np.zeros((int(row.max(initial=-1)) + 2, 4), np.uint64)
        np.bitwise_or.at(words, (row, (byte >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (byte & np.uint64(63)))
        self.words = words.ravel()
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.int32)

    def find(self, row: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Places, -1 for unknown strings; ``row`` -1 is the empty last row."""
        at = np.where(row < 0, len(self.words) // 4 - 1, row) * 4 + (byte >> 6)
        word, bit = self.words[at], np.uint64(1) << (byte & 63).astype(np.uint64)
        place = self.first[at] + np.bitwise_count(word & (bit - np.uint64(1)))
        return np.where(word & bit, place, -1)


class Tables:
    """Costs of a block of languages: by order, the known strings, their costs (nan: not seen by this language) and escapes."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], counts: list[np.ndarray]):
        self.langs, n = langs, len(langs)
        orders = [[_order(g, c, k) for g, c in zip(grams, counts)] for k in range(ORDER + 1)]
        # after one byte: every pair, escapes and the uniform byte included; an unseen context costs no escape
        pairs = np.zeros((1 << 16, n))
        for j in range(n):
            keys, bits, _, escape = orders[0][j]
            single = np.full(256, escape[0] + 8.0)
            single[keys] = bits
            keys, bits, contexts, escape = orders[1][j]
            table = np.tile(single, (256, 1))
            table[contexts] += escape[:, None]
            table.ravel()[keys] = bits
            pairs[:, j] = table.ravel()
        self.pairs = pairs.astype(np.float32)
        # after two bytes
        two = np.unique(np.concatenate([o[2] for o in orders[2]]))
        self.row_of_two = np.full(1 << 16, -1, np.int64)
        self.row_of_two[two] = np.arange(len(two))
        self.escape_two = self._spread(two, [(o[2], o[3]) for o in orders[2]], 0.0, spare=True)
        # the contexts of three bytes need a place, too; their first two bytes are a context, as a byte followed these
        short = np.unique(np.concatenate([o[0] for o in orders[2]] + [o[2] for o in orders[3]]))
        self.threes = _Known(short, self.row_of_two[short >> 8])
        seen = self._spread(short, [(o[0], o[1]) for o in orders[2]], np.nan)
        lower = self.pairs[short & 0xFFFF] + self.escape_two[self.row_of_two[short >> 8]]
        self.short = np.where(np.isnan(seen), lower, seen).astype(np.float32)
        # after three bytes; the row of a context is its place among the strings of three bytes
        self.escape_three = self._spread(short, [(o[2], o[3]) for o in orders[3]], 0.0, spare=True)
        long = np.unique(np.concatenate([o[0] for o in orders[3]]))
        place = np.searchsorted(short, long >> 8)
        self.fours = _Known(long, place)
        seen = self._spread(long, [(o[0], o[1]) for o in orders[3]], np.nan)
        self.long = np.where(np.isnan(seen), self._after_two(long & 0xFFFFFF) + self.escape_three[place], seen).astype(np.float32)

    def _spread(self, keys: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], missing: float, spare: bool = False) -> np.ndarray:
        """(keys, languages) of each language's values; ``spare`` adds a last row of ``missing`` for place -1."""
        out = np.full((len(keys) + spare, len(parts)), missing, np.float32)
        for j, (own, values) in enumerate(parts):
            out[np.searchsorted(keys, own), j] = values
        return out

    def place_of_three(self, tri: np.ndarray) -> np.ndarray:
        return self.threes.find(self.row_of_two[tri >> 8], tri & 255)

    def _after_two(self, tri: np.ndarray) -> np.ndarray:
        """Costs of the last of three bytes after the two before."""
        place = self.place_of_three(tri)
        cost = self.short[place]
        new = place < 0
        cost[new] = self.pairs[tri[new] & 0xFFFF] + self.escape_two[self.row_of_two[tri[new] >> 8]]
        return cost

    def costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits by text and language. data: the texts' bytes, each after three zero bytes; starts: where each begins."""
        out = np.zeros((len(starts), len(self.langs)))
        ends = np.append(starts[1:], len(data))
        for i in range(0, len(data), _CHUNK):
            j = min(len(data), i + _CHUNK)
            d = data[max(0, i - ORDER) : j].astype(np.int64)
            pad = i - max(0, i - ORDER)
            d = np.concatenate((np.zeros(ORDER - pad, np.int64), d))  # d[k + ORDER] is byte i + k
            tri = (d[1:-2] << 16 | d[2:-1] << 8 | d[3:]) if len(d) > ORDER else np.zeros(0, np.int64)
            prior = d[:-3] << 16 | d[1:-2] << 8 | d[2:-1]
            row = self.place_of_three(prior)
            deep = self.fours.find(row, d[3:])
            cost = self.long[deep]
            new = np.flatnonzero(deep < 0)
            cost[new] = self._after_two(tri[new]) + self.escape_three[row[new]]
            first, last = np.searchsorted(ends, i, "right"), np.searchsorted(starts, j, "left")
            sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(cost, axis=0, dtype=np.float64)))
            lo = np.clip(starts[first:last] + ORDER, i, j) - i
            hi = np.clip(ends[first:last], i, j) - i
            out[first:last] += sums[np.maximum(lo, hi)] - sums[lo]
        return out


class Predictor:
    """All languages of a model."""

    def __init__(self, model: PpmModel):
        self.langs = model.langs
        n = len(model.langs)
        self.blocks = [Tables(model.langs[i : i + BLOCK], model.grams[i : i + BLOCK], model.counts[i : i + BLOCK]) for i in range(0, n, BLOCK)]

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Exact bits by text and language."""
        pad = b"\0" * ORDER
        parts = [pad + (t or "").encode("utf-8", "surrogatepass") for t in texts]
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        return np.hstack([b.costs(data, starts) for b in self.blocks])


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte strings that end at each byte of the texts, zero bytes before the first, and their counts."""
    parts = [b"\0" * ORDER + t.encode("utf-8", "surrogatepass") for t in texts if t]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    real = np.ones(len(data), bool)
    at = 0
    for p in parts:
        real[at : at + ORDER] = False
        at += len(p)
    end = np.flatnonzero(real)
    return np.unique(data[end - 3] << 24 | data[end - 2] << 16 | data[end - 1] << 8 | data[end], return_counts=True)


def train(by_lang: dict[str, list[str]]) -> PpmModel | None:
    """A model of texts at hand; ``learn`` makes one of a table."""
    counted = {k: gram_counts(v) for k, v in sorted(by_lang.items())}
    kept = {k: x for k, x in counted.items() if len(x[0])}
    return PpmModel(list(kept), [g for g, _ in kept.values()], [n for _, n in kept.values()]) if kept else None


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, part in texts.items():
            grams, n = gram_counts(part)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def learn(docs: DataFrame, max_docs: int = MAX_DOCS) -> PpmModel | None:
    """A model of the rows outside fold 1 with a language and a text.

    At most ``max_docs`` a language are taken, of MAX_BYTES together, repeated
    texts once: a hash of id and text takes about twice as many, of which those
    with the smallest hash stay. Spark counts their four-byte strings; the counts
    alone reach the driver.
    """
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null")
    usable = usable.where(fold_of(F.col("doc_id")) != 1)
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * max_docs / n))])[F.col("lang")]
    draw = F.xxhash64("doc_id", "text")
    drawn = usable.where(F.octet_length("text") <= MAX_BYTES // 8).withColumn("draw", draw).where(F.pmod("draw", F.lit(1 << 20)) < share * F.lit(1 << 20))
    each = drawn.groupBy("lang", "text").agg(F.min("draw").alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "text")  # some 600 short texts a language
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sample = each.withColumn("i", F.row_number().over(order)).withColumn("upto", upto).where((F.col("i") <= max_docs) & (F.col("upto") <= MAX_BYTES)).select("lang", "text")
    sample = sample.repartition("lang")  # counted in one task a language, each string is one row
    got = sample.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).orderBy("lang", "gram").toArrow()
    langs, grams, counts = got["lang"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy()
    known = sorted(set(langs))
    if not known:
        return None
    return PpmModel(known, [grams[langs == k] for k in known], [counts[langs == k] for k in known])


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or (Predictor(PpmModel(**shared.value)) if shared.value else None)
            texts = b.column(1).to_pylist()
            lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            todo = [i for i, ok in enumerate(lettered) if ok] if model else []
            i = 0
            while i < len(todo):  # about a million characters at a time
                j, n = i, 0
                while j < len(todo) and (j == i or n < 1 << 20):
                    n += len(texts[todo[j]])
                    j += 1
                bits = model.code_lengths([texts[k] for k in todo[i:j]])
                best = bits.argmin(1)
                rel = np.exp2(-(bits - bits.min(1, keepdims=True)))
                p = 1 / rel.sum(1)
                for k, w, s in zip(todo[i:j], best.tolist(), p.tolist()):
                    langs[k], scores[k] = model.langs[w], s
                i = j
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``score`` is the posterior of the language under equal priors. Texts that
    are null or have no letter, and all texts where no language could be
    learned, are ``und`` with score 0. Of languages with equal code lengths the
    first by name wins. A text of any length is coded whole, in chunks; equal
    rows get equal answers; other columns are not read; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model) if (model := learn(docs, max_docs)) else None)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
