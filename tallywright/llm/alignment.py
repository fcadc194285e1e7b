"""Alignment of two tokenizers over the same bytes.

Both tokenizers encode each text; the tokens of a whole Arrow batch lie end to
end, so the running sum of their byte lengths is their place in the batch. The
ends of A and of B are counted once each by byte; where both occur the tokens
are cut into groups, and between two neighbouring ends of either kind one A and
one B token overlap, which makes one link. Prefix sums at the documents'
boundaries give what belongs to each document.

Links are counted over the whole corpus by id pair. Pairs with more than a
2^-20th of all links, fewer than 2^20 of them, are broadcast with their counts;
links of other pairs are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, saved

FOLDER = "/opt/tokenizers"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair is frequent if it has more than this share of the links.
FREQUENT = 1 / (1 << 20)
#: Bytes of text that are aligned at once; a longer text is a block of its own. A token takes some 200 bytes meanwhile.
BLOCK = 1 << 18
#: Links that are looked up or counted at once.
LINKS = 1 << 20


#: Fixed value: how the byte-level vocabulary splits text before it merges.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Ids of texts, and the bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.said = {sep: np.array([f"{sep}{i}" for i in range(len(pieces))], object) for sep in ",;|"}

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class ByteLevel(Tokenizer):
    """A byte-level BPE file of the ``tokenizers`` library; strings of special tokens are plain text.

    The file's vocabulary is in the order of its merges, so ids are ranks, and
    ``tiktoken`` encodes with them in a quarter of the time and memory. What it
    can't split, such as a run of millions of equal characters, goes to the
    file's own library.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        tokens = sorted(vocabulary, key=vocabulary.get)
        super().__init__([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in tokens])
        special = "<|endoftext|>".encode()
        self.path = path
        self.file = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={p: i for i, p in enumerate(self.pieces) if p != special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(" " + t) for t in texts]

    def _one(self, text: str) -> list[int]:
        try:
            return self.file.encode_ordinary(text)
        except BaseException as e:  # a panic of the library is no Exception
            if type(e).__name__ != "PanicException" and not isinstance(e, (ValueError, RuntimeError)):
                raise
            return self.slow().encode(text, add_special_tokens=False).ids

    @cache  # noqa: B019
    def slow(self):
        from tokenizers import Tokenizer as File

        file = File.from_file(self.path)
        file.encode_special_tokens = True
        return file


class Pieces(Tokenizer):
    """A ``sentencepiece`` model, which puts a space before each text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.file = SentencePieceProcessor(model_file=path)
        known = (self.file.id_to_piece(i) for i in range(self.file.get_piece_size()))
        super().__init__([bytes([int(p[3:5], 16)]) if self.file.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(known)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.file.encode(texts, num_threads=1)


@cache
def tokenizers(folder: str) -> tuple[Tokenizer, Tokenizer]:
    return ByteLevel(f"{folder}/{A}"), Pieces(f"{folder}/{B}")


def align(a: Tokenizer, b: Tokenizer, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """For a batch of texts: (documents x (n_a, n_b, n_groups, n_links)), their group digests, all links, and the links' bounds by document."""
    given = [t or "" for t in texts]
    # text that is not valid Unicode has no tokens
    whole = [(" " + t).encode("utf-8", "ignore") if t else b"" for t in given]
    given = [t if w and w.decode() == " " + t else "" for t, w in zip(given, whole)]
    ids_a, ids_b = a.encode(given), b.encode(given)
    for i, (t, w) in enumerate(zip(given, whole)):
        if not t or a.joined(ids_a[i]) != w or b.joined(ids_b[i]) != w:
            ids_a[i] = ids_b[i] = []
    n_a, n_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
    x, y = (np.fromiter(chain.from_iterable(ids), np.int64, n.sum()) for ids, n in ((ids_a, n_a), (ids_b, n_b)))
    end_a, end_b = a.lengths[x].cumsum(), b.lengths[y].cumsum()
    size = int(end_a[-1]) + 1 if len(end_a) else 1
    at_a, at_b = np.bincount(end_a, minlength=size), np.bincount(end_b, minlength=size)
    cut = (at_a > 0) & (at_b > 0)
    ends = np.flatnonzero(at_a + at_b)  # a link ends at each
    before_a, before_b, before_cut = at_a.cumsum(), at_b.cumsum(), cut.cumsum()
    links = x[before_a[ends - 1]] * len(b.pieces) + y[before_b[ends - 1]] if len(ends) else np.empty(0, np.int64)
    # documents' bounds in bytes, then in tokens, groups and links
    bounds_a, bounds_b = np.concatenate(([0], n_a.cumsum())), np.concatenate(([0], n_b.cumsum()))
    upto = np.concatenate(([0], end_a))[bounds_a]
    groups = before_cut[upto]
    bounds = np.searchsorted(ends, upto, side="right")
    counts = np.stack([n_a, n_b, np.diff(groups), np.diff(bounds)], 1)
    # group and place of each token, A's before B's within a group
    group_a, group_b = before_cut[end_a - 1], before_cut[end_b - 1]
    place_a = np.arange(len(x)) + np.searchsorted(group_b, group_a, side="left")
    place_b = np.arange(len(y)) + np.searchsorted(group_a, group_b, side="right")
    said = np.empty(len(x) + len(y), object)
    first_a, first_b = np.diff(group_a, prepend=-1) != 0, np.diff(group_b, prepend=-1) != 0
    said[place_a] = np.where(first_a, a.said[";"][x], a.said[","][x])
    said[place_b] = np.where(first_b, b.said["|"][y], b.said[","][y])
    starts = (bounds_a + bounds_b).tolist()
    digests = [hashlib.sha256("".join(said[s:e].tolist())[1:].encode()).hexdigest() if e > s else "" for s, e in zip(starts, starts[1:])]
    return counts, digests, links, bounds


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > BLOCK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _pair_kind(folder: str) -> str:
    a, b = tokenizers(folder)
    return "int" if len(a.pieces) * len(b.pieces) < 1 << 31 else "long"


def _aligned(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizers(folder)
        kind = pa.int32() if _pair_kind(folder) == "int" else pa.int64()
        for batch in batches:
            for s, e in _blocks(batch.column(1)):
                counts, digests, links, bounds = align(a, b, batch.column(1).slice(s, e - s).to_pylist())
                cols = [pa.array(counts[:, i], pa.int64()) for i in range(4)]
                linked = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(links, kind))
                yield pa.record_batch([batch.column(0).slice(s, e - s), *cols, pa.array(digests, pa.string()), linked], names=["doc_id", *_COUNTS, "groups_sha256", "links"])

    return run


def aligned(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links) of each row; a link is A's id times B's number of ids, plus B's id."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_aligned(folder), f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<{_pair_kind(folder)}>")


#: Pairs that a task keeps before it passes their counts on.
KEPT = 1 << 20


def _parts(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The lists of a column in parts of about LINKS values: first row, end, values, and bounds of the rows within them."""
    bounds = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    s = 0
    while s < len(column):
        e = max(s + 1, int(np.searchsorted(bounds, bounds[s] + LINKS, side="right")) - 1)
        yield s, e, column.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).astype(np.int64), bounds[s : e + 1] - bounds[s]
        s = e


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): counts of the batches' links, several of a pair for a task if it meets many pairs."""
    pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        for _, _, links, _ in _parts(batch.column(0)):
            got, k = np.unique(links, return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, got]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, k]), len(pairs)).astype(np.int64)
            if len(pairs) > KEPT:
                yield pa.record_batch([pa.array(pairs), pa.array(n)], names=["pair", "n"])
                pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
    yield pa.record_batch([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def _scored(table):
    """Adds up what frequent pairs give to each document; the links of other pairs stay as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = table.value
        pairs, n, best = np.append(pairs, -1), np.append(n, 0), np.append(best, False)  # the last stands for none
        for batch in batches:
            for s, e, links, bounds in _parts(batch.column(1)):
                at = np.searchsorted(pairs[:-1], links)
                at[pairs[at] != links] = len(pairs) - 1
                rare = at == len(pairs) - 1
                tops, sums, upto = (np.concatenate(([0], np.cumsum(v)))[bounds] for v in (best[at], n[at], rare))
                rest = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(links[rare]))
                yield pa.record_batch([batch.column(0).slice(s, e - s), pa.array(np.diff(tops), pa.int64()), pa.array(np.diff(sums), pa.int64()), rest], names=["at", "tops", "sums", "rest"])

    return run


def alignments(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either tokenizer does not give back
    byte for byte, have zeros and an empty digest. Repeated rows are rows of
    their own and count in the corpus. Ids may be null. Pairs that tie for a B
    id's highest count are all best. A text is encoded whole, however long;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = Stored(aligned(docs, folder).withColumn("at", F.monotonically_increasing_id())).df
    counts = saved(rows.select("links").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    id_b = F.col("pair") % len(tokenizers(folder)[1].pieces)
    tops = counts.groupBy(id_b.alias("b")).agg(F.max("n").alias("most"))
    table = saved(counts.join(tops, id_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    often = F.col("n") > F.lit(total * FREQUENT)
    frequent = table.where(often).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("pair", "n", "best")))
    scored = saved(rows.select("at", "links").mapInArrow(_scored(shared), "at long, tops long, sums long, rest array<long>"))
    rare = scored.select("at", F.explode("rest").alias("pair")).join(table.where(~often), "pair")
    rare = rare.groupBy("at").agg(F.count_if("best").alias("more_tops"), F.sum("n").alias("more_sums"))
    found = scored.drop("rest").join(rare, "at", "left")
    of = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).cast("long")
    out = rows.drop("links").join(found, "at")
    return out.select("doc_id", *_COUNTS, of("tops", F.col("more_tops")).alias("n_best"), of("sums", F.col("more_sums")).alias("count_sum"), "groups_sha256")
