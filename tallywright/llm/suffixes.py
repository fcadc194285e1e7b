"""Repeated byte strings by suffix order and longest-previous-factor arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it starts earlier as
well. Suffixes of the whole corpus can't be sorted in one place, so those that
can share ``WINDOW`` bytes are brought together first. The anchor of a window is
the least of its ``GRAM``-byte hashes, the leftmost of equal ones: equal windows
have equal anchors at equal places. The windows of one anchor follow each other;
such a run with its bytes is a context, about one for 37 bytes.

1. Of equal contexts all but the first go, within each block of documents and
   then over all, in the order of (anchor, context, place): a global sort by
   ranges, so that no anchor or context is too large for it.
2. What is left of an anchor, different contexts, can only share a window if
   they share ``SIDE`` bytes before or after the anchor; the others drop out.
3. The bytes of the remaining contexts meet by anchor. Their suffixes are
   sorted; the previous and the next smaller place in suffix order give the
   longest previous factor of each, and where it reaches ``WINDOW`` the window
   goes. Anchors with too many contexts for one suffix array are taken window
   by window, by the least place of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, saved

WINDOW = 100
GRAM = 28
SIDE = 36
#: Bytes that are taken at once; of a longer text so many at a time.
BLOCK = 1 << 20
#: Contexts of an anchor that may share one suffix array, and bytes of a suffix array after which no more anchors are added.
GROUP = 8192
TEXT = 1 << 20

_REACH = WINDOW - GRAM
_RNG = np.random.default_rng(12)
_LETTERS = _RNG.integers(0, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) * 2 + 1 for x in _RNG.integers(1 << 61, 1 << 62, 2)]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)
_POWERS: dict[tuple[int, int], np.ndarray] = {}

_KEY = ["doc", "tie"]
_RUNS = "doc long, tie long, start long, size long, anchor long, context long, sides long"


def _powers(which: int, sign: int, n: int) -> np.ndarray:
    """Powers of a hash's base, or of its inverse."""
    have = _POWERS.get((which, sign))
    if have is None or len(have) < n:
        base = pow(_BASES[which], sign, 1 << 64)
        have = np.full(n, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[which, sign] = have
    return have[:n]


class Hashes:
    """Polynomial hashes of any stretches of a block of bytes."""

    def __init__(self, data: np.ndarray, which: int):
        self.which, self.n = which, len(data)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTERS[which][data] * _powers(which, 1, self.n))))

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * _powers(self.which, -1, self.n + 1)[start]

    def grams(self, k: int) -> np.ndarray:
        return (self.sums[k:] - self.sums[:-k]) * _powers(self.which, -1, self.n + 1)[: self.n - k + 1]


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor: piece, start and size, and hashes of anchor, context and sides.

    Pieces of documents lie end to end in ``data``: windows start from
    ``first`` to before ``last``; bytes from ``low`` to ``high`` are the document's.
    """
    empty = {k: np.empty(0, np.int64) for k in ("piece", "start", "size")} | {k: np.empty(0, np.uint64) for k in ("anchor", "context", "sides")}
    ok = last > first
    marks = np.bincount(first[ok], minlength=len(data) + 1) - np.bincount(last[ok], minlength=len(data) + 1)
    at = np.flatnonzero(np.cumsum(marks))
    if not len(at):
        return empty
    one, two = Hashes(data, 0), Hashes(data, 1)
    grams = one.grams(GRAM)
    keyed = ((grams ^ (grams >> np.uint64(31))) * _MIX & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least(keyed, _REACH + 1)[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    start, a = at[new], anchor[new]
    end = np.append(at[new[1:] - 1], at[-1])
    piece = np.searchsorted(first[ok], start, side="right") - 1
    piece = np.flatnonzero(ok)[piece]
    size = end - start + 1
    shape = (size.astype(np.uint64) * np.uint64(WINDOW + 1) + (a - start).astype(np.uint64)) * _MIX
    context = two.of(start, end + WINDOW) + shape
    before, after = a - SIDE, a + GRAM + SIDE
    left = np.where(before >= low[piece], two.of(np.maximum(before, 0), a) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    right = np.where(after <= high[piece], two.of(a + GRAM, np.minimum(after, len(data))) >> np.uint64(32) | np.uint64(1), np.uint64(0))
    return {"piece": piece, "start": start, "size": size, "anchor": grams[a], "context": context, "sides": left << np.uint64(32) | right}


def _pieces(rows: list[tuple[int | None, int, bytes]]) -> Iterator[list[tuple[int | None, int, bytes, int, int]]]:
    """Blocks of (doc, tie, text, from, to): windows that start there; a long text comes in several blocks."""
    block, size = [], 0
    for doc, tie, text in rows:
        for s in range(0, max(len(text) - WINDOW + 1, 0), BLOCK):
            e = min(s + BLOCK, len(text) - WINDOW + 1)
            if size and size + e - s > BLOCK:
                yield block
                block, size = [], 0
            block.append((doc, tie, text, s, e))
            size += e - s + WINDOW
    if block:
        yield block


def _batch(doc, tie, start, size, anchor=None, context=None, sides=None, **more) -> pa.RecordBatch:
    none = pa.nulls(len(tie), pa.int64())
    hashed = [none if x is None else pa.array(x.view(np.int64)) for x in (anchor, context, sides)]
    return pa.record_batch([doc, pa.array(tie), pa.array(start, pa.int64()), pa.array(size, pa.int64()), *hashed, *more.values()], names=["doc", "tie", "start", "size", "anchor", "context", "sides", *more])


def _merged(piece: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of a piece as one: the piece, the first byte and the number of bytes that their windows cover."""
    if not len(piece):
        return piece, start, size
    new = np.flatnonzero(np.append(True, (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + size[:-1])))
    last = np.append(new[1:] - 1, len(piece) - 1)
    return piece[new], start[new], start[last] + size[last] - 1 + WINDOW - start[new]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that are the first of their context in a block of documents; with no anchor, stretches of bytes that go."""
    for batch in batches:
        given = dict.fromkeys(zip(*(batch.column(i).to_pylist() for i in range(3))))  # rows alike in id and text are one document
        for block in _pieces(sorted(given, key=lambda r: (r[0] is None, r[0] or 0, r[1]))):
            spans = [(max(s - SIDE, 0), min(e + WINDOW - 1 + SIDE, len(t))) for _, _, t, s, e in block]
            data = np.frombuffer(b"".join(t[a:b] for (_, _, t, _, _), (a, b) in zip(block, spans)), np.uint8)
            base = np.concatenate(([0], np.cumsum([b - a for a, b in spans])))
            off = np.array([a for a, _ in spans])
            first, last = (np.array([x[i] for x in block]) - off + base[:-1] for i in (3, 4))
            r = runs(data, first, last, base[:-1], base[1:])
            kept = np.zeros(len(r["start"]), bool)
            kept[np.unique(r["anchor"] * _MIX ^ r["context"], return_index=True)[1]] = True
            docs, ties = pa.array([x[0] for x in block], pa.int64()), np.array([x[1] for x in block], np.int64)
            place = lambda piece, start: start - base[piece] + off[piece]  # noqa: E731, B023
            p = r["piece"][kept]
            yield _batch(docs.take(pa.array(p)), ties[p], place(p, r["start"][kept]), r["size"][kept], *(r[k][kept] for k in ("anchor", "context", "sides")))
            p, start, size = _merged(*(r[k][~kept] for k in ("piece", "start", "size")))
            yield _batch(docs.take(pa.array(p)), ties[p], place(p, start), size)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def _twice(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same side; 0 is no side."""
    both = (group.astype(np.uint64) << np.uint64(32)) | side
    _, at, n = np.unique(both, return_inverse=True, return_counts=True)
    return (n[at] > 1) & (side != 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in the order of (anchor, context, place): stretches that go, and contexts that may share a window with another.

    An anchor whose rows may go on in a neighbouring partition, or are more
    than GROUP, keeps all its contexts.
    """
    names = ["doc", "tie", "start", "size", "anchor", "context", "sides"]
    rest, before, whole = None, None, []  # rows of the last anchor; (anchor, context, place of its first run) of the row before them; anchors that keep all

    def settle(table: pa.Table, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        nonlocal before
        doc, tie, start, size, anchor, context, sides = (_numbers(table.column(c).combine_chunks()) for c in names)
        none = table.column("doc").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1]))
        place = lambda i: (bool(none[i]), int(doc[i]), int(tie[i]), int(start[i]))
        new[0] = before is None or before[:2] != (int(anchor[0]), int(context[0]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        again = np.zeros(len(new), bool)  # a repeated row of the context's first run
        in_sight = lead >= 0
        again[in_sight] = [(none[i] == none[j]) & (doc[i] == doc[j]) & (tie[i] == tie[j]) & (start[i] == start[j]) for i, j in ((np.flatnonzero(in_sight), lead[in_sight]),)][0]
        for i in np.flatnonzero(~in_sight):
            again[i] = place(i) == before[2]
        gone = np.flatnonzero(~new & ~again)
        firsts = np.flatnonzero(new)
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))[firsts]
        s = sides[firsts].view(np.uint64)
        may = keep[firsts] | _twice(group, s >> np.uint64(32)) | _twice(group, s & np.uint64((1 << 32) - 1))
        i = len(new) - 1
        before = (int(anchor[i]), int(context[i]), place(lead[i]) if lead[i] >= 0 else before[2])
        for rows, found in ((gone, False), (firsts[may], True)):
            d = table.column("doc").combine_chunks().take(pa.array(rows))
            yield _batch(d, tie[rows], start[rows], size[rows], anchor[rows], context[rows], sides[rows]) if found else _batch(d, tie[rows], start[rows], size[rows] - 1 + WINDOW)

    begun = None  # the partition's first anchor
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        anchor = _numbers(table.column("anchor").combine_chunks())
        begun = int(anchor[0]) if begun is None else begun
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if len(anchor) - cut > GROUP:
            whole, cut = [*whole[-1:], int(anchor[-1])], len(anchor)
        rest = table.slice(cut) if cut < len(anchor) else None
        if cut:
            yield from settle(table.slice(0, cut), np.isin(anchor[:cut], [begun, *whole]))
    if rest is not None:
        yield from settle(rest, np.ones(len(rest), bool))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, tie, start, bytes) of the runs listed beside each text."""
    for batch in batches:
        out = [(r["anchor"], doc, tie, r["start"], text[r["start"] : r["start"] + r["size"] - 1 + WINDOW]) for doc, tie, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))) for r in found]
        for i in range(0, len(out), 1 << 14):
            cols = list(zip(*out[i : i + (1 << 14)]))
            yield pa.record_batch([pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(cols)], names=["anchor", "doc", "tie", "start", "bytes"])


def _smaller(place: np.ndarray, step: int) -> np.ndarray:
    """For each element the nearest one in direction ``step`` with a smaller place, or -1: every round jumps over what is known to be larger."""
    n = len(place)
    at = np.arange(n) + step
    at[at == n] = -1
    while True:
        far = np.flatnonzero((at >= 0) & (place[at] >= place))
        if not len(far):
            return at
        at[far] = at[at[far]]


def longest_previous_factors(text: np.ndarray, starts: np.ndarray, place: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """For suffixes of ``text`` cut at ``most`` bytes: how many bytes the suffix shares with one of a smaller place, at most.

    ``text`` has ``most`` bytes from each start. Ranks of stretches of 8, 16,
    32, ... bytes order the suffixes and give common lengths; in suffix order,
    equal ones by place, only the nearest smaller places on both sides count.
    """
    data = np.concatenate((text, np.zeros(2 * most + 16, np.uint8))).astype(np.uint64)
    eight = np.zeros(len(data) - 8, np.uint64)
    for i in range(8):
        eight = eight << np.uint64(8) | data[i : len(eight) + i]
    ranks, width = {8: np.unique(eight, return_inverse=True)[1].astype(np.int64)}, 8
    while width * 2 <= most:
        r = ranks[width]
        ranks[width * 2] = np.unique(r[:-width] * (len(r) + 1) + r[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    top = ranks[width]
    order = np.lexsort((place, top[starts + most - width], top[starts]))
    at, out = starts[order], np.zeros(len(starts), np.int64)
    views = [(w, ranks[w]) for w in sorted(ranks, reverse=True)] + [(w, eight >> np.uint64(64 - 8 * w)) for w in (4, 2, 1)]
    for step in (-1, 1):
        other = _smaller(place[order], step)
        known = np.flatnonzero(other >= 0)
        a, b, common = at[known], at[other[known]], np.zeros(len(known), np.int64)
        for w, r in views:
            common += w * ((common + w <= most) & (r[a + common] == r[b + common]))
        out[order[known]] = np.maximum(out[order[known]], common)
    return out


def _windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts that lie end to end: each window's context, its place there, and its place in the text."""
    n = np.maximum(lengths - WINDOW + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return which, inside, inside + (np.cumsum(lengths) - lengths)[which]


def _columns(table: pa.Table) -> tuple:
    one = lambda c: table.column(c).combine_chunks()
    data = one("bytes")
    lengths = pa.compute.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    return one("doc"), _numbers(one("doc")), one("doc").is_null().to_numpy(zero_copy_only=False), _numbers(one("tie")), _numbers(one("start")), lengths, np.frombuffer(b"".join(data.to_pylist()), np.uint8)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows whose longest previous factor is a whole window; rows come by anchor."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        docs, doc, none, tie, start, lengths, text = _columns(table)
        which, inside, at = _windows(lengths)
        _, place = np.unique(np.stack([none[which], doc[which], tie[which], start[which] + inside]), axis=1, return_inverse=True)
        gone = longest_previous_factors(text, at, place.reshape(-1)) >= WINDOW
        p, s, size = _merged(which[gone], inside[gone], np.ones(int(gone.sum()), np.int64))
        return pa.record_batch([docs.take(pa.array(p)), pa.array(tie[p]), pa.array(start[p] + s), pa.array(size, pa.int64())], names=["doc", "tie", "start", "size"])

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rest = pa.concat_tables([rest, pa.Table.from_batches([batch])]) if rest is not None else pa.Table.from_batches([batch])
        while rest.num_rows and rest.column("bytes").nbytes > TEXT:
            anchor = _numbers(rest.column("anchor").combine_chunks())
            bounds = np.append(np.flatnonzero(np.diff(anchor)) + 1, [])
            if not len(bounds):
                break
            size = np.cumsum(pa.compute.binary_length(rest.column("bytes").combine_chunks()).to_numpy(zero_copy_only=False))
            cut = int(bounds[min(len(bounds) - 1, np.searchsorted(size[bounds.astype(np.int64) - 1], TEXT))])
            yield settle(rest.slice(0, cut))
            rest = rest.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield settle(rest)


def _each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            docs, _, _, tie, start, lengths, text = _columns(pa.Table.from_batches([batch.slice(i, 256)]))
            which, inside, at = _windows(lengths)
            data = text.tobytes()
            yield pa.record_batch([docs.take(pa.array(which)), pa.array(tie[which]), pa.array(start[which] + inside), pa.array([data[a : a + WINDOW] for a in at.tolist()], pa.binary())], names=["doc", "tie", "start", "bytes"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            upto, removed, spans, parts = 0, 0, 0, []
            end = -1  # of the last removed run; a gap of no bytes is no gap
            for s, e in sorted((r["start"], r["start"] + r["size"]) for r in found or ()):
                if s > end:
                    spans += 1
                    parts.append(text[max(end, 0) : s])
                    removed += e - s
                    end = e
                elif e > end:
                    removed += e - end
                    end = e
            parts.append(text[max(end, 0) :])
            out.append((doc, len(text), removed, spans, hashlib.sha256(b"".join(parts)).hexdigest()))
        cols = list(zip(*out)) or [[]] * 5
        yield pa.record_batch([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _same(a: str, b: str):
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.tie") == F.col(f"{b}.tie"))


def repeated_stretches(texts: DataFrame) -> DataFrame:
    """(doc, tie, start, size): stretches of bytes to remove, which may overlap, of texts (doc, tie, text)."""
    first = Stored(texts.mapInArrow(_runs, _RUNS))
    order = [F.col("anchor"), F.col("context"), F.col("doc").asc_nulls_last(), F.col("tie"), F.col("start")]
    ranged = first.df.where("anchor is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    found = Stored(ranged.mapInArrow(_groups, _RUNS))
    left = found.df.where("anchor is not null")
    listed = left.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "start", "size")).alias("found"))
    near = texts.alias("t").join(listed.alias("l"), _same("t", "l")).select("t.doc", "t.tie", "t.text", "l.found")
    contexts = Stored(near.mapInArrow(_contexts, "anchor long, doc long, tie long, start long, bytes binary"))
    many = saved(left.groupBy("anchor").count().where(F.col("count") > GROUP).select("anchor"))
    few = contexts.df.join(many, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    removed = few.mapInArrow(_repeats, "doc long, tie long, start long, size long")
    removed = removed.unionByName(first.df.where("anchor is null").select(removed.columns)).unionByName(found.df.where("anchor is null").select(removed.columns))
    if not many.isEmpty():
        each = contexts.df.join(many, "anchor", "left_semi").select("doc", "tie", "start", "bytes").mapInArrow(_each_window, "doc long, tie long, start long, bytes binary")
        place = F.struct(F.col("doc").isNull().alias("none"), "doc", "tie", "start")
        least_place = each.groupBy("bytes").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("n")).where("n > 1")
        removed = removed.unionByName(each.join(least_place, "bytes").where(place > F.col("p")).select("doc", "tie", "start", F.lit(WINDOW).cast("long").alias("size")))
    out = Stored(removed)
    for table in (first, found, contexts):
        table.remove()
    return out.df


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty. Documents come in the order of their ids, null
    ids last; those that share an id in the order of a hash of their texts; rows
    alike in id and text are one document and get one result each. A text of any
    length is read whole, other columns are not read, an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("tie"), text.cast("binary").alias("text"))
    gone = repeated_stretches(texts).groupBy(*_KEY).agg(F.collect_list(F.struct("start", "size")).alias("gone"))
    both = texts.alias("t").join(gone.alias("g"), _same("t", "g"), "left").select("t.doc", "t.text", "g.gone")
    return both.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
