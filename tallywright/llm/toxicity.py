"""Toxic spans by a linear-chain conditional random field.

Labels are by document, so token tags are derived first: a token of a toxic
document is tagged when one of its features (the word, its beginnings and
endings) is significantly bound to toxic documents. A two-state chain CRF is
fitted to these tags, by tasks over all labelled documents. Forward-backward marginals of each whole text are summed
up to a document score, calibrated by logistic regression, and to offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, fold_of, freed, saved, slices, tidied

THRESHOLD = 0.7
_TOKEN = re.compile(r"\w+")
#: Tokens whose transfer matrices are multiplied one after the other; the products of whole blocks carry the chain on.
_STRIDE = 64
_CACHE = 400_000
#: Features that a task counts at once, tokens of its chains at once and altogether, about.
_PART, _TOKENS, _TASK = 100_000, 1 << 17, 1 << 19
#: Parts of one to which numbers are rounded before they are summed: a float holds sums below 2^33 of them exactly.
_EXACT = float(1 << 20)
_DEFAULT = math.log(1e-9)


def features(token: str) -> list[str]:
    """The word and its first and last 3 to 6 letters, of a token in lower case."""
    out = ["w" + token]
    for k in (3, 4, 5, 6):
        if len(token) > k:
            out += ["<" + token[:k], ">" + token[-k:]]
    return out


@dataclass
class ChainModel:
    """Two states, O and T. A token's score is bias + the weights of its features."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    #: log transition scores: O->O, O->T, T->O, T->T
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    #: intercept, weight of the largest marginal's log-odds, weight of the log of their sum
    calibration: tuple[float, float, float] = (-2.0, 0.3, 0.0)

    def score(self, token: str) -> float:
        w = self.weights
        return self.bias + sum(w.get(f, 0.0) for f in features(token))

    def odds(self, potentials: list[float]) -> list[float]:
        """Odds of T at each token by forward-backward, in ratio form; potentials are exp(score)."""
        oo, ot, to, tt = map(math.exp, self.trans)
        forward = list(potentials[:1])
        r = forward[0] if forward else 1.0
        for e in potentials[1:]:
            r = e * (ot + r * tt) / (oo + r * to)
            forward.append(r)
        b = 1.0
        for t in range(len(potentials) - 1, -1, -1):
            e = potentials[t]
            forward[t] *= b
            eb = e * b
            b = (to + tt * eb) / (oo + ot * eb)
        return forward

    def document(self, odds: list[float]) -> float:
        """Probability that the document is toxic, from the odds of its tokens."""
        a, c, d = self.calibration
        x, y = summary(odds)
        z = a + c * x + d * y
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def summary(odds: list[float]) -> tuple[float, float]:
    """Log-odds of the largest marginal, bounded to 6, and the log of the marginals' sum over those above 0.2."""
    if not odds:
        return -6.0, _DEFAULT / 4
    top = max(odds)
    likely = sum(o / (1 + o) for o in odds if o > 0.25)
    return max(-6.0, min(6.0, math.log(max(top, 1e-9)))), math.log(likely + 0.01)


def tokens_of(text: str | None) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text or "")]


def _balance(n: int, k: int) -> float:
    """The weight of a clean text where ``k`` of ``n`` texts are toxic: all clean ones count for two a toxic one at most."""
    return min(1.0, 2 * k / (n - k)) if n > k else 1.0


def bound(p: np.ndarray, q: np.ndarray, n: int, k: int, kinds: int) -> np.ndarray:
    """Which features that stand in ``p`` of the ``k`` toxic and ``q`` of the ``n - k`` clean texts are bound to toxic ones, by the G-test over all ``kinds`` of them."""
    p, q = p.astype(float), q.astype(float)
    share, clean = k / n, _balance(n, k)
    often = p / (p + clean * q) > max(0.6, 1.5 * k / (k + clean * (n - k)))
    g = 2 * (p * np.log(p / ((p + q) * share)) + np.where(q > 0, q * np.log(np.maximum(q, 1) / ((p + q) * (1 - share))), 0))
    return often & (p / (p + q) > share) & (g > 2 * (math.log(max(2, kinds)) + 2))


class _Chains:
    """Whole chains of any length, cut into blocks of _STRIDE tokens for vector operations; nothing is lost at the cuts.

    A token's transfer matrix holds the transition and its potential, a
    chain's first token none of the former, padding is the identity. Block
    products carry forward and backward vectors along each chain, then all
    blocks are gone through at once.
    """

    def __init__(self, lengths: np.ndarray):
        lengths = lengths[lengths > 0]
        blocks = -(-lengths // _STRIDE)
        self.begin = np.concatenate(([0], np.cumsum(blocks)))[:-1]
        self.count = int(blocks.sum())
        self.order = np.argsort(-blocks, kind="stable")
        self.blocks = blocks[self.order]
        where = np.arange(self.count * _STRIDE).reshape(self.count, _STRIDE)
        offset = where - np.repeat(self.begin, blocks)[:, None] * _STRIDE
        self.real = (offset < np.repeat(lengths, blocks)[:, None]).T  # (stride, blocks), as all below
        self.first = (offset == 0).T

    def places(self) -> np.ndarray:
        """Flat index of each token, chain by chain."""
        k, b = np.nonzero(self.real.T)[::-1]
        return k * self.count + b

    def marginals(self, e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(T) of each token and the expected transitions of each block; ``e``: potentials, (stride, blocks).

        Vectors are kept as the ratio of T to O: forward r, backward s.
        """
        a = np.exp(trans)
        first, real = self.first, self.real
        w00, w01 = np.where(first | ~real, 1.0, a[0, 0]), np.where(real, np.where(first, e, a[0, 1] * e), 0.0)
        w10, w11 = np.where(real, np.where(first, 1.0, a[1, 0]), 0.0), np.where(real, np.where(first, e, a[1, 1] * e), 1.0)
        p00, p01, p10, p11 = w00[0], w01[0], w10[0], w11[0]
        for k in range(1, _STRIDE):
            p00, p01, p10, p11 = p00 * w00[k] + p01 * w10[k], p00 * w01[k] + p01 * w11[k], p10 * w00[k] + p11 * w10[k], p10 * w01[k] + p11 * w11[k]
            if k % 4 == 0:
                size = p00 + p01 + p10 + p11
                p00, p01, p10, p11 = p00 / size, p01 / size, p10 / size, p11 / size
        start, end = np.empty(self.count), np.empty(self.count)
        chains, longest = len(self.blocks), int(self.blocks[0]) if len(self.blocks) else 0
        reach = [self.begin[self.order[: int(np.searchsorted(-self.blocks, -j, "left"))]] + j for j in range(longest)]  # each chain's block j
        r = np.zeros(chains)
        for at in reach:
            x = r[: len(at)]
            start[at] = x
            r[: len(at)] = (p01[at] + x * p11[at]) / (p00[at] + x * p10[at])
        s = np.ones(chains)
        for at in reversed(reach):
            x = s[: len(at)]
            end[at] = x
            s[: len(at)] = (p10[at] + p11[at] * x) / (p00[at] + p01[at] * x)
        forward = np.empty((_STRIDE + 1, self.count))
        forward[0] = start
        for k in range(_STRIDE):
            x = forward[k]
            forward[k + 1] = (w01[k] + x * w11[k]) / (w00[k] + x * w10[k])
        p, pairs, s, inner = np.zeros(e.shape), np.zeros((4, self.count)), end, real & ~first
        for k in range(_STRIDE - 1, -1, -1):
            both = forward[k + 1] * s
            p[k] = both / (1 + both)
            x = forward[k]
            joint = w00[k], w01[k] * s, x * w10[k], x * w11[k] * s
            share = inner[k] / (joint[0] + joint[1] + joint[2] + joint[3])
            for i, j in enumerate(joint):
                pairs[i] += j * share
            s = (w10[k] + w11[k] * s) / (w00[k] + w01[k] * s)
        return p * real, pairs.reshape(2, 2, -1)


_COUNTED = "feature string, toxic long, clean long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the texts (text, toxic) each feature stands, of each class; a feature may come more than once."""
    known: dict[str, list[str]] = {}
    both: tuple[Counter[str], Counter[str]] = Counter(), Counter()

    def parts() -> Iterator[pa.RecordBatch]:
        clean, toxic = both
        names = list(clean | toxic)
        for i in range(0, len(names), _PART):
            some = names[i : i + _PART]
            yield pa.record_batch([pa.array(some, pa.string()), pa.array([toxic[f] for f in some], pa.int64()), pa.array([clean[f] for f in some], pa.int64())], names=["feature", "toxic", "clean"])
        clean.clear()
        toxic.clear()

    for b in slices(batches):
        for text, y in zip(b.column(0), b.column(1)):
            found: set[str] = set()
            for w in set(tokens_of(text.as_py())):
                if (x := known.get(w)) is None:
                    if len(known) >= _PART // 4:
                        known.clear()
                    x = known[w] = features(w)
                found.update(x)
            both[y.as_py()].update(found)
            if len(both[0]) + len(both[1]) > _PART:
                yield from parts()
    yield from parts()


_REDUCED = "toxic boolean, n int, at array<int>, feat array<int>"


def _reduced(index: dict[str, int]):
    """Of each text (text, toxic) its number of tokens and where which bound features stand; all else of it shares the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in slices(batches):
            n, places, feats = [], [], []
            for text in b.column(0):
                tokens, at, feat = tokens_of(text.as_py()), [], []
                for i, w in enumerate(tokens):
                    if (x := known.get(w)) is None:
                        if len(known) >= _PART:
                            known.clear()
                        x = known[w] = [index[f] for f in features(w) if f in index]
                    if x:
                        at += [i] * len(x)
                        feat += x
                n.append(len(tokens))
                places.append(at)
                feats.append(feat)
            ints = pa.list_(pa.int32())
            yield pa.record_batch([b.column(1), pa.array(n, pa.int32()), pa.array(places, ints), pa.array(feats, ints)], names=["toxic", "n", "at", "feat"])

    return run


@dataclass
class _State:
    """What a round of training needs to know: the parameters so far."""

    w: np.ndarray
    bias: float
    trans: np.ndarray


class _Part:
    """Some of the chains (toxic, n, at, feat, times) under a state: potentials, marginals and expected transitions."""

    def __init__(self, b: pa.RecordBatch, state: _State):
        self.toxic, n, self.times = (np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1, 4))
        self.n = n.astype(np.int64)
        self.chains = _Chains(self.n)
        self.place = self.chains.places()
        each = np.diff(b.column(2).offsets.to_numpy())
        at = np.repeat(np.cumsum(self.n) - self.n, each) + b.column(2).flatten().to_numpy()
        self.at, self.feat, self.bad = self.place[at], b.column(3).flatten().to_numpy(), np.repeat(self.toxic, each)
        shape = self.chains.real.shape
        e = np.exp(np.clip(state.bias + np.bincount(self.at, state.w[self.feat], self.chains.real.size), -30, 30)).reshape(shape)
        self.p, self.pairs = self.chains.marginals(e, state.trans)

    def gradient(self, size: int) -> np.ndarray:
        """Of clean and of toxic chains: derived less expected tags by feature, of all tokens, and transitions.

        What is summed are multiples of a fraction that are exact in a float,
        so sums do not depend on how the chains are dealt out.
        """
        exact = lambda x: np.rint(x * _EXACT) / _EXACT
        y = np.zeros(self.p.shape)
        y.ravel()[self.at[self.bad]] = 1
        blocks = -(-self.n // _STRIDE)
        kind, times = np.repeat(self.toxic.astype(int), blocks), np.repeat(self.times, blocks).astype(float)
        err = exact(y - self.p) * times
        tags = y.ravel()[self.place].astype(int)
        inside = ~self.chains.first.ravel()[self.place[1:]] * np.repeat(self.times, self.n)[1:]
        pair, of = tags[:-1] * 2 + tags[1:], np.repeat(self.toxic.astype(int), self.n)[1:]
        seen = np.bincount(pair + 4 * of, inside, 8).reshape(2, 4)
        moves = exact(self.pairs.reshape(4, -1)) * times
        out = np.zeros((2, size + 5))
        for c in (0, 1):
            mine = self.bad == bool(c)
            out[c, :size] = np.bincount(self.feat[mine], err.ravel()[self.at[mine]], size)
            out[c, size] = err[:, kind == c].sum()
            out[c, size + 1 :] = seen[c] - moves[:, kind == c].sum(1)
        return out

    def summaries(self) -> tuple[np.ndarray, np.ndarray]:
        """``summary`` of each chain."""
        p = self.p.ravel()[self.place]
        starts = np.cumsum(self.n) - self.n
        top = np.maximum.reduceat(p, starts)
        x = np.log(np.maximum(top, 1e-9) / np.maximum(1 - top, 1e-9)).clip(-6, 6)
        return x, np.log(np.add.reduceat(np.where(p > 0.2, p, 0), starts) + 0.01)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of a task in Arrow's own bytes, so many at a time that they have about _TOKENS tokens."""
    for b in slices(batches):
        ends = np.cumsum(b.column(1).to_numpy().astype(np.int64))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _TOKENS, "right")))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema) as w:
                w.write_batch(b.take(pa.array(range(i, j))))
            yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["chains"])
            i = j


def _gradient(chains: bytes, state: _State) -> np.ndarray:
    with pa.ipc.open_stream(chains) as r:
        return _Part(r.read_next_batch(), state).gradient(len(state.w))


def _summaries(state: _State):
    """Of each chain whether it is toxic, how often it comes, and its summary: the four as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for chains in b.column(0):
                with pa.ipc.open_stream(chains.as_py()) as r:
                    part = _Part(r.read_next_batch(), state)
                seen = np.array([part.toxic, part.times, *part.summaries()], float)
                yield pa.record_batch([pa.array([seen.tobytes()], pa.binary())], names=["seen"])

    return run


def _sums(seen: bytes, b: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the calibration's log-likelihood at ``b``, in which all texts weigh the same; exact as ``_Part.gradient``."""
    toxic, times, *xy = np.frombuffer(seen).reshape(4, -1)
    x = np.stack([np.ones(len(toxic)), *xy], 1)
    p = 1 / (1 + np.exp(-np.clip((x * b).sum(1), -30, 30)))
    each = np.concatenate([x * (toxic - p)[:, None], (x[:, :, None] * x[:, None, :]).reshape(-1, 9) * (p * (1 - p))[:, None]], 1)
    return (np.rint(each * _EXACT) / _EXACT * times[:, None]).sum(0)


def _fitted(size: int, clean: float, gradient: Callable[[_State], np.ndarray], rounds: int) -> _State:
    """Full-batch Adagrad on the log-likelihood of the derived tags of whole chains; a clean chain has the weight ``clean``."""
    w, bias, trans = np.zeros(size), -3.0, np.zeros((2, 2))
    gw, gb, gt = np.full(size, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    for _ in range(rounds):
        got = np.array([clean, 1.0]) @ gradient(_State(w, bias, trans))
        dw, db, dt = got[:size] - 0.5 * w, got[size], got[size + 1 :].reshape(2, 2) - 0.5 * trans
        gw, gb, gt = gw + dw * dw, gb + db * db, gt + dt * dt
        w, bias, trans = w + 0.8 * dw / np.sqrt(gw), bias + 0.8 * db / math.sqrt(gb), trans + 0.5 * dt / np.sqrt(gt)
    return _State(w, float(bias), trans)


def _logistic(sums: Callable[[np.ndarray], np.ndarray]) -> tuple[float, float, float]:
    """Newton's method with a small ridge, signs of the two slopes kept positive; ``sums``: those of ``_sums`` over all chains."""
    b = np.zeros(3)
    for _ in range(40):
        got = sums(b)
        step = np.clip(np.linalg.solve(got[3:].reshape(3, 3) + 0.1 * np.eye(3), got[:3] - 0.1 * b), -2, 2)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    if b[1] < 0 or b[2] < 0:
        return float(b[0]), max(0.05, float(b[1])), max(0.0, float(b[2]))
    return float(b[0]), float(b[1]), float(b[2])


def _wordless(times: dict[bool, int]) -> bytes:
    """The summaries of texts without a token, as ``_summaries`` gives those of others."""
    return np.array([(y, c, *summary([])) for y, c in times.items()], float).reshape(-1, 4).T.tobytes()


def _model(names: list[str], state: _State, calibration: tuple[float, float, float]) -> ChainModel:
    return ChainModel(dict(zip(names, map(float, state.w))), state.bias, tuple(float(x) for x in state.trans.ravel()), calibration)


def train(texts: list[str], toxic: list[bool], rounds: int = 40) -> ChainModel:
    """The steps of ``learn`` over a list of texts that is at hand."""
    n, k = len(texts), sum(toxic)
    given = pa.record_batch([pa.array(texts, pa.string()), pa.array(toxic, pa.bool_())], names=["text", "toxic"])
    counts = pa.Table.from_batches(_counted(iter([given]))).group_by("feature").aggregate([("toxic", "sum"), ("clean", "sum")]).filter(pc.field("toxic_sum") > 0) if 0 < k < n else None
    if counts is None or not counts.num_rows:
        return ChainModel()
    chosen = bound(counts["toxic_sum"].to_numpy(), counts["clean_sum"].to_numpy(), n, k, counts.num_rows)
    names = sorted(counts["feature"].filter(pa.array(chosen)).to_pylist())
    if not names:
        return ChainModel()
    chains = pa.Table.from_batches(_reduced({f: i for i, f in enumerate(names)})(iter([given]))).append_column("times", pa.array([1] * n, pa.int64()))
    packs = list(_packed(iter(chains.filter(pc.field("n") > 0).combine_chunks().to_batches())))
    state = _fitted(len(names), _balance(n, k), lambda s: sum(_gradient(b.column(0)[0].as_py(), s) for b in packs), rounds)
    seen = [b.column(0)[0].as_py() for b in _summaries(state)(iter(packs))]
    seen.append(_wordless(Counter(chains.filter(pc.field("n") == 0)["toxic"].to_pylist())))
    return _model(names, state, _logistic(lambda b: sum(_sums(x, b) for x in seen)))


def learn(docs: DataFrame, labels: DataFrame, max_bytes: int | None = None, rounds: int = 40) -> ChainModel:
    """Trains on all labelled documents outside fold 1; a document with any toxic label is toxic.

    Equal texts count once, with the label of the least id. Features are
    counted, and each round's gradient is summed, by tasks over whole texts;
    only bound features, gradients and sums reach the driver. Texts in which
    bound features stand in the same places among as many tokens, as all
    without any of one length, are one chain with a number. ``max_bytes``
    leaves out longer texts; by default there is no bound.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(fold_of(F.col("doc_id")) != 1)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (fold_of(F.col("doc_id")) != 1))
    if max_bytes is not None:
        rows = rows.where(F.octet_length("text") <= max_bytes)
    labelled = rows.join(usable, "doc_id").withColumn("h", F.sha2("text", 256))
    once = labelled.groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("of"), F.min("text").alias("text"))
    texts = Stored(once.select("text", (F.col("of.toxic") > 0).alias("toxic")))
    try:
        return _learned(texts.df, rounds)
    finally:
        texts.remove()
        tidied(docs.sparkSession)


def _learned(texts: DataFrame, rounds: int) -> ChainModel:
    each = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n, k = sum(each.values()), each.get(True, 0)
    if not 0 < k < n:
        return ChainModel()
    counts = saved(texts.mapInArrow(_counted, _COUNTED).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0"))
    kinds = counts.count()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0]).filter(pa.array(bound(b.column(1).to_numpy(), b.column(2).to_numpy(), n, k, kinds), pa.bool_()))

    names = sorted(r["feature"] for r in counts.mapInArrow(chosen, "feature string").collect())
    if not names:
        return ChainModel()
    reduced = texts.mapInArrow(_reduced({f: i for i, f in enumerate(names)}), _REDUCED)
    grouped = saved(reduced.groupBy("toxic", "n", "at", "feat").agg(F.count(F.lit(1)).alias("times")))
    tokens = grouped.agg(F.sum(F.col("n").cast("long"))).first()[0]
    packs = saved(grouped.where("n > 0").repartition(max(1, math.ceil(tokens / _TASK))).mapInArrow(_packed, "chains binary"))
    wordless = _wordless({r["toxic"]: r["times"] for r in grouped.where("n = 0").select("toxic", "times").collect()})
    chains = packs.rdd
    state = _fitted(len(names), _balance(n, k), lambda s: chains.map(lambda r: _gradient(bytes(r[0]), s)).treeReduce(np.add), rounds)
    seen = saved(packs.mapInArrow(_summaries(state), "seen binary")).rdd
    return _model(names, state, _logistic(lambda b: seen.map(lambda r: _sums(bytes(r[0]), b)).treeReduce(np.add) + _sums(wordless, b)))


class Scorer:
    """Scores whole texts under a model; token potentials are remembered up to a bound."""

    def __init__(self, model: ChainModel):
        self.model, self.met = model, {}
        self.plain = math.exp(model.bias)
        #: scores of texts without any weighted feature, by number of tokens
        self.by_length: dict[int, float] = {}
        self.words = {f[1:] for f in model.weights if f[0] == "w"}
        self.heads = {f[1:4] for f in model.weights if f[0] == "<"}
        self.tails = {f[-3:] for f in model.weights if f[0] == ">"}

    def potential(self, token: str) -> float:
        if token[:3] in self.heads or token[-3:] in self.tails or token in self.words:
            return math.exp(max(-30.0, min(30.0, self.model.score(token))))
        return self.plain

    def potentials(self, text: str | None) -> list[float]:
        met = self.met
        tokens = _TOKEN.findall(text or "")  # as written; potentials are those of the lower-case token
        out = list(map(met.get, tokens))
        if None in out:
            if len(met) > _CACHE:
                met.clear()
            for i, e in enumerate(out):
                if e is None:
                    out[i] = met[tokens[i]] = self.potential(tokens[i].lower())
        return out

    def odds(self, text: str | None) -> list[float]:
        return self.model.odds(self.potentials(text))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]]]:
        """The document's score and its toxic spans."""
        e = self.potentials(text)
        n, p = len(e), self.plain
        if e.count(p) == n:  # all alike: the chain depends on its length alone
            if n not in self.by_length:
                odds = self.model.odds(e)
                if any(o > 1 for o in odds):
                    return self.model.document(odds), self.spans(text, odds)
                self.by_length[n] = self.model.document(odds)
            return self.by_length[n], []
        odds = self.model.odds(e)
        return self.model.document(odds), self.spans(text, odds)

    def spans(self, text: str | None, odds: list[float]) -> list[tuple[int, int]]:
        """Code-point offsets of the tokens more likely toxic than not, adjacent ones joined."""
        if not any(o > 1 for o in odds):
            return []
        out: list[tuple[int, int]] = []
        last = False
        for m, o in zip(_TOKEN.finditer(text or ""), odds):
            if o > 1:
                if last:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
            last = o > 1
        return out


def _scored(model: ChainModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in slices(batches):
            scores, spans = [], []
            for t in b.column(1).to_pylist():
                score, found = scorer.score(t)
                scores.append(score)
                spans.append(",".join(f"{s}:{e}" for s, e in found))
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, model: ChainModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans (start:end, comma-joined).

    Null texts count as empty; an empty text scores as one without toxic
    tokens. Without labels of both classes outside fold 1 all scores are that
    of the untrained model, below the threshold; a score at the threshold is
    predicted toxic. A text of any length is one chain, scored whole; repeated
    rows stay and get equal scores; other columns are not read; an empty table
    gives an empty result.
    """
    model = model or learn(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double, spans string")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic, all columns kept."""
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for s in texts:
            yield pd.Series([scorer.score(t)[0] for t in s], dtype="float64")
        s = scorer = None
        freed()

    return docs.where(score(F.col("text").cast("string")) < THRESHOLD)
