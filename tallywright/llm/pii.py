"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers of three sorts vote on each: the
shape of the span (regex), membership of fixed lists (gazetteer) and words just
before it (context). Vote patterns are counted over the whole corpus;
expectation-maximisation on the counts estimates how reliable each labeler is
and the probability of each pattern; a logistic span classifier is then trained
on span features under those probabilities. Spans of the base patterns always
stay; the classifier decides about the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Base kinds as listed, then those only the method adds.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "local_phone", "spelled_email", "name")
BASE = 4

# Lists the gazetteer and context labelers look up.
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "us", "info"}
CALLING_CODES = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358", "420")
IBAN_COUNTRIES = {"AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"}
GIVEN_NAMES = {"james", "mary", "john", "anna", "peter", "maria", "paul", "laura", "thomas", "sophie", "jean", "pierre", "hans", "jose", "carlos", "lucia", "emma", "david", "sarah", "michael"}
CONTEXT = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "server", "host", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "bank", "account"),
    "local_phone": ("phone", "call", "tel", "fax", "mobile"),
    "spelled_email": ("mail", "contact", "write"),
    "name": ("name", "mr", "mrs", "dr", "dear"),
}
WINDOW = 40

_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MORE = {
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "local_phone": re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
}
_SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{2,63}){1,4}")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in one pass from @ to @."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            pos = m.end()
            at = text.find("@", pos)
        else:
            pos = max(pos, start)
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the four base patterns; failing matches are dropped without retries."""
    out = [(0, s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def _vote(kind: int, text: str, s: int, e: int) -> str:
    """Votes of the three labelers, '1' for, '0' against, '-' abstains."""
    span, name = text[s:e], KINDS[kind]
    digits = "".join(c for c in span if c in "0123456789")
    before = text[max(0, s - WINDOW) : s].lower()
    context = "1" if any(w in before for w in CONTEXT[name]) else "-"
    if name == "email":
        return ("1" if len(span) <= 254 and ".." not in span else "0") + ("1" if span.rsplit(".", 1)[-1].lower() in TOP_DOMAINS else "0") + context
    if name == "ip":
        return "1" + ("0" if span.startswith(("0.", "127.")) else "1") + context
    if name == "card":
        return "1" + ("1" if digits[0] in "3456" else "-") + context
    if name == "phone":
        return ("1" if len(digits) >= 10 else "-") + ("1" if digits.startswith(CALLING_CODES) else "0") + context
    if name == "ssn":
        return ("1" if digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000" else "0") + "-" + context
    if name == "iban":
        flat = span.replace(" ", "")
        valid = int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
        return ("1" if valid else "0") + ("1" if flat[:2] in IBAN_COUNTRIES else "0") + context
    if name == "local_phone":
        return ("1" if digits[0] not in "01" and digits[3] not in "01" else "0") + "-" + context
    if name == "spelled_email":
        return "1" + ("1" if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in TOP_DOMAINS else "0") + context
    words = span.lower().split()
    return "1" + ("1" if any(w in GIVEN_NAMES for w in words[1:]) else "-") + context


def _features(text: str, s: int, e: int) -> int:
    """Bits: long span, many digits, separators, upper case, word characters at either side, line start."""
    span = text[s:e]
    digits = sum(c in "0123456789" for c in span)
    bits = (e - s > 14, digits * 2 > e - s, any(c in " -.()" for c in span), any("A" <= c <= "Z" for c in span), s > 0 and text[s - 1].isalnum(), e < len(text) and text[e].isalnum(), s == 0 or text[s - 1] == "\n")
    return sum(b << i for i, b in enumerate(bits))


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str, int]]:
    """(kind, start, end, base, votes, features) of one whole text, by kind and start; others never overlap base ones."""
    text = text or ""
    base = base_spans(text)
    spans = [(*x, True) for x in base]
    more: list[tuple[int, int, int]] = []
    if _DIGIT.search(text):
        more += [(KINDS.index(k), m.start(), m.end()) for k, p in _MORE.items() for m in p.finditer(text)]
    if "at]" in text or "at)" in text:
        more += [(KINDS.index("spelled_email"), m.start(), m.end()) for m in _SPELLED.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr")):
        more += [(KINDS.index("name"), m.start(), m.end()) for m in _NAME.finditer(text)]
    if more:
        taken = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in taken]
        ends = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
        last = 0
        for k, s, e in sorted(more, key=lambda x: (x[1], x[0])):
            i = int(np.searchsorted(starts, e)) if starts else 0
            if s >= last and not (i and ends[i - 1] > s):
                spans.append((k, s, e, False))
                last = e
    return sorted((k, s, e, b, _vote(k, text, s, e), _features(text, s, e)) for k, s, e, b in spans)


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.int32())])
_NAMES = [f.name for f in _SPAN]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [[dict(zip(_NAMES, c)) for c in candidates(t)] for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def reliabilities(patterns: list[tuple[int, str, int]], rounds: int = 50) -> tuple[dict[tuple[int, str], float], np.ndarray]:
    """EM over (kind, votes, count): the probability of each pattern, and P(vote | labeler, class).

    Two classes; a labeler's votes are independent given the class. Abstaining
    is a vote of its own. The start trusts each labeler a little.
    """
    code = {"0": 0, "1": 1, "-": 2}
    if not patterns:
        return {}, np.full((3, 2, 3), 1 / 3)
    kinds = np.array([k for k, _, _ in patterns])
    votes = np.array([[code[c] for c in v] for _, v, _ in patterns])
    n = np.array([c for _, _, c in patterns], float)
    p = np.tile(np.array([[0.5, 0.2, 0.3], [0.2, 0.5, 0.3]]), (3, 1, 1))  # labeler, class, vote
    prior = np.full(len(KINDS), 0.5)
    q = np.zeros(len(n))
    for _ in range(rounds):
        log = np.stack([np.log(p[np.arange(3)[None], c, votes]).sum(1) for c in (0, 1)], 1)
        log += np.stack([np.log(1 - prior[kinds]), np.log(prior[kinds])], 1)
        log -= log.max(1, keepdims=True)
        q = np.exp(log[:, 1]) / np.exp(log).sum(1)
        for j in range(3):
            for c, share in ((0, 1 - q), (1, q)):
                mass = np.bincount(votes[:, j], n * share, 3) + np.array([[2, 0.5, 1], [0.5, 2, 1]][c])
                p[j, c] = mass / mass.sum()
        for k in range(len(KINDS)):
            here = kinds == k
            prior[k] = (1 + (n * q)[here].sum()) / (2 + n[here].sum())
    return {(k, v): float(x) for (k, v, _), x in zip(patterns, q)}, p


def _design(kind: int, votes: str, features: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 7 + 6)
    x[0] = 1
    x[1 + kind] = 1
    for i in range(7):
        x[1 + len(KINDS) + i] = features >> i & 1
    for j, v in enumerate(votes):
        x[8 + len(KINDS) + 2 * j] = v == "1"
        x[9 + len(KINDS) + 2 * j] = v == "0"
    return x


def span_classifier(counts: list[tuple[int, str, int, int]]) -> dict[tuple[int, str, int], float]:
    """Fits the classifier on (kind, votes, features, count) and gives each combination's probability."""
    by_votes: dict[tuple[int, str], int] = {}
    for k, v, _, n in counts:
        by_votes[k, v] = by_votes.get((k, v), 0) + n
    q, _ = reliabilities([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    if not counts:
        return {}
    x = np.stack([_design(k, v, f) for k, v, f, _ in counts])
    y = np.array([q[k, v] for k, v, _, _ in counts])
    n = np.array([c for *_, c in counts], float)
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        b = b + np.clip(np.linalg.solve(h, x.T @ (n * (y - p)) - b), -3, 3)
    p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    return {(k, v, f): float(z) for (k, v, f, _), z in zip(counts, p)}


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _decided(chance: dict[tuple[int, str, int], float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for spans in b.column(1).to_pylist():
                base = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"]]
                kept = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"] or chance[x["kind"], x["votes"], x["features"]] >= 0.5]
                for k in range(BASE):
                    cols[k].append(sum(x[0] == k for x in base))
                cols[4].append(hashlib.sha256(_digest(base).encode()).hexdigest())
                cols[5].append(_digest(kept))
            yield pa.record_batch([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: every candidate with its votes and features, per document."""
    kind = "struct<kind:int,start:int,end:int,base:boolean,votes:string,features:int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_found, f"doc_id long, spans array<{kind}>")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty: no spans, the hash of the empty string. Repeated
    rows stay. The counts and the hash are of base spans; ``spans`` holds all.
    The distinct combinations of kind, votes and features are bounded by their
    definition, so only a small table of counts reaches the driver.
    """
    found = saved(candidate_spans(docs))
    x = F.col("x")
    counts = found.select(F.explode("spans").alias("x")).groupBy(x["kind"].alias("k"), x["votes"].alias("v"), x["features"].alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    chance = span_classifier(sorted((r["k"], r["v"], r["f"], r["n"]) for r in counts))
    return found.mapInArrow(_decided(chance), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
