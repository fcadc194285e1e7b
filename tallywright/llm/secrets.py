"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams: alternatives, each a
set of trigrams that any match must contain. The index holds (trigram, doc_id)
postings; alternatives are intersected by joining the small query table and
counting; only candidates are verified by the regex. A rule without mandatory
trigrams scans every text. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # read alike by Java and Python; letters of either case are spelled out
    group: int = 0  # whose length counts
    shortest: int = 0
    base: bool = False


# The rules, base kinds first.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[ps]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[bp]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
MOST_ALTERNATIVES = 64
_SPANS = "array<struct<start:int,order:int,end:int>>"


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams in lower case, or None if some match needs none.

    Follows literals, groups, branches, optional items and classes whose
    letters agree in lower case or are few; any other item ends the literal
    run. More than MOST_ALTERNATIVES alternatives also end the runs, which only
    loosens the query.
    """
    from re import _constants as c
    from re import _parser

    State = tuple[frozenset[str], str]

    def push(states: set[State], ch: str) -> set[State]:
        out = set()
        for grams, tail in states:
            tail += ch.lower()
            out.add((grams | {tail[-3:]} if len(tail) >= 3 else grams, tail[-2:]))
        return out

    def ended(states: set[State]) -> set[State]:
        return {(g, "") for g, _ in states}

    def run(items, states: set[State]) -> set[State]:
        for op, arg in items:
            if op is c.LITERAL:
                states = push(states, chr(arg))
            elif op is c.SUBPATTERN:
                states = run(arg[-1], states)
            elif op is c.BRANCH:
                states = set().union(*(run(b, states) for b in arg[1]))
            elif op is c.IN and all(o is c.LITERAL for o, _ in arg) and len(arg) <= 8:
                states = set().union(*(push(states, ch) for ch in {chr(a).lower() for _, a in arg}))
            elif op is c.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                states = states | run(arg[2], states)
            elif op is c.MAX_REPEAT and arg[0] >= 1:
                states = ended(run(arg[2], states))
            elif op is not c.AT:
                states = ended(states)
            if len(states) > MOST_ALTERNATIVES:
                states = {(frozenset.intersection(*(g for g, _ in states)), "")}
        return states

    found = {g for g, _ in run(_parser.parse(regex), {(frozenset(), "")})}
    if frozenset() in found:
        return None
    return sorted((_few(g) for g in found if not any(o < g for o in found)), key=sorted)


def _few(grams: frozenset[str], most: int = 3) -> frozenset[str]:
    """At most so many of the trigrams, spread over their order: a looser query that needs fewer postings."""
    order = sorted(grams)
    return grams if len(order) <= most else frozenset(order[round(i * (len(order) - 1) / (most - 1))] for i in range(most))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id) of the trigrams that queries name, over texts in lower case."""
    named = F.array(*[F.lit(t) for t in trigrams]).cast("array<string>")
    hits = let(F.lower(F.col("text")), lambda low: F.filter(named, lambda t: F.contains(low, t)))
    # explode_outer: for a plain explode the optimizer would compute the array once more, as a filter
    return docs.select("doc_id", F.explode_outer(hits).alias("trigram")).where("trigram is not null")


def rule_queries(rules: tuple[Rule, ...]) -> list[tuple[str, int, str, int]]:
    """(rule, alternative, trigram, trigrams needed) of the rules that do not scan fully."""
    return [(r.kind, i, t, len(alt)) for r in rules for i, alt in enumerate(trigram_query(r.regex) or []) for t in sorted(alt)]


def rule_candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, rules): which rules' Boolean queries a document meets, by intersecting the postings; rules that scan fully are not listed."""
    table = index.sparkSession.createDataFrame(rule_queries(rules), "rule string, alternative int, trigram string, needed int")
    met = index.join(F.broadcast(table), "trigram").groupBy("doc_id", "rule", "alternative", "needed").agg(F.count_distinct("trigram").alias("n")).where("n >= needed")
    return met.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def rarest(index: DataFrame, rules: tuple[Rule, ...]) -> list[str]:
    """For each alternative its trigram with the fewest postings: a text without any of them meets no query."""
    n = {r["trigram"]: r["n"] for r in index.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).collect()}
    best: dict[tuple[str, int], str] = {}
    for rule, alternative, t, _ in rule_queries(rules):
        at = (rule, alternative)
        best[at] = min(best.get(at, t), t, key=lambda x: (n.get(x, 0), x))
    return sorted(set(best.values()))


def _before(sizes: Column) -> Column:
    """The sum up to and including each element, by way of blocks of about the square root of their number."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def summed(a: Column) -> Column:
        """a: struct of the sizes and the width of a block."""
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a["v"]) - 1) / a["w"]).cast("int")), lambda k: total(F.slice(a["v"], k * a["w"] + 1, a["w"])))

        def placed(sums: Column) -> Column:
            starts = F.transform(sums, lambda x, k: total(F.slice(sums, F.lit(1), k)))
            place = lambda p: F.transform(a["v"], lambda x, i: F.get(p, F.floor(i / a["w"]).cast("int")) + total(F.slice(a["v"], F.floor(i / a["w"]).cast("int") * a["w"] + 1, i % a["w"] + 1)))
            return let(starts, place)

        return let(blocks, placed)

    return let(F.struct(sizes.alias("v"), F.ceil(F.sqrt(F.size(sizes))).cast("int").alias("w")), summed)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, order, end) of a rule's matches in code points, from the pieces between the matches."""
    none = F.array().cast(_SPANS)
    found = lambda group: F.regexp_extract_all(text, F.lit(rule.regex), F.lit(group))
    sizes = lambda a: F.transform(a, lambda m: F.char_length(m))

    def placed(m: Column) -> Column:
        """From the lengths of gaps, matches and groups to spans of the matches long enough."""
        ends = _before(F.zip_with(F.slice(m["gaps"], F.lit(1), F.size(m["whole"])), m["whole"], lambda g, w: g + w))

        def spans(end: Column) -> Column:
            kept = F.filter(F.sequence(F.lit(0), F.size(end) - 1), lambda i: F.get(m["sized"], i) >= rule.shortest)
            return F.transform(kept, lambda i: F.struct((F.get(end, i) - F.get(m["whole"], i)).alias("start"), F.lit(order).alias("order"), F.get(end, i).alias("end")))

        return let(ends, spans)

    lengths = F.struct(sizes(F.split(text, rule.regex, -1)).alias("gaps"), sizes(found(0)).alias("whole"), sizes(found(rule.group)).alias("sized"))
    return F.when(F.regexp(text, F.lit(rule.regex)), let(lengths, placed)).otherwise(none)


def _joined(spans: Column, kinds: list[str]) -> Column:
    name = lambda m: F.element_at(F.array(*[F.lit(k) for k in kinds]), m["order"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", name(m), m["start"].cast("string"), m["end"].cast("string"))), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_<kind> of base kinds, base_sha256, spans.

    Null texts count as empty. Repeated and null ids are fine: candidates are
    found by id, matches by each row's own text. Matches that start together
    are in the order of the rules. Texts of any length are read whole, in time
    little more than their length and matches. Other columns are not read; an
    empty table gives an empty result.

    Texts without the rarest trigram of any alternative do not meet the list of
    candidates; they need nothing but the rules that scan fully.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    full = [trigram_query(r.regex) is None for r in rules]
    index = saved(postings(rows, sorted({t for *_, t, _ in rule_queries(rules)})))
    listed = rule_candidates(index, rules).select(F.col("doc_id").alias("_id"), "rules")
    posted = let(F.lower("text"), lambda low: F.exists(F.array(*[F.lit(t) for t in rarest(index, rules)]).cast("array<string>"), lambda t: F.contains(low, t)))
    none = F.array().cast(_SPANS)
    marked = rows.select("doc_id", "text", posted.alias("posted"))
    found = lambda i, r: _spans(F.col("text"), r, i) if full[i] else F.when(F.coalesce(F.array_contains("rules", r.kind), F.lit(False)), _spans(F.col("text"), r, i)).otherwise(none)
    joined = marked.where("posted").join(listed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    spans = joined.select("doc_id", *[found(i, r).alias(f"s{i}") for i, r in enumerate(rules)])
    plain = marked.where("not posted").select("doc_id", *[(_spans(F.col("text"), r, i) if full[i] else none).alias(f"s{i}") for i, r in enumerate(rules)])
    kinds = [r.kind for r in rules]
    base = [i for i, r in enumerate(rules) if r.base]
    flat = lambda ix: F.flatten(F.array(*[F.col(f"s{i}") for i in ix]))
    return spans.unionByName(plain).select(
        "doc_id", *[F.size(f"s{i}").cast("long").alias(f"n_{kinds[i]}") for i in base],
        F.sha2(_joined(flat(base), kinds).cast("binary"), 256).alias("base_sha256"), _joined(flat(range(len(rules))), kinds).alias("spans"),
    )
