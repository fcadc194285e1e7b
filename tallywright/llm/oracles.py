"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .licenses import CONTAINMENT, SHINGLE, TEMPLATES
from .mixing import BUDGET, REPEATS, WEIGHTS
from .secrets import RULES

_WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t
"""

_WEIGHT = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {} {} END".format(len(WEIGHTS), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)))

# One step for each source: a source stops at its cap, the excess goes to the others by weight.
MIXING = rf"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
n AS (SELECT *, {_WEIGHT} AS w, source_size * {REPEATS} AS cap FROM b),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {BUDGET} - coalesce(sum(cap) OVER before, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
 FROM n WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE level * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT final FROM f) * w), CAST(cap AS DOUBLE)) AS target FROM n),
u AS (SELECT s.*, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM s),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM u),
r AS (SELECT o.*, t.source_size, t.target FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, unnest(range({REPEATS})) AS round FROM r WHERE size > 0),
v AS (SELECT *, CAST(upto + source_size * round AS DOUBLE) / target AS finish FROM q),
z AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, draw, doc_id, round ROWS UNBOUNDED PRECEDING) AS queue FROM v),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM z WHERE queue <= {BUDGET} * (SELECT sum(size) FROM s) GROUP BY 1)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(k.taken, 0) AS taken FROM r LEFT JOIN k ON r.doc_id = k.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_spans() -> str:
    """One SELECT a rule: doc_id, o (order), kind, base, s, e of the matches long enough."""
    out = []
    for i, r in enumerate(RULES):
        x = _quoted(r.regex)
        out.append(
            f"SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {str(r.base).lower()} AS base, unnest(list_transform(range(1, len(m) + 1), lambda k: list_sum(list_transform(g[1:k], lambda p: length(p))) + coalesce(list_sum(list_transform(m[1:k-1], lambda p: length(p))), 0))) AS s,"
            f" unnest(list_transform(m, lambda p: length(p))) AS n, unnest(list_transform(z, lambda p: length(p))) AS sized, {r.shortest} AS shortest"
            f" FROM (SELECT doc_id, regexp_split_to_array(text, {x}) AS g, regexp_extract_all(text, {x}, 0) AS m, regexp_extract_all(text, {x}, {r.group}) AS z FROM d WHERE regexp_matches(text, {x}))"
        )
    return " UNION ALL ".join(out)


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({_rule_spans()}),
x AS (SELECT doc_id, o, kind, base, s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS t FROM a WHERE sized >= shortest),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(t, ',' ORDER BY s, o) FILTER (base) AS b, string_agg(t, ',' ORDER BY s, o) AS spans FROM x GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_SHINGLES = f"list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i+{SHINGLE - 1}], ' ')))"
_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"

LICENSES = f"""
WITH t AS (SELECT license, {_SHINGLES} AS t FROM (SELECT license, {_WORDS.format('text')} AS w FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) AS v(license, text))),
d AS (SELECT doc_id, {_SHINGLES} AS h FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)),
u AS (SELECT doc_id, unnest(h) AS x FROM d), q AS (SELECT license, len(t) AS n, unnest(t) AS x FROM t)
SELECT doc_id, license, CAST(count(*) AS DOUBLE) / n AS containment FROM u JOIN q ON u.x = q.x GROUP BY doc_id, license, n HAVING count(*) / n >= {CONTAINMENT}
"""

SQL = {"op10_exact_dedup": EXACT_DEDUP, "op5_mixing": MIXING, "op7_secrets": SECRETS, "op9_licenses": LICENSES}
