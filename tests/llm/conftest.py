import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that operators use inside
    *[T.StructField(n, T.StringType()) for n in ("fp", "sha", "n", "score", "key", "size", "h", "_tw_id", "shard_id", "spans", "rules", "node", "root", "depth")],
])
EXTRA = ("x",) * 14


@pytest.fixture(scope="session")
def make(spark):
    """docs from (doc_id, text, lang, source), with extra columns of clashing names."""

    def build(rows):
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in rows], COLUMNS)

    return build


WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega").split()


def prose(n: int, start: int = 0, step: int = 7) -> str:
    return " ".join(WORDS[(start + i * step + i * i // 5) % len(WORDS)] for i in range(n))


#: Nulls, empties, white space, ties, repeated rows, hot source, very long and non-ASCII texts.
TRICKY = [
    (1, prose(60), "en", "a"), (2, prose(60), "en", "a"), (3, prose(60).upper(), "en", "a"), (3, prose(60).upper(), "en", "a"),
    (4, None, "en", "a"), (5, "", None, None), (6, " \t\n", "fr", ""), (None, "no id here at all", "en", "b"), (None, None, None, None),
    (7, "Ünïcödé ÀÉ ß İ word", "de", "a"), (8, "ünïcödé àé ß i̇ word", "de", "c"), (9, prose(60) + " extra", "en", "a"), (10, prose(30_000, 3), "en", "a"),
    (11, "one", "en", "b"), (12, "ONE", "en", "b"), (13, "a b c", "es", "b"), (14, "𝔘nicode 😀 text mail x@y.org", "es", "a"), (15, prose(59) + " changed", "en", "a"),
]


@pytest.fixture(scope="session")
def tricky(make):
    return make(TRICKY)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
