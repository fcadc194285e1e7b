"""Retrieval by TF-IDF: every corpus is a long table of (doc_id, term, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stored import Stored


#: Terms whose weights are broadcast, the most frequent ones; all others are joined by shuffling.
FREQUENT = 50_000


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+", -1), lambda w: F.length(w) > 1)


def term_frequencies(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf): a term's share of the text's terms."""
    long = docs.select(key, terms(F.col("text")).alias("w")).select(key, F.size("w").alias("n"), F.explode("w").alias("term"))
    return long.groupBy(key, "term", "n").agg(F.count(F.lit(1)).alias("c")).select(key, "term", (F.col("c") / F.col("n")).alias("tf"))


def idf(tf: DataFrame, n: int) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1; terms that no document has weigh 1."""
    return tf.groupBy("term").agg((F.log((F.lit(n) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))


def retrieve(docs: DataFrame, questions: DataFrame, k: int = 3, least: float = 0.0, key: str = "doc_id", question: str = "item_id") -> DataFrame:
    """(question, key, score, rank): the k documents with the largest cosine over ``least``, ties by key.

    Texts are dealt out by key once; what is counted and summed by key, or by
    key and question, then stays where it is. Weights of the most frequent
    terms, to which most of all postings belong, are broadcast, and those of the
    questions' terms where Spark finds them small; only postings of rare terms
    are shuffled by term.
    """
    dealt = docs.select(key, "text").repartition(key)
    tf = term_frequencies(dealt, key)
    df = Stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).df
    n = docs.count()
    weight = df.select("term", (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    frequent = Stored(df.where("df > 1").orderBy(F.desc("df"), "term").limit(FREQUENT).select("term")).df
    heavy = F.broadcast(weight.join(frequent, "term"))
    rare = weight.join(frequent, "term", "left_anti")
    w = F.col("tf") * F.col("idf")
    known = tf.join(heavy, "term", "left")
    near = known.groupBy(key).agg(F.sum(w * w).alias("near"))
    far = known.where("idf is null").drop("idf").join(rare, "term").groupBy(key).agg(F.sum(w * w).alias("far"))
    norms = near.join(far, key, "left").select(key, F.sqrt(F.coalesce("near", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))).alias("norm"))
    q = term_frequencies(questions, question).join(weight, "term", "left").select(question, "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("qw"), F.col("idf").alias("q_idf"))
    q = Stored(q).df
    q_norms = q.groupBy(question).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    dots = tf.join(q, "term").groupBy(question, key).agg(F.sum(F.col("qw") * (F.col("tf") * F.col("q_idf"))).alias("dot"))
    scored = dots.join(norms, key).join(q_norms, question).select(question, key, F.round(F.try_divide(F.col("dot"), F.col("norm") * F.col("q_norm")), 9).alias("score"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), key)
    return scored.where(F.col("score") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def answer(faq: DataFrame, questions: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The best FAQ entry of each question, where its score is over the threshold."""
    best = retrieve(faq, questions, 1, threshold, "faq_id", "item_id")
    return questions.select("item_id").join(best.select("item_id", "faq_id", "score"), "item_id", "left")


def retrieve_or_rewritten(docs: DataFrame, questions: DataFrame, rewritten: DataFrame, k: int, least: float) -> DataFrame:
    """The better of the raw and the rewritten question, by top score; raw on a tie."""
    both = retrieve(docs, questions, k, least).withColumn("form", F.lit(0)).unionByName(retrieve(docs, rewritten, k, least).withColumn("form", F.lit(1)))
    top = both.groupBy("item_id", "form").agg(F.max("score").alias("top"))
    won = top.groupBy("item_id").agg(F.min(F.struct((-F.col("top")).alias("t"), "form")).getField("form").alias("form"))
    return both.join(won, ["item_id", "form"]).drop("form")


def chunks(docs: DataFrame, most: int = 500) -> DataFrame:
    """Paragraphs put together greedily to at most ``most`` characters: (doc_id, chunk, text). A longer paragraph stands alone."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n", -1), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["open"] != "") & (F.length(acc["open"]) + F.length(p) + 2 <= most)
        joined = F.concat(acc["open"], F.lit("\n\n"), p)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        return F.struct(F.when(fits, acc["done"]).otherwise(closed).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    folded = F.aggregate(parts, start, add, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["open"])), lambda x: x != ""))
    return docs.select("doc_id", F.posexplode(folded).alias("chunk", "text"))


def faq_entries(texts: DataFrame) -> DataFrame:
    """Markdown to (question, text): headings of the second level and what follows them."""
    parts = F.split(F.concat(F.lit("\n"), F.col("text")), r"\n##\s+", -1)
    part = F.explode(F.slice(parts, F.lit(2), F.size(parts)))
    return texts.select(part.alias("p")).select(F.trim(F.split("p", "\n", 2)[0]).alias("question"), F.btrim(F.coalesce(F.get(F.split("p", "\n", 2), 1), F.lit("")), F.lit(" \n\r\t")).alias("text"))
