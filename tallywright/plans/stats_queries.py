"""Queries of run statistics and text retrieval, over runs made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import model, roles, stats, text
from ..sources.adapters import table
from .register import on_ledger, query

USAGE = ["event_type", "caller"]


def usage(spark, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("caller"), F.floor("value").alias("tokens"), F.round("value", 2).alias("ms"))


USAGE_SQL = "u AS (SELECT event_type, 'c' || CAST(user_id % 3 AS VARCHAR) AS caller, CAST(floor(value) AS DOUBLE) AS tokens, round(value, 2) AS ms FROM events)"


def _usage(metric: str) -> str:
    return f"""SELECT event_type, caller, '{metric}' AS metric, count(*) AS n, round(avg({metric}), 1) AS mean, round(stddev_pop({metric}), 1) AS std, round(max(CASE WHEN i = floor(n * 0.5) THEN {metric} END), 1) AS p50,
 round(CASE WHEN count(*) >= 20 THEN max(CASE WHEN i = floor(n * 0.95) THEN {metric} END) ELSE max({metric}) END, 1) AS p95, round(CASE WHEN count(*) >= 100 THEN max(CASE WHEN i = floor(n * 0.99) THEN {metric} END) ELSE max({metric}) END, 1) AS p99,
 round(1.96 * stddev_pop({metric}) / sqrt(count(*)), 1) AS ci95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type, caller ORDER BY {metric}) - 1 AS i, count(*) OVER (PARTITION BY event_type, caller) AS n FROM u) GROUP BY 1, 2"""


query("agg_token_stats", f"WITH {USAGE_SQL} {_usage('tokens')} UNION ALL {_usage('ms')}")(lambda spark, d: stats.usage_stats(usage(spark, d), USAGE, ["tokens", "ms"]))
query("agg_ctx_cap", f"WITH {USAGE_SQL}, g AS (SELECT avg(tokens * 40) AS m, stddev_pop(tokens * 40) AS s, count(*) AS n FROM u GROUP BY event_type, caller HAVING count(*) >= 50) SELECT CAST(greatest(2048, ceil(max(m + 1.96 * s / sqrt(n)) / 1024) * 1024) AS INTEGER) AS cap FROM g")(
    lambda spark, d: stats.context_cap(usage(spark, d).withColumn("tokens", F.col("tokens").cast("double") * 40), USAGE, "tokens", 50)
)
RUN = "SELECT CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 9 END AS model, l_returnflag AS file, l_quantity AS quality, l_discount AS error FROM lineitem"


def runs(spark, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.nullif(F.col("l_suppkey") % 9, F.lit(0)).alias("model"), F.col("l_returnflag").alias("file"), F.col("l_quantity").alias("quality"), F.col("l_discount").alias("error"))


query(
    "agg_bench_group",
    f"WITH r AS ({RUN}) SELECT model, file, count(quality) AS n, round(avg(quality), 4) AS mean, round(median(quality), 4) AS median, round(stddev_samp(quality), 4) AS std, min(quality) AS min, max(quality) AS max, round(CASE WHEN count(quality) > 120 THEN 1.98 WHEN count(quality) > 60 THEN 2.0 WHEN count(quality) > 30 THEN 2.042 END * stddev_samp(quality) / sqrt(count(quality)), 4) AS ci95 FROM r GROUP BY 1, 2",
)(lambda spark, d: stats.group_stats(runs(spark, d), ["model", "file"], "quality"))
_VAR = "round(avg({0}), 4) AS mean, round(stddev_pop({0}), 4) AS std, min({0}) AS min, max({0}) AS max, round(stddev_pop({0}) * 100 / avg({0}), 3) AS cv FROM r"
query(
    "agg_bench_variance",
    f"WITH r AS ({RUN}) " + " UNION ALL ".join(f"SELECT file, '{m}' AS metric, 0 AS overall, {_VAR.format(m)} GROUP BY file UNION ALL SELECT NULL, '{m}', 1, {_VAR.format(m)}" for m in ("quality", "error")),
)(lambda spark, d: stats.variance(runs(spark, d), "file", ["quality", "error"]))
query(
    "agg_trimmed_mean",
    f"WITH r AS ({RUN}), q AS (SELECT file, quantile_cont(quality, 0.05) AS lo, quantile_cont(quality, 0.95) AS hi FROM r GROUP BY 1) SELECT r.file, round(avg(quality), 4) AS mean, count(*) AS n FROM r JOIN q ON r.file = q.file WHERE quality BETWEEN lo AND hi GROUP BY 1",
)(lambda spark, d: stats.trimmed_mean(runs(spark, d), ["file"], "quality"))
BENCH_RUNS = """r AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey % 9 END AS model, l_returnflag AS provider, CASE WHEN l_linenumber % 3 = 0 THEN 'classifier' ELSE 'categorizer' END AS benchmark_type, l_quantity AS duration_seconds, CAST(l_linenumber - 1 AS BIGINT) AS n_transactions,
 l_discount * 10 AS amount_accuracy, l_discount * 5 AS cat_exact_accuracy, l_discount * 6 AS cat_fuzzy_accuracy, l_tax AS cat_fallback_rate FROM lineitem)"""


def bench_runs(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.nullif(F.col("l_suppkey") % 9, F.lit(0)).alias("model"), F.col("l_returnflag").alias("provider"), F.when(F.col("l_linenumber") % 3 == 0, "classifier").otherwise("categorizer").alias("benchmark_type"),
        F.col("l_quantity").alias("duration_seconds"), (F.col("l_linenumber") - 1).cast("long").alias("n_transactions"), (F.col("l_discount") * 10).alias("amount_accuracy"), (F.col("l_discount") * 5).alias("cat_exact_accuracy"),
        (F.col("l_discount") * 6).alias("cat_fuzzy_accuracy"), F.col("l_tax").alias("cat_fallback_rate"),
    )


_T = "CASE " + " ".join(f"WHEN cat_n - 1 >= {df} THEN {t}" for df, t in sorted(stats.T_TABLE, reverse=True)) + " END"
query(
    "agg_bench_summary",
    f"""WITH {BENCH_RUNS}, x AS (SELECT *, CASE WHEN benchmark_type = 'categorizer' THEN duration_seconds END AS long, CASE WHEN benchmark_type = 'categorizer' AND n_transactions > 0 AND duration_seconds > 0 THEN duration_seconds / n_transactions * 10 END AS ten FROM r),
 q AS (SELECT model, provider, quantile_cont(long, 0.05) AS l0, quantile_cont(long, 0.95) AS l1, quantile_cont(ten, 0.05) AS t0, quantile_cont(ten, 0.95) AS t1 FROM x GROUP BY 1, 2),
 g AS (SELECT x.model, x.provider, count(CASE WHEN benchmark_type = 'classifier' THEN 1 END) AS clf_n, avg(CASE WHEN benchmark_type = 'classifier' THEN amount_accuracy END) AS clf_amount, avg(CASE WHEN benchmark_type = 'classifier' THEN duration_seconds END) AS clf_seconds, count(long) AS cat_n_raw,
 count(CASE WHEN long BETWEEN l0 AND l1 THEN 1 END) AS cat_n, avg(CASE WHEN long IS NOT NULL THEN cat_exact_accuracy END) AS exact, stddev_samp(CASE WHEN long IS NOT NULL THEN cat_exact_accuracy END) AS std, avg(CASE WHEN long IS NOT NULL THEN cat_fuzzy_accuracy END) AS fuzzy,
 avg(CASE WHEN long IS NOT NULL THEN cat_fallback_rate END) AS fallback, avg(CASE WHEN ten BETWEEN t0 AND t1 THEN ten END) AS seconds_10 FROM x JOIN q ON x.model IS NOT DISTINCT FROM q.model AND x.provider = q.provider GROUP BY 1, 2),
 h AS (SELECT *, CASE WHEN cat_n >= 2 THEN coalesce({_T} * std / sqrt(cat_n), 0.0) ELSE 0.0 END AS ci95, greatest(0.0, 1 - fuzzy - fallback) AS wrong FROM g)
 SELECT model, provider, clf_n, round(clf_amount, 4) AS clf_amount, round(clf_seconds, 4) AS clf_seconds, cat_n, cat_n_raw, cat_n >= 10 AS enough, round(exact, 4) AS exact, round(ci95, 4) AS ci95, round(fuzzy, 4) AS fuzzy, round(wrong, 4) AS wrong, round(fallback, 4) AS fallback, round(seconds_10, 4) AS seconds_10,
 row_number() OVER (ORDER BY coalesce(round(exact, 9), -1.0) DESC, round(ci95, 9), model NULLS LAST, provider NULLS LAST) AS rank FROM h""",
)(lambda spark, d: stats.benchmark_summary(bench_runs(spark, d), ["model", "provider"]))
query(
    "jn_bench_merge",
    f"WITH r AS ({RUN}), a AS (SELECT file, model, round(avg(quality), 6) AS score, 'a' AS host FROM r WHERE model IS NOT NULL AND model < 6 GROUP BY 1, 2), b AS (SELECT file, model, round(avg(error), 6) AS miss, 'b' AS host FROM r WHERE model > 3 GROUP BY 1, 2) SELECT coalesce(a.file, b.file) AS file, coalesce(a.model, b.model) AS model, score, miss, coalesce(a.host, b.host) AS host FROM a FULL JOIN b ON a.file = b.file AND a.model = b.model",
)(
    lambda spark, d: stats.merged_runs(
        runs(spark, d).where("model < 6").groupBy("file", "model").agg(F.round(F.avg("quality"), 6).alias("score")).withColumn("host", F.lit("a")),
        runs(spark, d).where("model > 3").groupBy("file", "model").agg(F.round(F.avg("error"), 6).alias("miss")).withColumn("host", F.lit("b")), ["file", "model"],
    )
)
query("agg_detkpi", "SELECT round(avg(CAST(l_quantity > 5 AS INTEGER)), 4) AS header, round(avg(CAST(l_discount > 0.01 AS INTEGER)), 4) AS rows, round(0.6 * avg(CAST(l_quantity > 5 AS INTEGER)) + 0.4 * avg(CAST(l_discount > 0.01 AS INTEGER)), 4) AS score FROM lineitem")(
    lambda spark, d: stats.weighted_score(table(spark, d, "lineitem").select((F.col("l_quantity") > 5).alias("header"), (F.col("l_discount") > 0.01).alias("rows")), {"header": 0.6, "rows": 0.4})
)
query(
    "agg_ols_simple",
    "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coef, round(regr_r2(l_extendedprice, l_quantity), 4) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 2), round(regr_r2(l_extendedprice, l_quantity), 4) FROM lineitem",
)(lambda spark, d: stats.least_squares(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice").select("term", F.round("coef", 2).alias("coef"), F.round("r2", 4).alias("r2")))
query("agg_ols")(lambda spark, d: stats.least_squares(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"))
query(
    "agg_bench_progress",
    "SELECT event_type, count(*) AS done, round(avg(CASE WHEN value > 0 THEN value END), 4) AS mean_s, greatest(3000 - count(*), 0) AS \"left\", round(greatest(3000 - count(*), 0) * round(avg(CASE WHEN value > 0 THEN value END), 15), 2) AS eta_s FROM events GROUP BY 1",
)(lambda spark, d: stats.progress(table(spark, d, "events").select("event_type", F.col("value").alias("duration")), ["event_type"], 3000))
TICKS = "SELECT event_type, epoch(date_trunc('hour', ts)) AS t, count(*) AS n FROM events GROUP BY 1, 2"
query(
    "st_rate_window",
    f"WITH h AS ({TICKS}), k AS (SELECT event_type, t, row_number() OVER (PARTITION BY event_type ORDER BY t) AS tick, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY t) AS BIGINT) AS c FROM h), x AS (SELECT event_type, tick, last(t) OVER w - first(t) OVER w AS dt, last(c) OVER w - first(c) OVER w AS dc FROM k WINDOW w AS (PARTITION BY event_type ORDER BY tick ROWS 19 PRECEDING)) SELECT event_type, CAST(tick AS INTEGER) AS tick, CASE WHEN dt >= 1 AND dc > 0 THEN round(dc / dt, 4) END AS rate FROM x",
)(lambda spark, d: stats.rates(ticks(spark, d), ["event_type"]))


def ticks(spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("t")
    h = table(spark, d, "events").groupBy("event_type", F.unix_timestamp(F.date_trunc("hour", "ts")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("event_type", "t", F.row_number().over(w).alias("tick"), F.sum("n").over(w).alias("c"))


def truth(d: DataFrame) -> DataFrame:
    return d.select("id", F.coalesce("category", F.lit("X")).alias("category"), F.when(F.col("to_review"), F.lit("?")).otherwise(F.col("subcategory")).alias("subcategory")).dropDuplicates(["id"])


on_ledger(
    "agg_accuracy",
    """, t AS (SELECT DISTINCT ON (id) id, coalesce(category, 'X') AS c, CASE WHEN to_review THEN '?' ELSE subcategory END AS s FROM ledger), p AS (SELECT DISTINCT ON (id) id, amount, category, subcategory, category_source FROM ledger),
 j AS (SELECT CASE WHEN amount < 0 THEN 'expense' ELSE 'income' END AS direction, coalesce(p.category = c AND p.subcategory = s, false) AS exact, coalesce(p.category = c, false) AS fuzzy FROM p JOIN t ON p.id = t.id)
 SELECT direction, count(*) AS n, round(avg(CAST(exact AS INTEGER)), 4) AS exact_rate, round(avg(CAST(fuzzy AS INTEGER)), 4) AS fuzzy_rate, 0.0::DOUBLE AS fell_rate FROM j GROUP BY GROUPING SETS ((direction), ())""",
)(lambda d: stats.accuracy(d.dropDuplicates(["id"]), truth(d), ["id"]))

# ---- text
TERMS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1)"
RETRIEVE = f"""d AS (SELECT doc_id, {TERMS} AS w FROM documents), q AS (SELECT item_id, {TERMS} AS w FROM benchmark),
 dt AS (SELECT doc_id, term, count(*) / any_value(n) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY 1, 2), idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM dt GROUP BY 1),
 dw AS (SELECT doc_id, dt.term, tf * idf AS w FROM dt JOIN idf ON dt.term = idf.term), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
 qt AS (SELECT item_id, term, count(*) / any_value(n) AS tf FROM (SELECT item_id, len(w) AS n, unnest(w) AS term FROM q) GROUP BY 1, 2), qw AS (SELECT item_id, qt.term, tf * coalesce(idf, 1) AS w FROM qt LEFT JOIN idf ON qt.term = idf.term), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
 s AS (SELECT qw.item_id, dw.doc_id, round(sum(qw.w * dw.w) / (any_value(dn.norm) * any_value(qn.norm)), 9) AS score FROM qw JOIN dw ON qw.term = dw.term JOIN dn ON dw.doc_id = dn.doc_id JOIN qn ON qw.item_id = qn.item_id GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0.05)"""
query("ir_tfidf", f"WITH {RETRIEVE} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")(
    lambda spark, d: text.retrieve(table(spark, d, "documents"), table(spark, d, "benchmark"), 3, 0.05).withColumn("score", F.round("score", 6))
)
query("ir_faq", f"WITH {RETRIEVE} SELECT b.item_id, r.doc_id AS faq_id, round(score, 6) AS score FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id AND rank = 1 AND score > 0.3")(
    lambda spark, d: text.answer(table(spark, d, "documents").withColumnRenamed("doc_id", "faq_id"), table(spark, d, "benchmark")).withColumn("score", F.round("score", 6))
)
# one step a paragraph: it joins the open chunk if both have room, else it opens the next
query(
    "src_faq",
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL),
 g(r, i, chunk, open) AS (SELECT r, CAST(1 AS BIGINT), 0, p[1] FROM d WHERE len(p) > 0 UNION ALL SELECT d.r, i + 1, CASE WHEN length(open) + length(p[i + 1]) + 2 <= 500 THEN chunk ELSE chunk + 1 END, CASE WHEN length(open) + length(p[i + 1]) + 2 <= 500 THEN open || chr(10) || chr(10) || p[i + 1] ELSE p[i + 1] END FROM g JOIN d ON g.r = d.r WHERE i < len(p))
 SELECT doc_id, chunk, md5(arg_max(open, i)) AS h FROM g JOIN d ON g.r = d.r GROUP BY g.r, doc_id, chunk""",
)(lambda spark, d: text.chunks(table(spark, d, "documents")).select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("h")))


def asked(d: DataFrame) -> DataFrame:
    """The model slot of the cascade, filled by the stand-in, checked against the taxonomy."""
    back = model.KeywordBackend({"ring": {"category": "ECONOMY", "subcategory": "Brand#12"}, "bolt": {"category": "nonsense", "subcategory": "Brand#13"}, "nut": {"category": "a", "subcategory": "b"}})
    tax = d.sparkSession.createDataFrame([("ECONOMY", "Brand#12"), ("PROMO", "Brand#13")], "category string, subcategory string")
    return model.checked(model.ask(d, F.col("description"), [back], ["category", "subcategory"]), tax)


on_ledger(
    "cs_validate_llm",
    """ SELECT DISTINCT description AS prompt, CASE WHEN contains(description, 'ring') THEN 'ECONOMY' WHEN contains(description, 'bolt') THEN 'PROMO' END AS category, CASE WHEN contains(description, 'ring') THEN 'Brand#12' WHEN contains(description, 'bolt') THEN 'Brand#13' END AS subcategory,
 CASE WHEN contains(description, 'ring') THEN 'medium' ELSE 'low' END AS category_confidence, CASE WHEN contains(description, 'ring') OR contains(description, 'bolt') OR contains(description, 'nut') THEN 'keyword' ELSE 'quarantine' END AS backend FROM ledger""",
)(asked)
on_ledger("cl_clean_desc", "SELECT DISTINCT description, CASE WHEN contains(description, 'ring') THEN 'Ring shop' END AS cleaned FROM ledger")(
    lambda d: model.ask(d, F.col("description"), [model.KeywordBackend({"ring": {"text": "Ring shop"}, "bolt": {"text": "null"}})], ["text"]).select(
        F.col("prompt").alias("description"), model.usable_description(F.col("text"), F.col("prompt")).alias("cleaned")
    )
)
query(
    "agg_patterns_union",
    "SELECT pattern, min_by(id, id * 10 + pos) AS id, min_by(pos, id * 10 + pos) AS pos FROM (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS pattern, unnest(range(0, len(string_split(p_name, ' ')))) AS pos FROM part WHERE p_size % 4 <> 0) GROUP BY 1",
)(
    # footer patterns of schemas as JSON lists: the words of each part's name, and none for a quarter of them
    lambda spark, d: roles.patterns_union(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 4 != 0, F.to_json(F.split("p_name", " "))).alias("patterns"))).select("pattern", "first.id", F.col("first.pos").cast("long").alias("pos"))
)
query("agg_hw", "SELECT event_type, round(avg(value), 3) AS cpu_avg, max(value) AS cpu_max, round(avg(CASE WHEN value - 100 > 0 THEN value - 100 END), 3) AS power_avg, max(CASE WHEN value - 100 > 0 THEN value - 100 END) AS power_max FROM events GROUP BY 1")(
    lambda spark, d: roles.hardware(table(spark, d, "events").select("event_type", F.col("value").alias("cpu"), (F.col("value") - 100).alias("power")), ["event_type"])
)
GROUPS = [("file_1.csv", "G1"), ("file_2.csv", "G2")]
on_ledger("sc_commit_group", "SELECT CASE source_file WHEN 'file_1.csv' THEN 'G1' WHEN 'file_2.csv' THEN 'G2' ELSE 'UNKNOWN' END AS \"group\", count(*) AS n FROM ledger GROUP BY 1")(
    lambda d: roles.commit_groups(d.withColumnRenamed("source_file", "commit"), d.sparkSession.createDataFrame(GROUPS, "commit string, `group` string")).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
)
query("agg_bench_session", "SELECT o_orderpriority AS version, count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderpriority = (SELECT max(o_orderpriority) FROM orders)) GROUP BY 1")(
    lambda spark, d: roles.latest_session(table(spark, d, "orders").select(F.col("o_orderpriority").alias("version"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"))).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
)
CATALOGUE = "SELECT DISTINCT p_name AS name, p_type AS tag FROM part"
query("src_brand_build", f"WITH c AS ({CATALOGUE}) SELECT '\\b' || replace(lower(name), ' ', '\\s+') || '\\b' AS pattern, tag AS osm_tag, CAST(row_number() OVER (ORDER BY length(replace(name, ' ', '\\s+')) DESC, replace(lower(name), ' ', '\\s+'), tag) - 1 AS INTEGER) AS rule_idx FROM c WHERE length(name) <= 25")(
    lambda spark, d: roles.brand_rules(table(spark, d, "part").select(F.concat("p_name", F.lit(" S.p.A. (Italia)")).alias("name"), F.col("p_type").alias("osm_tag"), F.array().cast("array<string>").alias("countries")).distinct().withColumn("name", F.regexp_replace("name", r" S\.p\.A\.", " spa"))).drop("countries")
)
on_ledger("sc_legacy_clean", """, w AS (SELECT id, list_filter(regexp_split_to_array(upper(description), '[^A-Z]+'), lambda x: x <> '') AS w FROM ledger WHERE description IS NOT NULL), c AS (SELECT x, count(*) AS c FROM (SELECT unnest(w) AS x FROM w) GROUP BY 1),
 k AS (SELECT list(x) AS common FROM c WHERE c > (SELECT sum(c) FROM c) * 0.05) SELECT id, array_to_string(list_filter(w, lambda x: NOT list_contains(common, x)), ' ') AS text FROM w, k""")(lambda d: roles.common_words_removed(d.where("description is not null")))
on_ledger("inf_legacy_year", "SELECT batch_id AS y, CASE WHEN batch_id <= 30 THEN batch_id + 2000 ELSE batch_id + 1900 END AS year FROM ledger GROUP BY 1")(lambda d: d.groupBy(F.col("batch_id").alias("y")).agg(F.count(F.lit(1)).alias("n")).select("y", roles.expand_year(F.col("y")).alias("year")))
