"""Aggregates, bins and audits over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.numeric import bin_index, nearest_standard
from sparkloom.functions.text import lookup
from sparkloom.operators import aggregate, rollouts, select
from sparkloom.queries import query, table


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' GROUP BY ALL""")
def pricing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2000-01-01'")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, round(quantile_cont(r, 0.1), 6) AS q10, round(quantile_cont(r, 0.5), 6) AS q50, round(quantile_cont(r, 0.9), 6) AS q90,
 round(avg((r <= 0)::INT::DOUBLE), 6) AS zero_fraction, round(avg((r >= 1)::INT::DOUBLE), 6) AS perfect_fraction, round(corr(r, n), 4) AS length_correlation FROM (SELECT (l_quantity - 1) / 45.0::DOUBLE AS r, l_linenumber::DOUBLE AS n FROM lineitem)""")
def reward_audit_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 1) / 45.0).alias("r"), "l_linenumber")
    out = aggregate.audit_scalars(rows, "r", "l_linenumber")
    return out.select(*(F.round(c, 4 if c == "length_correlation" else 6).alias(c) for c in out.columns))


@query("""
WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS c, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2), g AS (SELECT l_orderkey, sum(c)::BIGINT AS n, count(*) AS u, min(lo) AS lo, max(hi) AS hi FROM c GROUP BY 1)
SELECT g.l_orderkey, any_value(g.n) AS n, round(any_value(g.u / g.n::DOUBLE), 6) AS unique_fraction, round(sum(-(c.c / g.n::DOUBLE) * ln(c.c / g.n::DOUBLE + 1e-12)) / ln(greatest(any_value(g.n), 2)), 6) + 0.0 AS entropy,
 any_value(g.u = 1 AND g.n > 1) AS collapsed, any_value(g.hi = g.lo) AS no_signal FROM g JOIN c USING (l_orderkey) GROUP BY 1""")
def answer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.answer_entropy(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity")
    return out.withColumn("unique_fraction", F.round("unique_fraction", 6)).withColumn("entropy", F.round("entropy", 6) + 0.0)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity >= 30 THEN 3 WHEN l_quantity >= 15 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS bin,
 CASE WHEN abs(q.v - l_quantity) <= 2 THEN q.v END AS standard FROM lineitem, LATERAL (SELECT list_min([{'d': abs(l_quantity - s), 'v': s} FOR s IN [5.0::DOUBLE, 10.0, 15.0, 20.0]]).v AS v) q""")
def bin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bin_index(q, [0, 5, 15, 30]).alias("bin"), nearest_standard(q, [5, 10, 15, 20], 2.0).alias("standard"))


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT o_custkey, arg_max(o_orderpriority, n * 1000000000 - f) AS mode FROM c GROUP BY 1""")
def first_seen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.first_mode(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""
SELECT CASE WHEN grouping(event_type) = 1 THEN 'Average' ELSE event_type END AS event_type, round(avg((value > 20)::INT::DOUBLE) * 100, 6) AS accuracy FROM events GROUP BY ROLLUP (event_type)""")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.category_accuracy(table(spark, sf_dir, "events"), "event_type", F.col("value") > 20).withColumn("accuracy", F.round("accuracy", 6))


@query("""
SELECT round(avg(n_chars), 6) AS mean, max(n_chars) AS max, min(n_chars) AS min, round(avg((n_chars >= 10000)::INT::DOUBLE), 6) AS clip_ratio FROM documents""")
def length_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.length_metrics(table(spark, sf_dir, "documents"), "n_chars", 10_000).withColumn("mean", F.round("mean", 6)).withColumn("clip_ratio", F.round("clip_ratio", 6))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount < 0.05 AS ok FROM lineitem), s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM v WHERE ok)
SELECT l_orderkey, l_linenumber, l_partkey, round((x - s / (n + 1e-8)) / sqrt(((q / (n + 1e-8)) - (s / (n + 1e-8)) * (s / (n + 1e-8))) * n / (n - 1) + 1e-8), 5) AS white FROM v, s""")
def masked_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), "l_discount")
    return aggregate.whiten(rows, "x", F.col("l_discount") < 0.05, "white").select("l_orderkey", "l_linenumber", "l_partkey", F.round("white", 5).alias("white"))


@query("""
SELECT round(1 - var_samp(l_quantity - l_linenumber) / (var_samp(l_quantity) + 1e-5), 6) AS explained_variance FROM lineitem""")
def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.explained_variance(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity").select(F.round("explained_variance", 6).alias("explained_variance"))


@query("""
WITH s AS (SELECT doc_id % 8 AS p, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, (max(s) - min(s))::BIGINT AS spread, round(avg(s), 4) AS mean FROM s""")
def sequence_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.imbalance(table(spark, sf_dir, "documents").withColumn("p", F.col("doc_id") % 8), "p", "n_chars").withColumn("mean", F.round("mean", 4))


@query()
def kk_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    dealt = select.balanced_partitions(docs, "n_chars", "doc_id", 4, group=["source"])
    return dealt.groupBy("source", "partition").agg(F.sum("n_chars").alias("total"), F.count(F.lit(1)).alias("n"))


@query()
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("p"), F.expr("substring(text, 50)").alias("r"))
    out = aggregate.similarity(docs, "p", "r")
    return out.select("doc_id", *(F.round(c, 4).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY avg(l_quantity) OVER (PARTITION BY l_orderkey) > 20 AND avg(l_quantity) OVER (PARTITION BY l_orderkey) < 25""")
def online_filter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return rollouts.online_filter(items, "l_orderkey", "l_quantity", 20, 25)


@query("""
SELECT CASE event_type WHEN 'view' THEN 'look' WHEN 'click' THEN 'press' ELSE event_type END AS task, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY 1""")
def task_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(lookup(F.col("event_type"), {"view": "look", "click": "press"}).alias("task")).agg(F.round(F.avg("value"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT sum(n_chars)::BIGINT AS tokens, sum(doc_id % 7 + 1)::BIGINT AS seconds, round(sum(n_chars) / (sum(doc_id % 7 + 1) * 8)::DOUBLE, 6) AS tokens_per_second_device FROM documents""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars", (F.col("doc_id") % 7 + 1).alias("s"))
    return aggregate.throughput(docs, "n_chars", "s", 8).withColumn("tokens_per_second_device", F.round("tokens_per_second_device", 6))
