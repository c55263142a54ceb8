"""Joins: equi with missing counts, contains, pairs, bands, as-of, intervals, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.numeric import box_overlap, jaccard
from sparkloom.operators import joins, select
from sparkloom.queries import query, table


@query("""
SELECT coalesce(c.c_mktsegment, 'missing') AS segment, count(*) AS n FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_custkey % 10 <> 3 GROUP BY 1""")
def trace_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return joined.groupBy(F.coalesce("c_mktsegment", F.lit("missing")).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT 'a' || s_suppkey AS key, s_name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'b' || s_suppkey, s_name || '!' FROM supplier WHERE s_suppkey % 3 = 0)
SELECT p_partkey, coalesce(x.key, y.key) AS key, coalesce(x.s_name, y.s_name) AS s_name FROM part p LEFT JOIN k x ON x.key = 'a' || (p_partkey % 50) LEFT JOIN k y ON y.key = 'b' || (p_partkey % 50)""")
def multi_key_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    keyed = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("key"), "s_name").union(s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")), F.concat("s_name", F.lit("!"))))
    part = table(spark, sf_dir, "part").select("p_partkey")
    k = (F.col("p_partkey") % 50).cast("string")
    return joins.multi_key_join(part, keyed, [F.concat(F.lit("a"), k), F.concat(F.lit("b"), k)], "key")


@query("""
SELECT 'with' AS kind, count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey) UNION ALL
SELECT 'without', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""")
def semi_anti_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    one = lambda how, kind: c.join(o, "c_custkey", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("left_semi", "with").union(one("left_anti", "without"))


@query("""
SELECT a.p_brand, a.p_type, a.p_partkey AS a_p_partkey, b.p_partkey AS b_p_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey WHERE abs(a.p_size - b.p_size) <= 2 AND abs(a.p_retailprice - b.p_retailprice) >= 30""")
def self_pair_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", "p_size", "p_retailprice")
    pairs = joins.pairs_within(part, ["p_brand", "p_type"], "p_partkey", lambda a, b: f"abs({a}p_retailprice - {b}p_retailprice) >= 30", band=("p_size", 2.0))
    return pairs.select("p_brand", "p_type", "a_p_partkey", "b_p_partkey")


@query("""
SELECT a.s_suppkey, count(b.s_suppkey) AS neighbours FROM supplier a LEFT JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 150 GROUP BY 1""")
def band_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.band_count(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 150.0).groupBy("s_suppkey").agg(F.sum("neighbours").alias("neighbours"))


@query("""
SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) <= 40""")
def band_join_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    return joins.band_join(s, c, "s_acctbal", "c_acctbal", 40.0, ["nation"]).select("s_suppkey", "c_custkey")


@query("""
SELECT p.p_partkey, EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey < p.p_partkey AND abs(q.p_size - p.p_size) <= 2 AND abs(q.p_retailprice - p.p_retailprice) <= 6) AS has_earlier FROM part p""")
def bucket_near_dup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return joins.earlier_near(part, ["p_brand"], "p_partkey", "p_size", 2.0, "p_retailprice", 6.0, "has_earlier").select("p_partkey", "has_earlier")


@query()
def greedy_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return joins.greedy_near_duplicates(part, ["p_brand"], ["p_partkey"], lambda a, b: abs(a["p_size"] - b["p_size"]) <= 2 and abs(a["p_retailprice"] - b["p_retailprice"]) <= 6)


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), v AS (SELECT user_id, epoch_us(ts) AS t, event_id AS near FROM events WHERE event_type = 'view'),
b AS (SELECT e.*, v.t AS bt, v.near AS bn FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.t >= v.t), a AS (SELECT e.event_id, v.t AS ta, v.near AS an FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.t <= v.t)
SELECT b.event_id, CASE WHEN ta IS NULL OR t - bt <= ta - t THEN bn ELSE an END AS near_event_id FROM b JOIN a USING (event_id)""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    errors, views = (events.where(F.col("event_type") == k).drop("event_type") for k in ("error", "view"))
    found = joins.asof_nearest(errors, views, "t", ["user_id"], right_columns=["event_id"], gap=lambda a, b: F.abs(a - b))
    return found.select("event_id", "near_event_id")


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 60 + (o_orderkey % 90) AS e FROM orders)
SELECT a.o_custkey, a.o_orderkey AS a_o_orderkey, b.o_orderkey AS b_o_orderkey, round((least(a.e, b.e) - greatest(a.s, b.s) + 1) / (greatest(a.e, b.e) - least(a.s, b.s) + 1)::DOUBLE, 6) AS iou
FROM w a JOIN w b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.s <= b.e AND b.s <= a.e""")
def interval_overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    w = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", start.alias("s"), (start + 60 + F.col("o_orderkey") % 90).alias("e"))
    return joins.interval_overlaps(w, ["o_custkey"], "o_orderkey", "s", "e", 150).select("o_custkey", "a_o_orderkey", "b_o_orderkey", F.round("iou", 6).alias("iou"))


@query()
def nms_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    w = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice"), start.alias("s"), (start + 60 + F.col("o_orderkey") % 90).cast("long").alias("e"))
    return select.grouped_greedy(w, ["o_custkey"], ["o_totalprice", "o_orderkey"], select.pick_non_overlapping("s", "e", 0.1, 12))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lag(l_quantity) OVER w, last_value(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS mismatched
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)""")
def mismatched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.row_number().over(w).alias("i"))
    return joins.shifted_pairs(items, "l_orderkey", "i", "l_quantity", "mismatched").select("l_orderkey", "l_linenumber", "l_partkey", "mismatched")


@query("""
SELECT o_custkey, "1-URGENT" AS urgent, "5-LOW" AS low FROM (SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT", min(o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW" FROM orders GROUP BY 1) WHERE "1-URGENT" IS NOT NULL AND "5-LOW" IS NOT NULL""")
def pivot_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("k"))
    return joins.pivot_required(firsts, "o_custkey", "o_orderpriority", "k", ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@query("""
SELECT p.p_partkey, p.p_brand, p.p_size FROM part p JOIN (SELECT p_partkey, p_size AS other FROM part) q USING (p_partkey) WHERE p.p_size = q.other""")
def horizontal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return joins.horizontal_union(part.select("p_partkey", "p_brand", "p_size"), part.select("p_partkey", "p_size"), "p_partkey")


@query("""
WITH m AS (SELECT o_orderkey, [o_custkey, o_custkey + 1, o_custkey + 2] AS ks FROM orders), x AS (SELECT o_orderkey, unnest(ks) AS c_custkey, generate_subscripts(ks, 1) AS i FROM m)
SELECT o_orderkey, string_agg(c_name, ',' ORDER BY i) AS names FROM x JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 1) USING (c_custkey) GROUP BY 1 HAVING count(*) = 3""")
def lookup_all_or_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = F.array(*(F.struct((F.col("o_custkey") + i).alias("c_custkey")) for i in range(3)))
    customers = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select("c_custkey", "c_name")
    found = joins.lookup_all(orders, "o_orderkey", items, customers, ["c_custkey"], 3)
    return found.select("o_orderkey", F.array_join(F.transform("rows", lambda r: r["c_name"]), ",").alias("names"))


@query("""
WITH s AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""")
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("w").alias("wa")), docs.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, "a").select("a", "b", F.round(jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity"))


@query("""
SELECT a.p_partkey, round(greatest(0, least(a.p_size, b.p_size)) * greatest(0, least(a.p_size, 20) - 5) / greatest(1.0, (a.p_size * (a.p_size - 5))::DOUBLE), 6) AS overlap FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size > 5""")
def box_overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"))
    pairs = part.where("s > 5").join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("s").alias("s2")), "p_partkey")
    a = [F.lit(0.0), F.lit(5.0), F.col("s"), F.col("s")]
    b = [F.lit(0.0), F.lit(0.0), F.col("s2"), F.lit(20.0)]
    return pairs.select("p_partkey", F.round(box_overlap(a, b), 6).alias("overlap"))


@query("""
WITH f AS (SELECT regr_slope(t, i) AS m, regr_intercept(t, i) AS c FROM (SELECT l_linenumber::DOUBLE AS i, l_quantity AS t FROM lineitem))
SELECT round(any_value(m), 4) AS slope, round(any_value(c), 4) AS "offset", round(max(abs(l_quantity - (m * l_linenumber + c))), 4) AS worst FROM lineitem, f""")
def affine_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("i"), F.col("l_quantity").alias("t"))
    return joins.affine_time(items, "i", "t").select(*(F.round(c, 4).alias(c) for c in ("slope", "offset", "worst")))


@query("""
WITH s(v) AS (VALUES (0), (3), (6)), a(v) AS (VALUES (0), (15), (30)), p(v) AS (VALUES (0), (4), (8), (12))
SELECT s.v AS straight, a.v AS angle, p.v AS path, (abs(s.v - 3) // 3 + abs(a.v - 15) // 15 + abs(p.v - 4) // 4)::BIGINT AS distance FROM s, a, p""")
def option_bin_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.range(1).select(F.explode(F.array(*map(F.lit, (0, 3, 6)))).alias("straight")).withColumn("angle", F.explode(F.array(*map(F.lit, (0, 15, 30))))).withColumn("path", F.explode(F.array(*map(F.lit, (0, 4, 8, 12)))))
    distance = F.floor(F.abs(F.col("straight") - 3) / 3) + F.floor(F.abs(F.col("angle") - 15) / 15) + F.floor(F.abs(F.col("path") - 4) / 4)
    return base.withColumn("distance", distance)
