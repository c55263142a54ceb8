"""Rewards, advantages, returns and divergences (orders as groups, their lines as rollouts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.answers import reward_target, with_score
from sparkloom.functions.numeric import decayed_weight
from sparkloom.operators import rollouts
from sparkloom.queries import query, table

ROWS = "r AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))::INTEGER AS i, l_quantity AS x FROM lineitem)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("i"), F.col("l_quantity").alias("x"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and xs: the group's rewards in order."""
    return rows(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("xs"))


@query(f"""
WITH {ROWS} SELECT l_orderkey, i, round(coalesce((x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6), 0), 5) + 0.0 AS advantage FROM r WINDOW w AS (PARTITION BY l_orderkey)""")
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.group_advantage(rows(spark, sf_dir), "l_orderkey", "x").select("l_orderkey", "i", (F.round("advantage", 5) + 0.0).alias("advantage"))


@query(f"""
WITH {ROWS}, o AS (SELECT *, row_number() OVER o AS k, (x - lead(x) OVER o) / (stddev_samp(x) OVER (PARTITION BY l_orderkey) + 1e-6) AS a FROM r WINDOW o AS (PARTITION BY l_orderkey ORDER BY x DESC, i)) SELECT l_orderkey, i, round(CASE WHEN k = 1 THEN coalesce(a, 0) ELSE 0 END, 5) AS advantage FROM o""")
def passk_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.pass_at_k_advantage(rows(spark, sf_dir), "l_orderkey", "x", "i").select("l_orderkey", "i", F.round("advantage", 5).alias("advantage"))


@query(f"""
WITH {ROWS} SELECT l_orderkey, i, round(x - CASE WHEN count(*) OVER w > 1 THEN (sum(x) OVER w - x) / (count(*) OVER w - 1) ELSE 0 END, 5) AS advantage FROM r WINDOW w AS (PARTITION BY l_orderkey)""")
def loo_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.leave_one_out_advantage(rows(spark, sf_dir), "l_orderkey", "x").select("l_orderkey", "i", F.round("advantage", 5).alias("advantage"))


@query(f"""
WITH {ROWS} SELECT a.l_orderkey, a.i, sum(pow(0.5, b.i - a.i) * b.x) AS ret FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.i >= a.i GROUP BY ALL""")
def reverse_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = arrays(spark, sf_dir).select("l_orderkey", F.posexplode(rollouts.discounted_returns(F.col("xs"), 0.5)).alias("p", "ret"))
    return returns.select("l_orderkey", (F.col("p") + 1).alias("i"), "ret")


@query(f"""
WITH {ROWS}, d AS (SELECT *, x + 0.5 * coalesce(lead(x / 2) OVER w, 0) - x / 2 AS delta FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY i))
SELECT a.l_orderkey, a.i, sum(pow(0.25, b.i - a.i) * b.delta) AS adv FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND b.i >= a.i GROUP BY ALL""")
def gae_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = rollouts.gae(F.col("xs"), F.transform("xs", lambda x: x / 2), 0.5, 0.5)
    out = arrays(spark, sf_dir).select("l_orderkey", F.posexplode(g["advantages"]).alias("p", "adv"))
    return out.select("l_orderkey", (F.col("p") + 1).alias("i"), "adv")


@query(f"""
WITH {ROWS} SELECT l_orderkey, i, sum(x) OVER (PARTITION BY l_orderkey ORDER BY i DESC) AS rest FROM r""")
def reverse_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.reverse_cumulative(rows(spark, sf_dir), "l_orderkey", "i", "x", "rest").select("l_orderkey", "i", "rest")


@query(f"""
WITH {ROWS} SELECT l_orderkey, i, (row_number() OVER (PARTITION BY l_orderkey ORDER BY x DESC, i))::INTEGER AS rank FROM r""")
def rank_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollouts.rank_in_group(rows(spark, sf_dir), "l_orderkey", "x", "i").select("l_orderkey", "i", "rank")


@query(f"""
WITH {ROWS}, k AS (SELECT l_orderkey, i, -x / 10 AS p, -x / 12 - 0.1 AS q FROM r)
SELECT l_orderkey, i, round(p - q, 6) + 0.0 AS kl, round(abs(p - q), 6) AS abs, round(0.5 * (p - q) * (p - q), 6) AS mse, round(greatest(-10, least(10, exp(greatest(-20, least(20, q - p))) - greatest(-20, least(20, q - p)) - 1)), 6) AS low_var FROM k""")
def kl_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = -F.col("x") / 10, -F.col("x") / 12 - 0.1
    return rows(spark, sf_dir).select("l_orderkey", "i", *((F.round(rollouts.kl(p, q, k), 6) + 0.0).alias(k) for k in ("kl", "abs", "mse", "low_var")))


@query(f"""
WITH {ROWS}, t AS (SELECT l_orderkey, ln(x / sum(x) OVER w) AS p, ln((51 - x) / sum(51 - x) OVER w) AS q FROM r WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, round(least(2.0, greatest(0, sum(exp(p) * (p - q)))), 5) AS fkl FROM t GROUP BY 1""")
def topk_forward_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    other = F.transform("xs", lambda x: 51 - x)
    a = arrays(spark, sf_dir).withColumn("o", other).withColumn("s", total(F.col("xs"))).withColumn("t", total(F.col("o")))
    p, q = F.transform("xs", lambda x: F.ln(x / F.col("s"))), F.transform("o", lambda x: F.ln(x / F.col("t")))
    return a.select("l_orderkey", F.round(rollouts.topk_forward_kl(p, q, 2.0), 5).alias("fkl"))


@query(f"""
WITH {ROWS}, p AS (SELECT l_orderkey, i, (x - 25) / 25 AS adv, exp(greatest(-20, least(20, (i - 3) / 10.0::DOUBLE))) AS ratio FROM r), w AS (SELECT *, greatest(-adv * ratio, -adv * greatest(0.8, least(1.3, ratio))) AS worst FROM p)
SELECT l_orderkey, i, round(CASE WHEN adv < 0 THEN least(worst, -adv * 3) ELSE worst END, 6) + 0.0 AS loss FROM w""")
def policy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    loss = rollouts.policy_loss(F.lit(0.0), (F.col("i") - 3) / 10.0, (F.col("x") - 25) / 25)
    return rows(spark, sf_dir).select("l_orderkey", "i", (F.round(loss, 6) + 0.0).alias("loss"))


@query(f"""
WITH {ROWS}, m AS (SELECT *, CASE WHEN i % 2 = 1 THEN 1 ELSE 0 END AS m FROM r), s AS (SELECT l_orderkey, sum(x * m) AS a, sum(m) AS n FROM m GROUP BY 1)
SELECT (SELECT round(sum(x * m) / greatest(sum(m), 1e-6), 5) FROM m) AS token, round(avg(a), 5) AS seq_sum, round(avg(a / greatest(n, 1e-6)), 5) AS seq_mean FROM s""")
def loss_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("m", F.when(F.col("i") % 2 == 1, 1).otherwise(0))
    one = lambda mode: rollouts.average_loss(r, "l_orderkey", "x", "m", mode).select(F.round("loss", 5).alias(mode))
    return one("token").crossJoin(one("seq_sum")).crossJoin(one("seq_mean"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size <= 10 THEN 0.5 ELSE greatest(0, 0.5 * (1 - (p_size - 10) / 20.0::DOUBLE)) END, 6) AS weight FROM part""")
def weight_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(decayed_weight(F.col("p_size"), 0.5, 10, 20), 6).alias("weight"))


@query()
def ema_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("l_orderkey", F.to_json(F.transform(rollouts.ema(F.col("xs")), lambda x: F.round(x, 4))).alias("smooth"))


@query("""
WITH p AS (SELECT p_partkey, substr('ABCDE', 1 + (p_partkey % 5)::INTEGER, 1) AS said, substr('ABCDE', 1 + (p_partkey % 3)::INTEGER, 1) AS gold, p_partkey % 4 AS form, p_size FROM part)
SELECT p_partkey, round(CASE form WHEN 0 THEN 0.9 * (said = gold)::INT + 0.1 WHEN 1 THEN 0.9 * (said = gold)::INT WHEN 2 THEN 0.9 * greatest(0, 1 - abs(p_size - 20) / 20.0::DOUBLE) + 0.1 ELSE 0.9 * ((said = gold)::INT + 1) / 2.0 + 0.1 END, 6) AS overall,
 round(CASE form WHEN 2 THEN greatest(0, 1 - abs(p_size - 20) / 20.0::DOUBLE) WHEN 3 THEN ((said = gold)::INT + 1) / 2.0 ELSE (said = gold)::INT END, 6)::DOUBLE AS task, CASE WHEN form = 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS format FROM p""")
def reward_parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four forms of answers: native, bare letter without reasoning, number in tags, JSON with two fields."""
    i = F.col("p_partkey")
    said, gold = F.substring(F.lit("ABCDE"), 1 + i % 5, F.lit(1)), F.substring(F.lit("ABCDE"), 1 + i % 3, F.lit(1))
    response = F.when(i % 4 == 0, F.concat(F.lit("Because it moves.\nAnswer: "), said)).when(i % 4 == 1, said).when(i % 4 == 2, F.concat(F.lit("<COT>near</COT><answer>"), F.col("p_size").cast("string"), F.lit("</answer>"))).otherwise(F.concat(F.lit('<COT>x</COT><answer>{"path":"'), said, F.lit('","angle":"B"}</answer>')))
    truth = F.when(i % 4 == 2, F.lit('{"reward_family":"numeric_mra","value":20}')).when(i % 4 == 3, F.concat(F.lit('{"reward_family":"multi_choice","fields":{"path":"'), gold, F.lit('","angle":"B"}}'))).otherwise(F.concat(F.lit('{"reward_family":"choice","choice_gold":"'), gold, F.lit('"}')))
    scored = with_score(table(spark, sf_dir, "part").select("p_partkey", response.alias("response"), truth.alias("truth")), "response", "truth", "s")
    return scored.select("p_partkey", F.round("s.overall", 6).alias("overall"), F.round("s.task", 6).alias("task"), F.col("s.format").alias("format"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'multi_choice' WHEN 1 THEN 'numeric_mra' ELSE 'choice' END AS family, CASE p_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN (p_size + 0.5)::DOUBLE::VARCHAR ELSE 'B' END AS gold FROM part""")
def reward_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    metadata = F.when(i % 3 == 0, F.lit('{"correct_options":{"path":"c"},"value":3}')).when(i % 3 == 1, F.concat(F.lit('{"value_m":'), (F.col("p_size") + 0.5).cast("string"), F.lit("}"))).otherwise(F.lit("{}"))
    target = reward_target(metadata, F.lit("the option is B"))
    get = lambda p: F.get_json_object(target, p)
    return table(spark, sf_dir, "part").select("p_partkey", get("$.reward_family").alias("family"), F.coalesce(get("$.fields.path"), get("$.value"), get("$.choice_gold")).alias("gold"))
