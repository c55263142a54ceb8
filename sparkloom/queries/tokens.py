"""Token-level losses, masks and batches (orders as sequences, their lines as tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import aggregate, rollouts, training
from sparkloom.queries import query, table
from sparkloom.queries.rewards import ROWS, rows

#: Log probabilities before and after, advantage and mask of each token.
TOKENS = f"{ROWS}, k AS (SELECT l_orderkey, i, x, -x / 10 AS old, -x / 11 - 0.02 * i AS new, (x - 25) / 25 AS adv, (i % 3 <> 0)::INTEGER AS m FROM r)"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, i = F.col("x"), F.col("i")
    return rows(spark, sf_dir).select("l_orderkey", "i", "x", (-x / 10).alias("old"), (-x / 11 - 0.02 * i).alias("new"), ((x - 25) / 25).alias("adv"), (i % 3 != 0).cast("int").alias("m"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey with an array of each column, in the order of i."""
    names = ["i", "x", "old", "new", "adv", "m"]
    packed = tokens(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("t"))
    return packed.select("l_orderkey", *(F.col(f"t.{c}").alias(c) for c in names))


@query(f"""
WITH {TOKENS}, l AS (SELECT *, new - old AS d, sum((new - old) * m) OVER w / (sum(m) OVER w + 1e-8) AS mean FROM k WINDOW w AS (PARTITION BY l_orderkey)),
q AS (SELECT *, exp(greatest(-20, least(20, d))) AS ratio, exp(greatest(-20, least(20, mean * m))) AS gr, exp(greatest(-20, least(20, mean))) AS tr FROM l),
n AS (SELECT *, greatest(0.8, least(1.3, ratio)) AS near, greatest(-adv * gr, -adv * greatest(0.8, least(1.3, gr))) AS gw, greatest(-adv * tr, -adv * greatest(0.8, least(1.3, tr))) AS tw FROM q)
SELECT l_orderkey, i, round(CASE WHEN adv < 0 THEN least(gw, -adv * 3) ELSE gw END, 6) + 0.0 AS gspo, round(CASE WHEN adv < 0 THEN least(tw, -adv * 3) ELSE tw END, 6) + 0.0 AS gspo_token,
 round(-adv * new * near, 6) + 0.0 AS cispo, round(-adv * CASE WHEN adv >= 0 THEN 4 / (1 + exp(-(ratio - 1))) ELSE 4 / 1.05 / (1 + exp(-1.05 * (ratio - 1))) END, 6) + 0.0 AS sapo FROM n""")
def sequence_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four policy losses of each token."""
    kinds = ("gspo", "gspo_token", "cispo", "sapo")
    losses = [rollouts.sequence_policy_losses(F.col("old"), F.col("new"), F.col("adv"), F.col("m"), k).alias(k) for k in kinds]
    each = sequences(spark, sf_dir).select("l_orderkey", F.explode(F.arrays_zip(F.col("i"), *losses)).alias("t"))
    return each.select("l_orderkey", "t.i", *((F.round(f"t.{k}", 6) + 0.0).alias(k) for k in kinds))


@query(f"""
WITH {TOKENS}, c AS (SELECT l_orderkey, i, x / 10 AS v, x / 12 + 0.3 AS t, x / 10 - 0.4 AS o FROM k)
SELECT l_orderkey, i, round(0.5 * greatest((v - t) ** 2, (greatest(o - 0.2, least(o + 0.2, v)) - t) ** 2), 6) AS loss FROM c""")
def value_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return tokens(spark, sf_dir).select("l_orderkey", "i", F.round(rollouts.value_loss(x / 10, x / 12 + 0.3, x / 10 - 0.4, 0.2), 6).alias("loss"))


@query(f"""
WITH {TOKENS} SELECT l_orderkey, i, round(x - 0.1 * (new - old), 6) AS reward FROM k""")
def penalised_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("l_orderkey", "i", F.round(rollouts.penalised(F.col("x"), F.col("new"), F.col("old"), 0.1), 6).alias("reward"))


@query(f"""
WITH {TOKENS}, q AS (SELECT *, exp(greatest(-20, least(20, new - old))) AS ratio FROM k WHERE m <> 0), n AS (SELECT *, -adv * ratio AS plain, -adv * greatest(0.9, least(1.1, ratio)) AS near FROM q)
SELECT round(avg(old - new), 6) AS kl, round(avg((plain < near)::INT), 6) AS clipped_above, round(avg((adv < 0 AND greatest(plain, near) > -adv * 1.05)::INT), 6) AS bounded_below FROM n""")
def loss_clip_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollouts.clip_fractions(tokens(spark, sf_dir), "old", "new", "adv", "m", low=0.1, high=0.1, dual=1.05)
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query("""
SELECT count(*) AS rows, round(avg((toxic = 1)::INT), 6) AS toxic_rows, round(sum(CASE WHEN toxic = 1 THEN n_chars ELSE 0 END) / sum(n_chars)::DOUBLE, 6) AS toxic_tokens, round(avg((quality = 1)::INT), 6) AS good_rows,
 round(sum(CASE WHEN quality = 1 THEN n_chars ELSE 0 END) / sum(n_chars)::DOUBLE, 6) AS good_tokens FROM documents JOIN labels USING (doc_id)""")
def batch_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = rollouts.group_fractions(docs, {"toxic": F.col("toxic") == 1, "good": F.col("quality") == 1}, "n_chars")
    return found.select("rows", *(F.round(c, 6).alias(c) for c in found.columns if c != "rows"))


@query("""
WITH s AS (SELECT p_type, p_brand, avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice, count(*) AS rows FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())),
t AS (SELECT p_type, avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice FROM part GROUP BY 1), u AS (SELECT * FROM s UNION ALL BY NAME SELECT 'macro' AS p_type, NULL AS p_brand, avg(p_size) AS p_size, avg(p_retailprice) AS p_retailprice, count(*) AS rows FROM t)
SELECT p_type, p_brand, rows, round(p_size, 6) AS p_size, round(p_retailprice, 5) AS p_retailprice FROM u""")
def validation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollouts.validation_rollup(table(spark, sf_dir, "part"), "p_type", "p_brand", ["p_size", "p_retailprice"])
    return found.select("p_type", "p_brand", "rows", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 5).alias("p_retailprice"))


@query(f"""
WITH {TOKENS} SELECT l_orderkey, round(sum(x * m) / greatest(sum(m), 1), 6) AS mean, round(avg(CASE WHEN m = 1 THEN (x::BIGINT % 4 = i % 4)::INT END), 6) AS accuracy FROM k GROUP BY 1""")
def masked_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked mean and token accuracy of each sequence."""
    labels = F.zip_with("i", "m", lambda i, m: F.when(m == 1, i % 4).otherwise(training.IGNORE))
    predicted = F.transform("x", lambda x: (x.cast("long") % 4).cast("int"))
    return sequences(spark, sf_dir).select("l_orderkey", F.round(aggregate.masked_mean(F.col("x"), F.col("m")), 6).alias("mean"), F.round(aggregate.token_accuracy(predicted, labels), 6).alias("accuracy"))


@query("""
WITH a AS (SELECT CASE WHEN l_linenumber < 5 THEN l_returnflag END AS f FROM lineitem), c AS (SELECT f, count(*) AS n FROM a GROUP BY 1)
SELECT (SELECT f FROM c WHERE f IS NOT NULL ORDER BY n DESC, f LIMIT 1) AS mode, round(max(n) FILTER (WHERE f IS NOT NULL) / sum(n)::DOUBLE, 6) AS mode_fraction, round(count(f) / sum(n)::DOUBLE, 8) AS unique_fraction, round(sum(n) FILTER (WHERE f IS NULL) / sum(n)::DOUBLE, 6) AS missing_fraction FROM c""")
def answer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 5, F.col("l_returnflag")).alias("f"), "l_quantity")
    found = aggregate.answer_profile(items, "f", F.col("l_quantity"))
    return found.select("mode", F.round("mode_fraction", 6).alias("mode_fraction"), F.round("unique_fraction", 8).alias("unique_fraction"), F.round("missing_fraction", 6).alias("missing_fraction"))


@query(f"""
WITH {ROWS}, s AS (SELECT l_orderkey, count(*) AS n, sum(x::BIGINT) AS total FROM r GROUP BY 1), w AS (SELECT *, ceil(max(n) OVER (PARTITION BY l_orderkey % 50) / 8.0)::BIGINT * 8 AS width FROM s)
SELECT l_orderkey % 50 AS batch, l_orderkey, width, total, n AS attended, width - n + 1 AS ignored FROM w""")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences padded by batch; the first token of each is a masked source."""
    ids = sequences(spark, sf_dir).select("l_orderkey", (F.col("l_orderkey") % 50).alias("batch"), F.transform("x", lambda x: x.cast("int")).alias("ids"))
    pair = ids.withColumn("pair", training.encode_pair(F.slice("ids", 1, 1), F.slice("ids", F.lit(2), F.size("ids")), 1000)).select("batch", "l_orderkey", "pair.input_ids", "pair.labels")
    made = training.collate(pair, "batch", "l_orderkey", "input_ids", "labels")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select("batch", "l_orderkey", F.size("input_ids").cast("long").alias("width"), total("input_ids").alias("total"), total("attention_mask").alias("attended"), F.size(F.filter("labels", lambda x: x == training.IGNORE)).cast("long").alias("ignored"))


@query("""
WITH p AS (SELECT p_partkey, p_size AS s, p_size % 7 + 1 AS c, p_size % 11 + 1 AS r FROM part), b AS (SELECT *, greatest(c, r) AS t FROM p),
m AS (SELECT *, least(CASE WHEN t * 2 < 24 THEN 24 WHEN s * 2 < 24 THEN 24 - s ELSE floor(24 * (t / (s + t)::DOUBLE))::INTEGER END, t) AS nt FROM b), k AS (SELECT *, least(greatest(24 - nt, 0), s) AS ns FROM m)
SELECT p_partkey, ns + least(c, nt) AS chosen, ns + least(r, nt) AS rejected, ns AS hidden FROM k""")
def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of encoded pairs of a chosen and a rejected answer."""
    size = F.col("p_size")
    ids = lambda n: F.sequence(F.lit(1), n.cast("int"))
    made = table(spark, sf_dir, "part").withColumn("e", training.encode_preference(ids(size), ids(size % 7 + 1), ids(size % 11 + 1), 24))
    hidden = F.size(F.filter("e.chosen_labels", lambda x: x == training.IGNORE))
    return made.select("p_partkey", F.size("e.chosen_input_ids").alias("chosen"), F.size("e.rejected_labels").alias("rejected"), hidden.alias("hidden"))
