"""Question rows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import qa, trajectory
from sparkloom.queries import query, table
from sparkloom.queries.series import SLOTS, slots


@query("""
WITH q AS (SELECT p_partkey, 'size' AS task_type, 'How large is "' || p_name || '"?' AS question, p_size::VARCHAR AS answer_text FROM part UNION ALL SELECT p_partkey, 'type', 'Which type is "' || p_name || '"?', p_type FROM part WHERE p_size > 10)
SELECT p_partkey, task_type, question, answer_text FROM q""")
def questions_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    specs = [
        ("size", F.concat(F.lit('How large is "'), "p_name", F.lit('"?')), size.cast("string"), F.array((size + 3).cast("string"), (size + 7).cast("string"))),
        ("type", F.when(size > 10, F.concat(F.lit('Which type is "'), "p_name", F.lit('"?'))), F.col("p_type"), F.array(F.lit("none"), F.lit("other"))),
    ]
    return qa.build_questions(part, ["p_partkey"], specs).select("p_partkey", "task_type", "question", "answer_text")


@query("""
WITH n AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 4 = 0 THEN p_name || '_II' ELSE p_brand END AS b FROM part)
SELECT coalesce(CASE WHEN a IN ('red widget') OR lower(b) IN ('red widget') THEN 'bad_name' WHEN p_partkey % 4 = 0 THEN 'duplicate_name' END, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1""")
def curation_drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_name", F.lit("_II"))).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('Is "'), "p_name", F.lit('" nearer than "'), second, F.lit('"?')).alias("q"))
    return qa.with_drop_reason(rows, "q", ["red widget"]).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SLOTS}, c AS (SELECT user_id, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY slot) AS run, sum(abs(value)) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM s),
f AS (SELECT user_id, count(*) FILTER (WHERE run < total / 2) / greatest(any_value(n) - 1, 1)::DOUBLE AS f FROM c GROUP BY 1), r AS (SELECT user_id, f, abs(f * 4 - round(f * 4)) / 4 < 0.05 AND round(f * 4) BETWEEN 1 AND 3 AS near FROM f)
SELECT user_id, CASE WHEN NOT near THEN least(3, floor(f * 4))::INTEGER END AS quarter, CASE WHEN near THEN 'near_border' END AS reason FROM r""")
def main_turn_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "value"))), lambda r: r["value"]).alias("turns"))
    return qa.main_turn_rows(s, "turns", 0.05).select("user_id", "quarter", "reason")


@query()
def revisit_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    pairs = trajectory.revisits(s, "user_id", "slot", "x", "y", near=1.0, least_path=4.0)
    return qa.revisit_rows(pairs, s, "user_id", "slot", "x", "y").withColumn("others", F.array_join(F.transform("others", lambda o: o.cast("string")), ","))
