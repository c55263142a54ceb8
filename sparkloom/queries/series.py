"""Time series and streams: events as trajectories (user = scene, order in time = slot)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.numeric import direction8, point_line_distance, world_to_local, wrap180, yaw_gap
from sparkloom.operators import select, state, trajectory
from sparkloom.queries import query, table
from sparkloom.streaming import streams
from sparkloom.tables import shared_folder

SLOTS = """s AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS slot, event_id, event_type, value,
 CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN -1.0 ELSE 0.0 END::DOUBLE * (1 + event_id % 3) AS dx, CASE event_type WHEN 'error' THEN 1.0 WHEN 'signup' THEN -1.0 ELSE 0.0 END::DOUBLE * (1 + event_id % 2) AS dy FROM events),
p AS (SELECT *, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM s WINDOW w AS (PARTITION BY user_id ORDER BY slot))"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and slot with integral steps (dx, dy) and positions (x, y)."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sign = lambda up, down: F.when(F.col("event_type") == up, 1.0).when(F.col("event_type") == down, -1.0).otherwise(0.0)
    s = events.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("slot"), "event_id", "event_type", "value", (sign("view", "click") * (1 + F.col("event_id") % 3)).alias("dx"), (sign("error", "signup") * (1 + F.col("event_id") % 2)).alias("dy"))
    run = Window.partitionBy("user_id").orderBy("slot")
    return s.withColumn("x", F.sum("dx").over(run)).withColumn("y", F.sum("dy").over(run))


@query(f"""
WITH {SLOTS}, d AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY user_id ORDER BY slot)),
g AS (SELECT user_id, count(*) AS points, coalesce(sum(step), 0) AS len, arg_max(x, slot) - arg_min(x, slot) AS cx, arg_max(y, slot) - arg_min(y, slot) AS cy FROM d GROUP BY 1), h AS (SELECT *, sqrt(cx * cx + cy * cy) AS chord, ((degrees(atan2(cy, cx)) % 90) + 90) % 90 AS a FROM g)
SELECT user_id, points, round(len, 5) AS length, round(chord, 5) AS chord, CASE WHEN chord > 0.5 THEN round(len / chord, 5) END AS ratio, round(least(a, 90 - a), 4) AS axis_angle FROM h""")
def adjacent_delta_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = trajectory.path_metrics(slots(spark, sf_dir), "user_id", "slot", "x", "y")
    return m.select("user_id", "points", F.round("length", 5).alias("length"), F.round("chord", 5).alias("chord"), F.when(F.col("chord") > 0.5, F.round("ratio", 5)).alias("ratio"), F.round("axis_angle", 4).alias("axis_angle"))


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 7200 THEN 1 ELSE 0 END AS n FROM e),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id) AS run FROM f) SELECT user_id, run::BIGINT AS run, count(*) AS n, min(t)::BIGINT AS first, max(t)::BIGINT AS last FROM r GROUP BY 1, 2""")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("t"))
    return trajectory.gap_runs(events, "user_id", "t", 7200).groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query(f"""
WITH {SLOTS}, a AS (SELECT user_id, slot, (event_id * 37 % 360)::DOUBLE AS h FROM p), d AS (SELECT *, coalesce(((h - lag(h) OVER w + 180) % 360 + 360) % 360 - 180, h) AS st FROM a WINDOW w AS (PARTITION BY user_id ORDER BY slot))
SELECT user_id, slot, sum(st) OVER (PARTITION BY user_id ORDER BY slot) AS unwrapped FROM d""")
def angle_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).select("user_id", "slot", (F.col("event_id") * 37 % 360).cast("double").alias("h"))
    return trajectory.unwrap_angle(s, "user_id", "slot", "h").select("user_id", "slot", "unwrapped")


@query(f"""
WITH {SLOTS}, t AS (SELECT *, sum(coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0)) OVER (PARTITION BY user_id ORDER BY slot) AS trav FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY user_id ORDER BY slot)))
SELECT a.user_id, a.slot AS i, b.slot AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM t a JOIN t b ON a.user_id = b.user_id AND b.slot - a.slot >= 6
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.0 AND b.trav - a.trav >= 4""")
def revisit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trajectory.revisits(slots(spark, sf_dir), "user_id", "slot", "x", "y", least_gap=6, near=1.0, least_path=4.0)
    return found.select("user_id", "i", "j", F.round("distance", 6).alias("distance"))


@query(f"""
WITH {SLOTS}, c AS (SELECT user_id, slot, sum(greatest(dx, 0)) OVER w AS px, sum(greatest(-dx, 0)) OVER w AS nx, sum(greatest(dy, 0)) OVER w AS py, sum(greatest(-dy, 0)) OVER w AS ny FROM s WINDOW w AS (PARTITION BY user_id ORDER BY slot)),
w AS (SELECT a.user_id, a.slot AS start, b.slot AS "end", b.px - a.px AS px, b.nx - a.nx AS nx, b.py - a.py AS py, b.ny - a.ny AS ny FROM c a JOIN c b ON a.user_id = b.user_id AND b.slot BETWEEN a.slot + 5 AND a.slot + 8 WHERE a.slot % 4 = 0),
m AS (SELECT *, abs(px - nx) AS sx, abs(py - ny) AS sy FROM w)
SELECT user_id, start, "end", CASE WHEN sy >= sx THEN 'dy' || CASE WHEN py >= ny THEN '+' ELSE '-' END ELSE 'dx' || CASE WHEN px >= nx THEN '+' ELSE '-' END END AS label, round(greatest(sx, sy) / greatest(sqrt(sx * sx + sy * sy), 1e-9), 6) AS purity,
 round(CASE WHEN sy >= sx THEN greatest(py, ny) / greatest(py + ny, 1e-9) ELSE greatest(px, nx) / greatest(px + nx, 1e-9) END, 6) AS monotonicity FROM m""")
def window_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = trajectory.candidate_windows(slots(spark, sf_dir), "user_id", "slot", ["dx", "dy"], low=5, high=8, stride=4)
    out = trajectory.window_purity(windows, ["dx", "dy"])
    return out.select("user_id", "start", "end", "label", F.round("purity", 6).alias("purity"), F.round("monotonicity", 6).alias("monotonicity"))


@query(f"""
WITH {SLOTS}, m AS (SELECT user_id, min(slot) FILTER (WHERE event_type = 'signup') AS start FROM p GROUP BY 1)
SELECT p.user_id, any_value(m.start) AS start, min(p.slot) FILTER (WHERE p.event_type = 'purchase' AND p.slot > m.start) AS "end" FROM p JOIN m USING (user_id) GROUP BY 1""")
def event_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.event_pattern(slots(spark, sf_dir), "user_id", "slot", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query(f"""
WITH {SLOTS}, c AS (SELECT user_id, slot, abs(value) AS v, sum(abs(value)) OVER (PARTITION BY user_id ORDER BY slot) AS run, sum(abs(value)) OVER (PARTITION BY user_id) AS total, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, least(3, floor(count(*) FILTER (WHERE run < total / 2) / greatest(any_value(n) - 1, 1)::DOUBLE * 4))::INTEGER AS quarter FROM c GROUP BY user_id""")
def turn_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "value"))), lambda r: r["value"]).alias("turns"))
    return s.select("user_id", trajectory.turn_fraction(F.col("turns"))["quarter"].alias("quarter"))


@query(f"""
WITH {SLOTS}, n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), i AS (SELECT user_id, DISTINCT_IDX FROM (SELECT user_id, unnest(CASE WHEN n <= 8 THEN range(0, n) ELSE list_distinct(list_transform(range(0, 8), lambda i: round_even(i * (n - 1) / 7.0::DOUBLE, 0)::BIGINT)) END) AS DISTINCT_IDX FROM n))
SELECT s.user_id, s.slot, s.event_id FROM s JOIN i ON s.user_id = i.user_id AND s.slot = i.DISTINCT_IDX""")
def even_spaced_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).select("user_id", "slot", "event_id")
    wanted = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.explode(select.even_slots(F.col("n"), 8)).alias("slot")).withColumn("slot", F.col("slot").cast("long"))
    return s.join(wanted, ["user_id", "slot"])


@query()
def rdp_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.simplify(slots(spark, sf_dir).select("user_id", "slot", "x", "y"), "user_id", "slot", "x", "y", 1.5)


@query()
def path_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.path_shapes(slots(spark, sf_dir), "user_id", "slot", "x", "y", eps=1.5, segment=1.0)


@query()
def timeline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.segment_timeline(slots(spark, sf_dir), "user_id", "slot", ["dx", "dy"], least=2, most=8, purity=0.75)


@query()
def resample_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).select("user_id", (F.col("slot") * 3 + F.col("event_id") % 3).alias("frame"))
    return trajectory.resample(s, "user_id", "frame", 10)


@query()
def separated_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).select("user_id", "slot", "x", "y", "value")
    return select.grouped_greedy(s, ["user_id"], ["value", "slot"], select.pick_separated(["x", "y"], 3.0, 12))


@query()
def similarity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).withColumns({"u": -F.col("y") * 2 + 1, "v": F.col("x") * 2, "w": F.col("x"), "z": F.col("y") * 3})
    errors = trajectory.alignment_errors(s.withColumn("rule", F.lit("turned")), ["user_id", "rule"], ["x", "y"], ["u", "v"]).union(trajectory.alignment_errors(s.withColumn("rule", F.lit("stretched")), ["user_id", "rule"], ["x", "y"], ["w", "z"]))
    return trajectory.best_rule(errors, "user_id", "rule").withColumn("error", F.round("error", 6))


@query(f"""
WITH {SLOTS}, m AS (SELECT user_id, min(slot) AS a, max(slot) AS b FROM p GROUP BY 1), e AS (SELECT p.user_id, p.slot, sqrt((p.x - f.x) ** 2 + (p.y - f.y) ** 2) + sqrt((p.x - l.x) ** 2 + (p.y - l.y) ** 2) - sqrt((l.x - f.x) ** 2 + (l.y - f.y) ** 2) AS extra
 FROM p JOIN m USING (user_id) JOIN p f ON f.user_id = m.user_id AND f.slot = m.a JOIN p l ON l.user_id = m.user_id AND l.slot = m.b)
SELECT user_id, round(max(extra), 5) AS extra FROM e GROUP BY 1""")
def two_stage_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.two_stage_split(slots(spark, sf_dir), "user_id", "slot", "x", "y").select("user_id", F.round("extra", 5).alias("extra"))


@query(f"""
WITH {SLOTS} SELECT user_id, (part - 1)::INTEGER AS part, sum(dx) AS total FROM (SELECT *, ntile(4) OVER (PARTITION BY user_id ORDER BY slot) AS part FROM s) GROUP BY ALL""")
def interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.interval_summary(slots(spark, sf_dir), "user_id", "slot", "dx", 4)


@query(f"""
WITH {SLOTS}, m AS (SELECT a.user_id, a.slot AS i, b.slot AS j, abs(b.x - a.x) AS sx, abs(b.y - a.y) AS sy, b.x >= a.x AS ux, b.y >= a.y AS uy FROM p a JOIN p b ON a.user_id = b.user_id AND b.slot BETWEEN a.slot + 1 AND a.slot + 10),
c AS (SELECT *, CASE WHEN sx > sy THEN 'x' || CASE WHEN ux THEN '+' ELSE '-' END ELSE 'y' || CASE WHEN uy THEN '+' ELSE '-' END END AS direction, greatest(sx, sy) AS size FROM m WHERE greatest(sx, sy) BETWEEN 5 AND 25 AND least(sx, sy) <= 2.5)
SELECT user_id, direction, i, j, size FROM c QUALIFY row_number() OVER (PARTITION BY user_id, direction ORDER BY j - i, i) = 1""")
def best_pure_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.best_pure_segments(slots(spark, sf_dir), "user_id", "slot", ["x", "y"], longest=10).select("user_id", "direction", "i", "j", "size")


@query(f"""
WITH {SLOTS}, d AS (SELECT user_id, slot, value / 1000 AS tr, (event_id % 41 - 20)::DOUBLE AS yaw, (event_id % 17 - 8)::DOUBLE AS pitch, dx AS f, dy AS r FROM s)
SELECT user_id, slot, CASE WHEN tr BETWEEN 0.2 AND 0.65 AND abs(yaw) <= 10 AND abs(pitch) <= 8 AND greatest(abs(f), abs(r)) >= 1.45 * least(abs(f), abs(r)) THEN CASE WHEN abs(f) >= abs(r) THEN CASE WHEN f >= 0 THEN 'forward' ELSE 'backward' END WHEN r >= 0 THEN 'right' ELSE 'left' END
 WHEN abs(yaw) BETWEEN 15 AND 30 AND tr <= 0.14 AND abs(pitch) <= 6 THEN CASE WHEN yaw >= 0 THEN 'turn_right' ELSE 'turn_left' END END AS label FROM d""")
def motion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir)
    e = F.col("event_id")
    return s.select("user_id", "slot", trajectory.step_class(F.col("value") / 1000, (e % 41 - 20).cast("double"), (e % 17 - 8).cast("double"), F.col("dx"), F.col("dy")).alias("label"))


@query(f"""
WITH {SLOTS} SELECT user_id, slot, round(least(((event_id * 37 - slot * 11) % 360 + 360) % 360, 360 - ((event_id * 37 - slot * 11) % 360 + 360) % 360)::DOUBLE, 6) AS gap, round(((event_id * 37 + 180.0) % 360 + 360) % 360 - 180, 6)::DOUBLE AS wrapped,
 ['front','front-right','right','back-right','back','back-left','left','front-left'][((floor((degrees(atan2(dx * cos(radians(30)) - dy * sin(radians(30)), dx * sin(radians(30)) + dy * cos(radians(30)))) + 22.5) / 45) % 8 + 8) % 8)::INTEGER + 1] AS direction,
 round(abs(5 * y - 2 * x) / sqrt(29), 5) AS off_line FROM p WHERE dx <> 0 OR dy <> 0""")
def geometry_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).where("dx <> 0 or dy <> 0")
    h = (F.col("event_id") * 37).cast("double")
    right, forward = world_to_local(F.col("dx"), F.col("dy"), F.lit(30.0))
    zero = F.lit(0.0)
    return s.select("user_id", "slot", F.round(yaw_gap(h, (F.col("slot") * 11).cast("double")), 6).alias("gap"), F.round(wrap180(h), 6).alias("wrapped"), direction8(right, forward).alias("direction"), F.round(point_line_distance(F.col("x"), F.col("y"), zero, zero, F.lit(5.0), F.lit(2.0)), 5).alias("off_line"))


@query(f"""
WITH {SLOTS}, d AS (SELECT user_id, slot, abs(x) + abs(y) AS dist FROM p), e AS (SELECT *, dist - lag(dist) OVER (PARTITION BY user_id ORDER BY slot) AS st FROM d)
SELECT user_id, arg_max(dist, slot) <= arg_min(dist, slot) - 0.2 AND coalesce(bool_and(st <= 0.15), true) AS ok FROM e GROUP BY 1""")
def route_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).withColumn("dist", F.abs("x") + F.abs("y"))
    return state.progression_ok(s, "user_id", "slot", "dist")


@query(f"""
WITH {SLOTS}, b AS (SELECT user_id, event_type AS kind, value FROM s WHERE slot = 0), a AS (SELECT user_id, event_type AS kind, value FROM s WHERE slot = 1)
SELECT user_id, 'kind' AS attribute, b.kind AS was, a.kind AS now FROM b FULL JOIN a USING (user_id) WHERE a.kind IS DISTINCT FROM b.kind UNION ALL
SELECT user_id, 'late', (b.value > 20)::VARCHAR, (a.value > 20)::VARCHAR FROM b FULL JOIN a USING (user_id) WHERE (a.value > 20) IS DISTINCT FROM (b.value > 20)""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slots(spark, sf_dir).select("user_id", "slot", F.col("event_type").alias("kind"), (F.col("value") > 20).alias("late"))
    return state.state_changes(s.where("slot = 0").drop("slot"), s.where("slot = 1").drop("slot"), ["user_id"], ["kind", "late"])


@query(f"""
WITH {SLOTS}, o AS (SELECT user_id AS state_id, slot AS object_id, event_type AS object_type, (event_id % 50) / 10.0::DOUBLE AS distance, (event_id % 97) / 97.0::DOUBLE AS x, (event_id % 53) / 53.0::DOUBLE AS y FROM s)
SELECT a.state_id, a.object_id AS a_object_id, b.object_id AS b_object_id FROM o a JOIN o b ON a.state_id = b.state_id AND a.object_id <> b.object_id
WHERE b.distance - a.distance >= 0.8 AND a.distance <= 2.6 AND b.distance <= 5 AND abs(a.x - b.x) <= 0.45 AND abs(a.y - b.y) <= 0.3
QUALIFY row_number() OVER (PARTITION BY a.state_id ORDER BY b.distance - a.distance DESC, a.object_id, b.object_id) <= 10""")
def object_depth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    o = slots(spark, sf_dir).select(F.lit("s").alias("scene"), F.col("user_id").alias("state_id"), F.col("slot").alias("object_id"), F.col("event_type").alias("object_type"), ((e % 50) / 10.0).alias("distance"), ((e % 97) / 97.0).alias("x"), ((e % 53) / 53.0).alias("y"))
    return state.object_pairs(o, "depth", 10).select("state_id", "a_object_id", "b_object_id")


@query(f"""
WITH {SLOTS}, o AS (SELECT user_id AS state_id, slot, event_type, (event_id % 50) / 10.0::DOUBLE AS d, (event_id % 40) / 1000.0::DOUBLE AS area, (event_id % 97) / 97.0::DOUBLE AS cx FROM s)
SELECT state_id, count(*) AS n_visible, round(count(*) FILTER (WHERE d < 0.8) / count(*)::DOUBLE, 6) AS near_share, count(*) FILTER (WHERE d >= 1.2) AS n_far, count(*) FILTER (WHERE area >= 0.010) AS n_good_box, count(*) FILTER (WHERE area >= 0.018) AS n_prominent, round(max(d) - min(d), 6) AS distance_spread FROM o GROUP BY 1""")
def state_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    no = F.lit(False)
    o = F.struct(F.col("slot").cast("string").alias("object_id"), F.col("event_type").alias("object_type"), F.col("event_type").alias("name"), ((e % 50) / 10.0).alias("distance"), no.alias("pickupable"), no.alias("moveable"), no.alias("openable"), no.alias("toggleable"), ((e % 40) / 1000.0).alias("bbox_area_ratio"), ((e % 97) / 97.0).alias("center_x_ratio"), F.lit(0.5).alias("center_y_ratio"))
    s = slots(spark, sf_dir).groupBy(F.col("user_id").alias("state_id")).agg(F.collect_list(o).alias("visible_objects"))
    m = state.state_metrics(s)
    return m.select("state_id", *(F.col(c).cast("long").alias(c) for c in ("n_visible", "n_far", "n_good_box", "n_prominent")), F.round("near_share", 6).alias("near_share"), F.round("distance_spread", 6).alias("distance_spread"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) // 1000000 AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a stream, run to its end."""
    schema = table(spark, sf_dir, "events").schema
    if _is_folder(spark, sf_dir):
        source = streams.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    else:
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out, check = _paths(spark, "tumbling")
    counts = streams.tumbling_counts(streams.with_event_time(source, "ts", "30 days"), "ts", "6 hours", ["event_type"])
    streams.run_to_end(counts, out, check, mode="complete", each=lambda batch, n: batch.write.mode("overwrite").parquet(out))
    return spark.read.parquet(out).select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


def _is_folder(spark: SparkSession, sf_dir: str) -> bool:
    """Whether the table is a folder of files, which a file stream needs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    base = shared_folder(spark)
    tag = uuid.uuid4().hex
    return f"{base}/{name}-{tag}", f"{base}/{name}-{tag}-log"


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 3600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS s FROM f) SELECT user_id, min(t) // 1000000 AS session_start, count(*) AS n FROM g GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.session_counts(streams.with_event_time(table(spark, sf_dir, "events")), "ts", "1 hour", ["user_id"])
    return found.select("user_id", F.unix_seconds("session_start").alias("session_start"), "n")


@query("""
SELECT epoch_us(b + INTERVAL 1 HOUR * k.i) // 1000000 - 10800 AS window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, event_type FROM events), (SELECT unnest(range(0, 4)) AS i) k GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = streams.sliding_counts(streams.with_event_time(table(spark, sf_dir, "events")), "ts", "4 hours", "1 hour", ["event_type"])
    return found.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")
