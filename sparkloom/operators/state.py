"""State banks: metrics of visible objects, goodness, suitability, proposals and ground truth from recorded states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numeric import direction8, world_to_local, yaw_gap
from sparkloom.functions.numeric import jaccard as set_jaccard
from sparkloom.operators.select import best_per_signature, top_k

# Thresholds of good states and pairs.
NEAR, FAR = 0.8, 1.2
GOOD_BOX, PROMINENT = 0.010, 0.018
CENTRED = (0.18, 0.82)


def _count(objects: Column, test) -> Column:
    return F.size(F.filter(objects, lambda o: F.coalesce(test(o), F.lit(False))))


def state_metrics(df: DataFrame, objects: str = "visible_objects", salient: list[str] | None = None) -> DataFrame:
    """Adds counts over the visible objects: visible, near share, far, good boxes, names, prominent, centred, actionable, distance spread."""
    o = F.col(objects)
    named = lambda x: F.length(F.trim(x["name"])) > 2
    is_salient = (lambda x: x["object_type"].isin(*salient)) if salient else named
    n = F.size(o)
    distances = F.transform(o, lambda x: x["distance"])
    return df.withColumns({
        "n_visible": n,
        "near_share": F.coalesce(F.try_divide(_count(o, lambda x: x["distance"] < NEAR).cast("double"), n.cast("double")), F.lit(0.0)),
        "n_far": _count(o, lambda x: x["distance"] >= FAR),
        "n_good_box": _count(o, lambda x: x["bbox_area_ratio"] >= GOOD_BOX),
        "n_named": _count(o, named),
        "n_prominent": _count(o, lambda x: is_salient(x) & (x["bbox_area_ratio"] >= PROMINENT)),
        "n_centred": _count(o, lambda x: is_salient(x) & x["center_x_ratio"].between(*CENTRED) & x["center_y_ratio"].between(*CENTRED)),
        "n_actionable": _count(o, lambda x: x["pickupable"] | x["moveable"] | x["openable"] | x["toggleable"]),
        "distance_spread": F.coalesce(F.array_max(distances) - F.array_min(distances), F.lit(0.0)),
    })


def is_good_state(brightness: Column) -> Column:
    """Of rows with state_metrics."""
    return (brightness >= 42) & (F.col("n_visible") >= 3) & (F.col("near_share") <= 0.55) & (F.col("n_far") >= 1) & (F.col("n_good_box") >= 2) & (F.col("n_named") >= 2) & (F.col("n_prominent") >= 1) & (F.col("n_centred") >= 1)


def suitability() -> Column:
    """map class -> whether the state can serve it; a pair with a gap exists iff the spread reaches it."""
    entries = {"action_inference": F.col("n_visible") >= 3, "overlap": F.col("n_named") >= 2, "depth": F.col("distance_spread") >= 0.8, "magnitude": F.col("n_centred") >= 1, "state_change": F.col("n_actionable") >= 1}
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])


def focus_score(o: Column, salient: list[str] | None = None) -> Column:
    """How well an object serves as a state's focus: weights of size, a salient name, use, place and distance.

    Any object with a name counts as salient unless ``salient`` names those that do.
    """
    stands_out = o["name"].isin(*salient) if salient else F.length(F.trim(o["name"])) > 2
    bias = F.abs(o["center_x_ratio"] - 0.5) + F.abs(o["center_y_ratio"] - 0.5)
    actionable = (o["pickupable"] | o["moveable"] | o["openable"] | o["toggleable"]).cast("double")
    # The weights
    return 4 * o["bbox_area_ratio"] + 0.8 * F.coalesce(stands_out, F.lit(False)).cast("double") + 0.5 * actionable - bias - 0.2 * F.greatest(F.lit(0.0), o["distance"] - 1.5)


def with_focus(df: DataFrame, objects: str = "visible_objects") -> DataFrame:
    """Adds focus: the object of the best score, the smallest id among equals; null without objects."""
    ranked = F.transform(objects, lambda o: F.struct((-focus_score(o)).alias("s"), o["object_id"].alias("id"), o.alias("o")))
    return df.withColumn("focus", F.array_min(F.transform(ranked, lambda r: F.struct(r["s"], r["id"], r["o"]["distance"].alias("distance"), r["o"]["center_x_ratio"].alias("cx"), r["o"]["center_y_ratio"].alias("cy"), r["o"]["bbox_area_ratio"].alias("area")))))


def same_state(a: dict, b: dict) -> bool:
    """Whether two states of one focus and horizon are near-duplicates."""
    turn = abs(a["yaw"] - b["yaw"]) % 360
    ids_a, ids_b = set(a["salient"]), set(b["salient"])
    shared = len(ids_a & ids_b) / len(ids_a | ids_b) if ids_a | ids_b else 1.0
    return abs(a["x"] - b["x"]) <= 0.35 and abs(a["z"] - b["z"]) <= 0.35 and min(turn, 360 - turn) <= 30 and abs(a["cx"] - b["cx"]) <= 0.15 and abs(a["cy"] - b["cy"]) <= 0.15 and abs(a["area"] - b["area"]) <= 0.05 and shared >= 0.6


def near_state_pairs(df: DataFrame, key: str) -> DataFrame:
    """Pairs (a_key, b_key) of near-duplicate states (scene, focus_key, horizon, x, z, yaw, cx, cy, area, salient): blocked by 0.5 m cells."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / 0.5)
    group = ["scene", "focus_key", "horizon"]
    cols = [key, "x", "z", "yaw", "cx", "cy", "area", "salient"]
    a = df.withColumn("__i", F.explode(F.transform(around, lambda d: cell("x") + d))).withColumn("__j", F.explode(F.transform(around, lambda d: cell("z") + d))).select(*group, "__i", "__j", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = df.select(*group, cell("x").alias("__i"), cell("z").alias("__j"), *(F.col(c).alias(f"b_{c}") for c in cols))
    met = a.join(b, [*group, "__i", "__j"]).where(f"a_{key} < b_{key}")
    bands = {"x": 0.35, "z": 0.35, "cx": 0.15, "cy": 0.15, "area": 0.05}
    for c, width in bands.items():
        met = met.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= width)
    return met.where((yaw_gap(F.col("a_yaw"), F.col("b_yaw")) <= 30) & (set_jaccard(F.col("a_salient"), F.col("b_salient")) >= 0.6)).select(*group, f"a_{key}", f"b_{key}")


def objects_table(df: DataFrame, keys: list[str], objects: str = "visible_objects") -> DataFrame:
    return df.select(*keys, F.explode(objects).alias("o")).select(*keys, "o.*")


def object_pairs(df: DataFrame, kind: str, per_state: int) -> DataFrame:
    """Pairs of objects of a state that serve a class: overlap, depth or swap; the best ``per_state`` by gap.

    ``df`` has scene, state_id, object_id, object_type, distance, x, y (box centre).
    """
    a, b = (df.select("scene", "state_id", *(F.col(c).alias(f"{p}_{c}") for c in ("object_id", "object_type", "distance", "x", "y"))) for p in "ab")
    met = a.join(b, ["scene", "state_id"]).where("a_object_id <> b_object_id")
    dx, dy, dd = F.abs(F.col("a_x") - F.col("b_x")), F.abs(F.col("a_y") - F.col("b_y")), F.col("b_distance") - F.col("a_distance")
    rules = {
        "overlap": ((dx >= 0.18) & (dy <= 0.40) & (F.col("a_x") < F.col("b_x")), dx),
        "depth": ((dd >= 0.8) & (F.col("a_distance") <= 2.6) & (F.col("b_distance") <= 5.0) & (dx <= 0.45) & (dy <= 0.30), dd),
        "swap": ((F.col("a_object_id") < F.col("b_object_id")) & (F.col("a_object_type") != F.col("b_object_type")) & (F.abs(dd) <= 0.60) & (dy <= 0.24) & dx.between(0.05, 0.65), -F.abs(dd)),
    }
    test, score = rules[kind]
    return top_k(met.where(test).withColumn("score", score), ["scene", "state_id"], [F.desc("score"), F.col("a_object_id"), F.col("b_object_id")], per_state)


def select_proposals(df: DataFrame, caps: dict[str, int], room_weight: Column, group_bonus: Column, default: int = 4) -> DataFrame:
    """Proposals by adjusted score: the best of each signature, then each subcategory's cap."""
    scored = df.withColumn("adjusted", (F.col("score") + group_bonus) * room_weight + 0.02 * F.least(F.col("n_visible"), F.lit(12)))
    best = best_per_signature(scored, ["scene", "class_id", "signature"], ["scene", "class_id", "subcat"], [F.desc("adjusted"), F.col("proposal_id")], 10**9)
    pairs = [F.lit(x) for kv in caps.items() for x in kv]
    cap = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("subcat")), F.lit(default)) if pairs else F.lit(default)
    return best.where(F.col("rank") <= cap)


def join_proposals(states: DataFrame, proposals: DataFrame) -> DataFrame:
    return proposals.join(states, ["scene", "state_id"])


def executed(df: DataFrame, success: str, group: list[str], order: list[Column], cap: int) -> tuple[DataFrame, DataFrame]:
    """(kept, failures): successes up to a cap for each group, and the failed rows."""
    return top_k(df.where(success), group, order, cap), df.where(~F.col(success))


def nearer_object(df: DataFrame, key: str) -> DataFrame:
    """Per question the name of the nearest object."""
    return df.groupBy(key).agg(F.min_by("name", F.struct("distance", "name")).alias("nearer"))


def relative_direction(df: DataFrame) -> DataFrame:
    """Adds direction of (tx, tz) as seen from (x, z) at yaw."""
    right, forward = world_to_local(F.col("tx") - F.col("x"), F.col("tz") - F.col("z"), F.col("yaw"))
    return df.withColumn("direction", direction8(right, forward))


def progression_ok(df: DataFrame, key: str, order: str, distance: str) -> DataFrame:
    """Per route whether it comes nearer: the last distance at most the first - 0.2, no step farther than 0.15 back."""
    w = Window.partitionBy(key).orderBy(order)
    step = F.col(distance) - F.lag(distance).over(w)
    return df.withColumn("__s", step).groupBy(key).agg(((F.max_by(distance, order) <= F.min_by(distance, order) - 0.2) & F.coalesce(F.bool_and(F.col("__s") <= 0.15), F.lit(True))).alias("ok"))


def state_changes(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, attribute, was, now): attributes that differ between two snapshots, null equal to null."""
    joined = before.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in columns)).join(after.select(*keys, *columns), keys, "full_outer")
    each = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"__b_{c}").cast("string").alias("was"), F.col(c).cast("string").alias("now"), F.col(f"__b_{c}").eqNullSafe(F.col(c)).alias("same")) for c in columns))
    return joined.select(*keys, F.explode(each).alias("x")).where("not x.same").select(*keys, "x.attribute", "x.was", "x.now")


def depth_change(before: Column, after: Column, least: float = 0.15) -> Column:
    """'nearer', 'farther', or null for a change too small to tell."""
    return F.when(after - before <= -least, "nearer").when(after - before >= least, "farther")


def swapped(ax: Column, bx: Column, ax2: Column, bx2: Column, tolerance: float) -> Column:
    """Whether two things took each other's places."""
    return (F.abs(ax2 - bx) <= tolerance) & (F.abs(bx2 - ax) <= tolerance)


def magnitude_comparison(a: Column, b: Column, least_gap: float) -> Column:
    return F.when(a - b >= least_gap, "first").when(b - a >= least_gap, "second")


def action_sequences(spark, actions: list[str], length: int) -> DataFrame:
    """All sequences of a few actions (a product of small fixed dimensions)."""
    from itertools import product

    return spark.createDataFrame([(list(x),) for x in product(actions, repeat=length)], "actions array<string>")


def position_grid(df: DataFrame, yaws: list[int], horizons: list[int]) -> DataFrame:
    """Each position at each heading and horizon."""
    return df.withColumn("yaw", F.explode(F.array(*map(F.lit, yaws)))).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))


def group_scores(df: DataFrame, position: str, score: str, key: str) -> DataFrame:
    """Per position the best score, the second best (0 if none), and how many."""
    ranked = df.withColumn("rank_", F.row_number().over(Window.partitionBy(position).orderBy(F.desc(score), F.desc(key))))
    counts = df.groupBy(position).agg(F.count(F.lit(1)).alias("n"))
    top = ranked.where("rank_ <= 2").groupBy(position).agg(F.max(F.when(F.col("rank_") == 1, F.col(score))).alias("best"), F.coalesce(F.max(F.when(F.col("rank_") == 2, F.col(score))), F.lit(0.0)).alias("second"))
    return top.join(counts, position).select(position, "best", "second", "n")
