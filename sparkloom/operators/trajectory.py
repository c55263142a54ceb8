"""Pose sequences: deltas, runs, path metrics, revisits, segments and shapes.

Trajectories are long tables (scene, slot, x, y, ...); window functions work a
scene at a time. Algorithms that are sequential by nature take one scene each
in an Arrow-batched group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.numeric import wrap180


def deltas(df: DataFrame, scene: str, order: str, columns: list[str]) -> DataFrame:
    """Adds d_<c>: the difference to the previous slot (null at the first)."""
    w = Window.partitionBy(scene).orderBy(order)
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def gap_runs(df: DataFrame, scene: str, order: str, gap, out: str = "run") -> DataFrame:
    """Adds the number of the run (from 0): a new one where the step from the previous row passes ``gap``."""
    w = Window.partitionBy(scene).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w)) > gap, F.lit(False)).cast("int")
    return df.withColumn("__n", new).withColumn(out, F.sum("__n").over(w)).drop("__n")


def unwrap_angle(df: DataFrame, scene: str, order: str, angle: str, out: str = "unwrapped") -> DataFrame:
    """Adds a continuous angle: the first one and the wrapped steps from there on."""
    w = Window.partitionBy(scene).orderBy(order)
    step = F.coalesce(wrap180(F.col(angle) - F.lag(angle).over(w)), F.col(angle))
    return df.withColumn("__s", step).withColumn(out, F.sum("__s").over(w)).drop("__s")


def path_metrics(df: DataFrame, scene: str, order: str, x: str, y: str) -> DataFrame:
    """Per scene: length, chord, their ratio, and the chord's angle to the nearer axis (at most 45 degrees)."""
    steps = deltas(df, scene, order, [x, y])
    ends = lambda f, c: f(c, F.struct(order))
    out = steps.groupBy(scene).agg(F.coalesce(F.sum(F.hypot(f"d_{x}", f"d_{y}")), F.lit(0.0)).alias("length"), (ends(F.max_by, x) - ends(F.min_by, x)).alias("dx"), (ends(F.max_by, y) - ends(F.min_by, y)).alias("dy"), F.count(F.lit(1)).alias("points"))
    chord, a = F.hypot("dx", "dy"), F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(90.0))
    return out.select(scene, "points", "length", chord.alias("chord"), F.try_divide(F.col("length"), F.greatest(chord, F.lit(1e-9))).alias("ratio"), F.least(a, 90.0 - a).alias("axis_angle"))


def with_prefix_length(df: DataFrame, scene: str, order: str, x: str, y: str, out: str = "travelled") -> DataFrame:
    """Adds the path length from the scene's first slot, so that any stretch's length is one subtraction."""
    w = Window.partitionBy(scene).orderBy(order)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    return df.withColumn("__s", step).withColumn(out, F.sum("__s").over(w)).drop("__s")


def revisits(df: DataFrame, scene: str, order: str, x: str, y: str, *, least_gap: int = 6, near: float = 0.35, least_path: float = 2.0) -> DataFrame:
    """Pairs of slots i < j at one place again: far apart in time, near in space, with a path between. Cells of a grid, no pair join of all slots."""
    p = with_prefix_length(df, scene, order, x, y)
    cell = lambda c: F.floor(F.col(c) / near)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = p.withColumn("__x", F.explode(F.transform(around, lambda d: cell(x) + d))).withColumn("__y", F.explode(F.transform(around, lambda d: cell(y) + d)))
    a = a.select(scene, "__x", "__y", F.col(order).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"), F.col("travelled").alias("ti"))
    b = p.select(scene, cell(x).alias("__x"), cell(y).alias("__y"), F.col(order).alias("j"), F.col(x).alias("xj"), F.col(y).alias("yj"), F.col("travelled").alias("tj"))
    met = a.join(b, [scene, "__x", "__y"]).where(F.col("j") - F.col("i") >= least_gap)
    dist = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    return met.where((dist <= near) & (F.col("tj") - F.col("ti") >= least_path)).select(scene, "i", "j", dist.alias("distance"), (F.col("tj") - F.col("ti")).alias("path"))


def candidate_windows(df: DataFrame, scene: str, slot: str, axes: list[str], *, low: int, high: int, stride: int) -> DataFrame:
    """Windows of low..high steps from every ``stride``-th slot, with sums of the steps along each axis, of their positive
    and negative parts: differences of prefix sums, joined by (scene, slot)."""
    w = Window.partitionBy(scene).orderBy(slot)
    sums = df
    for c in axes:
        sums = sums.withColumn(f"p_{c}", F.sum(F.greatest(F.col(c), F.lit(0.0))).over(w)).withColumn(f"n_{c}", F.sum(F.greatest(-F.col(c), F.lit(0.0))).over(w))
    cols = [f"{s}_{c}" for c in axes for s in "pn"]
    starts = sums.where(F.col(slot) % stride == 0).withColumn("__e", F.explode(F.sequence(F.col(slot) + low, F.col(slot) + high)))
    starts = starts.select(scene, F.col(slot).alias("start"), F.col("__e").alias("end"), *(F.col(c).alias(f"s_{c}") for c in cols))
    ends = sums.select(scene, F.col(slot).alias("end"), *cols)
    met = starts.join(ends, [scene, "end"])
    return met.select(scene, "start", "end", *((F.col(c) - F.col(f"s_{c}")).alias(c) for c in cols))


def window_purity(windows: DataFrame, axes: list[str]) -> DataFrame:
    """Adds the main axis and sign, its size, purity (main over the norm of the nets) and monotonicity (main way over both ways)."""
    nets = F.array(*(F.struct(F.abs(F.col(f"p_{c}") - F.col(f"n_{c}")).alias("size"), F.lit(c).alias("axis"), F.greatest(f"p_{c}", f"n_{c}").alias("way"), F.least(f"p_{c}", f"n_{c}").alias("back"), F.when(F.col(f"p_{c}") >= F.col(f"n_{c}"), "+").otherwise("-").alias("sign")) for c in axes))
    norm = F.sqrt(F.aggregate(nets, F.lit(0.0), lambda a, n: a + n["size"] * n["size"]))
    best = F.array_max(nets)
    return windows.withColumn("__b", best).withColumn("label", F.concat("__b.axis", "__b.sign")).withColumn("size", F.col("__b.size")).withColumn("purity", F.col("__b.size") / F.greatest(norm, F.lit(1e-9))).withColumn("monotonicity", F.try_divide(F.col("__b.way"), F.greatest(F.col("__b.way") + F.col("__b.back"), F.lit(1e-9)))).drop("__b")


def step_class(translation: Column, yaw: Column, pitch: Column, forward: Column, right: Column) -> Column:
    """Motion of one step: a way if it is a clear translation, a turn if a clear rotation, else null."""
    main, other = F.greatest(F.abs(forward), F.abs(right)), F.least(F.abs(forward), F.abs(right))
    moves = translation.between(0.20, 0.65) & (F.abs(yaw) <= 10) & (F.abs(pitch) <= 8) & (main >= 1.45 * other)
    way = F.when(F.abs(forward) >= F.abs(right), F.when(forward >= 0, "forward").otherwise("backward")).otherwise(F.when(right >= 0, "right").otherwise("left"))
    turns = F.abs(yaw).between(15, 30) & (translation <= 0.14) & (F.abs(pitch) <= 6)
    return F.when(moves, way).when(turns, F.when(yaw >= 0, "turn_right").otherwise("turn_left"))


def turn_fraction(turns: Column) -> Column:
    """struct(fraction, quarter): where along an array of turn sizes half of the turning is done; quarter from 0 to 3."""
    total = F.aggregate(turns, F.lit(0.0), lambda a, x: a + F.abs(x))
    seen = F.aggregate(turns, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, x: F.struct((a["sum"] + F.abs(x)).alias("sum"), F.when(a["sum"] + F.abs(x) < total / 2, a["n"] + 1).otherwise(a["n"]).alias("n")))["n"]
    share = F.try_divide(seen.cast("double"), F.greatest(F.size(turns) - 1, F.lit(1)).cast("double"))
    return F.when(total > 0, F.struct(share.alias("fraction"), F.least(F.lit(3), F.floor(share * 4).cast("int")).alias("quarter")))


def best_pure_segments(df: DataFrame, episode: str, slot: str, axes: list[str], *, longest: int = 22, low: float = 5, high: float = 25, off: float = 2.5) -> DataFrame:
    """Per episode and direction the shortest stretch that is a clean move along one axis: by displacement of its ends."""
    a = df.select(episode, F.col(slot).alias("i"), *(F.col(c).alias(f"a_{c}") for c in axes)).withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + longest)))
    met = a.join(df.select(episode, F.col(slot).alias("j"), *axes), [episode, "j"])
    moves = F.array(*(F.struct(F.abs(F.col(c) - F.col(f"a_{c}")).alias("size"), F.lit(c).alias("axis"), (F.col(c) >= F.col(f"a_{c}")).alias("up")) for c in axes))
    ranked = met.withColumn("m", F.sort_array(moves, asc=False))
    clean = ranked.where((F.col("m")[0]["size"].between(low, high)) & (F.col("m")[1]["size"] <= off))
    named = clean.withColumn("direction", F.concat(F.col("m")[0]["axis"], F.when(F.col("m")[0]["up"], "+").otherwise("-"))).withColumn("size", F.col("m")[0]["size"])
    return named.groupBy(episode, "direction").agg(F.min_by(F.struct("i", "j", "size"), F.struct(F.col("j") - F.col("i"), "i")).alias("s")).select(episode, "direction", "s.*")


def event_pattern(df: DataFrame, scene: str, order: str, first: Column, then: Column) -> DataFrame:
    """Per scene the first row where ``first`` holds, and the first after it where ``then`` holds; null where it never comes."""
    w = Window.partitionBy(scene)
    start = F.min(F.when(first, F.col(order))).over(w)
    return df.withColumn("__s", start).groupBy(scene).agg(F.min("__s").alias("start"), F.min(F.when(then & (F.col(order) > F.col("__s")), F.col(order))).alias("end"))


def two_stage_split(df: DataFrame, scene: str, order: str, x: str, y: str) -> DataFrame:
    """Per scene the pivot slot where going by way of it adds the most to the straight line."""
    w = Window.partitionBy(scene).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = lambda f, c: f(c).over(w)
    legs = F.hypot(F.col(x) - at(F.first, x), F.col(y) - at(F.first, y)) + F.hypot(F.col(x) - at(F.last, x), F.col(y) - at(F.last, y))
    extra = legs - F.hypot(at(F.last, x) - at(F.first, x), at(F.last, y) - at(F.first, y))
    return df.withColumn("extra", extra).groupBy(scene).agg(F.max_by(order, F.struct("extra", -F.col(order))).alias("pivot"), F.max("extra").alias("extra"))


def rdp(points: np.ndarray, eps: float) -> np.ndarray:
    """Indices kept when a line is simplified: a stretch is straight if no point is farther than ``eps`` from its chord."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        chord = points[b] - points[a]
        inner = points[a + 1 : b] - points[a]
        size = math.hypot(*chord)
        far = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / size if size > 1e-12 else np.hypot(inner[:, 0], inner[:, 1])
        k = int(far.argmax())
        if far[k] > eps:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return np.array(sorted(keep))


def drop_short_segments(points: np.ndarray, least: float) -> np.ndarray:
    """Inner points too near the one kept before them go; then, while more than three are left, those with a short segment on either side.

    A pass judges all inner points, each against the last one that the pass has
    kept and against the one that follows; passes go on until one drops nothing.
    """
    def thinned(line: list[tuple], ahead: bool) -> list[tuple]:
        kept = [line[0]]
        for here, following in zip(line[1:-1], line[2:], strict=True):
            if math.dist(here, kept[-1]) >= least and not (ahead and math.dist(following, here) < least):
                kept.append(here)
        return [*kept, line[-1]]

    line = [tuple(p) for p in points]
    if len(line) > 2:
        line, before = thinned(line, False), 0
        while len(line) > 3 and len(line) != before:
            before, line = len(line), thinned(line, True)
    return np.array(line, float)


def shape_of(points: np.ndarray, *, eps: float = 0.35, least_move: float = 1.2, straight: float = 1.28, simple: float = 2.65, segment: float = 0.55, low: float = 32, high: float = 132) -> tuple[str | None, str | None, int]:
    """(label, reason it has none, turns): straight, left, right, or two turns in order such as left_then_right."""
    chord = math.dist(points[0], points[-1])
    if chord < least_move:
        return None, "too_little_translation", 0
    ratio = float(np.hypot(*np.diff(points, axis=0).T).sum()) / chord
    steps = np.diff(drop_short_segments(points[rdp(points, eps)], segment), axis=0)
    if len(steps) > 1 and (np.hypot(*steps.T) < segment).any():
        return None, "short_segment", 0
    heading = np.degrees(np.arctan2(steps[:, 1], steps[:, 0]))
    turns = (np.diff(heading) + 180) % 360 - 180
    clear = turns[np.abs(turns) >= low]
    if (np.abs(clear) > high).any():
        return None, "sharp_turn", int((np.abs(clear) > high).argmax()) + 1
    if not len(clear):
        return ("straight", None, 0) if ratio <= straight else (None, "straight_but_curvy" if len(steps) == 1 else "no_clear_turn", 0)
    if len(clear) > 2:
        return None, "too_many_turns", len(clear)
    if ratio > simple:
        return None, "too_loopy", len(clear)
    return "_then_".join("left" if t > 0 else "right" for t in clear), None, len(clear)


def path_shapes(df: DataFrame, scene: str, order: str, x: str, y: str, **parameters: float) -> DataFrame:
    """(scene, corners, label, reason, turns) of each scene's simplified path."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        points = part[[x, y]].to_numpy(float)
        label, reason, turns = shape_of(points, **parameters)
        return pd.DataFrame({scene: [part[scene].iloc[0]], "corners": [len(rdp(points, parameters.get("eps", 0.35)))], "label": [label], "reason": [reason], "turns": [turns]})

    return df.select(scene, order, x, y).groupBy(scene).applyInPandas(run, f"`{scene}` {df.schema[scene].dataType.simpleString()}, corners int, label string, reason string, turns int")


def simplify(df: DataFrame, scene: str, order: str, x: str, y: str, eps: float) -> DataFrame:
    """The rows kept by Ramer-Douglas-Peucker, scene by scene."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        return part.iloc[rdp(part[[x, y]].to_numpy(float), eps)]

    return df.groupBy(scene).applyInPandas(run, df.schema)


def resample_slots(frames: list[int], gap: int) -> list[int]:
    """Slots taken in turn: the first frame at least ``gap`` after the last taken, always one further at least."""
    from bisect import bisect_left

    out = [0] if frames else []
    while out and out[-1] < len(frames) - 1:
        at = max(out[-1] + 1, bisect_left(frames, frames[out[-1]] + gap))
        if at >= len(frames):
            break
        out.append(at)
    return out


def resample(df: DataFrame, scene: str, frame: str, gap: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(frame, kind="stable")
        return part.iloc[resample_slots(part[frame].tolist(), gap)]

    return df.groupBy(scene).applyInPandas(run, df.schema)


def pure_window(steps: np.ndarray, first: int, *, least: int = 2, most: int = 8, purity: float = 0.8) -> tuple[int, str, float, float] | None:
    """(steps, label, value, purity) of the best pure window from ``first`` on: the longest, then the one that moves most, then the purest.

    ``steps`` has a column for each axis. A window's value is its largest sum
    along an axis, signed in the label (axis0+, axis1-, ...); its purity the
    share of that in all movement. ``least`` to ``most`` steps count.
    """
    best = None
    for last in range(first + least, min(len(steps), first + most) + 1):
        part = steps[first:last]
        sums, every = part.sum(0), float(np.abs(part).sum())
        axis = int(np.abs(sums).argmax())
        value = float(abs(sums[axis]))
        if every > 0 and value / every >= purity:
            best = max(best or (0, "", 0.0, 0.0), (last - first, f"axis{axis}{'+' if sums[axis] > 0 else '-'}", value, value / every), key=lambda w: (w[0], w[2], w[3]))
    return best


def greedy_segments(steps: np.ndarray, *, most_impure: int = 6, **window: float) -> list[tuple[int, int, str | None]]:
    """(first, past the last, label) of a timeline of steps: the best pure window where one begins; else, without a label, what lies before the next that does, ``most_impure`` steps at most."""
    out: list[tuple[int, int, str | None]] = []
    at = 0
    while at < len(steps):
        found = pure_window(steps, at, **window)
        if found:
            end, label = at + found[0], found[1]
        else:
            ahead = range(at + 1, min(len(steps), at + most_impure) + 1)
            end, label = next((i for i in ahead if pure_window(steps, i, **window)), ahead[-1]), None
        out.append((at, end, label))
        at = end
    return out


def segment_timeline(df: DataFrame, scene: str, order: str, axes: list[str], **rule: float) -> DataFrame:
    """(scene, first, last, label): pure and impure segments of each scene, by the slots of their first and last steps."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        slots = part[order].tolist()
        found = greedy_segments(part[axes].to_numpy(float), **rule)
        return pd.DataFrame([(part[scene].iloc[0], slots[a], slots[b - 1], v) for a, b, v in found], columns=[scene, "first", "last", "label"])

    kind = df.schema[order].dataType.simpleString()
    return df.select(scene, order, *axes).groupBy(scene).applyInPandas(run, f"`{scene}` {df.schema[scene].dataType.simpleString()}, first {kind}, last {kind}, label string")


def umeyama(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, rotation, translation) that best take the source points to the target ones."""
    a, b = source - source.mean(0), target - target.mean(0)
    u, s, vt = np.linalg.svd(b.T @ a / len(a))
    flip = np.eye(len(s))
    flip[-1, -1] = -1.0 if np.linalg.det(u) * np.linalg.det(vt) < 0 else 1.0
    rotation = u @ flip @ vt
    spread = float((a**2).sum()) / len(a)
    scale = float((s * np.diag(flip)).sum()) / spread if spread > 1e-12 else 1.0
    return scale, rotation, target.mean(0) - scale * rotation @ source.mean(0)


def alignment_errors(df: DataFrame, keys: list[str], source: list[str], target: list[str]) -> DataFrame:
    """Per group of paired points the similarity's scale and root mean square error; groups may be (scene, rule)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part[source].to_numpy(float), part[target].to_numpy(float)
        scale, rotation, shift = umeyama(a, b)
        error = float(np.sqrt((((scale * a @ rotation.T + shift) - b) ** 2).sum(1).mean()))
        return part[keys].head(1).assign(scale=scale, error=error)

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", scale double, error double"
    return df.groupBy(*keys).applyInPandas(run, fields)


def best_rule(errors: DataFrame, scene: str, rule: str) -> DataFrame:
    """Each scene's rule of the least error, the first by name among equals."""
    return errors.groupBy(scene).agg(F.min_by(rule, F.struct("error", rule)).alias(rule), F.min("error").alias("error"))


def interval_summary(df: DataFrame, scene: str, slot: str, value: str, n: int) -> DataFrame:
    """(scene, part, total): a value summed over n equal fractions of each scene's slots."""
    w = Window.partitionBy(scene).orderBy(slot)
    part = F.ntile(n).over(w) - 1
    return df.withColumn("part", part).groupBy(scene, "part").agg(F.sum(value).alias("total"))
