"""Numeric and geometric expressions, with the guards ANSI mode asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wrap180(d: Column) -> Column:
    """An angle as one from -180 to below 180."""
    return F.pmod(d + 180.0, F.lit(360.0)) - 180.0


def yaw_gap(a: Column, b: Column) -> Column:
    """The smaller angle between two headings."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def bin_index(value: Column, edges: list[float]) -> Column:
    """Index of the half-open bin [edges[i], edges[i+1]); the last one has no upper end, what lies below is in the first."""
    out = F.lit(0)
    for i, edge in enumerate(edges[1:], 1):
        out = F.when(value >= edge, i).otherwise(out) if i == 1 else F.when(value >= edge, i).otherwise(out)
    return F.when(value.isNotNull(), out)


def nearest_standard(value: Column, standards: list[float], tolerance: float) -> Column:
    """The nearest of the standards, the smaller of two; null beyond the tolerance."""
    best = F.array_min(F.array(*(F.struct(F.abs(value - s).alias("d"), F.lit(float(s)).alias("s")) for s in standards)))
    return F.when(best["d"] <= tolerance, best["s"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def point_line_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment's line; to its first point if the segment is one."""
    length = F.hypot(bx - ax, by - ay)
    cross = F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay))
    return F.when(length < 1e-12, F.hypot(px - ax, py - ay)).otherwise(F.try_divide(cross, length))


def angle_between(dot: Column, norms: Column) -> Column:
    """Degrees, from a dot product and the product of the lengths."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, norms)))))


def world_to_local(dx: Column, dz: Column, yaw: Column) -> tuple[Column, Column]:
    """(right, forward) of a world offset seen at a heading in degrees."""
    a = F.radians(yaw)
    return dx * F.cos(a) - dz * F.sin(a), dx * F.sin(a) + dz * F.cos(a)


# The wheel of directions, clockwise.
WHEEL = ("front", "front-right", "right", "back-right", "back", "back-left", "left", "front-left")


def direction8(right: Column, forward: Column) -> Column:
    """One of eight directions."""
    k = F.pmod(F.floor((F.degrees(F.atan2(right, forward)) + 22.5) / 45.0), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, WHEEL)), k + 1)


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    """Shared area of two boxes (left, top, right, bottom) over the first one's area, at least 1."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height / F.greatest(F.lit(1.0), (a[2] - a[0]) * (a[3] - a[1]))


def clamp_score(c: Column, low: int = 1, high: int = 5) -> Column:
    """Rounded half to even and clamped; ``low`` where it is no number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.bround(F.try_to_number(c.cast("string"), F.lit("S999D999")).cast("double")).cast("int"), F.lit(low))))


def truncation_budget(source: Column, target: Column, cutoff: int) -> Column:
    """(source, target) token counts that fit: a short side stays whole, else both shrink in proportion."""
    share = F.floor(F.lit(cutoff) * F.try_divide(target.cast("double"), (source + target).cast("double"))).cast("int")
    most = F.when(target * 2 < cutoff, F.lit(cutoff)).when(source * 2 < cutoff, F.lit(cutoff) - source).otherwise(share)
    new_target = F.least(most, target)
    new_source = F.least(F.greatest(F.lit(cutoff) - new_target, F.lit(0)), source)
    return F.struct(new_source.cast("int").alias("source"), new_target.cast("int").alias("target"))


def decayed_weight(step: Column, initial: float, hold: int, decay: int) -> Column:
    """``initial`` up to ``hold``, then linearly to 0 over ``decay`` steps."""
    left = 1.0 - (step - hold).cast("double") / float(max(decay, 1))
    return F.when(step <= hold, F.lit(float(initial))).otherwise(F.greatest(F.lit(0.0), F.lit(float(initial)) * left))


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major 3x3 rotation of a unit quaternion."""
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return F.array(*(F.array(*r) for r in rows))


def camera_centre(m: Column) -> Column:
    """-R' t of a world-to-camera matrix given as array<array<double>> of 3 or 4 rows."""
    at = lambda i, j: m[i][j]
    return F.array(*(-(at(0, j) * at(0, 3) + at(1, j) * at(1, 3) + at(2, j) * at(2, 3)) for j in range(3)))


def axis_angle_matrix(axis: list[Column], angle: Column) -> Column:
    """Row-major 3x3 rotation about an axis (of any length but 0) by an angle in radians."""
    size = F.sqrt(axis[0] * axis[0] + axis[1] * axis[1] + axis[2] * axis[2])
    half = angle / 2
    return quaternion_matrix(F.cos(half), *(a / size * F.sin(half) for a in axis))


def rotation_vector_matrix(v: list[Column]) -> Column:
    """Row-major 3x3 rotation of a rotation vector; the identity for the zero vector."""
    size = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    one = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    return F.when(size < 1e-12, one).otherwise(axis_angle_matrix(v, size))


def rotation_angle(m: Column) -> Column:
    """The angle of a 3x3 rotation, in degrees."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m[0][0] + m[1][1] + m[2][2] - 1) / 2))))


def heading_elevation(forward: list[Column]) -> Column:
    """struct(heading, elevation) in degrees of a direction (x, y up, z): 0 along z, clockwise."""
    x, y, z = forward
    return F.struct(F.degrees(F.atan2(x, z)).alias("heading"), F.degrees(F.atan2(y, F.hypot(x, z))).alias("elevation"))
