"""Geometry as column expressions: everything here stays inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

#: Metres in a unit, by every accepted spelling (fixed values).
METRES = {
    "nm": 1e-9, "nanometer": 1e-9, "nanometers": 1e-9, "nanometre": 1e-9, "nanometres": 1e-9,
    "um": 1e-6, "µm": 1e-6, "μm": 1e-6, "micron": 1e-6, "microns": 1e-6, "micrometer": 1e-6, "micrometers": 1e-6,
    "mm": 1e-3, "millimeter": 1e-3, "millimeters": 1e-3, "cm": 1e-2, "centimeter": 1e-2, "centimeters": 1e-2,
    "m": 1.0, "meter": 1.0, "meters": 1.0,
}


def unit_factor(old: str, new: str) -> float:
    """Factor that turns lengths in ``old`` into lengths in ``new``."""
    for u in (old, new):
        if u not in METRES:
            raise ValueError(f"unknown unit {u!r}")
    return 1.0 if old == new else METRES[old] / METRES[new]


def vector(prefix: str = "", *, of: str = "") -> Vector:
    """The columns <of>.<prefix>x, y and z."""
    return tuple(F.col(f"{of}.{prefix}{a}" if of else f"{prefix}{a}") for a in "xyz")  # type: ignore[return-value]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return norm(minus(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(as_col(lo), F.least(as_col(hi), x))


def along_segment(p: Vector, a: Vector, b: Vector) -> Column:
    """Where on a-b (0 to 1) the point nearest to p lies; 0 for a segment without length."""
    d = minus(b, a)
    length2 = dot(d, d)
    return F.when(length2 > 0, clamp(dot(minus(p, a), d) / length2, 0.0, 1.0)).otherwise(F.lit(0.0))


def point_segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    t = along_segment(p, a, b)
    # less from a first: what lies exactly on a surface is then rounded as in the SQL
    return norm(tuple(w - t * (v - u) for w, u, v in zip(minus(p, a), a, b, strict=True)))  # type: ignore[arg-type]


def point_capsule_distance(p: Vector, a: Vector, b: Vector, ra: Column, rb: Column) -> Column:
    """Signed distance to a segment whose radius goes linearly from ra to rb; without length, to the larger ball."""
    t = along_segment(p, a, b)
    d = minus(b, a)
    return point_segment_distance(p, a, b) - F.when(dot(d, d) > 0, ra + t * (rb - ra)).otherwise(F.greatest(ra, rb))


def clipped_length(a: Vector, b: Vector, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    """Length of the part of a-b inside a closed box, by clipping the parameter range slab by slab."""
    t0, t1, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    least = F.lit(1e-12) * F.greatest(F.lit(1.0), *(F.abs(q - p) for p, q in zip(a, b, strict=True)))
    for p, q, low, high in zip(a, b, lo, hi, strict=True):
        d = q - p
        flat = F.abs(d) < least
        u, v = (F.lit(low) - p) / d, (F.lit(high) - p) / d
        t0 = F.when(flat, t0).otherwise(F.greatest(t0, F.least(u, v)))
        t1 = F.when(flat, t1).otherwise(F.least(t1, F.greatest(u, v)))
        outside = outside | (flat & ((p < low) | (p > high)))
    return F.when(outside | (t1 <= t0), F.lit(0.0)).otherwise((t1 - t0) * distance(a, b))


def in_box(p: Vector, lo: tuple[float, float, float], hi: tuple[float, float, float]) -> Column:
    inside = F.lit(True)
    for x, low, high in zip(p, lo, hi, strict=True):
        inside = inside & x.between(low, high)
    return inside


def parse_box(box) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """(lo, hi) from (xmin, xmax, ymin, ymax, zmin, zmax) or from two triples."""
    parts = list(box)
    if len(parts) == 2:
        lo, hi = (tuple(map(float, p)) for p in parts)
    else:
        lo, hi = tuple(map(float, parts[0::2])), tuple(map(float, parts[1::2]))
    if len(lo) != 3 or len(hi) != 3:
        raise ValueError("a box is (xmin, xmax, ymin, ymax, zmin, zmax) or two triples")
    if any(a > b for a, b in zip(lo, hi, strict=True)):
        raise ValueError("a box needs lo <= hi on each axis")
    return lo, hi


def cap_cosine(d: Column, r: Column, s: Column) -> Column:
    """Cosine of the half-angle of the cap that a sphere of radius s cuts from one of radius r at distance d."""
    return clamp((d * d + r * r - s * s) / (2 * d * r), -1.0, 1.0)


def cap_area(r: Column, cosine: Column) -> Column:
    return F.lit(2 * math.pi) * r * r * (1 - cosine)


def cap_chord(r: Column, cosine: Column) -> Column:
    return r * F.sqrt(F.greatest(F.lit(0.0), 1 - cosine * cosine))


def body_coordinates(p: Vector, center: Column, axes: Column, rot: Column) -> Vector:
    """Coordinates in which the ellipsoid is the unit ball; ``rot`` holds the axes' directions in its columns."""
    rel = minus(p, tuple(center[i] for i in range(3)))  # type: ignore[arg-type]
    return tuple(dot(rel, tuple(rot[i][k] for i in range(3))) / axes[k] for k in range(3))  # type: ignore[return-value, arg-type]


def in_soma(p: Vector, center: Column, axes: Column, rot: Column, inside_frac: float = 1.0) -> Column:
    q = body_coordinates(p, center, axes, rot)
    # a ball needs no turning, and no division that rounds places on its surface to either side
    rel = minus(p, tuple(center[i] for i in range(3)))  # type: ignore[arg-type]
    reach = axes[0] * F.lit(float(inside_frac))
    return F.when(_is_ball(axes), dot(rel, rel) <= reach * reach).otherwise(dot(q, q) <= F.lit(inside_frac**2))


def _is_ball(axes: Column) -> Column:
    return (axes[0] == axes[1]) & (axes[1] == axes[2])


def ellipsoid_surface_distance(p: Vector, center: Column, axes: Column, rot: Column, steps: int = 64) -> Column:
    """Signed distance to an ellipsoid.

    Outside: the nearest surface point has coordinates a^2 y / (t + a^2) for the root t >= 0 of
    sum (a y / (t + a^2))^2 = 1, by Newton steps, which converge from one side since the function is
    convex.  They begin at the largest bound below the root: that of the ball of the longest axis (of
    a ball, the root itself) or of one axis alone; there no term is above 1, and a step divides those
    that hold it back by 3 or so.  Rows take as many steps as the ratio of their axes asks for, at
    most ``steps``; a ball takes none.  Inside: along the ray from the centre; at the centre minus the least axis.
    """
    rel = minus(p, tuple(center[i] for i in range(3)))  # type: ignore[arg-type]
    y = tuple(dot(rel, tuple(rot[i][k] for i in range(3))) for k in range(3))  # type: ignore[arg-type]
    a = tuple(axes[k] for k in range(3))
    most, least = F.greatest(*a), F.least(*a)
    start = F.greatest(F.lit(0.0), norm(tuple(u * v for u, v in zip(a, y, strict=True))) - most * most, *(u * F.abs(v) - u * u for u, v in zip(a, y, strict=True)))  # type: ignore[arg-type]
    needed = F.least(F.lit(steps), F.lit(12) + F.coalesce(F.ceil(2 * F.log2(most / least)), F.lit(steps)).cast("int"))

    def step(t: Column, _: Column) -> Column:
        terms = [(u * v / (t + u * u), t + u * u) for u, v in zip(a, y, strict=True)]
        f = sum((w * w for w, _ in terms), F.lit(-1.0))
        slope = sum((w * w / d for w, d in terms), F.lit(0.0))
        return F.when(slope > 0, t + F.greatest(F.lit(0.0), f / (2 * slope))).otherwise(t)

    unit = norm(tuple(v / u for u, v in zip(a, y, strict=True)))  # type: ignore[arg-type]
    # solved once for each row, though its root is read many times
    ways = F.when(_is_ball(axes) | (unit <= 1), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), needed))
    root = F.aggregate(ways, start, step)

    def outside(t: Column) -> Column:
        foot = tuple(u * u * v / (t + u * u) for u, v in zip(a, y, strict=True))
        return norm(minus(y, foot))  # type: ignore[arg-type]

    inside = F.when(unit > 0, norm(y) * (1 - 1 / unit)).otherwise(-F.array_min(axes))  # type: ignore[arg-type]
    return F.when(unit > 1, F.element_at(F.transform(F.array(root), outside), 1)).otherwise(inside)


def spherical_radius(axes: Column) -> Column:
    return F.array_max(axes)


def equivalent_radius(axes: Column) -> Column:
    return F.cbrt(axes[0] * axes[1] * axes[2])


def ellipsoid_box(center: Column, axes: Column, rot: Column) -> Column:
    """Axis-aligned bounds of a rotated ellipsoid: centre -/+ |R| axes, as the reach of each row of the scaled rotation."""
    reach = [sum((F.abs(rot[i][k]) * axes[k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return F.struct(F.array(*(center[i] - reach[i] for i in range(3))).alias("lo"), F.array(*(center[i] + reach[i] for i in range(3))).alias("hi"))
