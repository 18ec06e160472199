"""Orientation of planes as column expressions.

A plane's normal n = (east, north, up) is undirected: n and -n are the same plane, so similarity is the absolute
dot product and the error between two planes is acos of it, in degrees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
#: What keeps a division by a vector's length from failing.
EPS = 1e-7


def vector(prefix: str = "n") -> Vector:
    """The columns <prefix>x, <prefix>y, <prefix>z."""
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def literal(v: tuple[float, float, float]) -> Vector:
    return tuple(F.lit(float(x)) for x in v)  # type: ignore[return-value]


def normal(dip: Column, dip_dir: Column) -> Vector:
    """Normal of a plane from dip and dip direction in degrees."""
    d, a = F.radians(dip), F.radians(dip_dir)
    return F.sin(d) * F.sin(a), F.sin(d) * F.cos(a), F.cos(d)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(v: Vector) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Vector, eps: float = EPS) -> Vector:
    """v over its length; a zero vector stays zero."""
    n = length(v) + F.lit(eps)
    return v[0] / n, v[1] / n, v[2] / n


def scaled(v: Vector, by: Column) -> Vector:
    return v[0] * by, v[1] * by, v[2] * by


def sign(x: Column) -> Column:
    """-1 below zero, 1 at zero or above."""
    return F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def aligned(v: Vector, to: Vector) -> Vector:
    """v or -v, whichever lies on the side of the other vector."""
    return scaled(v, sign(dot(v, to)))


def angle(a: Vector, b: Vector) -> Column:
    """Degrees between two planes whose normals are unit vectors: 0 to 90."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def dip(n: Vector) -> Column:
    """Dip of the plane, 0 to 90 degrees."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(n[2]))))


def wrap(x: Column, period: float) -> Column:
    return F.pmod(x, F.lit(float(period)))


def dip_direction(n: Vector) -> Column:
    """Dip direction, 0 to 360 degrees; n and -n agree."""
    azimuth = F.degrees(F.atan2(n[0], n[1]))
    return wrap(azimuth + F.when(n[2] < 0, F.lit(180.0)).otherwise(F.lit(0.0)), 360)


def strike(dip_dir: Column) -> Column:
    """Strike by the right-hand rule: a quarter turn before the dip direction."""
    return wrap(dip_dir - 90, 360)


def dip_vector(dip_dir: Column) -> Vector:
    """Horizontal unit vector along the dip direction."""
    a = F.radians(dip_dir)
    return F.sin(a), F.cos(a), F.lit(0.0)


def strike_vector(dip_dir: Column) -> Vector:
    return dip_vector(dip_dir - 90)


def plane_axis_angle(n: Vector, axis: Vector) -> Column:
    """Degrees between a plane and an axis: 0 if the axis lies in the plane."""
    return F.lit(90.0) - angle(n, axis)


def axial_difference(a: Column, b: Column, period: float = 180.0) -> Column:
    """Smallest difference of two directions on a circle of the given period."""
    d = wrap(a - b, period)
    return F.least(d, F.lit(float(period)) - d)


def trace_strike(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Azimuth of a trace from its first to its last point, modulo 180; a trace of no length lies at 0."""
    return F.when((x0 == x1) & (y0 == y1), F.lit(0.0)).otherwise(wrap(F.degrees(F.atan2(x1 - x0, y1 - y0)), 180))


def vertical_normal(strike_deg: Column) -> Vector:
    """Normal of a vertical plane with this strike."""
    return normal(F.lit(90.0), strike_deg + 90)


#: Strikes, in degrees, around which a trace's set is looked for.
TRACE_CENTERS = (170.0, 50.0, 110.0)


def trace_set(strike_deg: Column, centers: tuple[float, ...] = TRACE_CENTERS) -> Column:
    """Number of the nearest center on the half circle; the first of equals."""
    far = F.array(*(F.struct(axial_difference(strike_deg, F.lit(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)))
    return F.array_min(far)["i"]


def nearest_center(n: Vector, centers: list[tuple[float, float, float]]) -> Column:
    """struct(similarity, k) of the center with the largest absolute dot product; the first of equals."""
    found = F.array(*(F.struct(F.abs(dot(n, literal(c))).alias("similarity"), F.lit(-k).alias("k")) for k, c in enumerate(centers)))
    best = F.array_max(found)
    return F.struct(best["similarity"].alias("similarity"), (-best["k"]).alias("k"))


def raw_terzaghi(n: Vector, axis: Vector, floor: float = 1e-6) -> Column:
    """One over the cosine between a plane's normal and the borehole: planes along the hole are seen less."""
    return 1 / F.greatest(F.lit(floor), F.least(F.lit(1.0), F.abs(dot(n, axis))))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def soft_clamp(x: Column, lo: float, hi: float, tau: float = 0.25) -> Column:
    """A smooth clamp of x to lo and hi."""
    t = F.lit(tau)
    return F.lit(lo) + t * softplus((x - lo) / t) - t * softplus((x - hi) / t)


def kappa_from_resultant(r: Column) -> Column:
    """Concentration from the mean absolute cosine to the center, held between 0.01 and 100."""
    k = r * (3 - r * r) / (1 - r * r)
    return F.when(r > 0.999, 100.0).when(r < 0.01, 0.01).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.01), k)))


def equal_angle_xy(dip_deg: Column, dip_dir: Column) -> tuple[Column, Column]:
    """Pole plot with the horizontal plane at the rim: radius tan((90 - dip) / 2)."""
    r = F.tan(F.radians((90 - dip_deg) / 2))
    return r * F.sin(F.radians(dip_dir)), r * F.cos(F.radians(dip_dir))


def equal_area_xy(dip_deg: Column, dip_dir: Column) -> tuple[Column, Column]:
    """Pole plot with the horizontal plane in the middle: radius sqrt(2) sin(dip / 2)."""
    r = F.sqrt(F.lit(2.0)) * F.sin(F.radians(dip_deg / 2))
    return r * F.sin(F.radians(dip_dir)), r * F.cos(F.radians(dip_dir))


def number_text(x: Column, decimals: int = 1, missing: str = "N/A") -> Column:
    """A number as text; null, NaN and infinities as missing."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(missing)).otherwise(F.format_string(f"%.{decimals}f", x.cast("double")))
