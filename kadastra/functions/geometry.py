"""Geometry on rings held as ``array<array<double>>`` columns.

Sums over vertices are JVM-side higher-order functions; hulls, rotated rectangles, simplification, clipping and
offsets, which they cannot express, are Arrow-batched Python functions over whole columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from . import overlay

# --- fixed values: colour families and default colours --------------------------------------------------
COLOUR_FAMILIES = [
    ("buildable_envelope", (1.0, 0.75, 0.53)), ("infrastructure_zone", (0.8, 0.8, 0.8)), ("landscape_zone", (0.16, 0.78, 0.27)),
    ("restriction_line", (0.87, 0.0, 0.0)), ("zone_boundary", (1.0, 0.61, 0.0)), ("parcel_line", (0.0, 1.0, 1.0)),
    ("context_line", (0.39, 0.39, 0.39)),
]
COLOUR_REACH = 0.35
# --------------------------------------------------------------------------------------------------------


def closed(ring: Column) -> Column:
    """The ring with its first vertex at the end too."""
    first, last = F.get(ring, 0), F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(first == last, ring).otherwise(F.concat(ring, F.array(first)))


def _pairs(ring: Column, f) -> Column:
    """Sum of f(p, q) over consecutive vertices of ``ring`` as it stands."""
    n = F.size(ring)
    ends = F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), f)
    return F.aggregate(ends, F.lit(0.0), lambda a, x: a + x)


def signed_area(ring: Column) -> Column:
    return _pairs(closed(ring), lambda p, q: p[0] * q[1] - q[0] * p[1]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(path: Column) -> Column:
    return _pairs(path, lambda p, q: F.hypot(p[0] - q[0], p[1] - q[1]))


def perimeter(ring: Column) -> Column:
    return length(closed(ring))


def vertex_mean(points: Column) -> Column:
    n = F.size(points)

    def mean(k: int) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / n

    return F.when(n > 0, F.array(mean(0), mean(1)))


def centroid(ring: Column) -> Column:
    """Area-weighted; the mean of the vertices where the ring has no area."""
    a = signed_area(ring)
    c = closed(ring)
    x = _pairs(c, lambda p, q: (p[0] + q[0]) * (p[0] * q[1] - q[0] * p[1]))
    y = _pairs(c, lambda p, q: (p[1] + q[1]) * (p[0] * q[1] - q[0] * p[1]))
    return F.when(a != 0, F.array(x / (6 * a), y / (6 * a))).otherwise(vertex_mean(ring))


def bbox(points: Column) -> Column:
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(
        F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1")
    )


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def to_metres(points: Column, x0: Column, y0: Column, scale: Column) -> Column:
    """Page points to metres on the ground plane (x, 0, z) about (x0, y0), four decimals."""
    return F.transform(
        points, lambda p: F.array(F.round((p[0] - x0) * scale, 4), F.lit(0.0), F.round((p[1] - y0) * scale, 4))
    )


def at_height(points: Column, y: Column) -> Column:
    return F.transform(points, lambda p: F.array(p[0], y, p[2]))


def snap(c: Column, grid: float) -> Column:
    return F.round(c / grid) * grid


def edge_angle(p: Column, q: Column) -> Column:
    return F.atan2(q[1] - p[1], q[0] - p[0])


def _weighed(weights: list[list[float]], points: list[Column]) -> Column:
    """Sums of the points, one for each list of weights: written out, as no lambda is compiled."""
    def total(w: list[float], k: int) -> Column:
        out = w[0] * points[0][k]
        for x, p in zip(w[1:], points[1:], strict=True):
            out = out + x * p[k]
        return out

    return F.array(*(F.array(total(w, 0), total(w, 1)) for w in weights))


def bezier3(p1: Column, p2: Column, p3: Column, p4: Column, n: int = 10) -> Column:
    at = [(i / n, 1 - i / n) for i in range(n + 1)]
    return _weighed([[u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t] for t, u in at], [p1, p2, p3, p4])


def bezier2(p1: Column, p2: Column, p3: Column, n: int = 10) -> Column:
    at = [(i / n, 1 - i / n) for i in range(n + 1)]
    return _weighed([[u * u, 2 * u * t, t * t] for t, u in at], [p1, p2, p3])


def arc(x: Column, y: Column, radius: Column, start: Column, end: Column, n: int = 16) -> Column:
    """Points of an arc in degrees; an end before the start goes once round."""
    stop = F.when(end < start, end + 360).otherwise(end)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.array(
            x + radius * F.cos(F.radians(start + (stop - start) * i / n)),
            y + radius * F.sin(F.radians(start + (stop - start) * i / n)),
        ),
    )


def circle(x: Column, y: Column, radius: Column, n: int = 32) -> Column:
    return arc(x, y, radius, F.lit(0.0), F.lit(360.0), n)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels 0 to 1, cut off."""
    return F.concat(F.lit("#"), *(F.lpad(F.lower(F.hex((c * 255).cast("int"))), 2, "0") for c in (r, g, b)))


def colour_family(r: Column, g: Column, b: Column) -> Column:
    """The nearest family within reach; ties go to the first listed; else null."""
    near = F.array_min(
        F.array(
            *(
                F.struct(
                    F.sqrt(F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")
                )
                for i, (n, (x, y, z)) in enumerate(COLOUR_FAMILIES)
            )
        )
    )
    return F.when(near["d"] <= COLOUR_REACH, near["n"])


def colour_group(r: Column, g: Column, b: Column) -> Column:
    """Coarse colour word; null channels are unfilled."""
    return (
        F.when(r.isNull(), "unfilled")
        .when((r > 0.7) & (g > 0.5) & (b < 0.6), "warm/orange")
        .when((g > 0.5) & (r < 0.4) & (b < 0.5), "green")
        .when((F.abs(r - g) < 0.1) & (F.abs(g - b) < 0.1), "gray")
        .when((r > 0.7) & (g < 0.3), "red")
        .otherwise("other")
    )


def is_gray(r: Column, g: Column, b: Column) -> Column:
    return (r > 0.2) & (r < 0.6) & (F.abs(r - g) < 0.08) & (F.abs(g - b) < 0.08)


def hsl_hex(h: Column, s: float = 0.7, lum: float = 0.5) -> Column:
    """Hue in degrees to #rrggbb."""
    c = (1 - abs(2 * lum - 1)) * s
    k = F.pmod(h / 60.0, F.lit(6.0))
    x = c * (1 - F.abs(F.pmod(k, F.lit(2.0)) - 1))
    m = lum - c / 2
    zero = F.lit(0.0)

    def pick(*six: object) -> Column:
        out = F.lit(six[5]) if not isinstance(six[5], Column) else six[5]
        for i in range(4, -1, -1):
            out = F.when(k < i + 1, six[i]).otherwise(out)
        return out + m

    return rgb_hex(pick(F.lit(c), x, zero, zero, x, F.lit(c)), pick(x, F.lit(c), F.lit(c), x, zero, zero), pick(zero, zero, x, F.lit(c), F.lit(c), x))


def ring_holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring of any shape holds a point: a ray to the right crosses its sides an odd number of times."""
    c = closed(ring)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    sides = F.zip_with(
        F.slice(c, 1, n), F.slice(c, 2, n),
        lambda p, q: ((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]),
    )
    return F.coalesce(F.size(F.filter(sides, lambda s: F.coalesce(s, F.lit(False)))) % 2 == 1, F.lit(False))


def sides_meet(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the box of some side meets the box: no side does where it is false."""
    c = closed(ring)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    meet = F.zip_with(
        F.slice(c, 1, n), F.slice(c, 2, n),
        lambda p, q: (F.least(p[0], q[0]) <= x1) & (F.greatest(p[0], q[0]) >= x0) & (F.least(p[1], q[1]) <= y1) & (F.greatest(p[1], q[1]) >= y0),
    )
    return F.exists(meet, lambda m: m)


# --- plain Python kernels ---------------------------------------------------------------------------------
Point = tuple[float, float]


def hull(points: list[Point]) -> list[Point]:
    """Convex hull, counter-clockwise, without a repeated vertex."""
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(seq: list[Point]) -> list[Point]:
        out: list[Point] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return half(pts)[:-1] + half(pts[::-1])[:-1]


def ring_area(points: list[Point]) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1], strict=True)) / 2


def rotated_box(points: list[Point]) -> tuple[float, float, float]:
    """(long side, short side, angle) of the smallest rectangle around the hull."""
    h = hull(points)
    if len(h) < 2:
        return 0.0, 0.0, 0.0
    best = None
    for p, q in zip(h, h[1:] + h[:1], strict=True):
        d = math.dist(p, q)
        if d == 0:
            continue
        ux, uy = (q[0] - p[0]) / d, (q[1] - p[1]) / d
        a = [x * ux + y * uy for x, y in h]
        b = [y * ux - x * uy for x, y in h]
        w, t = max(a) - min(a), max(b) - min(b)
        if best is None or w * t < best[0]:
            best = (w * t, max(w, t), min(w, t), math.atan2(uy, ux))
    return best[1:] if best else (0.0, 0.0, 0.0)


METRICS = ["aspect_ratio", "compactness", "circularity", "elongation", "min_dim"]
#: What a ring without area counts as.
DEFAULT_METRICS = (1.0, 1.0, 0.5, 0.0, 10.0)


def metrics_of(ring: list[Point] | None) -> tuple[float, float, float, float, float]:
    pts = [(float(p[0]), float(p[1])) for p in ring] if ring is not None else []
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts = pts[:-1]
    a = abs(ring_area(pts)) if len(pts) > 2 else 0.0
    if a == 0:
        return DEFAULT_METRICS
    around = sum(math.dist(p, q) for p, q in zip(pts, pts[1:] + pts[:1], strict=True))
    long, short, _ = rotated_box(pts)
    return (
        long / max(short, 0.001), a / max(abs(ring_area(hull(pts))), 0.001), 4 * math.pi * a / max(around * around, 0.001),
        1 - short / max(long, 0.001), short,
    )


@F.pandas_udf(StructType([*(StructType().add(m, DoubleType())[m] for m in METRICS)]))
def shape_metrics(rings: pd.Series) -> pd.DataFrame:
    """Aspect ratio, compactness, circularity, elongation and smallest width of each ring."""
    return pd.DataFrame([metrics_of(r) for r in rings], columns=METRICS)


def clip(subject: list[Point], window: list[Point]) -> list[Point]:
    """The part of ``subject`` inside a convex window."""
    if ring_area(window) < 0:
        window = window[::-1]
    out = subject
    for a, b in zip(window, window[1:] + window[:1], strict=True):
        cur, out = out, []
        for p, q in zip(cur, cur[1:] + cur[:1], strict=True) if cur else ():
            sp = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
            sq = (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0])
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def simplify(points: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker on an open path, without recursion."""
    if len(points) < 3:
        return points
    keep, work = {0, len(points) - 1}, [(0, len(points) - 1)]
    while work:
        i, j = work.pop()
        (ax, ay), (bx, by) = points[i], points[j]
        d = math.hypot(bx - ax, by - ay)
        far, at = 0.0, -1
        for k in range(i + 1, j):
            x, y = points[k]
            off = abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / d if d else math.hypot(x - ax, y - ay)
            if off > far:
                far, at = off, k
        if far > tolerance:
            keep.add(at)
            work += [(i, at), (at, j)]
    return [points[k] for k in sorted(keep)]


def simplify_ring(ring: list[Point]) -> list[Point]:
    """By 5 hundredths of the square root of the area; unchanged where fewer than three corners would stay."""
    pts = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
    out = simplify([*pts, pts[0]], 0.05 * math.sqrt(abs(ring_area(pts))))[:-1] if len(pts) > 3 else pts
    return out if len(out) > 2 and abs(ring_area(out)) > 0 else pts


def inset(ring: list[Point], d: float) -> list[Point]:
    """The largest part of a ring of any shape moved inwards by ``d`` (mitred); empty when nothing is left."""
    parts = overlay.offset(ring, d)
    return parts[0].outer if parts and parts[0].area > 1e-9 else []


def _rows(s: pd.Series) -> Iterator[list[Point]]:
    for r in s:
        yield [(float(p[0]), float(p[1])) for p in r] if r is not None else []


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def simplified(rings: pd.Series) -> pd.Series:
    return pd.Series([[list(p) for p in simplify_ring(r)] if r else [] for r in _rows(rings)])


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def inset_ring(rings: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([[list(p) for p in inset(r, float(x))] if len(r) > 2 else [] for r, x in zip(_rows(rings), d, strict=True)])


@F.pandas_udf(DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area common to a ring and a convex ring."""
    out = []
    for p, q in zip(_rows(a), _rows(b), strict=True):
        c = clip(p, q) if len(p) > 2 and len(q) > 2 else []
        out.append(abs(ring_area(c)) if len(c) > 2 else 0.0)
    return pd.Series(out)
