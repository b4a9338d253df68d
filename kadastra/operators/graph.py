"""Faces of a planar graph over many tasks: next half-edges by a window at each corner, faces by pointer doubling.

A half-edge goes on with the clockwise neighbour at its end, which a window over that corner's few neighbours finds.  So
half-edges form cycles, one a side of a face.  In each round a half-edge takes the smallest name of twice as many that
follow it; after as many rounds as the longest cycle has binary digits all of a cycle have one name.  A second pass of
doubling counts the steps to the cycle's first half-edge, which orders its corners.  Nothing but a corner's neighbours and
a finished face's corners ever meets in one task, so a page of any size is shared out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import settled, shuffled

_U, _V = ("ux", "uy"), ("vx", "vy")


def half_edges(segments: DataFrame, keys: list[str], grid: float) -> DataFrame:
    """keys, u and v of both directions of each segment (x0 y0 x1 y1) whose ends, snapped to the grid, differ; once each."""

    def snap(c: str) -> Column:
        return F.rint(F.col(c) / grid) * grid + 0.0  # no negative zero

    s = segments.select(*keys, snap("x0").alias("ux"), snap("y0").alias("uy"), snap("x1").alias("vx"), snap("y1").alias("vy")).filter("ux <> vx or uy <> vy")
    back = s.select(*keys, F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.col("ux").alias("vx"), F.col("uy").alias("vy"))
    return s.unionByName(back).distinct()


def next_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges`` with the angle at u and the corner (nx, ny) that the half-edge from v goes on to."""
    e = edges.withColumn("angle", F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")))
    w = Window.partitionBy(*keys, *_U).orderBy("angle", "vx", "vy")  # edges may lie on each other
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    to = F.struct("vx", "vy")
    # of each corner and neighbour the neighbour before it, the last one before the first
    turn = e.select(*keys, F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("vx").alias("ux"), F.col("vy").alias("uy"), F.coalesce(F.lag(to).over(w), F.last(to).over(all_of)).alias("n"))
    return e.join(shuffled(turn), [*keys, *_U, *_V]).select(*keys, *_U, *_V, "angle", F.col("n.vx").alias("nx"), F.col("n.vy").alias("ny"))


def cycles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Half-edges (keys, u, v, angle, n) with ``first``, the number of the first half-edge of their cycle (by u, then angle), and
    ``steps``, how many go on from it to that one.

    Half-edges are numbered once, so a round moves and keeps a few numbers a half-edge."""
    named = settled(edges.withColumn("h", F.monotonically_increasing_id()))
    on = named.select(*keys, F.col("ux").alias("vx"), F.col("uy").alias("vy"), F.col("vx").alias("nx"), F.col("vy").alias("ny"), F.col("h").alias("go"))
    h = settled(named.join(shuffled(on), [*keys, *_V, "nx", "ny"]).select("h", "go"))
    now = h.withColumn("low", F.col("h"))
    while True:
        far = now.select(F.col("h").alias("go"), F.col("go").alias("go2"), F.col("low").alias("low2"))
        new = settled(now.join(shuffled(far), "go").select("h", F.col("go2").alias("go"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    name = now.select("h", "low")
    order = F.struct(*_U, "angle", *_V)
    first = name.join(shuffled(named), "h").groupBy("low").agg(F.min_by("h", order).alias("first"))
    at = name.join(shuffled(first), "low").join(shuffled(h), "h")
    steps = settled(at.select("h", "first", F.when(F.col("h") != F.col("first"), F.col("go")).alias("go"), F.when(F.col("h") == F.col("first"), 0).otherwise(1).alias("steps")))
    while True:
        far = steps.select(F.col("h").alias("go"), F.col("go").alias("go2"), F.col("steps").alias("more"))
        open_ = steps.filter("go is not null")
        if open_.isEmpty():
            break
        gone = open_.join(shuffled(far), "go").select("h", "first", F.col("go2").alias("go"), (F.col("steps") + F.col("more")).alias("steps"))
        steps = settled(steps.filter("go is null").unionByName(gone))
    return named.select(*keys, *_U, *_V, "h").join(shuffled(steps.select("h", "first", "steps")), "h").select(*keys, *_U, *_V, "first", "steps")


def faces(segments: DataFrame, keys: list[str], grid: float = 2.0, least: float = 1.0) -> DataFrame:
    """keys, area and points of the faces of the segments (x0 y0 x1 y1) of each key, their ends snapped to a grid.

    The outer side turns the other way and goes; so do faces of ``least`` or less, and one over three times the second
    largest.  Points are counter-clockwise from the lowest corner.  Segments without length and repeated ones don't matter."""
    c = cycles(next_edges(half_edges(segments, keys, grid), keys), keys)
    cross = F.col("ux") * F.col("vy") - F.col("vx") * F.col("uy")
    # the first half-edge has no steps to go, the second one the most
    order = F.when(F.col("steps") == 0, F.lit(-(1 << 30))).otherwise(-F.col("steps"))
    rings = c.groupBy(*keys, "first").agg(
        (F.sum(cross) / 2).alias("area"), F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "ux", "uy"))), lambda p: F.array(p["ux"], p["uy"])).alias("points")
    )
    found = settled(rings.filter((F.col("area") > least) & (F.size("points") > 2)).select(*keys, "area", "points"))
    top = found.groupBy(*keys).agg(F.max("area").alias("most"))
    rest = found.join(shuffled(top), keys).groupBy(*keys, "most").agg(F.count_if(F.col("area") == F.col("most")).alias("ties"), F.max(F.when(F.col("area") < F.col("most"), F.col("area"))).alias("second"))
    alone = rest.filter("ties = 1 and second is not null and most > 3 * second").select(*keys, F.col("most").alias("area"))
    return found.join(shuffled(alone), [*keys, "area"], "left_anti").select(*keys, "area", "points")
