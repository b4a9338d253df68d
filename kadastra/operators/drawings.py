"""From drawing items to paths: the points of lines, curves and boxes of a path in their order.

Items are rows of ``keys`` (a page), ``path``, ``seq``, ``kind`` (l, c, qu, re) and ``at`` (array<double>: the points' x and y one
after the other; of a box its x0 y0 x1 y1).  Style columns go on with the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

#: Points of a kind, and how far from the last point a new start is a point of its own.
NUMBERS = {"l": 4, "c": 8, "qu": 6, "re": 4}
APART = 0.5


def whole_item(kind: Column, at: Column) -> Column:
    """Whether an item is of a known kind and has all its coordinates."""
    right = F.size(at) == F.coalesce(*(F.when(kind == k, n) for k, n in NUMBERS.items()))
    return F.coalesce(right & ~F.exists(at, lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def item_points(kind: Column, at: Column) -> Column:
    """Points of a whole item, its start first; curves in ten steps."""
    p = [F.array(F.get(at, F.lit(2 * i)), F.get(at, F.lit(2 * i + 1))) for i in range(4)]
    x0, y0, x1, y1 = (F.get(at, F.lit(i)) for i in range(4))
    return (
        F.when(kind == "l", F.array(p[0], p[1])).when(kind == "c", geometry.bezier3(*p)).when(kind == "qu", geometry.bezier2(*p[:3]))
        .when(kind == "re", F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0)))
    )


def reconstruct_paths(items: DataFrame, keys: list[str], style: list[str] = ()) -> DataFrame:
    """keys, path, style, points, box (x0 y0 x1 y1) and bbox_area of each path of two points or more.

    The start of a line or curve is a point only where it is over ``APART`` from the last point in x or y; a box brings all
    its points.  An item of an unknown kind or with missing coordinates is as if it were not there.  The style is that of
    the path's first item."""
    own = [*keys, "path"]
    whole = items.filter(whole_item(F.col("kind"), F.col("at")))
    w = Window.partitionBy(*own).orderBy("seq")
    # a box ends where it starts, others in their last point; points are made behind the shuffle
    end = F.when(F.col("kind") == "re", F.slice("at", 1, 2)).otherwise(F.slice("at", -2, 2))
    ends = whole.withColumn("before", F.lag(end).over(w))
    goes_on = (F.col("kind") != "re") & (F.abs(F.get("before", F.lit(0)) - F.get("at", F.lit(0))) <= APART) & (F.abs(F.get("before", F.lit(1)) - F.get("at", F.lit(1))) <= APART)
    points = item_points(F.col("kind"), F.col("at"))
    runs = ends.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", points)
    runs = runs.withColumn("run", F.when(F.col("goes_on"), F.slice("run", 2, F.size("run"))).otherwise(F.col("run")))
    paths = runs.groupBy(*own).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "run"))), lambda r: r["run"])).alias("points"),
        *(F.min_by(c, "seq").alias(c) for c in style),
    )
    box = geometry.bbox(F.col("points"))
    return paths.filter(F.size("points") >= 2).select(
        *own, *style, "points", *(box[c].alias(c) for c in ("x0", "y0", "x1", "y1")), ((box["x1"] - box["x0"]) * (box["y1"] - box["y0"])).alias("bbox_area")
    )
