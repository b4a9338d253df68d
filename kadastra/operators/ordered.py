"""Steps that take rows in an order and keep what nothing kept before speaks against, over many tasks.

Which rows speak against which is found by a grid join; the rows kept are then the only set in which every row that goes
has one before it that stays.  Rounds find it: rows with nothing left before them stay, and what they speak against
goes.  A round is a few joins on ids, and there are as many as the longest chain of rows that depend on each other; a page
of any size is shared out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import box_area, box_join, common_area
from .steps import settled, shuffled


def gone(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id of the rows that go; ``edges``: keys, a, b where a comes before b and, if it stays, b goes."""
    left = settled(edges.select(*keys, "a", "b").distinct())
    out = left.select(*keys, F.col("b").alias("id")).filter("false")
    while not left.isEmpty():
        free = left.select(*keys, "a").join(shuffled(left.select(*keys, F.col("b").alias("a"))), [*keys, "a"], "left_anti").distinct()
        hit = settled(left.join(shuffled(free), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias("id")).distinct())
        out = out.unionByName(hit)
        left = (
            left.join(shuffled(free), [*keys, "a"], "left_anti").join(shuffled(hit.withColumnRenamed("id", "a")), [*keys, "a"], "left_anti")
            .join(shuffled(hit.withColumnRenamed("id", "b")), [*keys, "b"], "left_anti").select(*keys, "a", "b")
        )
        left = settled(left)
    return out


def skip_overlaps(boxes: DataFrame, keys: list[str], size: float, share: float = 0.2) -> DataFrame:
    """keys, id: in order of id, a box goes when more than ``share`` of it lies on an earlier one that stays."""
    b = boxes.select(*keys, "id", "x0", "y0", "x1", "y1")
    met = box_join(b, b, keys, size, F.col("r_id") < F.col("id"))
    over = met.filter(common_area() > share * box_area()).select(*keys, F.col("r_id").alias("a"), F.col("id").alias("b"))
    return b.select(*keys, "id").join(shuffled(gone(over, keys)), [*keys, "id"], "left_anti")


def _before(area: Column, other: Column) -> Column:
    """Whether the right row comes before: larger, or as large with a smaller id."""
    return (other > area) | ((other == area) & (F.col("r_id") < F.col("id")))


def dedup_boxes(boxes: DataFrame, keys: list[str], size: float, ratio: float = 0.98, near: float = 10.0) -> DataFrame:
    """keys, id, fill: largest first, a box goes when one that stays has an area ratio over ``ratio`` and sides within
    ``near``.  One that stays without a fill takes that of the first box that goes to it (it being the first such) with one."""
    b = boxes.select(*keys, "id", "x0", "y0", "x1", "y1", "fill")
    met = box_join(b, b, keys, size, F.col("id") != F.col("r_id"), near)
    a, o = box_area(), box_area("r_")
    alike = (F.greatest(a, o) == 0) | (F.least(a, o) / F.nullif(F.greatest(a, o), F.lit(0).cast("double")) > ratio)
    close = F.lit(True)
    for c in ("x0", "y0", "x1", "y1"):
        close &= F.abs(F.col(c) - F.col(f"r_{c}")) < near
    same = settled(met.filter(_before(a, o) & F.coalesce(alike, F.lit(False)) & close).select(*keys, F.col("r_id").alias("a"), F.col("id").alias("b"), o.alias("a_area"), a.alias("b_area"), F.col("fill").alias("b_fill")))
    out = settled(gone(same, keys))
    stay = same.join(shuffled(out.withColumnRenamed("id", "a")), [*keys, "a"], "left_anti").join(shuffled(out.withColumnRenamed("id", "b")), [*keys, "b"], "left_semi")
    to = stay.groupBy(*keys, "b").agg(F.min(F.struct((-F.col("a_area")).alias("o"), "a"))["a"].alias("id"), F.first("b_area").alias("b_area"), F.first("b_fill").alias("b_fill"))
    given = to.filter("b_fill is not null").groupBy(*keys, "id").agg(F.min(F.struct((-F.col("b_area")).alias("o"), "b", "b_fill"))["b_fill"].alias("given"))
    kept = b.join(shuffled(out), [*keys, "id"], "left_anti").join(shuffled(given), [*keys, "id"], "left")
    return kept.select(*keys, "id", F.coalesce("fill", "given").alias("fill"))


def cluster(shapes: DataFrame, keys: list[str], size: float, radius: float = 80.0) -> DataFrame:
    """keys, id, head, cluster: the largest free shape (id, cx, cy, area) takes all free ones within ``radius``; clusters of two
    or more, numbered by size (then by their least id) from 0."""
    s = shapes.select(*keys, "id", "cx", "cy", "area", F.col("cx").alias("x0"), F.col("cx").alias("x1"), F.col("cy").alias("y0"), F.col("cy").alias("y1"))
    met = box_join(s, s, keys, size, F.expr(f"id <> r_id and sqrt((cx - r_cx) * (cx - r_cx) + (cy - r_cy) * (cy - r_cy)) <= {radius}"), radius)
    near = settled(met.filter(_before(F.col("area"), F.col("r_area"))).select(*keys, F.col("r_id").alias("a"), F.col("id").alias("b"), F.col("r_area").alias("a_area")))
    out = settled(gone(near, keys))
    # a head is what stays; of several heads the first one takes a shape
    taken = near.join(shuffled(out.withColumnRenamed("id", "a")), [*keys, "a"], "left_anti").join(shuffled(out.withColumnRenamed("id", "b")), [*keys, "b"], "left_semi")
    own = taken.groupBy(*keys, F.col("b").alias("id")).agg(F.min(F.struct((-F.col("a_area")).alias("o"), "a"))["a"].alias("head"))
    members = settled(own.unionByName(own.select(*keys, F.col("head").alias("id"), "head").distinct()))
    groups = members.groupBy(*keys, "head").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    ranked = groups.withColumn("cluster", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "least")) - 1).cast("int"))
    return members.join(shuffled(ranked), [*keys, "head"]).select(*keys, "id", "head", "cluster")
