"""Spatial joins of boxed shapes: an equi-join on (keys, grid cell), then the exact predicate.

Shapes carry ``x0 y0 x1 y1``; where both sides have a ``ring`` too (points of any shape, open or closed), what lies in what
and what is common is decided on the rings, behind the boxes; a null ring is its box.  Both sides are listed under every cell their boxes touch, except that cells are
sized so that most shapes touch few; a pair that meets in several cells is kept once, in the first cell common
to both.  So the plan is a sort-merge join at any size, and a crowded cell is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, overlay
from .steps import dealt, settled, shuffled

BOX = ("x0", "y0", "x1", "y1")


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def with_cells(df: DataFrame, size: float) -> DataFrame:
    """A row for each cell the box touches."""
    return (
        df.withColumn("cell_x", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size))))
        .withColumn("cell_y", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    )


def box_join(left: DataFrame, right: DataFrame, keys: list[str], size: float, how: Column | None = None, reach: float = 0.0) -> DataFrame:
    """Pairs of rows with equal keys whose boxes meet (within ``reach``); right columns get the prefix ``r_``."""
    grown = right.select(
        *keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys),
        (F.col("x0") - reach).alias("x0"), (F.col("y0") - reach).alias("y0"), (F.col("x1") + reach).alias("x1"), (F.col("y1") + reach).alias("y1"),
    )
    a, b = with_cells(left, size), with_cells(grown, size)
    b = b.select(*(F.col(c).alias(f"g_{c}") if c in BOX else F.col(c) for c in b.columns))
    met = a.join(shuffled(b), [*keys, "cell_x", "cell_y"]).filter(
        (F.col("x0") <= F.col("g_x1")) & (F.col("g_x0") <= F.col("x1")) & (F.col("y0") <= F.col("g_y1")) & (F.col("g_y0") <= F.col("y1"))
        & (F.col("cell_x") == F.greatest(_cell(F.col("x0"), size), _cell(F.col("g_x0"), size)))
        & (F.col("cell_y") == F.greatest(_cell(F.col("y0"), size), _cell(F.col("g_y0"), size)))
    )
    met = met.drop("cell_x", "cell_y", *(f"g_{c}" for c in BOX))
    return met.filter(how) if how is not None else met


def common_area() -> Column:
    """Area common to the boxes of a joined pair."""
    w = F.least("x1", "r_x1") - F.greatest("x0", "r_x0")
    h = F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def box_area(prefix: str = "") -> Column:
    return (F.col(f"{prefix}x1") - F.col(f"{prefix}x0")) * (F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))


def box_ring(prefix: str = "") -> Column:
    x0, y0, x1, y1 = (F.col(f"{prefix}{c}").cast("double") for c in BOX)
    return F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))


def with_common(met: DataFrame, name: str = "common") -> DataFrame:
    """``met`` with the area common to each joined pair: of the rings where both sides have them.

    Boxes that hold nothing in common need no overlay."""
    if not {"ring", "r_ring"} <= set(met.columns):
        return met.withColumn(name, common_area())
    a, b = (F.coalesce(F.col(f"{p}ring"), box_ring(p)) for p in ("", "r_"))
    some = common_area() > 0
    return met.withColumn(name, F.when(some, overlay.common_ring_area(F.when(some, a), F.when(some, b))).otherwise(0.0))


def sized(df: DataFrame) -> DataFrame:
    """``df`` with ``size_of`` as a column, so that a pair does not add up its rings again."""
    return df.withColumn("size_", size_of(df))


def size_of(df: DataFrame, prefix: str = "") -> Column:
    """Area of a row's ring, else of its box."""
    if f"{prefix}size_" in df.columns:
        return F.col(f"{prefix}size_")
    ring = F.col(f"{prefix}ring") if f"{prefix}ring" in df.columns else None
    return box_area(prefix) if ring is None else F.when(ring.isNull(), box_area(prefix)).otherwise(geometry.area(ring))


def holds(met: DataFrame, x: Column, y: Column) -> Column:
    """Whether the right shape of a joined pair holds the point, strictly within its box."""
    inside = (x > F.col("r_x0")) & (x < F.col("r_x1")) & (y > F.col("r_y0")) & (y < F.col("r_y1"))
    if "r_ring" not in met.columns:
        return inside
    return inside & (F.col("r_ring").isNull() | geometry.ring_holds(F.col("r_ring"), x, y))


def ring_cells(rings: DataFrame, size: float) -> DataFrame:
    """A row for each cell that a shape with a ``ring`` covers at least in part: ``border`` where a side may pass through,
    else the whole cell lies inside."""
    low_x, low_y = F.col("cell_x") * size, F.col("cell_y") * size
    border = geometry.sides_meet(F.col("ring"), low_x, low_y, low_x + size, low_y + size)
    inner = geometry.ring_holds(F.col("ring"), low_x + size / 2, low_y + size / 2)
    return with_cells(rings, size).withColumn("border", border).filter(F.col("border") | inner)


def points_in_rings(points: DataFrame, rings: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Pairs of a point (x, y) and a ring of any shape (ring, box) that holds it; right columns get the prefix ``r_``.

    Rings are listed by the cells they cover; a point in an inner cell is inside without a look at the ring, one in a
    border cell by the sides that a ray crosses."""
    r = ring_cells(rings, size)
    r = r.select(*keys, "cell_x", "cell_y", *(F.col(c).alias(f"r_{c}") for c in [*rings.columns, "border"] if c not in keys))
    p = points.withColumns({"cell_x": _cell(F.col("x"), size), "cell_y": _cell(F.col("y"), size)})
    inside = ~F.col("r_border") | geometry.ring_holds(F.col("r_ring"), F.col("x"), F.col("y"))
    return p.join(shuffled(r), [*keys, "cell_x", "cell_y"]).filter(inside).drop("cell_x", "cell_y", "r_border")


def ring_overlaps(left: DataFrame, right: DataFrame, keys: list[str], size: float, how: Column | None = None) -> DataFrame:
    """Pairs of shapes that have area in common: ``common``, and what share it is of either (``of_left``, ``of_right``)."""
    some = common_area() > 0
    met = with_common(box_join(sized(left), sized(right), keys, size, some if how is None else how & some)).filter("common > 0")
    a, b = size_of(met), size_of(met, "r_")
    return met.withColumns({"of_left": F.col("common") / F.nullif(a, F.lit(0.0)), "of_right": F.col("common") / F.nullif(b, F.lit(0.0))}).drop("size_", "r_size_")


def plot_gaps(plots: DataFrame, zones: DataFrame, keys: list[str], least: float = 1e-4) -> DataFrame:
    """keys, part, area, points and holes of what the zones leave of each plot (``ring`` of any shape), parts of over
    ``least`` of the plot; several plots of a key each have their own.

    Only zones whose box meets the plot's come along, as arrays in the plot's row, so a page is one row of a map and no
    group of a task."""
    z = zones.select(*keys, F.col("ring").alias("z_ring"), *(F.col(c).alias(f"z_{c}") for c in BOX))
    near = dealt(plots.withColumn("plot_", F.monotonically_increasing_id()), *keys).join(shuffled(z), keys, "left")
    meets = F.expr("x0 < z_x1 and z_x0 < x1 and y0 < z_y1 and z_y0 < y1")
    j = near.groupBy(*keys, "plot_").agg(F.first("ring").alias("ring"), F.sort_array(F.collect_list(F.when(meets, F.col("z_ring")))).alias("z_rings"))
    j = j.withColumn("all_", F.concat(F.array("ring"), "z_rings"))
    j = j.withColumn("left_", overlay.uncovered("all_"))
    parts = j.select(*keys, geometry.area(F.col("ring")).alias("plot_area"), F.posexplode("left_").alias("part", "p"))
    return parts.filter(F.col("p.area") > F.col("plot_area") * least).select(*keys, "part", F.col("p.area").alias("area"), F.col("p.points").alias("points"), F.col("p.holes").alias("holes"))


def smallest_container(points: DataFrame, shapes: DataFrame, keys: list[str], size: float) -> DataFrame:
    """For each point (id, x, y) the shape (id, box) of least area strictly around it; ties to the least id."""
    p = points.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    met = box_join(p, sized(shapes), keys, size)
    met = met.filter(holds(met, F.col("x"), F.col("y")))
    return met.groupBy(*keys, "id").agg(F.min(F.struct(size_of(met, "r_").alias("area"), F.col("r_id").alias("shape"))).alias("s")).select(
        *keys, "id", F.col("s.shape").alias("shape"), F.col("s.area").alias("area")
    )


def near_text(shapes: DataFrame, texts: DataFrame, keys: list[str], reach: float, size: float, k: int = 5, longest: int = 50) -> DataFrame:
    """For each shape (id, cx, cy) up to ``k`` texts (id, x, y, text) shorter than ``longest`` within ``reach``, by id."""
    s = shapes.withColumns({"x0": F.col("cx"), "x1": F.col("cx"), "y0": F.col("cy"), "y1": F.col("cy")})
    t = texts.filter(F.length("text") < longest).withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    met = box_join(s, t, keys, size, F.expr(f"(cx - r_x) * (cx - r_x) + (cy - r_y) * (cy - r_y) < {reach * reach}"), reach)
    return met.groupBy(*keys, "id").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("r_id", "r_text"))), 1, k), lambda x: x["r_text"]), "|").alias("texts")
    )


def dominant_colour(hatches: DataFrame, shapes: DataFrame, keys: list[str], size: float, least: int = 2) -> DataFrame:
    """For each shape the most frequent colour of the hatch points inside; ``least`` hits in all; ties to the
    smallest colour.  Two-level aggregation, so a crowded shape is summed before it is shuffled."""
    p = hatches.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    if "ring" in shapes.columns:
        met = points_in_rings(hatches, shapes.withColumn("ring", F.coalesce("ring", box_ring())), keys, size)
    else:
        met = box_join(p, shapes, keys, size, F.expr("x > r_x0 and x < r_x1 and y > r_y0 and y < r_y1"))
    return (
        met.groupBy(*keys, "r_id", "colour").agg(F.count("*").alias("n"))
        .groupBy(*keys, "r_id").agg(F.sum("n").alias("hits"), F.max(F.struct("n", (-F.col("colour")).alias("c"))).alias("top"))
        .filter(F.col("hits") >= least)
        .select(*keys, F.col("r_id").alias("id"), (-F.col("top.c")).alias("colour"), "hits")
    )


def conflicts(shapes: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Pairs of shapes: containment (over 0.7 of the smaller) or intersection (over 0.15 of either)."""
    own = sized(shapes)
    met = with_common(box_join(own, own, keys, size, (F.col("id") < F.col("r_id")) & (common_area() > 0)))
    a, b = size_of(met), size_of(met, "r_")
    return (
        met.withColumns({"a": a, "b": b})
        .filter("a > 0 and b > 0")
        .withColumn("kind", F.expr("case when common > 0.70 * least(a, b) then 'containment' when common > 0.15 * least(a, b) then 'intersection' end"))
        .filter("kind is not null")
        .select(
            *keys, "kind",
            F.expr("case when kind = 'intersection' or a > b then id else r_id end").alias("first_id"),
            F.expr("case when kind = 'intersection' or a > b then r_id else id end").alias("second_id"),
            F.round(F.expr("case when kind = 'containment' then common / least(a, b) else common / a end"), 3).alias("ratio_1"),
            F.round(F.expr("case when kind = 'containment' then least(a, b) / greatest(a, b) else common / b end"), 3).alias("ratio_2"),
        )
    )


def fill_parents(zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, id, parent: filled shapes of at most a tenth of the plot and the largest larger filled zone around them (over 0.8
    of their area inside), where its fill is similar.  ``zones``: id, zone_type, closed, fill, plot_area, box, ring."""
    filled = sized(zones).filter("closed and fill is not null")
    small = filled.filter("zone_type not in ('plot_boundary', 'minor_context')").filter(size_of(filled) <= F.col("plot_area") * 0.10)
    parents = filled.filter("zone_type not in ('plot_boundary', 'sub_zone', 'minor_context')")
    met = box_join(small, parents, keys, size, F.col("id") != F.col("r_id"))
    met = with_common(met.filter(size_of(met, "r_") > size_of(met)))
    inside = met.filter(F.col("common") > 0.8 * size_of(met))
    top = inside.groupBy(*keys, "id", "fill").agg(
        F.max(F.struct(size_of(met, "r_").alias("area"), (-F.col("r_id")).alias("neg"), F.col("r_fill").alias("fill"))).alias("p")
    )
    alike = F.expr("abs(fill[0] - p.fill[0]) < 0.12 and abs(fill[1] - p.fill[1]) < 0.12 and abs(fill[2] - p.fill[2]) < 0.12")
    return top.filter(alike).select(*keys, "id", (-F.col("p.neg")).alias("parent"))


def inherited_fill(zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The shapes of ``fill_parents`` are buildings, taken in order of id: one that becomes a building loses its fill at once,
    and a later zone whose deciding zone it is keeps its own.

    A deciding zone is larger, so rounds of one join each end after as many as the longest such chain."""
    like = settled(fill_parents(zones, keys, size))
    # those whose deciding zone goes before them and may become a building itself
    first = like.select(*keys, F.col("id").alias("parent"))
    hangs = settled(like.filter("parent < id").join(shuffled(first), [*keys, "parent"], "left_semi"))
    hit = like
    if not hangs.isEmpty():
        kept = hangs.select(*keys, "id")
        while True:
            gone = like.join(shuffled(kept), [*keys, "id"], "left_anti").select(*keys, F.col("id").alias("parent"))
            now = settled(hangs.join(shuffled(gone), [*keys, "parent"], "left_semi").select(*keys, "id"))
            same = now.join(shuffled(kept), [*keys, "id"], "left_anti").isEmpty() and kept.join(shuffled(now), [*keys, "id"], "left_anti").isEmpty()
            kept = now
            if same:
                break
        hit = like.join(shuffled(kept), [*keys, "id"], "left_anti")
    return hit.select(*keys, "id", "parent", F.lit("sub_zone").alias("zone_type"))


def containers(shapes: DataFrame, keys: list[str], size: float, share: float = 0.8) -> DataFrame:
    """Shapes that hold others (over ``share`` of the inner area), with how many and the inner area."""
    own = sized(shapes)
    met = with_common(box_join(own, own, keys, size, (F.col("id") != F.col("r_id")) & (common_area() > 0)))
    return (
        met.filter(F.col("common") > share * size_of(met, "r_"))
        .groupBy(*keys, "id")
        .agg(F.count("*").alias("n_inner"), F.sum(size_of(met, "r_")).alias("inner_area"), F.first(size_of(met)).alias("outer_area"))
    )


def first_envelope(buildings: DataFrame, envelopes: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The first envelope (least id) that holds a building's centre or over 0.3 of its area."""
    met = with_common(box_join(buildings, envelopes, keys, size))
    if "ring" in buildings.columns:
        middle = geometry.centroid(F.coalesce("ring", box_ring()))
        centre = F.coalesce(holds(met, middle[0], middle[1]), F.lit(False))
    else:
        centre = F.expr("x0 + x1 > 2 * r_x0 and x0 + x1 < 2 * r_x1 and y0 + y1 > 2 * r_y0 and y0 + y1 < 2 * r_y1")
    return met.filter(centre | (F.col("common") > 0.3 * size_of(met))).groupBy(*keys, "id").agg(F.min("r_id").alias("envelope"))


def empty_envelopes(envelopes: DataFrame, buildings: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Envelopes without any building."""
    taken = first_envelope(buildings, envelopes, keys, size).select(*keys, F.col("envelope").alias("id")).distinct()
    return envelopes.join(shuffled(taken), [*keys, "id"], "left_anti")


def neighbour_type(gaps: DataFrame, zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The commonest type among zones whose side touches a gap along more than 1; ties to the least id seen first."""
    met = box_join(gaps, zones, keys, size)
    w, h = F.least("x1", "r_x1") - F.greatest("x0", "r_x0"), F.least("y1", "r_y1") - F.greatest("y0", "r_y0")
    beside = met.filter(((w == 0) & (h > 1)) | ((h == 0) & (w > 1)))
    n = beside.groupBy(*keys, "id", "r_zone_type").agg(F.count("*").alias("n"), F.min("r_id").alias("seen"))
    return n.groupBy(*keys, "id").agg(F.max_by("r_zone_type", F.struct("n", -F.col("seen"))).alias("zone_type"))
