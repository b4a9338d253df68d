"""From the shapes of a page to its zones: plot, hierarchy, rule classes, nesting, labels, the output table.

Shapes are rows of ``keys`` (a page), ``id``, ``closed``, ``area``, their box ``x0 y0 x1 y1`` and what each step
names.  What lies in what is decided on the shapes' ``ring`` where the table has one, else on boxes, by the grid joins of
``spatial``; a page has one plot, so joins with it are on the page's keys and its side has one row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, geometry, overlay
from . import graph, greedy
from .spatial import box_area, box_join, box_ring, containers, inherited_fill, smallest_container
from .steps import settled

# --- fixed values ------------------------------------------------------------------------------------------
#: Words that make a text of a plan worth keeping.
PLAN_TEXT = [
    "height", "setback", "max", "min", "sqm", "m2", "limit", "grens", "kavel", "m²", "floor", "level", "area", "boundary", "plot", "zone",
    "regel", "bouw", "hoogte", "goot", "nok", "bebouw", "rooilijn", "meter",
]
#: Types whose members are never promoted for lying in one of their own type.
NOT_NESTED = ["plot_boundary", "sub_zone", "minor_context", "context_line"]
REBUILT = ["chain_join", "planar_face"]
#: Added to the method of a zone whose fill is its parent's.
INHERITED = "+inherited_fill→building"
# -----------------------------------------------------------------------------------------------------------


def pick_plot(shapes: DataFrame, keys: list[str], width: float = 0.5) -> DataFrame:
    """keys, plot_id and the plot's box and area: the largest closed, unfilled shape of over a twentieth of the page
    drawn at least ``width`` wide, else the largest closed one; ties to the least id.

    ``shapes``: fill, width, page_area besides.  Pages without closed shapes have no row."""
    fits = F.col("fill").isNull() & (F.col("area") > F.col("page_area") * 0.05) & (F.col("width") >= width)
    order = F.struct(F.coalesce(fits, F.lit(False)).cast("int"), "area", -F.col("id"))
    more = _ring(shapes)
    top = shapes.filter("closed").groupBy(*keys).agg(F.max_by(F.struct("id", "area", "x0", "y0", "x1", "y1", *more), order).alias("p"))
    return top.select(*keys, F.col("p.id").alias("plot_id"), F.col("p.area").alias("plot_area"), *(F.col(f"p.{c}").alias(f"plot_{c}") for c in ("x0", "y0", "x1", "y1", *more)))


def _ring(shapes: DataFrame) -> list[str]:
    return ["ring"] if "ring" in shapes.columns else []


def _in_plot(shapes: DataFrame) -> Column:
    """Whether a shape lies in the plot (its box, where there are no rings), or over 0.8 of its area does."""
    if _ring(shapes):
        a, b = F.coalesce("ring", box_ring()), F.coalesce("plot_ring", box_ring("plot_"))
        meet = F.col("plot_id").isNotNull() & (F.col("x0") <= F.col("plot_x1")) & (F.col("x1") >= F.col("plot_x0")) & (F.col("y0") <= F.col("plot_y1")) & (F.col("y1") >= F.col("plot_y0"))
        return F.coalesce(F.when(meet, overlay.common_ring_area(F.when(meet, a), F.when(meet, b))) > F.col("area") * 0.8, F.lit(False))
    w = F.least("x1", "plot_x1") - F.greatest("x0", "plot_x0")
    h = F.least("y1", "plot_y1") - F.greatest("y0", "plot_y0")
    common = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    held = (F.col("x0") >= F.col("plot_x0")) & (F.col("x1") <= F.col("plot_x1")) & (F.col("y0") >= F.col("plot_y0")) & (F.col("y1") <= F.col("plot_y1"))
    return F.coalesce(held | (common > F.col("area") * 0.8), F.lit(False))


def hierarchy(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """``boundaries`` with their ``role``: plot, zone (large or drawn in a colour), subzone_candidate or unclassified
    (outside the plot).  ``stroke`` array<double> besides the columns of ``pick_plot``."""
    b = boundaries.filter("area > 0")
    j = b.join(pick_plot(b, keys, 0.3), keys, "left").withColumn("in_plot_", _in_plot(b))
    s = F.col("stroke")
    black = (s[0] < 0.15) & (s[1] < 0.15) & (s[2] < 0.15)
    coloured = F.coalesce(s.isNotNull() & ~black & ~geometry.is_gray(s[0], s[1], s[2]), F.lit(False))
    role = (
        F.when(F.col("id") == F.col("plot_id"), "plot").when(~F.col("in_plot_"), "unclassified")
        .when((F.col("area") / F.col("page_area") > 0.015) | coloured, "zone").otherwise("subzone_candidate")
    )
    return j.select(*boundaries.columns, role.alias("role"))


def open_segments(paths: DataFrame) -> DataFrame:
    """Unfilled paths of two points or more that do not close and are half a unit long (fill, points)."""
    n, p = F.size("points"), F.col("points")
    first, last = F.get(p, F.lit(0)), F.try_element_at(p, F.lit(-1))
    shut = (n >= 4) & (F.hypot(first[0] - last[0], first[1] - last[1]) < 5)
    return paths.filter(F.col("fill").isNull() & (n >= 2) & ~shut & (geometry.length(p) >= 0.5))


def segments_in_plot(segments: DataFrame, plots: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (x0 y0 x1 y1) whose middle lies in the page's plot; all of a page without one."""
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    j = segments.join(plots, keys, "left")
    inside = (mx > F.col("plot_x0")) & (mx < F.col("plot_x1")) & (my > F.col("plot_y0")) & (my < F.col("plot_y1"))
    return j.filter(F.col("plot_id").isNull() | inside).select(*segments.columns)


def adaptive_subzones(segments: DataFrame, boundaries: DataFrame, keys: list[str], style: list[str], gap: float = 8.0) -> DataFrame:
    """Shapes rebuilt from loose segments (id, box) on pages that draw buildings as dashes.

    Segments in the plot are chained by ``style``; a closed chain of under a twentieth of the page is a shape
    (chain_join), the segments of long or large chains are taken apart into faces (planar_face); thin and tiny shapes go.
    Returns keys, style, strategy, area and points."""
    plots = pick_plot(boundaries.filter("area > 0"), keys, 0.3)
    loose = segments_in_plot(segments, plots, keys)
    seen = hierarchy(boundaries, keys).filter("role = 'subzone_candidate'").groupBy(*keys).agg(F.count("*").alias("n_closed"))
    drawn = loose.groupBy(*keys).agg(F.count("*").alias("n_open")).join(seen, keys, "left")
    kind = classify.representation(F.coalesce("n_closed", F.lit(0)), F.col("n_open"))
    pages = drawn.filter(kind.isin("fragmented_dashes", "mixed")).select(*keys)
    page = boundaries.groupBy(*keys).agg(F.max("page_area").alias("page_area"))
    chains = greedy.chain(loose.join(pages, keys, "left_semi"), [*keys, *style], gap, 5).join(page, keys)
    box = geometry.bbox(F.col("points"))
    size = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])
    chains = chains.withColumn("kind", F.when(F.col("closed") & (size < F.col("page_area") * 0.05), "shape").when((F.size("points") > 50) | (size > F.col("page_area") * 0.05), "mega"))
    steps = F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.get("points", i).alias("q")))
    mega = chains.filter("kind = 'mega'").select(*keys, *style, F.explode(steps).alias("e")).select(
        *keys, *style, F.col("e.p")[0].alias("x0"), F.col("e.p")[1].alias("y0"), F.col("e.q")[0].alias("x1"), F.col("e.q")[1].alias("y1"),
        F.monotonically_increasing_id().alias("id"),
    )
    faces = graph.faces(mega, [*keys, *style]).join(page, keys).select(*keys, *style, F.lit("planar_face").alias("strategy"), "points", "page_area")
    found = chains.filter("kind = 'shape'").select(*keys, *style, F.lit("chain_join").alias("strategy"), "points", "page_area").unionByName(faces)
    found = found.withColumns({"area": geometry.area(F.col("points")), "m": geometry.shape_metrics("points")})
    thin = (F.col("m.aspect_ratio") > 10.0) | (F.col("m.elongation") > 0.92) | (F.col("m.min_dim") < 1.5)
    return found.filter(~thin & (F.col("area") >= F.col("page_area") * 1e-4)).select(*keys, *style, "strategy", F.round("area", 4).alias("area"), "points")


def classify_zones(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """``shapes`` with zone_type, confidence, method, colour and whether they lie in the plot, by the rules of
    ``classify.rule_class``; open lines go by their stroke.

    ``shapes``: fill and stroke array<double>, width, page_area, strategy, and the five shape measures besides."""
    fill, stroke = F.col("fill"), F.col("stroke")
    m = [F.col(c) for c in geometry.METRICS]
    c = F.col
    j = shapes.join(pick_plot(shapes, keys), keys, "left").withColumns(
        {
            "inside": _in_plot(shapes), "building": classify.is_building_shape(m[0], m[1], m[3], m[2], m[4]), "artifact_": classify.is_artifact_shape(m[0], m[1], m[3], m[4]),
            "fill_": geometry.colour_family(fill[0], fill[1], fill[2]), "stroke_": geometry.colour_family(stroke[0], stroke[1], stroke[2]), "plot_area": F.coalesce("plot_area", "page_area"),
        }
    )
    r = classify.rule_class(
        c("id") == c("plot_id"), fill.isNotNull(), c("fill_"), c("stroke_"), c("artifact_"), c("building"), c("inside"), c("width"), c("area"), c("plot_area"), c("strategy"),
    )
    j = settled(j.withColumn("r", F.when(F.col("closed"), r).otherwise(classify.open_class(c("stroke_"), stroke.isNull()))))
    seen = F.coalesce(fill, stroke)
    return j.select(
        *shapes.columns, "inside", "building", F.col("r.zone_type").alias("zone_type"), F.col("r.confidence").alias("confidence"), F.col("r.method").alias("method"),
        geometry.rgb_hex(seen[0], seen[1], seen[2]).alias("colour"),
    )


def dedup_zones(zones: DataFrame, keys: list[str]) -> DataFrame:
    """One zone of those with the same rounded box, number of points and colours: the filled, widest, surest; type,
    confidence and method come from the surest of all; ties to the least id.  ``zones``: n_points besides."""
    hexes = [F.coalesce(geometry.rgb_hex(F.col(c)[0], F.col(c)[1], F.col(c)[2]), F.lit("none")) for c in ("fill", "stroke")]
    same = [F.round(c).cast("long").alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]
    z = zones.select("*", *same, hexes[0].alias("_fill"), hexes[1].alias("_stroke"))
    best = F.struct(F.col("fill").isNotNull().cast("int"), "width", "confidence", -F.col("id"))
    sure = F.struct("confidence", -F.col("id"))
    g = z.groupBy(*keys, "_x0", "_y0", "_x1", "_y1", "n_points", "_fill", "_stroke").agg(
        F.max_by(F.struct(*zones.columns), best).alias("best"), F.max_by(F.struct("zone_type", "confidence", "method"), sure).alias("sure")
    )
    better = F.col("sure.confidence") > F.col("best.confidence")
    return g.select(
        *(F.when(better, F.col(f"sure.{c}")).otherwise(F.col(f"best.{c}")).alias(c) if c in ("zone_type", "confidence", "method") else F.col(f"best.{c}").alias(c) for c in zones.columns)
    )


def demote_inherited(zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Small filled zones in a larger zone of a like fill are buildings: type sub_zone, no fill, confidence 0.75 at least.

    The plot's area, or the largest, is what a tenth is taken of."""
    plot = zones.filter("closed").groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("zone_type") == "plot_boundary", F.col("area"))), F.max("area")).cast("double").alias("plot_area")
    )
    z = zones.join(plot, keys, "left")
    hit = inherited_fill(z.select(*keys, "id", "zone_type", "closed", "fill", "plot_area", "x0", "y0", "x1", "y1", *_ring(z)), keys, size).select(*keys, "id", "parent")
    j = zones.join(hit, [*keys, "id"], "left")
    is_in = F.col("parent").isNotNull()
    return j.select(
        *(
            F.when(is_in, F.lit("sub_zone")).otherwise(F.col(c)).alias(c) if c == "zone_type"
            else F.when(is_in, F.greatest("confidence", F.lit(0.75))).otherwise(F.col(c)).alias(c) if c == "confidence"
            else F.when(is_in, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "fill"
            else F.when(is_in, F.concat("method", F.lit(INHERITED))).otherwise(F.col(c)).alias(c) if c == "method"
            else F.col(c)
            for c in zones.columns
        )
    )


def promote_nested(zones: DataFrame, keys: list[str]) -> DataFrame:
    """Closed zones over 0.8 in the largest of their own type: an unfilled building shape becomes a building, a filled
    one is marked.  The parent is one row a key and type.  ``zones``: building (boolean) besides."""
    ring = zones.filter(F.col("closed") & ~F.col("zone_type").isin(*NOT_NESTED))
    top = ring.groupBy(*keys, "zone_type").agg(F.max_by(F.struct("id", "x0", "y0", "x1", "y1", *_ring(zones)), F.struct("area", -F.col("id"))).alias("p"))
    j = zones.join(top, [*keys, "zone_type"], "left")
    w = F.least(F.col("x1"), F.col("p.x1")) - F.greatest(F.col("x0"), F.col("p.x0"))
    h = F.least(F.col("y1"), F.col("p.y1")) - F.greatest(F.col("y0"), F.col("p.y0"))
    common = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    if _ring(zones):
        some = F.col("closed") & (common > 0)
        both = overlay.common_ring_area(F.when(some, F.coalesce("ring", box_ring())), F.when(some, F.coalesce("p.ring", box_ring("p."))))
        j = j.withColumn("common_", F.when(some, both).otherwise(0.0))
        common = F.col("common_")
    nested = F.coalesce(F.col("closed") & (F.col("id") != F.col("p.id")) & (common > F.col("area") * 0.8), F.lit(False))
    house = nested & F.col("fill").isNull() & F.coalesce("building", F.lit(False))
    marked = nested & F.col("fill").isNotNull()
    new = {
        "zone_type": F.when(house, "sub_zone").otherwise(F.col("zone_type")),
        "confidence": F.when(house, F.greatest("confidence", F.lit(0.80))).otherwise(F.col("confidence")),
        "method": F.when(house, F.concat("method", F.lit("+nested_building"))).when(marked, F.concat("method", F.lit("+nested_subzone"))).otherwise(F.col("method")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in zones.columns))


def envelopes_of_buildings(zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Buildings that hold other buildings become buildable envelopes of confidence 0.80 at least."""
    houses = zones.filter("closed and zone_type = 'sub_zone'").select(*keys, "id", "x0", "y0", "x1", "y1", *_ring(zones))
    outer = containers(houses, keys, size).select(*keys, "id", "n_inner")
    j = zones.join(outer, [*keys, "id"], "left")
    hit = F.col("n_inner") >= 1
    new = {
        "zone_type": F.when(hit, "buildable_envelope").otherwise(F.col("zone_type")),
        "confidence": F.when(hit, F.greatest("confidence", F.lit(0.80))).otherwise(F.col("confidence")),
        "method": F.when(hit, F.concat(F.col("method"), F.lit("+envelope("), F.col("n_inner").cast("string"), F.lit("_inner)"))).otherwise(F.col("method")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in zones.columns))


def label_zones(zones: DataFrame, texts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """``zones`` with ``label`` from the texts (id, x, y, text) whose smallest closed zone they are; context and nameless
    shapes with a name or tag become buildings of 0.85 at least."""
    held = smallest_container(texts.filter("trim(text) <> ''").select(*keys, "id", "x", "y"), zones.filter("closed").select(*keys, "id", "x0", "y0", "x1", "y1", *_ring(zones)), keys, size)
    lines = held.join(texts.select(*keys, "id", "text"), [*keys, "id"])
    joined = lines.groupBy(*keys, F.col("shape").alias("id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("t"), "text"))), lambda x: x["text"]), "\n").alias("said")
    )
    j = zones.join(joined, [*keys, "id"], "left").withColumn("label", classify.parse_label(F.col("said")))
    named = F.coalesce(F.col("label").isNotNull() & ~F.startswith("label", F.lit("h=")), F.lit(False)) & F.col("zone_type").isin("minor_context", "unknown", "sub_zone", "context_line")
    new = {
        "zone_type": F.when(named, "sub_zone").otherwise(F.col("zone_type")),
        "confidence": F.when(named, F.greatest("confidence", F.lit(0.85))).otherwise(F.col("confidence")),
        "method": F.when(named, F.concat("method", F.lit("+text_label"))).otherwise(F.col("method")),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in zones.columns if c != "label"), "label")


def marker_labels(markers: DataFrame, texts: DataFrame, zones: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, id of a zone and ``labels``: for each marker (id, box) the first text (id, x, y, text) nearer to its centre
    than one and a half of its radius, given to the smallest closed zone around it, in order of the markers."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    reach = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 * 1.5
    m = markers.select(*keys, "id", cx.alias("cx"), cy.alias("cy"), reach.alias("reach"))
    around = m.select("*", (F.col("cx") - F.col("reach")).alias("x0"), (F.col("cx") + F.col("reach")).alias("x1"), (F.col("cy") - F.col("reach")).alias("y0"), (F.col("cy") + F.col("reach")).alias("y1"))
    t = texts.filter("trim(text) <> ''").select(*keys, "id", "x", "y", F.trim("text").alias("text"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), F.col("y").alias("y1"))
    near = box_join(around, t, keys, size, F.expr("(cx - r_x) * (cx - r_x) + (cy - r_y) * (cy - r_y) < reach * reach"))
    first = near.groupBy(*keys, "id", "cx", "cy").agg(F.min(F.struct("r_id", "r_text"))["r_text"].alias("text"))
    held = smallest_container(first.select(*keys, "id", F.col("cx").alias("x"), F.col("cy").alias("y")), zones.filter("closed").select(*keys, "id", "x0", "y0", "x1", "y1", *_ring(zones)), keys, size)
    return held.join(first.select(*keys, "id", "text"), [*keys, "id"]).groupBy(*keys, F.col("shape").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("m"), "text"))), lambda x: x["text"]).alias("labels")
    )


def keep_zones(zones: DataFrame, keys: list[str]) -> DataFrame:
    """What the noise filter keeps, with one plot boundary a page: of several the one of most points stays, and others
    only if they have over six.  ``zones``: label, width, page_area, n_points besides."""
    kept = zones.filter(classify.is_kept(F.col("zone_type"), F.col("label"), F.col("closed"), F.col("area"), F.col("page_area"), F.col("width"), box_area()))
    plots = kept.filter("zone_type = 'plot_boundary'")
    most = plots.groupBy(*keys).agg(F.max_by("id", F.struct("n_points", -F.col("id"))).alias("best"))
    gone = plots.join(most, keys).filter("id <> best and n_points <= 6").select(*keys, "id")
    return kept.join(gone, [*keys, "id"], "left_anti")


def page_zones(shapes: DataFrame, texts: DataFrame, keys: list[str], size: float) -> DataFrame:
    """All of it: classes, duplicates, inherited fills, nesting, envelopes, labels and the noise filter."""
    z = settled(dedup_zones(classify_zones(shapes, keys), keys))
    z = settled(promote_nested(settled(demote_inherited(z, keys, size)), keys))
    z = settled(envelopes_of_buildings(z, keys, size))
    return keep_zones(settled(label_zones(z, texts, keys, size)), keys)


def to_output(zones: DataFrame, keys: list[str], scale: Column) -> DataFrame:
    """The output table: points in metres about the middle of the page's geometry on the ground plane, rings
    counter-clockwise, areas, a default colour by type, rounded confidence.  ``zones``: points, colour, label."""
    box = geometry.bbox(F.col("points"))
    lows = zones.select("*", box.alias("b")).groupBy(*keys).agg(((F.min("b.x0") + F.max("b.x1")) / 2).alias("mx"), ((F.min("b.y0") + F.max("b.y1")) / 2).alias("my"))
    j = zones.join(lows, keys)
    flip = F.col("closed") & (F.size("points") >= 3) & (geometry.signed_area(F.col("points")) < 0)
    ring = F.when(flip, F.reverse("points")).otherwise(F.col("points"))
    return j.select(
        *keys, "id", F.when(F.col("closed"), "Polygon").otherwise("Polyline").alias("type"), "zone_type",
        geometry.to_metres(ring, F.col("mx"), F.col("my"), scale).alias("points"), "closed",
        F.round("area", 1).alias("area_pdf_units"), F.round(F.col("area") * scale * scale, 1).alias("area_m2"),
        F.coalesce(F.col("colour"), classify.lookup(F.col("zone_type"), classify.DEFAULT_COLOURS, "#94a3b8")).alias("color_hint"),
        F.col("width").alias("stroke_width"), F.round("confidence", 2).alias("confidence"), F.col("method").alias("classification_method"),
        F.col("fill").isNotNull().alias("filled"), F.coalesce("label", F.lit("")).alias("zone_label"),
    )


def plan_texts(texts: DataFrame, plots: DataFrame, keys: list[str]) -> DataFrame:
    """Texts (box, text, page_w, page_h) that meet the plot's box, or without a plot the page less a tenth on each side,
    and hold a word of ``PLAN_TEXT``, or a digit in under twenty characters."""
    j = texts.join(plots.select(*keys, *(f"plot_{c}" for c in ("x0", "y0", "x1", "y1"))), keys, "left")
    side = {"x0": F.col("page_w") * 0.1, "y0": F.col("page_h") * 0.1, "x1": F.col("page_w") * 0.9, "y1": F.col("page_h") * 0.9}
    x0, y0, x1, y1 = (F.coalesce(F.col(f"plot_{c}"), side[c]) for c in ("x0", "y0", "x1", "y1"))
    t = F.trim("text")
    meets = (F.col("x0") < x1) & (F.col("x1") > x0) & (F.col("y0") < y1) & (F.col("y1") > y0)
    says = classify.has_any(t, PLAN_TEXT) | (t.rlike(r"\d") & (F.length(t) < 20))
    return j.filter(meets & says & (t != "")).select(*texts.columns)


def manifest(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON line a shape for those who vote: id, share of the page, fill, centre, corners, how it came about, guess,
    aspect and compactness."""
    share = F.when(F.col("page_area") > 0, F.round(F.col("area") / F.col("page_area") * 100, 2)).otherwise(0.0)
    row = F.struct(
        "id", share.alias("area_pct"), F.col("fill").isNotNull().alias("filled"),
        F.array(F.round((F.col("x0") + F.col("x1")) / 2, 1), F.round((F.col("y0") + F.col("y1")) / 2, 1)).alias("centroid"), "n_points",
        F.coalesce("strategy", F.lit("direct")).alias("extraction"), "guess", F.round("aspect_ratio", 2).alias("aspect_ratio"), F.round("compactness", 2).alias("compactness"),
    )
    return shapes.select(*keys, "id", F.to_json(row).alias("line"))


def visual_counts(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """What a page shows before any classes: shapes, filled ones, large filled zones (id and share, over a hundredth of
    the page) and compact unfilled shapes of 0.01 to 5 hundredths, which may be buildings."""
    pct = F.when(F.col("page_area") > 0, F.col("area") / F.col("page_area") * 100).otherwise(0.0)
    filled = F.col("fill").isNotNull()
    house = ~filled & (F.col("compactness") > 0.4) & (pct > 0.01) & (pct < 5)
    large = F.when(filled & (pct > 1.0), F.struct("id", F.round(pct, 2).alias("area_pct")))
    return shapes.groupBy(*keys).agg(
        F.count("*").alias("total_polygons"), F.count_if(filled).alias("filled_count"), F.count_if(F.coalesce(house, F.lit(False))).alias("building_candidates"),
        F.array_sort(F.collect_list(large)).alias("large_filled_zones"),
    )
