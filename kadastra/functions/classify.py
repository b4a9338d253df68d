"""Rules that name a shape, a layer or a zone: boolean and CASE expressions over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: thresholds, keywords and tables -------------------------------------------------------
BUILDABLE_LAYER = ["setback", "envelope", "max", "buildable", "max_height", "rooilijn"]
NO_BUILD_LAYER = ["no-build", "exclusion", "clear", "vrij", "verboden"]
PLOT_LAYER = ["bound", "site", "limit", "kavel", "grens", "contour", "plot"]
ESSENTIAL_TEXT = ["height", "setback", "max", "min", "sqm", "m2", "limit", "grens", "kavel", "m²", "floor", "level", "area", "boundary", "plot", "zone", "regel"]
ROAD_TYPES = ["traffic_zone", "infrastructure_zone", "landscape_zone"]
ROAD_WORDS = ["verkeer", "traffic", "road", "street", "weg", "straat", "parking lot", "parkeerplaats", "fiets", "bicycle", "voetpad"]
BUILDABLE_TYPES = ["buildable_envelope", "filled_zone", "uncategorized_zone"]
LABEL_MAP = {"GD": "Gemengd (Mixed-Use)", "V": "Verkeer (Traffic)", "G": "Groen (Green)", "WR-A": "Waarde - Archeologie"}
DEFAULT_COLOURS = {
    "plot_boundary": "#3b82f6", "buildable_envelope": "#f97316", "infrastructure_zone": "#94a3b8", "landscape_zone": "#22c55e",
    "restriction_line": "#ef4444", "zone_boundary": "#f59e0b", "parcel_line": "#06b6d4", "sub_zone": "#8b5cf6",
    "major_boundary": "#e2e8f0", "context_line": "#64748b", "overlapping_zone": "#a855f7", "filled_zone": "#fb923c",
    "minor_context": "#475569", "uncategorized_zone": "#f97316", "traffic_zone": "#64748b", "no_build_zone": "#ef4444",
    "plinth": "#d97706",
}
#: typology -> (coverage, buildings)
TYPOLOGIES = {
    "single_tower": (0.35, 1), "plinth_tower": (0.70, 2), "perimeter_block": (0.55, 3), "row_houses": (0.45, 4),
    "courtyard": (0.50, 1), "campus": (0.30, 4), "infill": (0.75, 1),
}
#: Types a vote may name.
VOTE_TYPES = [
    "plot_boundary", "buildable_envelope", "landscape_zone", "infrastructure_zone", "traffic_zone", "sub_zone", "no_build_zone",
    "restriction_line", "artifact",
]
#: Colour family of each type that a colour stands for.
FAMILY_NAMES = {
    "buildable_envelope": "orange_fill", "infrastructure_zone": "gray_fill", "landscape_zone": "green_fill", "restriction_line": "red_stroke",
    "zone_boundary": "orange_stroke", "parcel_line": "cyan_stroke", "context_line": "dark_gray",
}
#: Further reference colours of a type, for the finer colour class.
COLOUR_REFERENCES = {
    "buildable_envelope": [(1.0, 0.75, 0.53), (1.0, 0.65, 0.40), (0.95, 0.70, 0.50)],
    "infrastructure_zone": [(0.80, 0.80, 0.80), (0.75, 0.75, 0.75), (0.85, 0.85, 0.85)],
    "landscape_zone": [(0.16, 0.78, 0.27), (0.0, 0.80, 0.20), (0.20, 0.70, 0.30)],
    "restriction_line": [(0.87, 0.0, 0.0), (1.0, 0.0, 0.0), (0.80, 0.10, 0.10)],
    "zone_boundary": [(1.0, 0.61, 0.0), (0.95, 0.55, 0.0), (1.0, 0.50, 0.0)],
    "parcel_line": [(0.0, 1.0, 1.0), (0.0, 0.90, 0.90), (0.0, 0.80, 1.0)],
}
# ---------------------------------------------------------------------------------------------------------


def has_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words; null text holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def lookup(key: Column, table: dict[str, object], default: object = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, F.lit(default))


def is_building_shape(aspect: Column, compact: Column, elongation: Column, circularity: Column, min_dim: Column) -> Column:
    return (aspect < 6.0) & (compact > 0.35) & (elongation < 0.85) & (circularity > 0.08) & (min_dim > 2.0)


def is_artifact_shape(aspect: Column, compact: Column, elongation: Column, min_dim: Column) -> Column:
    return (aspect > 10.0) | (elongation > 0.92) | (min_dim < 1.5) | (compact < 0.15)


def is_realistic_building(aspect: Column, compact: Column, min_dim: Column) -> Column:
    return (aspect < 5.5) & (compact > 0.40) & (min_dim >= 20)


def path_class(filled: Column, n_points: Column, gap: Column, area: Column, page_area: Column, least: float = 3e-5) -> Column:
    """boundary (unfilled ring of some size), hatching (filled) or other."""
    return F.when(filled, "hatching").when((n_points >= 4) & (gap < 5) & (area >= page_area * least), "boundary").otherwise("other")


def is_label_marker(closed: Column, area: Column, page_area: Column, circularity: Column, w: Column, h: Column) -> Column:
    side = F.greatest(w, h)
    return closed & (area < page_area * 0.003) & ((circularity > 0.65) | ((F.least(w, h) / side > 0.85) & (side < 30)))


def is_page_border(area: Column, page_area: Column, w: Column, h: Column, pw: Column, ph: Column, n: Column) -> Column:
    """Frames of a page: most of its area, or long thin bars along it."""
    wide = (area > page_area * 0.7) & ((w * h > page_area * 0.8) | (((w > pw * 0.9) | (h > ph * 0.9)) & (n <= 8)))
    thin = F.greatest(w, h) > 5.0 * F.least(w, h)
    bar = (n <= 8) & (w > 0) & (h > 0) & thin & ((w > pw * 0.7) | (h > ph * 0.7))
    return wide | bar


def simple_class(valid: Column, aspect: Column, area: Column, page_area: Column, compact: Column, has_label: Column) -> Column:
    """What can be told without votes: struct<zone_type, confidence>, else null."""
    share = F.when(page_area > 0, area / page_area).otherwise(0.0)

    def artifact(c: float) -> Column:
        return F.struct(F.lit("artifact").alias("zone_type"), F.lit(c).alias("confidence"))

    box = (share < 0.0005) & (compact > 0.90) & (compact < 1.05) & (aspect >= 1.0) & (aspect < 2.5) & has_label
    return (
        F.when(~valid, artifact(1.0)).when(aspect > 10.0, artifact(0.95)).when(share < 0.0001, artifact(0.90)).when(box, artifact(0.85))
    )


def _verdict(zone_type: str | Column, confidence: float | Column, method: str | Column) -> Column:
    def col(x: object) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(col(zone_type).alias("zone_type"), col(confidence).cast("double").alias("confidence"), col(method).alias("method"))


def rule_class(
    is_plot: Column, filled: Column, fill_type: Column, stroke_type: Column, artifact: Column, building: Column,
    inside: Column, width: Column, area: Column, plot_area: Column, strategy: Column,
) -> Column:
    """struct<zone_type, confidence, method>: plot, fill, artifact, stroke colour, shape, width, size.  Being inside the
    plot lifts what is neither plot nor filled to 0.75 at least, but for context."""
    rebuilt = strategy.isin("chain_join", "planar_face")
    unfilled = (
        F.when(artifact, _verdict("minor_context", 0.20, "artifact_shape"))
        .when(stroke_type.isNotNull(), _verdict(stroke_type, 0.80, F.concat(F.lit("stroke:"), lookup(stroke_type, FAMILY_NAMES))))
        .when(inside & building & rebuilt, _verdict("sub_zone", 0.80, F.concat(F.lit("building_shape+"), strategy)))
        .when(inside & building & (area > plot_area * 0.10), _verdict("uncategorized_zone", 0.70, "large_unfilled_inside_plot"))
        .when(inside & building, _verdict("sub_zone", 0.75, "building_shape"))
        .when(width >= 1.0, _verdict("major_boundary", 0.75, "thick_stroke"))
        .when(inside & (width >= 0.5), _verdict("major_boundary", 0.60, "medium_stroke"))
        .when(inside & (area > plot_area * 0.01), _verdict("uncategorized_zone", 0.55, "thin_stroke_significant_area"))
        .otherwise(_verdict("minor_context", 0.40, "thin_stroke"))
    )
    lifted = _verdict(unfilled["zone_type"], F.greatest(unfilled["confidence"], F.lit(0.75)), F.concat(unfilled["method"], F.lit("+containment")))
    return (
        F.when(is_plot, _verdict("plot_boundary", 0.95, "area_rank"))
        .when(filled & fill_type.isNotNull(), _verdict(fill_type, 0.85, F.concat(F.lit("fill:"), lookup(fill_type, FAMILY_NAMES))))
        .when(filled, _verdict("filled_zone", 0.60, "fill_unknown"))
        .when(inside & (unfilled["zone_type"] != "minor_context"), lifted)
        .otherwise(unfilled)
    )


def open_class(stroke_type: Column, no_stroke: Column) -> Column:
    """struct<zone_type, confidence, method> of an open line."""
    family = F.when(no_stroke, "none").otherwise(lookup(stroke_type, FAMILY_NAMES, "unknown"))
    return _verdict(F.coalesce(stroke_type, F.lit("context_line")), 0.50, F.concat(F.lit("open:"), family))


def colour_class(r: Column, g: Column, b: Column, is_fill: Column) -> Column:
    """struct<zone_type, confidence> by the nearest of all reference colours; surer when near, and for fills."""
    refs = [(t, c) for t, cs in COLOUR_REFERENCES.items() for c in cs]
    near = F.array_min(
        F.array(
            *(
                F.struct(F.sqrt(F.pow(r - x, 2) + F.pow(g - y, 2) + F.pow(b - z, 2)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t"))
                for i, (t, (x, y, z)) in enumerate(refs)
            )
        )
    )
    sure = F.greatest(F.lit(0.5), 1.0 - near["d"] * 2)
    sure = F.round(F.when(is_fill, F.least(sure + 0.1, F.lit(1.0))).otherwise(sure), 2)
    known = r.isNotNull() & (near["d"] <= 0.35)
    return F.struct(F.when(known, near["t"]).otherwise("unknown").alias("zone_type"), F.when(known, sure).otherwise(0.3).alias("confidence"))


def surest(*classes: Column) -> Column:
    """The struct<zone_type, confidence> of most confidence, the first of equals."""
    out = classes[0]
    for c in classes[1:]:
        out = F.when(c["confidence"] > out["confidence"], c).otherwise(out)
    return out


def guess(filled: Column, strategy: Column, share: Column, realistic: Column) -> Column:
    """A first guess at a shape, for those who vote: boundary, zone or building candidate."""
    rebuilt = F.coalesce(strategy.isin("chain_join", "planar_face"), F.lit(False))
    house = F.when(realistic, "building_candidate")
    return (
        F.when((share > 0.15) & ~filled, "boundary_candidate").when(rebuilt, F.coalesce(house, F.lit("boundary_candidate")))
        .when((share > 0.04) & ~filled, "zone_candidate").when(filled & (share > 0.005), "zone_candidate").otherwise(F.coalesce(house, F.lit("zone_candidate")))
    )


def is_kept(ztype: Column, label: Column, closed: Column, area: Column, page_area: Column, width: Column, box_area: Column) -> Column:
    """The noise filter: structure and labelled shapes stay, the rest by type and size."""
    named = label.isNotNull() & (label != "")
    return (
        F.when(ztype.isin("plot_boundary", "zone_boundary", "parcel_line", "uncategorized_zone"), True)
        .when(named, True)
        .when(
            ztype.isin("buildable_envelope", "landscape_zone", "infrastructure_zone", "restriction_line"),
            F.when(closed, area > page_area * 5e-4).otherwise((width >= 0.5) | (box_area > page_area * 5e-3)),
        )
        .when(closed & (area > page_area * 8e-5), ztype != "unknown")
        .when(~closed & ztype.isin("restriction_line", "major_boundary", "zone_boundary") & ((width >= 0.3) | (box_area > page_area * 5e-3)), True)
        .otherwise(area > page_area * 5e-3)
    )


def containment_class(ratio: Column, inside: Column, touches: Column) -> Column:
    """struct<zone_type, confidence> by how a shape lies to the plot; ``ratio`` is its share of the plot."""

    def res(t: str, c: float) -> Column:
        return F.struct(F.lit(t).alias("zone_type"), F.lit(c).alias("confidence"))

    return (
        F.when(inside & (ratio > 0.5), res("major_sub_zone", 0.85)).when(inside & (ratio > 0.1), res("sub_zone", 0.75))
        .when(inside, res("minor_sub_zone", 0.60)).when(touches, res("overlapping_zone", 0.55))
        .otherwise(res("external_context", 0.40))
    )


def layer_type(layer: Column) -> Column:
    return (
        F.when(has_any(layer, BUILDABLE_LAYER), "buildable_envelope").when(has_any(layer, NO_BUILD_LAYER), "no_build_zone")
        .when(has_any(layer, PLOT_LAYER), "plot_boundary").otherwise("cad_context")
    )


def representation(n_closed: Column, n_open: Column) -> Column:
    """How buildings are drawn inside a plot, by closed shapes and open segments."""
    return (
        F.when(n_closed + n_open == 0, "none").when((n_closed > 0) & (n_open < 10), "clean_outlines")
        .when((n_open > 20) & (n_closed == 0), "fragmented_dashes").when(n_open > 20, "mixed")
        .when(n_closed > 0, "clean_outlines").otherwise("none")
    )


def is_road(ztype: Column, label: Column) -> Column:
    return ztype.isin(*ROAD_TYPES) | has_any(label, ROAD_WORDS)


def typology(area: Column, height: Column, use: Column) -> Column:
    tall = F.coalesce(height, F.lit(0.0))
    return (
        F.when(use.isin("mixed_use", "commercial") & (tall > 20), "plinth_tower").when(tall > 40, "single_tower")
        .when(area > 8000, "campus").when(area > 4000, "perimeter_block").when(area > 1500, "courtyard").otherwise("infill")
    )


def risk(gfa: Column, height: Column, inferred: Column) -> Column:
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (gfa.isNull(), height.isNull(), inferred)), F.lit(0))
    return F.when(n == 0, "LOW").when(n == 1, "MEDIUM").otherwise("HIGH")


def parse_label(text: Column) -> Column:
    """Composite label of a zone from the lines of its texts: name | tags | h=values m; null if none."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.create_map(*(F.lit(x) for kv in LABEL_MAP.items() for x in kv))
    labels = F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()))
    tag = F.transform(
        lines,
        lambda x: F.when(F.try_element_at(names, x).isNotNull(), F.lit(None))
        .when(x.rlike(r"^\(sgd-\d+\)"), F.concat(F.lit("sgd-"), F.regexp_extract(x, r"^\(sgd-(\d+)\)", 1)))
        .when(x.rlike(r"^\[sba-[^\]]+\]"), F.concat(F.lit("sba-"), F.regexp_extract(x, r"^\[sba-([^\]]+)\]", 1)))
        .when(x == "(m)", "maatschappelijk"),
    )
    tags = F.array_distinct(F.filter(tag, lambda x: x.isNotNull()))
    heights = F.array_distinct(F.filter(lines, lambda x: x.rlike(r"^\d+(,\d+)?$")))
    parts = F.array(
        F.get(labels, 0),
        F.when(F.size(tags) > 0, F.array_join(tags, " · ")),
        F.when(F.size(heights) > 0, F.concat(F.lit("h="), F.array_join(heights, ","), F.lit("m"))),
    )
    kept = F.filter(parts, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.array_join(kept, " | "))
