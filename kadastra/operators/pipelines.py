"""Constraints and programmes from end to end: texts, model rows and zones in; constraints, rules, geometry and summaries out.

What a model says comes as tables with the same keys; without them the steps that need them add nothing.  Zones are rows of
``keys`` (a site), ``id``, ``zone_type``, ``label``, ``closed``, ``area``, ``points`` (a ring in metres), ``confidence``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from . import programme
from .matching import either_holds
from .steps import settled

# --- fixed values ------------------------------------------------------------------------------------------
BUILDABLE = ["buildable_envelope", "filled_zone", "uncategorized_zone"]
NO_BUILD = ["no_build_zone", "restriction_line"]
#: Colours of setback lines by words of their names, the first that fits.
SETBACK_COLOURS = [(("front", "voor"), "#ef4444"), (("rear", "achter"), "#f97316"), (("side", "zij"), "#eab308")]
SETBACK, HEIGHT, FORBIDDEN = "#ef4444", "#f59e0b", "#dc2626"
CORNERS = 8
#: Sources in the order in which constraints are taken, with the confidence of rows that have none.
SOURCES = {"extracted": 0.85, "ai_extracted": 0.75, "ai_suggested": 0.45}
# -----------------------------------------------------------------------------------------------------------
CONSTRAINT = ("category", "name", "value", "unit", "raw_quote", "applies_to", "source", "confidence", "seq")


def _as_constraints(df: DataFrame, keys: list[str], source: str) -> DataFrame:
    have = set(df.columns)
    default = {"applies_to": F.lit("all"), "raw_quote": F.lit(""), "unit": F.lit(""), "seq": F.lit(0), "confidence": F.lit(SOURCES[source])}
    cols = {c: F.coalesce(F.col(c), default[c]) if c in have and c in default else F.col(c) if c in have else default.get(c) for c in CONSTRAINT if c != "source"}
    return df.filter("name is not null and value is not null").select(
        *keys, *(cols[c].cast({"value": "double", "confidence": "double", "seq": "long"}.get(c, "string")).alias(c) for c in cols), F.lit(source).alias("source")
    )


def collect_constraints(texts: DataFrame, keys: list[str], model: DataFrame | None = None, suggested: DataFrame | None = None, few: int = 3) -> DataFrame:
    """All constraints of each key: those found in its distinct texts (keys, seq, text), the model's (category, name, value
    and what else it says), and suggestions for keys that have fewer than ``few`` and lack an essential category."""
    found = text.extract_constraints(texts.dropDuplicates([*keys, "text"]), keys)
    out = _as_constraints(found, keys, "extracted")
    if model is not None:
        out = out.unionByName(_as_constraints(model, keys, "ai_extracted"))
    if suggested is not None:
        sites = suggested.select(*keys).distinct()
        open_ = programme.gap_categories(out, sites, keys, text.ESSENTIAL_CATEGORIES, few).select(*keys).distinct()
        out = out.unionByName(_as_constraints(suggested.join(open_, keys, "left_semi"), keys, "ai_suggested"))
    name = F.concat_ws("|", *keys, "source", "category", F.col("value").cast("string"), "name", "applies_to", F.col("seq").cast("string"))
    return out.withColumn("constraint_id", F.substring(F.sha1(name), 1, 16))


def _label(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def rules_with_constraints(rules: DataFrame, constraints: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """``rules`` (zone_index, zone_label, max_height_m, target_gfa_m2, setback_m, density_grz, source) with the values of
    the constraints (zone_id set) of zones whose label and theirs are one in the other; the last constraint wins."""
    z = zones.select(*keys, F.col("id").alias("zone_id"), "label")
    tagged = constraints.filter("zone_id is not null and value <> 0").join(z, [*keys, "zone_id"])
    same = either_holds(z.select(*keys, F.col("zone_id").alias("id"), "label"), rules.select(*keys, F.col("zone_index").alias("id"), F.col("zone_label").alias("label")), keys)
    at = {s: i for i, s in enumerate(SOURCES)}
    order = F.struct(F.coalesce(*(F.when(F.col("source") == s, i) for s, i in at.items())), "seq", "constraint_id")
    m = tagged.join(same.select(*keys, F.col("left_id").alias("zone_id"), F.col("right_id").alias("zone_index")), [*keys, "zone_id"])
    m = m.select(*keys, "zone_index", "category", "value", order.alias("seq"))
    hit = m.filter(F.col("category").isin("height", "gfa", "setback", "density")).select(*keys, "zone_index").distinct().withColumn("hit", F.lit(True))
    done = programme.constraint_overrides(rules, m, keys).join(hit, [*keys, "zone_index"], "left")
    return done.withColumn("source", F.when(F.col("hit"), "document").otherwise(F.col("source"))).drop("hit")


def _rounded(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(F.round(p[0], 4), F.round(p[1], 4)))


def constraint_geometry(constraints: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Outlines that constraints draw: the plot moved inwards by each setback (largest part), else the buildable envelope;
    each building at the greatest height, with up to ``CORNERS`` posts; the zones nobody may build on.

    keys, zone_type, zone_label, points, color_hint, confidence, classification_method, constraint_id, constraint_value, y_top,
    corner_posts.  Plot and envelope are the first (least id) closed ones."""
    ring = zones.filter(F.col("closed") & (F.size("points") >= 3))

    def first(kind: str) -> DataFrame:
        return ring.filter(F.col("zone_type") == kind).groupBy(*keys).agg(F.min_by(F.struct("points", "confidence"), "id").alias("z")).select(*keys, "z.*")

    none = {"constraint_id": F.lit(None).cast("string"), "constraint_value": F.lit(None).cast("string"), "y_top": F.lit(None).cast("double"), "corner_posts": F.lit(None).cast("array<struct<base:array<double>,top:array<double>>>")}
    cols = ["zone_type", "zone_label", "points", "color_hint", "confidence", "classification_method", *none]

    def rows(df: DataFrame, **given: Column) -> DataFrame:
        return df.select(*keys, *((given.get(c, none.get(c, F.col(c)))).alias(c) for c in cols))

    low = F.lower("name")
    colour = F.lit(SETBACK)
    for words, c in reversed(SETBACK_COLOURS):
        colour = F.when(F.contains(low, F.lit(words[0])) | F.contains(low, F.lit(words[1])), c).otherwise(colour)
    told = F.concat(F.col("value").cast("string"), F.coalesce("unit", F.lit("")))
    back = constraints.filter("category = 'setback' and value > 0").join(first("plot_boundary").drop("confidence"), keys).withColumn("inner", geometry.inset_ring("points", "value"))
    lines = settled(
        rows(
            back.filter(F.size("inner") > 2), zone_type=F.lit("setback_line"), zone_label=F.concat("name", F.lit(" ("), told, F.lit(")")), points=_rounded(F.col("inner")), color_hint=colour,
            classification_method=F.lit("constraint_offset"), constraint_id=F.col("constraint_id"), constraint_value=told,
        )
    )
    bare = first("buildable_envelope").join(lines.select(*keys).distinct(), keys, "left_anti")
    envelope = rows(
        bare, zone_type=F.lit("setback_line"), zone_label=F.lit("Buildable Envelope (bouwvlak)"), points=_rounded(F.col("points")), color_hint=F.lit(SETBACK), confidence=F.coalesce("confidence", F.lit(0.7)),
        classification_method=F.lit("derived_from_buildable_envelope"), constraint_value=F.lit("derived"),
    )
    top = constraints.filter("category = 'height'").groupBy(*keys).agg(F.max(F.struct("value", "confidence")).alias("t")).select(*keys, F.col("t.value").alias("limit"), F.col("t.confidence").alias("sure"))
    houses = ring.filter("zone_type = 'sub_zone'").join(top, keys)
    limit = F.round("limit", 4)
    posts = F.transform(F.slice("points", 1, CORNERS), lambda p: F.struct(F.array(p[0], F.lit(0.0), p[1]).alias("base"), F.array(p[0], limit, p[1]).alias("top")))
    heights = rows(
        houses, zone_type=F.lit("height_limit"), zone_label=F.concat(F.lit("Max Height "), F.col("limit").cast("string"), F.lit("m")), points=geometry.closed(F.col("points")), color_hint=F.lit(HEIGHT),
        confidence=F.col("sure"), classification_method=F.lit("height_limit_contour"), constraint_value=F.concat(F.col("limit").cast("string"), F.lit("m")), y_top=limit, corner_posts=posts,
    )
    named = F.when(_label(F.col("label")) != "", F.concat(F.lit("No-Build Zone ("), F.col("label"), F.lit(")"))).otherwise("No-Build Zone")
    forbidden = rows(
        ring.filter(F.col("zone_type").isin(*NO_BUILD)), zone_type=F.lit("setback_line"), zone_label=named, points=_rounded(F.col("points")), color_hint=F.lit(FORBIDDEN),
        confidence=F.coalesce("confidence", F.lit(0.65)), classification_method=F.lit("no_build_boundary"),
    )
    return lines.unionByName(envelope).unionByName(heights).unionByName(forbidden)


def extract_constraints(
    texts: DataFrame, zones: DataFrame, keys: list[str], rules: DataFrame | None = None, model: DataFrame | None = None, suggested: DataFrame | None = None
) -> dict[str, DataFrame]:
    """constraints (with the zone they are for), constraint_geometry, zone_rules (where there are any) and summary."""
    c = settled(collect_constraints(texts, keys, model, suggested))
    open_ = zones.filter(F.col("closed") & F.col("zone_type").isin(*BUILDABLE))
    tagged = settled(programme.match_constraints(c, open_.withColumnRenamed("id", "zone_id"), keys))
    shapes = constraint_geometry(c, zones, keys)
    out = {"constraints": tagged, "constraint_geometry": shapes, "summary": constraint_summary(c, shapes, keys)}
    return out | ({"zone_rules": rules_with_constraints(rules, tagged, open_, keys)} if rules is not None else {})


def constraint_summary(constraints: DataFrame, shapes: DataFrame, keys: list[str]) -> DataFrame:
    """total, regex_extracted, ai_extracted, ai_suggested, constraint_geometries and categories of each key."""
    n = shapes.groupBy(*keys).agg(F.count("*").alias("constraint_geometries"))
    s = constraints.groupBy(*keys).agg(
        F.count("*").alias("total"), *(F.count_if(F.col("source") == s).alias("regex_extracted" if s == "extracted" else s) for s in SOURCES), F.array_sort(F.collect_set("category")).alias("categories")
    )
    return s.join(n, keys, "full").select(
        *keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "regex_extracted", "ai_extracted", "ai_suggested", "constraint_geometries")), F.coalesce("categories", F.array().cast("array<string>")).alias("categories")
    )


def programme_summary(programmes: DataFrame, zone_programmes: DataFrame, keys: list[str]) -> DataFrame:
    """Buildings by where they come from, totals of the site, and whether anything is built under it."""
    p = programmes.groupBy(*keys).agg(
        F.count("*").alias("total_buildings"), *(F.count_if(F.col("source") == s).alias(s) for s in ("extracted", "ai_extracted", "ai_suggested", "inferred")),
        F.round(F.sum("gfa"), 1).alias("total_gfa"), F.sum("floors").alias("total_floors"), F.bool_or("has_plinth").alias("has_plinth"),
    )
    z = zone_programmes.groupBy(*keys).agg(F.count("*").alias("zone_programmes"), F.bool_or(F.col("parking_levels") > 0).alias("has_underground_parking"))
    return p.join(z, keys, "full").select(
        *keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_buildings", "extracted", "ai_extracted", "ai_suggested", "inferred", "zone_programmes", "total_floors")), F.coalesce("total_gfa", F.lit(0.0)).alias("total_gfa"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("has_plinth", "has_underground_parking")),
    )


def extract_programme(buildings: DataFrame, zones: DataFrame, site: DataFrame, rules: DataFrame, heights: DataFrame, keys: list[str], model: DataFrame | None = None) -> dict[str, DataFrame]:
    """programmes a building, zone_programmes and summary; inputs as ``programme.building_programmes`` and ``zone_programmes`` take them."""
    p = settled(programme.building_programmes(buildings, site, keys, model))
    z = settled(programme.zone_programmes(zones, rules, heights, site.select(*keys, "site_gfa", "underground", "parking_ratio"), keys))
    return {"programmes": p, "zone_programmes": z, "summary": programme_summary(p, z, keys)}
