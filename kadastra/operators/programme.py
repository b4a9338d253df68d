"""From rules and constraints to programmes and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import BUILDABLE_TYPES, TYPOLOGIES, has_any, is_road, lookup, typology
from .matching import either_holds, stands_in

# --- fixed values ------------------------------------------------------------------------------------------
FLOOR_HEIGHT, PLINTH_HEIGHT, PARKING_DEPTH, HEIGHT_CAP = 3.0, 4.5, 3.0, 45.0
FOOTPRINT_CAPS = {"residential": 1200.0, "commercial": 2500.0, "office": 2000.0, "retail": 3000.0, "mixed_use": 1800.0, "industrial": 5000.0}
DEFAULT_FOOTPRINT_CAP = 1500.0
# -----------------------------------------------------------------------------------------------------------
COVERAGE = {k: v[0] for k, v in TYPOLOGIES.items()}
BUILDINGS = {k: v[1] for k, v in TYPOLOGIES.items()}


def nonzero(c: Column) -> Column:
    """Null for 0, which the priorities pass over like a missing value."""
    return F.nullif(c, F.lit(0).cast("double"))


def fallback_rules(briefs: DataFrame, keys: list[str]) -> DataFrame:
    """One rule a zone that is expected: height or 15, an equal share of the GFA, else area * 0.4 * floors.

    ``briefs``: keys, n_zones, site_gfa, max_height, expected_floors, site_area, n_buildings, typology."""
    height = F.coalesce(nonzero(F.col("max_height")), F.lit(15.0))
    floors = F.coalesce(F.nullif("expected_floors", F.lit(0)), F.greatest(F.floor(height / 3.0).cast("int"), F.lit(1)))
    n = F.greatest("n_zones", F.lit(1))
    gfa = F.coalesce(F.round(nonzero(F.col("site_gfa")) / n, 1), F.round(F.col("site_area") / n * 0.4 * floors, 1))
    return briefs.filter("n_zones > 0").select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("n_zones") - 1)).alias("zone_index"),
        height.alias("max_height_m"),
        F.when(gfa > 50, gfa).alias("target_gfa_m2"),
        F.lit(3.0).alias("setback_m"),
        F.lit(0.4).alias("density_grz"),
        F.greatest(F.floor(F.col("n_buildings") / n).cast("int"), F.lit(1)).alias("expected_buildings"),
        F.col("typology").alias("typology"),
        F.lit("mixed_use").alias("use"),
        F.lit("ai_suggested").alias("source"),
    ).withColumn("zone_label", F.concat(F.lit("Zone "), (F.col("zone_index") + 1).cast("string")))


def merge_brief(regex: DataFrame, geometry: DataFrame, keys: list[str], model: DataFrame | None = None) -> DataFrame:
    """Priority model > text > geometry; 0 and empty count as missing."""
    g = geometry.select(*keys, "n_large_filled", "n_candidates")
    j = regex.join(g, keys, "left")
    if model is not None:
        j = j.join(model.select(*keys, *(F.col(c).alias(f"m_{c}") for c in ("n_zones", "n_buildings", "site_gfa", "max_height", "typology"))), keys, "left")
    else:
        j = j.withColumns({f"m_{c}": F.lit(None).cast(t) for c, t in (("n_zones", "int"), ("n_buildings", "int"), ("site_gfa", "double"), ("max_height", "double"), ("typology", "string"))})
    return j.select(
        *keys,
        F.coalesce(F.nullif("m_n_zones", F.lit(0)), F.nullif("expected_zone_count", F.lit(0)), F.greatest(F.coalesce("n_large_filled", F.lit(0)), F.lit(1))).cast("int").alias("n_zones"),
        F.coalesce(F.nullif("m_n_buildings", F.lit(0)), F.nullif("expected_building_count", F.lit(0)), F.greatest(F.coalesce("n_candidates", F.lit(0)), F.lit(1))).cast("int").alias("n_buildings"),
        F.coalesce(nonzero(F.col("m_site_gfa")), F.array_max("gfa_values")).alias("site_gfa"),
        F.coalesce(nonzero(F.col("m_max_height")), F.array_max("height_values")).alias("max_height"),
        F.array_max("floor_counts").alias("expected_floors"),
        F.coalesce(F.nullif("m_typology", F.lit("")), "dominant_typology").alias("typology"),
    )


def buildable(zones: DataFrame, keys: list[str]) -> DataFrame:
    """Closed zones of the buildable types off the roads, and buildings over four tenths of the plot (the largest zone
    where there is no plot).  ``zones``: keys, zone_id, zone_type, label, closed, area."""
    plot = zones.groupBy(*keys).agg(
        F.coalesce(nonzero(F.max(F.when(F.col("zone_type") == "plot_boundary", F.col("area"))).cast("double")), F.max("area").cast("double")).alias("plot_area")
    )
    own = F.col("zone_type").isin(*BUILDABLE_TYPES) & ~is_road(F.col("zone_type"), F.col("label"))
    big = (F.col("zone_type") == "sub_zone") & (F.col("area") > F.col("plot_area") * 0.4)
    return zones.join(plot, keys).filter(F.col("closed") & (own | big)).withColumn("oversized", ~own)


def match_rules(zones: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``zones`` (keys, zone_id, zone_index, label) with the rule of the first label that holds or is held by theirs,
    else the rule of the same index; prefix ``r_``.  Labels meet by their parts (``matching``)."""
    r = rules.select(*keys, *(F.col(c).alias(f"r_{c}") for c in rules.columns if c not in keys))
    held = either_holds(zones.select(*keys, F.col("zone_id").alias("id"), "label"), rules.select(*keys, F.col("zone_index").alias("id"), F.col("zone_label").alias("label")), keys)
    by_label = held.groupBy(*keys, F.col("left_id").alias("zone_id")).agg(F.min("right_id").alias("m_index"))
    with_index = zones.join(by_label, [*keys, "zone_id"], "left").withColumn("r_zone_index", F.coalesce("m_index", "zone_index"))
    return with_index.join(r, [*keys, "r_zone_index"], "left").drop("m_index")


def zone_programmes(zones: DataFrame, rules: DataFrame, heights: DataFrame, site: DataFrame, keys: list[str]) -> DataFrame:
    """One programme a buildable zone.

    ``zones``: keys, zone_id, zone_type, label, closed, area.  ``heights``: keys, value.  ``site``: keys, site_gfa,
    underground (boolean), parking_ratio.  GFA: rule, share of the site's, else area * coverage * floors.  Height: rule,
    the site's heights by rank of the zone, derived from the GFA, else by use."""
    w = Window.partitionBy(*keys)
    z = buildable(zones, keys).withColumn("zone_index", F.row_number().over(w.orderBy("oversized", "zone_id")) - 1)
    z = z.withColumns({"n_zones": F.count("*").over(w), "total_area": F.sum("area").over(w)})
    hs = heights.filter("value > 0").groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("hs"))
    j = match_rules(z, rules, keys).join(hs, keys, "left").join(site, keys, "left")
    k = F.size(F.coalesce("hs", F.array().cast("array<double>")))
    at = F.least(F.floor(F.col("zone_index") / F.greatest(F.col("n_zones") - 1, F.lit(1)) * k).cast("int"), k - 1)
    by_rank = F.when((k > 1) & (F.col("n_zones") > 1), F.get("hs", at)).when(k > 0, F.get("hs", F.lit(0)))
    j = j.withColumns(
        {
            "rule_gfa": nonzero(F.col("r_target_gfa_m2")),
            "rule_height": nonzero(F.col("r_max_height_m")),
            "use0": F.coalesce(F.nullif(F.lower("r_use"), F.lit("")), F.lit("residential")),
            "share_gfa": F.when(F.col("area") > 0, F.round(nonzero(F.col("site_gfa")) * F.col("area") / F.when(F.col("total_area") > 0, F.col("total_area")).otherwise(1), 0)),
            "by_rank": by_rank,
        }
    )
    j = j.withColumn("gfa1", F.coalesce("rule_gfa", "share_gfa"))
    foot = F.col("area") * lookup(typology(F.col("area"), F.lit(None).cast("double"), F.col("use0")), COVERAGE, 0.5)
    derived = F.when((F.col("area") > 0) & F.col("gfa1").isNotNull(), F.round(F.greatest(F.ceil(F.col("gfa1") / foot), F.lit(1)) * FLOOR_HEIGHT, 1))
    default = F.when(F.col("use0").isin("commercial", "office"), 24.0).when(F.col("use0") == "mixed_use", 21.0).otherwise(15.0)
    j = j.withColumns({"derived": derived, "default_h": default})
    j = j.withColumn("height", F.coalesce("rule_height", "by_rank", "derived", "default_h"))
    j = j.withColumn("typo", F.coalesce(F.nullif("r_typology", F.lit("")), typology(F.col("area"), F.col("height"), F.col("use0"))))
    floors = F.greatest(F.floor(F.col("height") / FLOOR_HEIGHT), F.lit(1))
    inferred = F.when(F.col("area") > 0, F.round(F.col("area") * lookup(F.col("typo"), COVERAGE, 0.5) * floors, 0))
    levels = F.when(F.coalesce("underground", F.lit(False)), F.when(F.coalesce("parking_ratio", F.lit(1.0)) > 1.5, 2).otherwise(1)).otherwise(0)
    levels = F.when(F.coalesce(F.col("r_use").isin("commercial", "mixed_use", "office"), F.lit(False)), F.greatest(levels, F.lit(1))).otherwise(levels)
    return j.select(
        *keys,
        "zone_id",
        F.col("zone_index").cast("int").alias("zone_index"),
        F.col("typo").alias("typology"),
        F.coalesce("gfa1", inferred).alias("target_gfa_m2"),
        F.when(F.col("rule_gfa").isNotNull(), F.coalesce("r_source", F.lit("document"))).when(F.col("share_gfa").isNotNull(), "proportional").otherwise("inferred").alias("gfa_source"),
        F.col("height").alias("max_height_m"),
        F.when(F.col("rule_height").isNotNull(), F.coalesce("r_source", F.lit("document"))).when(F.col("by_rank").isNotNull(), "document")
        .when(F.col("derived").isNotNull(), "derived_from_gfa").otherwise("default").alias("height_source"),
        levels.cast("int").alias("parking_levels"),
        F.when(levels > 0, F.coalesce("parking_ratio", F.lit(1.0))).otherwise(0.0).alias("parking_ratio"),
        F.coalesce(F.nullif("r_use", F.lit("")), F.lit("residential")).alias("use"),
        lookup(F.col("typo"), BUILDINGS, 1).alias("expected_buildings"),
        F.coalesce("r_source", F.lit("inferred")).alias("source"),
    )


def building_programmes(buildings: DataFrame, site: DataFrame, keys: list[str], model: DataFrame | None = None) -> DataFrame:
    """A programme a building, inferred from the site's values where no model row says otherwise.

    ``buildings``: keys, building_id, area.  ``site``: keys, floors, floor_height, max_height, use, plinth, underground,
    parking_ratio (all may be null).  ``model``: building_id, floors, floor_height, gfa."""
    j = buildings.join(site, keys, "left")
    if model is not None:
        j = j.join(model.select("building_id", F.col("floors").alias("m_floors"), F.col("floor_height").alias("m_fh"), F.col("gfa").alias("m_gfa")), "building_id", "left")
    else:
        j = j.withColumns({"m_floors": F.lit(None).cast("int"), "m_fh": F.lit(None).cast("double"), "m_gfa": F.lit(None).cast("double")})
    known = F.col("m_floors").isNotNull() | F.col("m_gfa").isNotNull()
    base_h = F.coalesce("floor_height", F.lit(FLOOR_HEIGHT))
    h = F.coalesce("m_fh", base_h)
    cap = F.greatest(F.floor(F.col("max_height") / h), F.lit(1))
    want = F.coalesce("m_floors", F.nullif("floors", F.lit(0)), F.when(known, 4), F.greatest(F.floor(nonzero(F.col("max_height")) / base_h), F.lit(1)), F.lit(4))
    n = F.when(nonzero(F.col("max_height")).isNotNull() & (want * h > F.col("max_height")), cap).otherwise(want).cast("int")
    use = F.coalesce("use", F.lit("residential"))
    return j.select(
        *keys,
        "building_id",
        n.alias("floors"),
        h.alias("floor_height"),
        F.round(n * h, 4).alias("total_height"),
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(
                i.alias("floor"), F.when(F.coalesce("plinth", F.lit(False)) & (n > 1) & (i == 0), "retail").otherwise(use).alias("use")
            ),
        ).alias("uses"),
        F.coalesce("m_gfa", F.when(F.col("area") > 0, F.col("area") * n).otherwise(0).cast("double")).alias("gfa"),
        F.coalesce("plinth", F.lit(False)).alias("has_plinth"),
        F.coalesce("underground", F.lit(False)).alias("has_underground_parking"),
        F.coalesce("parking_ratio", F.lit(1.0)).alias("parking_ratio"),
        F.when(known, "ai_extracted").otherwise("inferred").alias("source"),
        F.when(known, 0.75).otherwise(0.55).alias("confidence"),
    )


def floor_counts(buildings: DataFrame, keys: list[str]) -> DataFrame:
    """Floors of buildings without a programme, from their zone's GFA by share of the capped footprints.

    ``buildings``: keys, zone_id, building_id, footprint, use, zone_gfa, max_height, base_y."""
    cap = lookup(F.col("use"), FOOTPRINT_CAPS, DEFAULT_FOOTPRINT_CAP)
    b = buildings.withColumn("foot", F.least(F.col("footprint").cast("double"), cap))
    b = b.withColumn("feet", F.greatest(F.sum("foot").over(Window.partitionBy(*keys, "zone_id")), F.lit(0.01)))
    room = F.greatest(F.floor((F.col("max_height") - F.col("base_y")) / FLOOR_HEIGHT), F.lit(1))
    has_height = nonzero(F.col("max_height")).isNotNull()
    n = (
        F.when((F.col("zone_gfa") > 0) & (F.col("foot") > 0), F.greatest(F.ceil(F.round(F.col("zone_gfa") / F.col("feet"), 6)), F.lit(1)))
        .when(has_height, room).otherwise(4)
    )
    n = F.when(F.col("use").isin("industrial", "retail"), n).otherwise(F.greatest(n, F.lit(3)))
    n = F.when(has_height, F.least(n, room)).otherwise(n)
    return b.select(*keys, "zone_id", "building_id", F.round("foot", 4).alias("effective_footprint"), n.cast("int").alias("floors"), "base_y", "max_height")


def floor_volumes(programmes: DataFrame, keys: list[str]) -> DataFrame:
    """A row a floor above ground.  ``programmes``: keys, building_id, floors, floor_height, base_y, cap (may be null),
    uses array<struct<floor, use>>.  The last use stands for floors without one."""
    room = F.greatest(F.floor((F.col("cap") - F.col("base_y")) / F.col("floor_height")), F.lit(1))
    n = F.when(F.col("cap").isNotNull(), F.least(F.col("floors"), room)).otherwise(F.col("floors")).cast("int")
    e = programmes.withColumn("n", n).filter("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("floor_index"))
    own = F.get(F.filter("uses", lambda u: u["floor"] == F.col("floor_index")), F.lit(0))["use"]
    last = F.try_element_at("uses", F.lit(-1))["use"]
    return e.select(
        *keys,
        "building_id",
        "floor_index",
        F.round(F.col("base_y") + F.col("floor_index") * F.col("floor_height"), 4).alias("y_bottom"),
        F.round(F.col("base_y") + (F.col("floor_index") + 1) * F.col("floor_height"), 4).alias("y_top"),
        F.coalesce(own, last, F.lit("residential")).alias("use_type"),
        F.lit("building_floor").alias("zone_type"),
    )


def parking_volumes(programmes: DataFrame, keys: list[str]) -> DataFrame:
    """Levels -1, -2 .. of each zone with parking."""
    return programmes.filter("parking_levels > 0").select(
        *keys, "zone_id", F.explode(F.sequence(F.lit(1), F.col("parking_levels"))).alias("level")
    ).select(
        *keys, "zone_id", (-F.col("level")).alias("floor_index"), (-F.col("level") * PARKING_DEPTH).alias("y_bottom"),
        ((1 - F.col("level")) * PARKING_DEPTH).alias("y_top"), F.lit("underground_parking").alias("zone_type"),
    )


def default_gfa(zones: DataFrame) -> DataFrame:
    """Target GFA of zones without one: area times the index of their use."""
    fsi = F.when(has_any(F.col("use"), ["office", "commercial"]), 2.0).when(has_any(F.col("use"), ["retail"]), 1.0).when(has_any(F.col("use"), ["industrial"]), 0.6).otherwise(1.5)
    return zones.withColumn("target_gfa_m2", F.coalesce(F.when(F.col("target_gfa_m2") > 0, F.col("target_gfa_m2")), F.round(F.col("area") * fsi, 1)))


def footprint_area(envelopes: DataFrame) -> DataFrame:
    """Area to build on: GFA / floors, FSI * area / floors, density * area, in this order; over the envelope 0.85 of it.

    ``envelopes``: area, target_gfa, fsi, density, min_height; ``how`` tells what decided."""
    floors = F.coalesce(F.greatest(F.floor(nonzero(F.col("min_height")) / 3.0), F.lit(1)), F.lit(4))
    by = F.coalesce(nonzero(F.col("target_gfa")) / floors, nonzero(F.col("fsi")) * F.col("area") / floors, nonzero(F.col("density")) * F.col("area"))
    how = (
        F.when(nonzero(F.col("target_gfa")).isNotNull(), "gfa").when(nonzero(F.col("fsi")).isNotNull(), "fsi")
        .when(nonzero(F.col("density")).isNotNull(), "density").otherwise("full")
    )
    return envelopes.withColumns(
        {
            "footprint": F.round(F.when(by > F.col("area"), F.col("area") * 0.85).otherwise(F.coalesce(by, F.col("area").cast("double"))), 4),
            "how": how,
        }
    )


def constraint_overrides(rules: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Rules with height, GFA, setback and density taken from constraints matched to their zone; the last wins.

    ``matched``: keys, zone_index, category, value, seq."""
    last = matched.groupBy(*keys, "zone_index").agg(
        *(F.max_by(F.when(F.col("category") == c, F.col("value")), F.when(F.col("category") == c, F.col("seq"))).alias(f"c_{c}") for c in ("height", "gfa", "setback", "density"))
    )
    j = rules.join(last, [*keys, "zone_index"], "left")
    return j.withColumns(
        {
            "max_height_m": F.coalesce("c_height", "max_height_m"), "target_gfa_m2": F.coalesce("c_gfa", "target_gfa_m2"),
            "setback_m": F.coalesce("c_setback", "setback_m"), "density_grz": F.coalesce("c_density", "density_grz"),
        }
    ).drop("c_height", "c_gfa", "c_setback", "c_density")


def match_constraints(constraints: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Constraints with the first zone (least id) of their key whose label, over two characters, stands in what they apply
    to or in their quote."""
    z = zones.filter(F.length("label") > 2).select(*keys, F.col("zone_id").alias("label_id"), F.lower("label").alias("label"))
    said = [constraints.select(*keys, F.col("constraint_id").alias("text_id"), F.lower(c).alias("text")) for c in ("raw_quote", "applies_to")]
    first = stands_in(z, said[0].unionByName(said[1]), keys).groupBy(*keys, F.col("text_id").alias("constraint_id")).agg(F.min("label_id").alias("zone_id"))
    return constraints.join(first, [*keys, "constraint_id"], "left")


def gap_categories(constraints: DataFrame, sites: DataFrame, keys: list[str], essential: list[str], few: int = 3) -> DataFrame:
    """Essential categories a key lacks, where it has fewer than ``few`` constraints."""
    have = constraints.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set("category").alias("have"))
    j = sites.join(have, keys, "left")
    missing = F.array_except(F.array(*map(F.lit, essential)), F.coalesce("have", F.array().cast("array<string>")))
    return j.filter(F.coalesce("n", F.lit(0)) < few).select(*keys, F.explode(missing).alias("category"))


def constraint_rings(zones: DataFrame, constraints: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes made of constraints: the plot's setback (inset by the least setback), and a height outline at the greatest
    height over each building.  ``zones``: keys, zone_id, zone_type, x0 y0 x1 y1."""
    top = constraints.groupBy(*keys).agg(
        F.min(F.when(F.col("category") == "setback", F.col("value"))).alias("setback"), F.max(F.when(F.col("category") == "height", F.col("value"))).alias("height")
    )
    j = zones.join(top, keys)
    d = F.col("setback")
    plots = j.filter((F.col("zone_type") == "plot_boundary") & d.isNotNull() & (F.col("x1") - F.col("x0") > 2 * d) & (F.col("y1") - F.col("y0") > 2 * d))
    lines = plots.select(*keys, "zone_id", F.lit("setback_line").alias("zone_type"), *((F.col(c) + s * d).cast("double").alias(c) for c, s in (("x0", 1), ("y0", 1), ("x1", -1), ("y1", -1))), F.lit(0.0).alias("y_top"))
    highs = j.filter((F.col("zone_type") == "sub_zone") & F.col("height").isNotNull()).select(
        *keys, "zone_id", F.lit("height_limit").alias("zone_type"), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.col("height").alias("y_top")
    )
    return lines.unionByName(highs)
