"""From zones, programmes and constraints to volumes: envelopes, footprints, derived footprints, plinths, parking, floors.

Zones are rows of ``keys`` (a site), ``id``, ``zone_type``, ``label``, ``closed``, ``area``, box and ``points`` (a ring
in metres).  Which building stands in which envelope, and what overlaps, is decided on boxes; a building's floors come
from its programme, else from its zone's GFA.  Every step is a join on the site and an id, or a grid join.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions import geometry, overlay
from ..functions.classify import has_any, lookup
from . import ordered, programme
from .matching import either_holds
from .spatial import empty_envelopes, first_envelope
from .steps import settled

# --- fixed values ------------------------------------------------------------------------------------------
ROAD_LABELS = ["verkeer", "traffic", "road", "street", "weg", "straat", "fiets", "bicycle", "voetpad", "parking lot"]
USE_COLOURS = {
    "residential": "#8b5cf6", "commercial": "#3b82f6", "office": "#06b6d4", "retail": "#f59e0b", "mixed_use": "#ec4899", "parking": "#64748b",
    "underground_parking": "#475569", "plinth": "#f97316",
}
LEAST_AREA, NARROWEST, OF_PLOT, DEFAULT_HEIGHT = 0.01, 4.0, 0.4, 15.0
# -----------------------------------------------------------------------------------------------------------
BOX = ("x0", "y0", "x1", "y1")


def envelopes(zones: DataFrame) -> DataFrame:
    """Closed buildable and filled zones off the roads."""
    return zones.filter(F.col("zone_type").isin("buildable_envelope", "filled_zone") & F.col("closed") & ~has_any(F.col("label"), ROAD_LABELS) & (F.col("area") >= LEAST_AREA))


def footprints(zones: DataFrame, keys: list[str]) -> DataFrame:
    """Buildings of at most 0.4 of the plot (the largest zone where there is none) and 4 m across at least."""
    plot = zones.groupBy(*keys).agg(F.coalesce(programme.nonzero(F.max(F.when(F.col("zone_type") == "plot_boundary", F.col("area"))).cast("double")), F.max("area").cast("double")).alias("plot_area"))
    small = zones.filter("zone_type = 'sub_zone'").join(plot, keys).filter((F.col("area") <= F.col("plot_area") * OF_PLOT) & (F.col("area") >= LEAST_AREA))
    return small.withColumn("m", geometry.shape_metrics("points")).filter(F.col("m.min_dim") >= NARROWEST).drop("plot_area", "m")


def site_limits(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the least positive height, the least setback, and the last ratios of coverage and floor space (category,
    name, value, seq)."""
    c, v, low = F.col("category"), F.col("value"), F.lower(F.coalesce("name", F.lit("")))
    dense = c == "density"
    grz = dense & (F.contains(low, F.lit("grz")) | F.contains(low, F.lit("coverage")) | F.contains(low, F.lit("bebouwing")))
    fsi = dense & ~grz & (F.contains(low, F.lit("fsi")) | F.contains(low, F.lit("gfz")) | F.contains(low, F.lit("far")))
    return constraints.groupBy(*keys).agg(
        F.min(F.when((c == "height") & (v > 0), v)).alias("site_height"), F.min(F.when(c == "setback", v)).alias("setback"), F.max(F.when(c == "gfa", v)).alias("site_gfa"),
        F.max_by(F.when(grz, v), F.when(grz, F.col("seq"))).alias("density"), F.max_by(F.when(fsi, v), F.when(fsi, F.col("seq"))).alias("fsi"),
    )


def with_targets(envs: DataFrame, programmes: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Envelopes with their programme (zone id, typology, use, target_gfa_m2, max_height_m, parking_levels): a missing
    height is the site's or 15 m, a missing GFA the area times the index of the use.

    A zone whose id has no programme takes the first (by zone_index) whose zone_label holds its label or is held by it, if
    the programmes have these columns."""
    own = programmes.drop("zone_label", "zone_index").withColumnRenamed("zone_id", "id")
    j = envs.join(own, [*keys, "id"], "left")
    if {"zone_label", "zone_index"} <= set(programmes.columns):
        j = j.filter(F.col("typology").isNotNull()).unionByName(_by_label(envs.join(own, [*keys, "id"], "left_anti"), programmes, keys), allowMissingColumns=True)
    j = j.join(limits, keys, "left")
    j = j.withColumns({"use": F.coalesce("use", F.lit("residential")), "max_height_m": F.coalesce(programme.nonzero(F.col("max_height_m")), "site_height", F.lit(DEFAULT_HEIGHT))})
    return programme.default_gfa(j)


def _by_label(envs: DataFrame, programmes: DataFrame, keys: list[str]) -> DataFrame:
    """``envs`` with the first programme whose label and theirs are one in the other."""
    held = either_holds(envs.select(*keys, "id", "label"), programmes.select(*keys, F.col("zone_index").alias("id"), F.col("zone_label").alias("label")), keys)
    first = held.groupBy(*keys, F.col("left_id").alias("id")).agg(F.min("right_id").alias("zone_index"))
    p = programmes.drop("zone_id", "zone_label").dropDuplicates([*keys, "zone_index"])
    return envs.join(first, [*keys, "id"], "left").join(p, [*keys, "zone_index"], "left").drop("zone_index")


def scaled(ring: Column, centre: Column, factor: Column) -> Column:
    """A ring scaled about a point, four decimals."""
    c = centre
    return F.transform(ring, lambda p: F.array(F.round(c[0] + (p[0] - c[0]) * factor, 4), F.round(c[1] + (p[1] - c[1]) * factor, 4)))


def laid_out(ring: overlay.Ring, setback: float, count: int, spacing: float, width: float, length: float) -> list[overlay.Part]:
    """A row of ``count`` equal rectangles along the longest side of a ring, in the middle of it: closer together, then
    shorter, where they do not fit; each clipped to the ring set back (rounded) where over 0.3 of it is inside, else whole.
    None where the ring is longer across that side than along it."""
    room = next(iter(overlay.offset(ring, setback, True)), None) if setback > 0 else None
    back = room.outer if room else ring
    a, b = max(zip(back, back[1:] + back[:1]), key=lambda s: math.dist(*s))
    turn = math.atan2(b[1] - a[1], b[0] - a[0])
    cos, sin = math.cos(turn), math.sin(turn)
    flat = [(x * cos + y * sin, y * cos - x * sin) for x, y in back]
    low_x, high_x, low_y, high_y = min(x for x, _ in flat), max(x for x, _ in flat), min(y for _, y in flat), max(y for _, y in flat)
    along, across = high_x - low_x, high_y - low_y
    if along < across:
        return []
    if count * length + (count - 1) * spacing > along:
        if count > 1:
            spacing = max(2.0, (along - count * length) / (count - 1))
        if count * length + (count - 1) * spacing > along:
            length = max(5.0, (along - (count - 1) * spacing) / count)
    if width > across:
        width = max(4.0, across - 1.0)
    at, low, out = low_x + (along - count * length - (count - 1) * spacing) / 2, (low_y + high_y - width) / 2, []
    for k in range(count):
        x = at + k * (length + spacing)
        box = [(x, low), (x + length, low), (x + length, low + width), (x, low + width)]
        inside = overlay.intersection(flat, box)
        if sum(p.area for p in inside) > 0.3 * length * width:
            out.append(inside[0])
        else:
            out.append(overlay.Part(length * width, box))
    return [overlay.Part(p.area, [(x * cos - y * sin, x * sin + y * cos) for x, y in p.outer]) for p in out]


@F.pandas_udf(ArrayType(StructType().add("points", ArrayType(ArrayType(DoubleType()))).add("area", DoubleType())))
def layout_of(rings: pd.Series, setback: pd.Series, count: pd.Series, spacing: pd.Series, width: pd.Series, length: pd.Series) -> pd.Series:
    """``laid_out`` of each ring; bounds of the sizes as the proposals have them; null rings give null."""
    out = []
    for r, d, n, s, w, h in zip(rings, setback, count, spacing, width, length, strict=True):
        ring = overlay.open_ring(r)
        got = laid_out(ring, max(0.0, d), max(1, int(n)), max(0.0, s), max(4.0, w), max(5.0, h)) if len(ring) > 2 else []
        out.append([{"points": [[round(x, 4), round(y, 4)] for x, y in p.outer], "area": float(p.area)} for p in got])
    return pd.Series(out)


def lay_out_footprints(targets: DataFrame, keys: list[str], proposals: DataFrame | None = None) -> DataFrame:
    """Footprints in rows for envelopes of ``with_targets``, tried before any scaling: one to four blocks of 12 m (of 16 m where
    the typology names no homes) that together have the wanted area, 15 to 50 m long and 6 m apart.

    ``proposals`` (keys, id, count, spacing_m, width_m, length_m, from a model or a person) come first where they are: their
    width is 18 m at most, 14 m for homes.  Envelopes where nothing is wanted, or as much as there is room, have none.
    Returns keys, id, envelope, points, area, method, confidence, as ``derive_footprints``."""
    t = _wanted(targets, keys)
    low = F.lower(F.coalesce("typology", F.lit("")))
    homes = (low == "") | F.contains(low, F.lit("res")) | F.contains(low, F.lit("home"))
    width = F.when(homes, 12.0).otherwise(16.0)
    count = F.least(F.lit(4), F.greatest(F.lit(1), F.rint(F.col("want") / (width * 35.0)).cast("int")))
    length = F.greatest(F.lit(15.0), F.least(F.lit(50.0), F.col("want") / (count * width)))
    t = t.withColumns({"_w": width, "_n": count, "_l": length, "_s": F.lit(6.0), "_how": F.lit("CAD_rule_fallback"), "_ok": F.col("want") < F.col("room"), "_sure": F.lit(0.55)})
    if proposals is not None:
        p = proposals.select(*keys, "id", F.col("count").alias("p_n"), F.col("spacing_m").alias("p_s"), F.col("width_m").alias("p_w"), F.col("length_m").alias("p_l"))
        t = t.join(p, [*keys, "id"], "left")
        cap = F.when(homes, 14.0).otherwise(18.0)
        given = F.col("p_n").isNotNull()
        t = t.withColumns(
            {
                "_n": F.coalesce("p_n", "_n").cast("int"), "_s": F.coalesce("p_s", "_s").cast("double"), "_l": F.coalesce("p_l", "_l").cast("double"),
                "_w": F.coalesce(F.least("p_w", cap), "_w").cast("double"), "_how": F.when(given, "CAD_AI_proposal").otherwise(F.col("_how")),
                "_ok": given | F.col("_ok"), "_sure": F.when(given, 0.65).otherwise(F.col("_sure")),
            }
        )
    t = t.filter("_ok").withColumn("blocks", layout_of("ring", F.coalesce(programme.nonzero(F.col("setback")), F.lit(3.0)).cast("double"), "_n", "_s", "_w", "_l"))
    b = t.select(*keys, "id", "_how", "_sure", F.posexplode("blocks").alias("k", "b"))
    return b.select(
        *keys, F.concat(F.lit("derived_"), F.col("id").cast("string"), F.lit("_"), (F.col("k") + 1).cast("string")).alias("id"), F.col("id").alias("envelope"), F.col("b.points").alias("points"),
        F.round("b.area", 4).alias("area"), F.col("_how").alias("method"), F.col("_sure").alias("confidence"),
    )


def _wanted(targets: DataFrame, keys: list[str]) -> DataFrame:
    """``targets`` with ``ring`` (set back where over a tenth is left), its ``room`` and perimeter, ``floors``, the footprint
    that is wanted (null: unknown) and ``how``."""
    back = geometry.inset_ring(F.col("points"), F.coalesce("setback", F.lit(0.0)).cast("double"))
    t = targets.withColumn("back", F.when(F.col("setback") > 0, back))
    fits = (F.size("back") > 2) & (geometry.area(F.col("back")) > geometry.area(F.col("points")) * 0.1)
    t = settled(t.withColumn("ring", F.when(F.coalesce(fits, F.lit(False)), F.col("back")).otherwise(F.col("points"))))
    t = t.withColumns({"room": geometry.area(F.col("ring")), "around": geometry.perimeter(F.col("ring"))})
    t = t.withColumns({"floors": F.greatest(F.floor(F.least("max_height_m", F.coalesce("site_height", "max_height_m")) / programme.FLOOR_HEIGHT), F.lit(1))})
    gfa = F.greatest("target_gfa_m2", F.coalesce("site_gfa", F.lit(0.0)))
    want = F.coalesce(programme.nonzero(gfa) / F.col("floors"), programme.nonzero(F.col("fsi")) * F.col("room") / F.col("floors"), programme.nonzero(F.col("density")) * F.col("room"))
    how = F.when(programme.nonzero(gfa).isNotNull(), "gfa_derived").when(programme.nonzero(F.col("fsi")).isNotNull(), "fsi_derived").otherwise("density_derived")
    return t.withColumns({"want": F.when(want > F.col("room"), F.col("room") * 0.85).otherwise(want), "how": how})


def derive_footprints(targets: DataFrame, keys: list[str]) -> DataFrame:
    """A footprint for each envelope of ``with_targets`` (those without a building): the envelope set back, then scaled to
    GFA / floors, FSI * area / floors or density * area; where that leaves 0.95 of it or more, or nothing is known, inset
    by 3 hundredths of its perimeter (2 m at least) and scaled to 0.6.  ``lay_out_footprints`` is tried before it where
    a typology is known.

    Returns keys, id (``derived_`` and the envelope's), envelope, points, area, method, confidence."""
    t = _wanted(targets, keys)
    whole = F.col("want").isNull() | (F.col("want") >= F.col("room") * 0.95)
    inset = geometry.inset_ring(F.col("ring"), F.greatest(F.col("around") * 0.03, F.lit(2.0)))
    t = settled(t.withColumn("inset", F.when(whole, inset)))
    kept = F.when(whole & (F.size("inset") > 2), F.col("inset")).otherwise(F.col("ring"))
    t = settled(t.withColumn("base_ring", kept).withColumn("centre", geometry.centroid(kept)))
    factor = F.when(whole, F.sqrt(F.lit(0.6))).otherwise(F.sqrt(F.col("want") / F.greatest("room", F.lit(1.0))))
    shape = scaled(F.col("base_ring"), F.col("centre"), factor)
    left = F.when(F.size("inset") > 2, geometry.area(F.col("inset"))).otherwise(F.col("room"))
    return t.withColumn("shape", shape).select(
        *keys, F.concat(F.lit("derived_"), F.col("id").cast("string")).alias("id"), F.col("id").alias("envelope"), F.col("shape").alias("points"),
        F.round(F.when(whole, left * 0.6).otherwise(F.col("want")), 4).alias("area"), F.when(whole, "inset_60pct").otherwise(F.col("how")).alias("method"), F.when(whole, 0.45).otherwise(0.55).alias("confidence"),
    )


def _measured(df: DataFrame, ring: str) -> DataFrame:
    return df.withColumns({"middle": geometry.vertex_mean(F.col(ring)), "size": geometry.area(F.col(ring))})


def _volume(keys: list[str], ring: Column, low: Column, high: Column, building: Column, label: Column, floor: Column, floor_label: Column, use: Column, kind: Column, sure: Column) -> list:
    """Columns of a volume: footprint at both heights (x, y, z with y up), colour, area, centre; ``_measured`` comes first."""
    middle, size = F.col("middle"), F.col("size")
    colour = F.coalesce(lookup(use, USE_COLOURS), lookup(kind, USE_COLOURS), F.lit("#94a3b8"))

    def at(y: Column) -> Column:
        return F.transform(ring, lambda p: F.array(p[0], F.round(y, 4), p[1]))

    return [
        *keys, building.alias("building_id"), label.alias("building_label"), floor.cast("int").alias("floor_index"), floor_label.alias("floor_label"), use.alias("use_type"), kind.alias("zone_type"),
        F.concat(label, F.lit(" · "), floor_label).alias("zone_label"), at(low).alias("points"), at(high).alias("points_top"), F.round(low, 4).alias("y_bottom"), F.round(high, 4).alias("y_top"),
        F.round(high - low, 4).alias("height"), colour.alias("color_hint"), F.array(F.round(middle[0], 4), F.round((low + high) / 2, 4), F.round(middle[1], 4)).alias("centroid"),
        F.round(size, 1).alias("area_m2"), F.round(sure, 2).alias("confidence"),
    ]


def plinth_volumes(targets: DataFrame, keys: list[str]) -> DataFrame:
    """A podium of 4.5 m on plinth_tower zones: the envelope inset by 4 hundredths of its perimeter (1.5 m at least) where
    over 0.3 of it is left, else all of it."""
    t = targets.filter("typology = 'plinth_tower'").withColumn("inset", geometry.inset_ring(F.col("points"), F.greatest(geometry.perimeter(F.col("points")) * 0.04, F.lit(1.5))))
    ring = F.when((F.size("inset") > 2) & (geometry.area(F.col("inset")) > F.col("area") * 0.3), F.transform("inset", lambda p: F.transform(p, lambda v: F.round(v, 4)))).otherwise(F.col("points"))
    t = _measured(settled(t.withColumn("ring", ring)), "ring")
    zero = F.lit(0.0)
    return t.select(*_volume(keys, F.col("ring"), zero, F.lit(programme.PLINTH_HEIGHT), F.concat(F.lit("plinth_"), F.col("id").cast("string")),
                             F.concat(F.lit("Plinth ("), F.coalesce("label", F.lit("Mixed-Use")), F.lit(")")), F.lit(0), F.lit("Commercial Plinth"), F.lit("retail"), F.lit("plinth"), F.lit(0.75)))


def parking_volumes(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Levels of 3 m below the whole envelope."""
    e = _measured(targets.filter("parking_levels > 0"), "points").select("*", F.explode(F.sequence(F.lit(1), F.col("parking_levels"))).alias("level"))
    d, n = programme.PARKING_DEPTH, F.col("level")
    return e.select(*_volume(keys, F.col("points"), -n * d, (1 - n) * d, F.concat(F.lit("parking_"), F.col("id").cast("string")), F.concat(F.lit("Parking ("), F.coalesce("label", F.lit("")), F.lit(")")),
                             -n, F.concat(F.lit("Parking B"), n.cast("string")), F.lit("underground_parking"), F.lit("underground_parking"), F.lit(0.70)))


def building_volumes(buildings: DataFrame, targets: DataFrame, programmes: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """A volume a floor of each kept building (keys, id string, envelope or null, points, area, derived, kept): floors of its
    programme (building_id string, floors, floor_height, uses, label, confidence), else of its zone's GFA by share of the
    capped footprints, three at least but for retail and industry; under the zone's height, the site's, or 45 m, and on the
    plinth where its zone has one."""
    z = targets.select(*keys, F.col("id").alias("envelope"), "use", "target_gfa_m2", "max_height_m", F.when(F.col("typology") == "plinth_tower", programme.PLINTH_HEIGHT).otherwise(0.0).alias("base"))
    j = buildings.filter("area >= 0.1").join(z, [*keys, "envelope"], "left").join(limits.select(*keys, "site_height"), keys, "left")
    j = j.withColumns({"top": F.coalesce("max_height_m", "site_height", F.lit(programme.HEIGHT_CAP)), "base": F.coalesce("base", F.lit(0.0))})
    counts = programme.floor_counts(
        j.select(*keys, F.col("envelope").alias("zone_id"), F.col("id").alias("building_id"), F.col("area").alias("footprint"), F.coalesce("use", F.lit("residential")).alias("use"),
                 F.col("target_gfa_m2").alias("zone_gfa"), F.col("top").alias("max_height"), F.col("base").alias("base_y")), keys
    ).select(*keys, F.col("building_id").alias("id"), F.col("floors").alias("n_derived"))
    p = programmes.select(F.col("building_id").alias("id"), F.col("floors").alias("p_floors"), F.col("floor_height").alias("p_height"), "uses", F.col("label").alias("p_label"), F.col("confidence").alias("p_sure"))
    j = j.join(counts, [*keys, "id"]).join(p, "id", "left")
    known = F.col("p_floors").isNotNull()
    h = F.coalesce("p_height", F.lit(programme.FLOOR_HEIGHT)).cast("double")
    room = F.greatest(F.floor((F.col("top") - F.col("base")) / h), F.lit(1))
    n = F.least(F.when(known, F.col("p_floors")).otherwise(F.col("n_derived")), room).cast("int")
    e = _measured(j.withColumns({"h": h, "n": n}).filter("kept and n > 0"), "points").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("f"))
    own = F.get(F.filter("uses", lambda u: u["floor"] == F.col("f")), F.lit(0))["use"]
    use = F.coalesce(own, F.try_element_at("uses", F.lit(-1))["use"], F.lit("residential"))
    label = F.coalesce("p_label", F.nullif("label", F.lit("")), F.concat(F.lit("Building "), F.col("id")))
    sure = F.when(known, F.coalesce("p_sure", F.lit(0.7))).when(F.col("derived"), 0.55).otherwise(0.50)
    return e.select(*_volume(keys, F.col("points"), F.col("base") + F.col("f") * F.col("h"), F.col("base") + (F.col("f") + 1) * F.col("h"), F.col("id"), label, F.col("f"),
                             F.concat(F.lit("Floor "), F.col("f").cast("string")), use, F.lit("building_floor"), sure))


def annotations(envs: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers Z1, Z2 .. at the middle of a site's envelopes, by id."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    middle = geometry.vertex_mean(F.col("points"))
    z = envs.withColumn("n", n)
    return z.select(
        *keys, F.concat(F.lit("annot_zone_"), F.col("id").cast("string")).alias("id"), F.lit("zone_annotation").alias("zone_type"), F.concat(F.lit("Z"), F.col("n").cast("string")).alias("zone_label"),
        F.concat(F.lit("Z"), F.col("n").cast("string"), F.lit(": "), F.coalesce("label", F.concat(F.lit("Zone "), F.col("n").cast("string")))).alias("annotation_text"),
        F.round(middle[0], 4).alias("x"), F.round(middle[1], 4).alias("z"), "n",
    )


def summary(volumes: DataFrame, derived: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a site's volumes by type, buildings, derived footprints and annotations."""

    def of(t: str) -> Column:
        return F.count_if(F.col("zone_type") == t)

    v = volumes.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_distinct(F.when(F.col("zone_type") == "building_floor", F.col("building_id"))).alias("buildings_processed"), of("building_floor").alias("building_floors"),
        of("plinth").alias("plinths"), of("underground_parking").alias("parking_levels"),
    )
    d = derived.groupBy(*keys).agg(F.count("*").alias("derived_from_envelope"))
    a = notes.groupBy(*keys).agg(F.count("*").alias("annotations"))
    j = v.join(d, keys, "left").join(a, keys, "left")
    return j.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("derived_from_envelope", "annotations")})


def generate(zones: DataFrame, zone_programmes: DataFrame, programmes: DataFrame, constraints: DataFrame, keys: list[str], size: float) -> dict[str, DataFrame]:
    """volumes, derived, annotations and summary of the sites; a building more than a fifth of which lies on an earlier
    one has no volumes."""
    envs, limits = envelopes(zones), settled(site_limits(constraints, keys))
    targets = settled(with_targets(envs, zone_programmes, limits, keys))
    houses = settled(footprints(zones, keys))
    boxes = [*keys, "id", *BOX]
    home = first_envelope(houses.select(*boxes), envs.select(*boxes), keys, size)
    bare = empty_envelopes(envs.select(*boxes), houses.select(*boxes), keys, size).select(*keys, "id")
    derived = settled(derive_footprints(targets.join(bare, [*keys, "id"], "left_semi"), keys))
    free = ordered.skip_overlaps(houses.select(*boxes), keys, size).withColumn("kept", F.lit(True))
    own = houses.join(free, [*keys, "id"], "left").join(home, [*keys, "id"], "left").select(
        *keys, F.col("id").cast("string").alias("id"), "envelope", "label", "points", F.col("area").cast("double").alias("area"), F.lit(False).alias("derived"), F.coalesce("kept", F.lit(False)).alias("kept")
    )
    new = derived.select(*keys, "id", "envelope", F.concat(F.lit("Derived ("), F.col("envelope").cast("string"), F.lit(")")).alias("label"), "points", "area", F.lit(True).alias("derived"), F.lit(True).alias("kept"))
    floors = building_volumes(own.unionByName(new), targets, programmes, limits, keys)
    volumes = settled(plinth_volumes(targets, keys).unionByName(parking_volumes(targets, keys)).unionByName(floors))
    notes = annotations(envs, keys)
    return {"volumes": volumes, "derived": derived, "annotations": notes, "summary": summary(volumes, derived, notes, keys)}
