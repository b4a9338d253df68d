"""Tables behind the exports: layers, colours, entities, key=value pairs, DXF text, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import lookup

# --- fixed values: categories, layers and colours of the drawing formats -------------------------------------
CATEGORIES = {
    "BOUNDARIES": ["plot_boundary", "zone_boundary", "parcel_line", "major_boundary", "restriction_line"],
    "ZONES": ["buildable_envelope", "landscape_zone", "infrastructure_zone", "filled_zone", "no_build_zone", "uncategorized_zone", "traffic_zone", "zone_annotation"],
    "BUILDINGS": ["sub_zone"],
    "CONSTRAINTS": ["setback_line", "height_limit", "constraint_zone"],
    "VOLUMES": ["building_floor", "plinth", "underground_parking"],
    "INFRASTRUCTURE": ["context_line", "minor_context", "cad_context"],
}
PREFIXES = {
    "BOUNDARIES": "00_Boundaries", "ZONES": "01_Zones", "BUILDINGS": "02_Buildings", "CONSTRAINTS": "03_Constraints",
    "VOLUMES": "04_Generated_Volumes", "INFRASTRUCTURE": "05_Infrastructure",
}
ACI = {
    "plot_boundary": 5, "zone_boundary": 2, "parcel_line": 4, "major_boundary": 7, "restriction_line": 1, "buildable_envelope": 30,
    "landscape_zone": 3, "infrastructure_zone": 9, "filled_zone": 30, "no_build_zone": 1, "uncategorized_zone": 30, "traffic_zone": 9,
    "sub_zone": 6, "setback_line": 1, "height_limit": 2, "constraint_zone": 30, "building_floor": 6, "plinth": 30,
    "underground_parking": 9, "context_line": 9, "minor_context": 8, "cad_context": 9,
}
ACI_RGB = {
    1: (255, 0, 0), 2: (255, 255, 0), 3: (0, 255, 0), 4: (0, 255, 255), 5: (0, 0, 255), 6: (255, 0, 255), 7: (255, 255, 255),
    8: (128, 128, 128), 9: (192, 192, 192), 30: (255, 127, 0),
}
#: Names that are not just the type in title case.
LAYER_NAMES = {"sub_zone": "Building_Footprint", "cad_context": "CAD_Context"}
#: Model name prefix -> price of a million input and output tokens; the first prefix that fits counts.
PRICES = [
    ("gemini-3.5-flash", 1.50, 9.00), ("gemini-2.5-flash", 0.15, 0.60), ("gemini-2.5-pro", 1.25, 10.00), ("gemini-2.0-flash", 0.10, 0.40),
    ("gemini-1.5-flash", 0.075, 0.30), ("gemini-1.5-pro", 1.25, 5.00),
]
DEFAULT_PRICE = (0.15, 0.60)
# --------------------------------------------------------------------------------------------------------------
CATEGORY_OF = {t: c for c, ts in CATEGORIES.items() for t in ts}


def category(ztype: Column) -> Column:
    return lookup(ztype, CATEGORY_OF, "ZONES")


def layer_name(ztype: Column) -> Column:
    known = ztype.isin(*ACI)
    title = F.when(known, F.replace(F.initcap(F.replace(ztype, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))).otherwise(F.replace(ztype, F.lit(" "), F.lit("_")))
    return F.concat(lookup(category(ztype), PREFIXES), F.lit("-"), F.coalesce(lookup(ztype, LAYER_NAMES), title))


def aci_rgb(aci: Column) -> Column:
    rgb = F.array(F.lit(200), F.lit(200), F.lit(200))
    for k, v in ACI_RGB.items():
        rgb = F.when(aci == k, F.array(*map(F.lit, v))).otherwise(rgb)
    return rgb


def metadata(columns: dict[str, Column]) -> Column:
    """key=value strings of the columns that are not null, in their order."""
    return F.filter(F.array(*(F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in columns.items())), lambda x: x.isNotNull())


def layer_counts(zones: DataFrame) -> DataFrame:
    """Objects by category and type, with subtotals (null type) and the total (both null)."""
    return zones.withColumn("category", category(F.col("zone_type"))).rollup("category", "zone_type").agg(F.count("*").alias("n"))


def footprint_entities(zones: DataFrame) -> DataFrame:
    """A closed outline a zone (points array<array<double>> as x, 0, z): vertices as x, y; fewer than two go."""
    p = F.transform("points", lambda q: F.array(q[0], q[2]))
    ring = F.when(F.get(p, 0) == F.element_at(p, -1), p).otherwise(F.concat(p, F.slice(p, 1, 1)))
    return zones.filter(F.size("points") >= 2).select("zone_id", layer_name(F.col("zone_type")).alias("layer"), F.posexplode(ring).alias("seq", "v")).select(
        "zone_id", "layer", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")
    )


def volume_entities(volumes: DataFrame) -> DataFrame:
    """Two rings, n vertical edges and n walls a volume: kind and how many, by distinct corners (four decimals)."""
    corners = F.array_distinct(F.transform("points", lambda q: F.array(F.round(q[0], 4), F.round(q[2], 4))))
    n = volumes.select("volume_id", F.size(corners).cast("long").alias("n")).filter("n >= 3")
    return n.select("volume_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("n")) for k, c in (("ring", F.lit(2).cast("long")), ("edge", F.col("n")), ("wall", F.col("n")))))).alias("e")).select("volume_id", "e.kind", "e.n")


def constraint_column(constraints: DataFrame, keys: list[str]) -> DataFrame:
    """Where each constraint is written: x = -20, lines 1.5 apart, by key."""
    w = Window.partitionBy(*keys).orderBy("category", "value")
    return constraints.select(*keys, "category", "value", F.lit(-20.0).alias("x"), (-1.5 * (F.row_number().over(w) - 1)).alias("y"))


def attach_constraints(buildings: DataFrame, constraints: DataFrame, keys: list[str]) -> DataFrame:
    """A map of the key's constraints, ``category_i`` -> value, on each building; constraints of a key are few."""
    w = Window.partitionBy(*keys, "category").orderBy("value")
    numbered = constraints.withColumn("i", F.row_number().over(w) - 1)
    packed = numbered.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("_", "category", F.col("i").cast("string")).alias("k"), F.col("value").cast("string").alias("v"))))).alias("site_constraints")
    )
    return buildings.join(packed, keys, "left")


def volume_parts(volumes: DataFrame) -> DataFrame:
    """The entities of a volume (volume_id, points as x, 0, z, y_bottom, y_top): two closed rings, an upright line a corner
    and a wall a side, as kind, part and points (x, y, z with z up); under three distinct corners there are none."""
    seen = F.transform("points", lambda q: F.struct(F.round(q[0], 4).alias("k"), F.round(q[2], 4).alias("l"), q[0].alias("x"), q[2].alias("y")))
    keyed = F.transform(seen, lambda q: F.struct(q["k"].alias("k"), q["l"].alias("l")))
    first = F.filter(F.transform(F.sequence(F.lit(1), F.size("points")), lambda i: F.when(F.array_position(keyed, F.get(keyed, i - 1)) == i, F.get(seen, i - 1))), lambda q: q.isNotNull())
    c = volumes.withColumn("c", first).filter(F.size("c") >= 3).withColumn("n", F.size("c"))

    def at(i: Column, z: str) -> Column:
        q = F.get("c", F.pmod(i, F.col("n")))
        return F.array(q["x"], q["y"], F.col(z).cast("double"))

    def part(kind: str, i: Column, points: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("part"), points.alias("points"))

    def ring(z: str) -> Column:
        return F.transform("c", lambda q: F.array(q["x"], q["y"], F.col(z).cast("double")))

    places = F.sequence(F.lit(0), F.col("n") - 1)
    parts = F.concat(
        F.array(part("ring", F.lit(0), ring("y_bottom")), part("ring", F.lit(1), ring("y_top"))),
        F.transform(places, lambda i: part("edge", i, F.array(at(i, "y_bottom"), at(i, "y_top")))),
        F.transform(places, lambda i: part("wall", i, F.array(at(i, "y_bottom"), at(i + 1, "y_bottom"), at(i + 1, "y_top"), at(i, "y_top")))),
    )
    kept = [x for x in volumes.columns if x != "points"]
    return c.select(*kept, F.explode(parts).alias("e")).select(*kept, "e.kind", "e.part", "e.points")


# --- DXF text -------------------------------------------------------------------------------------------------
#: Name under which the key=value strings stand, and the layer of the constraint column.
APP, NOTES = "KADASTRA", "03_Constraints-Annotations"
_LAYER = "0\nLAYER\n2\n%s\n70\n0\n62\n%d\n6\nCONTINUOUS"


def _codes(*pairs: tuple[int, str | Column]) -> Column:
    """Group codes and values, one a line."""
    return F.concat_ws("\n", *(x for c, v in pairs for x in (F.lit(str(c)), F.lit(v) if isinstance(v, str) else v)))


def _number(c: Column) -> Column:
    return F.format_string("%.4f", c.cast("double"))


def _xdata(pairs: Column) -> Column:
    """The strings under the name of this library; null where there are none."""
    return F.when(F.size(pairs) > 0, F.concat_ws("\n", F.lit("1001"), F.lit(APP), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("1000\n"), p)), "\n")))


def _polyline(layer: Column, points: Column, flags: Column, vertex: int, pairs: Column) -> Column:
    v = F.transform(points, lambda p: _codes((0, "VERTEX"), (8, layer), (10, _number(p[0])), (20, _number(p[1])), (30, _number(F.coalesce(F.get(p, F.lit(2)), F.lit(0.0)))), (70, str(vertex))))
    head = _codes((0, "POLYLINE"), (8, layer), (66, "1"), (10, "0.0"), (20, "0.0"), (30, "0.0"), (70, flags.cast("string")))
    return F.concat_ws("\n", head, _xdata(pairs), F.array_join(v, "\n"), _codes((0, "SEQEND"), (8, layer)))


def dxf_document(objects: DataFrame, keys: list[str], constraints: DataFrame | None = None) -> DataFrame:
    """An R12 drawing a key as rows (keys, section, object, part, value) of group codes, to be joined in that order.

    ``objects``: keys, id, zone_type, points (x, 0, z), closed, y_bottom and y_top (null for flat ones), pairs (key=value
    strings).  ``constraints``: keys, name, value, unit, category.  Objects of fewer than two points go; a key without
    objects has no drawing."""
    o = objects.filter(F.size("points") >= 2).withColumn("layer", layer_name(F.col("zone_type")))
    solid = F.col("y_bottom").isNotNull() & F.col("y_top").isNotNull()
    row = lambda df, section, obj, part, value: df.select(*keys, F.lit(section).alias("section"), obj.alias("object"), part.alias("part"), value.alias("value"))
    flat = o.filter(~solid).withColumn("p", F.transform("points", lambda q: F.array(q[0], q[2])))
    outlines = row(flat, 3, F.col("id").cast("string"), F.lit(0), _polyline(F.col("layer"), F.col("p"), F.when(F.col("closed"), 1).otherwise(0), 0, F.col("pairs")))
    parts = volume_parts(o.filter(solid).withColumn("volume_id", F.col("id")))
    p, layer = F.col("points"), F.col("layer")

    def corner(i: int, k: int) -> list[tuple[int, Column]]:
        return [(10 + k, _number(p[i][0])), (20 + k, _number(p[i][1])), (30 + k, _number(p[i][2]))]

    body = (
        F.when(F.col("kind") == "ring", _polyline(layer, p, F.lit(9), 32, F.col("pairs")))
        .when(F.col("kind") == "edge", F.concat_ws("\n", _codes((0, "LINE"), (8, layer), *corner(0, 0), *corner(1, 1)), _xdata(F.col("pairs"))))
        .otherwise(F.concat_ws("\n", _codes((0, "3DFACE"), (8, layer), *(x for i in range(4) for x in corner(i, i))), _xdata(F.col("pairs"))))
    )
    order = F.when(F.col("kind") == "ring", 0).when(F.col("kind") == "edge", 10_000).otherwise(20_000) + F.col("part")
    solids = row(parts, 3, F.col("id").cast("string"), order, body)
    used = o.select(*keys, F.col("layer").alias("name"), lookup(F.col("zone_type"), ACI, 7).alias("aci")).groupBy(*keys, "name").agg(F.min("aci").alias("aci"))
    sites = o.select(*keys).distinct()
    parents = sites.select(*keys, F.explode(F.array(*(F.lit(x) for x in [*PREFIXES.values(), NOTES]))).alias("name")).withColumn("aci", F.when(F.col("name") == NOTES, 2).otherwise(7))
    layers = row(used.unionByName(parents), 1, F.col("name"), F.lit(0), F.format_string(_LAYER, "name", "aci"))
    head = "0\nSECTION\n2\nHEADER\n9\n$ACADVER\n1\nAC1009\n0\nENDSEC\n0\nSECTION\n2\nTABLES\n0\nTABLE\n2\nAPPID\n70\n1\n0\nAPPID\n2\n" + APP + "\n70\n0\n0\nENDTAB\n0\nTABLE\n2\nLAYER\n70\n64"
    fixed = [(0, head), (2, "0\nENDTAB\n0\nENDSEC\n0\nSECTION\n2\nENTITIES"), (5, "0\nENDSEC\n0\nEOF")]
    frame = [row(sites, n, F.lit(""), F.lit(0), F.lit(text)) for n, text in fixed]
    out = outlines.unionByName(solids).unionByName(layers)
    for f in frame:
        out = out.unionByName(f)
    if constraints is not None:
        w = Window.partitionBy(*keys).orderBy("category", "value", "name")
        c = constraints.join(sites, keys, "left_semi").withColumn("n", F.row_number().over(w) - 1)
        text = F.format_string("%s: %s %s [%s]", F.coalesce("name", F.lit("Constraint")), F.coalesce(F.col("value").cast("string"), F.lit("")), F.coalesce("unit", F.lit("")), F.coalesce("category", F.lit("")))
        out = out.unionByName(row(c, 4, F.lit(""), F.col("n"), _codes((0, "TEXT"), (8, NOTES), (10, "-20.0"), (20, _number(-1.5 * F.col("n"))), (30, "0.0"), (40, "0.5"), (1, text))))
    return out


def write_dxf(document: DataFrame, keys: list[str], path: str) -> None:
    """A text file a key under ``path``; a drawing is one task's rows, as its lines have an order."""
    if document.isEmpty():
        raise ValueError("no geometry to export")
    document.repartition(*keys).sortWithinPartitions(*keys, "section", "object", "part").select(*keys, "value").write.partitionBy(*keys).mode("overwrite").text(path)


def costs(calls: DataFrame) -> DataFrame:
    """Calls (stage, model, input_tokens, output_tokens) with their price."""
    name = F.coalesce("model", F.lit(""))
    a, b = F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for prefix, x, y in reversed(PRICES):
        a, b = F.when(F.startswith(name, F.lit(prefix)), x).otherwise(a), F.when(F.startswith(name, F.lit(prefix)), y).otherwise(b)
    return calls.withColumn("cost_usd", F.col("input_tokens") * a / 1e6 + F.col("output_tokens") * b / 1e6)


def cost_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    return costs(calls).groupBy(*keys).agg(
        F.count("*").alias("total_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.round(F.sum("cost_usd"), 4).alias("estimated_cost_usd"),
    )
