"""Numbers, patterns and word tests for regulatory text, as column expressions.

A pattern list is one array expression, so a text is scanned once however many patterns there are, and
duplicates are removed by a partial aggregation, not a window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: patterns, ranges and word lists that decide what is found --------------------------
CONSTRAINT_PATTERNS: dict[str, list[str]] = {
    "height": [
        r"(?:max(?:imale?)?[\s._-]*)?(?:nok|goot|bouw)?hoogte[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eter)?)?",
        r"(?:max(?:imum)?[\s._-]*)?(?:building[\s._-]*)?height[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eters?)?)?",
        r"(?:First|Trauf|Gebäude|max(?:imale?)?[\s._-]*)?[Hh]öhe[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eter)?)?",
    ],
    "setback": [
        r"(?:voor|achter|zij)?(?:gevel)?(?:rooilijn|afstand)[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eter)?)?",
        r"(?:front|rear|side|min(?:imum)?)?[\s._-]*setback[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eters?)?)?",
        r"(?:Grenz)?[Aa]bstand[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eter)?)?",
    ],
    "density": [
        r"bebouwings[\s._-]*(?:percentage|graad)[\s:=]*(\d+[.,]?\d*)\s*%?",
        r"(?:FSI|FAR|floor[\s._-]*(?:space|area)[\s._-]*(?:index|ratio))[\s:=]*(\d+[.,]?\d*)",
        r"(?:GRZ|GFZ)[\s:=]*(\d+[.,]?\d*)",
    ],
    "parking": [
        r"(?:parkeer(?:plaatsen|norm)?|parking)[\s:=]*(\d+[.,]?\d*)\s*(?:per|/)\s*(?:woning|unit|dwelling)?",
        r"(\d+[.,]?\d*)\s*(?:parkeer(?:plaatsen)?|parking\s*(?:spaces?)?)\s*(?:per|/)\s*(?:woning|unit|dwelling)",
    ],
    "gfa": [
        r"(?:GFA|gross\s*floor\s*area|bruto\s*vloer(?:opp(?:ervlak(?:te)?)?)?|BVO|BGF)\s*[:=]?\s*([\d.,]+)\s*(?:m[²2]|sqm)?",
        r"(?:total|totale?)\s*(?:floor\s*)?(?:area|oppervlak(?:te)?)\s*[:=]?\s*([\d.,]+)\s*(?:m[²2]|sqm)?",
        r"(?:target|beoogd[e]?|max(?:imale?)?|minimum?)\s*(?:GFA|BVO|BGF|floor\s*area)\s*[:=]?\s*([\d.,]+)\s*(?:m[²2]|sqm)?",
    ],
}
CONSTRAINT_RANGES = {"height": (1, 200), "setback": (0.5, 100), "parking": (0.1, 20), "gfa": (50, 5_000_000)}
CONSTRAINT_UNITS = {"height": "m", "setback": "m", "parking": "per dwelling", "gfa": "m²"}
#: category -> (substrings of the match, name), first hit wins; the last has no substrings.
CONSTRAINT_NAMES: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "height": [
        (("nok", "first", "ridge"), "Ridge Height (nokhoogte)"),
        (("goot", "trauf", "gutter"), "Gutter Height (goothoogte)"),
        ((), "Maximum Building Height"),
    ],
    "setback": [
        (("voor", "front"), "Front Setback"), (("achter", "rear"), "Rear Setback"), (("zij", "side"), "Side Setback"),
        ((), "Setback Line"),
    ],
    "density": [
        (("grz", "bebouwing"), "Building Coverage (GRZ)"), (("gfz", "fsi", "far"), "Floor Space Index (FSI)"),
        ((), "Build Percentage"),
    ],
    "parking": [((), "Parking Norm")],
    "gfa": [
        (("target", "beoogd"), "Target GFA"), (("max",), "Maximum GFA"), (("min",), "Minimum GFA"),
        ((), "Gross Floor Area"),
    ],
}
PROGRAMME_PATTERNS: dict[str, list[str]] = {
    "gfa": CONSTRAINT_PATTERNS["gfa"][:2],
    "floors": [
        r"(\d+)\s*(?:floors?|stories?|storeys?|verdiepingen?|bouwlagen?|Geschosse?|étages?|niveaux?)",
        r"(?:number\s*of\s*(?:floors?|stories?)|aantal\s*(?:bouw)?lagen)\s*[:=]?\s*(\d+)",
    ],
    "parking_ratio": [
        r"([\d.,]+)\s*(?:parkeer(?:plaatsen?)?|parking\s*(?:spaces?)?)\s*(?:per|/)\s*(?:woning|unit|dwelling|apartment)",
        r"(?:parkeer(?:norm)?|parking\s*ratio)\s*[:=]?\s*([\d.,]+)",
    ],
    "floor_height": [
        r"(?:floor|storey|verdiepings?)\s*height\s*[:=]?\s*([\d.,]+)\s*(?:m(?:eter)?)?",
        r"(?:verdiepings?hoogte)\s*[:=]?\s*([\d.,]+)\s*(?:m(?:eter)?)?",
    ],
}
USE_PATTERN = (
    r"\b(residential|commercial|mixed[- ]?use|office|retail|wonen|kantoor|winkel|gemengd|logement|bureau|commerce"
    r"|Wohnbau|Gewerbe)\b"
)
USE_MAP = {
    "residential": "residential", "wonen": "residential", "logement": "residential", "wohnbau": "residential",
    "commercial": "commercial", "kantoor": "commercial", "bureau": "commercial", "gewerbe": "commercial",
    "office": "office", "retail": "retail", "winkel": "retail", "commerce": "retail",
    "mixed-use": "mixed_use", "mixed use": "mixed_use", "gemengd": "mixed_use",
}
PLINTH_PATTERN = (
    r"\b(?:commercial\s*ground\s*floor|plinth|plint|commerci[ëe]le?\s*(?:begane\s*grond|plint)|retail\s*(?:at\s*)?ground"
    r"|ground\s*floor\s*(?:retail|commercial))\b"
)
UNDERGROUND_PATTERN = (
    r"\b(?:underground\s*park(?:ing|eer)|ondergronds[e]?\s*park(?:ing|eer|garage)|basement\s*park(?:ing)?|souterrain"
    r"|kelder(?:park(?:ing|eer))?|Tiefgarage|parking\s*(?:souterrain|sous-sol))\b"
)
ZONE_COUNT_PATTERN = r"(\d+)\s*(?:bouw(?:vlak(?:ken)?|zones?)|building\s*zones?|buildable\s*(?:areas?|zones?|envelopes?)|Baufelder?)"
BUILDING_COUNT_PATTERN = (
    r"(\d+)\s*(?:gebouwen|woningen|buildings?|dwellings?|units?|blokken|blocks?|Gebäude|bâtiments?|logements?)"
)
TYPOLOGY_PATTERNS = {
    "tower": r"\b(?:toren|tower|high[- ]?rise|woontoren|Hochhaus|tour|gratte[- ]?ciel)\b",
    "row_house": r"\b(?:rijtjes?(?:woning(?:en)?|huis|huizen)?|row\s*hous(?:e|ing|es)|terraced|Reihenhaus|Reihenhäuser|maison[s]?\s*en\s*bande)\b",
    "apartment_block": r"\b(?:appartement(?:en)?(?:blok|complex|gebouw)?|apartment\s*(?:block|building)|flat(?:gebouw)?|Mehrfamilienhaus|immeuble)\b",
    "detached": r"\b(?:vrijstaand|detached|single[- ]?family|Einfamilienhaus|maison\s*individuelle)\b",
    "semi_detached": r"\b(?:twee[- ]?onder[- ]?een[- ]?kap|semi[- ]?detached|Doppelhaus|maison\s*jumelée)\b",
    "plinth_tower": r"\b(?:plint|plinth|podium|socle|onderbouw)\b",
    "mixed_use": r"\b(?:gemengd|mixed[- ]?use|gemischt|mixte)\b",
}
BRIEF_GFA_PATTERN = r"(?:GFA|BVO|BGF|gross\s*floor\s*area|bruto\s*vloer(?:opp(?:ervlak)?)?)\s*[:=]?\s*([\d.,]+)\s*(?:m[²2]|sqm)?"
BRIEF_HEIGHT_PATTERN = r"(?:max(?:imale?)?[ s._-]*)?(?:nok|goot|bouw)?hoogte[\s:=]*(\d+[.,]?\d*)\s*(?:m(?:eter)?)?"
BRIEF_FLOOR_PATTERN = r"(\d+)\s*(?:verdieping(?:en)?|bouwla(?:ag|gen)|floors?|stories?|storeys?|Geschosse?|étages?)"
UNIT_PATTERNS = {
    "millimeters": r"\b(?:millimeter|mm)\b", "feet": r"\b(?:feet|ft|foot)\b", "centimeters": r"\b(?:centimeter|cm)\b",
    "inches": r"\b(?:inches?|in)\b",
}
SCALE_PATTERN = r"1\s*:\s*(\d+)"
CRS_PATTERN = r"\b(?:RD|EPSG|WGS|UTM|Amersfoort)\b"
SCALE_RANGE, DEFAULT_SCALE, MM_PER_POINT = (50, 10000), 500, 25.4 / 72.0
REGION_KEYWORDS = {
    "nl": ["bestemmingsplan", "bebouwingspercentage", "goothoogte", "nokhoogte", "rooilijn", "bouwvlak", "kavel", "grens", "woning", "perceel"],
    "de": ["bebauungsplan", "grundflächenzahl", "geschossflächenzahl", "firsthöhe", "traufhöhe", "baugrenze", "abstand"],
    "fr": ["plu", "urbanisme", "hauteur", "recul", "emprise", "cos"],
    "uk": ["planning permission", "storey", "setback", "building line"],
}
ESSENTIAL_CATEGORIES = ["height", "setback", "density", "parking"]
# ------------------------------------------------------------------------------------------------------


def java(pattern: str) -> str:
    """A pattern for Spark: no case, Unicode letters included."""
    return f"(?iu){pattern}"


def number_plain(c: Column) -> Column:
    """A comma is a decimal point; anything else that is no number is null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def number_grouped(c: Column) -> Column:
    """With both signs the dot groups and the comma is decimal; a lone comma groups before three digits."""
    c = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    comma, dot = F.contains(c, F.lit(",")), F.contains(c, F.lit("."))
    last = F.element_at(F.split(c, ","), -1)
    plain = (
        F.when(comma & dot, F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(comma & (F.length(last) == 3), F.replace(c, F.lit(","), F.lit("")))
        .otherwise(F.replace(c, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


def matches(text: Column, patterns: dict[str, list[str]]) -> Column:
    """array<struct<category, pattern, pos, quote, num>> of all matches of all patterns."""

    def one(category: str, k: int, p: str) -> Column:
        # the number is taken from the short match, so each pattern reads the text once
        return F.transform(
            F.regexp_extract_all(text, F.lit(java(p)), F.lit(0)),
            lambda q, i: F.struct(
                F.lit(category).alias("category"), F.lit(k).alias("pattern"), i.alias("pos"), q.alias("quote"),
                F.regexp_extract(q, java(p), 1).alias("num"),
            ),
        )

    return F.concat(*(one(c, k, p) for c, ps in patterns.items() for k, p in enumerate(ps)))


def constraint_name(category: Column, quote: Column) -> Column:
    low = F.lower(quote)
    out = F.lit(None).cast("string")
    for cat, rules in CONSTRAINT_NAMES.items():
        name = F.lit(rules[-1][1])
        for words, title in reversed(rules[:-1]):
            name = F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), title).otherwise(name)
        out = F.when(category == cat, name).otherwise(out)
    return out


def extract_constraints(blocks: DataFrame, keys: list[str], categories: list[str] | None = None) -> DataFrame:
    """Constraints of each key (a site, a file): the first match of each (category, value); with ``categories`` only the
    patterns of these are tried.

    ``blocks`` has the keys, ``seq`` (order) and ``text``.  Percentages of building coverage become ratios
    before duplicates are removed."""
    patterns = {c: p for c, p in CONSTRAINT_PATTERNS.items() if categories is None or c in categories}
    found = blocks.select(
        *keys, "seq", F.explode(matches(F.col("text"), patterns)).alias("m")
    ).select(*keys, "seq", "m.*", number_plain(F.col("m.num")).alias("value"))
    cover = (F.col("category") == "density") & F.lower("quote").rlike("grz|bebouwing")
    found = found.withColumn("value", F.when(cover & (F.col("value") > 1), F.col("value") / 100).otherwise(F.col("value")))
    fits = F.col("category") == "density"
    for cat, (low, high) in CONSTRAINT_RANGES.items():
        fits = fits | ((F.col("category") == cat) & F.col("value").between(low, high))
    rank = F.expr("case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(CONSTRAINT_PATTERNS)) + " end")
    first = (
        found.filter(F.col("value").isNotNull() & fits)
        .groupBy(*keys, "category", "value")
        .agg(F.min(F.struct("seq", rank.alias("rank"), "pattern", "pos", "quote")).alias("f"))
    )
    unit = F.lit(None).cast("string")
    for cat, u in CONSTRAINT_UNITS.items():
        unit = F.when(F.col("category") == cat, u).otherwise(unit)
    name = constraint_name(F.col("category"), F.col("f.quote"))
    return first.select(
        *keys,
        "category",
        name.alias("name"),
        "value",
        F.when(name == "Build Percentage", "%").when(F.col("category") == "density", "ratio").otherwise(unit).alias("unit"),
        F.substring(F.trim("f.quote"), 1, 200).alias("raw_quote"),
        F.lit("extracted").alias("source"),
        F.lit(0.85).alias("confidence"),
        F.col("f.seq").alias("seq"),
    )


def joined_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The texts of each key in order of ``seq``, joined by blanks."""
    return blocks.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " "
        ).alias("text")
    )


def extract_programme(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Programme values of joined texts: arrays in order of pattern and place, first use, flags."""
    m = matches(F.col("text"), PROGRAMME_PATTERNS)
    low_high = {"gfa": (10, 1_000_000, False), "floors": (1, 100, True), "parking_ratio": (0.1, 10, True), "floor_height": (2, 8, True)}

    def values(cat: str) -> Column:
        low, high, closed = low_high[cat]
        nums = F.transform(F.filter("m", lambda x: x["category"] == cat), lambda x: number_grouped(x["num"]))
        return F.filter(nums, lambda v: (v >= low) & (v <= high) if closed else (v > low) & (v < high))

    use = F.create_map(*(F.lit(x) for kv in USE_MAP.items() for x in kv))
    uses = F.array_distinct(
        F.transform(
            F.regexp_extract_all(F.col("text"), F.lit(java(USE_PATTERN)), F.lit(1)),
            lambda u: F.coalesce(F.try_element_at(use, F.lower(u)), F.lower(u)),
        )
    )
    return texts.select(*keys, "text", m.alias("m")).select(
        *keys,
        values("gfa").alias("gfa_values"),
        F.transform(values("floors"), lambda v: v.cast("int")).alias("floor_counts"),
        uses.alias("uses"),
        values("parking_ratio").alias("parking_ratios"),
        values("floor_height").alias("floor_heights"),
        F.col("text").rlike(java(PLINTH_PATTERN)).alias("has_plinth"),
        F.col("text").rlike(java(UNDERGROUND_PATTERN)).alias("has_underground_parking"),
    )


def extract_brief(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts (first match only, null out of range), typologies in list order, and value lists."""

    def first(pattern: str, low: int, high: int) -> Column:
        v = F.regexp_extract("text", java(pattern), 1).try_cast("int")
        return F.when(v.between(low, high), v)

    def values(pattern: str, low: float, high: float, closed: bool) -> Column:
        nums = F.transform(F.regexp_extract_all(F.col("text"), F.lit(java(pattern)), F.lit(1)), lambda v: F.round(number_plain(v), 1))
        return F.filter(nums, lambda v: (v >= low) & (v <= high) if closed else (v > low) & (v < high))

    typologies = F.filter(
        F.array(*(F.when(F.col("text").rlike(java(p)), t) for t, p in TYPOLOGY_PATTERNS.items())), lambda t: t.isNotNull()
    )
    return texts.select(
        *keys,
        first(ZONE_COUNT_PATTERN, 1, 50).alias("expected_zone_count"),
        first(BUILDING_COUNT_PATTERN, 1, 500).alias("expected_building_count"),
        typologies.alias("typologies"),
        F.coalesce(F.get(typologies, 0), F.lit("apartment_block")).alias("dominant_typology"),
        values(BRIEF_GFA_PATTERN, 50, 5_000_000, False).alias("gfa_values"),
        values(BRIEF_HEIGHT_PATTERN, 1, 300, False).alias("height_values"),
        F.transform(values(BRIEF_FLOOR_PATTERN, 1, 100, True), lambda v: v.cast("int")).alias("floor_counts"),
    )


def detect_units(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Unit word, drawing scale (first ``1:N``, 500 out of range), metres a point, reference system."""
    low = F.lower("text")
    unit = F.lit("meters")
    for name, p in reversed(UNIT_PATTERNS.items()):
        unit = F.when(low.rlike(p), name).otherwise(unit)
    n = F.regexp_extract(low, SCALE_PATTERN, 1).try_cast("int")
    scale = F.when(n.between(*SCALE_RANGE), n).otherwise(DEFAULT_SCALE)
    return texts.select(
        *keys,
        unit.alias("unit"),
        scale.alias("drawing_scale"),
        F.round(F.lit(MM_PER_POINT) * scale / 1000.0, 6).alias("meters_per_point"),
        F.when(F.col("text").rlike(java(CRS_PATTERN)), "Projected").otherwise("Local").alias("crs"),
    )


def detect_region(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The region whose keywords are most present (two at least, else eu); ties go to the first listed."""
    low = F.lower("text")
    scored = [
        F.struct(
            reduce(lambda a, b: a + b, (F.contains(low, F.lit(w)).cast("int") for w in words)).alias("n"),
            F.lit(-i).alias("order"),
            F.lit(region).alias("region"),
        )
        for i, (region, words) in enumerate(REGION_KEYWORDS.items())
    ]
    best = F.array_max(F.array(*scored))
    return texts.select(*keys, F.when(best["n"] >= 2, best["region"]).otherwise("eu").alias("region"), best["n"].alias("hits"))
