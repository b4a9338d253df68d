"""Constraints from end to end on small tables."""

from kadastra.operators import pipelines


def zones(spark):
    box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    rows = [
        (1, 1, "plot_boundary", None, box(0.0, 0.0, 40.0, 30.0)), (1, 2, "buildable_envelope", "Blok Noord", box(5.0, 5.0, 30.0, 20.0)), (1, 3, "sub_zone", "Huis", box(6.0, 6.0, 10.0, 10.0)),
        (1, 4, "restriction_line", "Water", box(30.0, 20.0, 40.0, 30.0)), (2, 5, "buildable_envelope", "Blok A", box(0.0, 0.0, 9.0, 9.0)), (3, 6, "plot_boundary", None, [[0.0, 0.0], [20.0, 0.0], [20.0, 6.0], [6.0, 6.0], [6.0, 20.0], [0.0, 20.0]]),
    ]
    return spark.createDataFrame([(s, i, t, n, True, 1.0, p, 0.7) for s, i, t, n, p in rows], "site int, id long, zone_type string, label string, closed boolean, area double, points array<array<double>>, confidence double")


def test_constraints_end_to_end(spark):
    texts = spark.createDataFrame([(1, 1, "Max hoogte: 12 m. front setback: 3 m"), (1, 2, "Max hoogte: 12 m. front setback: 3 m"), (2, 1, "niets"), (3, 1, "setback: 1 m")], "site int, seq long, text string")
    model = spark.createDataFrame([(1, "height", "Height of blok noord", 9.0, "m", "Blok Noord only", 0.6), (1, "gfa", "GFA", None, "m2", "", None), (1, "density", None, 1.0, "", "", None)], "site int, category string, name string, value double, unit string, applies_to string, confidence double")
    hints = spark.createDataFrame([(1, "parking", "Parking", 1.0), (2, "height", "Usual height", 15.0), (9, "height", "Usual height", 15.0)], "site int, category string, name string, value double")
    rules = spark.createDataFrame([(1, 0, "blok noord", 15.0, 900.0, 3.0, 0.4, "ai_suggested"), (1, 1, "Zuid", 15.0, 900.0, 3.0, 0.4, "ai_suggested")], "site int, zone_index int, zone_label string, max_height_m double, target_gfa_m2 double, setback_m double, density_grz double, source string")
    got = pipelines.extract_constraints(texts, zones(spark), ["site"], rules, model, hints)
    c = {(r.site, r.source, r.category, r.value): r.zone_id for r in got["constraints"].collect()}
    assert c[1, "extracted", "height", 12.0] is None and c[1, "ai_extracted", "height", 9.0] == 2 and c[2, "ai_suggested", "height", 15.0] is None and (9, "ai_suggested", "height", 15.0) in c
    assert not any(s == 1 and x == "ai_suggested" for s, x, *_ in c)  # three are enough
    r = {x.zone_index: (x.max_height_m, x.source) for x in got["zone_rules"].collect()}
    assert r == {0: (9.0, "document"), 1: (15.0, "ai_suggested")}
    g = {(x.site, x.classification_method): x for x in got["constraint_geometry"].collect()}
    assert sorted(map(tuple, g[1, "constraint_offset"].points)) == [(3, 3), (3, 27), (37, 3), (37, 27)] and g[1, "constraint_offset"].zone_label.endswith("(3.0m)")
    assert g[1, "height_limit_contour"].y_top == 12.0 and len(g[1, "height_limit_contour"].corner_posts) == 4 and g[1, "height_limit_contour"].confidence == 0.85
    assert g[1, "no_build_boundary"].zone_label == "No-Build Zone (Water)" and g[2, "derived_from_buildable_envelope"].constraint_value == "derived"
    assert (1, "derived_from_buildable_envelope") not in g and len(g[3, "constraint_offset"].points) == 6  # an L stays an L
    s = {x.site: x for x in got["summary"].collect()}
    assert (s[1].total, s[1].regex_extracted, s[1].ai_extracted, s[1].ai_suggested, s[1].constraint_geometries) == (3, 2, 1, 0, 3) and s[2].categories == ["height"]
    empty = pipelines.extract_constraints(texts.filter("false"), zones(spark).filter("false"), ["site"])
    assert empty["constraints"].count() == empty["constraint_geometry"].count() == empty["summary"].count() == 0 and "zone_rules" not in empty
