import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kadastra.functions import classify, geometry, text
from kadastra.operators import export, greedy, pages, programme, spatial, votes
from kadastra.sources import readers
from kadastra.streaming import progress


def one(spark, expr, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("s", "plain", "grouped"),
    [("13,500", 13.5, 13500.0), ("13.500", 13.5, 13.5), ("1.234,5", None, 1234.5), ("7,5", 7.5, 7.5), ("1.2.3", None, None), ("", None, None)],
)
def test_numbers(spark, s, plain, grouped):
    assert one(spark, text.number_plain(F.col("s")), s=s) == plain
    assert one(spark, text.number_grouped(F.col("s")), s=s) == grouped


@pytest.mark.parametrize(
    ("s", "found"),
    [
        ("max hoogte: 12m", [("height", 12.0)]), ("Max. building height: 30 m", [("height", 30.0)]), ("FIRSTHÖHE: 12,5 m", [("height", 12.5)]),
        ("rooilijn: 5m", [("setback", 5.0)]), ("bebouwingspercentage: 60%", [("density", 0.6)]), ("GFZ 1.2", [("density", 1.2)]),
        ("height 0.5 height 200 height 201", [("height", 200.0)]), ("2 parking spaces per unit", [("parking", 2.0)]), ("", []),
        ("hoogte 9 hoogte 9", [("height", 9.0)]),
    ],
)
def test_constraints(spark, s, found):
    df = spark.createDataFrame([(1, 1, s), (1, 2, None)], "site int, seq int, text string")
    got = text.extract_constraints(df, ["site"]).collect()
    assert sorted((r.category, r.value) for r in got) == found


ring = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=3, max_size=9)


@given(ring)
@settings(max_examples=60, deadline=None)
def test_hull_holds_all_points(points):
    h = geometry.hull(points)
    if len(h) > 2:
        for p in points:
            for a, b in zip(h, h[1:] + h[:1], strict=True):
                assert (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0
        assert geometry.ring_area(h) >= abs(geometry.ring_area(points)) / 2 - 1e9
        long, short, _ = geometry.rotated_box(points)
        assert long * short >= geometry.ring_area(h) - 1e-6


@given(st.integers(1, 60), st.integers(1, 60), st.floats(0.1, 40))
@settings(max_examples=50, deadline=None)
def test_inset_of_a_box(w, h, d):
    got = abs(geometry.ring_area(geometry.inset([(0, 0), (w, 0), (w, h), (0, h)], d)))
    assert math.isclose(got, max(0, w - 2 * d) * max(0, h - 2 * d), abs_tol=1e-6)


def test_rings(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0], [4.0, 0.0], [4.0, 3.0]]), (2, []), (3, [[1.0, 1.0], [1.0, 1.0]])], "id int, r array<array<double>>")
    a = {r.id: r for r in df.select("id", geometry.area(F.col("r")).alias("a"), geometry.centroid(F.col("r")).alias("c"), geometry.shape_metrics("r").alias("m")).collect()}
    assert a[1].a == 6 and a[2].a == 0 and a[3].a == 0 and a[3].c == [1.0, 1.0]
    assert a[2].m.min_dim == 10.0 and math.isclose(a[1].m.compactness, 1)
    hexes = spark.range(1).select(geometry.hsl_hex(F.lit(0.0), 1.0).alias("a"), geometry.hsl_hex(F.lit(120.0), 1.0).alias("b")).first()
    assert (hexes.a, hexes.b) == ("#ff0000", "#00ff00")


def test_label(spark):
    assert one(spark, classify.parse_label(F.col("t")), t="GD\n(sgd-2)\n[sba-x1]\n12,5\n(m)") == "Gemengd (Mixed-Use) | sgd-2 · sba-x1 · maatschappelijk | h=12,5m"
    assert one(spark, classify.parse_label(F.col("t")), t="x") is None


def test_falsy_priorities(spark):
    b = spark.createDataFrame([(1, 2, 0.0, 0.0, 0, 1000.0, 0, "t"), (2, 0, 1.0, 1.0, 1, 1.0, 1, "t")], "site int, n_zones int, site_gfa double, max_height double, expected_floors int, site_area double, n_buildings int, typology string")
    rows = programme.fallback_rules(b, ["site"]).collect()
    assert [(r.max_height_m, r.target_gfa_m2, r.expected_buildings) for r in rows] == [(15.0, 1000.0, 1)] * 2


def test_merge_brief(spark):
    r = spark.createDataFrame([(1, 3, None, [100.0, 900.0], [], [4], "tower")], "site int, expected_zone_count int, expected_building_count int, gfa_values array<double>, height_values array<double>, floor_counts array<int>, dominant_typology string")
    g = spark.createDataFrame([(1, 7, 5)], "site int, n_large_filled int, n_candidates int")
    m = spark.createDataFrame([(1, 0, 9, 0.0, 30.0, "")], "site int, n_zones int, n_buildings int, site_gfa double, max_height double, typology string")
    x = programme.merge_brief(r, g, ["site"]).first()
    assert (x.n_zones, x.n_buildings, x.site_gfa, x.max_height, x.typology) == (3, 5, 900.0, None, "tower")
    x = programme.merge_brief(r, g, ["site"], m).first()
    assert (x.n_zones, x.n_buildings, x.site_gfa, x.max_height, x.typology) == (3, 9, 900.0, 30.0, "tower")


def test_model_rows_of_programmes(spark):
    b = spark.createDataFrame([(1, 1, 100.0), (1, 2, 50.0)], "site int, building_id int, area double")
    s = spark.createDataFrame([(1, None, None, 10.0, None, True, False, None)], "site int, floors int, floor_height double, max_height double, use string, plinth boolean, underground boolean, parking_ratio double")
    m = spark.createDataFrame([(1, 9, 4.0, 77.0)], "building_id int, floors int, floor_height double, gfa double")
    got = {r.building_id: r for r in programme.building_programmes(b, s, ["site"], m).collect()}
    assert (got[1].floors, got[1].gfa, got[1].source) == (2, 77.0, "ai_extracted")
    assert (got[2].floors, got[2].gfa, got[2].uses[0].use) == (3, 150.0, "retail")


def test_allocation_and_caps(spark, sf):
    """Shares of a site add up, and floors never pass the cap when one fits."""
    from kadastra.plans.queries import QUERIES

    shares = QUERIES["gfa_share"](spark, sf).groupBy("site").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-4 for r in shares)
    p = QUERIES["floors_under_cap"](spark, sf).groupBy("building_id").agg(F.max("y_bottom").alias("y")).collect()
    assert all(r.y >= 0 for r in p)


def boxes(spark, rows):
    return spark.createDataFrame([(1, *map(float, r[1:]), r[0]) for r in rows], "site int, x0 double, y0 double, x1 double, y1 double, id long")


def test_box_join_is_exact_whatever_the_cells(spark):
    import random

    r = random.Random(3)
    rows = [(i, x := r.randint(-50, 50), y := r.randint(-50, 50), x + r.randint(0, 40), y + r.randint(0, 40)) for i in range(60)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    for size in (3.0, 16.0, 500.0):
        got = [(x.id, x.r_id) for x in spatial.box_join(boxes(spark, rows), boxes(spark, rows), ["site"], size).collect()]
        assert len(got) == len(want) and set(got) == want


def test_greedy(spark):
    df = boxes(spark, [(1, 0, 0, 100, 100), (2, 1, 0, 101, 100), (3, 500, 0, 510, 10)]).withColumn("fill", F.when(F.col("id") == 2, 7).cast("long"))
    kept = {r.id: r.fill for r in greedy.dedup_boxes(df, ["site"]).collect()}
    assert kept == {1: 7, 3: None}
    again = df.join(spark.createDataFrame([(k,) for k in kept], "id long"), "id")
    assert greedy.dedup_boxes(again.select(*df.columns), ["site"]).count() == 2  # idempotent
    assert {r.id for r in greedy.skip_overlaps(df.drop("fill"), ["site"]).collect()} == {1, 3}
    segs = boxes(spark, [(1, 0, 0, 10, 0), (2, 10, 0, 10, 10), (3, 10, 10, 0, 10), (4, 0, 10, 0, 0), (5, 100, 100, 120, 100)])
    got = sorted((r.n_segments, r.closed) for r in greedy.chain(segs, ["site"]).collect())
    assert got == [(1, False), (4, True)]
    f = greedy.faces(segs, ["site"]).collect()
    assert len(f) == 1 and f[0].area == 100.0
    g = boxes(spark, [(1, 0, 0, 10, 10), (2, 0, 0, 10, 4)]).withColumn("role", F.when(F.col("id") == 1, "plot").otherwise("zone"))
    assert [(r.y0, r.y1) for r in greedy.gaps(g, ["site"]).collect()] == [(4.0, 10.0)]
    c = boxes(spark, [(1, 0, 0, 9, 9), (2, 30, 0, 35, 5), (3, 400, 0, 405, 5)]).selectExpr("site", "id", "x0 cx", "y0 cy", "(x1 - x0) * (y1 - y0) area")
    assert {(r.id, r.cluster) for r in greedy.cluster(c, ["site"]).collect()} == {(1, 0), (2, 0)}
    e = spark.createDataFrame([(1, [[0.0, 0.0], [100.0, 0.0], [100.0, 30.0], [0.0, 30.0]], 840.0, 12.0)], "site int, points array<array<double>>, target double, width double")
    lay = greedy.layout(e, ["site"]).collect()
    assert len(lay) == 2 and all(abs(r.area - 420) < 1e-6 for r in lay)


def test_votes(spark):
    v = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "b"), (2, 0, "x"), (2, 1, "y")], "id int, agent_rank int, zone_type string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {r.id: (r.zone_type, r.confidence, r.agreement) for r in votes.majority(v, ids).collect()}
    assert got == {1: ("b", 0.8, "majority"), 2: ("x", 0.75, "judge_call"), 3: ("unknown", 0.3, None)}


def test_export(spark):
    assert one(spark, export.layer_name(F.col("t")), t="sub_zone") == "02_Buildings-Building_Footprint"
    assert one(spark, export.aci_rgb(F.col("t")), t=30) == [255, 127, 0] and one(spark, export.aci_rgb(F.col("t")), t=99) == [200, 200, 200]


DXF_TEXT = "\n".join(
    "0 SECTION 2 ENTITIES 0 LINE 8 kavel 10 0 20 0 11 5 21 0 0 CIRCLE 8 setback 10 1 20 2 40 3 0 TEXT 8 a 1 max 0 LWPOLYLINE 8 plot 70 1 10 0 20 0 10 4 20 0 10 4 20 4 "
    "0 POLYLINE 8 site 70 0 0 VERTEX 10 1 20 1 0 VERTEX 10 2 20 2 0 SEQEND 0 ENDSEC 0 EOF".split(" ")
)


def test_sources(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(DXF_TEXT)
    (tmp_path / "b.dxf").write_text("0\nSECTION\nx\nENTITIES")
    (tmp_path / "c.PDF").write_text("x")
    spark.dataSource.register(readers.DxfSource)
    rows = spark.read.format("kadastra_dxf").load(str(tmp_path)).collect()
    ok = [r for r in rows if r.error is None]
    assert [r.kind for r in ok] == ["LINE", "CIRCLE", "TEXT", "LWPOLYLINE", "POLYLINE"] and ok[3].closed and len(ok[4].points) == 2
    assert [r.error is not None for r in rows if r.file.endswith("b.dxf")] == [True]
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.dxf")
    shapes = readers.cad_geometry(readers.dxf_rows(files)).collect()
    assert sorted((r.zone_type, len(r.points)) for r in shapes) == [("buildable_envelope", 33), ("plot_boundary", 2), ("plot_boundary", 2), ("plot_boundary", 3)]
    assert {r.kind for r in readers.landed_files(spark, str(tmp_path)).collect()} == {"pdf", "cad"}
    v = one(spark, readers.parse_answer(F.col("t")), t='```json\n{"id": 3, "zone_type": "plinth"}\n```')
    assert v[0].id == 3 and one(spark, readers.parse_answer(F.col("t")), t="no json") is None


def test_streaming_progress_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "value")
    events.write.json(str(tmp_path / "in"))
    q = progress.follow(spark, str(tmp_path / "in"), "event_type string, ts timestamp, value double", ["event_type"], "runs")
    assert q.awaitTermination(120)
    got = {r.event_type: r.n_events for r in spark.table("runs").collect()}
    assert got == {r.event_type: r.n_events for r in progress.progress(events, ["event_type"]).collect()}
    z = spark.createDataFrame([(1, "3", "a"), (1, "3", "a"), (1, "4", "b")], "run int, stage string, zone_type string")
    got = {r.stage: r.line for r in progress.snapshots(z, ["run"]).collect()}
    assert got == {
        "3": '{"run":1,"stage":"3","total":2,"counts":{"a":2}}', "4": '{"run":1,"stage":"4","total":3,"counts":{"a":2,"b":1}}',
        "done": '{"run":1,"stage":"done","total":3,"counts":{"a":2,"b":1}}',
    }


def test_progress_goes_on_from_its_checkpoint(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(f'{{"event_type": "a", "ts": "2024-01-0{k + 1}T00:00:00Z", "value": 1}}\n')
        q = progress.follow(spark, str(tmp_path / "in"), "event_type string, ts timestamp, value double", ["event_type"], "again", str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    assert spark.table("again").first().n_events == 2


def test_dxf_is_read_back(spark, tmp_path):
    """A written drawing has the shapes that went in: outlines, rings, edges, walls and notes."""
    sq = [[0.0, 0.0, 0.0], [4.0, 0.0, 0.0], [4.0, 0.0, 3.0], [0.0, 0.0, 3.0]]
    rows = [(1, 1, "plot_boundary", sq, True, None, None, ["id=1"]), (1, 2, "building_floor", [*sq, sq[0]], True, 0.0, 3.0, ["id=2", "use=retail"]), (1, 3, "context_line", sq[:2], False, None, None, []), (1, 4, "sub_zone", sq[:1], True, None, None, [])]
    o = spark.createDataFrame(rows, "site int, id int, zone_type string, points array<array<double>>, closed boolean, y_bottom double, y_top double, pairs array<string>")
    c = spark.createDataFrame([(1, "Max", 12.0, "m", "height"), (1, None, 3.0, None, "setback"), (2, "x", 1.0, "m", "gfa")], "site int, name string, value double, unit string, category string")
    doc = export.dxf_document(o, ["site"], c)
    export.write_dxf(doc, ["site"], str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out" / "site=1").glob("*.txt"))
    assert text.startswith("0\nSECTION\n2\nHEADER") and text.rstrip().endswith("0\nEOF") and len(text.splitlines()) % 2 == 0
    got = list(readers.dxf_entities(text))
    kinds = [e["kind"] for e in got]
    assert sorted(kinds) == ["LINE"] * 4 + ["POLYLINE"] * 4 + ["TEXT"] * 2 and text.count("3DFACE") == 4
    rings = [e for e in got if e["kind"] == "POLYLINE"]
    assert sorted((e["layer"], e["closed"], len(e["points"])) for e in rings) == [("00_Boundaries-Plot_Boundary", True, 4), ("04_Generated_Volumes-Building_Floor", True, 4), ("04_Generated_Volumes-Building_Floor", True, 4), ("05_Infrastructure-Context_Line", False, 2)]
    assert [e["text"] for e in got if e["kind"] == "TEXT"] == ["Max: 12.0 m [height]", "Constraint: 3.0  [setback]"] and "1000\nuse=retail" in text
    with pytest.raises(ValueError):
        export.write_dxf(export.dxf_document(o.filter("false"), ["site"]), ["site"], str(tmp_path / "none"))


def test_one_plot_boundary_stays(spark):
    rows = [(1, 1, "plot_boundary", 9), (1, 2, "plot_boundary", 6), (1, 3, "plot_boundary", 7), (2, 4, "plot_boundary", 5)]
    z = spark.createDataFrame(rows, "site int, id int, zone_type string, n_points int").selectExpr("*", "null label", "true closed", "9e5 area", "1e6 page_area", "1.0 width", "0 x0", "0 y0", "9 x1", "9 y1")
    assert sorted(r.id for r in pages.keep_zones(z.withColumn("label", F.lit(None).cast("string")), ["site"]).collect()) == [1, 3, 4]


def test_subzones_from_dashes(spark):
    """Thirty dashes around a house become one shape; a page with few dashes gives none."""
    import math

    def dashes(site, x, y, w, h, n, first):
        corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        out = []
        for (ax, ay), (bx, by) in zip(corners, corners[1:]):
            for i in range(n):
                t0, t1 = i / n, (i + 0.8) / n
                out.append((site, "k", first + len(out), ax + (bx - ax) * t0, ay + (by - ay) * t0, ax + (bx - ax) * t1, ay + (by - ay) * t1))
        return out

    seg = spark.createDataFrame(dashes(1, 100, 100, 80, 60, 8, 1) + dashes(1, 900, 900, 20, 20, 8, 100) + dashes(2, 100, 100, 80, 60, 1, 500), "site int, style string, id long, x0 double, y0 double, x1 double, y1 double")
    edge = [(s, s * 10, True, None, [0.0, 0.0, 0.0], 1.0, 360000.0, 1e6, 0.0, 0.0, 600.0, 600.0) for s in (1, 2)]
    b = spark.createDataFrame(edge, "site int, id int, closed boolean, fill array<double>, stroke array<double>, width double, area double, page_area double, x0 double, y0 double, x1 double, y1 double")
    got = pages.adaptive_subzones(seg, b, ["site"], ["style"]).collect()
    assert [(r.site, r.strategy) for r in got] == [(1, "chain_join")] and math.isclose(got[0].area, 4800, rel_tol=0.1)


def test_classes_of_colours_and_ties(spark):
    one_ = lambda e: spark.range(1).select(e.alias("x")).first().x
    lit = lambda *v: [F.lit(x) for x in v]
    c = one_(classify.colour_class(*lit(1.0, 0.75, 0.53), F.lit(True)))
    assert (c.zone_type, c.confidence) == ("buildable_envelope", 1.0)
    none = F.lit(None).cast("double")
    assert one_(classify.colour_class(none, none, none, F.lit(True))).zone_type == "unknown"
    a, b = (F.struct(F.lit(t).alias("zone_type"), F.lit(v).alias("confidence")) for t, v in (("a", 0.5), ("b", 0.5)))
    assert one_(classify.surest(a, b)).zone_type == "a"
    o = one_(classify.open_class(F.lit(None).cast("string"), F.lit(False)))
    assert (o.zone_type, o.method) == ("context_line", "open:unknown")
