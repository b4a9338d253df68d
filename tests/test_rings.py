"""Overlay, repair, offsets and layouts against brute force; containment on rings in the page operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadastra.functions import geometry, overlay
from kadastra.operators import drawings, pages, spatial, volumes

G = np.linspace(-0.05, 20.05, 603)
X, Y = np.meshgrid(G + 0.00137, G + 0.00211)
CELL = (G[1] - G[0]) ** 2
ELL = [(0.0, 0.0), (20.0, 0.0), (20.0, 6.0), (6.0, 6.0), (6.0, 20.0), (0.0, 20.0)]
YOU = [(0.0, 0.0), (18.0, 0.0), (18.0, 15.0), (12.0, 15.0), (12.0, 5.0), (6.0, 5.0), (6.0, 15.0), (0.0, 15.0)]


def inside(ring):
    c = np.zeros(X.shape, bool)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay != by:
            c ^= ((ay > Y) != (by > Y)) & (X < (bx - ax) * (Y - ay) / (by - ay) + ax)
    return c


def mask(parts):
    out = np.zeros(X.shape, bool)
    for p in parts:
        k = inside(p.outer)
        for h in p.holes:
            k &= ~inside(h)
        out |= k
    return out


def around(r, n, size):
    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    return [(10 + size * (0.3 + r.random() * 0.7) * math.cos(t), 10 + size * (0.3 + r.random() * 0.7) * math.sin(t)) for t in turns]


def test_overlay_against_a_grid():
    r = random.Random(7)
    makers = [lambda: around(r, r.randint(3, 12), 8), lambda: [(r.random() * 20, r.random() * 20) for _ in range(r.randint(3, 8))], lambda: [(float(r.randint(0, 8)), float(r.randint(0, 8))) for _ in range(r.randint(3, 7))]]
    for _ in range(40):
        rings = [overlay.open_ring(r.choice(makers)()) for _ in range(r.randint(2, 5))]
        held = [inside(x) if len(x) > 2 else np.zeros(X.shape, bool) for x in rings]
        for parts, want in (
            (overlay.union(rings), np.logical_or.reduce(held)), (overlay.intersection(*rings[:2]), held[0] & held[1]),
            (overlay.difference(rings[0], rings[1:]), held[0] & ~np.logical_or.reduce(held[1:])),
        ):
            assert (mask(parts) != want).sum() * CELL < 0.3
            for p in parts:
                assert overlay.ring_area(p.outer) + sum(map(overlay.ring_area, p.holes)) == pytest.approx(p.area, abs=1e-6)


def test_parts_and_holes():
    frame, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0)]
    (one,) = overlay.difference(frame, [hole])
    assert one.area == 96 and len(one.holes) == 1 and overlay.ring_area(one.holes[0]) == -4
    two = overlay.difference(frame, [[(4.0, -1.0), (6.0, -1.0), (6.0, 11.0), (4.0, 11.0)]])
    assert [p.area for p in two] == [40, 40]
    touching = overlay.union([hole, [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]])
    assert [p.area for p in touching] == [4, 4]  # a corner joins nothing
    assert overlay.union([]) == [] and overlay.union([[], [(1.0, 1.0)], [(0.0, 0.0), (1.0, 1.0)]]) == [] and overlay.difference(frame, [frame]) == []


def test_repair():
    assert overlay.repair([(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 3.0)]).area == pytest.approx(32 / 7)
    spike = overlay.repair([(0.0, 0.0), (4.0, 0.0), (9.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])
    assert spike.area == 16 and len(spike.outer) == 4
    assert overlay.repair([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) is None and overlay.repair([]) is None
    assert overlay.is_simple(ELL) and overlay.is_simple(YOU[::-1]) and not overlay.is_simple([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)])
    assert not overlay.is_simple([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 0.0), (0.0, 4.0)])  # a corner on a side


def test_offsets_against_sampled_distances():
    r = random.Random(5)
    for ring in (ELL, YOU, *(around(r, r.randint(5, 11), 9) for _ in range(6))):
        if not overlay.is_simple(ring):
            continue
        far = np.full(X.shape, 1e9)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            t = np.clip(((X - ax) * (bx - ax) + (Y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
            far = np.minimum(far, np.hypot(X - ax - t * (bx - ax), Y - ay - t * (by - ay)))
        for d in (0.5, 1.0, 2.5, 3.2):
            want = (far > d) & inside(ring)
            got = overlay.offset(ring, d, True, quarter=32)
            assert abs(sum(p.area for p in got) - want.sum() * CELL) < 0.35 and (mask(got) != want).sum() * CELL < 0.35
            mitred = overlay.offset(ring, d)
            assert sum(p.area for p in mitred) <= sum(p.area for p in got) + 1e-6  # a mitre reaches past the arc
    assert [p.area for p in overlay.offset(YOU, 2.5)] == [10.0, 10.0] and overlay.offset(ELL, 3.0) == [] and overlay.offset(ELL, 50.0) == []
    assert overlay.offset(ELL, 1.0)[0].outer == [(1, 1), (19, 1), (19, 5), (5, 5), (5, 19), (1, 19)]


def test_layouts():
    field = [(0.0, 0.0), (100.0, 0.0), (100.0, 40.0), (0.0, 40.0)]
    rows = volumes.laid_out(field, 3.0, 3, 6.0, 12.0, 20.0)
    assert [round(p.area, 3) for p in rows] == [240, 240, 240]
    assert {round(y, 3) for p in rows for _, y in p.outer} == {14, 26} and round(min(x for x, _ in rows[0].outer), 3) == 14
    turned = volumes.laid_out([(x * 0.6 - y * 0.8, x * 0.8 + y * 0.6) for x, y in field], 3.0, 3, 6.0, 12.0, 20.0)
    assert [round(p.area, 3) for p in turned] == [240, 240, 240]
    tight = volumes.laid_out(field, 3.0, 4, 6.0, 12.0, 50.0)  # closer, then shorter
    assert len(tight) == 4 and all(p.area == pytest.approx(12 * (94 - 6) / 4) for p in tight)
    wide = volumes.laid_out([(0.0, 0.0), (30.0, 0.0), (30.0, 9.0), (0.0, 9.0)], 0.0, 1, 6.0, 12.0, 20.0)
    assert wide[0].area == pytest.approx(20 * 8)
    assert volumes.laid_out([(0.0, 0.0), (6.0, 0.0), (6.2, 5.0), (6.0, 10.0), (6.2, 15.0), (6.0, 20.0), (0.0, 20.0), (-0.2, 15.0), (0.0, 10.0), (-0.2, 5.0)], 0.0, 1, 6.0, 12.0, 20.0) == []


def test_layout_first(spark):
    ring = [[0.0, 0.0], [120.0, 0.0], [120.0, 50.0], [0.0, 50.0]]
    cols = "site int, id long, points array<array<double>>, setback double, max_height_m double, site_height double, target_gfa_m2 double, site_gfa double, fsi double, density double, typology string"
    rows = [
        (1, 1, ring, 3.0, 15.0, 15.0, 4000.0, None, None, None, None), (1, 2, ring, None, 9.0, 9.0, None, None, 1.2, None, "retail"), (1, 3, ring, None, 9.0, 9.0, None, None, None, 0.3, "residential"),
        (1, 4, ring, None, 9.0, 9.0, None, None, None, None, None), (1, 5, ring, None, 9.0, 9.0, 1e6, None, None, None, None),
    ]
    t = spark.createDataFrame(rows, cols)
    got = {}
    for r in volumes.lay_out_footprints(t, ["site"]).orderBy("id").collect():
        got.setdefault(r.envelope, []).append(r)
    assert sorted(got) == [1, 2, 3, 5]  # nothing is known of 4; 5 wants more than there is and gets 0.85 of it
    assert len(got[1]) == 2 and sum(r.area for r in got[1]) == pytest.approx(800, abs=1) and {r.method for r in got[1]} == {"CAD_rule_fallback"}
    assert len(got[2]) == 4 and all(r.area == pytest.approx(16 * 22.5, abs=1) or r.area <= 16 * 50 for r in got[2])
    ask = spark.createDataFrame([(1, 4, 2, 8.0, 20.0, 30.0)], "site int, id long, count int, spacing_m double, width_m double, length_m double")
    more = volumes.lay_out_footprints(t, ["site"], ask).filter("envelope = 4").collect()
    assert len(more) == 2 and all(r.area == pytest.approx(14 * 30) and r.method == "CAD_AI_proposal" for r in more)
    scaled = {r.envelope: r for r in volumes.derive_footprints(t, ["site"]).collect()}
    assert [scaled[i].method for i in (1, 2, 3, 4)] == ["gfa_derived", "fsi_derived", "density_derived", "inset_60pct"]
    assert scaled[2].area == pytest.approx(1.2 * 6000 / 3) and scaled[3].area == pytest.approx(1800)


def test_gaps_of_a_concave_plot(spark):
    plot = [list(p) for p in YOU]
    z = [(1, [[0.0, 0.0], [18.0, 0.0], [18.0, 5.0], [0.0, 5.0]]), (1, [[1.0, 8.0], [3.0, 8.0], [3.0, 10.0], [1.0, 10.0]])]

    def table(rows):
        d = spark.createDataFrame(rows, "site int, ring array<array<double>>")
        b = geometry.bbox(F.col("ring"))
        return d.withColumns({c: b[c] for c in spatial.BOX})

    got = spatial.plot_gaps(table([(1, plot), (2, plot)]), table(z), ["site"]).collect()
    assert sorted((r.site, round(r.area, 6), len(r.holes)) for r in got) == [(1, 56.0, 1), (1, 60.0, 0), (2, 210.0, 0)]
    assert spatial.plot_gaps(table([(1, plot)]), table(z).filter("false"), ["site"]).first().area == pytest.approx(210)


def test_points_in_rings_by_force(spark):
    r = random.Random(3)
    rings = [(k % 3, k, [list(p) for p in around(r, r.randint(3, 9), 9)]) for k in range(30)]
    points = [(r.randrange(3), k, r.random() * 20, r.random() * 20) for k in range(400)]
    d = spark.createDataFrame(rings, "site int, id int, ring array<array<double>>")
    b = geometry.bbox(F.col("ring"))
    d = d.withColumns({c: b[c] for c in spatial.BOX})
    got = {(x.id, x.r_id) for x in spatial.points_in_rings(spark.createDataFrame(points, "site int, id int, x double, y double"), d, ["site"], 3.0).select("id", "r_id").collect()}

    def holds(ring, x, y):
        return sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    assert got == {(p, k) for s, p, x, y in points for t, k, ring in rings if s == t and holds(ring, x, y)} and got


def test_pages_decide_on_rings(spark):
    """A shape whose box lies in the plot's box, but that lies in the plot's notch, is outside; rings that are boxes change nothing."""
    ell = [[0.0, 0.0], [100.0, 0.0], [100.0, 30.0], [30.0, 30.0], [30.0, 100.0], [0.0, 100.0]]
    box = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]
    rows = [(1, ell, None), (2, box(5.0, 5.0, 15.0, 15.0), None), (3, box(60.0, 60.0, 90.0, 90.0), None), (4, box(20.0, 40.0, 34.0, 44.0), None)]
    d = spark.createDataFrame([(0, i, r, True, 1.0, 20000.0, [0.0, 1.0, 1.0], None) for i, r, _ in rows], "site int, id long, ring array<array<double>>, closed boolean, width double, page_area double, stroke array<double>, fill array<double>")
    b = geometry.bbox(F.col("ring"))
    d = d.withColumns({**{c: b[c] for c in spatial.BOX}, "area": geometry.area(F.col("ring"))})
    role = lambda t: {r.id: r.role for r in pages.hierarchy(t, ["site"]).collect()}
    assert role(d) == {1: "plot", 2: "zone", 3: "unclassified", 4: "unclassified"}  # 10 of the 14 units across of 4 are inside
    assert role(d.drop("ring")) == {1: "plot", 2: "zone", 3: "zone", 4: "zone"}
    assert {r.id: r.shape for r in spatial.smallest_container(spark.createDataFrame([(0, 1, 70.0, 70.0), (0, 2, 10.0, 10.0), (0, 3, 10.0, 60.0)], "site int, id int, x double, y double"), d.filter("id <> 3"), ["site"], 16.0).collect()} == {2: 2, 3: 1}


def test_demotion_in_order(spark):
    """A zone that has lost its fill no longer passes it on; which goes first decides."""
    plot = (0, "plot_boundary", 0.0, 0.0, 100.0, 100.0)
    # 'mid' lies in 'top' (84 of its 100), 'low' in 'mid' (over 0.8) but not in 'top' (under 0.8)
    top, mid, low = (0.0, 0.0, 40.0, 40.0), (31.6, 0.0, 41.6, 10.0), (37.0, 2.0, 43.0, 6.0)
    low = (38.5, 2.0, 42.0, 6.0)
    cols = "site int, id long, zone_type string, closed boolean, fill array<double>, plot_area double, x0 double, y0 double, x1 double, y1 double"
    fill = [1.0, 0.7, 0.5]

    def hits(order):
        rows = [(1, plot[0], plot[1], True, None, 1e4, *plot[2:])] + [(1, i, "filled_zone", True, fill, 1e4, *b) for i, b in zip(order, (top, mid, low))]
        return {r.id: r.parent for r in spatial.inherited_fill(spark.createDataFrame(rows, cols), ["site"], 16.0).collect()}

    assert hits((1, 2, 3)) == {2: 1}  # mid is a building before low is looked at, so low keeps its fill
    assert hits((1, 3, 2)) == {3: 1, 2: 3}


def test_paths(spark):
    items = [
        (1, 1, "l", [0.0, 0.0, 10.0, 0.0]), (1, 2, "l", [10.4, 0.3, 10.0, 10.0]), (1, 3, "l", [11.0, 10.0, 0.0, 10.0]), (1, 4, "re", [0.0, 0.0, 2.0, 3.0]), (1, 5, "c", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]),
        (2, 1, "qu", [0.0, 0.0, 1.0]), (2, 2, "arc", [1.0, 2.0]), (3, 1, "re", [0.0, 0.0, 2.0, None]), (4, 1, "l", [5.0, 5.0, 5.0, 5.0]), (5, 1, "l", None), (5, 2, "qu", [0.0, 0.0, 5.0, 5.0, 10.0, 0.0]),
    ]
    d = spark.createDataFrame([(0, *r, "s") for r in items], "page int, path int, seq int, kind string, at array<double>, pen string")
    got = {r.path: r for r in drawings.reconstruct_paths(d, ["page"], ["pen"]).collect()}
    assert sorted(got) == [1, 4, 5]
    assert [tuple(p) for p in got[1].points[:10]] == [(0, 0), (10, 0), (10, 10), (11, 10), (0, 10), (0, 0), (2, 0), (2, 3), (0, 3), (0, 0)] and len(got[1].points) == 20
    assert len(got[5].points) == 11 and got[5].y1 == 2.5 and got[1].pen == "s"
    assert drawings.reconstruct_paths(d.filter("false"), ["page"]).count() == 0


def test_faces_equal_the_walk(spark):
    """Pointer doubling finds what walking finds, corner by corner; one page of many cells is shared out."""
    from kadastra.operators import graph, greedy

    r = random.Random(9)
    rows = []
    for k in range(12):
        pts = [(r.randrange(0, 24) * 2.0, r.randrange(0, 24) * 2.0) for _ in range(8)]
        rows += [(k, *a, *b) for a, b in zip(pts, pts[1:])]
    rows += [(50, 10.0 * x, 10.0 * y, 10.0 * x + 10 * dx, 10.0 * y + 10 * dy) for x in range(12) for y in range(12) for dx, dy in ((1, 0), (0, 1))]
    rows += [(60, 0.0, 0.0, 0.4, 0.3), (61, 0.0, 0.0, 10.0, 0.0)]
    d = spark.createDataFrame(rows, "site int, x0 double, y0 double, x1 double, y1 double")
    got = {(x.site, x.area, tuple(map(tuple, x.points))) for x in graph.faces(d, ["site"]).collect()}
    want = {(x.site, x.area, tuple(map(tuple, x.points))) for x in greedy.faces(d, ["site"]).collect()}
    assert got == want and sum(s == 50 for s, _, _ in got) == 121
    assert graph.faces(d.filter("false"), ["site"]).count() == 0


def test_ordered_steps_equal_the_walk(spark):
    """Rounds over many tasks keep what the loop in order keeps; long chains of rows that hang on each other too."""
    from kadastra.operators import greedy, ordered

    r = random.Random(12)
    rows = []
    for k in range(260):
        x, y = r.randrange(60), r.randrange(40)
        rows.append((k % 3, k, float(x), float(y), float(x + r.choice([6, 6, 7, 20])), float(y + r.choice([5, 5, 12])), r.choice([None, 1, 2])))
    rows += [(7, k, 3.0 * k, 0.0, 3.0 * k + 5, 5.0, None) for k in range(40)]  # each lies on the one before it
    rows += [(8, 1, 0.0, 0.0, 0.0, 5.0, 1), (8, 2, 0.0, 0.0, 0.0, 5.0, None)]
    d = spark.createDataFrame(rows, "site int, id long, x0 double, y0 double, x1 double, y1 double, fill long")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    box = d.drop("fill")
    assert same(ordered.skip_overlaps(box, ["site"], 16.0).select("site", "id"), greedy.skip_overlaps(box, ["site"]))
    assert same(ordered.dedup_boxes(d, ["site"], 16.0).select("site", "id", "fill"), greedy.dedup_boxes(d, ["site"]))
    c = box.select("site", "id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    assert same(ordered.cluster(c, ["site"], 16.0, 6.0).select("site", "id", "cluster"), greedy.cluster(c, ["site"], 6.0))
    assert ordered.skip_overlaps(box.filter("false"), ["site"], 16.0).count() == 0
