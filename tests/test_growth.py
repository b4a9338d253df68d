"""Findings of FINDINGS_r04: kernels over many rings at once against the sweep; plans that don't lean on guessed sizes."""

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kadastra.functions import geometry, overlay
from kadastra.operators import spatial


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def calls(df) -> int:
    """How often the plan calls Python."""
    return len(re.findall(r"(?:Arrow|Batch)EvalPython \[", plan(df)))


def some_rings(r, n):
    out = []
    for k in range(n):
        turns = sorted(r.random() * 2 * math.pi for _ in range(r.choice([3, 5, 9, 40])))
        star = [[10 + 8 * (0.3 + r.random() * 0.7) * f(t) for f in (math.cos, math.sin)] for t in turns]
        lattice = [[float(r.randint(0, 8)), float(r.randint(0, 8))] for _ in range(r.randint(1, 7))]  # repeats, crossings, no area
        x, y, w, h = (float(r.randint(1, 9)) for _ in range(4))
        ell = [[x, y], [x + 2 * w, y], [x + 2 * w, y + h], [x + w, y + h], [x + w, y + 2 * h], [x, y + 2 * h]]
        ring = (star, lattice, ell)[k % 3]
        out.append((ring if k % 5 else [*ring, ring[0]])[:: -1 if k % 7 == 0 else 1])
    return out


def rings(lists):
    return overlay.Rings.of(pa.array(lists, pa.list_(pa.list_(pa.float64()))))


def table(spark, rows):
    d = spark.createDataFrame(rows, "site int, id long, ring array<array<double>>")
    b = geometry.bbox(F.col("ring"))
    return d.withColumns({c: b[c] for c in spatial.BOX})


def test_common_areas_equal_the_sweep():
    r = random.Random(31)
    a, b = some_rings(r, 240), some_rings(r, 240)[::-1]
    a[5], b[6], b[7] = None, [], a[7]
    got = overlay.common_areas(rings(a), rings(b))
    for p, q, g in zip(a, b, got, strict=True):
        assert g == pytest.approx(sum(x.area for x in overlay.intersection(overlay.open_ring(p), overlay.open_ring(q))), abs=1e-7)


def test_conflicts_call_the_overlay_once(spark):
    """what is asked of the area common to a pair does not compute it again."""
    box = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]
    bow = [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0]]  # no area by its sum
    d = table(spark, [(1, 1, box(0.0, 0.0, 10.0)), (1, 2, box(1.0, 1.0, 4.0)), (1, 3, box(9.0, 5.0, 5.0)), (1, 4, bow), (1, 5, box(10.0, 0.0, 2.0)), (1, 6, None)])
    got = spatial.conflicts(d, ["site"], 8.0)
    assert calls(got) == 1
    assert sorted((r.kind, r.first_id, r.second_id, r.ratio_1) for r in got.collect()) == [("containment", 1, 2, 1.0), ("intersection", 1, 3, 0.05)]


def test_containers_call_the_overlay_once(spark):
    """the share that decides does not compute the area common to a pair again."""
    box = lambda x, y, w: [[x, y], [x + w, y], [x + w, y + w], [x, y + w]]
    d = table(spark, [(1, 1, box(0.0, 0.0, 10.0)), (1, 2, box(1.0, 1.0, 4.0)), (1, 3, box(8.5, 5.0, 2.0)), (1, 4, [[10.0, 0.0], [10.0, 10.0], [0.0, 10.0]])])
    got = spatial.containers(d, ["site"], 8.0)
    assert calls(got) == 1
    assert [(r.id, r.n_inner, r.inner_area, r.outer_area) for r in got.collect()] == [(1, 2, 66.0, 100.0)]


def test_fill_parents_as_given(spark):
    """the deciding zone is told by the fills as given, also where that zone becomes a building itself."""
    fill = [1.0, 0.7, 0.5]
    rows = [(1, i, "filled_zone", True, fill, 1e4, *b) for i, b in ((1, (0.0, 0.0, 40.0, 40.0)), (2, (31.6, 0.0, 41.6, 10.0)), (3, (38.5, 2.0, 42.0, 6.0)))]
    d = spark.createDataFrame(rows, "site int, id long, zone_type string, closed boolean, fill array<double>, plot_area double, x0 double, y0 double, x1 double, y1 double")
    assert {r.id: r.parent for r in spatial.fill_parents(d, ["site"], 16.0).collect()} == {2: 1, 3: 2}
    assert {r.id: r.parent for r in spatial.inherited_fill(d, ["site"], 16.0).collect()} == {2: 1}


def test_offsets_equal_the_sweep():
    """rings that keep all their sides are moved as arrays, others by the sweep; spikes don't stop it."""
    r = random.Random(8)
    lists = [*some_rings(r, 300), [[1.0, 0.0], [1.0, 5.0], [1.0, 2.0]], None]
    d = [r.choice([0.1, 0.5, 1.0, 2**0.5, -0.5, 0.0]) for _ in lists]
    got = overlay.offsets(rings(lists), d, [False] * len(lists))
    for ring, x, parts in zip(lists, d, got, strict=True):
        want = overlay.offset(ring, x)
        assert [p.area for p in parts] == pytest.approx([p.area for p in want], abs=1e-6)
        assert all(overlay.ring_area(p.outer) > 0 for p in parts)
    ell = [[0.0, 0.0], [0.0, 20.0], [6.0, 20.0], [6.0, 6.0], [20.0, 6.0], [20.0, 0.0], [0.0, 0.0]]
    (one,), none, (box,) = overlay.offsets(rings([ell, ell, ell[:1] + ell[4:6]]), [1.0, None, 0.0], [False, False, True])
    assert one.outer == [(1, 1), (19, 1), (19, 5), (5, 5), (5, 19), (1, 19)] and none == [] and box.area == 60


def test_offset_columns(spark):
    d = table(spark, [(1, 1, [[0.0, 0.0], [9.0, 0.0], [9.0, 6.0], [0.0, 6.0]]), (1, 2, None), (1, 3, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])])
    got = {r.id: r.m for r in d.withColumn("m", overlay.moved_inwards("ring", F.lit(1.0), F.lit("mitre"))).collect()}
    assert (got[1].points, got[1].holes, got[1].area, got[1].parts) == ([[1, 1], [8, 1], [8, 5], [1, 5]], [], 28.0, 1)
    assert tuple(got[2]) == tuple(got[3]) == (None,) * 4


def test_joins_of_faces_are_shuffled(spark):
    """no side that grows with the segments goes to the driver; half-edges are told by number."""
    from kadastra.operators import graph

    rows = [(k, 10.0 * x, 10.0 * y, 10.0 * x + 10 * dx, 10.0 * y + 10 * dy) for k in range(2) for x in range(3) for y in range(3) for dx, dy in ((1, 0), (0, 1))]
    e = graph.half_edges(spark.createDataFrame(rows, "site int, x0 double, y0 double, x1 double, y1 double"), ["site"], 2.0)
    n = graph.next_edges(e, ["site"])
    c = graph.cycles(n, ["site"])
    assert "Broadcast" not in plan(n) + plan(c) and dict(c.dtypes)["first"] == "bigint"
    assert c.count() == e.count() and c.filter("steps = 0").count() == c.select("first").distinct().count() == 10  # four cells and the outer side of each


def test_joins_of_clusters_are_shuffled(spark, sf):
    """nothing that grows with the shapes goes to the driver."""
    from kadastra.operators import ordered

    d = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 100.0 - k) for k in range(30)], "site int, id long, cx double, cy double, area double")
    got = ordered.cluster(d, ["site"], 16.0, 25.0)
    assert "Broadcast" not in plan(got) and got.count() == 30
    edges = d.select("site", F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert "Broadcast" not in plan(ordered.gone(edges.limit(2), ["site"]))


@pytest.mark.parametrize("name", ["gap_parts", "ring_fill", "ring_container", "ring_overlap"])
def test_rings_are_not_broadcast(spark, sf, name):
    """A table's file is no measure of the rings made of it."""
    from kadastra.plans.queries import QUERIES

    assert "Broadcast" not in plan(QUERIES[name](spark, sf))


def test_points_are_made_behind_the_shuffle(spark):
    """items are shuffled as they are, and curves are sums written out, not lambdas gone through point by point."""
    from kadastra.operators import drawings

    d = spark.createDataFrame([(0, 1, 1, "c", [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0]), (0, 1, 2, "re", [0.2, 1.3, 2.0, 3.0]), (0, 1, 3, "l", [0.2, 1.3, 5.0, 5.0])], "page int, path int, seq int, kind string, at array<double>")
    got = drawings.reconstruct_paths(d, ["page"])
    assert "array(" not in plan(got).split("Window [")[-1]
    points = got.first().points
    assert len(points) == 11 + 5 + 1 and points[5] == pytest.approx([0.75, 0.5]) and points[-2:] == [[0.2, 1.3], [5.0, 5.0]]
    p = [F.array(F.lit(float(k)), F.lit(1.0)) for k in range(4)]
    assert "transform" not in plan(d.select(geometry.bezier3(*p), geometry.bezier2(*p[:3])))
