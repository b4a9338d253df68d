"""Queries on rings of any shape: paths from drawing items, containment, overlaps, gaps, repair, offsets, layouts.

The fixtures are L-shapes (boxes less a notch) on a half-unit grid, turned by 45 degrees (x - y, x + y), so their boxes tell
other answers than their rings, while areas (twice those before the turn) stay sums of boxes that SQL can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, overlay
from ..operators import drawings, pipelines, spatial
from ..operators.steps import dealt
from .fixtures import sql as fx
from .fixtures import view
from .queries import _BPROG, ORACLES, QUERIES, _building_programmes, _constraint_sql, query

S = ["site"]
CELL = 24.0


# --- drawing items ---------------------------------------------------------------------------------------------
def _items(spark, d) -> DataFrame:
    i = view(spark, d, "fx_item")
    at = F.array(*(F.col(c) for c in ("ax", "ay", "bx", "by_", "cx", "cy", "dx", "dy")))
    n = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in drawings.NUMBERS.items()), F.lit(2))
    return i.select("page", "path", "seq", "kind", F.slice(at, F.lit(1), n).alias("at"), "stroke")


def _outline(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", *(F.round(p[i] * 1e5).cast("long").cast("string") for i in (0, 1)))), ",")


_OUT_SQL = "array_to_string(list_transform(points, lambda p: concat_ws(' ', round(p[1] * 1e5)::bigint, round(p[2] * 1e5)::bigint)), ',')"


def _curve(n: int) -> str:
    def axis(c: str) -> str:
        p = [f"{k}{c}{'_' * (k + c == 'by')}" for k in "abcd"[: n + 1]]
        if n == 3:
            return f"(1-t)*(1-t)*(1-t)*{p[0]} + 3*(1-t)*(1-t)*t*{p[1]} + 3*(1-t)*t*t*{p[2]} + t*t*t*{p[3]}"
        return f"(1-t)*(1-t)*{p[0]} + 2*(1-t)*t*{p[1]} + t*t*{p[2]}"

    return f"list_transform(list_transform(range(0, 11), lambda i: i / 10.0::double), lambda t: [{axis('x')}, {axis('y')}])"


@query(f"""with i as ({fx('fx_item')}), p as (select page, path, seq, kind, stroke, case kind when 'l' then [[ax, ay], [bx, by_]] when 'c' then {_curve(3)} when 'qu' then {_curve(2)}
when 're' then [[ax, ay], [bx, ay], [bx, by_], [ax, by_], [ax, ay]] end pts from i where kind in ('l', 'c', 'qu', 're')),
g as (select *, lag(pts[-1]) over (partition by page, path order by seq) b from p),
r as (select page, path, seq, stroke, case when kind <> 're' and abs(b[1] - pts[1][1]) <= 0.5 and abs(b[2] - pts[1][2]) <= 0.5 then pts[2:] else pts end pts from g),
f as (select page, path, flatten(list(pts order by seq)) points, min_by(stroke, seq) stroke from r group by 1, 2)
select page, path, stroke, len(points) n_points, {_OUT_SQL} outline, round((list_max(list_transform(points, lambda p: p[1])) - list_min(list_transform(points, lambda p: p[1]))) * 1e5)::bigint
* round((list_max(list_transform(points, lambda p: p[2])) - list_min(list_transform(points, lambda p: p[2]))) * 1e5)::bigint bbox_area from f where len(points) >= 2""")
def reconstructed_paths(spark, d):
    """Items of a path in order, a new start only where the pen moved, curves in ten steps."""
    p = drawings.reconstruct_paths(_items(spark, d), ["page"], ["stroke"])
    return p.select("page", "path", "stroke", F.size("points").cast("long").alias("n_points"), _outline(F.col("points")).alias("outline"), (F.round((F.col("x1") - F.col("x0")) * 1e5).cast("long") * F.round((F.col("y1") - F.col("y0")) * 1e5).cast("long")).alias("bbox_area"))


# --- rings -----------------------------------------------------------------------------------------------------
def _turned(points: list[tuple[str, str]]) -> Column:
    return F.array(*(F.array(F.expr(f"cast({x} - {y} as double)"), F.expr(f"cast({x} + {y} as double)")) for x, y in points))


_ELL = [("x0", "y0"), ("x1", "y0"), ("x1", "ny"), ("nx", "ny"), ("nx", "y1"), ("x0", "y1")]
_BOX = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]


def _with_ring(df: DataFrame) -> DataFrame:
    ring = F.when(F.col("notch"), _turned(_ELL)).otherwise(_turned(_BOX))
    df = df.withColumn("ring", ring).drop("x0", "y0", "x1", "y1", "nx", "ny", "notch")
    b = geometry.bbox(F.col("ring"))
    return df.withColumns({c: b[c] for c in spatial.BOX})


def _ells(spark, d) -> DataFrame:
    return _with_ring(view(spark, d, "fx_ell"))


def _marks(spark, d) -> DataFrame:
    return view(spark, d, "fx_mark").select("site", "id", "colour", F.expr("x - y").alias("x"), F.expr("x + y").alias("y"))


def _meet(a: str, b: str) -> str:
    """Area common to two boxes given by prefix and corner names."""
    (p, px, py), (q, qx, qy) = ((x[0], *(("nx", "ny") if x[1] == "n" else ("x0", "y0"))) for x in (a, b))
    return f"greatest(least({p}.x1, {q}.x1) - greatest({p}.{px}, {q}.{qx}), 0) * greatest(least({p}.y1, {q}.y1) - greatest({p}.{py}, {q}.{qy}), 0)"


#: Area common to two L-shapes: boxes less notches, by inclusion and exclusion; the turn doubles it.
_COMMON = f"2::double * ({_meet('ab', 'bb')} - case when a.notch then {_meet('an', 'bb')} else 0 end - case when b.notch then {_meet('ab', 'bn')} else 0 end + case when a.notch and b.notch then {_meet('an', 'bn')} else 0 end)"
_AREA = "2::double * ((x1 - x0) * (y1 - y0) - case when notch then (x1 - nx) * (y1 - ny) else 0 end)"
_E = f"e as (select *, {_AREA} ar from ({fx('fx_ell')}))"
_HELD = "x > x0 and x < x1 and y > y0 and y < y1 and not (notch and x > nx and y > ny)"


@query(f"with {_E}, m as ({fx('fx_mark')}), h as (select m.site, m.id, e.id shape, ar, row_number() over (partition by m.site, m.id order by ar, e.id) k from m join e on m.site = e.site and {_HELD}) select site, id, shape, ar area from h where k = 1")
def ring_container(spark, d):
    """J4 on rings: the smallest one around a point."""
    return spatial.smallest_container(_marks(spark, d), _ells(spark, d).select("site", "id", "ring", *spatial.BOX), S, CELL)


@query(f"""with {_E}, m as ({fx('fx_mark')}), h as (select e.site, e.id, m.colour, count(*) n from m join e on m.site = e.site and {_HELD} group by all),
k as (select *, sum(n) over (partition by site, id) hits, row_number() over (partition by site, id order by n desc, colour) r from h) select site, id, colour, hits::bigint hits from k where r = 1 and hits >= 2""")
def ring_fill(spark, d):
    """J2 on rings: the commonest colour of the hatch points inside, by cells that tell inner from border."""
    return spatial.dominant_colour(_marks(spark, d).drop("id"), _ells(spark, d).select("site", "id", "ring", *spatial.BOX), S, CELL)


@query(f"""with {_E}, p as (select a.site, a.id, b.id other, {_COMMON} common, a.ar aa, b.ar ba from e a join e b on a.site = b.site and a.id < b.id), k as (select *, least(aa, ba) lo, greatest(aa, ba) hi,
case when common > 0.7 * least(aa, ba) then 'containment' when common > 0.15 * least(aa, ba) then 'intersection' end kind from p)
select site, kind, case when kind = 'intersection' or aa > ba then id else other end first_id, case when kind = 'intersection' or aa > ba then other else id end second_id,
round(case when kind = 'containment' then common / lo else common / aa end, 3) ratio_1, round(case when kind = 'containment' then lo / hi else common / ba end, 3) ratio_2 from k where kind is not null""")
def ring_conflicts(spark, d):
    """J9 on rings."""
    return spatial.conflicts(_ells(spark, d).select("site", "id", "ring", *spatial.BOX), S, CELL)


@query(f"with {_E} select a.site, a.id, count(*) n_inner, sum(b.ar) inner_area, any_value(a.ar) outer_area from e a join e b on a.site = b.site and a.id <> b.id where {_COMMON} > 0.8 * b.ar group by 1, 2")
def ring_holders(spark, d):
    """J7 on rings: which hold others."""
    return spatial.containers(_ells(spark, d).select("site", "id", "ring", *spatial.BOX), S, CELL)


@query(f"with {_E}, p as (select a.site, a.id, b.id other, {_COMMON} common, a.ar aa, b.ar ba from e a join e b on a.site = b.site and a.id % 2 = 0 and b.id % 2 = 1) select site, id, other, common, round(common / aa, 4) of_left, round(common / ba, 4) of_right from p where common > 0")
def ring_overlap(spark, d):
    """Intersections of every even with every odd ring of a site."""
    e = _ells(spark, d).select("site", "id", "ring", *spatial.BOX)
    o = spatial.ring_overlaps(e.filter("id % 2 = 0"), e.filter("id % 2 = 1"), S, CELL)
    return o.select("site", "id", F.col("r_id").alias("other"), F.round("common", 6).alias("common"), F.round("of_left", 4).alias("of_left"), F.round("of_right", 4).alias("of_right"))


#: Half-unit cells of a site whose middle lies in its plot, and whether a ring lies over them.
_CELLS = f"""plot as ({fx('fx_plot')}), {_E}, c as (select site, i / 2.0 + 0.25 x, j / 2.0 + 0.25 y from (select site, unnest(range(0, 110)) i from plot), unnest(range(0, 90)) u(j)),
inp as (select c.* from c join plot using (site) where {_HELD}), over_ as (select distinct c.site, c.x, c.y from c join e on c.site = e.site and {_HELD})"""


@query(f"with {_CELLS} select site, sum(0.5::double) covered from over_ group by site")
def covered_area(spark, d):
    """Area that a site's rings cover together."""
    e = _ells(spark, d).groupBy("site").agg(F.sort_array(F.collect_list("ring")).alias("rings"))
    return e.select("site", F.round(overlay.covered_area("rings"), 6).alias("covered"))


@query(f"with {_CELLS} select site, sum(case when o.x is null then 0.5::double else 0 end) gap_area from inp left join over_ o using (site, x, y) group by site having gap_area > 0")
def gap_parts(spark, d):
    """What the rings leave of a concave plot; parts by ``plot_gaps``, here their sum."""
    plots = _with_ring(view(spark, d, "fx_plot"))
    g = spatial.plot_gaps(plots, _ells(spark, d), S, 0.0)
    return g.groupBy("site").agg(F.round(F.sum("area"), 6).alias("gap_area"))


@query(f"""with e as ({fx('fx_ell')}), l as (select site, id, x1 - x0 w, y1 - y0 h, case when notch then x1 - nx else 0 end nw, case when notch then y1 - ny else 0 end nh, d from e, (select unnest([0.5, 1.0, 2.0]::double[]) d)),
a as (select *, w - nw - 2 * d va, h - nh - 2 * d ha, w - 2 * d iw, h - 2 * d ih from l)
select site, id, d, round(2 * case when iw <= 0 or ih <= 0 then 0 when nw * nh = 0 then iw * ih when va > 0 and ha > 0 then iw * ih - nw * nh when va > 0 then va * ih when ha > 0 then ha * iw else 0 end, 4) left_area from a
where case when iw <= 0 or ih <= 0 then 0 when nw * nh = 0 then iw * ih when va > 0 and ha > 0 then iw * ih - nw * nh when va > 0 then va * ih when ha > 0 then ha * iw else 0 end > 0""")
def ring_offsets(spark, d):
    """Concave rings moved inwards, mitred."""
    e = _ells(spark, d).select("site", "id", "ring", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("d"))
    m = dealt(e, "site", "id", "d").withColumn("m", overlay.moved_inwards("ring", F.col("d") * F.sqrt(F.lit(2.0)), F.lit("mitre")))
    return m.filter("m.area > 1e-7").select("site", "id", "d", F.round("m.area", 4).alias("left_area"))


@query(f"""with b as ({fx('fx_knot')}) select site, id, case when kind in ('bow', 'flat') then false else kind <> 'spike' and kind <> 'twice' end valid,
round(1::double * case kind when 'bow' then w * h * greatest(s, 1 - s) * greatest(s, 1 - s) / 2 when 'flat' then null else w * h end, 4) area from b""")
def valid_rings(spark, d):
    """Rings that cross themselves keep their largest part; spikes and doubled rings are mended, flat ones have none."""
    b = view(spark, d, "fx_knot")
    p = lambda *xy: F.array(*(F.array(F.expr(f"cast({x} as double)"), F.expr(f"cast({y} as double)")) for x, y in xy))
    box = [("0", "0"), ("w", "0"), ("w", "h"), ("0", "h")]
    ring = (
        F.when(F.col("kind") == "bow", p(("0", "0"), ("w", "h * (1 - s)"), ("w", "0"), ("0", "h * s"))).when(F.col("kind") == "spike", p(*box[:2], ("w * 2", "0"), *box[1:]))
        .when(F.col("kind") == "twice", p(*box[:2], ("w", "h"), ("w", "h / 2"), *box[2:])).when(F.col("kind") == "flat", p(("0", "0"), ("w", "h"), ("0", "0"))).otherwise(p(*box, box[0]))
    )
    r = b.withColumn("ring", ring)
    return r.select("site", "id", overlay.is_valid_ring("ring").alias("valid"), F.round(overlay.repaired("ring")["area"], 4).alias("area"))


# --- constraints from end to end ---------------------------------------------------------------------------------
_ZTYPE = "case when id % 20 = 0 then 'plot_boundary' when id % 10 = 1 then 'no_build_zone' when id % 10 = 7 then 'buildable_envelope' else zone_type end"


def _constraint_zones(spark, d) -> DataFrame:
    p = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    z = view(spark, d, "fx_zone").withColumns({"zone_type": F.expr(_ZTYPE), "points": F.array(*(F.array(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in p)), "confidence": F.lit(0.8)})
    return z.select("site", "id", "zone_type", "label", "closed", F.expr("cast((x1 - x0) * (y1 - y0) as double)").alias("area"), "points", "confidence")


@query(f"""with z as (select site, id, {_ZTYPE} zt, label, x0, y0, x1, y1 from ({fx('fx_zone')}) where closed), c as ({fx('fx_rule')}),
pl as (select site, min_by(struct_pack(x0, y0, x1, y1), id) b from z where zt = 'plot_boundary' group by 1), en as (select site, min_by(struct_pack(x0, y0, x1, y1), id) b from z where zt = 'buildable_envelope' group by 1),
s as (select site, 'setback_line' zone_type, nm || ' (' || v || 'm)' zone_label, (b.x1 - b.x0 - 2 * v) * (b.y1 - b.y0 - 2 * v) area, case when contains(lower(nm), 'front') or contains(lower(nm), 'voor') then '#ef4444'
when contains(lower(nm), 'rear') or contains(lower(nm), 'achter') then '#f97316' when contains(lower(nm), 'side') or contains(lower(nm), 'zij') then '#eab308' else '#ef4444' end color_hint, 'constraint_offset' classification_method, null::double y_top
from c join pl using (site) where category = 'setback' and v > 0 and b.x1 - b.x0 > 2 * v and b.y1 - b.y0 > 2 * v),
h as (select site, max(v) v from c where category = 'height' group by 1)
select site, zone_type, zone_label, round(area, 4) area, color_hint, classification_method, y_top from s
union all select site, 'setback_line', 'Buildable Envelope (bouwvlak)', ((b.x1 - b.x0) * (b.y1 - b.y0))::double, '#ef4444', 'derived_from_buildable_envelope', null from en where site not in (select site from s)
union all select site, 'height_limit', 'Max Height ' || v || 'm', ((x1 - x0) * (y1 - y0))::double, '#f59e0b', 'height_limit_contour', v from z join h using (site) where zt = 'sub_zone'
union all select site, 'setback_line', case when coalesce(label, '') <> '' then 'No-Build Zone (' || label || ')' else 'No-Build Zone' end, ((x1 - x0) * (y1 - y0))::double, '#dc2626', 'no_build_boundary', null from z where zt = 'no_build_zone'""")
def constraint_outlines(spark, d):
    """Setbacks, the envelope where there are none, height limits, and where nobody may build."""
    c = view(spark, d, "fx_rule").withColumnsRenamed({"nm": "name", "v": "value"}).withColumns({"unit": F.lit("m"), "constraint_id": F.col("id").cast("string"), "confidence": F.lit(0.8)})
    g = pipelines.constraint_geometry(c.drop("id"), _constraint_zones(spark, d), S)
    return g.select("site", "zone_type", "zone_label", F.round(geometry.area(F.col("points")), 4).alias("area"), "color_hint", "classification_method", "y_top")


@query(f"""with f as ({_constraint_sql()}), n as (select site, count(*) regex_extracted, list(distinct category) cats from f group by 1), r as ({fx('fx_rule')}), a as (select site, count(*) ai, list(distinct category) acats from r where category <> 'parking' group by 1),
t as (select coalesce(n.site, a.site) site, coalesce(regex_extracted, 0) x, coalesce(ai, 0) y, list_distinct(list_concat(coalesce(cats, []), coalesce(acats, []))) cats from n full join a on n.site = a.site),
u as (select t.site, x, y, case when x + y < 3 and not list_has_all(cats, ['height', 'setback', 'density', 'parking']) then (select count(*) from r where r.site = t.site and category = 'parking') else 0 end w, cats from t)
select site, x + y + w total, x regex_extracted, y ai_extracted, w ai_suggested, array_to_string(list_sort(case when w > 0 then list_distinct(list_append(cats, 'parking')) else cats end), ',') categories from u""")
def constraint_pipeline(spark, d):
    """Texts, a model's rows and suggestions become constraints, counted by where they come from."""
    r = view(spark, d, "fx_rule").withColumnsRenamed({"nm": "name", "v": "value"})
    done = pipelines.extract_constraints(view(spark, d, "fx_text"), _constraint_zones(spark, d), S, None, r.filter("category <> 'parking'").drop("id"), r.filter("category = 'parking'").drop("id"))
    s = done["summary"].filter("total > 0")
    return s.select("site", "total", "regex_extracted", "ai_extracted", "ai_suggested", F.array_join("categories", ",").alias("categories"))


@query(f"""with p as (select site, count(*) n, sum(case when area > 0 then area * n else 0 end) gfa, sum(n) floors, bool_or(coalesce(plinth, false)) plinth from {_BPROG} group by 1),
z as (select site, count(*) zn, bool_or(parking_levels > 0) under from ({ORACLES['zone_programme']}) group by 1)
select coalesce(p.site, z.site) site, coalesce(n, 0) total_buildings, 0::bigint extracted, 0::bigint ai_extracted, 0::bigint ai_suggested, coalesce(n, 0) inferred, coalesce(zn, 0) zone_programmes, coalesce(floors, 0)::bigint total_floors,
round(coalesce(gfa, 0)::double, 1) total_gfa, coalesce(plinth, false) has_plinth, coalesce(under, false) has_underground_parking from p full join z on p.site = z.site""")
def programme_summary(spark, d):
    """Building and zone programmes of a site, counted by where they come from."""
    return pipelines.programme_summary(_building_programmes(spark, d), QUERIES["zone_programme"](spark, d), S)
