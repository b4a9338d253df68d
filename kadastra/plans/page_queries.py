"""Queries of the page, ensemble and volume operators, with SQL that takes the same steps on boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, geometry
from ..operators import ensemble, export, pages, volumes
from ..operators.steps import settled
from ..streaming import progress as stream
from .fixtures import sql as fx
from .fixtures import view
from .queries import CELL, _any_sql, query

S = ["site"]
#: Cells for pages of about a thousand units.
PAGE_CELL = 128.0
_FILLS = {1: (1.0, 0.75, 0.53), 2: (0.16, 0.78, 0.27), 3: (0.5, 0.0, 0.9)}
_STROKES = {1: (0.0, 1.0, 1.0), 2: (1.0, 0.61, 0.0), 3: (0.0, 0.0, 0.0)}


def _colour(key: str, table: dict[int, tuple]):
    out = F.lit(None).cast("array<double>")
    for k, c in table.items():
        out = F.when(F.col(key) == k, F.array(*map(F.lit, c))).otherwise(out)
    return out


def _hex_sql(key: str, table: dict[int, tuple]) -> str:
    return f"case {key} " + " ".join(f"when {k} then '#{''.join(f'{int(v * 255):02x}' for v in c)}'" for k, c in table.items()) + " end"


def _shapes(spark, d):
    s = view(spark, d, "fx_shape").withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    s = s.withColumns({"long": F.greatest("w", "h"), "short": F.least("w", "h"), "area": (F.col("w") * F.col("h")).cast("double")})
    return s.withColumns(
        {
            "fill": _colour("fk", _FILLS), "stroke": _colour("sk", _STROKES), "page_area": F.lit(1e6), "aspect_ratio": F.col("long") / F.col("short"), "compactness": F.lit(1.0),
            "circularity": F.pi() * F.col("area") / ((F.col("w") + F.col("h")) * (F.col("w") + F.col("h"))), "elongation": 1 - F.col("short") / F.col("long"), "min_dim": F.col("short").cast("double"),
            "width": F.col("width").cast("double"),
        }
    ).drop("w", "h", "long", "short")


def _texts(spark, d):
    t = view(spark, d, "fx_ptext")
    return t.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})


_COMMON = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_CHAIN: list[tuple[str, str]] = []


def _chain(upto: str) -> str:
    parts = []
    for name, text in _CHAIN:
        parts.append(f"{name} as ({text})")
        if name == upto:
            break
    return "with " + ",\n".join(parts) + "\n"


_CHAIN += [
    ("s", f"select *, cast((x1 - x0) * (y1 - y0) as double) ar, greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) asp, least(x1 - x0, y1 - y0) mind, pi() * (x1 - x0) * (y1 - y0) / ((x1 - x0 + y1 - y0) * (x1 - x0 + y1 - y0)) circ from ({fx('fx_shape')})"),
    ("pl", "select site, id plot_id, ar plot_ar, x0 px0, y0 py0, x1 px1, y1 py1 from (select *, row_number() over (partition by site order by (fk is null and ar > 50000 and width >= 0.5) desc, ar desc, id) k from s where closed) where k = 1"),
    ("ins", """select s.*, plot_id, coalesce(plot_ar, 1e6) plot_ar, asp > 10 or 1 - 1 / asp > 0.92 or mind < 1.5 art, asp < 6 and 1 - 1 / asp < 0.85 and circ > 0.08 and mind > 2 bld,
coalesce((x0 >= px0 and x1 <= px1 and y0 >= py0 and y1 <= py1) or greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) > ar * 0.8, false) ins,
case fk when 1 then 'buildable_envelope' when 2 then 'landscape_zone' end ft, case sk when 1 then 'parcel_line' when 2 then 'zone_boundary' end st, case sk when 1 then 'cyan_stroke' when 2 then 'orange_stroke' end sn from s left join pl using (site)"""),
    ("u", """select *, case when art then {'t': 'minor_context', 'c': 0.2::double, 'm': 'artifact_shape'} when st is not null then {'t': st, 'c': 0.8::double, 'm': 'stroke:' || sn}
when ins and bld and strategy <> 'direct' then {'t': 'sub_zone', 'c': 0.8::double, 'm': 'building_shape+' || strategy} when ins and bld and ar > plot_ar * 0.1 then {'t': 'uncategorized_zone', 'c': 0.7::double, 'm': 'large_unfilled_inside_plot'}
when ins and bld then {'t': 'sub_zone', 'c': 0.75::double, 'm': 'building_shape'} when width >= 1 then {'t': 'major_boundary', 'c': 0.75::double, 'm': 'thick_stroke'} when ins and width >= 0.5 then {'t': 'major_boundary', 'c': 0.6::double, 'm': 'medium_stroke'}
when ins and ar > plot_ar * 0.01 then {'t': 'uncategorized_zone', 'c': 0.55::double, 'm': 'thin_stroke_significant_area'} else {'t': 'minor_context', 'c': 0.4::double, 'm': 'thin_stroke'} end u from ins"""),
    ("r", """select *, case when not closed then {'t': coalesce(st, 'context_line'), 'c': 0.5::double, 'm': 'open:' || case when sk is null then 'none' else coalesce(sn, 'unknown') end} when id = plot_id then {'t': 'plot_boundary', 'c': 0.95::double, 'm': 'area_rank'}
when fk is not null and ft is not null then {'t': ft, 'c': 0.85::double, 'm': 'fill:' || case fk when 1 then 'orange_fill' else 'green_fill' end} when fk is not null then {'t': 'filled_zone', 'c': 0.6::double, 'm': 'fill_unknown'}
when ins and u.t <> 'minor_context' then {'t': u.t, 'c': greatest(u.c, 0.75)::double, 'm': u.m || '+containment'} else u end r from u"""),
    ("cls", "select * exclude (r, u, ft, st, sn, plot_ar, plot_id), r.t zone_type, r.c confidence, r.m as \"method\" from r"),
    ("ded", """select g.* exclude (zone_type, confidence, "method"), case when w.confidence > g.confidence then w.zone_type else g.zone_type end zone_type, greatest(w.confidence, g.confidence) confidence, case when w.confidence > g.confidence then w."method" else g."method" end as "method"
from (select *, row_number() over (partition by site, x0, y0, x1, y1, n_points, fk, sk order by (fk is not null) desc, width desc, confidence desc, id) k from cls) g
join (select *, row_number() over (partition by site, x0, y0, x1, y1, n_points, fk, sk order by confidence desc, id) k from cls) w on g.k = 1 and w.k = 1 and g.site = w.site and g.x0 = w.x0 and g.y0 = w.y0 and g.x1 = w.x1 and g.y1 = w.y1 and g.n_points = w.n_points and g.fk is not distinct from w.fk and g.sk is not distinct from w.sk"""),
    ("pa", "select site, coalesce(max(ar) filter (where zone_type = 'plot_boundary'), max(ar)) par from ded where closed group by site"),
    ("par", f"""select a.site, a.id, b.fk pfk, a.fk, row_number() over (partition by a.site, a.id order by b.ar desc, b.id) k2 from ded a join ded b on a.site = b.site and a.id <> b.id and b.ar > a.ar join pa on pa.site = a.site
where a.closed and b.closed and a.fk is not null and b.fk is not null and a.zone_type not in ('plot_boundary', 'minor_context') and b.zone_type not in ('plot_boundary', 'sub_zone', 'minor_context') and a.ar <= par * 0.1 and {_COMMON} > 0.8 * a.ar"""),
    ("dem", """select d.* exclude (zone_type, confidence, "method", fk), case when p.id is null then fk end fk, case when p.id is null then zone_type else 'sub_zone' end zone_type, case when p.id is null then confidence else greatest(confidence, 0.75) end confidence,
case when p.id is null then "method" else "method" || '+inherited_fill→building' end as "method" from ded d left join (select site, id from par where k2 = 1 and fk = pfk) p using (site, id)"""),
    ("big", "select * from (select site, zone_type, id pid, x0 bx0, y0 by0, x1 bx1, y1 by1, row_number() over (partition by site, zone_type order by ar desc, id) kb from dem where closed and zone_type not in ('plot_boundary', 'sub_zone', 'minor_context', 'context_line')) where kb = 1"),
    ("nes", "select dem.*, coalesce(closed and id <> pid and greatest(least(x1, bx1) - greatest(x0, bx0), 0) * greatest(least(y1, by1) - greatest(y0, by0), 0) > ar * 0.8, false) nst from dem left join big using (site, zone_type)"),
    ("pro", """select * exclude (zone_type, confidence, "method", nst), case when nst and fk is null and bld then 'sub_zone' else zone_type end zone_type, case when nst and fk is null and bld then greatest(confidence, 0.8) else confidence end confidence,
case when nst and fk is null and bld then "method" || '+nested_building' when nst and fk is not null then "method" || '+nested_subzone' else "method" end as "method" from nes"""),
    ("inn", f"select a.site, a.id, count(*) n_inner from pro a join pro b on a.site = b.site and a.id <> b.id where a.closed and b.closed and a.zone_type = 'sub_zone' and b.zone_type = 'sub_zone' and {_COMMON} > 0.8 * b.ar group by 1, 2"),
    ("env", """select p.* exclude (zone_type, confidence, "method"), case when n_inner >= 1 then 'buildable_envelope' else zone_type end zone_type, case when n_inner >= 1 then greatest(confidence, 0.8) else confidence end confidence,
case when n_inner >= 1 then "method" || '+envelope(' || n_inner || '_inner)' else "method" end as "method" from pro p left join inn using (site, id)"""),
    ("held", f"select * from (select t.site, t.id tid, t.text, e.id, row_number() over (partition by t.site, t.id order by e.ar, e.id) kt from ({fx('fx_ptext')}) t join env e on t.site = e.site and e.closed and t.x > e.x0 and t.x < e.x1 and t.y > e.y0 and t.y < e.y1) where kt = 1"),
    ("ls", "select site, id, list_filter(list_transform(string_split(string_agg(text, chr(10) order by tid), chr(10)), lambda x: trim(x)), lambda x: x <> '') ls from held group by 1, 2"),
    ("tg", r"""select site, id, list_filter(list_transform(ls, lambda x: case x when 'GD' then 'Gemengd (Mixed-Use)' when 'V' then 'Verkeer (Traffic)' when 'G' then 'Groen (Green)' when 'WR-A' then 'Waarde - Archeologie' end), lambda x: x is not null) a,
list_filter(list_transform(ls, lambda x: case when regexp_matches(x, '^\(sgd-\d+\)') then 'sgd-' || regexp_extract(x, '^\(sgd-(\d+)\)', 1) when regexp_matches(x, '^\[sba-[^\]]+\]') then 'sba-' || regexp_extract(x, '^\[sba-([^\]]+)\]', 1) when x = '(m)' then 'maatschappelijk' end), lambda x: x is not null) b,
list_filter(ls, lambda x: regexp_matches(x, '^\d+(,\d+)?$')) c from ls"""),
    ("lb", "select site, id, len(a) > 0 or len(b) > 0 named, nullif(concat_ws(' | ', a[1], nullif(array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), ' · '), ''), 'h=' || nullif(array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i), ','), '') || 'm'), '') label from tg"),
    ("lab", """select e.* exclude (zone_type, confidence, "method"), label, case when coalesce(named, false) and zone_type in ('minor_context', 'unknown', 'sub_zone', 'context_line') then 'sub_zone' else zone_type end zone_type,
case when coalesce(named, false) and zone_type in ('minor_context', 'unknown', 'sub_zone', 'context_line') then greatest(confidence, 0.85) else confidence end confidence, case when coalesce(named, false) and zone_type in ('minor_context', 'unknown', 'sub_zone', 'context_line') then "method" || '+text_label' else "method" end as "method"
from env e left join lb using (site, id)"""),
    ("kept", """select * from lab where case when zone_type in ('plot_boundary', 'zone_boundary', 'parcel_line', 'uncategorized_zone') then true when coalesce(label, '') <> '' then true
when zone_type in ('buildable_envelope', 'landscape_zone', 'infrastructure_zone', 'restriction_line') then case when closed then ar > 500 else width >= 0.5 or ar > 5000 end
when closed and ar > 80 then zone_type <> 'unknown' when not closed and zone_type in ('restriction_line', 'major_boundary', 'zone_boundary') and (width >= 0.3 or ar > 5000) then true else ar > 5000 end"""),
]


def _zone_sql(cte: str, more: str = "") -> str:
    return f"{_chain(cte)} select site, id, zone_type, round(confidence, 4) confidence, \"method\" classification_method{more} from {cte}"


def _zone_out(df, *more):
    return df.select("site", "id", "zone_type", F.round("confidence", 4).alias("confidence"), F.col("method").alias("classification_method"), *more)


@query(_zone_sql("cls", f", ins as inside, coalesce({_hex_sql('fk', _FILLS)}, {_hex_sql('sk', _STROKES)}) colour"))
def page_classes(spark, d):
    return _zone_out(pages.classify_zones(_shapes(spark, d), S), "inside", "colour")


def _deduped(spark, d):
    return settled(pages.dedup_zones(pages.classify_zones(_shapes(spark, d), S), S))


@query(_zone_sql("ded"))
def zone_dedup(spark, d):
    return _zone_out(_deduped(spark, d))


def _demoted(spark, d):
    return settled(pages.demote_inherited(_deduped(spark, d), S, PAGE_CELL))


@query(_zone_sql("dem", ", fk is not null filled"))
def page_inherited_fill(spark, d):
    return _zone_out(_demoted(spark, d), F.col("fill").isNotNull().alias("filled"))


def _promoted(spark, d):
    return settled(pages.promote_nested(_demoted(spark, d), S))


@query(_zone_sql("pro"))
def page_nested(spark, d):
    return _zone_out(_promoted(spark, d))


@query(_zone_sql("env"))
def page_envelopes(spark, d):
    return _zone_out(pages.envelopes_of_buildings(_promoted(spark, d), S, PAGE_CELL))


@query(_zone_sql("lab", ", label"))
def page_labels(spark, d):
    return _zone_out(pages.label_zones(settled(pages.envelopes_of_buildings(_promoted(spark, d), S, PAGE_CELL)), _texts(spark, d), S, PAGE_CELL), "label")


@query(_zone_sql("kept", ", label"))
def page_zones(spark, d):
    """From shapes and texts of pages to their zones, all steps."""
    return _zone_out(pages.page_zones(_shapes(spark, d), _texts(spark, d), S, PAGE_CELL), "label")


@query(f"{_chain('kept')} select zone_type, count(*) n, cast(round(avg(confidence) * 100) as bigint) confidence_pct from kept group by 1 order by n desc")
def zone_report(spark, d):
    """Counts and mean confidence of the page zones by type, most first."""
    z = pages.page_zones(_shapes(spark, d), _texts(spark, d), S, PAGE_CELL)
    return z.groupBy("zone_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence") * 100).cast("bigint").alias("confidence_pct")).orderBy(F.desc("n"))


@query(f"{_chain('pl')} select site, plot_id, plot_ar plot_area from pl")
def plot_pick(spark, d):
    return pages.pick_plot(_shapes(spark, d), S).select("site", "plot_id", "plot_area")


@query(f"""{_chain('s')}, p3 as (select * from (select site, id plot_id, x0 px0, y0 py0, x1 px1, y1 py1, row_number() over (partition by site order by (fk is null and ar > 50000 and width >= 0.3) desc, ar desc, id) k from s where closed and ar > 0) where k = 1)
select site, id, case when id = plot_id then 'plot' when not coalesce((x0 >= px0 and x1 <= px1 and y0 >= py0 and y1 <= py1) or greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) > ar * 0.8, false) then 'unclassified'
when ar / 1e6 > 0.015 or coalesce(sk in (1, 2), false) then 'zone' else 'subzone_candidate' end as role from s left join p3 using (site) where closed""")
def page_hierarchy(spark, d):
    return pages.hierarchy(_shapes(spark, d).filter("closed"), S).select("site", "id", "role")


@query(f"""{_chain('s')} select site, count(*) total_polygons, count(*) filter (where fk is not null) filled_count, count(*) filter (where fk is null and ar / 1e4 > 0.01 and ar / 1e4 < 5) building_candidates, count(*) filter (where fk is not null and ar / 1e4 > 1) n_large from s group by site""")
def visual_counts(spark, d):
    return pages.visual_counts(_shapes(spark, d), S).withColumn("n_large", F.size("large_filled_zones").cast("bigint")).drop("large_filled_zones")


_GUESS = "case when {a} > 0.15 and not {f} then 'boundary_candidate' when strategy <> 'direct' then case when {r} then 'building_candidate' else 'boundary_candidate' end when {a} > 0.04 and not {f} then 'zone_candidate' when {f} and {a} > 0.005 then 'zone_candidate' when {r} then 'building_candidate' else 'zone_candidate' end"


@query(f"{_chain('s')} select site, id, {_GUESS.format(a='ar / 1e5', f='(fk is not null)', r='(asp < 5.5 and mind >= 20)')} guess from s")
def shape_guess(spark, d):
    s = _shapes(spark, d)
    real = classify.is_realistic_building(F.col("aspect_ratio"), F.col("compactness"), F.col("min_dim"))
    return s.select("site", "id", classify.guess(F.col("fill").isNotNull(), F.col("strategy"), F.col("area") / 1e5, real).alias("guess"))


@query(f"{_chain('s')} select id, true share_fits, fk is not null filled, cast(n_points as bigint) n_points, strategy extraction from s")
def shape_manifest(spark, d):
    s = _shapes(spark, d).withColumn("guess", F.lit("zone_candidate"))
    m = pages.manifest(s, S).join(s.select("site", "id", "area"), ["site", "id"]).select("area", F.from_json("line", "id long, area_pct double, filled boolean, centroid array<double>, n_points long, extraction string").alias("m"))
    fits = F.abs(F.col("m.area_pct") - F.col("area") / 1e4) < 0.00501  # two decimals, whichever way a half goes
    return m.select("m.id", fits.alias("share_fits"), "m.filled", "m.n_points", "m.extraction")


_REFS = [(t, c) for t, cs in classify.COLOUR_REFERENCES.items() for c in cs]


@query(f"""with c as (select p_partkey id, cast(p_size % 11 as double) / 10 r, cast(p_partkey % 11 as double) / 10 g, cast((p_partkey + p_size) % 7 as double) / 6 b from part),
m as (select *, list_min([{", ".join(f"{{'d': sqrt(power(r - {x}, 2) + power(g - {y}, 2) + power(b - {z}, 2)), 'i': {i}, 't': '{t}'}}" for i, (t, (x, y, z)) in enumerate(_REFS))}]) m from c)
select id, case when m.d <= 0.35 then m.t else 'unknown' end zone_type, case when m.d > 0.35 then 0.3 when id % 2 = 0 then round(least(greatest(0.5, 1 - 2 * m.d) + 0.1, 1.0), 2) else round(greatest(0.5, 1 - 2 * m.d), 2) end confidence from m""")
def colour_class(spark, d):
    c = spark.sql("select p_partkey id, cast(p_size % 11 as double) / 10 r, cast(p_partkey % 11 as double) / 10 g, cast((p_partkey + p_size) % 7 as double) / 6 b from {part}", part=spark.read.parquet(f"{d}/part.parquet"))
    return c.select("id", classify.colour_class(F.col("r"), F.col("g"), F.col("b"), F.col("id") % 2 == 0).alias("c")).select("id", "c.zone_type", F.col("c.confidence").cast("double").alias("confidence"))


@query(f"""with m as (select * from ({fx('fx_shape')}) where closed and x1 - x0 < 40 and y1 - y0 < 40), t as (select * from ({fx('fx_ptext')}) where trim(text) <> ''), z as (select *, (x1 - x0) * (y1 - y0) ar from ({fx('fx_shape')}) where closed),
f as (select * from (select m.site, m.id, (m.x0 + m.x1) / 2.0 cx, (m.y0 + m.y1) / 2.0 cy, trim(t.text) said, row_number() over (partition by m.site, m.id order by t.id) k from m join t on m.site = t.site
and power((m.x0 + m.x1) / 2.0 - t.x, 2) + power((m.y0 + m.y1) / 2.0 - t.y, 2) < power(greatest(m.x1 - m.x0, m.y1 - m.y0) / 2.0 * 1.5, 2)) where k = 1),
h as (select * from (select f.*, z.id zid, row_number() over (partition by f.site, f.id order by ar, z.id) kz from f join z on f.site = z.site and cx > x0 and cx < x1 and cy > y0 and cy < y1) where kz = 1)
select site, zid id, count(*) n, string_agg(said, '|' order by id) labels from h group by 1, 2""")
def marker_labels(spark, d):
    s = _shapes(spark, d)
    m = s.filter("closed and x1 - x0 < 40 and y1 - y0 < 40").select("site", "id", "x0", "y0", "x1", "y1")
    got = pages.marker_labels(m, _texts(spark, d), s.select("site", "id", "closed", "x0", "y0", "x1", "y1"), S, PAGE_CELL)
    return got.select("site", "id", F.size("labels").cast("bigint").alias("n"), F.array_join("labels", "|").alias("labels"))


@query(f"""{_chain('pl')}, t as (select *, trim(text) tt from ({fx('fx_ptext')})) select t.site, t.id from t left join (select * from pl where site % 2 = 0) p using (site)
where x < coalesce(px1, 900) and x + 10 > coalesce(px0, 100) and y < coalesce(py1, 900) and y + 4 > coalesce(py0, 100) and tt <> '' and ({_any_sql('tt', pages.PLAN_TEXT)} or (regexp_matches(tt, '\\d') and length(tt) < 20))""")
def plan_texts(spark, d):
    t = _texts(spark, d).select("site", "id", "text", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 10).alias("x1"), (F.col("y") + 4).alias("y1"), F.lit(1000.0).alias("page_w"), F.lit(1000.0).alias("page_h"))
    return pages.plan_texts(t, pages.pick_plot(_shapes(spark, d), S).filter("site % 2 = 0"), S).select("site", "id")


@query(f"""{_chain('kept')}, b as (select site, (min(x0) + max(x1)) / 2.0 mx, (min(y0) + max(y1)) / 2.0 my from kept group by site)
select site, id, case when closed then 'Polygon' else 'Polyline' end as type, round((x0 - mx) * 0.1764, 4) px, round((y0 - my) * 0.1764, 4) pz, closed or id % 2 = 0 turns_left, round(ar * 0.1764 * 0.1764, 1) area_m2,
coalesce({_hex_sql('fk', _FILLS)}, {_hex_sql('sk', _STROKES)}, '#94a3b8') color_hint, round(confidence, 2) confidence, fk is not null filled from kept join b using (site) where zone_type <> 'major_boundary' and (fk is not null or sk is not null)""")
def page_output(spark, d):
    z = settled(pages.page_zones(_shapes(spark, d), _texts(spark, d), S, PAGE_CELL))
    c = {k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1")}
    up = F.array(F.array(c["x0"], c["y0"]), F.array(c["x1"], c["y0"]), F.array(c["x1"], c["y1"]), F.array(c["x0"], c["y1"]))
    down = F.array(F.array(c["x0"], c["y0"]), F.array(c["x0"], c["y1"]), F.array(c["x1"], c["y1"]), F.array(c["x1"], c["y0"]))
    z = z.withColumns({"points": F.when(F.col("id") % 2 == 0, up).otherwise(down), "colour": F.coalesce(*(geometry.rgb_hex(F.col(k)[0], F.col(k)[1], F.col(k)[2]) for k in ("fill", "stroke")))})
    o = pages.to_output(z, S, F.lit(0.1764)).join(z.select("site", "id", (F.col("fk").isNotNull() | F.col("sk").isNotNull()).alias("drawn")), ["site", "id"]).filter("drawn and zone_type <> 'major_boundary'")
    plane = F.transform("points", lambda p: F.array(p[0], p[2]))
    return o.select("site", "id", "type", F.array_min(F.transform("points", lambda p: p[0])).alias("px"), F.array_min(F.transform("points", lambda p: p[2])).alias("pz"),
                    (geometry.signed_area(plane) > 0).alias("turns_left"), "area_m2", "color_hint", "confidence", "filled")


# --- votes to types ---------------------------------------------------------------------------------------
_EN: list[tuple[str, str]] = [
    ("z", f"""select *, cast((x1 - x0) * (y1 - y0) as double) ar, greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) asp, least(x1 - x0, y1 - y0) mind, case when size % 2 = 0 then 'building_candidate' else 'zone_candidate' end guess,
case when id % 8 = 5 then 'chain_join' when id % 8 = 6 then 'planar_face' else 'direct' end strategy, greatest(x1 - x0, y1 - y0) / least(x1 - x0, y1 - y0) < 5.5 and least(x1 - x0, y1 - y0) >= 12 realistic from ({fx('fx_zone')})"""),
    ("lo", "select *, cast(case when id % 13 = 0 then 1.0 when asp > 10 then 0.95 when ar / 1e6 < 0.0001 then 0.9 when ar / 1e6 < 0.0005 and asp < 2.5 and coalesce(label, '') <> '' then 0.85 end as double) lc from z"),
    ("v", f"select z.site, v.* from z join ({fx('fx_vote')}) v on v.id = z.id where z.id % 17 <> 0"),
    ("n", "select site, id, zone_type, count(*) n, min(agent_rank) f from v group by 1, 2, 3"),
    ("mj", "select * from (select *, sum(n) over (partition by site, id) total, row_number() over (partition by site, id order by n desc, f) k from n) where k = 1"),
    ("ju", """select lo.site, lo.id, coalesce(mj.zone_type, 'unknown') zone_type, cast(coalesce(round(0.6 + n / total * 0.3, 2), 0.3) as double) confidence, case when n >= 2 then 'majority' when n = 1 then 'judge_call' end agreement from lo left join mj using (site, id) where lc is null"""),
    ("rf", "select ju.* exclude (zone_type, confidence, agreement), case when id % 6 = 0 then 'landscape_zone' when id % 6 = 1 then 'sub_zone' else zone_type end zone_type, case when id % 6 in (0, 1) then 0.77 else confidence end confidence, case when id % 6 in (0, 1) then 'refine_1' else agreement end agreement from ju"),
    ("chg", "select distinct site from ju join rf using (site, id) where ju.zone_type <> rf.zone_type"),
    ("r2", "select rf.* exclude (zone_type, confidence, agreement), case when id % 7 = 0 and c.site is not null then 'sub_zone' else zone_type end zone_type, case when id % 7 = 0 and c.site is not null then 0.66 else confidence end confidence, case when id % 7 = 0 and c.site is not null then 'refine_2' else agreement end agreement from rf left join chg c using (site)"),
    ("ap", """select lo.*, case when r2.zone_type = 'artifact' and (guess = 'building_candidate' or strategy <> 'direct') then 'sub_zone' when r2.zone_type not in ('artifact', 'unknown') then r2.zone_type end t,
case when r2.zone_type = 'artifact' and (guess = 'building_candidate' or strategy <> 'direct') then 0.7 when r2.zone_type not in ('artifact', 'unknown') then r2.confidence end c, r2.zone_type = 'artifact' and guess <> 'building_candidate' and strategy = 'direct' art from lo join r2 using (site, id)"""),
    ("cf", f"""select a.site, case when a.ar > b.ar then a.id else b.id end outer_id, least(a.ar, b.ar) ia, greatest(a.ar, b.ar) oa from ap a join ap b on a.site = b.site and a.id < b.id where a.t = 'sub_zone' and b.t = 'sub_zone' and {_COMMON} > 0.7 * least(a.ar, b.ar)"""),
    ("hd", "select site, outer_id id, sum(ia) / max(oa) share from cf group by 1, 2"),
    ("rs", "select ap.* exclude (t, c), case when t = 'sub_zone' and share < 0.85 then 'plinth' else t end t, case when t = 'sub_zone' and share < 0.85 then 0.7 else c end c from ap left join hd using (site, id)"),
    ("h1", "select * exclude (t, c), case when strategy <> 'direct' and t <> 'sub_zone' and not art then 'sub_zone' else t end t, case when strategy <> 'direct' and t <> 'sub_zone' and not art then greatest(coalesce(c, 0), 0.7) else c end c from rs"),
    ("h2", "select * exclude (t, c), case when t is null and guess = 'building_candidate' and not art and fnd < lst then 'sub_zone' else t end t, case when t is null and guess = 'building_candidate' and not art and fnd < lst then 0.65 else c end c from (select *, count(*) filter (where t = 'sub_zone') over (partition by site) fnd, greatest(floor(count(*) filter (where guess = 'building_candidate') over (partition by site) * 0.5), 2) lst from h1)"),
    ("tk", "select distinct e.site, e.id from h2 e join h2 b on e.site = b.site where e.t = 'buildable_envelope' and b.t in ('sub_zone', 'plinth') and b.x0 + b.x1 > 2 * e.x0 and b.x0 + b.x1 < 2 * e.x1 and b.y0 + b.y1 > 2 * e.y0 and b.y0 + b.y1 < 2 * e.y1"),
    ("mv", "select distinct b.site, b.id from h2 e join h2 b on e.site = b.site and e.id <> b.id left join tk on tk.site = e.site and tk.id = e.id where tk.id is null and e.t = 'buildable_envelope' and b.t is null and not b.art and b.realistic and b.x0 + b.x1 > 2 * e.x0 and b.x0 + b.x1 < 2 * e.x1 and b.y0 + b.y1 > 2 * e.y0 and b.y0 + b.y1 < 2 * e.y1 and b.ar / greatest(e.ar, 1) > 0.01 and b.ar / greatest(e.ar, 1) < 0.95"),
    ("h3", "select h2.* exclude (t, c), case when mv.id is null then t else 'sub_zone' end t, case when mv.id is null then c else 0.6 end c from h2 left join mv using (site, id)"),
    ("pt", f"select distinct a.site, a.id from h3 a join h3 b on a.site = b.site and a.id <> b.id where a.t = 'sub_zone' and b.t = 'sub_zone' and {_COMMON} > 0.8 * b.ar"),
    ("h4", "select h3.* exclude (t, c), case when pt.id is null then t else 'plinth' end t, case when pt.id is null then c else greatest(coalesce(c, 0), 0.8) end c from h3 left join pt using (site, id)"),
    ("h5", "select * exclude (t, art), case when t = 'sub_zone' and not realistic then 'artifact' else t end t, art or coalesce(t = 'sub_zone' and not realistic, false) art from h4"),
]


def _en(upto: str, more: str) -> str:
    parts = []
    for name, text in _EN:
        parts.append(f"{name} as ({text})")
        if name == upto:
            break
    return "with " + ",\n".join(parts) + "\n" + more


_BOX = ["x0", "y0", "x1", "y1"]


def _polygons(spark, d):
    z = view(spark, d, "fx_zone").withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    z = z.withColumns({"area": (F.col("w") * F.col("h")).cast("double"), "aspect_ratio": F.greatest("w", "h") / F.least("w", "h"), "strategy": F.when(F.col("id") % 8 == 5, "chain_join").when(F.col("id") % 8 == 6, "planar_face").otherwise("direct")})
    return z.select(
        "site", "id", *_BOX, "area", F.lit(1e6).alias("page_area"), F.lit(1.0).alias("compactness"), "aspect_ratio", "strategy", (F.col("id") % 13 != 0).alias("valid"), (F.coalesce("label", F.lit("")) != "").alias("has_label"),
        F.when(F.col("size") % 2 == 0, "building_candidate").otherwise("zone_candidate").alias("guess"), ((F.col("aspect_ratio") < 5.5) & (F.least("w", "h") >= 12)).alias("realistic"),
    )


def _ballots(spark, d):
    return view(spark, d, "fx_vote").join(view(spark, d, "fx_zone").select("site", "id"), "id").filter("id % 17 <> 0").select("site", "id", "agent_rank", "zone_type")


def _rounds(spark, d):
    z = view(spark, d, "fx_zone").select("site", "id", F.lit("").alias("reason"))
    one = z.filter("id % 6 in (0, 1)").withColumns({"zone_type": F.when(F.col("id") % 6 == 0, "landscape_zone").otherwise("sub_zone"), "confidence": F.lit(0.77)})
    two = z.filter("id % 7 = 0").withColumns({"zone_type": F.lit("sub_zone"), "confidence": F.lit(0.66)})
    return [one, two]


@query(_en("h5", "select site, id, t zone_type, cast(round(c, 4) as double) confidence, art artifact from h5 union all select site, id, 'artifact', lc, true from lo where lc is not null"))
def ensemble_types(spark, d):
    """Votes to types: prefilter, majority, two refinement rounds, conflicts and hard rules."""
    got = ensemble.classified(_polygons(spark, d), _ballots(spark, d), S, CELL, rounds=_rounds(spark, d))
    return got.select("site", "id", "zone_type", F.round("confidence", 4).alias("confidence"), "artifact")


_APPLIED = """select site, id, zone_type t, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) ar, id % 10 = 0 told from ({z}) where zone_type = 'sub_zone'""".format(z=fx("fx_zone"))


@query(f"""with a as ({_APPLIED}), c as (select a.site, case when a.ar > b.ar then a.id else b.id end id, round(least(a.ar, b.ar) / cast(greatest(a.ar, b.ar) as double), 3) ratio from a join a b on a.site = b.site and a.id < b.id where {_COMMON} > 0.7 * least(a.ar, b.ar)),
l as (select site, id, min(ratio) least_ratio from c group by 1, 2)
select a.site, a.id, case when told then 'landscape_zone' when least_ratio < 0.7 then 'plinth' else t end zone_type, cast(case when told then 0.9 when least_ratio < 0.7 then 0.75 else 0.5 end as double) confidence from a left join l using (site, id)""")
def conflict_answers(spark, d):
    """Conflicts with a resolver's answers: those hold, small inner buildings make plinths of the rest."""
    z = view(spark, d, "fx_zone").filter("zone_type = 'sub_zone'").select("site", "id", *_BOX, "zone_type", F.lit(0.5).alias("confidence"), F.lit("").alias("reason"))
    answers = z.filter("id % 10 = 0").select("site", "id", F.lit("landscape_zone").alias("zone_type"), F.lit(0.9).alias("confidence"))
    return ensemble.resolve(z, S, CELL, answers).select("site", "id", "zone_type", "confidence")


# --- volumes -----------------------------------------------------------------------------------------------
_B = f"(select *, cast((x1 - x0) * (y1 - y0) as double) ar from ({fx('fx_block')}))"
_ZP = "select site, id zone_id, case when id % 3 = 0 then 'plinth_tower' else 'infill' end typology, case when id % 4 < 2 then 'office' when id % 4 = 2 then 'retail' else 'residential' end as use_type, case when id % 5 > 0 then cast(300.0 * (1 + size) as double) end target_gfa_m2, case when id % 3 < 2 then cast(9 + size as double) end max_height_m, cast(id % 3 as int) parking_levels from {b} where k < 4 and id % 11 <> 2"
_PR = "select cast(id as string) building_id, cast(1 + size % 7 as int) floors, 3.0 + id % 2 floor_height, id % 4 = 0 shop, 'Toren ' || size label from {b} where zone_type = 'sub_zone' and id % 3 <> 1"
_VC = "select cast(floor(p_partkey / 20.0) as bigint) site, p_partkey seq, case p_partkey % 4 when 0 then 'height' when 1 then 'setback' when 2 then 'density' else 'density' end category, case p_partkey % 4 when 2 then 'GRZ' when 3 then 'FSI' else 'x' end as \"name\", cast(case p_partkey % 4 when 0 then 20 + p_size when 1 then 1 + p_size % 6 when 2 then 0.4 else 1.2 end as double) as \"value\" from {part} where p_partkey % 20 in (0, 4, 8, 1, 5, 6, 7) and p_partkey % 60 < 40"
_LIM = "(select site, min(\"value\") filter (where category = 'height' and \"value\" > 0) site_height, min(\"value\") filter (where category = 'setback') setback, max_by(\"value\", seq) filter (where \"name\" = 'GRZ') density, max_by(\"value\", seq) filter (where \"name\" = 'FSI') fsi from (" + _VC.replace("{part}", "part") + ") group by site)"
_ENVS = f"(select * from {_B} where zone_type in ('buildable_envelope', 'filled_zone') and closed and not {_any_sql('label', volumes.ROAD_LABELS)})"
_TGT = f"""(select e.*, z.typology, coalesce(z.use_type, 'residential') u, coalesce(z.parking_levels, 0) pk, coalesce(nullif(z.max_height_m, 0), site_height, 15.0) mh, site_height, setback, density, fsi,
coalesce(case when target_gfa_m2 > 0 then target_gfa_m2 end, round(ar * case coalesce(z.use_type, 'residential') when 'office' then 2.0 when 'retail' then 1.0 else 1.5 end, 1)) gfa from {_ENVS} e left join ({_ZP.format(b=_B)}) z on z.site = e.site and z.zone_id = e.id left join {_LIM} l on l.site = e.site)"""
_HOUSES = f"(select b.* from {_B} b join (select site, coalesce(max(ar) filter (where zone_type = 'plot_boundary'), max(ar)) plot from {_B} group by site) p using (site) where zone_type = 'sub_zone' and ar <= plot * 0.4 and least(x1 - x0, y1 - y0) >= 4)"
_HOME = f"(select h.site, h.id, min(e.id) envelope from {_HOUSES} h join {_ENVS} e on h.site = e.site where (h.x0 + h.x1 > 2 * e.x0 and h.x0 + h.x1 < 2 * e.x1 and h.y0 + h.y1 > 2 * e.y0 and h.y0 + h.y1 < 2 * e.y1) or greatest(least(h.x1, e.x1) - greatest(h.x0, e.x0), 0) * greatest(least(h.y1, e.y1) - greatest(h.y0, e.y0), 0) > 0.3 * h.ar group by 1, 2)"
_DERIVED = f"""(with t as (select t.*, x1 - x0 w0, y1 - y0 h0, coalesce(setback, 0) s from {_TGT} t where not exists (select 1 from {_HOME} m where m.site = t.site and m.envelope = t.id)),
b as (select *, case when s > 0 and w0 > 2 * s and h0 > 2 * s and (w0 - 2 * s) * (h0 - 2 * s) > 0.1 * ar then s else 0 end d from t), q as (select *, (w0 - 2 * d) * (h0 - 2 * d) room, 2 * (w0 + h0 - 4 * d) around, greatest(floor(least(mh, coalesce(site_height, mh)) / 3.0), 1) fl from b),
g as (select *, coalesce(nullif(gfa, 0) / fl, fsi * room / fl, density * room) want0 from q), f as (select *, case when want0 > room then room * 0.85 else want0 end want, greatest(around * 0.03, 2.0) i from g)
select site, id envelope, case when want is null or want >= room * 0.95 then 'inset_60pct' else 'gfa_derived' end as how, round(case when want is null or want >= room * 0.95 then 0.6 * case when w0 - 2 * d > 2 * i and h0 - 2 * d > 2 * i then (w0 - 2 * d - 2 * i) * (h0 - 2 * d - 2 * i) else room end else want end, 4) area from f)"""


def _blocks(spark, d):
    b = view(spark, d, "fx_block")
    c = {k: F.col(k).cast("double") for k in _BOX}
    ring = F.array(F.array(c["x0"], c["y0"]), F.array(c["x1"], c["y0"]), F.array(c["x1"], c["y1"]), F.array(c["x0"], c["y1"]))
    return b.withColumns({"area": ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).cast("double"), "points": ring})


def _volume_inputs(spark, d):
    b = view(spark, d, "fx_block")
    zp = spark.sql(_ZP.format(b="{blocks}"), blocks=b).withColumnRenamed("use_type", "use")
    pr = spark.sql(_PR.format(b="{blocks}"), blocks=b)
    use = F.when(F.col("shop"), F.array(F.struct(F.lit(0).alias("floor"), F.lit("retail").alias("use")), F.struct(F.lit(1).alias("floor"), F.lit("office").alias("use"))))
    pr = pr.select("building_id", "floors", F.col("floor_height").cast("double").alias("floor_height"), "label", F.coalesce(use, F.array().cast("array<struct<floor:int,use:string>>")).alias("uses"), F.lit(0.7).alias("confidence"))
    vc = spark.sql(_VC.replace('\\"', '"').replace('"name"', "`name`").replace('"value"', "`value`"), part=spark.read.parquet(f"{d}/part.parquet"))
    return _blocks(spark, d), zp, pr, vc


def _generated(spark, d):
    return volumes.generate(*_volume_inputs(spark, d), S, CELL * 4)


@query(f"select site, envelope, how as \"method\", area from {_DERIVED}")
def derived_footprints(spark, d):
    return _generated(spark, d)["derived"].select("site", "envelope", "method", "area")


_FLOORS = f"""(with z as (select site, id envelope, u, gfa, mh, case when typology = 'plinth_tower' then 4.5 else 0.0 end base from {_TGT}), l as {_LIM},
b as (select site, cast(id as string) id, envelope, label, ar, false der from {_HOUSES} left join {_HOME} using (site, id) union all select site, 'derived_' || envelope, envelope, 'Derived (' || envelope || ')', area, true from {_DERIVED}),
j as (select b.*, coalesce(u, 'residential') uu, gfa, coalesce(mh, site_height, 45.0) top, coalesce(base, 0.0) base, least(ar, case coalesce(u, 'residential') when 'residential' then 1200 when 'office' then 2000 when 'retail' then 3000 else 1500 end) foot from b left join z using (site, envelope) left join l using (site)),
k as (select *, greatest(sum(foot) over (partition by site, envelope), 0.01) feet from j), n as (select *, case when gfa > 0 and foot > 0 then greatest(ceil(round(gfa / feet, 6)), 1) else greatest(floor((top - base) / 3.0), 1) end n0 from k),
p as (select n.*, r.floors pf, r.floor_height ph, r.shop, r.label pl, case when uu in ('industrial', 'retail') then n0 else greatest(n0, 3) end n1 from n left join ({_PR.format(b=_B)}) r on r.building_id = n.id)
select *, coalesce(ph, 3.0) h, cast(least(coalesce(pf, n1), greatest(floor((top - base) / coalesce(ph, 3.0)), 1)) as int) nf from p)"""
_VOLS = f"""(select site, id building_id, 'building_floor' zone_type, cast(f as int) floor_index, round(base + f * h, 4) y_bottom, round(base + (f + 1) * h, 4) y_top, case when shop and f = 0 then 'retail' when shop then 'office' else 'residential' end use_type, round(ar, 0) area_m2, coalesce(pl, label, 'Building ' || id) building_label from (select *, unnest(range(nf)) f from {_FLOORS})
union all select site, 'parking_' || id, 'underground_parking', -l, -l * 3.0, (1 - l) * 3.0, 'underground_parking', round(ar, 0), 'Parking (' || coalesce(label, '') || ')' from (select *, cast(unnest(range(1, pk + 1)) as int) l from {_TGT})
union all select site, 'plinth_' || id, 'plinth', 0, 0.0, 4.5, 'retail', round(case when x1 - x0 > 2 * i and y1 - y0 > 2 * i and (x1 - x0 - 2 * i) * (y1 - y0 - 2 * i) > 0.3 * ar then (x1 - x0 - 2 * i) * (y1 - y0 - 2 * i) else ar end, 0), 'Plinth (' || coalesce(label, 'Mixed-Use') || ')' from (select *, greatest(2 * (x1 - x0 + y1 - y0) * 0.04, 1.5) i from {_TGT} where typology = 'plinth_tower'))"""


@query(f"select site, building_id, zone_type, floor_index, cast(y_bottom as double) y_bottom, cast(y_top as double) y_top, use_type, cast(case when building_id not like 'derived%' and building_id not like 'plinth%' then area_m2 end as double) area_m2, building_label from {_VOLS}")
def volume_rows(spark, d):
    """All volumes of the sites: plinths, parking and floors of drawn and derived buildings."""
    v = _generated(spark, d)["volumes"]
    drawn = ~F.col("building_id").rlike("^(derived|plinth)")  # areas of the others come from rounded corners
    return v.select("site", "building_id", "zone_type", "floor_index", F.col("y_bottom").cast("double").alias("y_bottom"), F.col("y_top").cast("double").alias("y_top"), "use_type", F.when(drawn, F.col("area_m2")).alias("area_m2"), "building_label")


@query(f"""with v as {_VOLS}, d as (select site, count(*) n from {_DERIVED} group by site), a as (select site, count(*) n from {_ENVS} group by site)
select v.site, count(*) total, count(distinct case when zone_type = 'building_floor' then building_id end) buildings_processed, count(*) filter (where zone_type = 'building_floor') building_floors, count(*) filter (where zone_type = 'plinth') plinths,
count(*) filter (where zone_type = 'underground_parking') parking_levels, coalesce(max(d.n), 0) derived_from_envelope, coalesce(max(a.n), 0) annotations from v left join d on v.site = d.site left join a on v.site = a.site group by v.site""")
def volume_summary(spark, d):
    return _generated(spark, d)["summary"]


@query(f"select site, 'annot_zone_' || id id, 'Z' || n || ': ' || coalesce(label, 'Zone ' || n) annotation_text, (x0 + x1) / 2.0 x, (y0 + y1) / 2.0 z from (select *, row_number() over (partition by site order by id) n from {_ENVS})")
def zone_annotations(spark, d):
    return volumes.annotations(volumes.envelopes(_blocks(spark, d)), S).select("site", "id", "annotation_text", F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z"))


# --- export and progress -------------------------------------------------------------------------------------
@query(f"""with z as ({fx('fx_zone')}), e as (select *, unnest(range(4)) i from z), r as (select id volume_id, 'ring' kind, unnest([0, 1]) part, x0, y0, x1, y1, size from z)
select volume_id, kind, cast(part as int) part, 4 n_points, cast(case when part = 0 then 0 else size end as double) z, cast(2 * (x0 + x1) as double) sum_x, cast(2 * (y0 + y1) as double) sum_y from r
union all select id, 'edge', cast(i as int), 2, cast(size as double), cast(2 * case when i in (1, 2) then x1 else x0 end as double), cast(2 * case when i in (2, 3) then y1 else y0 end as double) from e
union all select id, 'wall', cast(i as int), 4, cast(size as double), cast(2 * (case when i in (1, 2) then x1 else x0 end + case when i in (0, 1) then x1 else x0 end) as double), cast(2 * (case when i in (2, 3) then y1 else y0 end + case when i in (1, 2) then y1 else y0 end) as double) from e""")
def volume_parts(spark, d):
    z = view(spark, d, "fx_zone")
    c = {k: F.col(k).cast("double") for k in _BOX}
    flat = F.lit(0.0)
    ring = F.array(F.array(c["x0"], flat, c["y0"]), F.array(c["x1"], flat, c["y0"]), F.array(c["x1"], flat, c["y1"]), F.array(c["x0"], flat, c["y1"]), F.array(c["x0"], flat, c["y0"]))
    p = export.volume_parts(z.select(F.col("id").alias("volume_id"), ring.alias("points"), F.lit(0.0).alias("y_bottom"), F.col("size").cast("double").alias("y_top")))
    total = lambda k: F.aggregate("points", F.lit(0.0), lambda a, q: a + q[k])
    return p.select("volume_id", "kind", "part", F.size("points").alias("n_points"), F.array_max(F.transform("points", lambda q: q[2])).alias("z"), total(0).alias("sum_x"), total(1).alias("sum_y"))


_DXF_CAT = "case zone_type " + " ".join(f"when '{t}' then '{export.PREFIXES[c]}-{export.LAYER_NAMES.get(t) or t.title()}'" for t, c in export.CATEGORY_OF.items() if t in export.ACI) + " end"


@query(f"""with z as ({fx('fx_zone')}), l as (select site, {_DXF_CAT} ly from z), k as (select site, 1 section, count(distinct ly) + 7 n, 0 lines from l group by site)
select site, section, n, cast(lines as bigint) vertices from k union all select site, 3, count(*) filter (where id % 3 > 0) + 10 * count(*) filter (where id % 3 = 0), cast(sum(case when id % 3 > 0 then 4 else 8 end) as bigint) from z group by site
union all select site, s.s, 1, 0 from (select distinct site from z), (select unnest([0, 2, 5]) s) s""")
def dxf_document(spark, d):
    """How many entries the sections of each site's drawing have, and its polyline vertices."""
    z = view(spark, d, "fx_zone")
    c = {k: F.col(k).cast("double") for k in _BOX}
    flat, solid = F.lit(0.0), F.col("id") % 3 == 0
    ring = F.array(F.array(c["x0"], flat, c["y0"]), F.array(c["x1"], flat, c["y0"]), F.array(c["x1"], flat, c["y1"]), F.array(c["x0"], flat, c["y1"]))
    pairs = export.metadata({"zone_type": F.col("zone_type"), "id": F.col("id"), "zone_label": F.col("label")})
    o = z.select("site", "id", "zone_type", ring.alias("points"), F.lit(True).alias("closed"), F.when(solid, 0.0).alias("y_bottom"), F.when(solid, F.col("size").cast("double")).alias("y_top"), pairs.alias("pairs"))
    doc = export.dxf_document(o, S)
    return doc.groupBy("site", "section").agg(F.count("*").alias("n"), F.sum(F.size(F.split("value", "\\nVERTEX\\n")) - 1).alias("vertices"))


_ST = "case event_id % 6 when 0 then '3' when 1 then '4' when 2 then '5' when 3 then '6' when 4 then '7' else '8' end"


@query(f"""with o as (select event_id % 50 run, {_ST} stage, event_type zone_type from events), s as (select distinct run, stage from o union all select distinct run, 'done' from o)
select s.run, s.stage, count(*) total, count(distinct zone_type) n_types from s join o on s.run = o.run and (s.stage = 'done' or o.stage <= s.stage) group by 1, 2""")
def snapshots(spark, d):
    """Accumulated counts of the objects of runs, stage by stage."""
    o = spark.read.parquet(f"{d}/events.parquet")
    o = o.select((F.col("event_id") % 50).alias("run"), F.expr(_ST).alias("stage"), F.col("event_type").alias("zone_type"))
    got = stream.snapshots(o, ["run"])
    return got.select("run", "stage", F.get_json_object("line", "$.total").cast("bigint").alias("total"), F.size(F.map_keys(F.from_json(F.get_json_object("line", "$.counts"), "map<string,bigint>"))).cast("bigint").alias("n_types"))
