"""Planning inputs derived from the star-schema tables, as SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "cast(floor(p_partkey / 20.0) as bigint)"
VIEWS: dict[str, tuple[str, str]] = {
    # name: (table, select list)
    "fx_text": (
        "part",
        f"""select {KEY} site, p_partkey seq,
        'Max hoogte: ' || (3 + p_size % 30) || ',5 m; front setback: ' || (1 + p_partkey % 9) || 'm. GRZ: 0.' || (1 + p_partkey % 8)
        || ' GFA: ' || (60 + (p_partkey * 37) % 9000) || ' m2. ' || (p_partkey % 120) || ' floors, '
        || case p_partkey % 6 when 0 then 'wonen' when 1 then 'Kantoor' when 2 then 'retail' when 3 then 'mixed-use' when 4 then 'Gewerbe' else 'office' end
        || ' parkeerplaatsen: ' || (1 + p_partkey % 4) || ',5 per woning; schaal 1:' || (10 * (p_partkey % 150))
        || case p_partkey % 7 when 0 then ' Firsthöhe: ' || (5 + p_size) || ' m, Traufhöhe 7 Grenzabstand: 3 m, GFZ 1,2 Baugrenze Tiefgarage'
             when 1 then ' nokhoogte 9.5 goothoogte: 6 rooilijn: 5m bouwvlak kavel; 12 woningen, 3 bouwvlakken EPSG'
             when 2 then ' building height: 250 m rear setback 0.2 parking 2 / unit; verdiepingshoogte: 3,2m plint' when 3 then ' bebouwingspercentage: 60% total area: 5000 sqm; toren of appartementen'
             when 4 then ' HÖHE: 21 target floor area 12,5 commercial ground floor, 40 mm' when 5 then ' FAR 2.5 floor space index: 1,8 plu recul hauteur emprise' else '' end text from {{part}}""",
    ),
    "fx_number": (
        "part",
        """select p_partkey id, case p_partkey % 8 when 0 then (p_partkey % 90) || ',500' when 1 then (p_partkey % 90) || '.500'
        when 2 then '1.' || (100 + p_partkey % 900) || ',5' when 3 then (p_partkey % 9) || ',5' when 4 then '1.2.3' when 5 then cast(p_size as string)
        when 6 then ' ' || p_size || ' 000' else 'none' end s from {part}""",
    ),
    "fx_zone": (
        "part",
        f"""select p_partkey id, {KEY} site, (p_partkey * 37) % 200 x0, (p_partkey * 53) % 150 y0,
        (p_partkey * 37) % 200 + (5 + p_size) * case when p_partkey % 5 = 0 then 4 else 1 end x1,
        (p_partkey * 53) % 150 + (5 + (p_partkey * 7) % 40) * case when p_partkey % 5 = 0 then 4 else 1 end y1,
        case p_partkey % 10 when 0 then 'buildable_envelope' when 1 then 'landscape_zone' when 3 then 'filled_zone' when 5 then 'buildable_envelope' when 6 then 'uncategorized_zone' else 'sub_zone' end zone_type,
        case p_partkey % 7 when 0 then 'Zone ' || (1 + p_partkey % 3) when 1 then 'Parkeerplaats' when 2 then 'Hoofdstraat' when 3 then '' when 4 then 'Blok ' || (p_partkey % 5) else null end label,
        p_partkey % 11 <> 0 closed, p_partkey % 3 colour, p_size size from {{part}}""",
    ),
    "fx_hatch": (
        "lineitem",
        "select l_orderkey * 10 + l_linenumber id, cast(floor(l_partkey / 20.0) as bigint) site, l_partkey * 7 % 200 + 1 x, l_suppkey * 13 % 150 + 1 y, cast(l_linenumber as bigint) colour from {lineitem}",
    ),
    "fx_vote": (
        "lineitem",
        """select l_orderkey id, l_linenumber % 3 agent_rank, min(case l_returnflag when 'A' then 'sub_zone' when 'N' then 'buildable_envelope' else 'artifact' end) zone_type,
        round(max(0.5 + l_discount * 4), 2) confidence from {lineitem} group by l_orderkey, l_linenumber % 3""",
    ),
    "fx_call": (
        "events",
        """select event_type stage, case event_id % 4 when 0 then 'gemini-2.5-pro' when 1 then 'gemini-2.5-flash-lite' when 2 then 'unknown' else null end model,
        1 + event_id % 5000 input_tokens, event_id % 700 output_tokens from {events}""",
    ),
    "fx_layer": (
        "orders",
        """select o_orderkey id, case o_orderkey % 8 when 0 then 'Rooilijn-' when 1 then 'A-SETBACK-' when 2 then 'No-Build ' when 3 then 'Kavelgrens ' when 4 then 'furniture '
        when 5 then 'Site_' when 6 then 'Vrijgebied ' else 'misc ' end || o_orderpriority layer, o_totalprice price, o_custkey % 360 a0, o_orderkey % 360 a1, o_custkey cx, o_orderkey cy from {orders}""",
    ),
    "fx_shape": (  # shapes of a page of 1000 x 1000; every fourth twice; fk and sk number fill and stroke colours
        "part",
        f"""select p_partkey + k * 1000000 id, {KEY} site, p_partkey % 7 <> 3 or p_partkey % 20 = 1 closed, case when p_partkey % 20 = 1 then 0 else (p_partkey * 37) % 600 end x0,
        case when p_partkey % 20 = 1 then 0 else (p_partkey * 53) % 500 end y0, case when p_partkey % 20 = 1 then 700 else (p_partkey * 37) % 600 + 2 + (p_size * 3) % 160 end x1,
        case when p_partkey % 20 = 1 then 600 else (p_partkey * 53) % 500 + 4 + (p_partkey * 7) % 110 end y1, case when p_partkey % 5 = 0 then 1 when p_partkey % 5 = 2 then 2 when p_partkey % 5 = 4 and p_size % 2 = 0 then 3 end fk,
        case when p_partkey % 9 = 2 then 1 when p_partkey % 9 = 4 then 2 when p_partkey % 9 <> 6 then 3 end sk, (p_size + k) % 4 / 3.0 width, case when p_partkey % 8 = 5 then 'chain_join' when p_partkey % 8 = 6 then 'planar_face' else 'direct' end strategy,
        4 + p_partkey % 5 n_points, p_size size from {{part}}, (select 0 k union all select 1 k) c where k = 0 or p_partkey % 4 = 0""",
    ),
    "fx_ptext": (
        "part",
        f"""select p_partkey id, {KEY} site, (p_partkey * 37) % 600 + 1.5 + p_partkey % 2 x, (p_partkey * 53) % 500 + 2.5 y, case p_partkey % 6 when 0 then 'GD' when 1 then 'V' when 2 then '[sba-' || p_size || ']' when 3 then 'tekst' when 4 then p_size || ',5' else ' ' end
        || chr(10) || case when p_partkey % 4 = 0 then '(m)' when p_partkey % 4 = 1 then cast(p_size as string) else 'x' end || chr(10) || case when p_partkey % 3 = 0 then '(sgd-' || (p_partkey % 9) || ')' else ' hoogte ' end text from {{part}}""",
    ),
    "fx_block": (  # sites of four envelopes, buildings in the first three, a plot and an oversized building
        "part",
        f"""select p_partkey id, {KEY} site, p_partkey % 20 k, case when p_partkey % 20 < 3 then 'buildable_envelope' when p_partkey % 20 = 3 then 'filled_zone' when p_partkey % 20 < 12 or p_partkey % 20 = 13 then 'sub_zone' when p_partkey % 20 = 12 then 'plot_boundary' else 'landscape_zone' end zone_type,
        case when p_partkey % 20 = 2 and p_partkey % 3 = 0 then 'Hoofdweg' when p_partkey % 20 < 4 then 'Blok ' || (p_partkey % 20) when p_partkey % 2 = 0 then 'Huis ' || p_size end label, p_partkey % 29 <> 7 closed,
        case when p_partkey % 20 < 4 then p_partkey % 20 * 200 when p_partkey % 20 < 12 then (p_partkey % 20) % 3 * 200 + 5 + cast(floor((p_partkey % 20 - 4) / 3.0) as int) * 18 else 0 end x0, case when p_partkey % 20 between 4 and 11 then 5 else 0 end y0,
        case when p_partkey % 20 < 4 then p_partkey % 20 * 200 + 60 + p_size * 2 when p_partkey % 20 < 12 then (p_partkey % 20) % 3 * 200 + 5 + cast(floor((p_partkey % 20 - 4) / 3.0) as int) * 18 + case when p_partkey % 9 = 0 then 3 else 10 + p_size % 6 end when p_partkey % 20 = 12 then 800 else 600 end x1,
        case when p_partkey % 20 < 4 then 80 + (p_partkey * 7) % 60 when p_partkey % 20 < 12 then 15 + p_partkey % 30 else 200 end y1, p_size size from {{part}}""",
    ),
    "fx_item": (  # drawing items of a path: pens that go on, move a little or far, and kinds that are not known
        "lineitem",
        """select page, path, seq, kind, px + case seq % 3 when 0 then 0.25 when 1 then 0 else 3 end ax, py + case seq % 4 when 0 then 0.5 else 0 end ay, case kind when 'c' then px + 5 when 'qu' then px + 9 else qx end bx,
        case kind when 'c' then py - 3 when 'qu' then py + 4 else qy end by_, case kind when 'c' then qx + 2 else qx end cx, case kind when 'c' then qy - 8 else qy end cy, qx dx, qy dy, stroke from (
        select page, path, seq, stroke, case (pk + seq) % 7 when 0 then 'c' when 1 then 'qu' when 2 then 're' when 3 then 'arc' else 'l' end kind, cast((path * 7 + seq * 13) % 200 as double) px, cast((path * 3 + seq * 29) % 150 as double) py,
        cast((path * 7 + (seq + 1) * 13) % 200 as double) qx, cast((path * 3 + (seq + 1) * 29) % 150 as double) qy from (
        select l_orderkey % 50 page, l_orderkey path, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) seq, l_partkey pk, l_suppkey % 3 stroke from {lineitem}) a) b""",
    ),
    "fx_ell": (  # boxes of a site, two of three with their upper right corner cut out
        "part",
        f"""select site, id, x0, y0, x1, y1, x0 + cast(floor((x1 - x0) / 2.0) as int) nx, y0 + cast(floor((y1 - y0) / 3.0) as int) ny, notch from (
        select {KEY} site, p_partkey id, cast((p_partkey * 37) % 40 as int) x0, cast((p_partkey * 53) % 30 as int) y0, cast((p_partkey * 37) % 40 + 4 + p_size % 12 as int) x1, cast((p_partkey * 53) % 30 + 4 + (p_partkey * 7) % 11 as int) y1, p_partkey % 3 <> 0 notch from {{part}}) a""",
    ),
    "fx_plot": (  # a plot with a notch for each site
        "part",
        f"select {KEY} site, 2 x0, 1 y0, 50 x1, 40 y1, 30 nx, 25 ny, true notch from {{part}} group by {KEY}",
    ),
    "fx_mark": (
        "lineitem",
        "select cast(floor(l_partkey / 20.0) as bigint) site, l_orderkey * 10 + l_linenumber id, (l_partkey * 7 + l_linenumber * 11) % 52 + 0.5 x, (l_suppkey * 13 + l_linenumber * 5) % 44 + 0.25 y, cast(l_linenumber as bigint) colour from {lineitem}",
    ),
    "fx_knot": (
        "part",
        f"select {KEY} site, p_partkey id, case p_partkey % 5 when 0 then 'bow' when 1 then 'spike' when 2 then 'twice' when 3 then 'flat' else 'box' end kind, 4 + p_size % 12 w, 3 + p_partkey % 8 h, (1 + p_partkey % 4) / 5.0 s from {{part}}",
    ),
    "fx_rule": (  # constraints of a site; every fourth site has no setbacks
        "part",
        f"""select {KEY} site, p_partkey id, case when p_partkey % 3 = 0 then 'height' when p_partkey % 3 = 1 and cast(floor(p_partkey / 20.0) as int) % 4 <> 0 then 'setback' else 'parking' end category,
        case p_size % 4 when 0 then 'Front line' when 1 then 'Achter grens' when 2 then 'zijdelings' else 'Setback' end nm, cast(p_size as double) v from {{part}}""",
    ),
    "fx_label": (
        "part",
        """select p_partkey id, case p_partkey % 6 when 0 then 'GD' when 1 then 'V' when 2 then 'WR-A' else 'x' end || chr(10) || case p_partkey % 5 when 0 then '(sgd-' || (p_partkey % 9) || ')'
        when 1 then '[sba-' || p_size || ']' when 2 then '(m)' else ' ' end || chr(10) || case p_partkey % 4 when 0 then p_size || ',5' when 1 then cast(p_size as string) else 'tekst' end txt from {part}""",
    ),
}


def sql(name: str) -> str:
    """The view as a DuckDB query."""
    table, text = VIEWS[name]
    return text.format(**{table: table})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, text = VIEWS[name]
    return spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})
