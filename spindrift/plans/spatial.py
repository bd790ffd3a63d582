"""Queries over points, rasters, names and polygons of the fixture network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import names, raster, spatial, topology
from ..sources.fixtures import table, view, with_views
from .network import q, s
from .registry import query

# Least upstream area of a name, by zoom.
REVEAL = {3: 300000, 4: 100000, 5: 40000, 6: 15000, 7: 5000, 8: 1500, 9: 500, 10: 150, 11: 40, 12: 0}

# Projections


@query(with_views("reach") + "select id, cast(floor(x1*100e0+0.5) as bigint) as x, cast(floor(y1*100e0+0.5) as bigint) as y from reach")
def p2_quantise(spark, d):
    return view(spark, d, "reach").select("id", geo.round_half_up(F.col("x1") * 100.0).cast("long").alias("x"), geo.round_half_up(F.col("y1") * 100.0).cast("long").alias("y"))


@query(with_views("reach") + f"select id, {q('(x1+180)/360')} as mx, {q('0.5-ln((1+sin(radians(y1)))/(1-sin(radians(y1))))/(4*pi())')} as my, {q('degrees(atan((exp(pi()*(1-2*(0.5+id/100000e0)))-exp(-pi()*(1-2*(0.5+id/100000e0))))/2))')} as lat from reach")
def p4_mercator(spark, d):
    r = view(spark, d, "reach")
    return r.select("id", s(geo.mercator_x("x1")).alias("mx"), s(geo.mercator_y("y1")).alias("my"), s(geo.mercator_lat(F.lit(0.5) + F.col("id") / 100000)).alias("lat"))


@query(with_views("reach") + f"select id, {q('0.5+4.5*least(1,greatest(0,(log10(greatest(up,10))-1)/(log10(3000000)-1)))')} as miles from reach")
def p6_corridor_width(spark, d):
    return view(spark, d, "reach").select("id", s(geo.corridor_miles("up")).alias("miles"))


@query(with_views("reach") + "select id, case when x1+9 < -69.95 then 'Río Amazonas' when x1+9 < -59.902 then 'Rio Solimões' else 'Rio Amazonas' end as name from reach")
def p7_stem_name(spark, d):
    return view(spark, d, "reach").select("id", geo.stem_name(F.col("x1") + 9).alias("name"))


@query(with_views("reach") + "select id, case " + " ".join(f"when up/10 >= {t} then {max(3, z - 1)}" for z, t in sorted(REVEAL.items())) + " else 11 end as minz from reach")
def p8_reveal_zoom(spark, d):
    return view(spark, d, "reach").select("id", geo.reveal_zoom(F.col("up") / 10, REVEAL).alias("minz"))


_GLOW = "(0.3e0+0.7e0*least(1e0,greatest(0e0,log10(pop/2000e0)/log10(1100e0))))"
_RADIUS = "(6.5e0*cbrt(pop/2000e0))"


@query(with_views("place") + f"select id, {q(_GLOW)} as strength, {q(_RADIUS)} as radius, {q(_RADIUS + '*ln(' + _GLOW + '/0.005e0)', '1000e0')} as reach_m from place")
def p9_glow_params(spark, d):
    p = view(spark, d, "place").withColumn("st", geo.glow_strength("pop")).withColumn("r", geo.glow_radius_km("pop"))
    return p.select("id", s("st").alias("strength"), s("r").alias("radius"), s(F.col("r") * F.ln(F.col("st") / 0.005), 1e3).alias("reach_m"))


@query(with_views("reach") + f"select id, case when stra > 2 and len > 0 then {q('(up-100000)/len', '100e0')} end as gradient, case when up < 100000 then {q('up', '100e0')} else {q('up', '1e0')}*100 end as discharge from reach")
def p10_gradient(spark, d):
    r = view(spark, d, "reach")
    return r.select("id", F.when((F.col("stra") > 2) & (F.col("len") > 0), s((F.col("up") - 100000) / F.col("len"), 100)).alias("gradient"), F.when(F.col("up") < 100000, s("up", 100)).otherwise(s("up", 1) * 100).alias("discharge"))


@query(with_views("place") + "select id, case when pop >= 100000 then 'city' else 'town' end as kind, concat(cast(cc as varchar), '|', name) as rid, split_part(concat(cast(cc as varchar), '|', name), '|', 1) as mouth, substr(concat(cast(cc as varchar), '|', name), instr(concat(cast(cc as varchar), '|', name), '|') + 1) as river from place")
def p11_p13_p14_keys(spark, d):
    rid = F.concat(F.col("cc").cast("string"), F.lit("|"), F.col("name"))
    p = view(spark, d, "place").withColumn("rid", rid)
    return p.select("id", F.when(F.col("pop") >= 100000, "city").otherwise("town").alias("kind"), "rid", F.substring_index("rid", "|", 1).alias("mouth"), F.expr("substr(rid, instr(rid, '|') + 1)").alias("river"))


@query(with_views("way") + "select id, coalesce(nullif(case when id%3=0 then '' else name end, ''), case when id%2=0 then kind end, 'unnamed') as shown from way")
def p12_default_chain(spark, d):
    w = view(spark, d, "way")
    own = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("name"))
    return w.select("id", F.coalesce(F.nullif(own, F.lit("")), F.when(F.col("id") % 2 == 0, F.col("kind")), F.lit("unnamed")).alias("shown"))


@query(with_views("reach") + f"select id, {q('0.05*greatest(3, coalesce(case when stra<>5 then stra end, 3))')} as opacity, {q('(id%100)/99e0')} as tint from reach")
def p15_style(spark, d):
    order = F.coalesce(F.when(F.col("stra") != 5, F.col("stra")), F.lit(3))
    return view(spark, d, "reach").select("id", s(F.greatest(F.lit(3), order) * 0.05).alias("opacity"), s((F.col("id") % 100) / 99).alias("tint"))


@query(with_views("place") + "select id, case when pop >= 1000 then concat(cast(pop//1000 as varchar), ',', lpad(cast(pop%1000 as varchar), 3, '0')) else cast(pop as varchar) end as population, case when cc = 3 then 'N/A' else concat(cast(cc as varchar), ' km') end as distance from place")
def p16_display(spark, d):
    return view(spark, d, "place").select("id", F.format_number("pop", 0).alias("population"), F.when(F.col("cc") == 3, "N/A").otherwise(F.concat(F.format_number("cc", 0), F.lit(" km"))).alias("distance"))


@query(with_views("place") + f"select id, {q('cos(radians(lat))*40075000/(512*pow(2,5+id%6))', '1000e0')} as mm_per_px from place")
def p17_ground_resolution(spark, d):
    return view(spark, d, "place").select("id", s(geo.metres_per_pixel("lat", 5 + F.col("id") % 6), 1e3).alias("mm_per_px"))


# Filters


@query(with_views("place") + "select id from place where lon between -79 and -77.5 and lat between -19.5 and -18 and cc in (1, 3, 5, 7, 9) and pop >= 50000")
def f1_f5_f6_filters(spark, d):
    return view(spark, d, "place").where(F.col("lon").between(-79, -77.5) & F.col("lat").between(-19.5, -18) & F.col("cc").isin(1, 3, 5, 7, 9) & (F.col("pop") >= 50000)).select("id")


@query(with_views("way") + "select id from way where regexp_matches(kind, '^(ECONOMY|PROMO|SMALL)') and name is not null and name <> ' ' and name like '%a%'")
def f2_f3_tag_filters(spark, d):
    return view(spark, d, "way").where(F.col("kind").rlike("^(ECONOMY|PROMO|SMALL)") & F.col("name").isNotNull() & (F.col("name") != " ") & F.col("name").like("%a%")).select("id")


@query(with_views("reach") + "select z.z as zoom, count(*) as n from (values " + ", ".join(f"({z}, {t})" for z, t in REVEAL.items()) + ") z(z, t) join reach r on r.up >= z.t group by 1")
def f11_threshold_by_zoom(spark, d):
    zooms = spark.createDataFrame(sorted(REVEAL.items()), "zoom int, t long")
    r = view(spark, d, "reach").select("up")
    return r.withColumn("zoom", F.explode(F.array(*[F.when(F.col("up") >= t, F.lit(z)) for z, t in sorted(REVEAL.items())]))).where("zoom is not null").groupBy("zoom").agg(F.count("*").alias("n")).join(F.broadcast(zooms.select("zoom")), "zoom")


# Spatial joins

_DIST = "sqrt(pow(ax+t*dx,2)+pow(ay+t*dy,2))*111.32e0"


def _cand(points: str, r: str) -> str:
    return (
        f"c0 as (select p.*, r.id, r.up, cos(radians(p.lat)) as c, r.x1, r.y1, r.x2, r.y2 from {points} p join reach r on floor(least(r.x1,r.x2)/0.05e0) <= floor((p.lon+{r}/111.32e0)/0.05e0) and floor(greatest(r.x1,r.x2)/0.05e0) >= floor((p.lon-{r}/111.32e0)/0.05e0) and floor(least(r.y1,r.y2)/0.05e0) <= floor((p.lat+{r}/111.32e0)/0.05e0) and floor(greatest(r.y1,r.y2)/0.05e0) >= floor((p.lat-{r}/111.32e0)/0.05e0)), "
        "c1 as (select *, (x1-lon)*c as ax, y1-lat as ay, (x2-x1)*c as dx, y2-y1 as dy from c0), c2 as (select *, case when dx*dx+dy*dy > 0 then greatest(0e0, least(1e0, -(ax*dx+ay*dy)/(dx*dx+dy*dy))) else 0e0 end as t from c1), "
        f"cand as (select *, {_DIST} as km from c2)"
    )


_POINTS = "pts as (select id as pid, lon, lat, pop*1e0 as target from place)"


def _points(spark, d):
    return view(spark, d, "place").select(F.col("id").alias("pid"), "lon", "lat", F.col("pop").cast("double").alias("target"))


@query(with_views("reach", "place", more=_POINTS + ", " + _cand("pts", "1.5e0")) + f"select pid, id, {q('km', '1000e0')} as metres from (select *, row_number() over (partition by pid order by km, id) as rn from cand) where rn = 1 and km <= 1.5")
def j8_nearest(spark, d):
    return spatial.nearest(_points(spark, d), view(spark, d, "reach"), 1.5).select("pid", "id", s("km", 1e3).alias("metres"))


@query(with_views("reach", "place", more=_POINTS + ", " + _cand("pts", "6e0")) + f"select pid, id, {q('up', '100e0')} as up_c from (select *, row_number() over (partition by pid order by up desc, id) as rn from cand where km <= 6) where rn = 1")
def j9_largest(spark, d):
    return spatial.largest_within(_points(spark, d), view(spark, d, "reach"), 6.0).select("pid", "id", s("up", 100).alias("up_c"))


@query(with_views("reach", "place", more=_POINTS + ", " + _cand("pts", "3e0")) + "select pid, id from (select *, row_number() over (partition by pid order by abs(ln(up)-ln(target)), id) as rn from cand where km <= 3 and abs(ln(up)-ln(target)) < ln(4)) where rn = 1")
def j10_best_size(spark, d):
    return spatial.closest_size_within(_points(spark, d), view(spark, d, "reach")).select("pid", "id")


def _hits(r: str, n: str) -> str:
    c = _cand("smp", r).replace("c0 as", f"c0{n} as").replace("from c0)", f"from c0{n})").replace("c1 as", f"c1{n} as").replace("from c1)", f"from c1{n})").replace("c2 as", f"c2{n} as").replace("from c2)", f"from c2{n})").replace("cand as", f"cand{n} as")
    return c + f", h{n} as (select line, count(*) as h, list_sort(list(up)) as ups from (select *, row_number() over (partition by pid order by km, id) as rn from cand{n}) where rn = 1 and km <= {r} group by 1)"


@query(with_views("reach", "place", more="smp as (select id as pid, id//4 as line, lon, lat from place), nd as (select line, greatest(1, count(*)/2e0) as need from smp group by 1), " + _hits("1.5e0", "a") + ", " + _hits("6e0", "b")) + "select nd.line, case when ha.h >= need then ha.h else hb.h end as hits, " + q("case when ha.h >= need then ha.ups[len(ha.ups)//2+1] else hb.ups[len(hb.ups)//2+1] end", "100e0") + " as median_c, not coalesce(ha.h >= need, false) as wide from nd left join ha on ha.line = nd.line left join hb on hb.line = nd.line where coalesce(ha.h >= need, false) or coalesce(hb.h >= need, false)")
def j11_fallback(spark, d):
    p = view(spark, d, "place").select(F.col("id").alias("pid"), F.floor(F.col("id") / 4).cast("long").alias("line"), "lon", "lat")
    return spatial.nearest_with_fallback(p, view(spark, d, "reach")).select("line", "hits", s("median_up", 100).alias("median_c"), "wide")


@query(with_views("reach", "place") + "select id from place p where exists (select 1 from reach r where abs(floor(r.x1/0.15e0)-floor(p.lon/0.15e0)) <= 1 and abs(floor(r.y1/0.15e0)-floor(p.lat/0.15e0)) <= 1 and r.up > 450000)")
def j13_near_semi(spark, d):
    v = view(spark, d, "reach").where("up > 450000").select(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return spatial.near_vertices(view(spark, d, "place"), v).select("id")


_J14 = "v as (select id%40 as rid, x1 as x, y1 as y, up from reach), d as (select p.id as pid, v.rid, v.up, sqrt(pow((v.x-p.lon)*cos(radians(p.lat)),2)+pow(v.y-p.lat,2))*111.32e0 as km from place p join v on abs(v.y-p.lat) < 0.6 and abs(v.x-p.lon) < 0.7), b as (select pid, rid, min(km) as km, max(up) as up from d where km <= 60 group by 1, 2)"


@query(with_views("reach", "place", more=_J14) + f"select pid, rid, {q('km', '10e0')} as km10 from (select *, row_number() over (partition by pid order by case when km <= 10 then 0 else 1 end, case when km <= 10 then -(case when rid%4=0 then 0 else up end) else km end, rid) as rn from b) where rn = 1")
def j14_named_river(spark, d):
    river = F.when(F.col("id") % 4 == 0, F.concat(F.lit("igarapé "), F.col("id") % 40)).otherwise(F.concat(F.lit("rio "), F.col("id") % 40))
    v = view(spark, d, "reach").select((F.col("id") % 40).alias("rid"), river.alias("river"), F.col("x1").alias("x"), F.col("y1").alias("y"), "up")
    p = view(spark, d, "place").select(F.col("id").alias("pid"), "lon", "lat")
    return spatial.named_river(p, v).select("pid", "rid", s("km", 10).alias("km10"))


@query(with_views("reach", "place", more=f"t as (select lon, lat, {_GLOW} as s, {_RADIUS} as r, cos(radians(lat)) as c from place), u as (select *, r*ln(s/0.005e0)/111.32e0 as reach from t), g as (select a.id as pid, max(u.s*exp(-(sqrt(pow((a.x1-u.lon)*u.c,2)+pow(a.y1-u.lat,2))*111.32e0)/u.r)) as g from reach a join u on abs(a.y1-u.lat) <= u.reach and abs((a.x1-u.lon)*u.c) <= u.reach group by 1)") + "select a.id as pid, cast(least(99, floor(coalesce(g.g,0)*99+0.5)) as bigint) as level from reach a left join g on g.pid = a.id")
def j15_remoteness(spark, d):
    points = view(spark, d, "reach").select(F.col("id").alias("pid"), F.col("x1").alias("lon"), F.col("y1").alias("lat"))
    return spatial.remoteness(points, view(spark, d, "place"))


@query()
def j16_greedy_dedupe(spark, d):
    return spatial.greedy_dedupe(view(spark, d, "place"), 3.0)


@query(with_views("place") + "select a.id as high, b.id as low from place a join place b on (a.pop > b.pop or a.pop = b.pop and a.id < b.id) and sqrt(pow((b.lon-a.lon)*cos(radians((a.lat+b.lat)/2)),2)+pow(b.lat-a.lat,2))*111.32e0 < 3")
def j16_close_pairs(spark, d):
    return spatial.pairs_within(view(spark, d, "place").withColumn("rank", F.struct(-F.col("pop"), "id")), 3.0)


@query(with_views("way", more="k as (select id, lower(replace(name, ' ', '')) as key, id%60 as gx, id%7 as gy from way)") + "select distinct a.id as aid, b.id as bid from k a join k b on a.id < b.id and abs(a.gx-b.gx) <= 1 and abs(a.gy-b.gy) <= 1 and (a.key = b.key or levenshtein(a.key, b.key) <= case when least(length(a.key), length(b.key)) >= 9 then 2 when least(length(a.key), length(b.key)) >= 5 then 1 else 0 end)")
def j17_fuzzy_names(spark, d):
    w = view(spark, d, "way").select("id", "name", (F.col("id") % 60).alias("gx"), (F.col("id") % 7).alias("gy"))
    return names.near_same_names(w, w).where("aid < bid")


@query(with_views("way") + "select least(start_node, end_node) as lo, greatest(start_node, end_node) as hi, count(distinct name) as owners from way group by 1, 2 having count(distinct name) >= 2")
def j18_shared_edges(spark, d):
    return topology.shared_edges(view(spark, d, "way").select(F.col("name").alias("owner"), F.col("start_node").alias("a"), F.col("end_node").alias("b")))


@query(with_views("place", "reach") + "select id, priority from (select id, priority, row_number() over (order by priority, id) as rn from (select id, 0 as priority from place where lon between -79 and -78.9 and lat between -19.5 and -19.4 union all select id, 1 from reach where x1 between -79 and -78.9 and y1 between -19.5 and -19.4)) where rn <= 5")
def j22_hit_test(spark, d):
    box = lambda t, x, y, p: t.where(F.col(x).between(-79, -78.9) & F.col(y).between(-19.5, -19.4)).select("id", F.lit(p).alias("priority"))
    both = box(view(spark, d, "place"), "lon", "lat", 0).unionByName(box(view(spark, d, "reach"), "x1", "y1", 1))
    return both.orderBy("priority", "id").limit(5)


# Rasters

_W = "case when q < 14 then cast(floor(255e0*least(1e0, greatest(0e0, 0.52e0*14-q))+0.5) as bigint) else 0 end"
_PYR = f"w as (select cx, cy, {_W} as cnt from cell), pyr as (select l.range as level, cast(floor(cx/pow(2, l.range)) as bigint) as cx, cast(floor(cy/pow(2, l.range)) as bigint) as cy, cast(sum(cnt) as bigint) as cnt from w, range(4) l where cnt > 0 group by 1, 2, 3)"


@query(with_views("cell") + f"select cx, cy, {_W} as weight from cell")
def r7_weights(spark, d):
    return view(spark, d, "cell").select("cx", "cy", raster.weight("q", 0.52).alias("weight"))


@query(with_views("cell") + "select cx, cy from cell where q <= 7 or q = 14 and false")
def r8_outline_depth(spark, d):
    return view(spark, d, "cell").where(raster.visible_depth("q", 0.52)).select("cx", "cy")


@query(with_views("cell", more=_PYR) + "select cast(level as int) as level, cx, cy, cnt from pyr")
def r9_pyramid(spark, d):
    return raster.pyramid(view(spark, d, "cell"), 0.52, 3)


_NEED = {k: raster.need(k, 0.52) for k in range(4)}
_ON = _PYR + ", vis as (select level, cx, cy from pyr where cnt >= case " + " ".join(f"when level = {k} then {v}" for k, v in _NEED.items()) + " end)"


@query(with_views("cell", more=_ON) + "select cast(level as int) as level, cx, cy from vis")
def r10_visible(spark, d):
    return raster.visible(raster.pyramid(view(spark, d, "cell"), 0.52, 3), 0.52, 3).select("level", "cx", "cy")


_B = ", on1 as (select cx, cy from vis where level = 1), nb as (select cx, cy+1 as cy, 1 as b, cx as ox, cy as oy from on1), tell as (select cx, cy, 16 as b from on1 union all select cx, cy+1, 1 from on1 union all select cx, cy-1, 2 from on1 union all select cx+1, cy, 4 from on1 union all select cx-1, cy, 8 from on1), m as (select cx, cy, bit_or(b) as m from tell group by 1, 2), br as (select cx, cy, (case when m&5 = 5 then 1 else 0 end)+(case when m&9 = 9 then 2 else 0 end)+(case when m&6 = 6 then 4 else 0 end)+(case when m&10 = 10 then 8 else 0 end) as flags from m where m&16 = 0)"


def _level1(spark, d):
    return raster.visible(raster.pyramid(view(spark, d, "cell"), 0.52, 3), 0.52, 3).where("level = 1").select("cx", "cy")


@query(with_views("cell", more=_ON + _B) + "select cx, cy, flags from br where flags > 0")
def r13_bridges(spark, d):
    return raster.bridges(_level1(spark, d))


@query(with_views("cell", more=_ON + _B) + "select cx-16 as i, cy-16 as j, 1 as visible, 0 as flags from on1 where cx between 15 and 32 and cy between 15 and 32 union all select cx-16, cy-16, 0, flags from br where flags > 0 and cx between 16 and 31 and cy between 16 and 31")
def r12_coverage(spark, d):
    return raster.coverage(_level1(spark, d), 16, 16, 16)


@query(with_views("cell", more=_ON + _B) + "select tx, ty, cast(sum(a) as bigint) as n_on, cast(sum(b) as bigint) as n_bridged, sum(a) = 64 as full from (select cast(floor(cx/8e0) as bigint) as tx, cast(floor(cy/8e0) as bigint) as ty, 1 as a, 0 as b from on1 union all select cast(floor(cx/8e0) as bigint), cast(floor(cy/8e0) as bigint), 0, 1 from br where flags > 0) group by 1, 2")
def a16_tile_flags(spark, d):
    return raster.tile_flags(_level1(spark, d), 8)


@query(with_views("cell") + "select distinct cast(floor(cx/2e0) as bigint) as cx, cast(floor(cy/2e0) as bigint) as cy from cell where q < 3")
def r3_coarsen(spark, d):
    return raster.coarsen(view(spark, d, "cell").where("q < 3"))


@query(with_views("cell") + "select distinct cx+a.range-2 as cx, cy+b.range-2 as cy from cell, range(5) a, range(5) b where q < 2")
def r4_dilate(spark, d):
    return raster.dilate(view(spark, d, "cell").where("q < 2"), 2)


_FLOOD = "blk as (select distinct cx, cy from cell where q < 4), fr as (select a.range as cx, b.range as cy from range(128) a, range(128) b where not exists (select 1 from blk where blk.cx = a.range and blk.cy = b.range)), fl as (select cx, cy from fr where cx in (0, 127) or cy in (0, 127) union select f.cx, f.cy from fl join (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dy) on true join fr f on f.cx = fl.cx+o.dx and f.cy = fl.cy+o.dy)"


@query(with_views("cell", more=_FLOOD, recursive=True) + "select cx, cy from fl")
def r5_flood(spark, d):
    return raster.exterior(view(spark, d, "cell").where("q < 4"), 0, 127, 0, 127)


_INTERIOR = "cb as (select distinct cast(floor((cast(floor(cx/2e0) as bigint)+a.range-2)) as bigint) as cx, cast(floor(cy/2e0) as bigint)+b.range-2 as cy from cell, range(5) a, range(5) b where q < 2), fr as (select a.range as cx, b.range as cy from range(64) a, range(64) b where not exists (select 1 from cb where cb.cx = a.range and cb.cy = b.range)), fl as (select cx, cy from fr where cx in (0, 63) or cy in (0, 63) union select f.cx, f.cy from fl join (values (0, 1), (0, -1), (1, 0), (-1, 0)) o(dx, dy) on true join fr f on f.cx = fl.cx+o.dx and f.cy = fl.cy+o.dy)"


@query(with_views("cell", more=_INTERIOR, recursive=True) + "select a.range as cx, b.range as cy from range(128) a, range(128) b where not exists (select 1 from cell c where c.q < 2 and c.cx = a.range and c.cy = b.range) and not exists (select 1 from fl where fl.cx = a.range//2 and fl.cy = b.range//2)")
def r5_interior(spark, d):
    return raster.interior(view(spark, d, "cell").where("q < 2"), 0, 127, 0, 127)


@query(with_views("cell") + "select (cy*128+cx)//2 as byte_no, cast(bit_and(case when cx%2 = 0 then q*16+15 else 240+q end) as int) as byte from cell group by 1")
def r6_pack4(spark, d):
    return raster.pack_nibbles(view(spark, d, "cell"), 0, 0, 128)


@query(with_views("cell") + "select cx, cy, q from cell")
def r6_unpack4(spark, d):
    return raster.unpack_nibbles(raster.pack_nibbles(view(spark, d, "cell"), 0, 0, 128), 0, 0, 128)


_R1 = "sg as (select (x1+80)*20 as x1, (y1+20)*20 as y1, (x2+80)*20 as x2, (y2+20)*20 as y2, greatest(0.75e0, up/200000) as rr from reach), g as (select s.*, a.range as cx, b.range as cy from sg s join range(-10, 80) a on a.range between floor(least(x1,x2)-rr) and floor(greatest(x1,x2)+rr) join range(-10, 70) b on b.range between floor(least(y1,y2)-rr) and floor(greatest(y1,y2)+rr)), h as (select *, cx+0.5e0 as px, cy+0.5e0 as py, x2-x1 as dx, y2-y1 as dy from g), k as (select *, case when dx*dx+dy*dy > 0 then greatest(0e0, least(1e0, ((px-x1)*dx+(py-y1)*dy)/(dx*dx+dy*dy))) else 0e0 end as t from h), l as (select *, (x1+t*dx-px)*(x1+t*dx-px)+(y1+t*dy-py)*(y1+t*dy-py) as d2 from k)"


@query(with_views("reach", more=_R1) + "select cx, cy, cast(min(least(13, floor(sqrt(d2)/rr*14))) as int) as q from l where d2 <= rr*rr group by 1, 2")
def r1_rasterise(spark, d):
    r = view(spark, d, "reach")
    seg = r.select(((F.col("x1") + 80) * 20).alias("x1"), ((F.col("y1") + 20) * 20).alias("y1"), ((F.col("x2") + 80) * 20).alias("x2"), ((F.col("y2") + 20) * 20).alias("y2"), (F.col("up") / 200000).alias("r"))
    return raster.rasterise(seg)


@query(with_views("cell", more="o as (select cx, cy from cell where q < 3), e as (select cx as ax, cy as ay, cx+1 as bx, cy as by_ from o union all select cx+1, cy, cx+1, cy+1 from o union all select cx+1, cy+1, cx, cy+1 from o union all select cx, cy+1, cx, cy from o)") + "select e.ax, e.ay, e.bx, e.by_ from e left join e f on f.ax = e.bx and f.ay = e.by_ and f.bx = e.ax and f.by_ = e.ay where f.ax is null")
def j19_boundary_edges(spark, d):
    on = view(spark, d, "cell").where("q < 3").select("cx", "cy")
    square = F.array(*[F.struct((F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    return raster.boundary_edges(on.select(square.alias("ring"))).withColumnRenamed("by", "by_")


@query(with_views("cell", more=_ON + _B + ", sh as (select cx, cy, 0 as flags from on1 union all select cx, cy, flags from br where flags > 0), pg as (select *, flags in (3, 5, 10, 12) as five, flags in (1, 2, 4, 8) as three from sh)") + "select cx, cy, case when three then 3 when five then 5 else 4 end as corners, case when three then 6*cx + 2*(case flags when 1 then 1 when 2 then 2 when 4 then 1 else 2 end) when five then 10*cx+5 else 8*cx+4 end as twice_x, case when three then 6*cy + 2*(case flags when 1 then 1 when 2 then 1 when 4 then 2 else 2 end) when five then 10*cy+5 else 8*cy+4 end as twice_y from pg")
def r14_bridge_polygons(spark, d):
    twice = lambda axis: F.aggregate("ring", F.lit(0.0), lambda t, p: t + 2 * p[axis]).cast("long")
    return raster.outline_polygons(_level1(spark, d)).select("cx", "cy", F.size("ring").alias("corners"), twice("x").alias("twice_x"), twice("y").alias("twice_y"))


@query()
def g12_rings(spark, d):
    return topology.trace_rings(topology.by_component(raster.boundary_edges(raster.outline_polygons(_level1(spark, d)))))


@query()
def g10_chain_ways(spark, d):
    return topology.chain_ways(view(spark, d, "way").withColumn("seq", F.col("id")))


@query()
def g11_border_lines(spark, d):
    e = view(spark, d, "way").select(F.col("start_node").cast("double").alias("ax"), F.lit(0.0).alias("ay"), F.col("end_node").cast("double").alias("bx"), F.lit(0.0).alias("by"))
    return topology.chain_edges(topology.by_component(e))


# Set operations


@query(with_views("way", more="s as (select id, name, 0 as prio from way where kind like 'PROMO%' union all select id, upper(name), 1 from way where kind not like 'SMALL%')") + "select id, name, prio from (select *, row_number() over (partition by id order by prio) as rn from s) where rn = 1")
def u1_priority_union(spark, d):
    w = view(spark, d, "way").select("id", "name", "kind", F.col("id").alias("seq"))
    return names.priority_union(w.where("kind like 'PROMO%'").drop("kind"), w.where("kind not like 'SMALL%'").drop("kind").withColumn("name", F.upper("name")))


@query(with_views("way") + "select name, min(id) as id from way group by 1")
def u2_dedupe(spark, d):
    return view(spark, d, "way").groupBy("name").agg(F.min("id").alias("id"))


@query("select 'c' as src, count(*) as n from customer union all select 's', count(*) from supplier")
def u3_union_all(spark, d):
    c, p = table(spark, d, "customer").select(F.lit("c").alias("src")), table(spark, d, "supplier").select(F.lit("s").alias("src"))
    return c.unionByName(p).groupBy("src").agg(F.count("*").alias("n"))


_U4 = "f as (select path_id, seq, x, y, up <= 30000 as ok from path_vertex), g as (select path_id, seq, x, y, seq - row_number() over (partition by path_id order by seq) as grp from f where ok), k as (select path_id, grp, seq, sqrt(pow((lead(x) over w - x)*cos(radians(lead(y) over w)),2)+pow(lead(y) over w - y,2))*111.32e0 as km from g window w as (partition by path_id, grp order by seq))"


@query(with_views("path_vertex", more=_U4) + f"select path_id, min(seq) as first, max(seq) as last, count(*) as n, cast(sum({q('km', '1000e0')}) as bigint) as metres from k group by path_id, grp having count(*) >= 2 and sum({q('km', '1000e0')}) >= 1000")
def u4_gap_fill(spark, d):
    v = view(spark, d, "path_vertex")
    return names.uncovered(v.select("path_id", "seq", "x", "y"), v.where("up > 30000").select("path_id", "seq"))


@query(with_views("reach", "claim") + "select case when rid%3 = 0 then rid-rid%30 else rid end as into_rid, count(distinct id) as n from claim group by 1")
def u5_absorb(spark, d):
    into = F.when(F.col("rid") % 3 == 0, F.col("rid") - F.col("rid") % 30).otherwise(F.col("rid"))
    return view(spark, d, "claim").groupBy(into.alias("into_rid")).agg(F.count_distinct("id").alias("n"))


@query(with_views("way", more="m as (select id as way, case when id%4 = 0 then '' when id%4 = 1 then name end as own from way), rel as (select id as seq, kind as name, unnest([id, id+1, id+7]) as way from way where kind like 'PROMO%'), f as (select way, name from (select way, name, row_number() over (partition by way order by seq) as rn from rel) where rn = 1)") + "select m.way, coalesce(nullif(m.own, ''), f.name) as name from m left join f on f.way = m.way where coalesce(nullif(m.own, ''), f.name) is not null")
def j7_relation_names(spark, d):
    w = view(spark, d, "way")
    members = w.select(F.col("id").alias("way"), F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.col("name")).alias("own"))
    relations = w.where("kind like 'PROMO%'").select(F.col("id").alias("seq"), F.col("kind").alias("name"), F.array("id", F.col("id") + 1, F.col("id") + 7).alias("ways"))
    return names.name_members(members, relations)


@query(with_views("way") + "select id from way w where not exists (select 1 from (select min(id) as lo, min(id)+60 as hi from way group by id//100) c where w.id between c.lo and c.hi)")
def u7_finished_chunks(spark, d):
    w = view(spark, d, "way").select("id")
    chunk = F.floor(F.col("id") / 100)
    done = w.groupBy(chunk.alias("chunk")).agg(F.min("id").alias("lo"), (F.min("id") + 60).alias("hi"))
    return w.withColumn("own", chunk).join(done, (F.col("own") == F.col("chunk")) & F.col("id").between(F.col("lo"), F.col("hi")), "left_anti").select("id")
