"""Queries over parts, rings, tiles, frames and dimension tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, seq, text, water
from ..operators import sequences, shapes
from ..sources import sinks
from ..sources.fixtures import table, view, with_views
from .network import q, s
from .registry import query

_LINE = "ln as (select path_id, seq, x, y from path_vertex)"


@query(with_views("path_vertex") + "select concat('ana', cast(path_id as varchar), case when (seq-1)//3 > 0 then concat('_', cast((seq-1)//3 as varchar)) else '' end) as id, count(*) as n from path_vertex group by path_id, (seq-1)//3 having count(*) >= 2")
def p3_f4_single_parts(spark, d):
    v = view(spark, d, "path_vertex").withColumn("part", F.floor((F.col("seq") - 1) / 3))
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    parts = v.groupBy("path_id", "part").agg(line.alias("c")).groupBy(F.col("path_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "c"))), lambda p: p["c"]).alias("parts"))
    return shapes.single_parts(parts, prefix="ana").select("id", F.size("c").cast("long").alias("n"))


@query(with_views("path_vertex") + "select path_id, count(*) as n, max(case when seq = 1 then floor(x*1000e0+0.5) end) as first_x from path_vertex group by 1")
def p3_flattened(spark, d):
    v = view(spark, d, "path_vertex").withColumn("part", F.floor((F.col("seq") - 1) / 3))
    parts = v.groupBy("path_id", "part").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("c")).groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "c"))), lambda p: p["c"]).alias("parts"))
    return parts.select("path_id", shapes.one_line("parts").alias("c")).select("path_id", F.size("c").cast("long").alias("n"), geo.round_half_up(F.get("c", F.lit(0))["x"] * 1000.0).cast("double").alias("first_x"))


@query("select n_nationkey as id from nation join region on n_regionkey = r_regionkey where r_name = 'AMERICA' and n_name not in ('CANADA', 'PERU')")
def f8_continent(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return shapes.on_continent(n.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("continent"), F.col("n_name").alias("name")), "AMERICA", ("CANADA", "PERU")).select("id")


_NAMED = "nm as (select id, up, case id%5 when 0 then 'Igarapé ' when 1 then 'Rio ' when 2 then 'FURO ' when 3 then 'Braço ' else 'Córrego ' end || cast(id%97 as varchar) as name from reach)"


@query(with_views("reach", more=_NAMED) + "select id from nm where not (regexp_matches(name, '(?i)^(igarap[eé]|furo|paran[aáã]|canal|bra[cç]o|quebrada|ca[nñ]o|lago|lagoa|entrada|sacado|riacho|c[oó]rrego|arroyo|arroio|ribeir[aã]o|corixo|grot[aã]o?|demarca)') and up > 20000)")
def f9_minor_cap(spark, d):
    first = F.element_at(F.array(*[F.lit(w) for w in ("Igarapé ", "Rio ", "FURO ", "Braço ", "Córrego ")]), (F.col("id") % 5 + 1).cast("int"))
    r = view(spark, d, "reach").select("id", "up", F.concat(first, (F.col("id") % 97).cast("string")).alias("name"))
    return r.where(text.plausible("name", "up")).select("id")


_FRAME = (14, 4551, 9012, 140, 140)


@query(with_views("place", "cell", more="pc as (select id, cast(floor((lon+180)/360*16384) as bigint)-4551 as cx, cast(floor((0.5-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*16384) as bigint)-9012 as cy from place)") + "select id from pc join cell using (cx, cy) where q <> 14")
def f13_inside_basin(spark, d):
    zoom, x0, y0, w, h = _FRAME
    return shapes.inside_cells(view(spark, d, "place"), view(spark, d, "cell"), zoom, x0, y0, w, h, outside=14).select("id")


@query(with_views("place") + "select z.range as zoom, count(*) as n from place, range(3, 13) z where pop >= 100000 or z.range >= 7 group by 1")
def f15_layers(spark, d):
    p = view(spark, d, "place").select(F.when(F.col("pop") >= 100000, "city").otherwise("town").alias("kind"))
    out = None
    for zoom in range(3, 13):
        n = shapes.shown_at(p, zoom).agg(F.count("*").alias("n")).select(F.lit(zoom).cast("long").alias("zoom"), "n")
        out = n if out is None else out.unionByName(n)
    return out.where("n > 0")


@query(with_views("place", "reach", more="ask as (select id, cast(floor((lon+180)/360*1024) as bigint) as x, cast(floor(lat*10) as bigint) as y from place), idx as (select distinct cast(floor((x1+180)/360*1024) as bigint) as x, cast(floor(y1*10) as bigint) as y from reach where up > 300000)") + "select id, idx.x is not null as known from ask left join idx using (x, y)")
def f16_tile_index(spark, d):
    at = lambda x, y: (F.lit(10).alias("z"), F.floor(geo.mercator_x(x) * 1024).cast("long").alias("x"), F.floor(F.col(y) * 10).cast("long").alias("y"))
    return shapes.known_tiles(view(spark, d, "place").select("id", *at("lon", "lat")), view(spark, d, "reach").where("up > 300000").select(*at("x1", "y1"))).select("id", "known")


_RING = "rg as (select path_id, seq, floor(x*10) as x, floor(y*10) as y from path_vertex), nb as (select *, coalesce(lag(x) over w, last_value(x) over v) as px, coalesce(lag(y) over w, last_value(y) over v) as py, coalesce(lead(x) over w, first_value(x) over v) as nx, coalesce(lead(y) over w, first_value(y) over v) as ny from rg window w as (partition by path_id order by seq), v as (partition by path_id order by seq rows between unbounded preceding and unbounded following))"


@query(with_views("path_vertex", more=_RING) + "select path_id, cast(sum(case when (x-px)*(ny-y) - (y-py)*(nx-x) <> 0 then 1 else 0 end) as bigint) as corners, cast(coalesce(sum(case when (x-px)*(ny-y) - (y-py)*(nx-x) <> 0 then x end), 0) as bigint) as sum_x from nb group by 1")
def f17_corners(spark, d):
    v = view(spark, d, "path_vertex").select("path_id", "seq", F.floor(F.col("x") * 10).cast("double").alias("x"), F.floor(F.col("y") * 10).cast("double").alias("y"))
    ring = sequences.polylines(v).select("path_id", seq.without_collinear("c").alias("r"))
    return ring.select("path_id", F.size("r").cast("long").alias("corners"), F.aggregate("r", F.lit(0.0), lambda t, p: t + p["x"]).cast("long").alias("sum_x"))


@query("select id, name, w.type from (select n_nationkey as id, n_name as name, case when n_nationkey%3 = 0 then 'Rio Solimões' when n_nationkey%3 = 1 then 'Río Negro' else 'Rio Xingu' end as river from nation) left join (values ('Rio Solimões', 'white'), ('Río Negro', 'black'), ('Rio Xingu', 'clear')) w(r, type) on w.r = river")
def s10_water_types(spark, d):
    river = F.when(F.col("n_nationkey") % 3 == 0, "Rio Solimões").when(F.col("n_nationkey") % 3 == 1, "Río Negro").otherwise("Rio Xingu")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), text.attribute_key(river).alias("key"))
    return n.join(F.broadcast(water.water_types(spark)), "key", "left").select("id", "name", "type")


@query("select page_id, nullif(regexp_extract(html, 'href=\"([^\"]*)\"', 1), '') as href from pages")
def s15_attribute(spark, d):
    return table(spark, d, "pages").select("page_id", text.attribute_of("html", "href").alias("href"))


@query(with_views("reach", "claim", more="ri as (select distinct rid from claim where rid%3 <> 0), pt as (select rid, count(*) as hops from claim group by 1)") + "select ri.rid, pt.hops from ri left join pt using (rid)")
def j21_column_if_known(spark, d):
    c = view(spark, d, "claim")
    info = c.where("rid % 3 <> 0").select("rid").distinct()
    return info.join(c.groupBy("rid").agg(F.count("*").alias("hops")), "rid", "left")


_SEG = "sg as (select path_id, x as x1, y as y1, lead(x) over (partition by path_id order by seq) as x2, lead(y) over (partition by path_id order by seq) as y2 from path_vertex)"


@query(with_views("path_vertex", more=_SEG + ", st as (select *, greatest(1, cast(ceil(greatest(abs(x2-x1), abs(y2-y1))/(3e0/111.32e0)) as int)) as n from sg where x2 is not null), al as (select *, unnest(range(0, n+1)) as i from st)") + "select distinct path_id, cast(floor((x1+(x2-x1)*(i/cast(n as double)))/(3e0/111.32e0)) as bigint) as gx, cast(floor((y1+(y2-y1)*(i/cast(n as double)))/(3e0/111.32e0)) as bigint) as gy from al")
def x4_cells_along(spark, d):
    return sequences.points_along(view(spark, d, "path_vertex"))


_CH = "ch as (select path_id as chain, count(*) as n from path_vertex group by 1), rn as (select path_id as chain, seq-1 as start, row_number() over (partition by path_id order by seq)-1 as run, lead(seq-1) over (partition by path_id order by seq) as nxt from path_vertex where seq%3 = 1), sl as (select rn.chain, run, start, case when n > 2 then 4 else 1 end as f, nxt, case when n > 2 then 4*n else n end as m from rn join ch using (chain)), "


@query(with_views("path_vertex", more=_CH + "cu as (select chain, cast(run as int) as run, start*f as a, case when nxt is not null then nxt*f else m-1 end as b from sl)") + "select chain, run, b-a+1 as n from cu where b > a")
def x7_run_slices(spark, d):
    v = view(spark, d, "path_vertex")
    lines = sequences.polylines(v).select(F.col("path_id").alias("chain"), "c", seq.chaikin("c", 2).alias("smooth"))
    runs = v.where("seq % 3 = 1").groupBy(F.col("path_id").alias("chain")).agg(F.array_sort(F.collect_list(F.struct((F.col("seq") - 1).alias("start")))).alias("runs"))
    # Two passes of corner cutting turn n vertices into 4n.
    return shapes.run_slices(lines.join(runs, "chain"), 4).select("chain", "run", F.size("c").cast("long").alias("n"))


@query(with_views("path_vertex") + "select path_id, count(*) as n, cast(floor(sum(x)*1000e0+0.5) as bigint) as sum_x from path_vertex group by 1")
def x9_joined_lines(spark, d):
    """Lines cut at their third vertex, which both parts have, and joined again."""
    c = sequences.polylines(view(spark, d, "path_vertex"))
    cut = c.select("path_id", F.slice("c", 1, 3).alias("a"), F.when(F.size("c") > 3, F.slice("c", F.lit(3), F.size("c"))).otherwise(F.slice("c", F.lit(-1), F.lit(1))).alias("b"))
    return cut.select("path_id", seq.join_lines("a", "b").alias("c")).select("path_id", F.size("c").cast("long").alias("n"), geo.round_half_up(F.aggregate("c", F.lit(0.0), lambda t, p: t + p["x"]) * 1000.0).cast("long").alias("sum_x"))


def _clip(zoom: int, buffer: int) -> str:
    n, b = f"{2**zoom}e0", f"({buffer}/4096e0)"
    my = lambda v: f"(0.5-ln((1+sin(radians({v})))/(1-sin(radians({v}))))/(4*pi()))*{n}"
    return (
        f"m as (select path_id, (x1+180)/360*{n} as ax, {my('y1')} as ay, (x2+180)/360*{n} as bx, {my('y2')} as by_ from sg where x2 is not null), "
        f"tx as (select *, unnest(range(cast(floor(least(ax,bx)-{b}) as bigint), cast(floor(greatest(ax,bx)+{b}) as bigint)+1)) as x from m), ty as (select *, unnest(range(cast(floor(least(ay,by_)-{b}) as bigint), cast(floor(greatest(ay,by_)+{b}) as bigint)+1)) as y from tx), "
        f"pr as (select *, greatest(0e0, coalesce(least((x-{b}-ax)/nullif(bx-ax,0), (x+1+{b}-ax)/nullif(bx-ax,0)), 0e0), coalesce(least((y-{b}-ay)/nullif(by_-ay,0), (y+1+{b}-ay)/nullif(by_-ay,0)), 0e0)) as t, least(1e0, coalesce(greatest((x-{b}-ax)/nullif(bx-ax,0), (x+1+{b}-ax)/nullif(bx-ax,0)), 1e0), coalesce(greatest((y-{b}-ay)/nullif(by_-ay,0), (y+1+{b}-ay)/nullif(by_-ay,0)), 1e0)) as u from ty)"
    )


@query(with_views("path_vertex", more=_SEG + ", " + _clip(8, 128)) + f"select x, y, count(*) as n, cast(sum({q('ax+t*(bx-ax)-x', '4096e0')}) as bigint) as sum_ax, cast(sum({q('ay+u*(by_-ay)-y', '4096e0')}) as bigint) as sum_by from pr where t <= u group by 1, 2")
def x10_tile_cut(spark, d):
    cut = shapes.tile_segments(sequences.segments(view(spark, d, "path_vertex")).select("path_id", "x1", "y1", "x2", "y2"), 8)
    return cut.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("ax").alias("sum_ax"), F.sum("by").alias("sum_by"))


@query(with_views("path_vertex", more=_SEG + ", " + _clip(9, 32)) + "select 9 as z, x, y, count(*) as n from pr where t <= u group by 2, 3")
def k5_tile_writer(spark, d):
    from ..operators.graph import scratch_path

    cut = shapes.tile_segments(sequences.segments(view(spark, d, "path_vertex")).select("path_id", "x1", "y1", "x2", "y2"), 9, 32)
    path = scratch_path(spark, "tiles")
    sinks.tiles(cut, path)
    return spark.read.parquet(path).groupBy(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), "y").agg(F.count("*").alias("n"))


@query(f"select range as zoom, {q('360e0/(512*pow(2, range))*10', '1e12')} as label, {q('40075e0/(512*pow(2, range))*3', '1e6')} as run_km from range(3, 13)")
def x11_tolerances(spark, d):
    return spark.range(3, 13).select(F.col("id").alias("zoom"), s(shapes.label_tolerance("id"), 1e12).alias("label"), s(shapes.least_run_km("id"), 1e6).alias("run_km"))


@query(with_views("path_vertex") + "select path_id, count(distinct (seq-1)//4) as rings, count(*) as vertices from path_vertex group by 1")
def x12_rings(spark, d):
    """Even paths are polygons, odd ones multi-polygons of two; rings of four vertices."""
    v = view(spark, d, "path_vertex")
    ring = v.groupBy("path_id", F.floor((F.col("seq") - 1) / 4).alias("k")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("r"))
    own = ring.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda p: p["r"]).alias("all"))
    even = F.col("path_id") % 2 == 0
    shaped = own.select("path_id", F.when(even, F.col("all")).alias("lone"), F.when(~even, F.filter(F.array(F.slice("all", 1, 1), F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0)))), lambda p: F.size(p) > 0)).alias("polygons"))
    found = shaped.select("path_id", shapes.rings("polygons", "lone").alias("r"))
    return found.select("path_id", F.size("r").cast("long").alias("rings"), F.aggregate("r", F.lit(0).cast("long"), lambda t, x: t + F.size(x)).alias("vertices"))


@query(with_views("reach", more="mp as (select (x1+180)/360 as mx, 0.5-ln((1+sin(radians(y1)))/(1-sin(radians(y1))))/(4*pi()) as my from reach), bx as (select cast(floor(min(mx)*4096) as bigint) as x0, cast(ceil(max(mx)*4096) as bigint) as x1, cast(floor(min(my)*4096) as bigint) as y0, cast(ceil(max(my)*4096) as bigint) as y1, cast(ceil(8046.72e0/(40075000e0/4096)) as bigint)+2 as pad from mp)") + "select greatest(0, x0-pad) as x0, greatest(0, y0-pad) as y0, least(4095, x1+pad)-greatest(0, x0-pad)+1 as w, least(4095, y1+pad)-greatest(0, y0-pad)+1 as h from bx")
def r2_grid_frame(spark, d):
    return shapes.grid_frame(view(spark, d, "reach").select(geo.mercator_x("x1").alias("mx"), geo.mercator_y("y1").alias("my")), 12, 5 * 1609.344)


_QUAD = "o as (select cx, cy, (cx//16+cy//16)%2 as grp from cell where q < 6), e as (select grp, cx as ax, cy as ay, cx+1 as bx, cy as by_ from o union all select grp, cx+1, cy, cx+1, cy+1 from o union all select grp, cx+1, cy+1, cx, cy+1 from o union all select grp, cx, cy+1, cx, cy from o)"


@query(with_views("cell", more=_QUAD) + "select e.grp, e.ax, e.ay, e.bx, e.by_ from e left join e f on f.grp = e.grp and f.ax = e.bx and f.ay = e.by_ and f.bx = e.ax and f.by_ = e.ay where f.grp is null")
def u6_dissolve(spark, d):
    on = view(spark, d, "cell").where("q < 6").withColumn("grp", (F.floor(F.col("cx") / 16) + F.floor(F.col("cy") / 16)) % 2)
    corners = ((0, 0), (1, 0), (1, 1), (0, 1))
    edges = F.array(*[F.struct((F.col("cx") + a[0]).alias("ax"), (F.col("cy") + a[1]).alias("ay"), (F.col("cx") + b[0]).alias("bx"), (F.col("cy") + b[1]).alias("by")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    return shapes.dissolve(on.select("grp", F.explode(edges).alias("e")).select("grp", "e.*")).withColumnRenamed("by", "by_")


@query("select key from (select l_partkey as key, max(l_shipdate) as last_use from lineitem group by 1) order by last_use desc, key limit 800")
def e4_recent_tiles(spark, d):
    return shapes.recent_keys(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("at"))).select("key")
