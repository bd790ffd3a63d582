"""Serving queries: tile coverage, point lookups, the course of a river, display panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import attributes, graph, raster, sections
from ..sources.fixtures import view, with_views
from .network import q, s
from .registry import query


def coverage(cells: DataFrame, z: int, x: int, y: int, scale: float, finest: int, subdivision: int = 5, coarsest: int = 8) -> DataFrame:
    """Visible cells and bridges of tile (z, x, y); cells are at mask zoom `finest`. Only the tile's part is read."""
    m = max(coarsest, min(z + subdivision, finest))
    halvings = finest - m
    n = 1 << (m - z) if m >= z else 1
    x0, y0 = (x * n, y * n) if m >= z else (x >> (z - m), y >> (z - m))
    side = 1 << halvings
    near = cells.where(F.col("cx").between((x0 - 1) * side, (x0 + n + 1) * side - 1) & F.col("cy").between((y0 - 1) * side, (y0 + n + 1) * side - 1))
    w = near.groupBy(F.floor(F.col("cx") / side).cast("long").alias("cx"), F.floor(F.col("cy") / side).cast("long").alias("cy")).agg(F.sum(raster.weight("q", scale)).alias("cnt"))
    return raster.coverage(w.where(F.col("cnt") >= raster.need(halvings, scale)), x0, y0, n)


def metres_or_km(v: Column) -> Column:
    return F.when(v.isNull(), "N/A").otherwise(F.concat(F.format_number(F.floor(v + 0.5), 0), F.lit(" km")))


def discharge(v: Column) -> Column:
    """Whole numbers from 100 on, one decimal from 10 on, else two."""
    number = F.when(v >= 100, F.format_number(F.floor(v + 0.5), 0)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.when(v.isNull(), "N/A").otherwise(F.concat(number, F.lit(" m³/s")))


def river_panel(info: DataFrame) -> DataFrame:
    """Display rows of rivers (rid, name, length_km, to_sea_km, ele_source, gradient, ord, dis_avg)."""
    return info.select(
        "rid",
        "name",
        metres_or_km(F.col("length_km")).alias("length"),
        metres_or_km(F.col("to_sea_km")).alias("to_sea"),
        F.when(F.col("ele_source").isNull(), "N/A").otherwise(F.concat(F.format_number("ele_source", 0), F.lit(" m"))).alias("source"),
        F.when(F.col("gradient").isNull(), "N/A").otherwise(F.concat(F.format_string("%.2f", "gradient"), F.lit(" m/km"))).alias("gradient"),
        F.col("ord").cast("string").alias("stream_order"),
        discharge(F.col("dis_avg")).alias("discharge"),
    )


def river_course(paths: DataFrame, courses: DataFrame, rid: int) -> DataFrame:
    """hop, place, x, y of a river's way to the sea; paths: id, hop, chain, km; courses: chain, seq, x, y, km_to_mouth."""
    own = paths.where(F.col("id") == rid).select("hop", "chain", F.col("km").alias("from_km"))
    return courses.join(F.broadcast(own), "chain").where(F.col("km_to_mouth") <= F.col("from_km")).select("hop", F.col("seq").alias("place"), "x", "y")


@query(with_views("cell", more="w as (select cx, cy, case when q < 14 then 255*(case when q <= 6 then 1 else 0 end) else 0 end as cnt from cell), l as (select cast(floor(cx/2e0) as bigint) as cx, cast(floor(cy/2e0) as bigint) as cy, sum(cnt) as cnt from w group by 1, 2), v as (select cx, cy from l where cnt >= " + str(raster.need(1, 0.5)) + "), t as (select cx, cy, 16 as b from v union all select cx, cy+1, 1 from v union all select cx, cy-1, 2 from v union all select cx+1, cy, 4 from v union all select cx-1, cy, 8 from v), m as (select cx, cy, bit_or(b) as m from t where cx between 31 and 64 and cy between 31 and 64 group by 1, 2), br as (select cx, cy, (case when m&5 = 5 then 1 else 0 end)+(case when m&9 = 9 then 2 else 0 end)+(case when m&6 = 6 then 4 else 0 end)+(case when m&10 = 10 then 8 else 0 end) as flags from m where m&16 = 0)") + "select cx-32 as i, cy-32 as j, 1 as visible, 0 as flags from v where cx between 31 and 64 and cy between 31 and 64 union all select cx-32, cy-32, 0, flags from br where flags > 0 and cx between 32 and 63 and cy between 32 and 63")
def serve_coverage(spark, d):
    return coverage(view(spark, d, "cell"), 11, 1, 1, 0.5, finest=17)


@query(with_views("reach") + "select id as rid, case when len > 2 then concat(cast(cast(floor(len+0.5) as bigint) as varchar), ' km') else 'N/A' end as length, case when up/1000 >= 100 then concat(cast(cast(floor(up/1000+0.5) as bigint) as varchar), ' m³/s') else null end as discharge from reach where up/1000 >= 100 and up/1000 < 999")
def serve_river_panel(spark, d):
    r = view(spark, d, "reach").where("up/1000 >= 100 and up/1000 < 999")
    none = F.lit(None).cast("double")
    info = r.select(F.col("id").alias("rid"), F.lit("x").alias("name"), F.when(F.col("len") > 2, F.col("len")).alias("length_km"), none.alias("to_sea_km"), none.alias("ele_source"), none.alias("gradient"), F.col("stra").alias("ord"), (F.col("up") / 1000).alias("dis_avg"))
    return river_panel(info).select("rid", "length", "discharge")


@query(with_views("reach") + f"select id, {q('up', '100e0')} as up_c, stra from reach where id = 137")
def serve_point_lookup(spark, d):
    return view(spark, d, "reach").where("id = 137").select("id", s("up", 100).alias("up_c"), "stra")


@query()
def serve_river_course(spark, d):
    r = view(spark, d, "reach")
    m = graph.cut(graph.chain_members(r), "members")
    paths = graph.paths_to_sea(r, m, graph.headwaters(r))
    top = graph.headwaters(r).agg(F.max("id")).first()[0]
    courses = m.join(r.select("id", "x1", "y1"), "id").select("chain", F.col("hops").alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("km").alias("km_to_mouth"))
    return river_course(paths, courses, top)


@query()
def g6_sections(spark, d):
    r = view(spark, d, "reach").select("id", "down", "up", "len")
    mine = view(spark, d, "claim").join(r.select("id", "up"), "id").select("rid", "id", "up")
    sizes = graph.cut(attributes.weighted_median(view(spark, d, "line_up")).select("rid", F.col("median_up").alias("size_up")), "sizes")
    rivers = sizes.select("rid", F.concat(F.lit("river "), F.col("rid")).alias("name"))
    lon = view(spark, d, "reach").select("id", (F.col("x1") + 9).alias("lon"))
    members = graph.chain_members(r)
    stem = graph.main_stem(r, members, geo.MAIN_STEM_MIN_UP / 100).join(lon, "id").select("id", geo.stem_name("lon").alias("name"))
    stem = graph.cut(stem, "stem")
    found = sections.two_passes(r, rivers, mine, sizes, stem, members)
    return sections.section_lengths(found, r)
