"""Readers and writers, there and back: what is read is the table that was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq
from ..operators import raster, sequences
from ..operators.graph import scratch_path
from ..sources import files, ingest, service, sinks
from ..sources.fixtures import table, view, with_views
from .network import q, s
from .registry import query


def _whole_text(df, path: str) -> None:
    """Lines of a small table as one file."""
    df.coalesce(1).write.text(path)


@query(with_views("reach") + f"select id, down, len, {q('up', '100e0')} as up_c, stra, {q('x1', '1000e0')} as x, {q('y2', '1000e0')} as y from reach")
def s3_k1_ndjson(spark, d):
    r = view(spark, d, "reach")
    path = scratch_path(spark, "reaches")
    sinks.ndjson(r.select("id", "down", "len", "up", F.col("stra").cast("int").alias("stra"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("c")), path)
    back = files.ndjson(spark, path)
    return back.select("id", "down", "len", s("up", 100).alias("up_c"), "stra", s(F.col("c")[0][0], 1000).alias("x"), s(F.col("c")[1][1], 1000).alias("y"))


@query(with_views("way") + "select id, count(*) as n from (select id from way union all select id from way where id%2 = 0) group by 1")
def k2_ndjson_append(spark, d):
    w = view(spark, d, "way").select("id", "name")
    path = scratch_path(spark, "ways")
    sinks.ndjson(w, path)
    sinks.ndjson(w.where("id % 2 = 0"), path, append=True)
    return files.ndjson(spark, path, "id long, name string").groupBy("id").agg(F.count("*").alias("n"))


@query("select n_nationkey as id, n_name as name, 'Polygon' as kind, n_regionkey + 1 as corners from nation")
def s4_geojson(spark, d):
    """The table is the 25 nations: a document has to hold all its features."""
    ring = F.transform(F.sequence(F.lit(0), F.col("n_regionkey")), lambda i: F.array(i.cast("double"), F.lit(0.5)))
    f = table(spark, d, "nation").select(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("NAME")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).alias("f"))
    path = scratch_path(spark, "nations")
    _whole_text(f.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value")), path)
    back = files.features(spark, path, "ID int, NAME string", "array<array<array<double>>>")
    return back.select(F.col("ID").alias("id"), F.col("NAME").alias("name"), "kind", F.size(F.col("coordinates")[0]).alias("corners"))


@query("select cast(n_nationkey as varchar) as key, n_name as name, n_regionkey as region from nation")
def s5_k4_json_documents(spark, d):
    path = scratch_path(spark, "documents")
    sinks.json_documents(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "id", path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")))
    return lines.select("key", F.get_json_object("value", "$.name").alias("name"), F.get_json_object("value", "$.region").cast("int").alias("region"))


@query("select cast(r_regionkey as varchar) as key, r_name as name from region")
def s5_json_map(spark, d):
    path = scratch_path(spark, "map")
    entry = F.struct(F.col("r_regionkey").cast("string").alias("k"), F.struct(F.col("r_name").alias("name")).alias("v"))
    _whole_text(table(spark, d, "region").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")), path)
    return files.json_map(spark, path, "struct<name:string>").select("key", F.col("value.name").alias("name"))


@query(with_views("place") + f"select name, 'P' as class, pop, {q('lon', '1000e0')} as x, {q('lat', '1000e0')} as y, case when id%2 = 0 then id%90 else id%70 end as elev from place")
def s6_gazetteer(spark, d):
    p = view(spark, d, "place")
    none = F.lit("")
    even = F.col("id") % 2 == 0
    fields = [F.col("id"), F.col("name"), none, none, F.col("lat"), F.col("lon"), F.lit("P"), F.lit("PPL"), F.lit("BR"), none, F.lit("04"), none, none, none, F.col("pop"), F.when(even, (F.col("id") % 90).cast("string")).otherwise(""), F.col("id") % 70]
    path = scratch_path(spark, "gazetteer")
    p.select(F.array_join(F.array(*[f.cast("string") for f in fields]), "\t").alias("value")).unionByName(spark.createDataFrame([("short\trow",)], "value string")).write.text(path)
    g = files.gazetteer(spark, path)
    return g.select("name", "class", "pop", s("lon", 1000).alias("x"), s("lat", 1000).alias("y"), F.col("elev").cast("long").alias("elev"))


@query(with_views("cell") + "select cx, cy, q from cell")
def s7_k6_packed_raster(spark, d):
    path = scratch_path(spark, "raster")
    blocks = sinks.packed_rows(raster.pack_nibbles(view(spark, d, "cell"), 0, 0, 128), 128, 16)
    blocks.write.parquet(path)
    back = spark.read.parquet(path).select(F.explode(files.packed_bytes("body")).alias("b"), (F.col("block") * (128 * 16 // 2)).alias("base"))
    return raster.unpack_nibbles(back.select((F.col("base") + F.col("b.at")).alias("byte_no"), F.col("b.byte").alias("byte")), 0, 0, 128)


@query(with_views("path_vertex") + "select path_id%40 as chain, count(distinct path_id) as lines, count(*) as n, cast(sum(floor(x*100000e0+0.5)) as bigint) as x from path_vertex group by 1")
def k7_chain_files(spark, d):
    """Forty chains of several courses each."""
    path = scratch_path(spark, "chains")
    sinks.chain_files(sequences.polylines(view(spark, d, "path_vertex")).withColumn("chain", F.col("path_id") % 40), path)
    flat = spark.read.option("basePath", path).text(path).select("chain", F.from_json("value", "array<bigint>").alias("flat"))
    back = flat.select(F.col("chain").cast("long").alias("chain"), seq.delta_decode("flat").alias("c"))
    each = back.select("chain", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda t, p: t + s(p["x"], 1e5)).alias("x"))
    return each.groupBy("chain").agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.sum("x").alias("x"))


@query("select 0 as n")
def s11_missing_input(spark, d):
    found = files.optional(spark, f"{d}/no-such-table.parquet", "id long", lambda p, path: p.read.parquet(path))
    return found.agg(F.count("*").alias("n"))


@query(with_views("reach") + "select stra, count(*) as n from reach group by 1")
def s12_cached_scan(spark, d):
    path = scratch_path(spark, "cache")
    build = lambda: view(spark, d, "reach").select("id", "stra")
    ingest.cached(spark, path, build)

    def again():
        raise AssertionError("the table is there")

    return ingest.cached(spark, path, again).groupBy("stra").agg(F.count("*").alias("n"))


@query("select x.range as x, y.range as y from range(-80, -49) x, range(-20, 6) y")
def s8_chunked_scan(spark, d):
    spark.dataSource.register(service.ChunkedSource)
    box = {"x0": "-80", "y0": "-20", "x1": "-49", "y1": "6", "step": "4"}
    return spark.read.format("chunked").schema("x bigint, y bigint").options(fetch="spindrift.sources.service:sample_grid", **box).load()


@query("select range as id, range*range as square from range(2500)")
def s9_paged_scan(spark, d):
    spark.dataSource.register(service.PagedSource)
    return spark.read.format("paged").schema("id bigint, square bigint").options(fetch="spindrift.sources.service:sample_page", count="2500", page="1000").load()
