"""Readers and writers, there and back."""

import gzip
import json
import struct

from pyspark.sql import functions as F

from spindrift.operators import raster, sections
from spindrift.sources import files, sinks


def test_ndjson(spark, tmp_path):
    p = tmp_path / "r.ndjson"
    p.write_text('{"id":1,"down":2,"len":1.5,"up":10,"c":[[-60.5,-3.25],[-60.4,-3.2]]}\n\n{"id":2,"down":0,"len":2,"up":20,"c":[]}\n')
    rows = files.ndjson(spark, str(p)).orderBy("id").collect()
    assert [(r["id"], r["down"], r["len"]) for r in rows] == [(1, 2, 1.5), (2, 0, 2.0)]
    sinks.ndjson(files.ndjson(spark, str(p)), str(tmp_path / "out"))
    sinks.ndjson(files.ndjson(spark, str(p)), str(tmp_path / "out"), append=True)
    assert files.ndjson(spark, str(tmp_path / "out")).count() == 4


def test_geojson_and_map(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"NAME": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}))
    r = files.features(spark, str(p), "NAME string", "array<array<array<double>>>").first()
    assert (r["NAME"], r["kind"], len(r["coordinates"][0])) == ("A", "Polygon", 4)
    m = tmp_path / "m.json"
    m.write_text('{"a":{"n":1},"b":{"n":2}}')
    assert {(r["key"], r["value"]["n"]) for r in files.json_map(spark, str(m), "struct<n:int>").collect()} == {("a", 1), ("b", 2)}


def test_gazetteer(spark, tmp_path):
    p = tmp_path / "g.txt"
    row = ["1", "Tefé", "", "", "-3.35", "-64.71", "P", "PPL", "BR", "", "04", "", "", "", "60000", "", "47"]
    p.write_text("\t".join(row) + "\nshort\trow\n")
    rows = files.gazetteer(spark, str(p)).collect()
    assert [(r["name"], r["lon"], r["pop"], r["elev"]) for r in rows] == [("Tefé", -64.71, 60000, 47.0)]


def test_dbf_and_shapefile(spark, tmp_path):
    fields = [("ID", "N", 6), ("NAME", "C", 5)]
    head = struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 2, 32 + 32 * 2 + 1, 12) + b"".join(n.encode().ljust(11, b"\0") + t.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, t, w in fields) + b"\r"
    (tmp_path / "a.dbf").write_bytes(head + b" " + b"    17" + b"Rio  " + b" " + b"******" + b"X    ")
    assert [(r["row"], r["ID"], r["NAME"]) for r in files.dbf(spark, str(tmp_path / "a.dbf"), {"ID": "long", "NAME": "string"}).collect()] == [(0, 17, "Rio"), (1, None, "X")]
    body = struct.pack("<I4dII", 3, 0, 0, 1, 1, 2, 4) + struct.pack("<2I", 0, 2) + struct.pack("<8d", 0, 0, 1, 1, 2, 2, 3, 3)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">II", 1, len(body) // 2) + body)
    rows = files.shapefile(spark, str(tmp_path / "a.shp")).orderBy("part").collect()
    assert [(r["row"], r["part"], [tuple(p) for p in r["c"]]) for r in rows] == [(0, 0, [(0, 0), (1, 1)]), (0, 1, [(2, 2), (3, 3)])]


def test_packed_raster(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 3), (1, 0, 14), (5, 2, 0)], "cx long, cy long, q int")
    blocks = sinks.packed_rows(raster.pack_nibbles(cells, 0, 0, 8), 8, 1).orderBy("block").collect()
    whole = bytearray(b"\xff" * 4 * 3)
    for b in blocks:
        whole[b["block"] * 4 : b["block"] * 4 + 4] = gzip.decompress(b["body"])
    (tmp_path / "m.gz").write_bytes(gzip.compress(bytes(whole)))
    back = raster.unpack_nibbles(files.packed_raster(spark, str(tmp_path / "m.gz")), 0, 0, 8)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_optional_tiles_and_chains(spark, tmp_path):
    assert files.optional(spark, str(tmp_path / "none"), "a int", lambda s, p: s.read.json(p)).count() == 0
    x, y = sinks.tile_of(3, "lon", "lat")
    t = spark.createDataFrame([(-60.0, -3.0), (-60.1, -3.1), (10.0, 50.0)], "lon double, lat double").select(F.lit(3).alias("z"), x.alias("x"), y.alias("y"), "lon")
    index = sinks.tiles(t, str(tmp_path / "tiles"))
    assert sorted(r["n"] for r in index.collect()) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "tiles")).where("z = 3").count() == 3
    c = spark.createDataFrame([(7, [{"x": 1.0, "y": 2.0}, {"x": 1.5, "y": 2.0}])], "chain long, c array<struct<x:double,y:double>>")
    sinks.chain_files(c, str(tmp_path / "chains"))
    assert spark.read.text(str(tmp_path / "chains")).first()["value"] == "[100000,200000,50000,0]"
    sinks.json_documents(spark.createDataFrame([(1, "a")], "rid long, name string"), "rid", str(tmp_path / "docs"))
    assert json.loads(spark.read.text(str(tmp_path / "docs")).first()[0]) == {"1": {"name": "a"}}


def test_sections(spark):
    """A stem 1 < 2 < 3 < 4 (down to up) with a side branch 9 at 2; the river of 3 and 4 stops where the stem's takes over."""
    reach = spark.createDataFrame([(1, 0, 100.0, 1.0), (2, 1, 90.0, 1.0), (3, 2, 50.0, 1.0), (4, 3, 40.0, 1.0), (9, 2, 30.0, 1.0), (10, 9, 25.0, 1.0)], "id long, down long, up double, len double")
    rivers = spark.createDataFrame([(1, "big"), (2, "small")], "rid long, name string")
    mine = spark.createDataFrame([(1, 1, 100.0), (1, 2, 90.0), (1, 3, 50.0), (1, 4, 40.0), (2, 9, 30.0), (2, 10, 25.0)], "rid long, id long, up double")
    sizes = spark.createDataFrame([(1, 90.0), (2, 30.0)], "rid long, size_up double")
    owner = mine.join(rivers, "rid").select("id", F.col("name").alias("owner"))
    stem = spark.createDataFrame([], "id long")
    found = {}
    for r in sections.sections(reach, rivers, mine, sizes, owner, stem).orderBy("rid", "place").collect():
        found.setdefault(r["rid"], []).append(r["id"])
    assert found == {1: [1, 2, 3, 4], 2: [9, 10]}


def test_stem_stretches(spark):
    """A stem 1 < 2 < 3 < 4 of two names; the river that claims all of it keeps the stretch of its own name."""
    reach = spark.createDataFrame([(1, 0, 100.0, 1.0), (2, 1, 90.0, 1.0), (3, 2, 80.0, 1.0), (4, 3, 70.0, 1.0)], "id long, down long, up double, len double")
    rivers = spark.createDataFrame([(1, "lower"), (2, "upper")], "rid long, name string")
    mine = spark.createDataFrame([(r, i, u) for r in (1, 2) for i, u in ((1, 100.0), (2, 90.0), (3, 80.0), (4, 70.0))], "rid long, id long, up double")
    sizes = spark.createDataFrame([(1, 95.0), (2, 75.0)], "rid long, size_up double")
    stem = spark.createDataFrame([(1, "lower"), (2, "lower"), (3, "upper"), (4, "upper")], "id long, name string")
    found = {}
    for r in sections.two_passes(reach, rivers, mine, sizes, stem).orderBy("rid", "place").collect():
        found.setdefault(r["rid"], []).append(r["id"])
    assert found[2][-1] == 4 and found[1][0] == 1
    own = {}
    from spindrift.operators import attributes

    for r in attributes.own_reaches(mine, sizes, rivers=rivers, stem=stem).collect():
        own.setdefault(r["rid"], set()).add(r["id"])
    assert own == {1: {1, 2}, 2: {3, 4}}
    lost = attributes.own_reaches(mine.where("rid = 1 and id > 2"), sizes, rivers=rivers, stem=stem)
    assert {r["id"] for r in lost.collect()} == {3, 4}
