"""Literal cases of the traps, and properties."""

import math

from pyspark.sql import functions as F

from spindrift.functions import geo, seq, text
from spindrift.operators import raster, sequences, spatial, topology
from spindrift.plans.spatial import REVEAL


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_literals(spark):
    r = one(
        spark,
        down=geo.round_half_up(F.lit(-2.5)), up=geo.round_half_up(F.lit(2.5)),
        m5=geo.corridor_miles(F.lit(5.0)), m10=geo.corridor_miles(F.lit(10.0)), m3=geo.corridor_miles(F.lit(3e6)), m9=geo.corridor_miles(F.lit(1e9)),
        a=geo.stem_name(F.lit(-70.0)), b=geo.stem_name(F.lit(-69.95)), c=geo.stem_name(F.lit(-59.902)),
        z1=geo.reveal_zoom(F.lit(300000.0), REVEAL), z2=geo.reveal_zoom(F.lit(50000.0), REVEAL), z3=geo.reveal_zoom(F.lit(10.0), REVEAL),
    )
    assert (r["down"], r["up"]) == (-2, 3)
    assert [round(r[k], 9) for k in ("m5", "m10", "m3", "m9")] == [0.5, 0.5, 5.0, 5.0]
    assert (r["a"], r["b"], r["c"]) == ("Río Amazonas", "Rio Solimões", "Rio Amazonas")
    assert (r["z1"], r["z2"], r["z3"]) == (3, 4, 11)


def test_names(spark):
    r = one(
        spark,
        label=text.label_key(F.lit("Rio Ji-Paraná")), attribute=text.attribute_key(F.lit("Rio Ji-Paraná")),
        alt=text.alternatives(F.lit("Rio Guaporé (Brasil) / Rio Itenez (Bolivia)")),
        near=text.same_name(F.lit("itonamas"), F.lit("itonomas")), far=text.same_name(F.lit("abc"), F.lit("abd")),
        minor=text.is_minor(F.lit("Igarapé Preto")), big=text.is_minor(F.lit("Rio Negro")),
    )
    assert (r["label"], r["attribute"], r["alt"]) == ("jiparana", "ji-parana", ["guapore", "itenez"])
    assert (r["near"], r["far"], r["minor"], r["big"]) == (True, False, True, False)


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_lines(spark):
    r = one(spark, c=seq.chaikin(line((0, 0), (4, 0), (4, 4)), 1), short=seq.chaikin(line((0, 0), (1, 1)), 2), code=seq.delta_encode(line((-60.625, 5.20417), (-60.61875, 5.19792))), back=seq.delta_decode(seq.delta_encode(line((-60.625, 5.20417), (-60.61875, 5.19792)))))
    assert [tuple(p) for p in r["c"]] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 3), (4, 4)]
    assert len(r["short"]) == 2
    assert r["code"] == [-6062500, 520417, 625, -625]
    assert [tuple(p) for p in r["back"]] == [(-60.625, 5.20417), (-60.61875, 5.19792)]


def test_raster_weights(spark):
    r = one(spark, a=raster.weight(F.lit(6), 0.52), b=raster.weight(F.lit(7), 0.52), c=raster.weight(F.lit(8), 0.52), d=raster.weight(F.lit(14), 0.52))
    assert (r["a"], r["b"], r["c"], r["d"]) == (255, 71, 0, 0)
    assert raster.need(1, 1.0) == 593


def test_glow_at_a_town(spark):
    p = spark.createDataFrame([(1, -60.0, -3.0), (2, -70.0, -3.0)], "pid long, lon double, lat double")
    t = spark.createDataFrame([(-60.0, -3.0, 2000)], "lon double, lat double, pop long")
    assert {r["pid"]: r["level"] for r in spatial.remoteness(p, t).collect()} == {1: 30, 2: 0}


def test_greedy_dedupe_is_the_sequential_one(spark):
    import random

    rnd = random.Random(4)
    rows = [(i, rnd.randrange(5000), -60 + rnd.random() / 5, -3 + rnd.random() / 5) for i in range(150)]
    kept = []
    for i, _, x, y in sorted(rows, key=lambda r: (-r[1], r[0])):
        if all(math.hypot((x - a) * math.cos(math.radians((y + b) / 2)), y - b) * 111.32 >= 3 for _, a, b in kept):
            kept.append((i, x, y))
    got = spatial.greedy_dedupe(spark.createDataFrame(rows, "id long, pop long, lon double, lat double"), 3.0)
    assert sorted(r["id"] for r in got.collect()) == sorted(k[0] for k in kept)


def test_simplify_keeps_ends(spark):
    rows = [(1, i, i / 10, math.sin(i / 3)) for i in range(50)]
    lines = sequences.polylines(spark.createDataFrame(rows, "path_id long, seq long, x double, y double"))
    c = sequences.simplify(lines, 0.1).first()["c"]
    assert 2 < len(c) < 50
    assert (c[0]["x"], c[-1]["x"]) == (0.0, 4.9)


def test_merge_runs_follows_the_fold(spark):
    runs = [(1, [(1, 10, 50.0), (2, 20, 500.0), (2, 20, 300.0), (3, 30, 10.0)])]
    df = spark.createDataFrame(runs, "chain long, runs array<struct<ord:int,rem:int,km:double>>")
    got = [tuple(r)[2:] for r in sequences.merge_runs(df, 3).orderBy("grp").collect()]
    # 29.3 km is the least at zoom 3: the first stands, the equal pair joins, the short tail joins the pair.
    assert got == [(1, 10, 50.0), (2, 20, 810.0)]


def test_rings_close(spark):
    on = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (3, 3)], "cx long, cy long")
    edges = raster.boundary_edges(raster.outline_polygons(on)).withColumn("component", F.lit(0).cast("long"))
    rings = topology.trace_rings(edges)
    assert rings.select("ring").distinct().count() == 2
    assert rings.count() == edges.count()
    assert topology.svg_path(rings).first()["d"].startswith("M")


def test_pack_round_trip(spark):
    cells = spark.createDataFrame([(0, 0, 3), (1, 0, 14), (5, 2, 0)], "cx long, cy long, q int")
    back = raster.unpack_nibbles(raster.pack_nibbles(cells, 0, 0, 8), 0, 0, 8)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_streams(spark, tmp_path):
    from spindrift.streaming import interaction

    impulse = F.when(F.col("event_id") % 5 == 0, -F.col("value")).otherwise(F.col("value")) / 1000
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", impulse.alias("impulse")).limit(300)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("debounced", interaction.debounce_stream(stream), "append"), ("decayed", interaction.decay_stream(stream, frame_ms=3.6e6), "update")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("debounced").count() > 0
    batch = {r["user_id"]: round(r["velocity"], 9) for r in interaction.decay(src, frame_ms=3.6e6).collect()}
    assert {r["user_id"]: round(r["velocity"], 9) for r in spark.table("decayed").collect()} == batch


def test_decay_by_elapsed_time(spark):
    """Velocity 0.1, half a second of frames later still moving; a reversal starts from rest; the limit holds; at last it rests."""
    from datetime import datetime, timedelta

    from spindrift.streaming import interaction

    t0 = datetime(2024, 1, 1)
    at = lambda ms: t0 + timedelta(milliseconds=ms)
    rows = [(1, at(0), 1, 0.1), (1, at(100), 2, 0.1), (2, at(0), 1, 0.1), (2, at(50), 2, -0.05), (3, at(0), 1, 9.0), (4, at(0), 1, 0.2), (4, at(5000), 2, 0.01)]
    got = {r["user_id"]: r["velocity"] for r in interaction.decay(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, impulse double")).collect()}
    assert math.isclose(got[1], 0.1 * 0.9 ** (100 / 16.667) + 0.1)
    assert got[2] == -0.05 and got[3] == 0.25 and got[4] == 0.01


def test_douglas_peucker_by_recursion(spark):
    """The vertices that stay are those of the plain recursive rule."""
    from spindrift.operators import sequences
    from spindrift.sources.fixtures import view

    lines = sequences.polylines(view(spark, "/root/testdata/sf0.001", "path_vertex"))

    def keep(p, tolerance):
        if len(p) <= 2:
            return p
        (ax, ay), (bx, by) = p[0], p[-1]
        dx, dy = bx - ax, by - ay
        ll = dx * dx + dy * dy

        def off(q):
            t = min(1, max(0, ((q[0] - ax) * dx + (q[1] - ay) * dy) / ll)) if ll > 0 else 0
            return (ax + t * dx - q[0]) ** 2 + (ay + t * dy - q[1]) ** 2

        k = max(range(1, len(p) - 1), key=lambda i: (off(p[i]), -i))
        return keep(p[: k + 1], tolerance)[:-1] + keep(p[k:], tolerance) if off(p[k]) > tolerance**2 else [p[0], p[-1]]

    want = {}
    for r in lines.collect():
        c = math.cos(r["c"][0]["y"] * math.pi / 180)
        want[r["path_id"]] = [(round(x / c, 9), y) for x, y in keep([(v["x"] * c, v["y"]) for v in r["c"]], 0.2)]
    got = {r["path_id"]: [(round(v["x"], 9), v["y"]) for v in r["c"]] for r in sequences.simplify(lines, 0.2).collect()}
    assert got == want


def test_every_edge_is_walked_once(spark):
    """Lines hold every undirected edge once, rings every directed one; components do not mix."""
    from itertools import pairwise

    from spindrift.plans.spatial import g11_border_lines, g12_rings
    from spindrift.sources.fixtures import view

    d = "/root/testdata/sf0.001"
    lines, edges = {}, set()
    for r in g11_border_lines(spark, d).orderBy("component", "line", "place").collect():
        lines.setdefault((r["component"], r["line"]), []).append((r["x"], r["y"]))
    walked = [tuple(sorted(e)) for line in lines.values() for e in pairwise(line)]
    for r in view(spark, d, "way").collect():
        edges.add(tuple(sorted(((float(r["start_node"]), 0.0), (float(r["end_node"]), 0.0)))))
    assert len(walked) == len(set(walked)) and set(walked) == edges
    rings = {}
    for r in g12_rings(spark, d).orderBy("component", "ring", "place").collect():
        rings.setdefault((r["component"], r["ring"]), []).append((r["x"], r["y"]))
    closed = [e for ring in rings.values() for e in pairwise([*ring, ring[0]])]
    assert len(closed) == len(set(closed)) and not {(b, a) for a, b in closed} & set(closed)


def test_svg_of_a_square(spark):
    on = spark.createDataFrame([(2, 3)], "cx long, cy long")
    rings = topology.trace_rings(topology.by_component(raster.boundary_edges(raster.outline_polygons(on))))
    assert topology.svg_path(rings).first()["d"] == "M2 3L3 3L3 4L2 4Z"
