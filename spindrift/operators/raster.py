"""Raster operators over sparse cells (cx, cy, q): an absent row is a cell beyond every corridor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

# Depth steps of a corridor, codes of the interior and the outside, full weight, threshold curve.
LEVELS, INTERIOR, OUTSIDE, FULL = 14, 14, 15, 255
T0, S0, K, CAP, LOW_POWER = 0.2, 0.15, 2.8, 0.62, 0.8


def rasterise(segments: DataFrame, least_radius: float = 0.75) -> DataFrame:
    """cx, cy, q: each cell's least depth step in any corridor.

    segments: x1, y1, x2, y2 and radius r in cells. Cells of the padded box are tried by their centres.
    """
    r = F.greatest(F.col("r"), F.lit(least_radius))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) - F.col("rr")).cast("long"), F.floor(F.greatest(a, b) + F.col("rr")).cast("long")))
    s = segments.withColumn("rr", r)
    grid = s.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    px, py = F.col("cx") + 0.5, F.col("cy") + 0.5
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ll = dx * dx + dy * dy
    t = F.when(ll > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - F.col("x1")) * dx + (py - F.col("y1")) * dy) / ll))).otherwise(0.0)
    ex, ey = F.col("x1") + t * dx - px, F.col("y1") + t * dy - py
    d2 = ex * ex + ey * ey
    hit = grid.withColumn("d2", d2).where(F.col("d2") <= F.col("rr") * F.col("rr"))
    q = F.least(F.lit(LEVELS - 1), F.floor(F.sqrt("d2") / F.col("rr") * LEVELS)).cast("int")
    return hit.groupBy("cx", "cy").agg(F.min(q).alias("q"))


def coarsen(cells: DataFrame) -> DataFrame:
    """Cells of half the resolution that hold any cell."""
    return cells.select(F.floor(F.col("cx") / 2).cast("long").alias("cx"), F.floor(F.col("cy") / 2).cast("long").alias("cy")).distinct()


def dilate(cells: DataFrame, k: int = 2) -> DataFrame:
    """A square of side 2k + 1 around every cell, one axis after the other."""
    offsets = F.array(*[F.lit(i) for i in range(-k, k + 1)])
    x = cells.select("cx", "cy", F.explode(offsets).alias("d")).select((F.col("cx") + F.col("d")).alias("cx"), "cy").distinct()
    return x.select("cx", "cy", F.explode(offsets).alias("d")).select("cx", (F.col("cy") + F.col("d")).alias("cy")).distinct()


def _flood(blocked: DataFrame, x0: int, x1: int, y0: int, y1: int) -> tuple[DataFrame, DataFrame]:
    """Vertical runs (cx, a, b) of free cells of the frame, and those that a flood from the border reaches.

    Runs of neighbouring columns that touch are joined, so the number of rounds follows the number of bends, not the size of
    the grid.
    """
    spark = blocked.sparkSession
    inside = blocked.where(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)).select("cx", "cy").distinct()
    columns = spark.range(x0, x1 + 1).select(F.col("id").alias("cx"))
    walls = columns.join(inside.groupBy("cx").agg(F.array_sort(F.collect_list("cy")).alias("ys")), "cx", "left")
    edges = F.concat(F.array(F.lit(y0 - 1).cast("long")), F.coalesce("ys", F.array().cast("array<bigint>")), F.array(F.lit(y1 + 1).cast("long")))
    spans = walls.select("cx", F.explode(F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct((F.element_at(edges, i) + 1).alias("a"), (F.element_at(edges, i + 1) - 1).alias("b")))).alias("s"))
    runs = cut(spans.where("s.a <= s.b").select("cx", "s.a", "s.b"), "free")
    border = (F.col("cx") == x0) | (F.col("cx") == x1) | (F.col("a") == y0) | (F.col("b") == y1)
    seen = cut(runs.where(border), "flood")
    fresh = seen
    while True:
        near = fresh.withColumn("d", F.explode(F.array(F.lit(-1), F.lit(1)))).select((F.col("cx") + F.col("d")).alias("cx"), F.col("a").alias("fa"), F.col("b").alias("fb"))
        reached = runs.join(near, "cx").where("a <= fb and fa <= b").select("cx", "a", "b").distinct()
        fresh = cut(reached.join(seen, ["cx", "a", "b"], "left_anti"), "fresh")
        if not fresh.limit(1).count():
            return runs, seen
        seen = cut(seen.unionByName(fresh), "flood")


def exterior(blocked: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Cells of the frame that a 4-neighbour flood from its border reaches past the blocked cells."""
    _, seen = _flood(blocked, x0, x1, y0, y1)
    return seen.select("cx", F.explode(F.sequence("a", "b")).alias("cy"))


def interior(cells: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Fine cells of the frame that no corridor holds and whose coarse parent the flood does not reach.

    Only the children of coarse cells that are blocked or enclosed are looked at, not the frame.
    """
    coarse = dilate(coarsen(cells.where(F.col("q") < INTERIOR)), 2)
    box = (x0 // 2, x1 // 2, y0 // 2, y1 // 2)
    runs, seen = _flood(coarse, *box)
    enclosed = runs.join(seen, ["cx", "a", "b"], "left_anti").select("cx", F.explode(F.sequence("a", "b")).alias("cy"))
    held = coarse.where(F.col("cx").between(box[0], box[1]) & F.col("cy").between(box[2], box[3]))
    both = F.array(F.lit(0), F.lit(1))
    fine = held.unionByName(enclosed).select((F.col("cx") * 2).alias("cx"), (F.col("cy") * 2).alias("cy"), F.explode(both).alias("i")).select((F.col("cx") + F.col("i")).alias("cx"), "cy", F.explode(both).alias("j")).select("cx", (F.col("cy") + F.col("j")).alias("cy"))
    framed = fine.where(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1))
    return framed.join(cells.select("cx", "cy"), ["cx", "cy"], "left_anti")


def pack_nibbles(cells: DataFrame, x0: int, y0: int, width: int) -> DataFrame:
    """byte_no, byte of the row-major grid, even index in the high half; bytes of nothing but outside are left out."""
    index = (F.col("cy") - y0) * width + (F.col("cx") - x0)
    i = cells.select(index.alias("i"), "q")
    high = F.pmod("i", F.lit(2)) == 0
    # Outside is all ones: clear the half that is set, then combine with AND.
    half = F.when(high, F.shiftleft("q", 4).bitwiseOR(F.lit(15))).otherwise(F.lit(240).bitwiseOR(F.col("q")))
    return i.groupBy(F.floor(F.col("i") / 2).cast("long").alias("byte_no")).agg(F.bit_and(half).cast("int").alias("byte"))


def unpack_nibbles(packed: DataFrame, x0: int, y0: int, width: int) -> DataFrame:
    halves = packed.select("byte_no", F.posexplode(F.array(F.shiftright("byte", 4), F.col("byte").bitwiseAND(F.lit(15)))).alias("half", "q"))
    i = F.col("byte_no") * 2 + F.col("half")
    return halves.where(F.col("q") < OUTSIDE).select((F.pmod(i, F.lit(width)) + x0).cast("long").alias("cx"), (F.floor(i / width) + y0).cast("long").alias("cy"), F.col("q").cast("int").alias("q"))


def weight(q, scale: float) -> Column:
    """Weight of a depth at a scale from 0 to 1; the interior counts only at full scale."""
    q = F.col(q) if isinstance(q, str) else q
    by_depth = F.floor(F.lit(float(FULL)) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(scale * LEVELS) - q)) + 0.5)
    return F.when(q < LEVELS, by_depth).when(q == INTERIOR, FULL if scale >= 0.999 else 0).otherwise(0).cast("long")


def visible_depth(q, scale: float) -> Column:
    """The two-valued variant, for outlines."""
    import math

    q = F.col(q) if isinstance(q, str) else q
    return (q <= min(LEVELS - 1, math.ceil(scale * LEVELS) - 1)) | (q == INTERIOR) & F.lit(scale >= 0.999)


def counts(cells: DataFrame, scale: float) -> DataFrame:
    """Level 0 of the pyramid: level, cx, cy, cnt."""
    return cells.select(F.lit(0).alias("level"), "cx", "cy", weight("q", scale).alias("cnt")).where("cnt > 0")


def pyramid(cells: DataFrame, scale: float, levels: int) -> DataFrame:
    """All levels up to `levels` halvings in one aggregation: each cell counts for its ancestors."""
    base = counts(cells, scale)
    up = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    p = F.pow(F.lit(2.0), F.col("level"))
    return up.groupBy("level", F.floor(F.col("cx") / p).cast("long").alias("cx"), F.floor(F.col("cy") / p).cast("long").alias("cy")).agg(F.sum("cnt").alias("cnt"))


def need(level: int, scale: float, low_power: bool = True) -> int:
    """Least count of a visible cell of a level; `low_power` is the map's curve below S0, else the outline's."""
    import math

    if level == 0:
        return 1
    if scale < S0 and low_power:
        t = T0 * (scale / S0) ** LOW_POWER
    else:
        t = CAP - (CAP - T0) * math.exp(-K * (scale - S0))
    return max(1, math.ceil(4**level * FULL * t))


def visible(levels: DataFrame, scale: float, most: int) -> DataFrame:
    """Cells of a pyramid that show."""
    limit = F.lit(need(0, scale))
    for k in range(1, most + 1):
        limit = F.when(F.col("level") == k, F.lit(need(k, scale))).otherwise(limit)
    return levels.where(F.col("cnt") >= limit)


def bridges(on: DataFrame) -> DataFrame:
    """cx, cy, flags of empty cells between two visible orthogonal neighbours: NW 1, NE 2, SW 4, SE 8.

    One aggregation: every visible cell tells its four neighbours which side it is on.
    """
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 16), (0, 1, 1), (0, -1, 2), (1, 0, 4), (-1, 0, 8))])
    told = on.select("cx", "cy", F.explode(sides).alias("s")).select((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"), F.col("s.bit").alias("bit"))
    seen = told.groupBy("cx", "cy").agg(F.bit_or("bit").alias("m")).where(F.col("m").bitwiseAND(F.lit(16)) == 0)
    has = lambda b: F.col("m").bitwiseAND(F.lit(b)) != 0
    north, south, west, east = has(1), has(2), has(4), has(8)
    flag = lambda c, v: F.when(c, v).otherwise(0)
    flags = flag(north & west, 1) + flag(north & east, 2) + flag(south & west, 4) + flag(south & east, 8)
    return seen.withColumn("flags", flags).where("flags > 0").select("cx", "cy", "flags")


def coverage(on: DataFrame, x0: int, y0: int, n: int) -> DataFrame:
    """i, j, visible, flags for the cells of a tile of n x n cells at (x0, y0) and one cell around it."""
    window = on.where(F.col("cx").between(x0 - 1, x0 + n) & F.col("cy").between(y0 - 1, y0 + n)).select("cx", "cy")
    shown = window.select("cx", "cy", F.lit(1).alias("visible"), F.lit(0).alias("flags"))
    inner = bridges(window).where(F.col("cx").between(x0, x0 + n - 1) & F.col("cy").between(y0, y0 + n - 1)).select("cx", "cy", F.lit(0).alias("visible"), "flags")
    return shown.unionByName(inner).select((F.col("cx") - x0).alias("i"), (F.col("cy") - y0).alias("j"), "visible", "flags")


def tile_flags(on: DataFrame, n: int) -> DataFrame:
    """tx, ty, n_on, n_bridged, full for every tile of n x n cells that shows anything."""
    tile = lambda c: F.floor(F.col(c) / n).cast("long")
    both = on.select("cx", "cy", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(bridges(on).select("cx", "cy", F.lit(0).alias("a"), F.lit(1).alias("b")))
    t = both.groupBy(tile("cx").alias("tx"), tile("cy").alias("ty")).agg(F.sum("a").alias("n_on"), F.sum("b").alias("n_bridged"))
    return t.withColumn("full", F.col("n_on") == n * n)


def outline_polygons(on: DataFrame) -> DataFrame:
    """cx, cy, ring: visible cells as squares, bridges as a triangle, a pentagon, or the whole cell."""
    shape = lambda *pts: F.array(*[F.struct((F.col("cx") + float(x)).alias("x"), (F.col("cy") + float(y)).alias("y")) for x, y in pts])
    square = shape((0, 0), (1, 0), (1, 1), (0, 1))
    by_flags = {
        1: shape((0, 0), (1, 0), (0, 1)), 2: shape((1, 0), (1, 1), (0, 0)), 4: shape((0, 1), (0, 0), (1, 1)), 8: shape((1, 1), (0, 1), (1, 0)),
        3: shape((0, 0), (1, 0), (1, 1), (0.5, 0.5), (0, 1)), 10: shape((1, 0), (1, 1), (0, 1), (0.5, 0.5), (0, 0)),
        12: shape((1, 1), (0, 1), (0, 0), (0.5, 0.5), (1, 0)), 5: shape((0, 1), (0, 0), (1, 0), (0.5, 0.5), (1, 1)),
    }
    ring = square
    for flags, points in by_flags.items():
        ring = F.when(F.col("flags") == flags, points).otherwise(ring)
    all_ = on.select("cx", "cy", F.lit(0).alias("flags")).unionByName(bridges(on).select("cx", "cy", "flags"))
    return all_.select("cx", "cy", ring.alias("ring"))


def boundary_edges(polygons: DataFrame) -> DataFrame:
    """ax, ay, bx, by: directed edges whose reverse is no edge (polygons of one orientation that do not overlap)."""
    n = F.size("ring")
    pairs = F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.element_at(F.col("ring"), F.pmod(i + 1, n).cast("int") + 1).alias("b")))
    e = polygons.select(F.explode(pairs).alias("e")).select(F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    return e.join(e.select(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by")), ["ax", "ay", "bx", "by"], "left_anti")
