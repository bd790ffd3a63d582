"""Ordered operators over vertices (path_id, seq, x, y, ...), as windows rather than loops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, km


def polylines(vertices: DataFrame, *more: str) -> DataFrame:
    """path_id, c: vertices of a path in order, as an array of structs."""
    return vertices.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y", *more))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), *[p[m].alias(m) for m in more])).alias("c"))


def segments(vertices: DataFrame) -> DataFrame:
    """path_id, seq, x1, y1, x2, y2 of consecutive vertices."""
    w = W.partitionBy("path_id").orderBy("seq")
    ahead = vertices.select("path_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return ahead.where("x2 is not null")


def lengths(vertices: DataFrame) -> DataFrame:
    """path_id and its length in metres by three conventions, each segment rounded to whole metres."""
    s = segments(vertices)
    metres = lambda at: F.sum(F.floor(km("x1", "y1", "x2", "y2", at) * 1000 + 0.5).cast("long"))
    return s.groupBy("path_id").agg(metres("start").alias("by_start"), metres("end").alias("by_end"), metres("mean").alias("by_mean"))


def runs(rows: DataFrame, group: str, order: str, *keys: str) -> DataFrame:
    """Maximal runs of equal keys: group, run, keys, first, last, n."""
    w = W.partitionBy(group).orderBy(order)
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(w))
    flagged = rows.withColumn("_new", F.when(F.lag(order).over(w).isNull() | changed, 1).otherwise(0))
    numbered = flagged.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(group, "run", *keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def islands(rows: DataFrame, group: str, order: str, flag: Column, least: int = 2) -> DataFrame:
    """Runs of rows for which `flag` holds, of at least `least` rows."""
    found = runs(rows.withColumn("_flag", flag), group, order, "_flag")
    return found.where(F.col("_flag") & (F.col("n") >= least)).drop("_flag")


def overlapping_runs(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Runs of a key, each with the first row of the next run as its end; a run of one last row gives nothing."""
    found = runs(rows, group, order, key)
    ends = rows.groupBy(group).agg(F.max(order).alias("_end"))
    out = found.join(ends, group).withColumn("end", F.least(F.col("last") + 1, F.col("_end")))
    return out.where("end > first").select(group, "run", key, "first", "end")


def evenly_spaced(vertices: DataFrame, most: int = 16) -> DataFrame:
    """Up to `most` vertices at even steps of their index, first and last among them; repeats stay."""
    size = vertices.groupBy("path_id").agg(F.count("*").alias("n"))
    samples = size.withColumn("samples", F.least("n", F.lit(most)))
    picked = samples.withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1)))
    picked = picked.withColumn("seq", F.floor(F.col("sample") * (F.col("n") - 1) / F.greatest(F.col("samples") - 1, F.lit(1))) + 1)
    return picked.select("path_id", "sample", "seq").join(vertices, ["path_id", "seq"])


def slice_km(vertices: DataFrame, from_km: float, to_km: float) -> DataFrame:
    """The part of each course (head to mouth) between two distances from the mouth, from_km > to_km.

    Distances run back from the last vertex by mean-latitude kilometres; cut points are interpolated; beyond the head the
    head is the end. Gives path_id, place (0 on, from the head), x, y.
    """
    w = W.partitionBy("path_id").orderBy(F.col("seq").desc())
    back = vertices.withColumn("px", F.lead("x").over(w)).withColumn("py", F.lead("y").over(w))
    back = back.withColumn("seg", km("x", "y", "px", "py", "mean"))
    upto = F.coalesce(F.sum("seg").over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    back = back.withColumn("after", upto).withColumn("before", F.col("after") - F.coalesce("seg", F.lit(0.0)))
    whole = back.where((F.col("before") > to_km) & (F.col("before") < from_km) | (F.col("before") <= to_km) & (F.lit(to_km) <= 0) & (F.col("before") == 0)).select("path_id", F.col("before").alias("d"), "x", "y")
    cuts = None
    for d in (to_km, from_km):
        inside = (F.col("before") <= d) & (F.col("after") > d) if d == to_km else (F.col("before") < d) & (F.col("after") >= d)
        t = (F.lit(d) - F.col("before")) / F.col("seg")
        at = back.where(inside & F.col("seg").isNotNull() & (F.lit(d) > 0)).select("path_id", F.lit(float(d)).alias("d"), (F.col("x") + (F.col("px") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("py") - F.col("y")) * t).alias("y"))
        cuts = at if cuts is None else cuts.unionByName(at)
    points = whole.unionByName(cuts)
    return points.withColumn("place", F.row_number().over(W.partitionBy("path_id").orderBy(F.col("d").desc())) - 1).select("path_id", "place", "x", "y")


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker over c (array of struct x, y); longitudes scaled at the first vertex, strict comparison."""

    def thin(c: list) -> list:
        if len(c) <= 2:
            return c
        p = np.array([(v["x"], v["y"]) for v in c])
        p[:, 0] *= np.cos(p[0, 1] * np.pi / 180)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        work = [(0, len(p) - 1)]
        while work:
            a, b = work.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            ll = float(d @ d)
            rel = p[a + 1 : b] - p[a]
            t = np.clip(rel @ d / ll, 0, 1) if ll > 0 else np.zeros(b - a - 1)
            off = ((t[:, None] * d - rel) ** 2).sum(axis=1)
            k = int(off.argmax())
            if off[k] > tolerance * tolerance:
                keep[a + 1 + k] = True
                work += [(a, a + 1 + k), (a + 1 + k, b)]
        return [v for v, k in zip(c, keep, strict=True) if k]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["c"] = [thin(list(c)) for c in f["c"]]
            yield f

    return lines.select("path_id", "c").mapInPandas(run, lines.select("path_id", "c").schema)


def merge_runs(chains: DataFrame, zoom: int) -> DataFrame:
    """Runs of a chain grouped until a group is long enough for the zoom.

    chains: chain, runs (array of struct ord, rem, km, in order). Gives chain, grp, ord, rem, km. A group under three
    pixels takes the next run in, as does one of the same order and level; order comes from the longest part, the level is
    the length-weighted mean, rounded at every step. A short last group joins the one before it.
    """
    least = 3 * 40075 / (512 * 2**zoom)
    group = "struct<ord:int,rem:int,km:double,rem_km:double,longest:double>"

    def absorb(g: Column, r: Column) -> Column:
        """r counts with its own level and length."""
        total, weighted = g["km"] + r["km"], g["rem_km"] + r["rem"] * r["km"]
        longer = r["km"] > g["longest"]
        return F.struct(F.when(longer, r["ord"]).otherwise(g["ord"]).alias("ord"), F.floor(weighted / total + 0.5).cast("int").alias("rem"), total.alias("km"), weighted.alias("rem_km"), F.when(longer, r["km"]).otherwise(g["longest"]).alias("longest"))

    def fresh(r: Column) -> Column:
        return F.struct(r["ord"].cast("int").alias("ord"), r["rem"].cast("int").alias("rem"), r["km"].alias("km"), (r["rem"] * r["km"]).alias("rem_km"), r["km"].alias("longest"))

    def add(groups: Column, r: Column) -> Column:
        last = F.element_at(groups, -1)
        joins = (last["km"] < least) | (last["ord"] == r["ord"]) & (last["rem"] == r["rem"])
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(absorb(last, r)))
        return F.when(F.size(groups) == 0, F.array(fresh(r))).when(joins, grown).otherwise(F.concat(groups, F.array(fresh(r))))

    def close(groups: Column) -> Column:
        n = F.size(groups)
        last = F.element_at(groups, -1)
        tail = F.concat(F.slice(groups, F.lit(1), n - 2), F.array(absorb(F.element_at(groups, n - 1), last)))
        return F.when((n > 1) & (last["km"] < least), tail).otherwise(groups)

    folded = F.aggregate("runs", F.array().cast(f"array<{group}>"), add, close)
    return chains.select("chain", F.posexplode(folded).alias("grp", "g")).select("chain", "grp", "g.ord", "g.rem", "g.km")


def kept_after_moves(vertices: DataFrame, least: float = 0.003) -> DataFrame:
    """Vertices that moved at least `least` degrees (sum of both axes) since the last kept one; the first is kept."""
    w = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    empty = F.array().cast("array<struct<seq:bigint,x:double,y:double>>")

    def add(kept: Column, v: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.abs(v["x"] - last["x"]) + F.abs(v["y"] - last["y"]) >= least
        return F.when(F.size(kept) == 0, F.array(v)).when(far, F.concat(kept, F.array(v))).otherwise(kept)

    return vertices.groupBy("path_id").agg(F.aggregate(w, empty, add).alias("kept")).select("path_id", F.explode("kept").alias("v")).select("path_id", "v.seq", "v.x", "v.y")


def points_along(vertices: DataFrame, cell_km: float = 3.0) -> DataFrame:
    """Cells of `cell_km` that a path touches, stepping along every segment."""
    size = cell_km / KM_PER_DEG
    s = segments(vertices)
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) / size).cast("int"))
    t = F.col("i") / F.col("n")
    steps = s.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return steps.select("path_id", F.floor((F.col("x1") + (F.col("x2") - F.col("x1")) * t) / size).cast("long").alias("gx"), F.floor((F.col("y1") + (F.col("y2") - F.col("y1")) * t) / size).cast("long").alias("gy")).distinct()
