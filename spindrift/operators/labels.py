"""Matching named lines with reaches, and filling gaps of one source of names from another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, km
from ..functions.text import MINOR_MOST_UP, alternatives, label_key, plausible, same_name
from . import spatial
from .names import uncovered
from .sequences import evenly_spaced, kept_after_moves, points_along, segments

# Radius of like names, narrow and wide matches, length of a long line (all km).
SAME_NAME_KM, NARROW_KM, WIDE_KM, LONG_KM = 3.0, 1.5, 6.0, 200.0


def match_lines(lines: DataFrame, vertices: DataFrame, reach: DataFrame, minor_most: float = MINOR_MOST_UP, samples: int = 16) -> DataFrame:
    """line, how, hits, median_up: the size of the reaches that a line runs along.

    lines: line, name; vertices: line, seq (from 1), lon, lat, target (area, or null). Up to `samples` vertices are matched:
    by the closest size where there is a target, by the largest within the wide radius on long lines, else by the nearest,
    and by the nearest within the wide radius where less than half of them find anything. Minor waters keep small matches
    only. Lines of which less than half the samples match are left out.
    """
    path = vertices.withColumnRenamed("line", "path_id")
    picked = evenly_spaced(path, samples).select(F.col("path_id").alias("line"), F.struct(F.col("path_id").alias("line"), "sample").alias("pid"), "lon", "lat", "target")
    long = segments(path.select("path_id", "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))).groupBy(F.col("path_id").alias("line")).agg(F.sum(km("x1", "y1", "x2", "y2", "start")).alias("km"))
    sized = picked.groupBy("line").agg(F.greatest(F.lit(1.0), F.count("*") / 2).alias("need"), F.max(F.col("target").isNotNull()).alias("aimed"))
    how = F.when(F.col("aimed"), "size").when(F.coalesce("km", F.lit(0.0)) >= LONG_KM, "largest").otherwise("nearest")
    kinds = spatial.cut(lines.join(sized, "line").join(long, "line", "left").select("line", "name", "need", how.alias("how")), "lines")

    def points(chosen: DataFrame) -> DataFrame:
        return picked.join(chosen.select("line"), "line", "left_semi").select("pid", "lon", "lat", "target")

    def kept(matches: DataFrame) -> DataFrame:
        m = matches.select(F.col("pid")["line"].alias("line"), "up").join(kinds, "line")
        return m.where(plausible("name", "up", minor_most)).groupBy("line", "how", "need").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list("up")).alias("ups")).where("hits >= need")

    near = points(kinds.where("how = 'nearest'")).drop("target")
    first = spatial.nearest(near, reach, NARROW_KM)
    first = first.unionByName(spatial.closest_size_within(points(kinds.where("how = 'size'")), reach))
    first = first.unionByName(spatial.largest_within(points(kinds.where("how = 'largest'")).drop("target"), reach, WIDE_KM))
    sure = spatial.cut(kept(first.select("pid", "up")), "matched")
    failed = kinds.where("how = 'nearest'").join(sure.select("line"), "line", "left_anti")
    wide = kept(spatial.nearest(points(failed).drop("target"), reach, WIDE_KM).select("pid", "up"))
    # The greater of the two middle values, as many as `samples` of them.
    return sure.unionByName(wide).select("line", "how", "hits", F.element_at("ups", F.floor(F.size("ups") / 2).cast("int") + 1).alias("median_up"))


def claimed_reaches(lines: DataFrame, vertices: DataFrame, reach: DataFrame, minor_most: float = MINOR_MOST_UP) -> DataFrame:
    """id of the reaches that a line runs along: nearest to a vertex, sizes that its name allows. vertices: path_id, seq, x, y."""
    kept = kept_after_moves(vertices).select(F.struct("path_id", "seq").alias("pid"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    found = spatial.nearest(kept, reach, NARROW_KM).select(F.col("pid")["path_id"].alias("path_id"), "id", "up")
    return found.join(lines.select("path_id", "name"), "path_id").where(plausible("name", "up", minor_most)).select("id").distinct()


def named_cells(lines: DataFrame, vertices: DataFrame) -> DataFrame:
    """gx, gy, key, seq: the keys of the names that pass through a cell, with the first line (by its `seq`, then part) of each."""
    keys = lines.select("path_id", F.col("seq").alias("order"), F.posexplode(alternatives("name")).alias("part", "key"))
    return points_along(vertices, SAME_NAME_KM).join(keys, "path_id").groupBy("gx", "gy", "key").agg(F.min(F.struct("order", "part")).alias("first"))


def gap_fill(primary: DataFrame, primary_vertices: DataFrame, secondary: DataFrame, secondary_vertices: DataFrame, reach: DataFrame, minor_most: float = MINOR_MOST_UP) -> DataFrame:
    """path_id, first, last, n, metres, name: the runs of secondary lines that the primary source does not name.

    lines: path_id, seq (their order), name; vertices: path_id, seq, x, y, and up for the secondary ones. A vertex is covered
    where a primary line of a like name passes in the three by three cells around it, or where the reach of the closest size
    is one that a primary line runs along. A run takes the primary source's spelling, if one names part of its line.
    """
    size = SAME_NAME_KM / KM_PER_DEG
    v = secondary_vertices.join(secondary.select("path_id", label_key("name").alias("own")), "path_id")
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    spread = v.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    spread = spread.select("path_id", "seq", "own", "dx", "dy", (F.floor(F.col("x") / size).cast("long") + F.col("dx")).alias("gx"), (F.floor(F.col("y") / size).cast("long") + F.col("dy")).alias("gy"))
    like = spread.join(named_cells(primary, primary_vertices), ["gx", "gy"]).where(same_name("own", "key"))
    plain = primary.where(~F.col("name").contains("/")).select(F.get(alternatives("name"), F.lit(0)).alias("key"), "seq", "name").groupBy("key").agg(F.min_by("name", "seq").alias("spelling"))
    by_name = spatial.cut(like.groupBy("path_id", "seq").agg(F.min_by("key", F.struct("dx", "dy", "first")).alias("key")), "like")
    spelled = by_name.join(plain, "key").groupBy("path_id").agg(F.min_by("spelling", "seq").alias("spelling"))
    open_ = v.join(by_name, ["path_id", "seq"], "left_anti").select(F.struct("path_id", "seq").alias("pid"), F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("up").alias("target"))
    matched = spatial.closest_size_within(open_, reach).select("pid", "id")
    by_reach = matched.join(claimed_reaches(primary, primary_vertices, reach, minor_most), "id", "left_semi").select("pid.path_id", "pid.seq")
    runs = uncovered(secondary_vertices.select("path_id", "seq", "x", "y"), by_name.select("path_id", "seq").unionByName(by_reach))
    return runs.join(secondary.select("path_id", "name"), "path_id").join(spelled, "path_id", "left").select("path_id", "first", "last", "n", "metres", F.coalesce("spelling", "name").alias("name"))
