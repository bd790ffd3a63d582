"""Operators that resolve names and merge sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alternatives, same_name
from .graph import cut

_AROUND = (-1, 0, 1)


#: Members of a class that travel together.
_DEALT = 256


def _classes(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Named points by equal names in one cell: classes (c, keys, gx, gy), and their members (c, ids) in parts."""
    keyed = points.select("id", alternatives("name").alias("keys"), "gx", "gy").where(F.size("keys") > 0)
    sizes = keyed.groupBy("keys", "gx", "gy").agg(F.count("*").alias("n"))
    classes = cut(sizes.withColumn("c", F.monotonically_increasing_id()), "classes")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / _DEALT))
    members = keyed.join(classes.hint("merge"), ["keys", "gx", "gy"]).groupBy("c", part.alias("part")).agg(F.collect_list("id").alias("ids"))
    return classes.select("c", "keys", "gx", "gy"), cut(members.select("c", "ids"), "members")


def _like_classes(a: DataFrame, b: DataFrame) -> DataFrame:
    """ac, bc of classes with a like name in the 3 x 3 block around their cell."""
    keys = lambda t, p: t.select(F.col("c").alias(f"{p}c"), F.explode("keys").alias(f"{p}key"), "gx", "gy")
    block = F.array(*[F.lit(i) for i in _AROUND])
    spread = keys(b, "b").withColumn("dx", F.explode(block)).withColumn("dy", F.explode(block)).select("bc", "bkey", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"))
    return keys(a, "a").join(spread.hint("merge"), ["gx", "gy"]).where(same_name("akey", "bkey")).select("ac", "bc").distinct()


def near_same_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """aid, bid of named points (id, name, gx, gy) with a like name in the 3 x 3 block around their cell.

    Names are compared once for all points of equal names in a cell; the pairs of points are unfolded last, where nothing
    sorts or shuffles them, unless ids repeat.
    """
    (ca, ma), (cb, mb) = (of_a := _classes(a)), of_a if b is a else _classes(b)
    links = cut(_like_classes(ca, cb), "links")
    left = links.join(ma.select(F.col("c").alias("ac"), F.col("ids").alias("aids")).hint("merge"), "ac")
    both = left.join(mb.select(F.col("c").alias("bc"), F.col("ids").alias("bids")).hint("merge"), "bc")
    pairs = both.select("aids", F.explode("bids").alias("bid")).select(F.explode("aids").alias("aid"), "bid")
    repeats = any(t.groupBy("id").count().where("count > 1").limit(1).count() for t in ([a] if b is a else [a, b]))
    return pairs.distinct() if repeats else pairs


def first_spelling(names: DataFrame, key: Column) -> DataFrame:
    """key, name: the first spelling (by seq) of every key."""
    return names.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min_by("name", "seq").alias("name"))


def priority_union(*sources: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several sources, the first source's (then the first seq's) for each key."""
    all_ = None
    for rank, s in enumerate(sources):
        part = s.withColumn("prio", F.lit(rank))
        all_ = part if all_ is None else all_.unionByName(part)
    rest = [c for c in all_.columns if c not in (key, "prio", "seq")]
    best = all_.groupBy(key).agg(F.min_by(F.struct(*rest, "prio"), F.struct("prio", "seq")).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.prio").alias("prio"))


def name_members(members: DataFrame, relations: DataFrame) -> DataFrame:
    """way, name: a way's own name, else that of the first relation (by seq) that holds it.

    members: way, own; relations: seq, name, ways (array).
    """
    held = relations.select("seq", "name", F.explode("ways").alias("way")).groupBy("way").agg(F.min_by("name", "seq").alias("rel_name"))
    return members.join(held, "way", "left").select("way", F.coalesce(F.nullif(F.col("own"), F.lit("")), "rel_name").alias("name")).where("name is not null")


def uncovered(vertices: DataFrame, covered: DataFrame) -> DataFrame:
    """Maximal runs of uncovered vertices of secondary lines, of two vertices and one kilometre at least.

    vertices: path_id, seq, x, y; covered: path_id, seq. Gives path_id, first, last, n, metres.
    """
    from ..functions.geo import km
    from .sequences import runs

    flagged = vertices.join(covered.select("path_id", "seq").distinct().withColumn("hit", F.lit(1)), ["path_id", "seq"], "left").withColumn("open", F.col("hit").isNull())
    spans = runs(flagged, "path_id", "seq", "open").where("open and n >= 2").select("path_id", "first", "last", "n")
    from .sequences import segments

    seg = segments(vertices).select("path_id", "seq", F.floor(km("x1", "y1", "x2", "y2", "end") * 1000 + 0.5).cast("long").alias("m"))
    inside = spans.join(seg, "path_id").where((F.col("seq") >= F.col("first")) & (F.col("seq") < F.col("last")))
    return inside.groupBy("path_id", "first", "last", "n").agg(F.sum("m").alias("metres")).where("metres >= 1000")
