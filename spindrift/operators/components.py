"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


#: Links above which a node is a hub, and the parts that the links of each node are dealt to where there are hubs.
HUB, SALTS = 1_000, 16


def _with_least(e: DataFrame, hubs: bool) -> DataFrame:
    """Links (u, v) with m, the least v of each u. Where there are hubs, links are dealt by v and the least travels to each part."""
    if not hubs:
        return e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")
    dealt = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    partial = dealt.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = partial.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return dealt.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def _both(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(e: DataFrame, hubs: bool) -> DataFrame:
    return _with_least(_both(e), hubs).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, hubs: bool) -> DataFrame:
    down = _with_least(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), hubs)
    # Every u keeps its least, and the others of its neighbours turn to it.
    return down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (u, v): the least node that it reaches. No links give no rows."""
    e = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        # A node gathers links as the stars grow, so every round looks for hubs anew.
        hubs = bool(_both(e).groupBy("u").count().where(F.col("count") > HUB).limit(1).count())
        e = cut(_small_star(_large_star(e, hubs), hubs), "links")
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if (now["n"], now["h"]) == seen:
            break
        seen = (now["n"], now["h"])
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
