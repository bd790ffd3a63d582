"""Operators over a forest of downstream pointers (id, down, up, len)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir.

    Without that setting a session of one machine gets a temporary folder; on a cluster, whose executors would not see one
    another's files there, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write an iteration's table to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that `cut` wrote and that nothing reads any more."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def main_predecessor(reach: DataFrame) -> DataFrame:
    """For each reach that has any, its largest upstream neighbour (the first on ties): down, main_id."""
    known = reach.select(F.col("id").alias("down"))
    return reach.join(known, "down").groupBy("down").agg(F.max_by("id", F.struct("up", -F.col("id"))).alias("main_id"))


def outlets(reach: DataFrame) -> DataFrame:
    return reach.join(reach.select(F.col("id").alias("_d")), F.col("down") == F.col("_d"), "left_anti")


def headwaters(reach: DataFrame) -> DataFrame:
    return reach.join(reach.select(F.col("down").alias("_u")), F.col("id") == F.col("_u"), "left_anti")


def chain_links(reach: DataFrame) -> DataFrame:
    """id, nxt, len, up: nxt is the next reach of the same chain, null at a chain's mouth."""
    main = main_predecessor(reach).select(F.col("main_id").alias("id"), F.col("down").alias("nxt"))
    return reach.select("id", "len", "up").join(main, "id", "left")


def chain_members(reach: DataFrame) -> DataFrame:
    """id, chain (its mouth), hops and km to the chain's mouth, own length included, by pointer doubling."""
    state = cut(chain_links(reach).select("id", "nxt", F.col("id").alias("last"), F.lit(0).cast("long").alias("hops"), F.col("len").alias("km")), "chain")
    # A round doubles what a pointer spans.
    for _ in rounds(state.count().bit_length()):
        if not state.where("nxt is not null").limit(1).count():
            break
        ahead = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("n2"), F.col("last").alias("l2"), F.col("hops").alias("h2"), F.col("km").alias("k2"))
        # `hops` and `km` reach up to, not into, `nxt`; at a mouth they are final.
        joined = state.join(ahead, "nxt", "left")
        after = cut(
            joined.select(
                "id",
                F.col("n2").alias("nxt"),
                F.coalesce("l2", "last").alias("last"),
                (F.col("hops") + F.when(F.col("nxt").isNull(), 0).otherwise(F.col("h2") + 1)).alias("hops"),
                (F.col("km") + F.coalesce("k2", F.lit(0.0))).alias("km"),
            ),
            "chain",
        )
        drop(state)
        state = after
    return state.select("id", F.col("last").alias("chain"), "hops", "km")


def chain_summary(reach: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(reach.select("id", "up", "len"), "id").groupBy("chain").agg(F.count("*").alias("n_reaches"), F.max("up").alias("max_up"), F.sum(F.col("len").cast("long")).alias("sum_len"))


def chain_edges(reach: DataFrame, members: DataFrame) -> DataFrame:
    """chain, next_chain, entry_km: where each chain's mouth flows into, null at the sea."""
    mouth = members.where("hops = 0").select("id", "chain")
    down = mouth.join(reach.select("id", "down"), "id").select("chain", "down")
    into = members.select(F.col("id").alias("down"), F.col("chain").alias("next_chain"), F.col("km").alias("entry_km"))
    return down.join(into, "down", "left").select("chain", "next_chain", "entry_km")


def rounds(most: int) -> Iterator[int]:
    """Rounds of a walk over `most` places, which the caller breaks off when nothing is left: a longer walk goes in a circle."""
    yield from range(most + 1)
    raise ValueError(f"a walk has not ended after {most} steps; is there a circle?")


def paths_to_sea(reach: DataFrame, members: DataFrame, tops: DataFrame, most: int | None = None) -> DataFrame:
    """id, hop, chain, km of every chain on the way from each top reach (id) to the sea; `most`: chains of a way, else all."""
    edges = cut(chain_edges(reach, members), "edges")
    at = cut(tops.select("id").join(members, "id").select("id", F.lit(0).cast("long").alias("hop"), "chain", "km"), "path")
    out = at
    for _ in rounds(edges.count() if most is None else most):
        at = cut(at.join(edges, "chain").where("next_chain is not null").select("id", (F.col("hop") + 1).alias("hop"), F.col("next_chain").alias("chain"), F.col("entry_km").alias("km")), "path")
        if not at.limit(1).count():
            break
        out = out.unionByName(at)
    return out


def main_stem(reach: DataFrame, members: DataFrame, least_up: float) -> DataFrame:
    """Reaches of the outlet's chain, from the mouth up, as long as the area stays at `least_up`."""
    outlet = outlets(reach).agg(F.max_by("id", F.struct("up", -F.col("id"))).alias("chain"))
    chain = members.join(outlet, "chain").join(reach.select("id", "up"), "id")
    low = chain.where(F.col("up") < least_up).groupBy("chain").agg(F.min("hops").alias("stop"))
    return chain.join(low, "chain", "left").where(F.col("stop").isNull() | (F.col("hops") < F.col("stop"))).select("id", "hops", "up")


def upstream_of(reach: DataFrame) -> DataFrame:
    """down, n, ids: upstream neighbours in order of id."""
    return reach.join(reach.select(F.col("id").alias("down")), "down").groupBy("down").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


def owner_by_fit(claims: DataFrame, key: str = "id") -> DataFrame:
    """Of claims (id, name, fit, seq), the best fit owns; the first on ties. `fit` -1 overrides."""
    return claims.groupBy(key).agg(F.min_by("name", F.struct("fit", "seq")).alias("owner"))


def fold_side_channels(reach: DataFrame, groups: DataFrame, members: DataFrame, most_hops: int = 40) -> DataFrame:
    """rid, into: minor groups of a name that meet the name's dominant chain within `most_hops` downstream hops.

    groups: name, rid, mouth, n_reaches, seq. Dominant: the group of most reaches, the first on ties.
    """
    dominant = groups.groupBy("name").agg(F.max_by(F.struct("rid", "mouth"), F.struct("n_reaches", -F.col("seq"))).alias("d"), F.count("*").alias("n")).where("n > 1")
    chain = dominant.select("name", F.col("d.rid").alias("into"), F.col("d.mouth").alias("dominant_mouth")).join(members.select(F.col("id").alias("dominant_mouth"), F.col("chain").alias("dominant_chain")), "dominant_mouth")
    minor = groups.join(chain, "name").where("rid <> into")
    at = cut(minor.join(reach.select(F.col("id").alias("mouth"), "down"), "mouth").select("name", "rid", "into", "dominant_chain", F.col("down").alias("at")), "fold")
    found = None
    chains = members.select(F.col("id").alias("at"), "chain")
    downs = reach.select(F.col("id").alias("at"), F.col("down").alias("nxt"))
    for _ in range(most_hops):
        here = at.join(chains, "at")
        met = here.where("chain = dominant_chain").select("rid", "into")
        found = met if found is None else found.unionByName(met)
        at = cut(here.where("chain <> dominant_chain").join(downs, "at").select("name", "rid", "into", "dominant_chain", F.col("nxt").alias("at")), "fold")
        if not at.limit(1).count():
            break
    return found.distinct()


def walk_down(reach: DataFrame, starts: DataFrame, stop, most: int | None = None) -> DataFrame:
    """rid, last: follow `down` from (rid, id) until `stop(frame)` holds for the step (columns cur, nxt, cur_up, nxt_up).

    A walk of over `most` reaches, or else of more than there are, is an error.
    """
    nodes = reach.select("id", "down", "up")
    cur = cut(starts.select("rid", F.col("id").alias("cur")), "walk")
    done = None
    step = nodes.select(F.col("id").alias("cur"), F.col("down").alias("nxt"), F.col("up").alias("cur_up"))
    ahead = nodes.select(F.col("id").alias("nxt"), F.col("up").alias("nxt_up"))
    for _ in rounds(reach.count() if most is None else most):
        here = cur.join(step, "cur").join(ahead, "nxt", "left")
        ends = F.col("nxt_up").isNull() | F.coalesce(stop, F.lit(False))
        halted = here.where(ends).select("rid", F.col("cur").alias("last"))
        done = halted if done is None else done.unionByName(halted)
        cur = cut(here.where(~ends).select("rid", F.col("nxt").alias("cur")), "walk")
        if not cur.limit(1).count():
            break
    return done


def position_in_chain(members: DataFrame) -> DataFrame:
    """Members with their place from the head, 0 on."""
    return members.withColumn("from_head", F.row_number().over(W.partitionBy("chain").orderBy(F.col("hops").desc())) - 1)
