"""Roll-ups of attributes over lines (rid, up, km, line_id, k)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(lines: DataFrame, key: str = "rid", value: str = "up") -> DataFrame:
    """The sorted value at floor(n / 2), by a window rather than an array."""
    w = W.partitionBy(key)
    ranked = lines.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1)
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2)).select(key, F.col(value).alias("median_up"))


def weighted_median(lines: DataFrame) -> DataFrame:
    """The first sorted value at which the running length reaches half of the whole."""
    w = W.partitionBy("rid")
    # Lines of equal value share the running length that the last of them has.
    run = F.sum("km").over(w.orderBy("up").rangeBetween(W.unboundedPreceding, 0))
    c = lines.select("rid", "up", "km").withColumn("_run", run).withColumn("_all", F.sum("km").over(w))
    return c.where(F.col("_run") * 2 >= F.col("_all")).groupBy("rid").agg(F.min("up").alias("median_up"))


def supported_maximum(lines: DataFrame, least_km: int = 20, share_percent: int = 15) -> DataFrame:
    """The largest value of a long line whose size class (a third of it and above) holds enough length, else the median.

    The class's length comes from one running sum over values in falling order, with the thirds as rows among them.
    """
    values = lines.select("rid", F.col("up").alias("v"), F.lit(0).alias("kind"), "km", F.lit(None).cast("double").alias("up"))
    asks = lines.where(F.col("km") >= least_km).select("rid", (F.col("up") / 3).alias("v"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("km"), "up")
    w = W.partitionBy("rid").orderBy(F.col("v").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    both = values.unionByName(asks).withColumn("support", F.sum("km").over(w)).withColumn("total", F.sum("km").over(W.partitionBy("rid")))
    best = both.where((F.col("kind") == 1) & (F.col("support") * 100 >= F.col("total") * share_percent)).groupBy("rid").agg(F.max("up").alias("best"))
    return weighted_median(lines).join(best, "rid", "left").select("rid", F.coalesce("best", "median_up").alias("size_up"))


def own_reaches(lines: DataFrame, sizes: DataFrame, cap: float = 3.0, rivers: DataFrame | None = None, stem: DataFrame | None = None) -> DataFrame:
    """Lines up to `cap` times the river's size, off the part of the main stem that has another name.

    Where no line meets both, those of the first kind of failure alone count: off the other stem, of any size; where there is
    none either, all of the river's lines. rivers: rid, name; stem: id, name (lines have an id then); without them nothing is
    on a stem.
    """
    joined = lines.join(sizes, "rid")
    if stem is None:
        foreign = joined.withColumn("_foreign", F.lit(0))
    else:
        named = joined.join(rivers.select("rid", F.col("name").alias("_own")), "rid", "left").join(stem.select("id", F.col("name").alias("_stem")), "id", "left")
        foreign = named.withColumn("_foreign", F.when(F.col("_stem").isNull() | F.col("_stem").eqNullSafe(F.col("_own")), 0).otherwise(1)).drop("_own", "_stem")
    # 0: its own, 1: too large, 2: on a stretch of another name; a river keeps the least kinds that it has.
    kind = F.when(F.col("_foreign") == 1, 2).when(F.col("up") <= cap * F.col("size_up"), 0).otherwise(1)
    ranked = foreign.withColumn("_kind", kind).withColumn("_least", F.min("_kind").over(W.partitionBy("rid")))
    return ranked.where(F.col("_kind") <= F.col("_least")).drop("_foreign", "_kind", "_least")


def third_largest(owned: DataFrame) -> DataFrame:
    """name, u3: the third-largest value a name owns; it takes over at `up` iff u3 >= up / 3."""
    w = W.partitionBy("name").orderBy(F.col("up").desc())
    return owned.withColumn("_r", F.row_number().over(w)).where("_r = 3").select("name", F.col("up").alias("u3"))


def takes_over(owned: DataFrame, asks: DataFrame) -> DataFrame:
    """name, at_up, yes for asks (name, at_up)."""
    return asks.join(third_largest(owned), "name", "left").select("name", "at_up", F.coalesce(F.col("u3") >= F.col("at_up") / 3, F.lit(False)).alias("yes"))


def longest_section(sections: DataFrame) -> DataFrame:
    """Per reach, the longest section through it, the first on ties: id, rid."""
    return sections.groupBy("id").agg(F.max_by("rid", F.struct("length_km", -F.col("seq"))).alias("rid"))
