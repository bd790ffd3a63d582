"""Writers of what a river map serves."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seq import delta_encode


def ndjson(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def json_documents(df: DataFrame, key: str, path: str) -> None:
    """One JSON text for each row under its key, for maps too large for one document."""
    value = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.from_json(value, "map<string,string>"))).alias("value")).write.mode("overwrite").text(path)


def tiles(features: DataFrame, path: str) -> DataFrame:
    """Features (z, x, y, ...) partitioned by tile; gives the index of tiles: z, x, y, n."""
    features.repartition("z", "x").sortWithinPartitions("y").write.mode("overwrite").partitionBy("z", "x").parquet(path)
    return features.groupBy("z", "x", "y").agg(F.count("*").alias("n"))


def tile_of(zoom: int, lon: str, lat: str):
    """x, y of the web-mercator tile of a point."""
    from ..functions.geo import mercator_x, mercator_y

    n = float(2**zoom)
    return F.floor(mercator_x(lon) * n).cast("long"), F.floor(mercator_y(lat) * n).cast("long")


def chain_files(chains: DataFrame, path: str) -> None:
    """Courses (chain, c) as delta-coded JSON arrays, partitioned by chain."""
    chains.select("chain", F.to_json(delta_encode("c")).alias("value")).repartition("chain").write.mode("overwrite").partitionBy("chain").text(path)


def packed_rows(packed: DataFrame, width: int, rows: int) -> DataFrame:
    """block, body: gzip bodies of packed depths in blocks of whole grid rows, each built in one task of bounded size.

    Blocks joined in order are the grid's bytes; a block no row of which is inside is left out (all outside).
    """
    import pandas as pd

    size = width * rows // 2

    def build(f: pd.DataFrame) -> pd.DataFrame:
        body = bytearray(b"\xff" * size)
        base = int(f["block"].iloc[0]) * size
        for i, b in zip(f["byte_no"], f["byte"], strict=True):
            body[int(i) - base] = int(b)
        return pd.DataFrame({"block": [int(f["block"].iloc[0])], "body": [gzip.compress(bytes(body), 9)]})

    return packed.withColumn("block", F.floor(F.col("byte_no") / size).cast("long")).groupBy("block").applyInPandas(build, "block long, body binary")
