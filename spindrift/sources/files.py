"""Readers of the file formats of a river atlas. All go through Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REACH = "id long, down long, len double, up double, dis double, stra int, cls int, flow int, c array<array<double>>"
#: Positions of the gazetteer's columns that are kept.
GAZETTEER = {"name": 1, "lat": 4, "lon": 5, "class": 6, "code": 7, "cc": 8, "admin1": 10, "pop": 14, "elev": 15, "dem": 16}


def ndjson(spark: SparkSession, path: str, schema: str = REACH) -> DataFrame:
    """One JSON record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def features(spark: SparkSession, path: str, properties: str, coordinates: str) -> DataFrame:
    """Features of a whole GeoJSON document, properties flattened."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:{coordinates}>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Entries of a JSON object of like values: key, value."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated places by position; rows of under 15 fields are dropped, a missing elevation comes from the model."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("v")).where("size(v) >= 15")
    at = lambda k: F.get("v", GAZETTEER[k])
    number = lambda c, kind: c.try_cast(kind)
    elev = F.coalesce(number(F.nullif(at("elev"), F.lit("")), "double"), number(F.nullif(at("dem"), F.lit("")), "double"))
    return parts.select(*[at(k).alias(k) for k in ("name", "class", "code", "cc", "admin1")], *[number(at(k), "double").alias(k) for k in ("lat", "lon")], number(at("pop"), "long").alias("pop"), elev.alias("elev"))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def dbf(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of dBASE tables: row, then `columns` (name to long, double or string). A file is read in one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                n, head, size = struct.unpack("<IHH", raw[4:12])
                fields, at, pos = {}, 32, 1
                while raw[at] != 0x0D:
                    name, width = raw[at : at + 11].split(b"\0")[0].decode("latin-1"), raw[at + 16]
                    fields[name] = (pos, width)
                    pos += width
                    at += 32
                for lo in range(0, n, 50_000):
                    out = {"row": [], **{c: [] for c in columns}}
                    for i in range(lo, min(n, lo + 50_000)):
                        rec = raw[head + i * size : head + (i + 1) * size]
                        if rec[:1] == b"*":
                            continue
                        out["row"].append(i)
                        for c, kind in columns.items():
                            p, w = fields[c]
                            text = rec[p : p + w].decode("latin-1").strip()
                            out[c].append(text if kind == "string" else None if not text or text[0] == "*" else int(float(text)) if kind == "long" else float(text))
                    yield pd.DataFrame(out)

    return _binary(spark, path).mapInPandas(run, ", ".join(["row long", *(f"`{c}` {k}" for c, k in columns.items())]))


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """Poly-lines and polygons of a .shp file: row, part, c (array of struct x, y)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                at, row, out = 100, 0, []
                while at + 8 <= len(raw):
                    (words,) = struct.unpack(">I", raw[at + 4 : at + 8])
                    body = raw[at + 8 : at + 8 + 2 * words]
                    (kind,) = struct.unpack("<I", body[:4])
                    if kind in (3, 5):
                        parts, points = struct.unpack("<II", body[36:44])
                        firsts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
                        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
                        out += [(row, p, [{"x": xy[2 * k], "y": xy[2 * k + 1]} for k in range(firsts[p], firsts[p + 1])]) for p in range(parts)]
                    row += 1
                    at += 8 + 2 * words
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=["row", "part", "c"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["row", "part", "c"])

    return _binary(spark, path).mapInPandas(run, "row long, part int, c array<struct<x:double,y:double>>")


def packed_bytes(bodies: str):
    """at, byte of gzip bodies of packed depths, as an array; bytes of nothing but outside are left out."""

    @F.pandas_udf("array<struct<at:bigint,byte:int>>")
    def unpack(column: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for raw in column:
            data = np.frombuffer(gzip.decompress(raw), np.uint8)
            out.append([{"at": int(k), "byte": int(data[k])} for k in np.flatnonzero(data != 255)])
        return pd.Series(out)

    return unpack(bodies)


def packed_raster(spark: SparkSession, path: str) -> DataFrame:
    """byte_no, byte of a gzip file of packed depths, bytes of nothing but outside left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for f in frames:
            for raw in f["content"]:
                data = np.frombuffer(gzip.decompress(raw), np.uint8)
                full = np.flatnonzero(data != 255)
                for lo in range(0, len(full), 1_000_000):
                    at = full[lo : lo + 1_000_000]
                    yield pd.DataFrame({"byte_no": at, "byte": data[at].astype("int32")})

    return _binary(spark, path).mapInPandas(run, "byte_no long, byte int")


def optional(spark: SparkSession, path: str, schema: str, read) -> DataFrame:
    """read(spark, path), or no rows where nothing is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return read(spark, path)
    return spark.createDataFrame([], schema)
