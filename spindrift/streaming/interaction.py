"""Debounce, latest-wins and decaying velocity, for batches and for streams of events (user_id, ts, event_id, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def debounce(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Of each burst (events closer than the gap), the last: user_id, burst, n, last_event."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    step = micros - F.lag(micros).over(w)
    marked = events.withColumn("_new", F.when(step < gap_seconds * 1_000_000, 0).otherwise(1))
    bursts = marked.withColumn("burst", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return bursts.groupBy("user_id", "burst").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def debounce_stream(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same on a stream: a session closes once the watermark passes its gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("last_event"))


def latest_wins(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the greatest `order` for each key; works on a stream in update mode."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


#: What is left of a velocity after a frame, frames a second, the greatest velocity, and the least that still moves.
DECAY, FRAME_MS, MOST, LEAST = 0.9, 16.667, 0.25, 0.0004


def _fold(rate: float, frame_ms: float, most: float, least: float):
    """State (v, at) and an event (at in ms, impulse): the velocity decays by the time since the last event."""

    def add(s: Column, e: Column) -> Column:
        left = s["v"] * F.pow(F.lit(rate), (e["ms"] - s["ms"]) / frame_ms)
        left = F.when(F.abs(left) < least, 0.0).otherwise(left)
        kept = F.when(F.signum(e["impulse"]) != F.signum(left), 0.0).otherwise(left)
        return F.struct(F.greatest(F.lit(-most), F.least(F.lit(most), kept + e["impulse"])).alias("v"), e["ms"].alias("ms"))

    return add


def decay(events: DataFrame, rate: float = DECAY, frame_ms: float = FRAME_MS, most: float = MOST, least: float = LEAST) -> DataFrame:
    """user_id, velocity, n: the velocity after all impulses (user_id, ts, event_id, impulse) in order of time.

    Between events it decays by `rate` for each frame that passes, and rests once it is under `least`; an impulse against it
    starts from rest; it never exceeds `most`.
    """
    ms = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    ordered = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(ms.alias("ms"), "event_id", F.col("impulse").cast("double").alias("impulse")))).alias("es"))
    start = F.struct(F.lit(0.0).alias("v"), F.element_at("es", 1)["ms"].alias("ms"))
    return ordered.select("user_id", F.aggregate("es", start, _fold(rate, frame_ms, most, least), lambda s: s["v"]).alias("velocity"), F.size("es").cast("long").alias("n"))


def decay_stream(events: DataFrame, rate: float = DECAY, frame_ms: float = FRAME_MS, most: float = MOST, least: float = LEAST) -> DataFrame:
    """The same on a stream, with the velocity of each user and its time as state; gives the velocity after every micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        v, at, n = state.get if state.exists else (0.0, None, 0)
        rows = pd.concat(list(frames))
        rows["ms"] = rows["ts"].astype("datetime64[us]").astype("int64") / 1000.0
        for e in rows.sort_values(["ms", "event_id"]).itertuples():
            v *= rate ** ((e.ms - (e.ms if at is None else at)) / frame_ms)
            if abs(v) < least or (e.impulse > 0) - (e.impulse < 0) != (v > 0) - (v < 0):
                v = 0.0
            v, at, n = max(-most, min(most, v + e.impulse)), e.ms, n + 1
        state.update((v, at, n))
        yield pd.DataFrame({"user_id": [key[0]], "velocity": [v], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, velocity double, n long", "velocity double, at double, n long", "update", "NoTimeout")


def resumed_ingest(chunks: DataFrame, done: DataFrame, size: float) -> DataFrame:
    """Chunks (x0, y0, x1, y1) that lie in no finished chunk (the same columns, of any size up to `size` a side).

    A chunk meets the finished ones that touch the grid cell of its lower corner.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("long"), F.floor(F.col(b) / size).cast("long")))
    spread = done.select(*[F.col(c).alias(f"d{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("gx", cells("dx0", "dx1")).withColumn("gy", cells("dy0", "dy1"))
    own = chunks.withColumn("gx", F.floor(F.col("x0") / size).cast("long")).withColumn("gy", F.floor(F.col("y0") / size).cast("long"))
    inside = (F.col("x0") >= F.col("dx0")) & (F.col("y0") >= F.col("dy0")) & (F.col("x1") <= F.col("dx1")) & (F.col("y1") <= F.col("dy1"))
    same = (own["gx"] == spread["gx"]) & (own["gy"] == spread["gy"])
    return own.join(spread, same & inside, "left_anti").select(*chunks.columns)
