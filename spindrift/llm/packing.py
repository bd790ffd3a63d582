"""Best-fit packing by length patterns (operator 6).

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most `capacity` rows)
reaches the driver. There, patterns of a few lengths are enumerated on a coarse grid, non-negative least squares fits how
often each is used, the counts are rounded down, each pattern is filled with exact lengths, and what remains is packed
best fit, longest first. The plan is a list of runs "the next r pieces of length l stand at offset o in r sequences",
of a size bounded by the capacity, not by the data. Pieces take their place in the runs by their rank within a length,
which is counted in parts, so no length, however common, meets in one task.

Null text counts as empty (the end id alone). Rows with equal doc_id are separate documents. An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, parts_of, utf8_view
from .tokens import encoder, ids_crc32

CAPACITY = 4096
#: The grid of the pattern fit, and the documents in a pattern.
GRAIN, PATTERN_DOCS = 64, 4
#: Rows that share a counting part of a length, about.
PART_ROWS = 8_000


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        w = target - gram @ x
        w[passive] = -np.inf
        k = int(np.argmax(w))
        if w[k] <= tol:
            break
        passive[k] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(p, p)], target[p], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[p] = s
                break
            low = s <= 0
            step = float(np.min(x[p][low] / np.maximum(x[p][low] - s[low], 1e-300)))
            x[p] += step * (s - x[p])
            drop = p[low & (x[p] <= 1e-9)]
            if not len(drop):
                drop = p[[int(np.argmin(s))]]
            passive[drop] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def patterns(total: int, most: int) -> list[tuple[int, ...]]:
    """Falling tuples of one to `most` positive numbers with sum `total`."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, head: tuple[int, ...]) -> None:
        if left == 0:
            out.append(head)
            return
        if len(head) == most:
            return
        least = -(-left // (most - len(head)))
        for v in range(min(left, top), least - 1, -1):
            grow(left - v, v, (*head, v))

    grow(total, total, ())
    return out


class _Stock:
    """Lengths that are left, with their counts."""

    def __init__(self, hist: np.ndarray):
        self.count = hist.astype(np.int64).tolist()
        self.left = [l for l in range(1, len(self.count)) if self.count[l] > 0]

    def best(self, room: int, used: dict[int, int]) -> int:
        """The greatest length of at most `room` that is not used up; 0 if none."""
        k = bisect_right(self.left, room) - 1
        while k >= 0:
            l = self.left[k]
            if self.count[l] > used.get(l, 0):
                return l
            k -= 1
        return 0

    def take(self, used: dict[int, int], times: int) -> None:
        for l, m in used.items():
            self.count[l] -= m * times
            if self.count[l] == 0:
                self.left.pop(bisect_right(self.left, l) - 1)


def plan(hist: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN, most: int = PATTERN_DOCS) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, pieces, first sequence, offset) for a histogram of lengths, and the number of sequences."""
    stock = _Stock(hist)
    rank: dict[int, int] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    at = 0

    def put(lengths: list[int], times: int) -> None:
        nonlocal at
        offset = 0
        for l in lengths:
            first = rank.get(l, 0)
            runs.append((l, first, times, at, offset))
            rank[l] = first + times
            offset += l
        at += times

    def fill(lengths: list[int], used: dict[int, int], room: int) -> None:
        while room > 0 and (l := stock.best(room, used)):
            lengths.append(l)
            used[l] = used.get(l, 0) + 1
            room -= l

    def times(used: dict[int, int]) -> int:
        return min(stock.count[l] // m for l, m in used.items())

    if hist[capacity] > 0:
        n = int(hist[capacity])
        put([capacity], n)
        stock.take({capacity: 1}, n)
    cells = -(-capacity // grain)
    binned = np.zeros(cells + 1)
    np.add.at(binned, -(-np.arange(capacity + 1) // grain), np.r_[0, stock.count[1:]].astype(float))
    # A document takes half a cell less than its cell on average, so patterns may exceed the grid by that.
    shapes = [p for k in range(1, most + 1) for p in patterns(cells + k // 2, most) if len(p) == k and p[0] <= cells]
    matrix = np.zeros((cells + 1, len(shapes)))
    for j, p in enumerate(shapes):
        for v in p:
            matrix[v, j] += 1
    weight = np.arange(cells + 1, dtype=float)[:, None]
    fitted = np.floor(nnls(matrix * weight, binned * weight[:, 0]) + 1e-9).astype(np.int64) if binned.any() else np.zeros(len(shapes), np.int64)
    for j in sorted(np.flatnonzero(fitted), key=lambda j: shapes[j], reverse=True):
        wanted = int(fitted[j])
        while wanted > 0:
            room, used, lengths = capacity, {}, []
            for k, v in enumerate(shapes[j]):
                last = k == len(shapes[j]) - 1
                l = stock.best(room if last else min(room, v * grain), used)
                if not l or not last and l <= (v - 1) * grain:
                    lengths = []
                    break
                lengths.append(l)
                used[l] = used.get(l, 0) + 1
                room -= l
            if not lengths:
                break
            fill(lengths, used, room)
            n = min(wanted, times(used))
            put(lengths, n)
            stock.take(used, n)
            wanted -= n
    while stock.left:
        lengths, used = [], {}
        fill(lengths, used, capacity)
        n = times(used)
        put(lengths, n)
        stock.take(used, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), at


def _pieces(path: str, end_id: int | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in parts_of(batches, 1):
            if not len(batch):
                continue
            data, offsets = utf8_view(batch.column(1))
            ids, off = tokens.encode(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = off + np.arange(len(off))
            n = np.diff(off)
            pieces = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            raw = ids.astype("<u4")
            first = (off[row] + start).tolist()
            crc = [ids_crc32(raw[a : a + m]) for a, m in zip(first, length.tolist(), strict=True)]
            out = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([raw[a : a + m].tolist() for a, m in zip(first, length.tolist(), strict=True)], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def tokenise(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a materialised table of pieces; offsets in a sequence leave no gap."""
    rows = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    hist = np.zeros(capacity + 1, np.int64)
    for r in rows:
        hist[r["length"]] = r["count"]
    runs, _ = plan(hist, capacity)
    keys = runs[:, 0] << 44 | runs[:, 1]
    parts = max(1, int(hist.sum()) // PART_ROWS)

    parted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = parted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_part", (F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = parted.withColumn("_in_part", F.row_number().over(W.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_in_part"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            k = np.searchsorted(keys, f["length"].to_numpy(np.int64) << 44 | f["_rank"].to_numpy(np.int64), "right") - 1
            run = runs[k]
            f["sequence_id"] = run[:, 3] + f["_rank"].to_numpy(np.int64) - run[:, 1]
            f["offset"] = run[:, 4]
            yield f[columns]

    columns = [*pieces.columns, "sequence_id", "offset"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "_rank").mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut, and pack all documents (doc_id, text)."""
    return pack(materialise(tokenise(docs, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)
