"""Byte-balanced sharding by Karmarkar-Karp differencing (operator 2).

Documents of equal text are one group and stay together, unless the group alone exceeds a fair shard: then it is dealt
in pieces. Groups are hashed into blocks of bounded size; within a block, differencing repeatedly takes the two partial
partitions of largest spread and adds them in opposite order. The blocks' partial partitions are differenced in the same
way, level by level, so no task sees more than a block of groups or a fan of partial partitions.

Null texts form one group of size 8 each; rows with equal doc_id are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 24
#: Groups in a block, partial partitions that one task combines, and rows that share a numbering part.
BLOCK_GROUPS, FAN, PART_ROWS = 20_000, 256, 4_000
#: Groups of equal texts that may hold more than one part in so many of all rows.
HOT_GROUPS = 1_000


def differencing(partials: np.ndarray) -> np.ndarray:
    """Combine partial partitions (one row each, `shards` sums); gives the shard of each sum, row by row."""
    m, shards = partials.shape
    sums: list[np.ndarray | None] = []
    names: list[np.ndarray] = []
    parents: list[tuple[int, int, np.ndarray, np.ndarray] | None] = [None] * m
    heap = []
    for i in range(m):
        order = np.argsort(-partials[i], kind="stable")
        s = partials[i][order]
        names.append(order)
        sums.append(s - s[-1])
        heap.append((-int(s[0] - s[-1]), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joined = sums[a] + sums[b][::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        joined = joined - joined[-1]
        sums[a] = sums[b] = None
        sums.append(joined)
        parents.append((a, b, order, shards - 1 - order))
        heapq.heappush(heap, (-int(joined[0]), len(sums) - 1))
    shard_of: dict[int, np.ndarray] = {len(parents) - 1: np.arange(shards)}
    out = np.zeros((m, shards), np.int32)
    for k in range(len(parents) - 1, -1, -1):
        mine = shard_of.pop(k)
        if parents[k] is None:
            out[k][names[k]] = mine
        else:
            a, b, pa_, pb = parents[k]
            left, right = np.empty(shards, np.int64), np.empty(shards, np.int64)
            left[pa_] = mine
            right[pb] = mine
            shard_of[a], shard_of[b] = left, right
    return out


def _block(shards: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_key", "ascending"), ("_piece", "ascending")])
        partials = np.zeros((len(t), shards), np.int64)
        partials[:, 0] = t.column("bytes").to_numpy()
        return t.select(["_key", "_piece", "node", "bytes"]).append_column("label", pa.array(differencing(partials)[:, 0], pa.int32()))

    return run


def _fan(shards: int):
    def run(t: pa.Table) -> pa.Table:
        nodes, at = np.unique(t.column("node").to_numpy(), return_inverse=True)
        partials = np.zeros((len(nodes), shards), np.int64)
        partials[at, t.column("label").to_numpy()] = t.column("bytes").to_numpy()
        to = differencing(partials)
        n = len(nodes)
        return pa.table({"node": pa.array(np.repeat(nodes, shards), pa.int64()), "label": pa.array(np.tile(np.arange(shards), n), pa.int32()), "parent": pa.array(np.full(n * shards, t.column("parent")[0].as_py()), pa.int64()), "to": pa.array(to.reshape(-1), pa.int32())})

    return run


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for documents (doc_id, text)."""
    raw = F.col("text").cast("binary")
    digest = materialise(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(raw, F.lit(b""))).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("_key"),
        ),
        "digest",
    )
    total = digest.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    rows, fair = total["rows"], max(1, (total["bytes"] or 0) // shards)
    groups = digest.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    large = groups.where((F.col("bytes") > fair) & (F.col("n") > 1)).collect()  # fewer than `shards` rows
    piece = F.lit(0)
    for r in large:
        pieces = min(r["n"], -(-r["bytes"] * 8 // fair))
        piece = F.when(F.col("_key") == F.lit(bytes(r["_key"])), F.pmod(F.xxhash64("doc_id"), F.lit(pieces)).cast("int")).otherwise(piece)
    digest = digest.withColumn("_piece", piece)

    n_groups = groups.count()
    blocks = max(1, -(-n_groups // BLOCK_GROUPS))
    items = digest.groupBy("_key", "_piece").agg(F.sum("size").alias("bytes")).withColumn("node", F.pmod(F.xxhash64("_key", "_piece"), F.lit(blocks)))
    labelled = materialise(items.groupBy("node").applyInArrow(_block(shards), "_key binary, _piece int, node long, bytes long, label int"), "blocks")

    path = labelled.groupBy("node", "label").agg(F.sum("bytes").alias("bytes"))
    chain = None
    nodes = blocks
    while True:
        level = materialise(
            path.withColumn("parent", F.floor(F.col("node") / FAN)).groupBy("parent").applyInArrow(_fan(shards), "node long, label int, parent long, to int"),
            "fan",
        )
        sums = path.join(level, ["node", "label"]).groupBy("parent", "to").agg(F.sum("bytes").alias("bytes"))
        path = sums.select(F.col("parent").alias("node"), F.col("to").alias("label"), "bytes")
        if chain is None:
            chain = level.select(F.col("node").alias("block"), F.col("label").alias("block_label"), F.col("parent").alias("node"), F.col("to").alias("label"))
        else:
            chain = chain.join(level, ["node", "label"]).select("block", "block_label", F.col("parent").alias("node"), F.col("to").alias("label"))
        nodes = -(-nodes // FAN)
        if nodes == 1:
            break
    shard = chain.select(F.col("block").alias("node"), F.col("block_label").alias("label"), F.col("label").alias("shard"))
    assigned = labelled.join(shard, ["node", "label"]).select("_key", "_piece", "shard")
    # Groups of many rows (at most HOT_GROUPS by their number) meet their shards by broadcast, so that none fills a task.
    hot = F.broadcast(groups.where(F.col("n") > F.lit(max(PART_ROWS, rows // HOT_GROUPS))).select("_key"))
    usual = digest.join(hot, "_key", "left_anti").join(assigned, ["_key", "_piece"])
    many = digest.join(F.broadcast(assigned.join(hot, "_key", "left_semi")), ["_key", "_piece"])
    columns = ["doc_id", "size", "text_crc32", "shard"]
    placed = materialise(usual.select(*columns).unionByName(many.select(*columns)), "placed")
    return number_slots(placed, rows)


def number_slots(placed: DataFrame, rows: int) -> DataFrame:
    """Gapless slots from 0 in every shard, counted in parts so that a shard never meets in one task."""
    parts = max(1, rows // (SHARDS * PART_ROWS))
    parted = placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)))
    counts = parted.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = parted.withColumn("_in_part", F.row_number().over(W.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32")) - 1)
    return numbered.join(before, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_in_part")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
