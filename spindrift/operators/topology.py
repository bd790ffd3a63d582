"""Operators that chain segments into lines and rings; each group (a name, a component) is walked as a whole."""

from __future__ import annotations

import math
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components


def by_component(edges: DataFrame) -> DataFrame:
    """Edges (ax, ay, bx, by) with their component: edges of one meet at their ends, so each can be walked on its own."""
    ends = lambda x, y: F.xxhash64(F.col(x) + 0.0, F.col(y) + 0.0)
    keyed = edges.withColumn("_u", ends("ax", "ay")).withColumn("_v", ends("bx", "by"))
    found = components(keyed.select(F.col("_u").alias("u"), F.col("_v").alias("v")))
    joined = keyed.join(found, keyed["_u"] == found["node"], "left")
    return joined.select(F.coalesce("component", "_u").alias("component"), "ax", "ay", "bx", "by")


def shared_edges(rings: DataFrame) -> DataFrame:
    """lo, hi of edges that two owners or more have; rings: owner, a, b (comparable end points)."""
    e = rings.select("owner", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return e.groupBy("lo", "hi").agg(F.count_distinct("owner").alias("owners")).where("owners >= 2")


def chain_ways(ways: DataFrame) -> DataFrame:
    """name, line, place, id: ways of a name joined end to start, each way once, in order of seq.

    A line starts with the first way not used yet, grows forward from its end, then backward from its start; of several
    ways that fit, the first is taken. ways: name, id, seq, start_node, end_node.
    """

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        by_start, by_end = defaultdict(list), defaultdict(list)
        rows = list(f[["id", "start_node", "end_node"]].itertuples(index=False, name=None))
        for k, (_, a, b) in enumerate(rows):
            by_start[a].append(k)
            by_end[b].append(k)
        used, out, line = set(), [], 0
        for k in range(len(rows)):
            if k in used:
                continue
            used.add(k)
            chain = deque([k])
            for grow, index, side in ((lambda c: chain.append(c), by_start, 2), (lambda c: chain.appendleft(c), by_end, 1)):
                while True:
                    node = rows[chain[-1] if side == 2 else chain[0]][side]
                    nxt = next((c for c in index[node] if c not in used), None)
                    if nxt is None:
                        break
                    used.add(nxt)
                    grow(nxt)
            out += [(f["name"].iloc[0], line, place, rows[c][0]) for place, c in enumerate(chain)]
            line += 1
        return pd.DataFrame(out, columns=["name", "line", "place", "id"])

    return ways.groupBy("name").applyInPandas(walk, "name string, line int, place int, id long")


def chain_edges(edges: DataFrame) -> DataFrame:
    """component, line, place, x, y: undirected edges (component, ax, ay, bx, by) walked both ways into lines."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        segs = sorted({tuple(sorted(((a, b), (c, d)))) for a, b, c, d in f[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None)})
        at = defaultdict(list)
        for k, (p, q) in enumerate(segs):
            at[p].append(k)
            at[q].append(k)
        used, out = set(), []

        def grow(p: tuple) -> list:
            line = []
            while (k := next((k for k in at[p] if k not in used), None)) is not None:
                used.add(k)
                p = segs[k][1] if segs[k][0] == p else segs[k][0]
                line.append(p)
            return line

        n = 0
        for k, (p, q) in enumerate(segs):
            if k in used:
                continue
            used.add(k)
            line = grow(p)[::-1] + [p, q] + grow(q)
            out += [(f["component"].iloc[0], n, i, x, y) for i, (x, y) in enumerate(line)]
            n += 1
        return pd.DataFrame(out, columns=["component", "line", "place", "x", "y"])

    return edges.groupBy("component").applyInPandas(walk, "component long, line int, place int, x double, y double")


def trace_rings(edges: DataFrame) -> DataFrame:
    """component, ring, place, x, y: directed boundary edges closed into rings; at a pinch the sharpest turn is taken."""

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        out_of = defaultdict(list)
        for a, b, c, d in sorted(f[["ax", "ay", "bx", "by"]].itertuples(index=False, name=None)):
            out_of[a, b].append((c, d))
        rows, ring = [], 0
        for start in sorted(out_of):
            while out_of[start]:
                p, q = start, out_of[start].pop(0)
                line = [p]
                while q != start:
                    line.append(q)
                    dx, dy = q[0] - p[0], q[1] - p[1]
                    turn = lambda r, q=q, dx=dx, dy=dy: math.atan2(dx * (r[1] - q[1]) - dy * (r[0] - q[0]), dx * (r[0] - q[0]) + dy * (r[1] - q[1]))
                    if not out_of[q]:
                        break
                    best = max(out_of[q], key=turn)
                    out_of[q].remove(best)
                    p, q = q, best
                rows += [(f["component"].iloc[0], ring, i, x, y) for i, (x, y) in enumerate(line)]
                ring += 1
        return pd.DataFrame(rows, columns=["component", "ring", "place", "x", "y"])

    return edges.groupBy("component").applyInPandas(walk, "component long, ring int, place int, x double, y double")


def svg_path(rings: DataFrame) -> DataFrame:
    """component, d: closed rings as an SVG path."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    ring = rings.groupBy("component", "ring").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(number("x"), F.lit(" "), number("y")).alias("s")))).alias("p"))
    text = ring.select("component", "ring", F.concat(F.lit("M"), F.array_join(F.transform("p", lambda v: v["s"]), "L"), F.lit("Z")).alias("s"))
    return text.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", "s"))), lambda v: v["s"]), "").alias("d"))
