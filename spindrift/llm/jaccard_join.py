"""N-gram Jaccard join with signature trees (operator 7).

A document's set holds the hashes of its distinct five-word shingles. Two sets link if 100 * intersection >= 80 * union.

1. Candidates. In hash order, two linked sets share at least l of their first n - ceil(0.8 n) + l shingles (n: size,
   l: a tenth of n). Only these are shuffled, with a key of the set. Shingles that no other set has are known then; a set
   with too few others cannot link. The rest are put in order of frequency, and the rarest of each set that any link must
   touch become its cells. Sets that share cells, directly or through others, form blocks.
2. Signature trees. A block's sets, in order of size, are the leaves of a tree whose nodes hold the OR of their bitmaps, the
   range of sizes and the greatest excess of size over bits. A dual traversal drops pairs of nodes whose sizes or greatest
   possible overlap cannot reach the threshold, and pairs that are already joined; what is left is compared exactly.
3. Links (a spanning forest of each block) give components.

Equal sets are one class from the start. A block of many shingles is dealt in chunks, each pair of chunks in a task of its
own. Null text, and text without words, has size 0 and links with nothing, not even its like. To `link_documents`, rows with
equal doc_id are one document, which has the links of all their texts; to `keep_one_of_each` they are documents of their own. Words are split at U+0020 and U+0009 to U+000D; A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import ascii_space, hash_pieces, materialise, mix64, partitions, parts_of, ragged_take, release, repeats_ids, steps, tidy, utf8_view, words_of

SHINGLE = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles that one tree task holds, about.
TASK_SHINGLES = 3_000_000
LEAF, FANOUT = 8, 8
#: Pairs of nodes that are looked at together; links that these give prune the pairs that follow.
PAIRS = 512

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEED = np.random.default_rng(77).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their numbers."""
    rows = len(offsets) - 1
    folded = _FOLD[data]
    starts, ends, n = words_of(folded, offsets, ascii_space(folded))
    words = hash_pieces(folded, starts, ends, _SEED)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    bounds = np.r_[0, np.cumsum(n)]
    row = np.repeat(np.arange(rows), n)
    left = bounds[1:][row] - np.arange(len(words))
    acc = words.copy()
    for j in range(1, k):
        ahead = np.zeros(len(words), np.uint64)
        ahead[:-j] = words[j:]
        acc = np.where(left > j, mix64(acc * _ODD + ahead), acc)
    chosen = (left >= k) | (left == n[row])
    acc, row = acc[chosen], row[chosen]
    order = np.lexsort((acc, row))
    acc, row = acc[order], row[order]
    keep = np.r_[True, (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])]
    return acc[keep], np.bincount(row[keep], minlength=rows)


def set_keys(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    bounds = np.r_[0, np.cumsum(counts)]
    out = []
    for salt in (0x51ED270B7A2D39C5, 0xA24BAED4963EE407):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(salt)))]
        out.append(mix64((sums[bounds[1:]] - sums[bounds[:-1]]) + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """Intersection that a set of size n has with any set it links with."""
    return -(-n * PERCENT // 100)


def _spare(n: np.ndarray) -> np.ndarray:
    return n // 10 + 1


def prefix_size(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.minimum(n, n - _least_overlap(n) + _spare(n)), 0)


def cell_budget(n: np.ndarray) -> np.ndarray:
    """Of the prefix's shingles in order of frequency, how many any link must touch one of."""
    return np.where(n > 0, prefix_size(n) - _spare(_least_overlap(n)) + 1, 0)


_KINDS = "kind string, part int, doc_id long, n long, a long, b long, body binary"


def _post(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in parts_of(batches, 1):
            all_data, all_offsets = utf8_view(batch.column(1))
            values, counts = [], []
            for i, j in steps(all_offsets):
                v, c = shingle_sets(all_data[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i])
                p = prefix_size(c)
                a, b = set_keys(v, c)
                values.append(ragged_take(v, np.cumsum(c) - c, p))
                counts.append((c, a, b, p))
            if not counts:
                continue
            n, a, b, p = (np.concatenate(x) for x in zip(*counts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(["doc"] * len(n)), pa.array((a.view(np.uint64) % np.uint64(parts)).astype(np.int32)), batch.column(0), pa.array(n), pa.array(a), pa.array(b), pa.nulls(len(n), pa.binary())], names=["kind", "part", "doc_id", "n", "a", "b", "body"])
            once = np.sort(np.unique(a, return_index=True)[1])
            tokens = ragged_take(np.concatenate(values), (np.cumsum(p) - p)[once], p[once])
            yield from _deal("post", parts, squeeze, tokens, [(tokens, "<u8"), (np.repeat(a[once], p[once]), "<i8"), (np.repeat(n[once], p[once]), "<u4")])

    return run


def _deal(kind: str, parts: int, squeeze, by: np.ndarray, columns) -> Iterator[pa.RecordBatch]:
    """One compressed row of columns for every part that `by` falls in."""
    if not len(by):
        return
    part = (mix64(by.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(bounds))
    columns = [(c[order], t) for c, t in columns]
    bodies = []
    for k in full.tolist():
        s, e = bounds[k], bounds[k + 1]
        bodies.append((e - s).astype("<u4").tobytes() + squeeze.compress(b"".join(np.ascontiguousarray(c[s:e], t).tobytes() for c, t in columns)))
    m = len(full)
    none = pa.nulls(m, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([kind] * m), pa.array(full.astype(np.int32)), none, none, none, none, pa.array(bodies, pa.binary())], names=["kind", "part", "doc_id", "n", "a", "b", "body"])


def _gather(bodies: list[bytes], types: list[str]) -> list[np.ndarray]:
    import zstandard

    open_, parts = zstandard.ZstdDecompressor(), [[] for _ in types]
    for body in bodies:
        m = int.from_bytes(body[:4], "little")
        raw, at = open_.decompress(body[4:]), 0
        for k, t in enumerate(types):
            parts[k].append(np.frombuffer(raw, t, m, at))
            at += m * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types, strict=True)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by keys (the first leads) and the starts of groups of the first key in it."""
    order = np.lexsort(keys[::-1])
    first = keys[0][order]
    return order, np.flatnonzero(np.r_[True, first[1:] != first[:-1]]) if len(first) else np.zeros(0, np.int64)


def _frequencies(parts: int):
    """Documents pass; shingles that more than one set has go back to the sets, with their frequency."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bodies = []
        for batch in batches:
            docs = pa.array([k == "doc" for k in batch.column(0).to_pylist()], pa.bool_())
            own = batch.filter(docs)
            if len(own):
                yield own
            bodies += [x for x in batch.column(6).to_pylist() if x is not None]
        token, a, n = _gather(bodies, ["<u8", "<i8", "<u4"])
        if not len(token):
            return
        order = np.lexsort((a, token))
        token, a, n = token[order], a[order], n[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (a[1:] != a[:-1])]
        token, a, n = token[once], a[once], n[once]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[starts, len(token)])
        df = np.repeat(size, size)
        shared = df > 1
        token, a, n, df = token[shared], a[shared], n[shared], df[shared]
        yield from _deal("back", parts, zstandard.ZstdCompressor(level=1), a.view(np.uint64), [(a, "<i8"), (token, "<u8"), (df, "<u4"), (n, "<u4")])

    return run


def _cells(parts: int):
    """For each set that may link, its rarest shared shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        bodies = [x for batch in batches for x in batch.column(0).to_pylist()]
        a, token, df, n = _gather(bodies, ["<i8", "<u8", "<u4", "<u4"])
        if not len(a):
            return
        order, starts = _groups(a, df, token)
        a, token, n = a[order], token[order], n[order].astype(np.int64)
        count = np.diff(np.r_[starts, len(a)])
        alone = prefix_size(n[starts]) - count
        take = np.clip(cell_budget(n[starts]) - alone, 0, count)
        at = ragged_take(np.arange(len(a)), starts, take)
        for rb in _deal("cell", parts, zstandard.ZstdCompressor(level=1), token[at], [(token[at], "<u8"), (a[at], "<i8")]):
            yield rb.select(["part", "body"])

    return run


@tidy
def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each set of a cell with the cell's least set."""
    bodies = [x for batch in batches for x in batch.column(1).to_pylist()]
    token, a = _gather(bodies, ["<u8", "<i8"])
    if len(token):
        order, starts = _groups(token, a)
        a = a[order]
        size = np.diff(np.r_[starts, len(a)])
        pairs = np.stack([a, np.repeat(a[starts], size)])
        pairs = np.unique(pairs[:, pairs[0] != pairs[1]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


class SignatureTree:
    """Sets in order of size; nodes hold OR-ed bitmaps, size ranges and the greatest excess of size over bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0, i))
        most = max((len(s) for s in sets), default=1)
        bits = 8
        while 1 << bits < 16 * most and bits < 17:
            bits += 1
        n = len(sets)
        self.size = np.array([len(sets[i]) for i in self.order], np.int64)
        maps = np.zeros((n, 1 << bits >> 6), np.uint64)
        flags = np.zeros(1 << bits, bool)
        for r, i in enumerate(self.order):
            flags[:] = False
            flags[(sets[i] >> np.uint64(64 - bits)).astype(np.int64)] = True
            maps[r] = np.packbits(flags).view(np.uint64)
        excess = self.size - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        #: Levels from the leaves up: bitmaps, least size, greatest size, greatest excess, first set, last set + 1.
        self.levels = [(maps, self.size, self.size, excess, np.arange(n), np.arange(n) + 1)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            maps, low, high, excess, first, last = self.levels[-1]
            cut = np.arange(0, len(low), fan)
            self.levels.append((np.bitwise_or.reduceat(maps, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(excess, cut), first[cut], np.maximum.reduceat(last, cut)))
            fan = FANOUT
        self.joined = np.arange(n)

    def _parent(self, k: int) -> int:
        while self.joined[k] != k:
            self.joined[k] = self.joined[self.joined[k]]
            k = self.joined[k]
        return int(k)

    def _one(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component of the sets of every node of a level."""
        while (self.joined[self.joined] != self.joined).any():
            self.joined = self.joined[self.joined]
        first = self.levels[level][4]
        return np.minimum.reduceat(self.joined, first), np.maximum.reduceat(self.joined, first)

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold a link between sets that are not joined yet."""
        maps, low, high, excess, _, _ = self.levels[level]
        least, most = self._one(level)
        keep = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        keep &= (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
        at = np.flatnonzero(keep & (i != j))
        if len(at):
            x, y = i[at], j[at]
            bound = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(excess[x], excess[y])
            keep[at] = (100 + percent) * bound >= percent * (low[x] + low[y])
        return keep

    def _expand(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of pairs of nodes, each once; pairs of a node with itself come last."""
        fan, count = LEAF if level == 1 else FANOUT, len(self.levels[level - 1][1])
        step = np.arange(fan)
        p = np.repeat(i[:, None] * fan + step, fan, axis=1)
        q = np.tile(j[:, None] * fan + step, (1, fan))
        p, q = p.ravel(), q.ravel()
        good = (p < count) & (q < count) & ((np.repeat(i != j, fan * fan)) | (p <= q))
        if level == 1:
            good &= p != q
        p, q = p[good], q[good]
        order = np.argsort(p == q, kind="stable")
        return p[order], q[order]

    def links(self, percent: int = PERCENT) -> list[tuple[int, int]]:
        """A spanning forest of the links between sets, as pairs of their places in the list given."""
        out: list[tuple[int, int]] = []
        if len(self.sets) < 2:
            return out
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > PAIRS:
                stack.append((level, i[:-PAIRS], j[:-PAIRS]))
                i, j = i[-PAIRS:], j[-PAIRS:]
            keep = self._possible(level, i, j, percent)
            i, j = i[keep], j[keep]
            if level and len(i):
                stack.append((level - 1, *self._expand(level, i, j)))
            elif len(i):
                self._compare(i.tolist(), j.tolist(), percent, out)
        return out

    def _compare(self, i: list[int], j: list[int], percent: int, out: list) -> None:
        for p, q in zip(i, j, strict=True):
            a, b = self._parent(p), self._parent(q)
            if a == b:
                continue
            x, y = self.sets[self.order[p]], self.sets[self.order[q]]
            if len(x) > len(y):
                x, y = y, x
            inter = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            if inter and 100 * inter >= percent * (len(x) + len(y) - inter):
                self.joined[max(a, b)] = min(a, b)
                out.append((self.order[p], self.order[q]))


def _link_block(t: pa.Table) -> pa.Table:
    ids = t.column("doc_id").to_pylist()
    sets = [np.frombuffer(x, "<u8") for x in t.column("body").to_pylist()]
    pairs = SignatureTree(sets).links()
    release()
    return pa.table({"u": pa.array([ids[i] for i, _ in pairs], pa.int64()), "v": pa.array([ids[j] for _, j in pairs], pa.int64())})


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the chosen documents, once for every task that needs them."""
    for batch in batches:
        data, offsets = utf8_view(batch.column("text"))
        for i, j in steps(offsets):
            v, c = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            a, _ = set_keys(v, c)
            ends = np.cumsum(c)
            rb = batch.slice(i, j - i)
            bodies = [v[e - n : e].astype("<u8").tobytes() for e, n in zip(ends.tolist(), c.tolist(), strict=True)]
            right = pa.array(a == np.array(rb.column("a").to_pylist(), np.int64))
            out = pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("block"), rb.column("chunk"), rb.column("chunks"), pa.array(bodies, pa.binary())], names=["doc_id", "block", "chunk", "chunks", "body"])
            yield out.filter(right)


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for documents (doc_id, text)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    posted = texts.mapInArrow(_post(parts), _KINDS).repartition(parts, "part")
    first = materialise(posted.mapInArrow(_frequencies(parts), _KINDS), "shingles")
    own = first.where("kind = 'doc'").select("doc_id", "n", "a", "b")
    classes = own.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))

    back = first.where("kind = 'back'").select("part", "body").repartition(parts, "part").select("body")
    cells = back.mapInArrow(_cells(parts), "part int, body binary").repartition(parts, "part")
    blocks = components(cells.mapInArrow(_stars, "u long, v long")).select(F.col("node").alias("a"), F.col("component").alias("block"))

    members = materialise(classes.join(blocks, "a").select("rep", "a", "n", "block"), "members")
    weight = members.groupBy("block").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets")).where("sets > 1")
    weight = weight.select("block", F.when(F.col("shingles") <= TASK_SHINGLES, 1).otherwise(F.ceil(2 * F.col("shingles") / TASK_SHINGLES)).cast("int").alias("chunks"))
    chosen = members.join(weight, "block").select(F.col("rep").alias("doc_id"), "a", "block", "chunks", F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("chunk"))
    # Texts are dealt by doc_id at every size; a broadcast here would grow with the corpus.
    sets = texts.join(chosen.hint("merge"), "doc_id").select("doc_id", "text", "a", "block", "chunk", "chunks").mapInArrow(_sets, "doc_id long, block long, chunk int, chunks int, body binary")
    # A set of chunk c takes part in the tasks (c, other) and (other, c); one chunk alone is task (0, 0).
    other = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: x != F.col("chunk")))
    tasks = sets.withColumn("other", F.explode(other)).select("doc_id", "body", "block", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    links = tasks.groupBy("block", "low", "high").applyInArrow(_link_block, "u long, v long")
    found = components(links)

    grouped = own.where("n > 0").join(classes, ["a", "b", "n"]).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    linked = grouped.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return linked.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


_ROW = "__spindrift_row"


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, that have the least doc_id of their component; one row of each component.

    Where doc_ids repeat or are null, every row is a document of its own: the table is written once with a number for each
    row, and of rows of the least doc_id the first stays (rows without doc_id come first). Documents without words all stay.
    """
    doc_id = F.col("doc_id").cast("long")
    if not repeats_ids(docs):
        kept = link_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    rows = materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    links = link_documents(rows.select(F.col(_ROW).alias("doc_id"), "text"))
    order = rows.select(F.col(_ROW).alias("doc_id"), F.struct(doc_id.isNotNull(), doc_id, _ROW).alias("place"))
    first = links.join(order, "doc_id").groupBy("component_id").agg(F.min_by("doc_id", "place").alias(_ROW))
    return rows.join(first.select(_ROW), _ROW, "left_semi").select(*docs.columns)
