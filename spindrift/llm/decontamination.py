"""Benchmark decontamination by the CGK embedding (operator 8).

The random walk of Chakraborty, Goldenberg and Koucky reads a string and, at every step, stays or moves on by a random bit
of the step and the character; small edit distance becomes small Hamming distance. Windows start at every word of every
text, and at every code point of stretches of `SHORTEST` bytes or more without ASCII white space (scripts without spaces,
other spaces); the walk's first outputs are sampled at random places (bit sampling), for several walks and samples, and
compared with those of the same starts of every item, so one intact stretch of an item is enough. A hit aligns the item with
the text, and the exact edit distance (bit-parallel, over code points, ASCII case folded) within the aligned window decides.
Exact copies do not depend on the starts: the first bytes of every item are looked up at every byte of the texts.

Items under `SHORTEST` bytes are too short for a walk. They are matched by the same rule: an item with `e` edits allowed has
one of its `e + 1` parts intact, so all its parts are looked up at every byte, and the edit distance decides. Below ten code
points no edit is allowed and the item has to stand there. `least_chars` leaves out items that the caller holds for too short
to be evidence; it is 1, which leaves out none but empty ones.

The benchmark is the stated small side: it is broadcast in blocks of at most `ITEM_BLOCK` items and about `BLOCK_BYTES`, one
pass for each block; a Python worker builds the index of a block once. Null or empty text holds nothing, null or empty items
stand nowhere. Every row of the benchmark is an item of its own: equal texts, equal item_ids and null item_ids are all
reported, one row for each row of the benchmark. Rows with equal or null doc_id are searched one by one.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, steps, utf8_view

#: Most edits of a match, for each character of the item.
EDIT_RATE = 0.10
#: Outputs of a walk, walks, samples of each walk, and places in a sample.
STEPS, WALKS, SAMPLES, PLACES = 48, 2, 3, 18
#: The same for items under 48 bytes, and the shortest item.
SHORT_STEPS, SHORTEST = 14, 16
ITEM_BLOCK, BLOCK_BYTES = 20_000, 16 << 20
#: Starts that are looked at together.
BLOCK = 1 << 16
_BITS = 20

SCHEMA = "doc_id long, item_id long, start long, end long, distance int"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The first byte of every stretch without ASCII white space, and every code point of those that could hold an item."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = edges[edges > 0] - 1
    last[edges] = inside[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    for i, j in zip(*((x[ends - starts >= SHORTEST]).tolist() for x in (starts, ends)), strict=True):
        first[i:j] = (data[i:j] & 0xC0) != 0x80
    return np.flatnonzero(first)


def _heads(data: np.ndarray) -> np.ndarray:
    """A hash of the `SHORTEST` bytes from every byte on."""
    n = max(0, len(data) - SHORTEST + 1)
    low = np.ndarray(n, "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    return low ^ np.ndarray(n, "<u8", data, 8 if n else 0, (1,)) * np.uint64(0xD6E8FEB86659FD93)


class ShortItems:
    """Items under SHORTEST bytes, found by parts of which one is intact."""

    def __init__(self, raw: list[np.ndarray], text: list[str]):
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (r, t) in enumerate(zip(raw, text, strict=True)):
            if not 0 < len(r) < SHORTEST:
                continue
            edges = [len(t[: len(t) * i // (allowed(t) + 1)].encode()) for i in range(allowed(t) + 2)]
            for a, b in itertools.pairwise(edges):
                seeds[b - a].append((int(self._keys(r[a:b], b - a)[0]), k, a))
        self.tables = {}
        for n, own in seeds.items():
            own.sort()
            keys = np.array([h for h, _, _ in own], np.uint64)
            self.tables[n] = keys, np.array([k for _, k, _ in own], np.int64), np.array([a for _, _, a in own], np.int64), _bitmap(keys)
        self.exact = np.array([allowed(t) == 0 for t in text], bool)

    @staticmethod
    def _keys(data: np.ndarray, n: int) -> np.ndarray:
        """A hash of the n bytes (under 16) from every byte on."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        m = max(0, len(data) - n + 1)
        low, high = (np.ndarray(m, "<u8", padded, at, (1,)) for at in (0, 8))
        cut = np.uint64(8 * (8 - n % 8) % 64)
        if n > 8:
            high = high << cut >> cut
            return mix64(low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xD6E8FEB86659FD93))
        return mix64((low << cut >> cut) * np.uint64(0x9E3779B97F4A7C15))

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, first byte in the row) of places that may hold an item; one place of an item that allows no edit."""
        for n, (keys, items, off, bitmap) in self.tables.items():
            for i in range(0, len(data), BLOCK):
                h = self._keys(data[i : i + BLOCK + n - 1], n)
                maybe = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).view(np.int64)])
                low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
                count = high - low
                place = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                at, k = np.repeat(maybe + i, count), items[place]
                row = np.searchsorted(offsets, at, "right") - 1
                inside = at + n <= offsets[row + 1]
                at, k, place, row = at[inside], k[inside], place[inside], row[inside]
                first = np.where(self.exact[k], 0, at - off[place] - offsets[row])
                if len(row):
                    yield from np.unique(np.stack([row, k, first]), axis=1).T.tolist()


def allowed(item: str) -> int:
    """Edits that a match of an item may have."""
    return int(EDIT_RATE * len(item))


class Walk:
    """One random walk with its samples of the output places."""

    def __init__(self, seed: int, n: int, samples: int = SAMPLES, places: int = PLACES):
        rng = np.random.default_rng(seed)
        self.move = rng.integers(0, 2, (n, 256), dtype=np.int32)
        self.value = rng.integers(0, 2**64, (n, 256), dtype=np.uint64)
        self.used = np.zeros((samples, n), bool)
        for s in range(samples):
            self.used[s, rng.choice(n, min(places, n), replace=False)] = True

    def sketches(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of every sample, for every start; data is padded by at least as many bytes as the walk has steps."""
        at = starts.astype(np.int32)
        out = np.zeros((len(self.used), len(starts)), np.uint64)
        for j in range(self.move.shape[0]):
            c = data[at]
            if self.used[:, j].any():
                v = self.value[j][c]
                for s in np.flatnonzero(self.used[:, j]):
                    out[s] += v
            at += self.move[j][c]
        return mix64(out)


def infix_distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edit distance of pattern to a part of text, end of the first such part), or None if above `most`."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Which leading bits the hashes have."""
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return bitmap


class ItemIndex:
    """Sketches of every start of every item."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.raw = [_FOLD[np.frombuffer(t.encode(), np.uint8)] if t else np.zeros(0, np.uint8) for _, t in items]
        self.text = [r.tobytes().decode() for r in self.raw]
        self.kinds = []
        for n, own in ((STEPS, [k for k, r in enumerate(self.raw) if len(r) >= STEPS]), (SHORT_STEPS, [k for k, r in enumerate(self.raw) if SHORTEST <= len(r) < STEPS])):
            if own:
                self.kinds.append([self._table(Walk(1000 * n + w, n), own, n) for w in range(WALKS)])
        self.heads = self._head_table()
        self.short = ShortItems(self.raw, self.text)

    def _table(self, walk: Walk, own: list[int], n: int):
        item, off, at, parts, pos = [], [], [], [], 0
        for k in own:
            r = self.raw[k]
            s = _starts(r, np.zeros(1, np.int64))
            s = s[s + n <= len(r)]
            if not len(s):
                s = np.zeros(1, np.int64)
            item.append(np.full(len(s), k))
            off.append(s)
            at.append(s + pos)
            parts.append(r)
            pos += len(r)
        data = np.concatenate([*parts, np.zeros(n + 1, np.uint8)])
        item, off, at = np.concatenate(item), np.concatenate(off), np.concatenate(at)
        tables = []
        for h in walk.sketches(data, at):
            order = np.argsort(h, kind="stable")
            # Of equal sketches of one item (a repeated pattern) the first and the last align it with either end of a text's.
            same = (np.diff(h[order]) == 0) & (np.diff(item[order]) == 0)
            order = order[~(np.r_[False, same] & np.r_[same, False])]
            tables.append((h[order], item[order].astype(np.int32), off[order].astype(np.int32), _bitmap(h)))
        return walk, tables

    def _head_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.array([k for k, r in enumerate(self.raw) if len(r) >= SHORTEST], np.int64)
        h = np.concatenate([_heads(self.raw[k][:SHORTEST]) for k in own]) if len(own) else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        return h[order], own[order], _bitmap(h)

    def copies(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) of exact copies, at any byte; one may run over the end of a text."""
        keys, item, bitmap = self.heads
        for i in range(0, len(data), BLOCK):
            h = _heads(data[i : i + BLOCK + SHORTEST - 1])
            maybe = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).view(np.int64)])
            low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
            for at, a, b in zip((maybe + i)[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for k in item[a:b].tolist():
                    r = self.raw[k]
                    if np.array_equal(data[at : at + len(r)], r):
                        yield at, k

    def hits(self, data: np.ndarray, all_starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, item, offset in the item) of equal sketches."""
        for i in range(0, len(all_starts), BLOCK):
            starts = all_starts[i : i + BLOCK]
            for walk, tables in itertools.chain(*self.kinds):
                for h, (keys, item, off, bitmap) in zip(walk.sketches(data, starts), tables, strict=True):
                    maybe = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).view(np.int64)])
                    if not len(maybe):
                        continue
                    low, high = np.searchsorted(keys, h[maybe], "left"), np.searchsorted(keys, h[maybe], "right")
                    n = high - low
                    if not n.any():
                        continue
                    place = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(starts[maybe], n), item[place], off[place]


def find(index: ItemIndex, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, distance) of the best match of every item in every text; places in code points."""
    folded = _FOLD[data]
    starts = _starts(folded, offsets)
    padded = np.concatenate([folded, np.zeros(STEPS + 2, np.uint8)])
    found: dict[tuple[int, int], set[int]] = defaultdict(set)
    for at, item, off in index.hits(padded, starts):
        row = np.searchsorted(offsets, at, "right") - 1
        pairs = np.unique(np.stack([row, item, (at - off - offsets[row]) // 8]), axis=1)
        for r, k, a in pairs.T.tolist():
            found[r, k].add(a)
    for at, k in index.copies(folded):
        r = int(np.searchsorted(offsets, at, "right")) - 1
        if at + len(index.raw[k]) <= offsets[r + 1]:
            found[r, k].add((at - int(offsets[r])) // 8)
    for r, k, a in index.short.hits(folded, offsets):
        found[r, k].add(a // 8)
    out = []
    for (r, k), places in sorted(found.items()):
        body = folded[offsets[r] : offsets[r + 1]]
        match = _verify(index, k, body, places)
        if match:
            out.append((r, k, *match))
    return out


def _chars(raw: np.ndarray) -> int:
    return int(((raw & 0xC0) != 0x80).sum())


def _verify(index: ItemIndex, k: int, body: np.ndarray, places: set[int]) -> tuple[int, int, int] | None:
    item, pattern = index.raw[k], index.text[k]
    exact = body.tobytes().find(item.tobytes())
    if exact >= 0:
        start = _chars(body[:exact])
        return start, start + len(pattern), 0
    most = allowed(pattern)
    if not most:
        return None
    room = 4 * most + 16
    best = None
    spans: list[list[int]] = []
    for a in sorted(places):
        lo, hi = max(0, a * 8 - room), min(len(body), a * 8 + len(item) + room)
        if spans and lo <= spans[-1][1] - len(item):
            spans[-1][1] = max(hi, spans[-1][1])
        elif hi > lo:
            spans.append([lo, hi])
    for lo, hi in spans:
        while lo > 0 and body[lo] & 0xC0 == 0x80:
            lo -= 1
        while hi < len(body) and body[hi] & 0xC0 == 0x80:
            hi += 1
        text = body[lo:hi].tobytes().decode("utf-8", "replace")
        hit = infix_distance(pattern, text, most)
        if hit and (best is None or hit[0] < best[2]):
            distance, end = hit
            back = infix_distance(pattern[::-1], text[:end][::-1], most)
            start = end - back[1] if back else max(0, end - len(pattern))
            before = _chars(body[:lo])
            best = (before + start, before + end, distance)
    return best


_INDEXES: dict[str, ItemIndex] = {}


def _index_of(name: str, items) -> ItemIndex:
    """The index of a block of items, built once in each Python worker."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = ItemIndex(items.value)
    return _INDEXES[name]


def _search(items, only_clean: bool):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, items)
        for batch in batches:
            all_data, all_offsets = utf8_view(batch.column("text"))
            matches = []
            for i, j in steps(all_offsets):
                data, offsets = all_data[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
                if len(data):
                    matches += [(i + r, *m) for r, *m in find(index, data, offsets)]
            if only_clean:
                clean = np.ones(len(batch), bool)
                clean[[m[0] for m in matches]] = False
                yield batch.filter(pa.array(clean))
            elif matches:
                rows, items_, start, end, distance = zip(*matches, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([index.ids[k] for k in items_], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(distance, pa.int32())],
                    names=["doc_id", "item_id", "start", "end", "distance"],
                )

    return run


def _blocks(benchmark: DataFrame, least_chars: int) -> Iterator:
    """Broadcast blocks of items (item_id, text)."""
    context = benchmark.sparkSession.sparkContext
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where(F.char_length("text") >= max(1, least_chars)).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += 4 * len(r["text"])
        if len(block) == ITEM_BLOCK or size >= BLOCK_BYTES:
            yield context.broadcast(block)
            block, size = [], 0
    if block:
        yield context.broadcast(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, least_chars: int = 1) -> DataFrame:
    """doc_id, item_id, start, end, distance: the best match of every item in every document that holds it."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in _blocks(benchmark, least_chars):
        found = texts.mapInArrow(_search(block, False), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_chars: int = 1) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item."""
    for block in _blocks(benchmark, least_chars):
        docs = docs.mapInArrow(_search(block, True), docs.schema)
    return docs
