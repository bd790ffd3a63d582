"""Exact substring deduplication with run-length indexes (operator 1).

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier (smaller doc_id, or earlier in the document).

1. Every window of LENGTH bytes belongs to its anchor, the place of the least hash among its KMER-byte strings (leftmost
   on ties). Neighbouring windows of one anchor are a slice. Equal windows have equal anchors, so they meet under one key.
   Only digests of slices are shuffled, of equal slices of a part of a batch only the first. Of equal slices, all but the
   first occurrence are marked: they are one phrase of the dictionary. Anchors with several different slices go on to the
   index, with their first occurrences.
2. The slices of a bucket of anchors, each ended by a terminator, get a run-compressed Burrows-Wheeler transform: run heads,
   run starts, a step table (last-to-first by run) and text places sampled at run ends. Every slice is streamed through it
   from its end; each step gives the row, hence the matching statistics, of the suffix at that byte. Rows between two
   places where neighbouring suffixes share fewer than LENGTH bytes are one matched string; the least start of its rows
   decides which occurrences repeat an earlier one.
3. Marks return to the documents by their keys; their union is removed.

An anchor with many slices is dealt by further anchors of its windows (least strings by other hashes) into several buckets:
windows of the same further anchors stay one slice, and the more slices an anchor has, the more further anchors count.
Matches never cross documents, nor terminators. Null or empty text has no bytes and no marks. Every row is a document:
rows of equal doc_id stand in the order of the table, so the first of two equal rows keeps its bytes and the second loses
them; rows without doc_id stand before all others. Where doc_ids repeat or are null, the table is written once with a
number for every row. Extra columns are ignored by `removed_spans` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, materialise, mix64, partitions, parts_of, ragged_take, release, repeats_ids, tidy, utf8_view

LENGTH, KMER = 100, 32
#: Slices of an anchor above which it is dealt by window content, and bytes of slices in a bucket, about.
HOT_SLICES, BUCKET_BYTES = 2_500, 1 << 17
_PLACE = 22
_WINDOWS = LENGTH - KMER + 1
#: Slices that a task remembers to have seen often.
_REMEMBERED = 200_000
#: The place of a row in the order of documents: its doc_id, then its number among rows of equal doc_id (0 if there are none).
_DOC, _ROW = "__spindrift_doc", "__spindrift_row"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(h: np.ndarray, ahead: int) -> np.ndarray:
    """Hashes of two neighbouring (or overlapping) strings, from those of the first and of the one `ahead`."""
    out = h[:-ahead] * _M2
    out += h[ahead:]
    out ^= out >> np.uint64(31)
    out *= _M1
    return out


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _M1)


def slices_of(data: np.ndarray, ends: np.ndarray, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Slices of the windows that start in [first, last): (start, windows, anchor hash, slice digest, anchor place).

    `ends[i]` bounds row i's bytes in `data`; rows are one after another.
    """
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(data) < LENGTH:
        return empty
    h = _BYTE[data]
    n = 1
    while n < KMER:
        h = _join(h, n)
        n *= 2
    k64 = _join(h, KMER)
    full = _join(k64, LENGTH - 2 * KMER)  # a hash of each whole window
    packed = h >> np.uint64(_PLACE)
    packed <<= np.uint64(_PLACE)
    packed |= np.arange(len(h), dtype=np.uint64)
    m, span = packed, 1
    while span * 2 <= _WINDOWS:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < _WINDOWS:
        m = np.minimum(m[: len(m) - (_WINDOWS - span)], m[_WINDOWS - span :])
    windows = len(m)
    place = (m & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    ok = np.zeros(windows + 1, np.int64)
    starts = np.r_[0, ends[:-1]]
    begin = np.clip(starts, first, None)
    stop = np.minimum(np.minimum(ends - LENGTH + 1, last), windows)
    good = stop > begin
    np.add.at(ok, begin[good], 1)
    np.add.at(ok, stop[good], -1)
    valid = np.cumsum(ok[:-1]) > 0
    change = np.r_[True, place[1:] != place[:-1]]
    change[begin[good]] = True
    change[1:] |= valid[1:] != valid[:-1]
    at = np.flatnonzero(change)
    stop_at = np.r_[at[1:], windows]
    use = valid[at]
    at, stop_at = at[use], stop_at[use]
    if not len(at):
        return empty
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(full[:windows])]
    length = (stop_at - at).astype(np.uint64)
    digest = mix64((total[stop_at] - total[at]) * _M1 ^ full[at] * _M2 ^ mix64(full[stop_at - 1]) ^ length)
    return at, stop_at - at, h[place[at]], digest, place[at]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(row i, row j, first byte, last byte) of steps; a very long row comes in overlapping parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > STEP_BYTES:
            for s in range(int(offsets[i]), int(offsets[i + 1]), STEP_BYTES):
                yield i, i + 1, s, min(s + STEP_BYTES, int(offsets[i + 1]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP_BYTES, "right")) - 1)
        yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def batch_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor hash, digest) of all slices of all rows."""
    parts = []
    for i, j, s, e in _pieces(offsets):
        stop = min(int(offsets[j]), e + LENGTH - 1)
        at, n, anchor, digest, _ = slices_of(data[s:stop], np.minimum(offsets[i + 1 : j + 1], stop) - s, 0, e - s)
        row = np.searchsorted(offsets[i : j + 1], at + s, "right") - 1 + i
        parts.append((row, at + s - offsets[row], n, anchor, digest))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class _Seen:
    """First occurrences of slices that came more than once in a part, for the later parts of a task."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.facts = [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3

    def repeats(self, keys, facts) -> np.ndarray:
        """Which slices (anchor, digest, doc, row, start) repeat a remembered one that stands earlier."""
        at = np.searchsorted(self.keys, keys)
        out = np.zeros(len(keys), bool)
        inside = np.flatnonzero(at < len(self.keys))
        inside = inside[self.keys[at[inside]] == keys[inside]]
        (a, g, d, r, s), (a0, g0, d0, r0, s0) = (f[inside] for f in facts), (f[at[inside]] for f in self.facts)
        later = (d0 < d) | (d0 == d) & ((r0 < r) | (r0 == r) & (s0 < s))
        out[inside] = (a0 == a) & (g0 == g) & later
        return out

    def add(self, keys, facts) -> None:
        if len(self.keys) + len(keys) > _REMEMBERED:
            self.__init__()
        keys = np.r_[self.keys, keys[:_REMEMBERED]]
        facts = [np.r_[old, new[:_REMEMBERED]] for old, new in zip(self.facts, facts, strict=True)]
        self.keys, first = np.unique(keys, return_index=True)
        self.facts = [f[first] for f in facts]


def _digests(parts: int):
    """One compressed row for every bucket: digests of the batch's slices, by document and start. Part -1 has sure repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, seen = zstandard.ZstdCompressor(level=1), _Seen()

        def packed(at, columns):
            return len(at).to_bytes(4, "little") + squeeze.compress(b"".join(_planes(c[at] if diff is False else np.diff(c[at], prepend=0), t) for c, t, diff in columns))

        for k, batch in enumerate(parts_of(batches, "text")):
            data, offsets = utf8_view(batch.column("text"))
            row, start, n, anchor, digest = batch_slices(data, offsets)
            if not len(row):
                continue
            doc, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in (_DOC, _ROW))
            place = np.lexsort((start, number, doc))
            doc, number, start, n, anchor, digest = (x[place] for x in (doc, number, start, n, anchor, digest))
            key = mix64(anchor + mix64(digest))
            order = np.argsort(key, kind="stable")
            same = np.zeros(len(key), bool)
            same[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
            facts = (anchor, digest, doc, number, start)
            repeated = same | seen.repeats(key, facts)
            often = order[:-1][same[order[1:]] & ~same[order[:-1]]]
            seen.add(key[often], [f[often] for f in facts])
            part = np.where(repeated, -1, (mix64(anchor) % np.uint64(parts)).astype(np.int64))
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(-1, parts + 1))
            full = np.flatnonzero(np.diff(bounds))
            columns = ((anchor, "<u8", False), (digest, "<u8", False), (doc, "<i8", True), (number, "<i8", True), (start, "<i8", False), (n, "u1", False))
            bodies = [packed(order[bounds[z] : bounds[z + 1]], columns if z else columns[2:]) for z in full.tolist()]
            where = np.where(full > 0, full - 1, (k * 7919 + int(doc[0])) % parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(full == 0), pa.array(bodies, pa.binary())], names=["part", "sure", "body"])

    return run


def _planes(values: np.ndarray, kind: str) -> bytes:
    """Values byte plane by byte plane, which compresses small numbers well."""
    raw = np.ascontiguousarray(values, kind)
    return np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes()


def _unpack(body: bytes, kinds: list[str], open_) -> list[np.ndarray]:
    m = int.from_bytes(body[:4], "little")
    raw, at, out = open_.decompress(body[4:]), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, m * width, at).reshape(width, m)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += m * width
    return out


@tidy
def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of repeated slices (deal 0), and slices for the index (deal >= 1: buckets that the anchor is dealt to)."""
    import zstandard

    open_, rows, names = zstandard.ZstdDecompressor(), [], [_DOC, _ROW, "start", "n", "anchor", "deal"]
    for batch in batches:
        for sure, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sure:
                d, r, s, n = _unpack(body, ["<i8", "<i8", "<i8", "u1"], open_)
                yield from _chunked([np.cumsum(d), np.cumsum(r), s, n.astype(np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), np.int32)], names)
                continue
            a, g, d, r, s, n = _unpack(body, ["<u8", "<u8", "<i8", "<i8", "<i8", "u1"], open_)
            rows.append((a, g, np.cumsum(d), np.cumsum(r), s, n.astype(np.int64)))
    if not rows:
        return
    anchor, digest, doc, number, start, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    del rows
    # Anchors that come once are done.
    order = np.argsort(anchor, kind="stable")
    ranked = anchor[order]
    lone = np.r_[True, ranked[1:] != ranked[:-1]] & np.r_[ranked[1:] != ranked[:-1], True]
    keep = order[~lone]
    anchor, digest, doc, number, start, n = (x[keep] for x in (anchor, digest, doc, number, start, n))
    if not len(anchor):
        return
    order = np.lexsort((start, number, doc, digest, anchor))
    anchor, digest, doc, number, start, n = (x[order] for x in (anchor, digest, doc, number, start, n))
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    first = new_anchor | np.r_[True, digest[1:] != digest[:-1]]
    group = np.cumsum(new_anchor) - 1
    different = np.bincount(group, weights=first).astype(np.int64)[group]
    # The parts that a dealt anchor would need if its windows went out one by one, LENGTH bytes and a terminator each.
    windows = np.bincount(group, weights=first * n).astype(np.int64)[group]
    parts = np.where(different > HOT_SLICES, np.maximum(2, -(-windows * (LENGTH + 1) // (4 * BUCKET_BYTES))), 1)
    deal = np.where(first, np.where(different > 1, parts, -1), 0)
    use = deal >= 0
    # Several occurrences in one document, and neighbours in different slices, stay apart here; spans are united later.
    yield from _chunked([doc[use], number[use], start[use], n[use], anchor[use].view(np.int64), deal[use].astype(np.int32)], names)


def _chunked(columns: list[np.ndarray], names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + rows]) for c in columns], names=names)


def _dealt(text: np.ndarray, n: np.ndarray, deal: np.ndarray) -> tuple[np.ndarray, ...]:
    """Slices of n windows each, in `text` one after another, parted where a further anchor of their windows changes.

    Gives (slice, first window, windows, salt) of the parts. A further anchor is the least of a window's KMER-byte strings by
    another hash, so equal windows of equal `deal` have equal salts; an anchor has the more of them the more it is dealt.
    """
    h, k = _BYTE[text], 1
    while k < KMER:
        h = _join(h, k)
        k *= 2
    levels = 1 + np.maximum(0, np.log2(deal / 8) // 2).astype(np.int64)
    which = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    size = n + LENGTH - 1
    place = (np.cumsum(size) - size)[which] + step
    salt = np.zeros(len(which), np.uint64)
    for level in range(1, int(levels.max()) + 1):
        least, span = mix64(h + np.uint64(level)), 1
        while span * 2 <= _WINDOWS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (_WINDOWS - span)], least[_WINDOWS - span :])
        salt = np.where(levels[which] >= level, mix64(salt * _M2 + least[place]), salt)
    first = np.flatnonzero((step == 0) | np.r_[True, salt[1:] != salt[:-1]])
    return which[first], step[first], np.diff(np.r_[first, len(which)]), salt[first]


def _cut(buckets: int):
    """Bytes of the asked slices, packed by bucket of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in parts_of(batches, "text"):
            data, offsets = utf8_view(batch.column("text"))
            asked = batch.column("asked")
            flat, bounds = asked.flatten(), np.diff(asked.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), bounds)
            start, n, anchor, deal = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "anchor", "deal"))
            doc, number = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)[row] for c in (_DOC, _ROW))
            n, at = n.astype(np.int64), offsets[row] + start
            hot = deal > 1
            if hot.any():
                # Windows of the same further anchors are one slice here, dealt by these.
                rest, h = np.flatnonzero(~hot), np.flatnonzero(hot)
                piece, step, count, salt = _dealt(ragged_take(data, at[h], n[h] + LENGTH - 1), n[h], deal[h])
                more = h[piece]
                key = np.concatenate([mix64(anchor[rest].view(np.uint64)), mix64(mix64(anchor[more].view(np.uint64)) + salt + np.uint64(1))])
                doc, number = np.r_[doc[rest], doc[more]], np.r_[number[rest], number[more]]
                start, at, n = np.r_[start[rest], start[more] + step], np.r_[at[rest], at[more] + step], np.r_[n[rest], count]
            else:
                key = mix64(anchor.view(np.uint64))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((start, number, doc, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edges))
            bodies = []
            for k in full.tolist():
                z = order[edges[k] : edges[k + 1]]
                text = ragged_take(data, at[z], n[z] + LENGTH - 1)
                head = b"".join(_planes(c, t) for c, t in ((doc[z], "<i8"), (number[z], "<i8"), (start[z], "<i8"), (n[z], "u1")))
                bodies.append(len(z).to_bytes(4, "little") + squeeze.compress(head + text.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    return run


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of strings over bytes below 255, each ended by a terminator.

    Suffixes that are equal up to their terminators stand in order of their strings, so the last-to-first step holds.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray, depth: int = LENGTH):
        """`text` holds the strings one after another, without terminators."""
        m = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        n = len(text) + m
        body = np.ones(n, bool)
        body[ends] = False
        x = np.zeros(n, np.int16)
        x[body] = text.astype(np.int16) + 1
        self.n, self.ends = n, ends
        self.left = np.repeat(ends, lengths + 1) - np.arange(n)  # bytes up to the terminator
        array, near = self._sort(x, depth)
        self.starts = ends - lengths
        before = array - 1
        before[before < 0] = n - 1
        bwt = x[before]  # a terminator stands before each string's first byte
        bwt[before == n - 1] = 0
        head = np.r_[True, bwt[1:] != bwt[:-1]]
        #: Runs: first row and byte; the row that the first row's last-to-first step leads to; places sampled at the ends.
        self.run_start = np.flatnonzero(head)
        self.run_byte = bwt[self.run_start]
        run_end = np.r_[self.run_start[1:], n]
        size = run_end - self.run_start
        order = np.argsort(self.run_byte, kind="stable")
        first = np.zeros(len(size), np.int64)
        first[order] = np.cumsum(size[order]) - size[order]
        self.run_step = first
        self.run_shift = first - self.run_start
        self.sample_first, self.sample_last = array[self.run_start], array[run_end - 1]
        # Where neighbouring rows share fewer than `depth` bytes, a new matched string begins.
        self.depth = depth
        same = self._share(array, *near, depth)
        self.class_start = np.flatnonzero(np.r_[True, ~same])
        #: Rank support: the run and the matched string of every row.
        self.run_of = (np.cumsum(head) - 1).astype(np.int32)
        self.class_of = (np.cumsum(np.r_[True, ~same]) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(np.where(self.left[array] >= depth, array, n), self.class_start)
        self.class_size = np.diff(np.r_[self.class_start, n])

    def _sort(self, x: np.ndarray, wanted: int) -> tuple[np.ndarray, tuple[int, np.ndarray]]:
        """Suffix array by prefix doubling from seven bytes; comparisons stop at terminators, ties keep text order.

        Also gives the ranks at the greatest depth up to `wanted`.
        """
        n, left = self.n, self.left
        key = np.zeros(n + 8, np.uint64)
        key[:n] = x
        packed = np.zeros(n, np.uint64)
        for j in range(7):
            packed <<= np.uint64(9)
            packed |= np.where(left >= j, key[j : n + j], 0)
        order = np.argsort(packed)
        ranked = packed[order]
        change = np.r_[True, ranked[1:] != ranked[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
        del packed, ranked, key
        depth, near = 7, (7, rank)
        while True:
            if depth <= wanted:
                near = (depth, rank)
            size = np.bincount(rank, minlength=n)
            open_ = order[size[rank[order]] > 1]
            open_ = open_[left[open_] >= depth]
            if not len(open_):
                break
            pair = rank[open_] * n + rank[open_ + depth]
            sub = np.argsort(pair)
            place, pair = open_[sub], pair[sub]
            old = pair // n
            group = np.r_[True, old[1:] != old[:-1]]
            change = np.r_[True, pair[1:] != pair[:-1]]
            index = np.arange(len(place))
            begin = np.maximum.accumulate(np.where(group, index, 0))
            head = np.maximum.accumulate(np.where(change, index, 0))
            rank = rank.copy()
            rank[place] = old + head - begin
            depth *= 2
        order = np.argsort(rank * n + np.arange(n))
        return order, near

    def _share(self, array: np.ndarray, least: int, rank: np.ndarray, depth: int) -> np.ndarray:
        """Whether neighbouring rows share their first `depth` bytes."""
        a, b = array[:-1].copy(), array[1:].copy()
        same = (self.left[a] >= depth) & (self.left[b] >= depth)
        at = np.flatnonzero(same)
        x, y = a[at], b[at]
        good = np.ones(len(x), bool)
        for step in [*range(0, depth - least, least), depth - least]:
            good &= rank[x + step] == rank[y + step]
        same[at] = good
        return same

    def step(self, rows: np.ndarray) -> np.ndarray:
        """Last-to-first: the rows of the suffixes that start one byte earlier."""
        return rows + self.run_shift[self.run_of[rows]]

    def stream(self) -> np.ndarray:
        """For each byte of each string, the matched string (class of rows) of the suffix there; -1 at terminators.

        All strings are walked from their ends at once; a string's own terminator is the row of its number.
        """
        out = np.full(self.n, -1, np.int32)
        length = self.ends - self.starts
        order = np.argsort(-length, kind="stable")
        rows, place = order.copy(), self.ends[order].copy()
        longest = length[order]
        for t in range(1, int(longest[0]) + 1 if len(longest) else 0):
            alive = int(np.searchsorted(-longest, -t, "right"))
            rows, place = self.step(rows[:alive]), place[:alive] - 1
            out[place] = self.class_of[rows]
        return out


@tidy
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the windows of each bucket that start earlier elsewhere in it."""
    import zstandard

    open_, held, done = zstandard.ZstdDecompressor(), [], 0
    current = None
    for batch in batches:
        for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != current and held:
                yield from _marks(held)
                held, done = [], done + 1
                if done % 16 == 0:
                    release()
            current = bucket
            m = int.from_bytes(body[:4], "little")
            raw = open_.decompress(body[4:])
            doc, number, start = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * m, 8 * m * k).reshape(8, m).T).reshape(-1).view("<i8") for k in range(3))
            n = np.frombuffer(raw, np.uint8, m, 24 * m).astype(np.int64)
            held.append((doc, number, start, n, np.frombuffer(raw, np.uint8, offset=25 * m)))
    if held:
        yield from _marks(held)


def _marks(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    doc, number, start, n, text = (np.concatenate(x) for x in zip(*held, strict=True))
    # Strings in order of document and start: the least place in the index is the earliest start.
    order = np.lexsort((start, number, doc))
    lengths = n + LENGTH - 1
    text = ragged_take(text, np.cumsum(lengths)[order] - lengths[order], lengths[order])
    doc, number, start, n, lengths = (x[order] for x in (doc, number, start, n, lengths))
    index = RunLengthIndex(text, lengths)
    matched = index.stream()
    place = ragged_take(np.arange(index.n), index.starts, n)
    string = np.repeat(np.arange(len(n)), n)
    at = start[string] + place - index.starts[string]
    kind = matched[place]
    size = index.class_size[kind]
    # Windows of one document may reach the index in overlapping slices; the same place is no repeat of itself.
    least = index.least[kind]
    owner = np.searchsorted(index.starts, least, "right") - 1
    same = (doc[owner] == doc[string]) & (number[owner] == number[string])
    marked = (size > 1) & np.where(same, start[owner] + least - index.starts[owner] < at, owner < string)
    if not marked.any():
        return
    edge = marked & np.r_[True, ~marked[:-1] | (string[1:] != string[:-1])]
    begin = np.flatnonzero(edge)
    count = np.add.reduceat(marked.astype(np.int64), begin)
    yield from _chunked([doc[string[begin]], number[string[begin]], at[begin], count], [_DOC, _ROW, "start", "n"])


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with their place in the order of documents, _DOC and _ROW, which is theirs alone."""
    doc_id = F.col("doc_id").cast("long")
    if not repeats_ids(docs):
        return docs.withColumn(_DOC, doc_id).withColumn(_ROW, F.lit(0).cast("long"))
    number = F.monotonically_increasing_id() + F.when(doc_id.isNull(), 0).otherwise(2**62)
    return materialise(docs.withColumn(_DOC, F.coalesce(doc_id, F.lit(-(2**63)))).withColumn(_ROW, number), "rows")


def _repeated_windows(keyed: DataFrame) -> DataFrame:
    """_DOC, _ROW, start, n: n windows from `start` on whose LENGTH bytes also start earlier."""
    spark = keyed.sparkSession
    parts = partitions(spark)
    texts = keyed.select(_DOC, _ROW, "text")
    key = f"{_DOC} long, {_ROW} long"
    packed = texts.mapInArrow(_digests(parts), "part int, sure boolean, body binary").repartition(parts, "part").select("sure", "body")
    found = materialise(packed.mapInArrow(_resolve, f"{key}, start long, n long, anchor long, deal int"), "slices")
    asked = found.where("deal > 0").groupBy(_DOC, _ROW).agg(F.collect_list(F.struct("start", "n", "anchor", "deal")).alias("asked"))
    size = found.where("deal > 0").agg(F.sum((F.col("n") + LENGTH) * F.when(F.col("deal") > 1, 4).otherwise(1))).first()[0] or 0
    buckets = max(parts, -(-size // BUCKET_BYTES))
    cut = texts.join(asked.hint("merge"), [_DOC, _ROW]).select(_DOC, _ROW, "text", "asked").mapInArrow(_cut(buckets), "bucket int, body binary")
    marks = cut.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_index, f"{key}, start long, n long")
    return found.where("deal = 0").select(_DOC, _ROW, "start", "n").unionByName(marks)


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans, as maximal spans (touching ones are one)."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    top = np.maximum.accumulate(ends)
    cut = np.r_[True, starts[1:] > top[:-1]]
    at = np.flatnonzero(cut)
    return starts[at], top[np.r_[at[1:] - 1, len(top) - 1]]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    data, offsets = utf8_view(batch.column("text"))
    marks = batch.column(_MARKS).to_pylist()
    for r, m in enumerate(marks):
        raw = data[offsets[r] : offsets[r + 1]]
        if m:
            start = np.array([x["start"] for x in m], np.int64)
            starts, ends = _spans(start, start + np.array([x["n"] for x in m], np.int64) + LENGTH - 1)
        else:
            starts = ends = np.zeros(0, np.int64)
        yield raw, starts, ends


def _kept(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    if not len(starts):
        return raw.tobytes()
    return b"".join(raw[s:e].tobytes() for s, e in zip(np.r_[0, ends], np.r_[starts, len(raw)], strict=True))


@tidy
def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, gone, spans, sha = [], [], [], []
        for raw, starts, ends in _rows(batch):
            size.append(len(raw))
            gone.append(int((ends - starts).sum()))
            spans.append(len(starts))
            sha.append(hashlib.sha256(_kept(raw, starts, ends)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, spans)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


_MARKS = "__spindrift_marks"


def _with_marks(keyed: DataFrame) -> DataFrame:
    marks = _repeated_windows(keyed).groupBy(_DOC, _ROW).agg(F.collect_list(F.struct("start", "n")).alias(_MARKS))
    return keyed.join(marks.hint("merge"), [_DOC, _ROW], "left")


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document (doc_id, text)."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_marks(keyed).select("doc_id", "text", _MARKS).mapInArrow(_report, schema)


@tidy
def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, keep = [], []
        for raw, starts, ends in _rows(batch):
            left = _kept(raw, starts, ends).decode("utf-8", "ignore")
            texts.append(left)
            keep.append(bool(left.strip()) or not len(starts))
        rest = pa.RecordBatch.from_arrays([c for c, k in zip(batch.columns, batch.schema.names, strict=True) if k != _MARKS], names=[k for k in batch.schema.names if k != _MARKS])
        new = pa.array(texts, pa.string())
        old = rest.column("text")
        if old.null_count:
            new = pa.array([None if o is None else t for o, t in zip(old.to_pylist(), texts, strict=True)], pa.string())
        i = rest.schema.names.index("text")
        columns = [new if k == i else c for k, c in enumerate(rest.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=rest.schema.names).filter(pa.array(keep))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, without their repeated bytes (and what of a character is left at a cut).

    A document of which nothing is left goes. `n_chars`, where there is such a column, counts what is left.
    """
    joined = _with_marks(_keyed(docs)).select(*docs.columns, _MARKS)
    out = joined.mapInArrow(_rewrite, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out
