"""Quality rules with suffix-array repetition (operator 5).

Words are `[^\\x20\\x09-\\x0D]+`. A suffix array over the words of each text, by prefix doubling, gives the longest common
prefixes of neighbouring suffixes. Intervals of common prefix of at least `least` words are the maximal repeated
substrings; the union of their spans is the covered part, and their greatest length is the longest repeat. Both are limited.

Null text counts as no words and fails. Rows with equal doc_id are judged one by one. Nothing leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_space, hash_pieces, steps, utf8_view, words_of

#: Words of a window of the base rule, and of the shortest repeat that counts.
WINDOW, LEAST = 8, 6
#: Most covered words in a hundred, and most words of the longest repeat.
COVERED_PERCENT, LONGEST = 35, 200
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long"


def _union(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][bounds])


def repeats(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts given as word hashes, one after another: words in repeated windows, covered words, longest repeat."""
    n, rows = len(words), len(counts)
    bounds = np.r_[0, np.cumsum(counts)]
    if not n:
        zero = np.zeros(rows, np.int64)
        return zero, zero, zero.copy()
    row = np.repeat(np.arange(rows), counts)
    left = bounds[1:][row] - np.arange(n)
    # Ranks at depth 1: equal within a text only.
    ranks = [_rank_pairs(row.astype(np.uint64), words)]
    depth, open_ = 1, np.arange(n)
    window_rank = None
    while True:
        rank = ranks[-1]
        size = np.bincount(rank, minlength=n + 1)
        open_ = open_[size[rank[open_]] > 1]
        if depth == window:
            window_rank = rank
        if not len(open_):
            break
        # Refine the groups that are still open; closed suffixes keep a rank of their own.
        ahead = np.zeros(len(open_), np.int64)
        more = left[open_] > depth
        ahead[more] = rank[open_[more] + depth] + 1
        order = np.lexsort((ahead, rank[open_]))
        place = open_[order]
        old, new = rank[place], ahead[order]
        change = np.r_[True, (old[1:] != old[:-1]) | (new[1:] != new[:-1])]
        group = np.r_[True, old[1:] != old[:-1]]
        index = np.arange(len(place))
        first = np.maximum.accumulate(np.where(group, index, 0))
        head = np.maximum.accumulate(np.where(change, index, 0))
        finer = rank.copy()
        finer[place] = old + head - first
        ranks.append(finer)
        depth *= 2
    if window_rank is None:
        window_rank = ranks[-1]
    full = left >= window
    twice = np.zeros(n, bool)
    if full.any():
        size = np.bincount(window_rank[full], minlength=n + 1)
        twice[full] = size[window_rank[full]] > 1
    in_windows = _per_row(_union(np.flatnonzero(twice), np.full(int(twice.sum()), window), n), bounds)
    # Suffix array and common prefixes of neighbours, for suffixes that share `least` words or more with another.
    stage = max(k for k in range(len(ranks)) if 1 << k <= least)
    size = np.bincount(ranks[stage], minlength=n + 1)
    chosen = np.flatnonzero(size[ranks[stage]] > 1)
    array = chosen[np.argsort(ranks[-1][chosen], kind="stable")]
    a, b = array[:-1].copy(), array[1:].copy()
    lcp = np.zeros(len(a), np.int64)
    same = row[a] == row[b]
    for k in range(len(ranks) - 1, -1, -1):
        span = 1 << k
        ok = same & (a + lcp < n) & (b + lcp < n)
        at = np.flatnonzero(ok)
        at = at[(left[a[at]] - lcp[at] >= span) & (left[b[at]] - lcp[at] >= span)]
        hit = at[ranks[k][a[at] + lcp[at]] == ranks[k][b[at] + lcp[at]]]
        lcp[hit] += span
        # Full depth may repeat once more at the top level.
        while k == len(ranks) - 1 and len(hit):
            at = hit[(left[a[hit]] - lcp[hit] >= span) & (left[b[hit]] - lcp[hit] >= span)]
            hit = at[ranks[k][a[at] + lcp[at]] == ranks[k][b[at] + lcp[at]]]
            lcp[hit] += span
    inside = lcp >= least
    starts = np.r_[a[inside], b[inside]]
    lengths = np.r_[lcp[inside], lcp[inside]]
    covered = _per_row(_union(starts, lengths, n), bounds)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[starts], lengths)
    return in_windows, covered, longest


def _rank_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    order = np.lexsort((second, first))
    change = np.r_[True, (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])]
    index = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum.accumulate(np.where(change, index, 0))
    return out


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(rows, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    newline = data == 10
    edge[offsets] = True
    edge[1:][newline] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.r_[starts[1:], len(data)]
    body = ends - (data[ends - 1] == 10)
    word = np.r_[0, np.cumsum(~space)]
    full = word[body] > word[starts]
    starts, ends = starts[full], body[full]
    row = np.searchsorted(offsets, starts, "right") - 1
    key = hash_pieces(data, starts, ends)
    rank = _rank_pairs(row.astype(np.uint64), key)
    extra = np.ones(len(rank), bool)
    extra[np.unique(rank, return_index=True)[1]] = False
    return np.bincount(row[extra], minlength=rows)


def _run(least: int, percent: int, longest_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8_view(batch.column(1))
            for i, j in steps(all_offsets):
                data, offsets = all_data[all_offsets[i] : all_offsets[j]], all_offsets[i : j + 1] - all_offsets[i]
                space = ascii_space(data)
                starts, ends, n = words_of(data, offsets, space)
                chars = _per_row(((data & 0xC0) != 0x80) & ~space, offsets)
                symbols = _per_row(_SYMBOLS[data], offsets)
                lines = _duplicate_lines(data, offsets, space)
                windows, covered, longest = repeats(hash_pieces(data, starts, ends), n, least=least)
                failed = (n < 20) | (100 * windows > 30 * n)
                kept = ~failed & (100 * covered <= percent * n) & (longest <= longest_most)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *(pa.array(x, pa.int64()) for x in (n, chars, symbols, lines, windows)), pa.array(failed), pa.array(kept), pa.array(covered, pa.int64()), pa.array(longest, pa.int64())],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"],
                )

    return run


def judge_repetition(docs: DataFrame, least: int = LEAST, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST) -> DataFrame:
    """Base counts and the verdict of every document (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(least, covered_percent, longest), SCHEMA)
