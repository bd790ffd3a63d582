"""Fast exact token ids: pieces of text that a tokenizer cannot join are encoded once and remembered.

Both public BPE files split text before every run of white space that follows other text, so a run of white space with
the text after it always has the same ids, whatever stands around it. They also split a word from the marks that close
it, so `word` and `word,` share what is remembered. A document with white space beyond ASCII or with the controls U+001C
to U+001F is encoded as one piece instead. Pieces are told apart by their length, their first and last eight bytes (that
is all of a piece of up to 16 bytes) and, for longer ones, a 64-bit hash; two pieces that differ in these never share ids.
Words of letters alone go to the merges of a byte-level tokenizer directly, as its pattern would leave them whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib

import numpy as np

from .common import STEP_BYTES, ascii_space, hash_pieces, mix64, ragged_take, steps

#: Remembered pieces per Python worker; beyond it the memory starts anew (results do not change).
REMEMBERED = 3_000_000
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places of bytes that may belong to white space other than U+0020 and U+0009 to U+000D, or to U+001C to U+001F."""
    odd = (data >= 0x1C) & (data <= 0x1F)
    if (data >= 0x80).any():
        nxt = np.empty_like(data)
        nxt[:-1] = data[1:]
        nxt[-1:] = 0
        odd |= (data == 0xC2) & ((nxt == 0x85) | (nxt == 0xA0))
        odd |= (data == 0xE1) & (nxt == 0x9A)
        odd |= (data == 0xE2) & ((nxt == 0x80) | (nxt == 0x81))
        odd |= (data == 0xE3) & (nxt == 0x80)
    return np.flatnonzero(odd)


_MARK = np.zeros(256, bool)
_MARK[list(b",.!?;:#$%&*")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _closing_marks(data: np.ndarray, space: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the runs of marks that follow a letter (ASCII or Latin-1) and end a text or stand before white space."""
    mark = _MARK[data]
    starts = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
    if not len(starts):
        return starts
    ends = np.flatnonzero(mark & ~np.r_[mark[1:], False]) + 1
    ends = ends[len(ends) - len(starts) :]
    before, second = data[starts - 1], data[np.maximum(starts - 2, 0)]
    accented = (second == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & (starts >= 2)
    closed = space[np.minimum(ends, len(data) - 1)] | (ends == len(data))
    open_ = np.flatnonzero(~closed)
    if len(open_):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        closed[open_] = edge[ends[open_]]
    return starts[(_LETTER[before] | accented) & closed]


def _ends_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of every piece as integers; shorter pieces are padded with zeros."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 9, "<u8", padded, 0, (1,))
    short = (np.uint64(8) * np.minimum(8, 8 - np.minimum(8, ends - starts)).astype(np.uint64)) % np.uint64(64)
    return words[starts + 8] << short >> short, words[ends] >> short << short


class Encoder:
    """Encodes batches of UTF-8 texts with a tokenizers file; gives a flat array of ids and the offsets of the texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytewise = _is_bytewise(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        #: What tells pieces of one key apart: first and last bytes, length in bytes; then the place and number of ids.
        self.known = [np.zeros(0, np.uint64)] * 3
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.used = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], []
        for i, j in steps(offsets, 2 * STEP_BYTES):
            ids, n = self._step(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(ids)
            counts.append(n)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.r_[0, np.cumsum(n)]

    def _step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        space = ascii_space(data)
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[0] = False
        cut[_closing_marks(data, space, offsets)] = True
        odd = _odd_spaces(data)
        if len(odd):
            whole = np.unique(np.searchsorted(offsets, odd, "right") - 1)
            for r in whole:
                cut[offsets[r] : offsets[r + 1]] = False
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(data)]
        size = (ends - starts).astype(np.uint64)
        head, tail = _ends_of(data, starts, ends)
        keys = mix64(head * _ODD + mix64(tail + size * _BASE))
        long = np.flatnonzero(size > 16)
        if len(long):
            keys[long] ^= hash_pieces(data, starts[long], ends[long])
        place = self._places(data, starts, ends, keys, (head, tail, size))
        lengths = self.lengths[place]
        ids = ragged_take(self.ids, self.starts[place], lengths)
        owner = np.searchsorted(starts, offsets)
        total = np.r_[0, np.cumsum(lengths)]
        return ids, np.diff(total[owner])

    def _places(self, data, starts, ends, keys, facts) -> np.ndarray:
        """Places of the pieces in the memory. Pieces that share a key without being equal get another key."""
        while True:
            unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            if len(self.keys) + len(unique) > REMEMBERED:
                self._forget()
            leader = first[inverse]
            clash = np.zeros(len(keys), bool)
            for fact in facts:
                clash |= fact[leader] != fact
            at = np.searchsorted(self.keys, unique)
            old = np.zeros(len(unique), bool)
            inside = np.flatnonzero(at < len(self.keys))
            old[inside] = self.keys[at[inside]] == unique[inside]
            same = np.flatnonzero(old)
            wrong = np.zeros(len(unique), bool)
            for known, fact in zip(self.known, facts, strict=True):
                wrong[same] |= known[at[same]] != fact[first[same]]
            if wrong.any():
                clash |= wrong[inverse]
            if not clash.any():
                break
            keys = keys.copy()
            keys[clash] = mix64(keys[clash] + mix64(facts[0][clash] * _BASE + facts[1][clash] * _ODD + facts[2][clash]))
        new = np.flatnonzero(~old)
        if len(new):
            raw = data.tobytes()
            pieces = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            flat, counts = self._encode_new(pieces)
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), self.used, 1 << 16), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(counts) - counts
            self.used += len(flat)
            # Both lists of keys are in order; the new ones go in between.
            into = at[new]
            self.keys = np.insert(self.keys, into, unique[new])
            self.known = [np.insert(known, into, fact[first[new]]) for known, fact in zip(self.known, facts, strict=True)]
            self.starts = np.insert(self.starts, into, begin)
            self.lengths = np.insert(self.lengths, into, counts)
            at = np.searchsorted(self.keys, unique)
        return at[inverse]

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has."""
        lone = [k for k, p in enumerate(pieces) if _WORD.fullmatch(p)] if self.bytewise else []
        if not lone:
            return self._encode_all(pieces)
        merge = self.tokenizer.model.tokenize
        words = [[t.id for t in merge(pieces[k].encode().decode("latin-1").translate(_BYTE_CHARS))] for k in lone]
        rest = np.ones(len(pieces), bool)
        rest[lone] = False
        flat, n = self._encode_all([pieces[k] for k in np.flatnonzero(rest).tolist()])
        counts = np.zeros(len(pieces), np.int64)
        counts[lone] = [len(w) for w in words]
        counts[rest] = n
        out = np.zeros(int(counts.sum()), np.uint32)
        of_word = np.repeat(~rest, counts)
        out[of_word] = np.fromiter(itertools.chain.from_iterable(words), np.uint32)
        out[~of_word] = flat
        return out, counts

    def _encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(pieces), 8192):
            part = pieces[i : i + 8192]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)) if len(e.ids) else np.zeros(len(part), np.int64))
        return np.concatenate(ids), np.concatenate(counts)


#: A space or none, then letters: one word to a byte-level tokenizer, whose pattern need not be run for it.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level tokenizers write bytes as: printable ones as themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


_BYTE_CHARS = _byte_chars()


def _is_bytewise(made: dict) -> bool:
    """Whether a tokenizer splits texts by the byte-level pattern and merges bytes, and does nothing else to words."""
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    words = all(len(t["content"]) > 0 and not _WORD.fullmatch(t["content"].strip()) for t in made.get("added_tokens") or [])
    return bool(plain and merges and words and made.get("normalizer") is None)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def ids_crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
