"""Vectorised word kernel over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so it is the same on
UTF-8 bytes as on code points. Words are named by 64-bit hashes (a polynomial
over the bytes, then a finaliser); equality of hashes stands for equality of
words, which for the windows of one text errs with odds below 1e-9 even at
100,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER = _SAME.copy()
_LOWER[65:91] += np.uint64(32)

_BASE = 0x9E3779B97F4A7C15 | 1
#: Odd multipliers that tell the five places of a window apart.
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
#: Bytes hashed at once; the working arrays take about 30 times this.
SEGMENT = 1 << 19
WINDOW = 5


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = 1 << max(10, (n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, _BASE & (2**64 - 1), dtype=np.uint64))])
    return _powers


@dataclass
class Words:
    """The words of a batch: hash and text index of each, and the first word of each text (one more at the end)."""

    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def take(self, texts: np.ndarray) -> Words:
        size = self.counts[texts]
        end = np.cumsum(size)
        at = np.repeat(self.first[texts] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
        return Words(self.hash[at], np.concatenate([[0], end]))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, lower: bool) -> Words:
    data, at = raw(texts)
    code = _LOWER if lower else _SAME
    n = len(data)
    hashes, starts = [], []
    low = 0
    while low < n:
        high = min(n, low + SEGMENT)
        while high < n:  # a segment ends where no word runs on: at white space or the end of a text
            stop = np.flatnonzero(_SPACE[data[high : high + 4096]])
            if len(stop):
                high += int(stop[0])
                break
            high = min(n, high + 4096)
        part = data[low:high]
        space = _SPACE[part]
        begin = ~space
        begin[1:] &= space[:-1]
        edge = at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low
        begin[edge] = ~space[edge]
        s = np.flatnonzero(begin)
        if len(s):
            size = np.diff(np.append(s, len(part)))
            place = np.arange(s[0], len(part), dtype=np.int64) - np.repeat(s, size)
            value = code[part[s[0] :]]
            value[space[s[0] :]] = 0
            value *= powers(int(size.max()))[place]
            hashes.append(mix(np.add.reduceat(value, s - s[0])))
            starts.append(s + low)
        low = high
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64))
    begin = np.concatenate(starts)
    return Words(np.concatenate(hashes), np.searchsorted(begin, at))


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each 5-word window and the index of its text."""
    k = len(w.hash) - WINDOW + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(w.first) - 1), w.counts)
    h = np.zeros(k, np.uint64)
    for j in range(WINDOW):
        h += w.hash[j : j + k] * _PLACE[j]
    inside = text[:k] == text[WINDOW - 1 :]
    return mix(h[inside]), text[:k][inside]


def short_hash(h: np.ndarray) -> int:
    """One hash for a text of fewer words than a window."""
    return int(mix((h * _PLACE[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))[0])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingles of each text (A-Z lower-cased)."""
    w = words(texts, lower=True)
    h, of = windows(w)
    cut = np.searchsorted(of, np.arange(len(w.first)))
    out = []
    for i, n in enumerate(w.counts):
        if n >= WINDOW:
            out.append(np.unique(h[cut[i] : cut[i + 1]]))
        elif n:
            out.append(np.array([short_hash(w.hash[w.first[i] : w.first[i + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def repeated_words(w: Words) -> np.ndarray:
    """For each text, the words in 5-word windows found twice or more in it."""
    texts = len(w.first) - 1
    h, of = windows(w)
    if not len(h):
        return np.zeros(texts, np.int64)
    own = mix(h + of.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # the window's first word: windows are counted text by text
    start = np.arange(len(h)) - np.searchsorted(of, of) + w.first[of]
    cover = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(cover, start[twice], 1)
    np.add.at(cover, start[twice] + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[w.first[1:]] - inside[w.first[:-1]]


def ragged(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of arrays."""
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(kind.to_pandas_dtype()) if flat.itemsize == kind.bit_width // 8 else flat.astype(kind.to_pandas_dtype())))


def slices(batch: pa.RecordBatch, column: str, size: int = 2 << 20):
    """Cut a batch into runs of rows whose texts take about `size` bytes."""
    _, at = raw(batch.column(column))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield batch.slice(low, min(high, n) - low)
        low = min(high, n)
