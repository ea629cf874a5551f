"""Texts of an Arrow column as numpy arrays: words, their hashes, runs of words.

Helpers of the operators that work on Arrow batches inside Spark tasks. Work
goes in slices of a few MB of text, so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = U(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


class Texts:
    """Some texts: the bytes of all, byte offsets; words as byte ranges with hashes.

    first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = _BLANK):
        """blank: a flag a byte, set for those that separate words."""
        self.data, self.offsets = data, offsets
        inside = ~blank[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[filled] = False
        self.starts = np.flatnonzero(inside & ~before)
        stops = np.empty_like(inside)
        stops[-1:] = True
        stops[:-1] = ~inside[1:]
        stops[filled[filled > 0] - 1] = True
        self.ends = np.flatnonzero(inside & stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        lens = self.ends - self.starts
        at = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=at[1:])
        held = data[inside]
        if lower:
            held = _LOWER[held]
        place = np.arange(len(held), dtype=np.int32)
        place -= np.repeat(at[:-1].astype(np.int32), lens)
        values = _powers(int(lens.max(initial=0)) + 1)[place]
        values *= held.astype(np.uint16) + np.uint16(1)
        self.hashes = mix(np.add.reduceat(values, at[:-1])) if len(lens) else np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[o[0] : o[-1]], o - o[0]


def slices(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, Texts) over runs of rows with about `most` bytes, one row at least."""
    data, o = raw(column)
    n, i = len(o) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + most, "right")) - 1)
        yield i, j, Texts(data[o[i] : o[j]], o[i : j + 1] - o[i], lower)
        i = j


def pieces(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES, blank: np.ndarray = _BLANK) -> Iterator[tuple[np.ndarray, Texts]]:
    """(row of each text, Texts) of about `most` bytes; a longer row comes as several texts, cut where a word ends."""
    data, o = raw(column)
    ends, rows = [], []
    for i in range(len(o) - 1):
        at = o[i]
        while o[i + 1] - at > most:
            at += most
            while at < o[i + 1] and not len(gap := np.flatnonzero(blank[data[at : min(at + 65_536, o[i + 1])]])):
                at = min(at + 65_536, o[i + 1])
            at = at + gap[0] if at < o[i + 1] else at
            ends.append(at)
            rows.append(i)
        ends.append(o[i + 1])
        rows.append(i)
    cuts, rows = np.array([0, *ends], np.int64), np.array(rows, np.int64)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + most, "right")) - 1)
        yield rows[i:j], Texts(data[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], lower, blank)
        i = j


def grams(t: Texts, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of n words: hash, text and first word of each, in order.

    short: a text of 1 to n - 1 words gives one run of all its words.
    """
    w, total = t.hashes, len(t.hashes)
    if total >= n:
        h = np.zeros(total - n + 1, U)
        for k in range(n):
            h = h * _P + w[k : total - n + 1 + k]
        counts = np.diff(t.first)
        own = np.repeat(np.arange(len(t)), counts)
        ok = own[: total - n + 1] == own[n - 1 :]
        at = np.flatnonzero(ok)
        h, own = mix(h[at]), own[at]
    else:
        h, own, at = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        counts = np.diff(t.first)
        few = np.flatnonzero((counts > 0) & (counts < n))
        if len(few):
            extra = np.array([mix(np.array([sum(int(w[j]) * pow(int(_P), int(t.first[i + 1]) - j, 2**64) for j in range(t.first[i], t.first[i + 1])) % 2**64], U))[0] for i in few], U)
            h, own, at = np.concatenate([h, extra]), np.concatenate([own, few]), np.concatenate([at, t.first[few]])
            order = np.argsort(own, kind="stable")
            h, own, at = h[order], own[order], at[order]
    return h, own, at


def joined_words(t: Texts, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words (those of `keep`) each followed by a space, as bytes, and where each word begins; the last entry is the end."""
    starts, lens = t.starts, t.ends - t.starts
    if keep is not None:
        starts, lens = starts[keep], lens[keep]
    begin = np.concatenate([[0], np.cumsum(lens + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    shift = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64)
    source = place + np.repeat(starts - shift, lens)
    place += np.repeat(begin[:-1] - shift, lens)
    out[place] = t.data[source]
    return out, begin
