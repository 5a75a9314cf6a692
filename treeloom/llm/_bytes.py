"""Word and shingle arithmetic on Arrow string buffers.

Everything works on the UTF-8 bytes of a whole batch of documents at once:
word bounds come from a byte table, word hashes from one running polynomial
sum, so no Python object is made per word.  Hashes have 64 bits.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2^64
SLICE_BYTES = 1 << 18  # running sums of a slice take some 60 bytes a byte


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def byte_table(separators: str) -> np.ndarray:
    """True where a byte belongs to a word. ``space``: all but ASCII white
    space; ``alnum``: digits, letters and every byte from 0x80 on."""
    table = np.ones(256, bool)
    if separators == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    elif separators == "alnum":
        table[0x00:0x30] = False
        table[0x3A:0x41] = False
        table[0x5B:0x61] = False
        table[0x7B:0x80] = False
    else:
        raise ValueError(separators)
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for b in (BASE, _inverse(BASE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def text_slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES):
    """Yield (first row, byte buffer, offsets) over runs of whole documents of
    about ``slice_bytes``; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + slice_bytes, "right")) - 1)
        yield row, buf[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of documents: byte bounds, owners and hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        n = len(buf)
        self.offsets, self.docs = offsets, len(offsets) - 1
        self.buf = lower_table()[buf] if lower else buf
        is_word = table[buf]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = is_word
        after = np.empty(n + 1, bool)
        after[-1] = False
        after[:-1] = is_word
        # a document's first byte starts a word even right after another's last
        cut = offsets[1:-1]
        step = before != after
        starts_at, ends_at = step & after, step & before
        both = cut[(before & after)[cut]] if len(cut) else cut
        starts_at[both] = True
        ends_at[both] = True
        self.start, self.end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
        self.first = np.searchsorted(self.start, offsets)  # word range of each document
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def prefix_hashes(self, size: int) -> np.ndarray:
        """Hashes of the words' first ``size`` bytes (of all, if fewer)."""
        n = len(self.buf)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        end = np.minimum(self.end, self.start + size)
        return mix((sums[end] - sums[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.count)

    def points(self) -> np.ndarray:
        """Code points before each byte of the run."""
        lead = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=lead[1:])
        return lead


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words, documents' bounds ignored."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each document; a document with fewer
    words has its whole sequence as its one shingle, one without words none."""
    h = words.hashes()
    grams, out = ngrams(h, n), []
    for first, count in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(grams[first : first + count - n + 1]))
        elif count:
            acc = np.uint64(count)
            with np.errstate(over="ignore"):
                for x in h[first : first + count]:
                    acc = acc * np.uint64(0x9FB21C651E98DF25) + x
            out.append(mix(np.array([acc])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SPACE, ALNUM = byte_table("space"), byte_table("alnum")


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that ``Words.hashes`` gives these words."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = [w.encode() for w in words]
    sizes = np.array([len(r) for r in raw])
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
    power, inverse = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=sums[1:])
    _POWERS.clear()  # functions of this module are shipped with its globals
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + sizes.astype(np.uint64))
