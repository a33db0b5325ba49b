"""Words and their 64-bit hashes for whole Arrow columns of texts, in numpy.

Texts are read as the UTF-8 bytes that Arrow holds. Words are runs of bytes other than
0x20 and 0x09 to 0x0D; A-Z are lower-cased. A word's hash takes eight bytes at a time,
of all words at once, so no Python code runs per word but for very long ones. Equal
words have equal hashes; unequal ones collide with odds of about 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Tables for one task."""

    #: Bytes of a word up to which it is hashed by eight bytes at a time, with others.
    LONG = 512

    def __init__(self) -> None:
        self.mask = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
        self.base = 0xD6E8FEB86659FD93
        self._grow(CHUNK)

    def _grow(self, n: int) -> None:
        for name, factor in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
            steps = np.full(n + 1, factor, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, hash) of each word, and for each text the
        number of its first word, with one entry more for the end. No word spans two
        texts."""
        n = len(data)
        inside = np.zeros(n + 2, dtype=bool)
        # Unsigned numbers: what is below 9 becomes large.
        np.logical_and(data - np.uint8(9) > 4, data != 32, out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        cut = offsets[(offsets > 0) & (offsets < n)]
        cut = np.unique(cut[inside[cut] & inside[cut + 1]])
        if len(cut):  # texts that touch
            starts, ends = np.sort(np.concatenate([starts, cut]), kind="stable"), np.sort(np.concatenate([ends, cut]), kind="stable")
        return starts, ends, self._hash(data, starts, ends - starts), np.searchsorted(starts, offsets)

    def _hash(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) // 8 * 8 + 24, dtype=np.uint8)
        np.bitwise_or(data, (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5), out=padded[: len(data)])
        blocks = padded.view(np.uint64)
        out = size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        some = None
        at, left, h = starts, size, out
        while len(at):
            block, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
            # A shift by 64 or more bits gives 0.
            eight = (blocks[block] >> shift) | (blocks[block + 1] << (np.uint64(64) - shift))
            h = (h ^ (eight & self.mask[np.minimum(left, 8)])) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            if some is None:
                out, some = h, np.flatnonzero((size > 8) & (size <= self.LONG))
                more = some
            else:
                out[some] = h
                keep = left > 8
                some, more = some[keep], keep
            at, left, h = at[more] + 8, left[more] - 8, h[more]
        out = mix64(out)
        for i in np.flatnonzero(size > self.LONG):
            word = padded[starts[i] : starts[i] + size[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def sequences(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A digest of each run of words, in their order; `first` holds the number of the
        first word of each run, with one entry more for the end."""
        n = len(hashes)
        if n >= len(self.power):
            self._grow(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * self.power[:n], out=sums[1:])
        return mix64((sums[first[1:]] - sums[first[:-1]]) * self.inverse[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets of the texts in the bytes) for
    runs of texts of about `limit` bytes. Null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
