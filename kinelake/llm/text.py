"""Vectorised tokenising and hashing of Arrow text batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``. All arithmetic
is modulo 2**64 on whole batches, so a Python task spends its time in numpy
and never loops over words. Texts are cut into batches between documents
only; a single very long text makes a batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
#: Words of more bytes are hashed by a cryptographic function.
LONG_WORD = 512
_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside words of ASCII letters, digits and all other scripts.
PUNCTUATION = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Powers:
    """Powers of an odd base and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
                    for b in (self.base, self.inverse)
                )
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS, _SECOND_POWERS = Powers(int(_BASE)), Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5)


@dataclass
class Words:
    """Words of some documents: ``bounds[d]:bounds[d + 1]`` are those of document d."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    total: np.ndarray
    offsets: np.ndarray

    def prefixes(self, size: int) -> np.ndarray:
        """Hashes of the first ``size`` bytes of each word (of all, if it has fewer)."""
        _, down = _BYTE_POWERS.get(len(self.total))
        ends = np.minimum(self.starts + size, self.ends)
        return mix((self.total[ends] - self.total[self.starts]) * down[self.starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def windows(self, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, first word) of each run of ``size`` words; ``second`` gives another, independent hash."""
        counts = np.maximum(self.counts - size + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + self.bounds[:-1][doc]
        up, down = (_SECOND_POWERS if second else _WORD_POWERS).get(len(self.hashes) + 1)
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum((mix(self.hashes ^ _BASE) if second else self.hashes) * up[:-1], out=total[1:])
        return mix((total[first + size] - total[first]) * down[first]), doc, first


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A text column in one array."""
    array = batch.column(batch.schema.get_field_index(name))
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else array.cast(pa.string())


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text array, nulls as empty text, and its offsets."""
    n, array = len(array), array.cast(pa.large_string()).fill_null("")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of whole documents of about ``most`` bytes, from the offsets alone: a batch is never copied as a whole."""
    if len(array):
        kind = np.int32 if pa.types.is_string(array.type) else np.int64
        offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1]
        yield from slices(offsets.astype(np.int64), most)


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of whole documents of about ``most`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends with its document."""
    edge = np.zeros(len(member) + 1, bool)
    edge[offsets] = True
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1] | edge[1:-1]
    last[:-1] &= ~member[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, *spans: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Hashes of the bytes between starts and ends, for each pair of them; for short spans."""
    up, down = _BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return [mix((total[ends] - total[starts]) * down[starts]) for starts, ends in spans]


def tokenize(data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of a run of documents; ``space`` says which bytes separate them."""
    base = offsets[rows.start]
    data, offsets = data[base : offsets[rows.stop]], offsets[rows.start : rows.stop + 1] - base
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(rows, data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(1, np.uint64), offsets)
    starts, ends = runs(~space[data], offsets)
    up, down = _BYTE_POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    # Sums modulo a power of two have known collisions of some thousand bytes.
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return Words(rows, data, starts, ends, hashes, np.searchsorted(starts, offsets), total, offsets)


def token_batches(array: pa.Array, lower: bool = False, most: int = CHUNK_BYTES, space: np.ndarray = SPACE) -> Iterator[Words]:
    for rows in pieces(array, most):
        data, offsets = raw(array.slice(rows.start, rows.stop - rows.start))
        words = tokenize(data, offsets, slice(0, len(offsets) - 1), lower, space)
        words.rows = rows
        yield words


def shingle_sets(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their bounds.

    A document with 1 to size - 1 words has its whole sequence as its only
    shingle; one without words has none.
    """
    hashes, doc, _ = words.windows(size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        up, down = _WORD_POWERS.get(len(words.hashes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes * up[:-1], dtype=np.uint64)])
        a, b = words.bounds[short], words.bounds[short + 1]
        own = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        hashes, doc = np.concatenate([hashes, own]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])
        hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(words.bounds)))
