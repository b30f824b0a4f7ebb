"""Words of a batch of texts as numpy arrays over one byte buffer: positions, hashes, and the distinct words.

The helpers run inside Arrow tasks. A batch is cut into slices of whole texts, so that memory follows
``SLICE_BYTES`` or the longest text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20

#: Bytes of the words between white space, and of the words of letters and digits.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Texts:
    """Texts as one byte buffer; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z in lower case; other letters stay."""
        return Texts(LOWER[self.data], self.offsets)

    def pieces(self, limit: int) -> Iterator[tuple[int, Texts]]:
        """Runs of texts of about ``limit`` bytes, or of one longer text, each with the number of its first text."""
        first = 0
        while first < len(self):
            after = int(np.searchsorted(self.offsets, self.offsets[first] + limit, side="right")) - 1
            after = min(max(after, first + 1), len(self))
            low, high = self.offsets[first], self.offsets[after]
            yield first, Texts(self.data[low:high], self.offsets[first : after + 1] - low)
            first = after


@dataclass(frozen=True)
class Words:
    """Words as byte ranges; those of text i are numbers ``offsets[i]`` up to ``offsets[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def spelled(self, chosen: np.ndarray) -> pa.Array:
        """Some words as an Arrow string column, without a Python object per word."""
        n = self.end[chosen] - self.start[chosen]
        places = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        data = np.ascontiguousarray(self.data[ragged(self.start[chosen], n)])
        return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(places), pa.py_buffer(data)])


def texts_of(column: pa.Array) -> Texts:
    """The texts of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pc.fill_null(column, "").cast(pa.large_string())
    _, places, data = wide.buffers()
    if len(wide) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(places, dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(whole[offsets[0] : offsets[-1]], offsets - offsets[0])


def release() -> None:
    """Give freed memory back to the system: Python workers wait for their next task with what they last held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches in pieces of about ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        texts = texts_of(batch.column(text))
        for first, piece in texts.pieces(limit):
            yield batch.slice(first, len(piece)), piece
        batch = texts = piece = None
        release()


def find_words(texts: Texts, inside: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """Maximal runs of the bytes that ``inside`` allows, never across texts; ``cuts`` marks bytes that begin a new word."""
    flags = inside[texts.data]
    begins, ends = flags.copy(), flags.copy()
    begins[1:] &= ~flags[:-1]
    ends[:-1] &= ~flags[1:]
    firsts = texts.offsets[:-1][texts.offsets[:-1] < len(flags)]
    begins[firsts] = flags[firsts]
    lasts = texts.offsets[1:][texts.offsets[1:] > 0] - 1
    ends[lasts] = flags[lasts]
    if cuts is not None and len(cuts):
        begins |= cuts & flags
        ends[:-1] |= begins[1:] & flags[:-1]
    start = np.flatnonzero(begins)
    return Words(texts.data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.offsets))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * _MULTIPLIER
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word, the same in every task; hashes by another seed are independent ones."""
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(words.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = words.end - words.start
    hashes = _mix(left.astype(np.uint64) ^ np.uint64(seed))
    todo, at = np.arange(len(left)), words.start
    while len(todo):
        hashes[todo] = _mix(hashes[todo] ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return hashes


def seeded(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes that depend on a seed each as well; the seeds may themselves be hashes of words."""
    return _mix(_mix(seeds) ^ hashes)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of an example per distinct hash, and for each word the number of its distinct hash."""
    _, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return example, inverse


def equal_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where in it each distinct key begins; equal ones are in any order."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.ones(len(ordered), dtype=bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return order, np.flatnonzero(first)


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash per window of ``size`` consecutive hashes."""
    n = max(len(hashes) - size + 1, 0)
    combined = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        combined = _mix(combined ^ hashes[k : k + n])
    return combined


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ..., start[0] + length[0] - 1, start[1], ... in one array."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, length)
