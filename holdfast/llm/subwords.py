"""Subword ids of texts under a word-end vocabulary: every distinct word is encoded once, as long as a worker remembers it.

A text is cut at white space, and between a plain letter or digit and a run of plain punctuation; both are places
where neither normalisation nor the vocabulary's own splitting looks across. What the pieces give is therefore what
the whole text gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from holdfast.llm.words import LOWER, SOLID, Texts, Words, distinct, find_words, hash_words, ragged

MARKS = np.zeros(256, dtype=bool)
MARKS[list(b'.,;:!?()"')] = True
_ASCII_LETTERS = np.zeros(256, dtype=bool)
_ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[0x30:0x3A] = True
#: Second bytes of the letters U+00C0 to U+00FF, which follow 0xC3, and of their capitals.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LATIN_CAPITAL = np.zeros(256, dtype=bool)
_LATIN_CAPITAL[0x80:0x9F] = True
_LATIN_CAPITAL[0x97] = False

#: Words whose ids a worker remembers, at most, about 40 bytes each; or those of one slice of texts.
MOST_KNOWN = 1 << 19

#: Ids of many units in one array, and the number of ids per unit.
Ragged = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class TextIds:
    """The ids of text i are ``ids[offsets[i]:offsets[i + 1]]``."""

    ids: np.ndarray
    offsets: np.ndarray


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the bytes of plain letters, and the bytes in lower case."""
    after_c3 = np.zeros(len(data), dtype=bool)
    after_c3[1:] = data[:-1] == 0xC3
    second = after_c3 & _LATIN[data]
    letters = _ASCII_LETTERS[data] | second
    letters[:-1] |= second[1:]
    lowered = LOWER[data]
    lowered[after_c3 & _LATIN_CAPITAL[data]] += 0x20
    return letters, lowered


def _inside(flags: np.ndarray, words: Words) -> np.ndarray:
    """How many bytes of each word are flagged; those between words never are."""
    return np.add.reduceat(flags, words.start, dtype=np.int64)


class Known:
    """The ids of words that were encoded before, by hash: ``pool[start[i]:start[i] + length[i]]`` are those of ``hashes[i]``.

    Beyond ``most`` words only those of the latest slice of texts are kept, so memory is bounded by these.
    """

    def __init__(self, most: int = MOST_KNOWN) -> None:
        self.most = most
        self.hashes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def missing(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the ascending ``wanted`` are not known."""
        if not len(self.hashes):
            return np.arange(len(wanted))
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.flatnonzero(self.hashes[at] != wanted)

    def add(self, wanted: np.ndarray, fresh: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Learn ``wanted[fresh]``, whose ids are given; all of ``wanted`` are known then."""
        if len(self.hashes) + len(fresh) > self.most:
            used = np.isin(self.hashes, wanted, assume_unique=True)
            n = self.length[used]
            self.pool = self.pool[ragged(self.start[used], n)]
            self.hashes, self.start, self.length = self.hashes[used], np.cumsum(n) - n, n
        at = np.searchsorted(self.hashes, wanted[fresh])
        self.start = np.insert(self.start, at, start + len(self.pool))
        self.length = np.insert(self.length, at, length)
        self.hashes = np.insert(self.hashes, at, wanted[fresh])
        self.pool = np.concatenate([self.pool, ids.astype(np.uint32)])

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, wanted)
        return self.start[at], self.length[at]


@lru_cache(maxsize=4)
def known_words(path: str, method: str) -> Known:
    """What this worker knows of a vocabulary, by the method that encodes; it outlasts tasks, as ids depend on the word alone."""
    return Known()


def encode_texts(texts: Texts, simple: Callable[[list[bytes]], Ragged], other: Callable[[list[str]], Ragged], known: Known | None = None) -> TextIds:
    """The ids of every text.

    ``simple`` encodes lower-case runs of plain letters or of plain punctuation, ``other`` any other piece as it stands. Words
    that are ``known`` go through neither, and the others become known.
    """
    letters, lowered = _letters(texts.data)
    marks, plain = MARKS[texts.data], letters | _DIGITS[texts.data]
    cuts = np.zeros(len(texts.data), dtype=bool)
    cuts[1:] = (plain[:-1] & marks[1:]) | (marks[:-1] & plain[1:])
    words = find_words(texts, SOLID, cuts)
    if not len(words):
        return TextIds(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64))
    size = words.end - words.start
    is_simple = (_inside(letters, words) == size) | (_inside(marks, words) == size)
    # What is not simple keeps its case: names of special tokens depend on it.
    rough = np.flatnonzero(~is_simple)
    at = ragged(words.start[rough], size[rough])
    lowered[at] = texts.data[at]
    words = Words(lowered, words.start, words.end, words.offsets)
    hashes = hash_words(words)
    example, inverse = distinct(hashes)
    wanted = hashes[example]
    del hashes
    known = Known() if known is None else known
    fresh = known.missing(wanted)
    spelled = [words.word(i) for i in example[fresh]]
    kind = is_simple[example[fresh]]
    simple_ids, simple_n = simple([w for w, k in zip(spelled, kind, strict=True) if k])
    other_ids, other_n = other([w.decode() for w, k in zip(spelled, kind, strict=True) if not k])
    length = np.zeros(len(fresh), dtype=np.int64)
    length[kind], length[~kind] = simple_n, other_n
    start = np.zeros(len(fresh), dtype=np.int64)
    start[kind] = np.cumsum(simple_n) - simple_n
    start[~kind] = len(simple_ids) + np.cumsum(other_n) - other_n
    known.add(wanted, fresh, np.concatenate([simple_ids, other_ids]), start, length)
    pool = known.pool
    start, length = known.places(wanted)
    n = length[inverse]
    ids = np.empty(int(n.sum()), dtype=np.uint32)
    done = 0
    for first in range(0, len(n), 1 << 20):
        part = slice(first, first + (1 << 20))
        got = pool[ragged(start[inverse[part]], n[part])]
        ids[done : done + len(got)] = got
        done += len(got)
    before = np.concatenate([[0], np.cumsum(n)])
    return TextIds(ids, before[words.offsets])
