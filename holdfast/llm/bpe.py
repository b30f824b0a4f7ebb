"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree hold rank and place of each adjacent pair; every node holds the least below it, so the root is
the leftmost pair of lowest rank. A merge changes at most three leaves and the paths above them, until the root holds
no mergeable pair. Words of like length share their steps as rows of one array of trees; very long ones, which are
rare, run one at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.registry import documents, query
from holdfast.llm.subwords import Ragged, encode_texts, known_words
from holdfast.llm.words import ragged, slices

VOCABULARY = "word_bpe_49k.json"

#: Words beyond this many symbols run one at a time; trees of shorter ones are built for so many symbols together.
LONG, CELLS = 128, 1 << 18

#: Bytes of text that a task encodes together.
ENCODE_BYTES = 6 << 20

_NONE = np.int64(1) << 62
_SHIFT = np.int64(32)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """Symbols, merges and special tokens of a vocabulary file with word ends."""

    tokens: list[str]
    inner: np.ndarray
    final: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    special: dict[str, int]
    library: object

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        wanted = (left.astype(np.int64) << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], -1)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a vocabulary file of the tokenizers library: byte-level BPE with a word-end suffix."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    suffix, ids = model["end_of_word_suffix"], model["vocab"]
    odd = [t for t in content["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    if model["type"] != "BPE" or not suffix or odd or content["post_processor"] or content["decoder"]:
        raise ValueError(f"{path} is no byte-level BPE vocabulary with word ends")
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *special.values()]))
    for token, i in {**ids, **special}.items():
        tokens[i] = token
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
    order = np.argsort(pairs, kind="stable")
    characters = byte_characters()
    return Vocabulary(
        tokens,
        np.array([ids[c] for c in characters], dtype=np.int64),
        np.array([ids[c + suffix] for c in characters], dtype=np.int64),
        pairs[order],
        order.astype(np.int64),
        np.array([ids[a + b] for a, b in merges], dtype=np.int64),
        special,
        Tokenizer.from_file(path),
    )


def merge_rows(vocabulary: Vocabulary, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Merge words of at most ``P`` symbols, a power of two; ``symbols`` is (P, words), and -1 marks what a merge consumed."""
    places, count = symbols.shape
    symbols = symbols.copy()
    place = np.arange(places, dtype=np.int64)[:, None]
    following = np.where(place + 1 < lengths, place + 1, places)
    preceding = np.broadcast_to(place - 1, (places, count)).copy()
    tree = np.full((2 * places, count), _NONE)
    if places > 1:
        ranks = vocabulary.rank(symbols[:-1], symbols[1:])
        mergeable = (ranks >= 0) & (place[:-1] + 1 < lengths)
        tree[places:-1] = np.where(mergeable, ranks * places + place[:-1], _NONE)
    width = places // 2
    while width:
        tree[width : 2 * width] = np.minimum(tree[2 * width : 4 * width : 2], tree[2 * width + 1 : 4 * width : 2])
        width //= 2

    def renew(leaf: np.ndarray, words: np.ndarray, value: np.ndarray) -> None:
        node = leaf + places
        tree[node, words] = value
        for _ in range(places.bit_length() - 1):
            node = node >> 1
            tree[node, words] = np.minimum(tree[2 * node, words], tree[2 * node + 1, words])

    def value_of(left: np.ndarray, right: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        rank = vocabulary.rank(left, right)
        return np.where(rank >= 0, rank * places + leaf, _NONE)

    words = np.flatnonzero(tree[1] < _NONE)
    while len(words):
        root = tree[1, words]
        left = root % places
        right = following[left, words]
        merged = vocabulary.merged[root // places]
        after = following[right, words]
        symbols[left, words], symbols[right, words] = merged, -1
        following[left, words] = after
        renew(right, words, _NONE)
        inner = after < places
        preceding[after[inner], words[inner]] = left[inner]
        value = np.full(len(words), _NONE)
        value[inner] = value_of(merged[inner], symbols[after[inner], words[inner]], left[inner])
        renew(left, words, value)
        before = preceding[left, words]
        inner = before >= 0
        before, has = before[inner], words[inner]
        renew(before, has, value_of(symbols[before, has], merged[inner], before))
        words = words[tree[1, words] < _NONE]
    return symbols


def merge_word(vocabulary: Vocabulary, symbols: list[int]) -> list[int]:
    """Merge one word of any length: the same tree in plain lists."""
    count = len(symbols)
    places = 1 << max(count - 1, 1).bit_length()
    none = int(_NONE)
    tree = [none] * (2 * places)
    ranks = vocabulary.rank(np.array(symbols[:-1], dtype=np.int64), np.array(symbols[1:], dtype=np.int64)).tolist()
    for i, rank in enumerate(ranks):
        tree[places + i] = rank * places + i if rank >= 0 else none
    for node in range(places - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    following, preceding = [*range(1, count), -1], list(range(-1, count - 1))
    merged_of, known = vocabulary.merged.tolist(), {}

    def renew(leaf: int, value: int) -> None:
        node = places + leaf
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    def value_of(left: int, right: int, leaf: int) -> int:
        if (left, right) not in known:
            known[left, right] = int(vocabulary.rank(np.array([left]), np.array([right]))[0])
        rank = known[left, right]
        return rank * places + leaf if rank >= 0 else none

    while tree[1] < none:
        rank, left = divmod(tree[1], places)
        right = following[left]
        after = following[right]
        symbols[left], symbols[right] = merged_of[rank], -1
        following[left] = after
        renew(right, none)
        if after >= 0:
            preceding[after] = left
        renew(left, value_of(symbols[left], symbols[after], left) if after >= 0 else none)
        before = preceding[left]
        if before >= 0:
            renew(before, value_of(symbols[before], symbols[left], before))
    return [s for s in symbols if s >= 0]


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> Ragged:
    """The ids of words without white space that the vocabulary splits no further."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    if not len(words):
        return np.zeros(0, np.int64), lengths
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    start = np.cumsum(lengths) - lengths
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, high = 0, 1
    while low < LONG:
        group = np.flatnonzero((lengths > low) & (lengths <= high))
        for first in range(0, len(group), CELLS // high):
            part = group[first : first + CELLS // high]
            n = lengths[part]
            symbols = np.full((len(part), high), -1, dtype=np.int64)
            symbols[np.arange(high) < n[:, None]] = vocabulary.inner[data[ragged(start[part], n)]]
            symbols[np.arange(len(part)), n - 1] = vocabulary.final[data[start[part] + n - 1]]
            merged = merge_rows(vocabulary, np.ascontiguousarray(symbols.T), n).T
            found.append((part, merged[merged >= 0], (merged >= 0).sum(axis=1)))
        low, high = high, 2 * high
    for i in np.flatnonzero(lengths > LONG).tolist():
        own = data[start[i] : start[i] + lengths[i]]
        ids = merge_word(vocabulary, [*vocabulary.inner[own[:-1]].tolist(), int(vocabulary.final[own[-1]])])
        found.append((np.array([i]), np.array(ids, dtype=np.int64), np.array([len(ids)])))
    counts = np.zeros(len(words), dtype=np.int64)
    place = np.zeros(len(words), dtype=np.int64)
    pool, before = [], 0
    for part, ids, n in found:
        counts[part] = n
        place[part] = before + np.cumsum(n) - n
        pool.append(ids)
        before += len(ids)
    return np.concatenate(pool)[ragged(place, counts)], counts


def encode_pieces(vocabulary: Vocabulary, pieces: list[str]) -> Ragged:
    """The ids of any texts: special tokens first, then the vocabulary's normalisation and splitting, then merges."""
    characters = {c: b for b, c in enumerate(byte_characters())}
    split = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
    numbers: dict[bytes, int] = {}
    units: list[int] = []
    per_piece = np.zeros(len(pieces), dtype=np.int64)
    for i, piece in enumerate(pieces):
        before = len(units)
        for part in split.split(piece) if split else [piece]:
            if part in vocabulary.special:
                units.append(-1 - vocabulary.special[part])
            elif part:
                text = vocabulary.library.normalizer.normalize_str(part)
                for word, _ in vocabulary.library.pre_tokenizer.pre_tokenize_str(text):
                    units.append(numbers.setdefault(bytes(characters[c] for c in word), len(numbers)))
        per_piece[i] = len(units) - before
    ids, counts = encode_words(vocabulary, list(numbers))
    chosen = np.array(units, dtype=np.int64)
    named = chosen < 0
    start = np.concatenate([np.cumsum(counts) - counts, np.zeros(1, np.int64)])
    length = np.concatenate([counts, np.ones(1, np.int64)])
    at = np.where(named, len(counts), chosen)
    unit_length = length[at]
    out = np.concatenate([ids, np.zeros(1, np.int64)])[ragged(np.where(named, len(ids), start[at]), unit_length)]
    first = np.cumsum(unit_length) - unit_length
    out[first[named]] = -1 - chosen[named]
    running = np.concatenate([[0], np.cumsum(unit_length)])
    ends = np.cumsum(per_piece)
    return out, running[ends] - running[ends - per_piece]


def _spelled(tokens: list[str], ids: np.ndarray) -> str:
    if len(ids) and ids.max() >= len(tokens):
        ids = ids[ids < len(tokens)]
    return " ".join(map(tokens.__getitem__, ids.tolist()))


def encode(df: DataFrame, text: str, path: str, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """The frame with a binary column ``out``: the ids of the text as little-endian unsigned 32-bit integers.

    ``decoded`` names a column for what ``decode`` makes of them, in the same pass. Null and empty texts have no ids.
    Every row stays; columns already called so are replaced.
    """
    df = df.drop(out, *([decoded] if decoded else []))
    own = [T.StructField(out, T.BinaryType()), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*df.schema.fields, *own])
    names = [f.name for f in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch, texts in slices(batches, text, ENCODE_BYTES):
            found = encode_texts(texts, lambda w: encode_words(vocabulary, w), lambda w: encode_pieces(vocabulary, w), known_words(path, "tree"))
            each = [found.ids[a:b] for a, b in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True)]
            columns = [pa.array([ids.astype("<u4").tobytes() for ids in each], pa.binary())]
            if decoded:
                columns.append(pa.array([_spelled(vocabulary.tokens, ids) for ids in each], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """The frame with a string column ``out``: the tokens of the ids, special ones included, with a space between.

    Null ids decode to an empty text. Ids that the vocabulary lacks are left out.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(path).tokens
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                texts = [_spelled(tokens, np.frombuffer(packed or b"", dtype="<u4")) for packed in batch.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_bpe")
def op10(spark, sf_dir):
    return encode(documents(spark, sf_dir), "text", vocabulary_path(), decoded="decoded").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
