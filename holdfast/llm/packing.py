"""Packing tokenized documents into sequences of bounded length.

Only documents longer than a sequence are cut. Pieces are packed online by best fit with a fixed number of open
bins: a piece goes to the open bin with the least free space that still holds it, found in a bitset keyed by free
space; when a new bin is needed and all are open, the fullest closes.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.bpe import vocabulary_path
from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import free_name, stored
from holdfast.llm.subwords import Ragged, encode_texts, known_words
from holdfast.llm.words import slices

SEQUENCE = 2048
OPEN_BINS = 1024

#: Pieces that one lane packs on average. Lanes are packed apart; each ends with at most ``OPEN_BINS`` unfinished bins.
LANE_PIECES = 200_000

#: Pieces that are looked at together: the longest among them are packed first.
WINDOW = 2000

#: Words that the tokenizers library encodes as one text.
JOINED = 2000

PIECES = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


@lru_cache(maxsize=4)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    last[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
    return tokenizer, last


def library_words(path: str, words: list[bytes]) -> Ragged:
    """The library's ids of words that are one unit each; many go through it as one text, told apart by their word ends."""
    tokenizer, last = _library(path)
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(0, len(words), JOINED):
        text = b" ".join(words[first : first + JOINED]).decode()
        found = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
        ids.append(found)
        counts.append(np.diff(np.flatnonzero(last[found]) + 1, prepend=0))
    return np.concatenate(ids), np.concatenate(counts)


def library_pieces(path: str, pieces: list[str]) -> Ragged:
    tokenizer, _ = _library(path)
    found = [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
    counts = np.array([len(f) for f in found], dtype=np.int64)
    return np.array([i for f in found for i in f], dtype=np.int64), counts


def tokenize(df: DataFrame, key: str, text: str, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Per piece: the document's key and row, piece number, start, length and checksum of its ids.

    A document is the ids of its text and then id 0, so null and empty texts are one piece of length 1. ``row``
    tells equal documents apart.
    """
    frame = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    kept = [frame.schema["key"], T.StructField("row", T.LongType()), *PIECES.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            found = encode_texts(texts, lambda w: library_words(path, w), lambda w: library_pieces(path, w), known_words(path, "library"))
            data, offsets = found.ids.astype("<u4"), found.offsets
            which, piece, start, length, checksum = [], [], [], [], []
            for i in range(len(texts)):
                ids = np.append(data[offsets[i] : offsets[i + 1]], np.uint32(0)).astype("<u4")
                for number, first in enumerate(range(0, len(ids), sequence)):
                    own = ids[first : first + sequence]
                    which.append(i)
                    piece.append(number)
                    start.append(first)
                    length.append(len(own))
                    checksum.append(zlib.crc32(own))
            rows = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(rows),
                    batch.column("row").take(rows),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(checksum, pa.int64()),
                ],
                names=[f.name for f in kept],
            )

    return frame.mapInArrow(run, T.StructType(kept))


class OpenBins:
    """At most ``limit`` open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: defaultdict[int, deque[int]] = defaultdict(deque)

    def _take(self, free: int) -> int:
        found = self.by_free[free].popleft()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """The number of the bin that takes a piece, and the piece's place in it."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.capacity - free


def pack(
    pieces: DataFrame, length: str, spread: list[str], capacity: int = SEQUENCE, open_bins: int = OPEN_BINS,
    lane_pieces: int = LANE_PIECES, window: int = WINDOW,
) -> DataFrame:
    """The frame with ``sequence_id`` and ``offset``; pieces longer than ``capacity`` are an error.

    ``spread`` names columns that tell rows apart: their hash deals the pieces evenly into lanes, about one per
    ``lane_pieces`` rows, and orders them inside, so equal keys do not gather. A lane is packed as a stream, ``window`` pieces
    at a time and the longest of these first, an extension of online best fit, which ``window=1`` is: memory is the open bins and
    a window. With few open bins a wide window does harm, as long pieces close them before short ones come. Columns called ``sequence_id`` or ``offset`` are replaced. The frame is read twice, once for its count, so it should be stored.
    """
    pieces = pieces.drop("sequence_id", "offset")
    lanes = max(1, round(pieces.count() / lane_pieces))
    place, lane_of = free_name(pieces, "__order"), free_name(pieces, "__lane")
    ready = pieces.withColumn(place, F.xxhash64(*spread)).withColumn(lane_of, F.pmod(F.xxhash64(place), F.lit(lanes)).cast("int"))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    kept = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, bins = None, None
        for whole in batches:
            for first in range(0, whole.num_rows, window):
                batch = whole.slice(first, window)
                lanes_of, sizes = batch.column(lane_of).to_pylist(), batch.column(length).to_pylist()
                numbers, places = [0] * len(sizes), [0] * len(sizes)
                for i in sorted(range(len(sizes)), key=lambda i: (lanes_of[i], -sizes[i])):
                    if not 0 < sizes[i] <= capacity:
                        raise ValueError(f"a piece of length {sizes[i]} does not fit a sequence of {capacity}")
                    if lanes_of[i] != lane:
                        lane, bins = lanes_of[i], OpenBins(capacity, open_bins)
                    number, places[i] = bins.put(sizes[i])
                    numbers[i] = (lane << 40) + number
                columns = [batch.column(name) for name in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return ready.repartition(lanes, lane_of).sortWithinPartitions(lane_of, place, *spread).mapInArrow(run, schema)


def pack_documents(df: DataFrame, key: str, text: str, path: str, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenize and pack: one row per piece with its sequence and place there.

    Every row of the frame is a document of its own, also if its key is null or repeated. The pieces, without their
    ids, are written to the shared folder before they are packed.
    """
    pieces = stored(tokenize(df, key, text, path, sequence), "pieces")
    packed = pack(pieces, "length", ["row", "piece"], sequence, open_bins)
    return packed.select(F.col("key").alias(key), *PIECES.names, "sequence_id", "offset")


@query("op2_packing")
def op2(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), "doc_id", "text", vocabulary_path())
