"""Collocations by dynamic itemset counting: phrases of different lengths are counted side by side in cyclic shard scans.

The corpus is dealt into shards that are scanned in turn, round and round. A phrase becomes active in the round after
both its subphrases, it without its last word and it without its first, have reached the threshold, and is counted
for one full cycle from there, so that its count is exact; longer phrases need not wait for a pass to end.

Which phrases are active is held as one byte per slot of a hashed table: the round in which the first phrase of the slot
reached the threshold. It is the same table for all tasks of a round and never changes an entry, so every occurrence
of a phrase agrees on the cycle in which the phrase is counted. Phrases that share a slot can only make one another
active early, or needlessly: its count is exact all the same, and falls at the threshold.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.registry import query
from holdfast.llm.scratch import Scratch, stored
from holdfast.llm.words import Texts, Words, find_words, hash_words, seeded, slices

#: Words of the longest phrase, and occurrences that a phrase needs.
LONGEST, THRESHOLD = 4, 30

#: Shards of a cycle. All phrases are done after at most LONGEST cycles. More shards begin longer phrases earlier and carry
#: the counts of unfinished ones through more rounds.
SHARDS = 2

#: A slot table has a slot per so many bytes of text, a power of two between these bounds. Text of six bytes a word has fewer
#: phrases of up to three words that reach the threshold than slots. Beyond the greatest table more phrases share slots,
#: which costs counting phrases that turn out to be rare and changes no result.
BYTES_PER_SLOT, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 20, 1 << 26

#: Bytes of text that a task counts at a time, and phrases that it remembers to have spelled.
SLICE, SPELLED = 2 << 20, 1 << 20

#: One text in so many is read first for the spelling of frequent phrases.
SAMPLE = 8

#: Slots whose bits make one row of the bitmap that the driver collects.
CHUNK = 1 << 15

#: A phrase stands under this part of its longer ones, in hundredths of its count, to be dropped.
ABSORBED = 80

#: Lanes over which a language's candidates are ranked before the best are merged, and the rows of a word's joins dealt.
LANES, SALTS = 64, 16

SCORE = 2_000_000

#: Bytes that part pieces, and with space and tab those that part words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False

#: A phrase is counted under 120 bits of hash of its language and words; the last byte of ``mark`` has its first round and size.
_COUNTS = "code long, mark long, n long"
_SPELLED = "code long, mark long, lang string, phrase string"
_SIZES = 3

def slots_for(text_bytes: int) -> int:
    wanted = max(text_bytes // BYTES_PER_SLOT, 1)
    return min(max(1 << (wanted - 1).bit_length(), LEAST_SLOTS), MOST_SLOTS)


class _Windows:
    """The windows of 1, 2, ... words of some texts: their hashes, and whether they lie inside one piece."""

    def __init__(self, texts: Texts, langs: list[str | None]) -> None:
        self.words = words = find_words(texts.lower(), INSIDE)
        self.of_text = np.repeat(np.arange(len(texts)), words.counts())
        self.names, self.lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
        self.seeds = hash_words(_as_words(self.names))[self.lang]
        # Two neighbours are in one piece where no end of a piece stands between them.
        before = np.cumsum(ENDS[words.data], dtype=np.int32)[words.start]
        self.joined = np.concatenate([[False], (before[1:] == before[:-1]) & (self.of_text[1:] == self.of_text[:-1])])
        self.hashes = hash_words(words)
        self.others = hash_words(words, seed=1)

    def sizes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per size the hash of the window at each place, and whether it is one."""
        codes, whole = seeded(self.hashes, self.seeds[self.of_text]), np.ones(len(self.words), bool)
        for size in range(1, min(longest, len(self.words)) + 1):
            if size > 1:
                codes, whole = seeded(self.hashes[size - 1 :], codes[:-1]), whole[:-1] & self.joined[size - 1 :]
            yield size, codes, whole

    def marks(self, at: np.ndarray, size: int, start: np.ndarray) -> np.ndarray:
        """An independent hash of the windows at some places, its last byte the first round and the size."""
        codes = seeded(self.others[at], self.seeds[self.of_text[at]])
        for k in range(1, size):
            codes = seeded(self.others[at + k], codes)
        return (codes & ~np.uint64(255)) | (start.astype(np.uint64) << np.uint64(_SIZES)) | np.uint64(size)

    def spelled(self, at: np.ndarray, size: int, words: pa.Array) -> pa.Array:
        """The windows at some places, their words joined by a space."""
        parts = [words.take(pa.array(at + k)) for k in range(size)]
        joined = parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        return joined.cast(pa.string())

    def languages(self, at: np.ndarray) -> pa.Array:
        return pa.array(self.names[self.lang[self.of_text[at]]], pa.string())


def _as_words(names: np.ndarray) -> Words:
    data = [name.encode() for name in names]
    ends = np.cumsum([len(d) for d in data])
    return Words(np.frombuffer(b"".join(data) or b"\0", np.uint8), np.concatenate([[0], ends[:-1]]), ends, np.array([0, len(data)]))


def _word_array(words: Words) -> pa.Array:
    """The words as an Arrow array."""
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    data = words.data[INSIDE[words.data]]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


def _starts(windows: _Windows, reached: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per size the hash of the window at each place and the round in which its phrase becomes active, 0 for never."""
    mask, shorter = np.uint64(len(reached) - 1), None
    for size, codes, whole in windows.sizes(longest):
        if size == 1:
            start = np.ones(len(codes), np.uint8)
        else:
            start = np.where(whole & (np.minimum(shorter[:-1], shorter[1:]) > 0), np.maximum(shorter[:-1], shorter[1:]) + np.uint8(1), np.uint8(0))
        shorter = reached[codes & mask]
        yield size, codes, start


def count_slice(texts: Texts, langs: list[str], reached: np.ndarray, turn: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """The counts of the phrases that are active in round ``turn`` (from 1) over some texts.

    ``reached`` holds per slot the round in which a phrase of it reached the threshold, 0 if none has.
    """
    windows = _Windows(texts, langs)
    for size, codes, start in _starts(windows, reached, longest):
        here = np.flatnonzero((start > 0) & (start <= turn) & (turn < start.astype(np.int16) + shards))
        if len(here):
            distinct, example, count = np.unique(codes[here], return_index=True, return_counts=True)
            at = here[example]
            marks = windows.marks(at, size, start[at])
            yield pa.record_batch({"code": distinct.view(np.int64), "mark": marks.view(np.int64), "n": count.astype(np.int64)})


def spell_slice(texts: Texts, langs: list[str], reached: np.ndarray, frequent: np.ndarray, longest: int, told: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The spelling of the phrases whose slot is marked in ``frequent``, but for those in ``told``, the hashes of those
    that this task has spelled lately, per size."""
    windows = _Windows(texts, langs)
    spelled = _word_array(windows.words)
    for size, codes, start in _starts(windows, reached, longest):
        here = np.flatnonzero((start > 0) & (frequent[codes & np.uint64(len(frequent) - 1)] > 0))
        distinct, example = np.unique(codes[here], return_index=True)
        known = told.get(size, distinct[:0])
        new = ~np.isin(distinct, known, assume_unique=True)
        at = here[example[new]]
        told[size] = np.concatenate([known if len(known) < SPELLED else known[:0], distinct[new]])
        marks = windows.marks(at, size, start[at]).view(np.int64)
        yield pa.RecordBatch.from_arrays([codes[at].view(np.int64), marks, windows.languages(at), windows.spelled(at, size, spelled)], ["code", "mark", "lang", "phrase"])


def words_of_slice(texts: Texts, langs: list[str]) -> pa.RecordBatch:
    """The number of words per language."""
    names, lang = np.unique(np.array(langs, dtype=object), return_inverse=True)
    counts = np.zeros(len(names), np.int64)
    np.add.at(counts, lang, find_words(texts, INSIDE).counts())
    return pa.record_batch({"lang": pa.array(names, pa.string()), "n": counts})


def frequent_phrases(df: DataFrame, lang: Column, text: Column, scratch: Scratch, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``threshold`` occurrences in a language, and each one's words.

    Gives ``lang``, ``phrase``, ``size``, ``n``, and ``lang``, ``total``. ``lang`` must not be null; null texts are empty. The corpus is
    written once in shards; between rounds only the counts of active phrases stay, and the slots. A last scan
    spells the frequent ones.
    """
    if shards * longest >= 1 << (8 - _SIZES) or longest >= 1 << _SIZES:
        raise ValueError("too many rounds or words")
    spark = df.sparkSession
    whole = F.coalesce(text, F.lit(""))
    dealt = df.select(lang.alias("lang"), whole.alias("text"), (F.monotonically_increasing_id() % shards).cast("int").alias("shard"))
    corpus = scratch.store(dealt.where(F.col("text") != ""), "shards", "shard")
    size = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    reached = np.zeros(slots_for(size), np.uint8)
    active, rounds = spark.createDataFrame([], _COUNTS), Scratch(spark)
    finished, last, turn = [], 0, 0
    first = F.shiftright(F.col("mark").bitwiseAND(F.lit(255)), _SIZES)
    shorter = F.col("mark").bitwiseAND(F.lit((1 << _SIZES) - 1)) < longest
    # Phrases that the reached ones of round ``last`` made active are done ``shards`` rounds later.
    while turn < last + shards:
        turn += 1
        told = spark.sparkContext.broadcast(reached)

        def count(batches: Iterator[pa.RecordBatch], told=told, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, "text", SLICE):
                yield from count_slice(texts, batch.column("lang").to_pylist(), told.value, turn, shards, longest)

        scanned = corpus.where(F.col("shard") == (turn - 1) % shards).select("lang", "text").mapInArrow(count, _COUNTS)
        merged = active.unionByName(scanned).groupBy("code", "mark").agg(F.sum("n").alias("n"))
        done = first + (shards - 1) <= turn
        before, rounds = rounds, Scratch(spark)
        state = rounds.store(merged.where(~done | (F.col("n") >= threshold)), "round", reclaim=True)
        told.destroy()
        before.clear()
        if _enter(reached, state.where(shorter & (F.col("n") >= threshold)), turn):
            last = turn
        finished.append(scratch.store(state.where(done), "done"))
        active = state.where(~done)
    rounds.clear()
    every = functools.reduce(DataFrame.unionByName, finished)
    spelled = _spellings(corpus, every, reached, longest, scratch)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE):
            yield words_of_slice(texts, batch.column("lang").to_pylist())

    size = F.col("mark").bitwiseAND(F.lit((1 << _SIZES) - 1)).cast("int").alias("size")
    named = scratch.store(every.join(spelled, ["code", "mark"]).select("lang", "phrase", size, "n"), "phrases", reclaim=True)
    totals = scratch.store(corpus.select("lang", "text").mapInArrow(tally, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    return named, totals


def _spellings(corpus: DataFrame, every: DataFrame, reached: np.ndarray, longest: int, scratch: Scratch) -> DataFrame:
    """``lang`` and ``phrase`` of all phrases in ``every``, by ``code`` and ``mark``.

    A frequent phrase stands nearly anywhere, so one text in ``SAMPLE`` tells nearly all of them; the others, whatever their
    number, are then looked for in all texts.
    """
    found, missing = None, every.select("code", "mark")
    for texts_read in (corpus.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), corpus):
        wanted = np.zeros_like(reached)
        _enter(wanted, missing, 1)
        both = corpus.sparkSession.sparkContext.broadcast((reached, wanted))

        def spell(batches: Iterator[pa.RecordBatch], both=both) -> Iterator[pa.RecordBatch]:
            lately: dict[int, np.ndarray] = {}
            for batch, texts in slices(batches, "text", SLICE):
                yield from spell_slice(texts, batch.column("lang").to_pylist(), *both.value, longest, lately)

        told = texts_read.select("lang", "text").mapInArrow(spell, _SPELLED).join(missing, ["code", "mark"], "left_semi")
        told = scratch.store(told.groupBy("code", "mark").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase")), "spelled", reclaim=True)
        both.destroy()
        found = told if found is None else found.unionByName(told)
        missing = every.select("code", "mark").join(told, ["code", "mark"], "left_anti")
    return found


def _enter(slots: np.ndarray, phrases: DataFrame, turn: int) -> bool:
    """Enter the round in the free slots of the phrases; whether any slot changed.

    The executors make one bitmap per chunk of slots, so the driver gets an eighth of the table at most.
    """
    slot = phrases.select(F.col("code").bitwiseAND(F.lit(len(slots) - 1)).alias("slot"))
    bits = slot.groupBy(F.call_function("div", "slot", F.lit(CHUNK)).alias("chunk")).agg(F.bitmap_construct_agg(F.col("slot") % CHUNK).alias("bits"))
    changed = False
    for row in bits.toLocalIterator():
        chunk = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little").astype(bool)
        at = slots[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK]
        free = chunk[: len(at)] & (at == 0)
        at[free] = turn
        changed = changed or bool(free.any())
    return changed


def collocations(frequent: DataFrame, totals: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Candidates of two words or more with their least cut, without those that a longer candidate absorbs.

    Gives ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``; arithmetic is on decimals of 38 digits. A word stands in the cuts of any
    number of phrases, so the counts are repeated per salt and the cuts dealt over the salts.
    """
    words = F.split("phrase", " ")
    phrases = frequent.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = phrases.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size")).alias("rest"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    salted = frequent.select("lang", "phrase", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    for name, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(salted.select("lang", "salt", F.col("phrase").alias(name), F.col("n").alias(count)), ["lang", "salt", name])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCORE).cast("decimal(7,0)"), F.col("l").cast("decimal(20,0)") + F.col("r"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i -> array_join(slice(words, i, w), ' '))))"))
    longer = phrases.where("size > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("above").isNull() | (F.col("above").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * absorbed))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def top_phrases(scored: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language by score, count and spelling, with their rank; lanes are ranked first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    near = scored.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order)))
    ranked = near.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= most).drop("lane")


def mine_phrases(df: DataFrame, lang: str = "lang", text: str = "text", most: int = 2000, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """The ``most`` best collocations per language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Words are lower-cased in A-Z only; a null language is ``und``, a null text is empty, and repeated rows count as often
    as they stand. A table without frequent phrases gives no rows.
    """
    scratch = Scratch(df.sparkSession)
    frequent, totals = frequent_phrases(df, F.coalesce(F.col(lang), F.lit("und")), F.col(text), scratch, threshold, longest, shards)
    best = stored(top_phrases(collocations(frequent, totals), most), "collocations")
    scratch.clear()
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
    list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
  FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
), grams AS (
  SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS t(size))
), f AS (
  SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.size, c.phrase, a, k, l.n AS l, r.n AS r, (2000000 * a) // (l.n + r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS above
  FROM (
    SELECT lang, a, array_to_string(ws[i:i + w - 1], ' ') AS phrase
    FROM (SELECT lang, a, ws, w, unnest(range(1, size - w + 2)) AS i FROM candidates, (VALUES (2), (3)) AS t(w) WHERE w < size)
  )
  GROUP BY ALL
), ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, t.n, s.score,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase COLLATE "C") AS rank
  FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE above IS NULL OR 100 * above < 80 * s.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


@query("op11_collocations", _SQL)
def op11(spark, sf_dir):
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
