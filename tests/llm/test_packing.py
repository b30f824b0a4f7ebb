import random
import zlib

import numpy as np
import pytest
from llm_cases import ODD

from holdfast.llm import bpe, packing

PATH = bpe.vocabulary_path()


def test_bins_take_the_best_fit_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0)
    assert bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # fits both, bin 1 has less space left
    assert bins.put(5) == (2, 0)
    assert bins.put(8) == (3, 0)  # bins 0 and 2 were open: 0, the fuller one, closes
    assert bins.put(4) == (2, 5)
    assert bins.put(1) == (2, 9)


def check(rows, docs, capacity):
    by_bin = {}
    for row in rows:
        by_bin.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in by_bin.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    library = bpe.load(PATH).library
    want = []
    for key, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start : start + capacity]
            want.append((key, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    return len(by_bin)


def test_documents(frame):
    rows = packing.pack_documents(frame(ODD), "doc_id", "text", PATH).collect()
    check(rows, ODD, 2048)


def test_near_the_bound(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["one", "two", "cat"]) for _ in range(rng.randrange(1, 120)))) for i in range(800)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", PATH, 128).collect()
    bound = sum(r.length for r in rows) / 128
    assert check(rows, docs, 128) <= 1.02 * bound


def test_many_lanes(spark):
    pieces = spark.range(3000).selectExpr("id", "cast(id % 90 + 1 as bigint) as length").repartition(4)
    rows = packing.pack(pieces, "length", ["id"], capacity=100, open_bins=20, lane_pieces=500).collect()
    assert len(rows) == 3000 and len({r.sequence_id >> 40 for r in rows}) > 2
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0
        assert sum(n for _, n in places) <= 100


def test_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text", PATH).collect() == []


def test_too_long_a_piece(spark):
    with pytest.raises(Exception, match="does not fit"):
        packing.pack(spark.range(1).selectExpr("id", "11L as length"), "length", ["id"], capacity=10).collect()


def test_plain_online_and_clashing_names(spark):
    pieces = spark.range(500).selectExpr("id", "cast(id % 90 + 1 as bigint) as length", "'x' as __lane", "'y' as __order", "7 as offset").repartition(3)
    sequences = []
    for window in (1, packing.WINDOW):
        rows = packing.pack(pieces, "length", ["id"], capacity=100, open_bins=20, window=window).collect()
        assert len(rows) == 500 and {(r["__lane"], r["__order"]) for r in rows} == {("x", "y")}
        used = {}
        for r in rows:
            used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in places) <= 100 and min(places)[0] == 0 for places in used.values())
        sequences.append(len(used))
    # Best fit takes at most 1.7 times the least number, and pieces over half a sequence share none.
    assert max(sequences) <= 1.7 * sum(r.length > 50 for r in rows)


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_words_are_encoded_once_while_they_are_known(most):
    import pyarrow as pa

    from holdfast.llm.subwords import Known, encode_texts
    from holdfast.llm.words import texts_of

    library, asked, known = bpe.load(PATH).library, [], Known(most)

    def simple(words):
        asked.extend(words)
        return packing.library_words(PATH, words)

    for column in (["One two, two", "é <|x|> THREE"], ["two three (one)", None], ["four"], ["four ONE"]):
        texts = texts_of(pa.array(column, pa.string()))
        found = encode_texts(texts, simple, lambda w: packing.library_pieces(PATH, w), known)
        for i, text in enumerate(column):
            assert found.ids[found.offsets[i] : found.offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert len(known.hashes) == len(set(known.hashes.tolist())) and (np.diff(known.hashes.astype(object)) > 0).all()
    if most > 3:
        assert len(asked) == len(set(asked))
    else:
        assert len(known.hashes) == 2
