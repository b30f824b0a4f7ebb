import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import LONG, ODD

from holdfast.llm import bpe
from holdfast.llm.packing import library_pieces, library_words
from holdfast.llm.subwords import encode_texts
from holdfast.llm.words import texts_of

PATH = bpe.vocabulary_path()
VOCABULARY = bpe.load(PATH)


def own_ids(texts):
    found = encode_texts(
        texts_of(pa.array(texts, pa.string())),
        lambda words: bpe.encode_words(VOCABULARY, words),
        lambda pieces: bpe.encode_pieces(VOCABULARY, pieces),
    )
    return [found.ids[a:b].tolist() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]


def library_ids(texts):
    return [VOCABULARY.library.encode(t or "", add_special_tokens=False).ids for t in texts]


CASES = [
    "",
    " ",
    None,
    "It's <|endoftext|> x<|startoftext|>.Y <|ENDOFTEXT|>",
    "don't.'s 're!!#$ 'S é.È! ÀÉ×÷ß ΑΣ. İstanbul Å é. 中文。字 한국 \x1c\x1d x\x85y\xa0z　w",
    "#.a .'s a.'s 12.5 1.2,3 ̀.a̸= ≠.",
    "ab" * 400 + " " + "x" * 3000,
    LONG,
]


def test_equals_the_library():
    assert own_ids(CASES) == library_ids(CASES)


def test_equals_the_library_on_random_characters():
    rng = random.Random(3)
    kinds = [(1, 0x250), (0x300, 0x370), (0x1E00, 0x3100), (0x10000, 0x1F000), (0x20, 0x21), (0x27, 0x2F), (0x73, 0x74)]
    texts = ["".join(chr(rng.randrange(*rng.choice(kinds))) for _ in range(200)) for _ in range(60)]
    assert own_ids(texts) == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeiou st'.,!É9 \n<|>", max_size=60), max_size=4))
def test_equals_the_library_on_any_text(texts):
    assert own_ids(texts) == library_ids(texts)


def test_library_words_one_by_one():
    found = encode_texts(texts_of(pa.array(CASES, pa.string())), lambda w: library_words(PATH, w), lambda p: library_pieces(PATH, p))
    got = [found.ids[a:b].tolist() for a, b in zip(found.offsets[:-1], found.offsets[1:], strict=True)]
    assert got == library_ids(CASES)


@pytest.mark.parametrize("word", ["a", "ab", "internationalisation", "zzzzzzzz", "aaaaaaaaabaaaaaab" * 9])
def test_tree_in_lists_and_in_arrays(word):
    data = np.frombuffer(word.encode(), np.uint8)
    symbols = [*VOCABULARY.inner[data[:-1]].tolist(), int(VOCABULARY.final[data[-1]])]
    size = 1 << max(len(word) - 1, 0).bit_length()
    padded = np.full((size, 1), -1, dtype=np.int64)
    padded[: len(word), 0] = symbols
    rows = bpe.merge_rows(VOCABULARY, padded, np.array([len(word)]))[:, 0]
    assert rows[rows >= 0].tolist() == bpe.merge_word(VOCABULARY, list(symbols)) == library_ids([word])[0]


def test_encode_and_decode(frame):
    df = frame(ODD)
    encoded = bpe.encode(df, "text", PATH, decoded="back")
    rows = bpe.decode(encoded, "ids", PATH).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        ids = VOCABULARY.library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == np.array(ids, "<u4").tobytes()
        assert row.back == row.decoded == VOCABULARY.library.decode(ids, skip_special_tokens=False)
        assert row.words == "x" and row.n == -1


def test_query(spark, tmp_path):
    spark.createDataFrame(ODD, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = bpe.op10(spark, str(tmp_path)).collect()
    want = []
    for key, text in ODD:
        ids = VOCABULARY.library.encode(text or "", add_special_tokens=False).ids
        decoded = VOCABULARY.library.decode(ids, skip_special_tokens=False).encode()
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode(empty, "text", PATH, decoded="back").collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.load(bpe.vocabulary_path("byte_bpe_50k.json"))
