import re

import pytest
from llm_cases import ODD

from holdfast.llm import licenses

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
    return len(words), found


CASES = [
    *ODD,
    (10, "Licensed under CC-BY-NC 4.0. All rights reserved; all rights reserved. ALL RIGHTS reserved"),
    (11, "reserved rights all all rights"),
    (12, "the GNU General Public License and the general public"),
    (13, "license"),
    (13, "cc by cc by cc by " * 500),
    (14, "cc\nby ccby cc é by"),
]


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(CASES, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = licenses.op1(spark, str(tmp_path)).collect()
    want = []
    for key, text in CASES:
        n, base = places(text, licenses.BASE_PHRASES)
        _, every = places(text, licenses.PHRASES)
        at = [i for i, _ in base]
        labels = [",".join(sorted({label for _, label in found})) for found in (base, every)]
        want.append((key, n, len(base), min(at, default=None), max(at, default=None), *labels, 1.0 if every else 0.0))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("notice", licenses.NOTICES, ids=lambda n: n.label + n.text[:12])
def test_notices_are_found_in_place(frame, notice):
    edited = notice.text.replace(" the ", " THE\n", 1).replace(",", " ")
    rows = licenses.scan(frame([(1, "some words first. " * 7 + edited + " and after"), (2, "nothing here")]), "text").collect()
    found = {r.doc_id: [m for m in r.licenses.matches if m.rule == "notice"] for r in rows}
    match = next(m for m in found[1] if m.label == notice.label)
    assert abs(match.first_word - 21) <= licenses.SLACK and match.score > 0.9
    assert found[2] == [] and rows[0].words == "x"


def test_key_phrases_are_mandatory(frame):
    mit = licenses.NOTICES[0]
    broken = mit.text.replace("Permission is hereby granted", "Permission was once granted")
    scrambled = " ".join(sorted(mit.text.split()))
    for text in (broken, scrambled):
        rows = licenses.scan(frame([(1, text)]), "text").collect()
        assert not [m for m in rows[0].licenses.matches if m.rule == "notice"]


def test_key_phrases_of_the_next_document_do_not_count(spark):
    isc = licenses.NOTICES[1]
    cut = isc.text[: isc.text.index("with or without fee")]
    after = isc.text[isc.text.index("provided that") :]
    rest = f"with or without fee is hereby granted, {after}"
    # Enough indexed words stand in the first text, the key phrase at the start of the second.
    first = f"{cut} provided that above copyright notice appear copies"
    df = spark.createDataFrame([(1, first), (2, rest)], "doc_id bigint, text string").coalesce(1)
    rows = {r.doc_id: [m.label for m in r.licenses.matches if m.rule == "notice"] for r in licenses.scan(df, "text", notices=(isc,)).collect()}
    assert rows[1] == []


def test_anchors_stand_in_the_corpus():
    bsd = next(n for n in licenses.NOTICES if n.label == "bsd")
    words = [int(w) for w in licenses._hashes(bsd.text)]
    gone = {int(licenses._hashes(w)[0]) for w in ("without", "modification", "permitted", "provided", "must", "retain")}
    assert gone < set(words)
    index = licenses.build_index(2, {w: int(w not in gone) for w in words}, {}, (bsd,))
    anchors = {int(w) for w, postings in zip(index.words, index.notice_postings, strict=True) if postings}
    assert len(anchors) == licenses.ANCHORS and not anchors & gone


def test_two_copies_are_two_matches(frame):
    text = licenses.NOTICES[0].text
    rows = licenses.scan(frame([(1, f"{text} between {text}")]), "text").collect()
    assert [m.label for m in rows[0].licenses.matches if m.rule == "notice"] == ["mit", "mit"]


def test_no_rows(spark):
    assert licenses.scan(spark.createDataFrame([], "text string"), "text").collect() == []
