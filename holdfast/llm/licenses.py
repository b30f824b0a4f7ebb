"""Licence scans with a positional index of rare licence words.

Notices and phrases are sequences of words. The document frequency of every word in them is counted over the corpus;
each notice is indexed under its highest-IDF words, each phrase under its highest one, with their positions. A file
is looked up by the indexed words that it holds: a word at place j that stands at place p of a notice votes for a
copy that starts at j - p. Phrases are compared word by word at the starts voted for. A notice needs most of its
indexed words at about one start, and all of its key phrases inside; the matched share of their IDF is its score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.llm.registry import documents, query
from holdfast.llm.words import ALNUM, Words, find_words, hash_words, slices, texts_of


@dataclass(frozen=True)
class Notice:
    """A licence text; a copy must hold each of ``keys`` in full."""

    label: str
    text: str
    keys: tuple[str, ...]


#: The phrases of the base scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Phrases that name a licence.
PHRASES = BASE_PHRASES | {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "spdx license identifier": "spdx",
}

#: Notices as their licences word them.
NOTICES = (
    Notice(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        " (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,"
        " publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Notice(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee is hereby granted",),
    ),
    Notice(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may"
        " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express"
        " or implied.",
        ("apache license", "except in compliance with the license"),
    ),
    Notice(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        ("redistribution and use in source and binary forms",),
    ),
    Notice(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "free software foundation"),
    ),
    Notice(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license",),
    ),
    Notice(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or"
        " distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial",
        ("unencumbered software released into the public domain",),
    ),
    Notice(
        "cc-by",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"
        " http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons",
        ("creative commons attribution",),
    ),
)

#: Words of a notice that are indexed, the share of them that must agree on a start, and how far starts may differ.
ANCHORS, AGREE, SLACK = 8, 0.6, 6


def _hashes(text: str) -> np.ndarray:
    return hash_words(find_words(texts_of(pa.array([text])).lower(), ALNUM))


@dataclass(frozen=True)
class Index:
    """Postings of the indexed words, by hash: which phrase or notice, and the word's place in it."""

    words: np.ndarray
    phrase_postings: tuple[tuple[tuple[int, int], ...], ...]
    notice_postings: tuple[tuple[tuple[int, int, int], ...], ...]
    phrases: tuple[tuple[str, str, np.ndarray], ...]
    notices: tuple[tuple[str, int, tuple[int, ...], tuple[float, ...]], ...]


def document_frequencies(df: DataFrame, text: str, phrases: dict[str, str], notices: Sequence[Notice]) -> tuple[int, dict[int, int]]:
    """The number of documents, and per hash of a licence word how many documents hold it."""
    vocabulary = np.unique(np.concatenate([_hashes(t) for t in [*phrases, *(n.text for n in notices), *(k for n in notices for k in n.keys)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(vocabulary), dtype=np.int64), 0
        for _, texts in slices(batches, text):
            words = find_words(texts.lower(), ALNUM)
            place, number = _known(hash_words(words), vocabulary)
            of_text = np.searchsorted(words.offsets, place, side="right") - 1
            pairs = np.unique(of_text * len(vocabulary) + number)
            counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
            rows += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary, 0).view(np.int64)), pa.array(np.append(counts, rows))], names=["word", "n"])

    # One row per licence word.
    summed = df.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {row["word"] & 0xFFFFFFFFFFFFFFFF: row["n"] for row in summed}
    return found.pop(0, 0), found


def _known(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose hash is wanted, and its number among the wanted ones, which are in order."""
    few = np.zeros(1 << 16, dtype=bool)
    few[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
    place = np.flatnonzero(few[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    number = np.minimum(np.searchsorted(wanted, hashes[place]), len(wanted) - 1)
    same = wanted[number] == hashes[place]
    return place[same], number[same]


def build_index(total: int, frequency: dict[int, int], phrases: dict[str, str], notices: Sequence[Notice], anchors: int = ANCHORS) -> Index:
    def idf(word: int) -> float:
        return math.log((total + 1) / (frequency.get(word, 0) + 0.5))

    listed = [(name, label, _hashes(name)) for name, label in phrases.items()]
    listed += [(key, "", _hashes(key)) for n in notices for key in n.keys if key not in phrases]
    number = {name: i for i, (name, _, _) in enumerate(listed)}
    phrase_at: dict[int, list[tuple[int, int]]] = {}
    notice_at: dict[int, list[tuple[int, int, int]]] = {}
    for i, (_, _, words) in enumerate(listed):
        place = max(range(len(words)), key=lambda p: (idf(int(words[p])), -p))
        phrase_at.setdefault(int(words[place]), []).append((i, place))
    kept = []
    for i, notice in enumerate(notices):
        words = [int(w) for w in _hashes(notice.text)]
        # Only words that stand once in the notice tell where it starts, and those that stand in no document find no copy.
        single = sorted((w for w in set(words) if words.count(w) == 1), key=lambda w: (not frequency.get(w, 0), -idf(w), words.index(w)))[:anchors]
        for k, w in enumerate(single):
            notice_at.setdefault(w, []).append((i, k, words.index(w)))
        kept.append((notice.label, len(words), tuple(number[key] for key in notice.keys), tuple(max(idf(w), 1e-6) for w in single)))
    words = np.unique(np.array([*phrase_at, *notice_at], dtype=np.uint64))
    return Index(
        words,
        tuple(tuple(phrase_at.get(int(w), ())) for w in words),
        tuple(tuple(notice_at.get(int(w), ())) for w in words),
        tuple(listed),
        tuple(kept),
    )


def _phrase_places(index: Index, words: Words, hashes: np.ndarray, place: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """Per phrase the places where its words stand one after the other in one text."""
    last = np.repeat(words.offsets[1:], words.counts())
    first = np.repeat(words.offsets[:-1], words.counts())
    found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(index.phrases)
    for w, postings in enumerate(index.phrase_postings):
        at = place[number == w]
        for phrase, offset in postings:
            wanted = index.phrases[phrase][2]
            start = at - offset
            start = start[(start >= first[at]) & (start + len(wanted) <= last[at])]
            for k, word in enumerate(wanted):
                start = start[hashes[start + k] == word]
            found[phrase] = start
    return found


def _notice_matches(index: Index, words: Words, place: np.ndarray, number: np.ndarray, phrases: list[np.ndarray]) -> list[tuple[int, str, int, int, float]]:
    """Copies of notices: text, label, first place, length and score."""
    votes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for w, postings in enumerate(index.notice_postings):
        at = place[number == w]
        for notice, anchor, offset in postings:
            votes.setdefault(notice, []).append((at, np.stack([at - offset, np.full(len(at), anchor)], axis=1)))
    matches = []
    for notice, cast in votes.items():
        label, length, keys, weights = index.notices[notice]
        need, slack = max(2, math.ceil(AGREE * len(weights))), SLACK + length // 10
        at = np.concatenate([a for a, _ in cast])
        starts = np.concatenate([v for _, v in cast])
        of_text = np.searchsorted(words.offsets, at, side="right") - 1
        order = np.lexsort((starts[:, 0], of_text))
        of_text, starts = of_text[order], starts[order]
        busy, begin, size = np.unique(of_text, return_index=True, return_counts=True)
        for text, low, n in zip(busy.tolist(), begin.tolist(), size.tolist(), strict=True):
            if n < need:
                continue
            own = starts[low : low + n].tolist()
            at = 0
            while at < n:
                begin, after = own[at][0], at
                anchors = set()
                while after < n and own[after][0] <= begin + slack:
                    anchors.add(own[after][1])
                    after += 1
                end = own[after - 1][0] + length + slack
                # A key phrase counts only where it stands in the same text.
                least, most = max(begin - slack, int(words.offsets[text])), min(end, int(words.offsets[text + 1]))
                inside = (np.searchsorted(phrases[k], least) < np.searchsorted(phrases[k], most) for k in keys)
                if len(anchors) < need or not all(inside):
                    at += 1
                    continue
                first = max(begin, int(words.offsets[text]))
                score = sum(weights[a] for a in anchors) / sum(weights)
                matches.append((text, label, first, min(length, int(words.offsets[text + 1]) - first), score))
                at = after
    return matches


MATCH = "struct<n_words: bigint, matches: array<struct<rule: string, label: string, first_word: bigint, words: bigint, score: double>>>"


def scan(
    df: DataFrame, text: str, phrases: dict[str, str] = PHRASES, notices: Sequence[Notice] = NOTICES, out: str = "licenses"
) -> DataFrame:
    """The frame with a struct ``out``: ``n_words``, and ``matches`` in order of place.

    A match is a phrase, with the phrase as ``rule`` and score 1, or a copy of a notice, with ``rule`` "notice". Null and
    empty texts have no words and no matches. Every row stays; a column already called ``out`` is replaced. The frame
    is read twice, first for the document frequencies.
    """
    df = df.drop(out)
    total, frequency = document_frequencies(df, text, phrases, notices)
    index = build_index(total, frequency, phrases, notices)
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{out}` {MATCH}").fields])
    fields = [("rule", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]
    kind = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(pa.struct(fields)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            words = find_words(texts.lower(), ALNUM)
            hashes = hash_words(words)
            place, number = _known(hashes, index.words)
            places = _phrase_places(index, words, hashes, place, number)
            found: list[list[tuple]] = [[] for _ in range(len(texts))]
            for (name, label, wanted), at in zip(index.phrases, places, strict=True):
                if not label:
                    continue
                for i, p in zip((np.searchsorted(words.offsets, at, side="right") - 1).tolist(), at.tolist(), strict=True):
                    found[i].append((p - int(words.offsets[i]), name, label, len(wanted), 1.0))
            for i, label, p, length, value in _notice_matches(index, words, place, number, places):
                found[i].append((p - int(words.offsets[i]), "notice", label, length, value))
            rows = [
                {"n_words": n, "matches": [{"rule": r, "label": lab, "first_word": p, "words": w, "score": s} for p, r, lab, w, s in sorted(own)]}
                for n, own in zip(words.counts().tolist(), found, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


@query("op1_license_scan")
def op1(spark, sf_dir):
    scanned = scan(documents(spark, sf_dir), "text")
    matches = F.col("licenses.matches")
    base = F.filter(matches, lambda m: m["rule"].isin(*BASE_PHRASES))
    places = F.transform(base, lambda m: m["first_word"])
    return scanned.select(
        "doc_id",
        "licenses.n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        _joined(F.transform(base, lambda m: m["label"])).alias("base_labels"),
        _joined(F.transform(matches, lambda m: m["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform(matches, lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
