import random
import re
from collections import Counter

import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from holdfast.llm import phrases
from holdfast.llm.phrases import collocations, frequent_phrases, mine_phrases, slots_for, top_phrases
from holdfast.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(rows, longest=4):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    return counts, totals


def brute(rows, most, threshold):
    counts, totals = grams(rows)
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < threshold:
            continue
        cuts = [(2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        found[lang, words] = (a, counts[lang, words[:k]], counts[lang, words[k:]], totals[lang], score)
    absorbed = {
        (lang, longer[i : i + size])
        for (lang, longer), value in found.items()
        for size in range(2, len(longer))
        for i in range(len(longer) - size + 1)
        if 100 * value[0] >= 80 * found[lang, longer[i : i + size]][0]
    }
    out = []
    for lang in totals:
        left = [(words, v) for (x, words), v in found.items() if x == lang and (x, words) not in absorbed]
        left.sort(key=lambda row: (-row[1][4], -row[1][0], " ".join(row[0]).encode()))
        out += [(lang, rank, " ".join(words), *v) for rank, (words, v) in enumerate(left[:most], 1)]
    return sorted(out)


def mined(spark, rows, most=2000, threshold=30, shards=3):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, text string, phrase string, shard int, n int").repartition(4)
    return sorted(tuple(r) for r in mine_phrases(docs, most=most, threshold=threshold, shards=shards).collect())


def texts(seed, n=300):
    rng = random.Random(seed)
    pool = ["the", "The", "of", "en", "de", "é", "İ", "x-y", "a b", "\0", "long" * 30] + [f"w{i}" for i in range(12)]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", "; ", " ! "]
    rows = []
    for _ in range(n):
        words = rng.choices(pool, weights=[20, 5, 12, 9, 9] + [2] * 18, k=rng.choice([0, 1, 2, 9, 25]))
        rows.append((rng.choice(["en", "en", "de", None, ""]), "".join(w + rng.choice(gaps) for w in words)))
    return rows + [(None, None), ("en", ""), ("en", " \t.\n")] + [("hot", "the same text of many rows, the same text")] * 40


@pytest.mark.parametrize(("seed", "threshold", "shards", "most"), [(1, 30, 3, 2000), (2, 5, 2, 7), (3, 1, 1, 2000)])
def test_equals_counting_everything(spark, seed, threshold, shards, most):
    rows = texts(seed)
    assert mined(spark, rows, most, threshold, shards) == brute(rows, most, threshold)


def test_odd_texts(spark):
    rows = [("en", text) for _, text in ODD] * 8
    assert mined(spark, rows) == brute(rows, 2000, 30)


def test_a_table_of_one_slot_changes_no_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "slots_for", lambda size: 1)
    rows = texts(4, 80)
    scratch = Scratch(spark)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got, totals = frequent_phrases(docs, F.coalesce("lang", F.lit("und")), F.col("text"), scratch, 9)
    counts, words = grams(rows)
    assert {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in got.collect()} == {k: n for k, n in counts.items() if n >= 9}
    assert {r["lang"]: r["total"] for r in totals.collect()} == {k: n for k, n in words.items() if n}


@pytest.mark.parametrize("rows", [[], [("en", None)], [(None, "once only")]])
def test_nothing_frequent(spark, rows):
    assert mined(spark, rows) == []


def test_late_phrases_are_counted_for_a_whole_cycle(spark):
    """A phrase whose words reach the threshold in the last shard of the first cycle occurs before that too."""
    rows = [("en", "far away")] * 10 + [("en", "far")] * 25 + [("en", "away")] * 25
    assert mined(spark, rows, threshold=10, shards=5) == brute(rows, 2000, 10)


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000 // 3
    frequent = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 1), ("en", "a b", 2, big), ("en", "b a", 2, 31)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, total long")
    rows = top_phrases(collocations(frequent, totals), 5).orderBy("rank").collect()
    assert [(r["phrase"], r["score"]) for r in rows] == [("a b", 2_000_000 * big // (2 * big + 8)), ("b a", 0)]


def test_slots_follow_the_text():
    assert slots_for(0) == 1 << 20
    assert slots_for(1 << 30) == 1 << 24
    assert slots_for(1 << 40) == 1 << 26
