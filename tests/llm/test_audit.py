import itertools
import random
import re

import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from holdfast.llm.audit import FIELDS, interactions, label_flags, mask_counts, text_failures, unpack, wide_integer


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def failed(rows, row):
    """The letters of the filters that a row fails, in plain Python."""
    key, text = row[0], row[1] or ""
    ws = words(text)
    checks = {
        "A": len(ws) < 50,
        "B": 100 * len(set(ws)) < 65 * len(ws),
        "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, *_ in rows),
    }
    return {letter for letter, fails in checks.items() if fails}


def brute(rows, labels):
    flags = {k: (any(q == 1 for x, q, _ in labels if x == k), any(t == 1 for x, _, t in labels if x == k)) for k, _, _ in labels if k is not None}
    out, shapley = {}, {}
    masks = [(row[2] or "", failed(rows, row), *flags.get(row[0], (False, False))) for row in rows]
    for part in {m[0] for m in masks}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            everyone = list(left)
            for step, letter in enumerate(order, 1):
                here = [m for m in left if letter in m[1]]
                left = [m for m in left if letter not in m[1]]
                earlier = sum(letter in m[1] and bool(m[1] & set(order[: step - 1])) for m in everyone)
                alone = sum(m[1] == {letter} for m in everyone)
                out[part, order, step] = [len(left), len(here), earlier, alone, sum(m[2] for m in here), sum(m[3] for m in here)]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit(spark, docs, labels):
    flags = label_flags(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    part = F.coalesce(F.col("source"), F.lit(""))
    found = interactions(mask_counts(docs, "doc_id", part, "text", text_failures(F.col("text")), flags), "ABCDE")
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = found.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in rows}


def cases():
    rng = random.Random(7)
    pool = ["ab", "CD", "e#", "f", "g", "Éa", "x|y"] + [f"w{i}" for i in range(60)]
    rows = [(k, t, rng.choice(["s", "t", None])) for k, t in ODD]
    rows += [(rng.randrange(40), " ".join(rng.choices(pool, k=rng.choice([3, 49, 50, 70, 90]))), rng.choice(["s", "", None])) for _ in range(60)]
    rows += [(rng.choice([None, *range(90)]), "copied text", rng.choice(["s", "hot"])) for _ in range(50)]
    labels = [(rng.choice([None, *range(50)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    return rows, labels


def test_equals_the_filters_run_one_after_another_in_every_order(spark):
    rows, labels = cases()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, part string, mask int").repartition(5)
    assert audit(spark, docs, labels) == brute(rows, labels)


def test_an_empty_table_has_no_parts(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert audit(spark, docs, [(1, 1, 1)]) == {}


def test_no_label_rows(spark):
    rows = [(1, None, None), (2, "", "s")]
    assert audit(spark, spark.createDataFrame(rows, "doc_id bigint, text string, source string"), []) == brute(rows, [])


@pytest.mark.parametrize("n", [1, 2**32, 2**63 - 1])
def test_fields_hold_any_number_of_documents(n):
    once, many = unpack(wide_integer(0b10110, 5), 5), unpack(n * wide_integer(0b10110, 5), 5)
    assert many.shape == (120, 5, len(FIELDS))
    assert (many == once * n).all()
