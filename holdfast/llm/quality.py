"""Quality rules as a short-circuit cascade.

Each rule rejects a document when its condition over derived columns holds. On a bounded sample the cascade
estimates the time of each feature and which rows each rule rejects, and orders the rules by rejection per cost; a CASE evaluates them in that order and leaves out what a rejected document no longer needs.
The order changes the cost and which rule is named first, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import free_name

#: Documents that the estimates look at, at most, and the longest of them; only the order of the rules depends on them.
SAMPLE_ROWS, SAMPLE_BYTES = 200, 100_000

#: How often the sample is repeated for timing, at most, and characters that the repeated sample has, about.
SAMPLE_COPIES, SAMPLE_WORK = 10, 1_000_000

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words between white space; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column, symbols: str = SYMBOLS) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, symbols, ""))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of ``size`` words that are found twice or more, the first time included.

    Windows are compared by 64-bit hash. Only texts in which some window repeats sort them: equal hashes
    are then neighbours, and the repeated windows in order of place cover ``size`` words each, less what the
    next one covers itself.
    """

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(pairs: Column) -> Column:
            n = F.size(pairs)
            same = lambda k: F.when((k >= 0) & (k < n), F.get(pairs, k)["h"])
            kept = F.transform(
                pairs,
                lambda p, k: F.when(p["h"].eqNullSafe(same(k - 1)) | p["h"].eqNullSafe(same(k + 1)), p["i"]),
            )
            return F.sort_array(F.array_compact(kept))

        return _let(ordered, repeated)

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        spans = F.transform(places, lambda p, k: F.when(k == last, F.lit(size)).otherwise(F.least(F.lit(size), F.get(places, k + 1) - p)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)

    def count(ws: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(*(F.get(ws, i + k) for k in range(size)))
        )
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(starts(h), covered)))

    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(_let(words, count))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects`` of the named features holds."""

    name: str
    features: tuple[str, ...]
    rejects: Callable[..., Column]


#: Production rules. The first two are the base verdict; the others are set wide, as clean texts must pass.
RULES = (
    Rule("short", ("n_words",), lambda n: n < 50),
    Rule("repetitive", ("n_words", "n_repeat_words"), lambda n, repeated: 100 * repeated > 50 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, chars: (chars < 2 * n) | (chars > 30 * n)),
    Rule("duplicate_lines", ("n_words", "n_dup_lines"), lambda n, lines: 4 * lines > n),
)


def features_of(text: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(words),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": repeated_words(words),
    }


def _condition(rule: Rule, features: dict[str, Column]) -> Column:
    return rule.rejects(*(features[name] for name in rule.features))


def sample_texts(df: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most ``rows`` texts from all over the table: those of least hash of their place, so copies do not come together.

    The hash is cut off by the number of rows first, so the driver sees about three times ``rows`` texts at any size.
    """
    few = min(1.0, 3 * rows / max(df.count(), 1))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 53))
    drawn = df.select(F.col(text).alias("text"), place.alias("draw")).where(F.col("draw") <= int(few * (1 << 53)))
    short = drawn.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    return [row["text"] for row in short.orderBy("draw").limit(rows).select("text").collect()]


def feature_costs(sample: DataFrame, features: dict[str, Column], copies: int) -> dict[str, float]:
    """Seconds that each feature takes for one pass over a sample with the columns ``text`` and ``words``.

    One job reads the clock before and after each feature of each row, so what a job costs whatever its rows is not in it. The
    sample is gone through ``copies`` times, in a job like one that ran just before.
    """
    clock = F.expr("cast(reflect('java.lang.System', 'nanoTime') as bigint)")
    repeated = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    timed = repeated.select(*(F.array(clock, value, clock).alias(name) for name, value in features.items()))
    # The value is summed as well, so that it has to be computed.
    sums = timed.agg(*(F.struct(F.sum(F.get(n, F.lit(2)) - F.get(n, F.lit(0))), F.sum(F.get(n, F.lit(1)))).alias(n) for n in features))
    for _ in range(2):
        found = sums.first()
    return {name: max((found[name][0] or 0) / copies / 1e9, 1e-9) for name in features}


def rule_order(df: DataFrame, text: str, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by what each rejects per second of the documents that the rules before it leave of a sample.

    Rules equal in that, as are all once no document is left, go by what they reject of the whole sample. A rule pays for those of its features that no rule before it has paid for. An empty table keeps the given order.
    Estimates only order the rules, so they need not repeat exactly.
    """
    texts = sample_texts(df, text, sample_rows)
    if not texts:
        return list(rules)
    spark = df.sparkSession
    drawn = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).withColumn("words", words_of(F.col("text")))
    # Words are kept as a column, so that no feature is charged for splitting the text again.
    drawn = drawn.select("text", F.when(F.rand() >= 0, F.col("words")).alias("words"))
    features = features_of(F.col("text"), F.col("words"))
    size = sum(len(t or "") for t in texts) + 1
    costs = feature_costs(drawn, features, max(1, min(SAMPLE_COPIES, SAMPLE_WORK // size)))
    verdicts = drawn.select(*(_condition(rule, features).alias(rule.name) for rule in rules)).collect()
    every = left = [row.asDict() for row in verdicts]
    paid, ordered = set(), []
    while len(ordered) < len(rules):

        def value(rule: Rule) -> tuple[float, float]:
            cost = max(sum(costs[name] for name in set(rule.features) - paid), 1e-9)
            return sum(bool(row[rule.name]) for row in left) / cost, sum(bool(row[rule.name]) for row in every) / cost

        best = max((rule for rule in rules if rule not in ordered), key=value)
        ordered.append(best)
        paid.update(best.features)
        left = [row for row in left if not row[best.name]]
    return ordered


def rejected_by(ordered: Sequence[Rule], features: dict[str, Column]) -> Column:
    """The first rule in order that rejects, or null; the features of later rules are then not computed."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        verdict = F.when(_condition(rule, features), F.lit(rule.name)).otherwise(verdict)
    return verdict


def quality_features(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "quality") -> DataFrame:
    """The frame with a struct ``out``: every feature, and ``rejected_by``, null where a document is kept.

    Null texts count as empty and are rejected as short. Every row stays, repeated ones included; the other columns
    are left alone, and one called ``out`` is replaced.
    """
    work = free_name(df, f"{out}_words")
    ordered = rule_order(df, text, rules)
    features = features_of(F.col(text), F.col(work))
    measured = df.withColumn(work, words_of(F.col(text))).withColumn(out, F.struct(*(c.alias(n) for n, c in features.items())))
    return measured.withColumn(
        out, F.col(out).withField("rejected_by", rejected_by(ordered, {n: F.col(f"{out}.{n}") for n in features}))
    ).drop(work)


def filter_quality(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects. A rejected one costs only the rules up to the one that rejects it."""
    ordered = rule_order(df, text, rules)
    # A filter over a column of words would be pushed below it, and split the text for every rule.
    verdict = _let(words_of(F.col(text)), lambda words: rejected_by(ordered, features_of(F.col(text), words)))
    return df.where(verdict.isNull())


_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), windows AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), repeated AS (
  SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
    OR word_chars < 2 * n_words OR word_chars > 30 * n_words OR 4 * n_dup_lines > n_words) AS kept
FROM f
"""


@query("op8_quality_rules", _SQL)
def op8(spark, sf_dir):
    measured = quality_features(documents(spark, sf_dir))
    base = [_condition(rule, {n: F.col(f"quality.{n}") for n in rule.features}) for rule in RULES[:2]]
    return measured.select(
        "doc_id",
        *(f"quality.{n}" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        (base[0] | base[1]).alias("base_failed"),
        F.isnull("quality.rejected_by").alias("kept"),
    )
