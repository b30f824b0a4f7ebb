"""URL filters: listed rules, and association rules mined from the urls that the lists decide.

FP-growth finds the token combinations of labelled urls that are frequent; those that go with one label confidently,
and not merely as well as a shorter combination does, become rules. Rules are held in an inverted index under their
rarest token, so a url meets only the rules that one of its own tokens names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal
from itertools import product
from math import ceil

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from holdfast.llm.registry import query
from holdfast.llm.scratch import Scratch, free_name

#: Share of the labelled urls that a combination must occur in together with its label, and share of a
#: combination's labelled urls that must have that label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Listed:
    """Decides the urls of a host and its subdomains whose path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Learned:
    """Urls that have all ``tokens`` are likely to get ``verdict``."""

    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int


#: The lists of the registered query.
LISTED = (
    Listed("net", "/", "block"),
    Listed("example.net", "/en/", "allow"),
    Listed("example.com", "/de/", "block"),
    Listed("org", "/fr/", "allow"),
)


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?`` or ``#``, A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: Sequence[Listed] = LISTED) -> Column:
    """A struct of the longest rule's ``name`` and ``verdict``, null where none fits."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda rule: (len(rule.name), rule.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels by place from the right, path segments with ``#`` for numbers, the key the query opens with.

    Urls without a host have no tokens.
    """
    host, path = host_of(url), path_of(url)
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")
    key = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^=&#]+)", 1)
    numbered = lambda kind: lambda value, i: F.concat(F.lit(kind), (i + 1).cast("string"), F.lit(":"), value)
    tokens = F.concat(F.transform(labels, numbered("host")), F.transform(segments, numbered("path")), F.filter(F.array(F.concat(F.lit("query:"), key)), lambda t: t != "query:"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def whole_tokens(url: Column) -> Column:
    """The tokens of a url and one for every further key of its query."""
    asked = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(asked, "&"), lambda pair: F.substring_index(pair, "=", 1)), lambda key: key != "")
    further = F.transform(keys, lambda key: F.concat(F.lit("query:"), key))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_union(url_tokens(url), further))


def frequent_tokens(rows: DataFrame, tokens: str, label: str, least: int) -> list[Row]:
    """``token``, ``n``, its greatest number of rows of one ``verdict``, and a sum over hashes of its rows' tokens, of tokens in ``least`` rows.

    Tokens of equal ``n`` and sum stand in the same rows. There are at most tokens of a mean row / support of them.
    """
    each = rows.select(F.explode(tokens).alias("token"), F.col(label).alias("verdict"), F.xxhash64(tokens).cast("decimal(20,0)").alias("hash"))
    by_label = each.groupBy("token", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("hash").alias("hashes"))
    greatest = F.max(F.struct("n", "verdict"))
    counted = by_label.groupBy("token").agg(F.sum("n").alias("n"), F.sum("hashes").alias("hashes"), greatest.alias("greatest"))
    return counted.where(F.col("n") >= least).select("token", "n", "hashes", F.col("greatest.n").alias("same"), "greatest.verdict").collect()


def _renamed(tokens: Column, names: Mapping[str, str]) -> Column:
    """The tokens that have a name, as distinct names."""

    @F.pandas_udf("array<string>")
    def rename(column: pd.Series) -> pd.Series:
        return pd.Series([sorted({names[t] for t in row if t in names}) for row in column], dtype=object)

    return rename(tokens)


def mine(df: DataFrame, tokens: str, label: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[Learned]:
    """Association rules from token combinations to labels, best first: by confidence, support, fewer tokens, spelling.

    Rows whose label or tokens are null teach nothing. A rule is left out where some of its tokens alone give
    the same verdict as confidently. So a token that stands with one label only is a rule by itself and takes part in no
    other, and tokens that stand in the same rows are mined as one and spelled out afterwards: long hosts and paths
    cost FP-growth no more than the tokens that tell rows apart. The rules come to the driver: their number depends on
    those tokens and the support, not on the number of rows. Without labelled rows there are none.
    """
    scratch = Scratch(df.sparkSession)
    mark = "label="
    rows = df.where(F.col(label).isNotNull() & F.col(tokens).isNotNull())
    least = max(1, ceil(min_support * rows.count()))
    frequent = frequent_tokens(rows, tokens, label, least)
    pure = [Learned((r["token"],), r["verdict"], 1.0, r["n"]) for r in frequent if r["same"] == r["n"]]
    classes: dict[tuple[int, Decimal], list[str]] = {}
    for r in frequent:
        if r["same"] < r["n"]:
            classes.setdefault((r["n"], r["hashes"]), []).append(r["token"])
    members = {min(own): sorted(own) for own in classes.values()}
    names = {token: name for name, own in members.items() for token in own}
    items = rows.select(F.concat(_renamed(F.col(tokens), names), F.array(F.concat(F.lit(mark), F.col(label)))).alias("items"))
    frequent = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(items).freqItemsets
    sets = scratch.store(
        frequent.select(
            F.sort_array(F.filter("items", lambda t: ~t.startswith(mark))).alias("tokens"),
            F.filter("items", lambda t: t.startswith(mark)).alias("label"),
            "freq",
        ),
        "itemsets",
    )
    alone = sets.where(F.size("label") == 0).select("tokens", F.col("freq").alias("n"))
    labelled = sets.where((F.size("label") == 1) & (F.size("tokens") > 0))
    rules = scratch.store(
        labelled.join(alone, "tokens")
        .select("tokens", F.substring(F.col("label")[0], len(mark) + 1, 1 << 20).alias("verdict"), "freq", (F.col("freq") / F.col("n")).alias("confidence"))
        .where(F.col("confidence") >= min_confidence),
        "rules",
    )
    n = F.size("tokens")
    parts = F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 2), lambda m: F.filter("tokens", lambda t, i: F.getbit(m, i) == 1))
    shorter = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("as_sure"))
    longer = rules.where(n > 1).select("tokens", "verdict", "confidence", F.explode(parts).alias("part"))
    redundant = longer.join(shorter, ["part", "verdict"]).where("as_sure >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(redundant, ["tokens", "verdict"], "left_anti").collect()
    scratch.clear()
    spelled = ((r, some) for r in kept for some in product(*(members[name] for name in r["tokens"])))
    found = pure + [Learned(tuple(sorted(some)), r["verdict"], r["confidence"], r["freq"]) for r, some in spelled]
    return sorted(found, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))


def inverted_index(rules: Sequence[Learned]) -> dict[str, list[tuple[int, frozenset[str]]]]:
    """Per token the numbers and tokens of the rules that stand under it: those for which it is in the fewest rules."""
    uses: dict[str, int] = {}
    for rule in rules:
        for token in rule.tokens:
            uses[token] = uses.get(token, 0) + 1
    index: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for number, rule in enumerate(rules):
        index.setdefault(min(rule.tokens, key=lambda t: (uses[t], t)), []).append((number, frozenset(rule.tokens)))
    return index


def learned_verdict(tokens: Column, rules: Sequence[Learned]) -> Column:
    """The verdict of the first rule whose tokens are all there, null where there is none."""
    index, verdicts = inverted_index(rules), [rule.verdict for rule in rules]

    def first(mine: frozenset[str]) -> str | None:
        best = min((number for token in mine for number, needs in index.get(token, ()) if needs <= mine), default=None)
        return None if best is None else verdicts[best]

    @F.pandas_udf("string")
    def judge(column: pd.Series) -> pd.Series:
        known: dict[frozenset[str], str | None] = {}
        out = []
        for row in column:
            mine = frozenset(row) if row is not None else frozenset()
            if mine not in known:
                known[mine] = first(mine)
            out.append(known[mine])
        return pd.Series(out, dtype=object)

    return judge(tokens)


def judge_urls(df: DataFrame, url: str, rules: Sequence[Listed] = LISTED, default: str = "allow", out: str = "judged") -> DataFrame:
    """The frame with a struct ``out`` of ``host``, ``path``, ``rule``, ``learned`` and ``verdict``.

    The lists decide where one fits; the urls that they decide are the labels from which rules are mined for the
    others, and ``default`` stands where no rule of either kind fits. Null urls, and those without ``://``, have empty
    host and path, and get the default. Every row stays; a column called ``out`` is replaced.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    listed = listed_rule(host, path, rules)
    labelled = df.select(whole_tokens(F.col(url)).alias("tokens"), listed["verdict"].alias("label"))
    learned_rules = mine(labelled, "tokens", "label")
    learned = free_name(df, "learned")
    return df.withColumn(learned, learned_verdict(whole_tokens(F.col(url)), learned_rules)).withColumn(
        out,
        F.struct(
            host.alias("host"),
            path.alias("path"),
            listed["name"].alias("rule"),
            F.col(learned).alias("learned"),
            F.coalesce(listed["verdict"], F.col(learned), F.lit(default)).alias("verdict"),
        ),
    ).drop(learned)


@query("op12_url_filter")
def op12(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, "url")
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.learned")
