import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from holdfast.llm.urls import LISTED, Learned, host_of, inverted_index, judge_urls, learned_verdict, listed_rule, mine, path_of, url_tokens, whole_tokens

SOME = [
    "http://a.example.net/en/1",
    "http://EXAMPLE.net/en",
    "https://m.x.example.com/de/77.html?page=2&ref=x",
    "http://example.org/fr/#top",
    "http://org?q=1",
    "net://net/",
    "http://badexample.net/en/",
    "http://a.b.c.d.e.org/fr/é/Ü",
    "no scheme/en/",
    "://?",
    "",
    None,
    "http://two://example.net/en/x\n/y?z",
    "http://\n.net/\n",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = [r for r in LISTED if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def test_host_path_and_listed_rule(spark):
    listed = listed_rule(F.col("host"), F.col("path"))
    df = spark.createDataFrame([(u,) for u in SOME], "url string").select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    for row in df.select("*", listed["name"].alias("rule"), listed["verdict"].alias("verdict")).collect():
        host, path = split(row["url"])
        rule = rule_of(host, path)
        assert (row["host"], row["path"]) == (host, path)
        assert (row["rule"], row["verdict"]) == ((rule.name, rule.verdict) if rule else (None, None))


def test_tokens(spark):
    df = spark.createDataFrame([(SOME[2],), (SOME[11],), ("http://h",)], "url string")
    found = [r[0] for r in df.select(url_tokens(F.col("url"))).collect()]
    assert found[0] == ["host1:com", "host2:example", "host3:x", "host4:m", "path1:de", "path2:#.html", "query:page"]
    assert found[1:] == [[], ["host1:h"]]


def brute(rows, support, confidence):
    """All rules by counting every combination, in plain Python."""
    rows = [(frozenset(t), label) for t, label in rows if label is not None and t is not None]
    sure = {}
    for some in {some for t, _ in rows for k in range(1, len(t) + 1) for some in itertools.combinations(sorted(t), k)}:
        having = [label for t, label in rows if t.issuperset(some)]
        for verdict in set(having):
            n = having.count(verdict)
            if n >= support * len(rows) and n / len(having) >= confidence:
                sure[some, verdict] = (n / len(having), n)
    kept = {
        (some, verdict): v
        for (some, verdict), v in sure.items()
        if not any(sure.get((part, verdict), (-1,))[0] >= v[0] for k in range(1, len(some)) for part in itertools.combinations(some, k))
    }
    found = [Learned(some, verdict, c, n) for (some, verdict), (c, n) in kept.items()]
    return sorted(found, key=lambda r: (-r.confidence, -r.support, len(r.tokens), r.tokens, r.verdict))


@pytest.mark.parametrize("support", [0.02, 0.2])
def test_rules_equal_counting_all_combinations(spark, support):
    rng = random.Random(int(support * 100))
    rows = [(rng.sample("abcdefg", rng.randrange(0, 5)), rng.choice(["block", "allow", "allow", None])) for _ in range(150)]
    rows += [(None, "allow"), (["a", "b"], "block")] + [(["a", "c"], "block")] * 30
    df = spark.createDataFrame(rows, "tokens array<string>, label string").repartition(4)
    assert mine(df, "tokens", "label", support, 0.6) == brute(rows, support, 0.6)


def test_the_index_gives_the_first_rule_that_fits(spark):
    rng = random.Random(3)
    rules = [Learned(tuple(sorted(rng.sample("abcdefgh", rng.randrange(1, 4)))), rng.choice(["block", "allow"]), 1.0, 1) for _ in range(25)]
    assert sum(len(v) for v in inverted_index(rules).values()) == len(rules)
    sets = [rng.sample("abcdefgh", rng.randrange(0, 7)) for _ in range(80)] + [None]
    df = spark.createDataFrame([(s,) for s in sets], "tokens array<string>")
    found = [r[0] for r in df.select(learned_verdict(F.col("tokens"), rules)).collect()]
    assert found == [next((r.verdict for r in rules if set(r.tokens) <= set(s or ())), None) for s in sets]


def test_judged_urls(spark):
    rng = random.Random(5)
    rows = [(k, f"http://{rng.choice(['a', 'spam'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr'])}/{k}") for k in range(400)]
    rows += [(None, u) for u in SOME] + rows[:3]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, learned string, tokens string").repartition(3)
    labels = [(([t for t in tokens] or []), rule.verdict) for tokens, rule in ((r[1], rule_of(*split(r[0]))) for r in df.select("url", url_tokens(F.col("url"))).collect()) if rule]
    rules = brute(labels, 0.002, 0.9)
    judged = judge_urls(df, "url").select("page_id", "url", "learned", "tokens", "judged.*", url_tokens(F.col("url")).alias("mine"))
    assert judged.count() == len(rows)
    for row in judged.drop("learned").collect():
        rule = rule_of(*split(row["url"]))
        learned = next((r.verdict for r in rules if set(r.tokens) <= set(row["mine"])), None)
        assert row["verdict"] == (rule.verdict if rule else learned or "allow")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://example.com/en/")]])
def test_nothing_to_learn_from(spark, rows):
    judged = judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), "url")
    assert [r["judged"]["verdict"] for r in judged.collect()] == ["allow"] * len(rows)


def test_tokens_of_whole_urls(spark):
    urls = ["http://a.b.c.d.e.net/1/x/y2/z?k=1&l=&=3&&m#n&o", "http://h?a&b=2?c", "?a", None]
    found = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(whole_tokens(F.col("url"))).collect()]
    host = ["host1:net", "host2:e", "host3:d", "host4:c", "host5:b", "host6:a"]
    assert found == [[*host, "path1:#", "path2:x", "path3:y#", "path4:z", "query:k", "query:l", "query:m"], ["host1:h", "query:a", "query:b"], [], []]


@pytest.mark.parametrize("url", ["http://spam.a.b.c.{}", "http://x.{}/1/2/3/spam", "http://x.{}?a=1&spam=2"])
def test_what_stands_late_in_a_url_is_learned(spark, url):
    hosts = ["example.com/de/", "example.net/en/", "net/fr/", "example.net/en/"]
    rows = [(url.replace("{}", host if "{}/" not in url else host.rstrip("/")),) for host in hosts[:1] * 20]
    rows += [(f"http://x.{host}",) for host in hosts[1:] * 20] + [(url.replace("{}", "example.info"),)]
    judged = judge_urls(spark.createDataFrame(rows, "url string"), "url")
    assert judged.where("url like '%info%'").first()["judged"]["verdict"] == "block"


def test_long_shared_paths_are_mined_as_one(spark):
    tail = "/".join(f"s{i}" for i in range(40))
    urls = [f"http://x{k}.{host}{tail}" for k in range(6) for host in ["net/", "net/", "example.net/en/"]]
    rows = [(u,) for u in urls] + [("http://example.org/" + tail,)]
    df = spark.createDataFrame(rows, "url string")
    assert judge_urls(df, "url").count() == len(rows)


def test_rules_of_tokens_that_stand_together_equal_counting(spark):
    rng = random.Random(11)
    rows = [(["p", "q", *(["x", "y"] if k % 3 else ["z"]), *rng.sample("abc", 1)], "block" if k % 7 else "allow") for k in range(120)]
    rows += [(["only", "a"], "allow")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, label string").repartition(3)
    assert mine(df, "tokens", "label", 0.01, 0.6) == brute(rows, 0.01, 0.6)
