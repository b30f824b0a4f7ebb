"""Secret scans with linking of credentials that come in parts.

Access identifiers, secrets and endpoints are found by patterns. Strong matches are reported as they are. A weak
candidate, one that a pattern alone does not prove, is reported only when the parts that complete it stand in its
scope: a paragraph, at most ``REACH`` code points away. The interval join behind that is a window over the parts of a
scope in order of place: if any completing part is within reach, so is the last that starts before the candidate or
the first that starts after it, and no pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.registry import documents, query
from holdfast.llm.scratch import free_name, stored

REACH = 300

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Pattern:
    """Matches of ``regex``, leftmost and not overlapping, of which those with ``keep`` are parts in the ``role``."""

    kind: str
    role: str
    regex: str
    strong: bool
    needs: tuple[str, ...] = ()
    every: bool = False
    group: int = 0
    least: int = 0


#: The first three are the base patterns, in order. The others are weak, and need any or every of the named roles near.
PATTERNS = (
    Pattern("assign", SECRET, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, group=2, least=6),
    Pattern("access", IDENTIFIER, r"AKIA[A-Z0-9]+", True, least=20),
    Pattern("hex", SECRET, r"[0-9a-f]{24,}", True, least=24),
    Pattern("blob", SECRET, r"[A-Za-z0-9+/_-]{32,}={0,2}", False, (IDENTIFIER, ENDPOINT)),
    Pattern("account", IDENTIFIER, r"""(?i)(user|username|user_?id|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", False, (SECRET,)),
    Pattern("endpoint", ENDPOINT, r"""(?i)([a-z][a-z0-9+.-]{1,15}://|(host|hostname|server|endpoint)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9._:/@%?=&-]{3,}""", False, (IDENTIFIER, SECRET), True),
)
BASE = tuple(p.kind for p in PATTERNS if p.strong)
BREAK = "break"
_BREAKS = r"\n[\x20\t\r]*\n"


def _matches(text: Column, kind: str, regex: str, group: int = 0) -> Column:
    """Per match its kind, the code points between it and the match before, its text and the group's text.

    Splitting at the matches gives what lies between them; texts without a match, nearly all, are searched once.
    """
    empty = F.expr("cast(array() as array<struct<kind:string,gap:int,value:string,inner:string>>)")
    found = F.struct(
        F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("values"),
        F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("inner"),
        F.split(text, regex, -1).alias("between"),
    )
    rows = F.transform(
        F.array(found),
        lambda f: F.transform(
            f["values"],
            lambda v, i: F.struct(F.lit(kind).alias("kind"), F.length(F.get(f["between"], i)).alias("gap"), v.alias("value"), F.get(f["inner"], i).alias("inner")),
        ),
    )
    return F.when(F.rlike(text, F.lit(regex)), F.get(rows, F.lit(0))).otherwise(empty)


def has_part(text: Column) -> Column:
    """Whether any pattern matches at all."""
    found = F.lit(False)
    for p in PATTERNS:
        found = found | F.rlike(F.coalesce(text, F.lit("")), F.lit(p.regex))
    return found


def find_parts(df: DataFrame, text: str, out: str = "parts") -> DataFrame:
    """The frame with an array ``out`` of the matches of every pattern and, where there are any, of the paragraph breaks."""
    whole = F.coalesce(F.col(text), F.lit(""))
    parts = df.withColumn(out, F.concat(*(_matches(whole, p.kind, p.regex, p.group) for p in PATTERNS)))
    breaks = F.concat(F.col(out), _matches(whole, BREAK, _BREAKS))
    return parts.withColumn(out, F.when(F.size(out) > 0, breaks).otherwise(F.col(out)))


def link(parts: DataFrame, row: str, column: str = "parts", reach: int = REACH) -> DataFrame:
    """The reported spans of each ``row``: ``kind``, ``start`` and ``end`` (exclusive) in code points, and whether ``strong``."""
    rank = F.create_map(*(x for i, p in enumerate(PATTERNS) for x in (F.lit(p.kind), F.lit(i))))
    role = F.create_map(*(x for p in PATTERNS for x in (F.lit(p.kind), F.lit(p.role))))
    each = parts.select(row, F.posexplode(column).alias("place", "part")).select(row, "place", "part.*")
    before = Window.partitionBy(row, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("value")
    # The start of a match: all that lies between matches of its kind up to it, and the matches before it.
    spans = each.withColumn("end", F.sum(F.col("gap") + size).over(before).cast("int")).withColumn("start", F.col("end") - size)
    in_order = Window.partitionBy(row).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("scope", F.count_if(F.col("kind") == BREAK).over(in_order)).where(F.col("kind") != BREAK)
    long_enough = F.lit(True)
    for p in PATTERNS:
        if p.least:
            long_enough = long_enough & ((F.col("kind") != p.kind) | (F.length("inner") >= p.least))
    mixed = (F.col("kind") != "blob") | (F.rlike("value", F.lit("[0-9]")) & F.rlike("value", F.lit("[A-Z]")) & F.rlike("value", F.lit("[a-z]")))
    spans = spans.where(long_enough & mixed).select(row, "kind", "start", "end", "scope", F.col("kind").isin(*BASE).alias("strong"))
    # A weak candidate inside a strong match is that match.
    here = Window.partitionBy(row).orderBy("start", F.desc("strong"), "end", "kind")
    covered_before = F.max(F.when(F.col("strong"), F.col("end"))).over(here.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    covered_after = F.min(F.when(F.col("strong"), F.col("start"))).over(here.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    spans = spans.withColumn("covered", F.coalesce(covered_before, F.lit(False)) | F.coalesce(covered_after, F.lit(False))).where("strong or not covered")
    near = Window.partitionBy(row, "scope").orderBy("start", "end", "kind")

    def close(wanted: str) -> Column:
        is_it = role[F.col("kind")] == wanted
        last = F.max(F.when(is_it, F.col("end"))).over(near.rowsBetween(Window.unboundedPreceding, -1))
        following = F.min(F.when(is_it, F.col("start"))).over(near.rowsBetween(1, Window.unboundedFollowing))
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(following - F.col("end") <= reach, F.lit(False))

    spans = spans.withColumns({wanted: close(wanted) for wanted in (IDENTIFIER, SECRET, ENDPOINT)})
    reported = F.col("strong")
    for p in PATTERNS:
        if not p.strong:
            complete = F.lit(p.every)
            for wanted in p.needs:
                complete = complete & F.col(wanted) if p.every else complete | F.col(wanted)
            reported = reported | ((F.col("kind") == p.kind) & complete)
    return spans.where(reported).select(row, "kind", "start", "end", "strong", rank[F.col("kind")].alias("rank"))


def spans_by_row(found: DataFrame, row: str, parts: str, out: str) -> DataFrame:
    """Per ``row`` with a reported span an array ``out`` of all of them, in order of start and of kind as listed."""
    spans = link(found.where(F.size(parts) > 0), row, parts)
    return spans.groupBy(row).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind", "strong"))).alias(out))


def scan(df: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """The frame without its text, with ``out``: an array of the reported ``start``, ``rank``, ``end``, ``kind`` and ``strong``.

    Spans stand in order of start, and of kind as listed in ``PATTERNS``. Null and empty texts have none; every row
    stays, and a column already called ``out`` is replaced. The matches are written to the shared folder, and only
    their rows go through the windows.
    """
    rest = [c for c in df.columns if c not in (text, out)]
    row, parts = free_name(df, "__row"), free_name(df, "__parts")
    numbered = df.select(*rest, text).withColumn(row, F.monotonically_increasing_id())
    found = stored(find_parts(numbered, text, parts).drop(text), "parts")
    listed = spans_by_row(found, row, parts, out)
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,strong:boolean>>)")
    return found.select(row, *rest).join(listed, row, "left").select(*rest, F.coalesce(out, none).alias(out))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with a mark in place of its spans; spans that touch or overlap get one mark."""
    start = F.struct(F.lit(0).alias("to"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        new = span["start"] > state["to"]
        first = (state["to"] == 0) & (span["start"] == 0)
        between = F.substring(text, state["to"] + 1, span["start"] - state["to"])
        return F.struct(
            F.greatest(state["to"], span["end"]).alias("to"),
            F.when(new | first, F.concat(state["out"], F.when(new, between).otherwise(F.lit("")), F.lit(mark))).otherwise(state["out"]).alias("out"),
        )

    end = F.length(text)
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["to"] + 1, F.greatest(end - s["to"], F.lit(0)))))


def _listed(spans: Column) -> Column:
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


@query("op7_secret_scan")
def op7(spark, sf_dir):
    scanned = scan(documents(spark, sf_dir), "text")
    counts = {f"n_{kind}": F.size(F.filter(F.col("spans.kind"), F.lit(kind).__eq__)).cast("long") for kind in BASE}
    base = _listed(F.filter("spans", lambda s: s["strong"]))
    return scanned.select(
        "doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
