"""Secret scans through a trigram inverted index, in SQL functions only.

From each rule's regular expression follows a Boolean query over trigrams that every match must contain: an OR of ANDs. The
index has, for each trigram that some query names, the texts that contain it; an AND holds where a text stands in all
its postings. Only texts for which a rule's query holds are matched with that rule; a rule without mandatory
trigrams is matched with every text. Trigrams are those of the lower-case text, so that no rule loses a match by case.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.shared import written
from siftline.tuning import broadcast_if_small

# Alternatives that a query may have, and letters of a class that are spelled out.
ALTERNATIVES, SPELLED = 64, 8
# Candidate rows (two longs each) that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE + ADDED

# A query is a set of ANDs, each a set of trigrams; the empty AND holds everywhere.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _either(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > ALTERNATIVES:
        return min(a, b, key=len)  # weaker, and so still safe
    return _either(frozenset(x | y for x in a for y in b), frozenset())


def _of_strings(strings: set[str]) -> Query:
    return _either(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings), frozenset())


def _read(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that match, where they are few, else None; query) of a sequence of parsed nodes."""
    known, query, whole = {""}, ANY, True
    for kind, value in nodes:
        strings, own = _node(kind, value)
        joined = {a + b for a in known for b in strings} if strings is not None else None
        if joined is not None and len(joined) <= ALTERNATIVES:
            known = joined
            continue
        query, whole = _both(_both(query, _of_strings(known)), own), False
        known = strings if strings is not None else {""}
    return (known, _of_strings(known)) if whole else (None, _both(query, _of_strings(known)))


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind is kinds.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is kinds.IN:
        letters: set[str] = set()
        for part, content in value:
            if part is kinds.LITERAL:
                letters.add(chr(content).lower())
            elif part is kinds.RANGE and content[1] - content[0] < SPELLED:
                letters |= {chr(c).lower() for c in range(content[0], content[1] + 1)}
            else:
                return None, ANY
        return (letters, ANY) if len(letters) <= SPELLED else (None, ANY)
    if kind is kinds.SUBPATTERN:
        return _read(value[3])
    if kind is kinds.BRANCH:
        parts = [_read(branch) for branch in value[1]]
        query: Query = frozenset()
        for _strings, own in parts:
            query = _either(query, own)
        if all(strings is not None for strings, _own in parts):
            strings = set().union(*(s for s, _own in parts))
            if len(strings) <= ALTERNATIVES:
                return strings, query
        return None, query
    if kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        least, most, content = value
        strings, query = _read(content)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if least == most and strings is not None and len(strings) ** least <= ALTERNATIVES:
            return _read(list(content) * least)
        return None, (query if least else ANY)
    if kind in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """The ORed ANDs of lower-case trigrams that a text with a match contains."""
    return _read(parser.parse(pattern))[1]


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, text_key) of ``texts`` (text_key, text): the index of the named trigrams. A text counts once however often it occurs."""
    lowered = texts.select("text_key", F.lower("text").alias("low"))
    inside = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return lowered.select("text_key", F.explode(inside).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(text_key, mask): which queries hold, bit i for query i. A query that holds everywhere is left out."""
    spark = index.sparkSession
    ands = [(number, part, trigram, len(one)) for number, query in enumerate(queries) if query != ANY for part, one in enumerate(sorted(map(sorted, query))) for trigram in one]
    wanted = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("query"), F.lit(p).alias("part"), F.lit(t).alias("trigram"), F.lit(s).alias("size")) for n, p, t, s in ands))).alias("w")).select("w.*")
    met = index.join(F.broadcast(wanted), "trigram").groupBy("text_key", "query", "part", "size").agg(F.count(F.lit(1)).alias("held"))
    bits = met.filter("held = size").select("text_key", F.expr("shiftleft(1L, query)").alias("bit"))
    return bits.groupBy("text_key").agg(F.bit_or("bit").alias("mask"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of one rule's matches, in code points; the gaps between matches give the places."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    checked = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits))

    def add(state: Column, z: Column) -> Column:
        start = state["at"] + F.length(z["gap"])
        end = start + F.length(z["hit"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        fits = F.length(z["checked"]) >= rule.least
        return F.struct(end.alias("at"), F.when(fits, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), checked.alias("checked"))
    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("spans")), add)["spans"]
    return F.when(F.rlike(text, pattern), folded).otherwise(none)


def scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, kind number, end>>, by start, then kind as listed.

    Null and empty texts have no spans. Repeated rows are scanned each; a column named ``spans`` is replaced, and names that begin with ``_secret_`` are the operator's own.
    Texts are keyed by a hash in the index: should two share one, both are candidates, and matching decides.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    named = sorted({t for q in queries for one in q for t in one})
    keyed = docs.withColumn("_secret_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_secret_key", F.xxhash64("_secret_text"))
    if named:
        index = postings(keyed.select(F.col("_secret_key").alias("text_key"), F.col("_secret_text").alias("text")), named)
        found = written(candidates(index, queries).select(F.col("text_key").alias("_secret_key"), F.col("mask").alias("_secret_mask")), "secret-candidates")
        keyed = keyed.join(broadcast_if_small(found, BROADCAST_ROWS), "_secret_key", "left")
    else:
        keyed = keyed.withColumn("_secret_mask", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = []
    for number, (rule, query) in enumerate(zip(rules, queries)):
        found = spans_of(F.col("_secret_text"), rule, number)
        candidate = F.coalesce(F.col("_secret_mask"), F.lit(0)).bitwiseAND(F.lit(1 << number)) != 0
        spans.append(found if query == ANY else F.when(candidate, found).otherwise(none))
    return keyed.withColumn("spans", F.sort_array(F.concat(*spans))).drop("_secret_text", "_secret_key", "_secret_mask")


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
