"""Secret scans by a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query of trigrams is derived, on the driver and once: a walk over the
parsed regex gathers the strings that stand side by side in any match, a string needs all its
trigrams, alternatives are an OR, and what follows each other an AND. The index is a written table of
postings (trigram, document) of the trigrams that occur in any rule. A rule's candidates are found by
intersecting postings: the postings of a document are gathered, and the Boolean query is evaluated
on them. Only candidates are verified by the regex itself; a rule without mandatory trigrams
is matched against every text. The index is case-blind, so it can only add candidates.

Verification finds all leftmost non-overlapping matches with their places: each text is read as a
row of (gap, match) pairs, whose lengths add up. The few candidates are joined to the texts by broadcast where
their number is within a bound, else by a shuffle.

Defined results: null text counts as empty. Repeated rows give a row each. Rows meet their candidate flags by
a hash of doc_id and text, so rows that share a doc_id, or have none, aren't one group; rows whose hashes are equal
share flags, which verification makes exact. Extra columns are passed over.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize


@dataclass(frozen=True)
class Rule:
    """kind: name of its spans. regex: in the dialect that the JVM and Python share, without capturing groups but one, numbered 1, whose length least counts (0 groups: the match's)."""

    kind: str
    regex: str
    least: int = 0
    groups: int = 0


BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Spans beyond the base ones: private key blocks and tokens with a vendor's prefix.
MORE = (
    Rule("key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("vendor", r"(?:gh[pousr]_[A-Za-z0-9]+|xox[abprs]-[A-Za-z0-9-]+|sk_live_[A-Za-z0-9]+)", 20),
)
RULES = (*BASE, *MORE)
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Strings that a set of alternatives may hold, and characters of a class, before a regex's part counts as any text.
MAX_STRINGS, MAX_CLASS = 64, 8
#: Candidates that are broadcast, at most (about 40 bytes each); matches added up in one go.
BROADCAST_ROWS, RUN = 1_000_000, 512

#: An AND of clauses, each an OR of sets of trigrams that are all needed.
Query = list[frozenset[frozenset[str]]]


def trigrams(literal: str) -> list[str]:
    return sorted({literal[i : i + 3] for i in range(len(literal) - 2)})


def _clause(sets) -> frozenset[frozenset[str]]:
    """An OR of sets without those that another one makes needless."""
    sets = set(sets)
    return frozenset(s for s in sets if not any(o < s for o in sets))


def _literal(strings: set[str]) -> Query:
    """What a text must hold that holds one of the strings; nothing is known of those under three characters."""
    if any(len(s) < 3 for s in strings):
        return []
    return [_clause(frozenset(trigrams(s)) for s in strings)]


def _either(queries: list[Query]) -> Query:
    sets: set[frozenset[str]] = set()
    for q in queries:
        if not q:
            return []
        if len(list(itertools.islice(itertools.product(*q), MAX_STRINGS + 1))) > MAX_STRINGS:
            q = [min(q, key=len)]  # weaker, but still mandatory
        sets |= {frozenset().union(*choice) for choice in itertools.product(*q)}
    return [_clause(sets)]


def _part(op: str, value) -> tuple[set[str] | None, Query]:
    """Of one part of a parsed regex: all strings that it matches, in lower case, where they are few (else None), and its query."""
    if op == "LITERAL":
        found = {chr(value).lower()} if value < 128 else None
        return found, []
    if op == "IN":
        chars: set[str] = set()
        for kind, x in value:
            span = range(x, x + 1) if str(kind) == "LITERAL" else range(x[0], x[1] + 1) if str(kind) == "RANGE" else None
            if span is None or span.stop > 128 or len(span) > 128:
                return None, []
            chars |= {chr(c).lower() for c in span}
        return (chars if len(chars) <= MAX_CLASS else None), []
    if op == "BRANCH":
        found = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MAX_STRINGS:
            return set().union(*(s for s, _ in found)), []
        return None, _either([q if s is None else _literal(s) for s, q in found])
    if op in ("SUBPATTERN", "ATOMIC_GROUP"):
        return _sequence(value[-1] if op == "SUBPATTERN" else value)
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        strings, query = _sequence(inner)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, []
        if least == 0:
            return None, []
        if strings is not None and least == most and len(strings) ** least <= MAX_STRINGS:
            return {"".join(p) for p in itertools.product(strings, repeat=least)}, []
        return None, query if strings is None else _literal(strings)
    if op in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width
        return {""}, []
    return None, []


def _sequence(parts) -> tuple[set[str] | None, Query]:
    now, query, whole = {""}, [], True
    for op, value in parts:
        strings, own = _part(str(op), value)
        if strings is not None and len(now) * len(strings) <= MAX_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        query += _literal(now) + own
        now, whole = strings or {""}, False
    return (now, []) if whole else (None, query + _literal(now))


@functools.lru_cache(256)
def _derived(regex: str) -> tuple:
    strings, query = _sequence(re._parser.parse(regex))
    return tuple(query if strings is None else _literal(strings))


def query_of(rule: Rule) -> Query:
    """The trigrams that any match of the rule holds; empty if none is mandatory."""
    return list(_derived(rule.regex))


def vocabulary(rules) -> list[str]:
    return sorted({t for rule in rules for clause in query_of(rule) for any_of in clause for t in any_of})


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, rules=RULES) -> DataFrame:
    """The postings (trigram, doc_id, row: a hash of doc_id and text) of the rules' trigrams, written to the shared folder."""
    terms = F.array(*map(F.lit, vocabulary(rules))).cast("array<string>")
    held = _let(F.lower("text"), lambda folded: F.filter(terms, lambda t: F.contains(folded, t)))
    rows = docs.select("doc_id", _row().alias("row"), F.explode(held).alias("trigram"))
    return materialize(rows, "secrets-postings")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """row, doc_id and a flag for each rule that has trigrams: postings intersected as the rule's Boolean query says."""
    indexed = [r for r in rules if query_of(r)]
    place = {t: f"t{i}" for i, t in enumerate(vocabulary(rules))}
    every = [F.bool_or(F.col("trigram") == t).alias(name) for t, name in place.items()]
    held = postings.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *every)
    both = lambda parts: functools.reduce(lambda a, b: a & b, parts, F.lit(True))
    either = lambda parts: functools.reduce(lambda a, b: a | b, parts, F.lit(False))
    flag = lambda rule: both([either([both([F.col(place[t]) for t in sorted(s)]) for s in sorted(clause, key=sorted)]) for clause in query_of(rule)])
    return held.select("row", "doc_id", *[flag(r).alias(f"maybe_{r.kind}") for r in indexed]).where(either([F.col(f"maybe_{r.kind}") for r in indexed]))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The matches of a rule that are long enough, as (start, kind's number, end) in code points. Lengths are added up in runs, so that the work doesn't grow with the square of the matches."""
    pattern = F.lit(f"(?s)(.*?)({rule.regex}|\\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("hit"), F.regexp_extract_all(text, pattern, F.lit(3 if rule.groups else 2)).alias("core"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    span = lambda start, end: F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))

    def add(a, p):
        start = a["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["hit"])
        kept = (F.char_length(p["hit"]) > 0) & (F.char_length(p["core"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(kept, F.array_append(a["found"], span(start, end))).otherwise(a["found"]).alias("found"))

    def joined(runs):
        bases = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("of")), lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.array_append(a["of"], a["at"]).alias("of")), lambda a: a["of"])
        return F.flatten(F.zip_with(runs, bases, lambda r, base: F.transform(r["found"], lambda s: span(s["start"] + base, s["end"] + base))))

    cut = lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(ps, i * RUN + 1, RUN), state, add))
    return _let(pairs, lambda ps: F.when(F.size(ps) > 0, _let(cut(ps), joined)).otherwise(F.array().cast(SPAN)))


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text (null: empty) and spans, an array of (start, kind's number, end) sorted by start, then kind: a row for each row of docs."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = materialize(candidates(index(docs, rules), rules).drop("doc_id"), "secrets-candidates")
    flags = [c for c in held.columns if c != "row"]
    if held.count() <= BROADCAST_ROWS:
        held = F.broadcast(held)
    tagged = docs.withColumn("row", _row()).join(held, "row", "left")
    none = F.array().cast(SPAN)
    every = []
    for number, rule in enumerate(rules):
        maybe = F.coalesce(F.col(f"maybe_{rule.kind}"), F.lit(False)) if f"maybe_{rule.kind}" in flags else F.col("text").rlike(rule.regex if not rule.least else f"{rule.regex[:-1]}{{{rule.least}}}" if rule.regex.endswith("+") and not rule.groups else rule.regex)
        every.append(F.when(maybe, spans_of(F.col("text"), rule, number)).otherwise(none))
    return tagged.select("doc_id", "text", F.array_sort(F.concat(*every)).alias("spans"))


def span_text(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
