r"""Operator 3: secret scans through a trigram inverted index.

For every rule a Boolean query over trigrams is derived from its regular expression: a text that
matches the rule holds, in lower case, the trigrams that the query asks for. The index holds
postings (trigram, document) for the trigrams that some rule's query names. Postings are
intersected per document, which leaves each rule its candidates, and only these are searched with
the rule's expression. A rule without mandatory trigrams searches all texts.

Main path: DataFrame functions only. The query analysis runs on the driver, over the rules.

Defined results: a null text counts as empty; a null id is an id; rows that repeat are searched each on
its own (they share postings, which can only add candidates); an empty table gives an empty result;
further columns are ignored. Places are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import semi_left, stored
from egresslake.llm.spans import SPAN, by_start, counted, joined, matches

#: More exact strings than so many are not spelled out.
MOST = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length counts, and its least length.
    part: int = 0
    least: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+"),
    Rule("bearer", r"""authorization["']?\x20*+[:=]\x20*+["']?bearer\x20++([A-Za-z0-9._~+/=-]+)""", 1, 16, True),
    Rule("url_login", r"(https?|ftp|postgres|mysql|mongodb|redis|amqp)://[^\s:/@]{1,64}:[^\s:/@]{1,64}@", 0, 0, True),
)
RULES = BASE + MORE

#: A query is None (nothing is mandatory), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def both(queries: list[Query]) -> Query:
    kept = sorted({q for q in queries if q is not None}, key=repr)
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def either(queries: list[Query]) -> Query:
    """Alternatives; one that asks for all that another asks for, and more, is left out."""
    if any(q is None for q in queries):
        return None
    need = {q: frozenset(q[1]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in queries}
    kept = sorted({q for q in need if not any(need[o] < need[q] for o in need)}, key=repr)
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def spelled(strings: set[str]) -> Query:
    """The query for texts that hold one of the strings."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """The trigrams that the lower-cased text of any match holds."""
    exact, query = _walk(sre_parser.parse(pattern))
    return both([query, spelled(exact)]) if exact else query


def _chars(items: list) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """(the exact strings that it matches, if these are few; else None, and the query of the whole)."""
    now, queries, whole = {""}, [], True

    def broken() -> None:
        nonlocal now, whole
        queries.append(spelled(now) if all(len(s) >= 3 for s in now) else None)
        now, whole = {""}, False

    for op, value in tokens:
        exact: set[str] | None = None
        query: Query = None
        if op is sre.LITERAL:
            exact = {chr(value).lower()}
        elif op is sre.IN:
            exact = _chars(value)
        elif op is sre.SUBPATTERN:
            exact, query = _walk(value[3])
        elif op is sre.ATOMIC_GROUP:
            exact, query = _walk(value)
        elif op is sre.BRANCH:
            parts = [_walk(t) for t in value[1]]
            if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MOST:
                exact = set().union(*(e for e, _ in parts))
            else:
                query = either([both([q, spelled(e) if e else None]) for e, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, inner = value
            e, q = _walk(inner)
            if e is not None and high == 1:
                exact = e | ({""} if low == 0 else set())
            elif e is not None and low and low == high and len(e) ** int(low) <= MOST:
                exact = {"".join(x) for x in product(e, repeat=int(low))}
            elif low:
                query = both([q, spelled(e) if e and all(len(s) >= 3 for s in e) else None])
        elif op is sre.AT:
            exact = {""}
        if exact is not None and len(now) * len(exact) <= MOST:
            now = {a + b for a in now for b in exact}
            continue
        broken()
        queries.append(query)
        if exact is not None:
            now = exact
    if whole:
        return now, None
    broken()
    return None, both(queries)


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(docs: DataFrame, key: Column, text: Column, vocabulary: list[str]) -> DataFrame:
    """The index: (trigram number, document key), for the trigrams of the vocabulary."""
    d = docs.select(key.alias("doc"), F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    return d.select("doc", F.explode(held).alias("trigram"))


def intersected(index: DataFrame, vocabulary: list[str], queries: dict[str, Query]) -> DataFrame:
    """(doc, rules): the rules that each document's postings satisfy, for documents with one at least."""
    number = {t: i for i, t in enumerate(vocabulary)}
    words = range(-(-len(vocabulary) // 60))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") % 60).cast("int"))
    masks = index.groupBy("doc").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])

    def holds(q: Query) -> Column:
        if isinstance(q, str):
            i = number[q]
            return F.col(f"m{i // 60}").bitwiseAND(F.lit(1 << i % 60)) != 0
        parts = [holds(x) for x in q[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if q[0] == "and" else out | p
        return out

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items() if q is not None]))
    return masks.select("doc", rules.alias("rules")).filter(F.size("rules") > 0)


def found_by(rule: Rule, rank: int, text: Column) -> Column:
    spans = matches(text, rule.kind, rank, rule.java, rule.part)
    return F.filter(spans, lambda s: F.length(s["part"]) >= rule.least) if rule.least else spans


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: the id and spans (kind, rank, start, end, found, part), by start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    vocabulary = sorted(set().union(*map(trigrams, queries.values())))
    key = F.xxhash64(F.col(id_col))
    hit = stored(intersected(stored(postings(docs, key, F.col(text_col), vocabulary), "postings"), vocabulary, queries), "candidates")
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"), key.alias("doc"))
    d = semi_left(d, hit, "doc")
    none = F.array().cast(SPAN)
    parts = []
    for rank, rule in enumerate(rules):
        spans = found_by(rule, rank, F.col("txt"))
        if queries[rule.kind] is not None:
            spans = F.when(F.array_contains(F.coalesce(F.col("rules"), F.array().cast("array<string>")), rule.kind), spans).otherwise(none)
        parts.append(spans)
    return d.select(F.col("id").alias(id_col), by_start(F.concat(*parts)).alias("spans"))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Query: counts and digest of the base kinds, and all spans, of every document."""
    d = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return d.select(
        "doc_id", *[counted(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
