r"""Spans of pattern matches as native columns.

Spark returns matched strings, not places. A match's place follows from splitting the same text at
the same pattern: gaps and matches alternate, so running sums of their lengths are the places.
Places are code points, as Spark's length() counts. Patterns here are written so that
java.util.regex neither recurses per repetition nor scans a run of characters from each of its places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,rank:int,start:int,end:int,found:string,part:string>>"


def matches(text: Column, kind: str, rank: int, pattern: str, part: int = 0) -> Column:
    """Leftmost non-overlapping matches: kind, rank, start, end (exclusive), found, part (a group)."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    group = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(part + 1))
    zipped = F.arrays_zip(F.split(text, pattern).alias("gap"), whole.alias("found"), group.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        span = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), begin.alias("start"), end.alias("end"), x["found"].alias("found"), x["part"].alias("part"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["rank"].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def by_kind(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["rank"].alias("a"), s["start"].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
