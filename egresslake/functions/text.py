"""Text rules of generated guidance: markers, reasons, token costs, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from egresslake.functions.fixed import ATTACK_MARKERS, DIRECTION_WORDS, VAGUE_PHRASES

# Codes and the phrases that show them.


def attack_reasons(text: Column, markers: tuple = ATTACK_MARKERS) -> Column:
    """Codes whose marker the text holds, as attack_pattern:code, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(phrase)), F.lit(f"attack_pattern:{code}")) for code, phrase in markers]))
    return F.array_distinct(found)


def is_vague(text: Column) -> Column:
    """A stock phrase, or under six words without a direction; empty text is not vague."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    directed = F.lit(False)
    for w in DIRECTION_WORDS:
        directed = directed | F.contains(words, F.lit(w))
    return (words != "") & (words.isin(*VAGUE_PHRASES) | ((F.size(F.split(words, " ")) < 6) & ~directed))


def token_estimate(text: Column, output_tokens: int = 0) -> Column:
    """max(1, (length + 3) / 4 rounded down) and the output tokens."""
    return F.greatest(F.lit(1), F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4)).cast("long") + output_tokens


def cost_usd(tokens_in: Column, tokens_out: Column, usd_in: float, usd_out: float) -> Column:
    """Dollars at prices per million tokens."""
    return (tokens_in * usd_in + tokens_out * usd_out) / 1e6


def reasons(joined: Column) -> Column:
    """The ;-joined reasons of a row as an array; none means accepted."""
    parts = F.filter(F.transform(F.split(F.coalesce(joined, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit("accepted"))).otherwise(parts)


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def variant_parts(name: Column) -> Column:
    """a__b__c as an array, without a prefix up to the first = in each part."""
    return F.transform(F.split(name, "__"), lambda p: F.regexp_replace(p, "^[^=]*=", ""))


def levels(text: Column) -> Column:
    """'0;1' or '2-0' as distinct level numbers, ranges in either direction."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("0")), ";"), lambda x: F.trim(x)), lambda p: p != "")

    def spread(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(-?\d+)", 1).try_cast("int"), F.regexp_extract(p, r"^-?\d+\s*-\s*(-?\d+)$", 1).try_cast("int")
        return F.when(b.isNotNull(), F.sequence(a, F.coalesce(b, a))).otherwise(F.array(a))

    return F.array_distinct(F.flatten(F.transform(parts, spread)))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of a row as JSON with keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
