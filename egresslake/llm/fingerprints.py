r"""Operator 4: document fingerprints that scale with the document.

A fingerprint keeps every hash of the text's distinct word 5-grams below a fixed fraction of the
hash range, so its size follows the document's and sketches of very unequal documents can be
compared: of the hashes that both sketches cover, the share of A's that B has estimates how much of
A is in B. A floor keeps the FLOOR least hashes of short texts too. Both parts can be merged: the union of
two sketches, cut the same way, is the sketch of the union.

Main path: DataFrame functions only.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, which is like
another empty one (1) and like no other (0); a text of fewer than five words has one shingle, itself;
null ids come last in descending order; documents with one id are ordered by a hash of their text; rows that
repeat are one document in that order and get equal results; a single document is its own next; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.llm.common import row_key, stored

SHINGLE = 5
FRACTION = 0.25
FLOOR = 16
LEAST = -(1 << 31)
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def limit(fraction: float) -> int:
    return LEAST + int(fraction * (1 << 32))


def sketch(text: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Sorted distinct 32-bit hashes of the text's shingles: those under the fraction, and the least `floor`."""
    words = F.split(F.btrim(F.lower(text), F.lit(SPACES)), r"[\x20\x09-\x0D]+")
    top = F.lit(limit(fraction))

    def upper(*parts: Column) -> Column:
        return F.shiftright(F.xxhash64(*parts), 32).cast("int")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: upper(*[w[i + k] for k in range(SHINGLE)]))
        few = F.when(w[0] == "", F.array().cast("array<int>")).otherwise(F.array(upper(F.array_join(w, " "))))
        return F.when(F.size(w) >= SHINGLE, many).otherwise(few)

    def cut(h: Column) -> Column:
        low = F.array_distinct(F.filter(h, lambda x: x < top))
        return let(low, lambda x: F.when(F.size(x) >= floor, x).otherwise(F.array_distinct(h)))

    def kept(h: Column) -> Column:
        return F.filter(h, lambda x, i: (x < top) | (i < floor))

    return let(let(words, lambda w: let(hashes(w), cut)), lambda h: let(F.array_sort(h), kept))


def likeness(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """The estimated share of a's shingles that b has."""

    def covered(s: Column) -> Column:
        return F.when(F.size(s) < floor, F.lit(1 << 31).cast("long")).otherwise(F.greatest(F.lit(limit(fraction)).cast("long"), F.element_at(s, floor).cast("long") + 1))

    def share(mine: Column) -> Column:
        return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, b)) / F.size(mine)).otherwise(F.lit(0.0))

    both = F.least(covered(a), covered(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(both, lambda c: share(F.filter(a, lambda x: x < c))))


def merged(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """The sketch of both texts' shingles together."""
    return let(F.array_sort(F.array_union(a, b)), lambda h: F.filter(h, lambda x, i: (x < limit(fraction)) | (i < floor)))


def written(s: Column) -> Column:
    """A sketch as text, eight hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x.cast("long") - LEAST)), 8, "0")), "")


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, key, n, next): the key of each row's follower by descending id, the first row's after the last.

    Rows are range-partitioned; followers inside a partition are the next row, and across partitions
    the first row of the next one, from a table with one row per partition.
    """
    order = [F.desc_nulls_last("id"), F.asc("key")]
    o = stored(rows.distinct().repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "order")
    inside = Window.partitionBy("pid").orderBy(*order)
    o = o.withColumn("place", F.row_number().over(inside)).withColumn("next", F.lead("key").over(inside))
    firsts = o.filter("place = 1").select("pid", "key")
    along = Window.orderBy("pid")
    first = F.first("key").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("pid", F.coalesce(F.lead("key").over(along), first).alias("after"))
    return o.join(F.broadcast(firsts), "pid").select("id", "key", "n", F.coalesce("next", "after").alias("next"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, txt, edited (its last third replaced by the next document's start), sketch of the next document.

    Texts are shuffled once, by row key; the next document's start and sketch once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), text.alias("txt"))
    rows = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.length(text).alias("n"))
    near = stored(neighbours(rows), "neighbours")
    asked = near.select(F.col("next").alias("key"), F.col("key").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    sent = d.join(asked.hint("merge"), "key").select(F.col("to").alias("key"), F.substring("txt", F.lit(1), F.col("k")).alias("head"), sketch(F.col("txt")).alias("next_sketch"))
    if docs.count() > near.count():  # whole rows repeat
        sent = sent.dropDuplicates(["key"])
    out = d.join(sent.hint("merge"), "key").join(near.select("key", "id", "n").hint("merge"), "key")
    cut = F.col("n") - F.floor(F.col("n") / 3).cast("int")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "txt",
        F.concat(F.substring("txt", F.lit(1), cut), F.col("head")).alias("edited"), "next_sketch",
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Query: fingerprints of every text and its edited text, and their likeness."""
    d = edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("txt")).alias("mine"), sketch(F.col("edited")).alias("theirs"), "next_sketch")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("mine")).alias("fingerprint"), written(F.col("theirs")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("theirs")).alias("near_edited"), likeness(F.col("mine"), F.col("next_sketch")).alias("near_next"),
    )
