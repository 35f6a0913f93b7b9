r"""Operator 1: mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. The integral of a source's
schedule up to t, scaled so that its value at 1 is the source's target, is the number of its
tokens that training has asked for by then: its cumulative demand. A document stands in its
source's order (by a hash of its id) behind so many tokens; inverting the demand at that number
gives the document's training position. The plan is range-sorted by position.

The source's order is never sorted by one task: rows fall into buckets of about BUCKET_ROWS rows
by the high bits of the hash, bucket sums give each bucket its offset, and only rows inside a
bucket are ordered. Source statistics are one row per source.

Defined results: a null text has size 0; a source that is null is a source of its own, last in
order; documents of size 0 are taken 0 times and stand at the position of their offset; rows that
repeat are documents of their own; an empty table gives an empty plan; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.llm.common import WORD, stored

#: Weights of sources in code point order, null last, repeating.
WEIGHTS = (1, 2, 3)
#: No source is taken more than so many times over.
REPEATS = 3
#: Change of a weight over training for the sources in order, repeating: weight (1 + tilt (2 t - 1)), so the mean is the weight.
TILTS = (-0.5, 0.0, 0.5)
#: Buckets whose sums are added up first.
GROUP_BUCKETS = 1024
BUCKET_ROWS = 256
SPAN = float(1 << 52)


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))).cast("long")


def spread(doc_id: Column) -> Column:
    """A number in [0, 1) from the id, the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(SPAN)


def cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, tilts: tuple = TILTS) -> DataFrame:
    """From (source, source_size), one row per source: weight, tilt and target.

    Targets share the sum of all sizes by weight; with the level x that spends it, a target is
    min(x * weight, repeats * size). Sorted by repeats * size / weight, the sources at their cap
    are a prefix, so x comes from running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    s = sizes.withColumn("rank", F.row_number().over(order) - 1)
    s = s.withColumn("weight", cycle(weights, F.col("rank"))).withColumn("tilt", cycle(tilts, F.col("rank")))
    s = s.withColumn("cap", (F.lit(repeats) * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / weight).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", "tilt", target.alias("target"))


def position(share: Column, tilt: Column) -> Column:
    """Inverse at share of the cumulative demand t + tilt (t^2 - t), the integral of 1 + tilt (2 t - 1)."""
    b = 1.0 - tilt
    root = F.sqrt(b * b + 4.0 * tilt * share)
    return F.least(F.lit(1.0), F.when(share <= 0, 0.0).otherwise(2.0 * share / (b + root)))


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, repeats: int = REPEATS, tilts: tuple = TILTS, whole_rows: bool = False,
) -> DataFrame:
    """One row per row of docs, unsorted: doc_id, source, size, source_size, target, taken, epochs, start, tilt.

    start is where the document stands in its source's order, in tokens. taken is the number of the
    document's tokens that lie in the first round(target) tokens of that order, repeated; so the
    documents of a source take its target, and one document of it may be cut. epochs is how many
    times the document occurs (whole or cut). whole_rows adds row, a struct of all columns.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), spread(F.col(id_col)).alias("u"),
        *([F.struct(*docs.columns).alias("row")] if whole_rows else []),
    ).withColumn("key", key)
    small = stored(base.drop("row"), "sizes")
    buckets = max(1, -(-small.count() // BUCKET_ROWS))
    bucket = F.floor(F.col("u") * buckets)
    sums = stored(small.groupBy("key", "source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, repeats, tilts)
    # What lies before a bucket: sums of whole groups of buckets, then of the buckets before it in its group, so that no task sees all of a source.
    group = F.floor(F.col("bucket") / GROUP_BUCKETS)
    earlier = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("key", group.alias("group")).agg(F.sum("bucket_size").alias("n")).select("key", "group", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = Window.partitionBy("key", "group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("group", group).withColumn("inside", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(groups, ["key", "group"])
    offsets = offsets.select("key", "bucket", (F.col("before") + F.col("inside")).alias("offset"))
    offsets = offsets.join(targets.withColumn("key", key).drop("source"), "key")
    inner = Window.partitionBy("key", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = (base if whole_rows else small).withColumn("bucket", bucket)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["key", "bucket"])
    asked = F.round(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(asked / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    d = d.withColumn("start", F.col("offset") + F.col("inner")).withColumn("full", full)
    part = F.greatest(F.lit(0), F.least(F.col("size"), asked - F.col("full") * F.col("source_size") - F.col("start"))).cast("long")
    d = d.withColumn("part", part).withColumn("taken", F.col("full") * F.col("size") + F.col("part"))
    epochs = F.when(F.col("size") > 0, F.col("full")).otherwise(0) + (F.col("part") > 0).cast("long")
    return d.withColumn("epochs", epochs).drop("full", "part", "inner", "offset", "bucket", "u", "key", "weight")


def reached(tokens: Column) -> Column:
    """Training position at which the source's demand reaches so many of its tokens."""
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), tokens / F.greatest(F.col("target"), F.lit(1e-9)))).otherwise(1.0)
    return position(share, F.col("tilt"))


def curriculum_mix(docs: DataFrame, **options) -> DataFrame:
    """The plan, range-sorted by first_position (null for documents that are not taken). Options as for curriculum()."""
    d = curriculum(docs, **options).withColumn("first_position", F.when(F.col("taken") > 0, reached(F.col("start"))))
    return d.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id").drop("start", "tilt")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, as training reads them: a row for each time that a document is taken, range-sorted by position."""
    d = curriculum(docs, whole_rows=True, **options).filter("epochs > 0")
    d = d.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    d = d.select("row", "doc_id", reached(F.col("start") + F.col("turn") * F.col("source_size")).alias("position"))
    d = d.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """Query: the plan for all documents."""
    plan = curriculum_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "epochs", F.round("first_position", 6).alias("first_position"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s),
     w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, [-0.5, 0.0, 0.5][rank % 3 + 1]::DOUBLE AS tilt,
                  (3 * source_size)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM r),
     l AS (SELECT *, (total - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
           FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     x AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
     t AS (SELECT source, source_size, tilt, least(cap, coalesce(x.level * weight, cap)) AS target FROM l, x),
     p AS (SELECT d.*, source_size, tilt, target, round(target)::BIGINT AS asked,
                  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
     q AS (SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS full_ FROM p),
     z AS (SELECT *, greatest(0, least(size, asked - full_ * source_size - start)) AS part,
                  CASE WHEN target > 0 THEN least(1.0::DOUBLE, start / greatest(target, 1e-9)) ELSE 1.0 END AS share FROM q)
SELECT doc_id, size, source_size, target, full_ * size + part AS taken,
       CASE WHEN size > 0 THEN full_ ELSE 0 END + (part > 0)::BIGINT AS epochs,
       CASE WHEN full_ * size + part > 0 THEN round(least(1.0::DOUBLE, CASE WHEN share <= 0 THEN 0.0::DOUBLE
            ELSE 2.0 * share / ((1.0 - tilt) + sqrt((1.0 - tilt) * (1.0 - tilt) + 4.0 * tilt * share)) END), 6) END AS first_position
FROM z
"""
