"""Operator 8: exact duplicates by progressive refinement.

Texts are equal when they are identical without white space ([\\x20\\x09-\\x0D]). Rows are
refined in three steps, each only over what the step before could not tell apart:

1. length of the normalised text. A text of a length up to LENGTHS that occurs once is unique. The
   lengths that occur more often number at most LENGTHS, so they are broadcast; longer texts go on.
2. hash of the first PREFIX normalised characters, among texts of one length. The scan that finds
   lengths has the text in hand and notes this hash too (16 bytes a row are stored).
3. SHA-256 of the whole normalised text, for the rows that share length and prefix only.

Rows of step 3 are stored without text (id, length, hash); group results come back to rows
through join_groups, so a group with a third of all rows is not one task's work.

Defined results: a null text counts as empty; a null id loses to any other; rows that repeat an
id and text are copies of each other and one of them stays; an empty table gives an empty one;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import SPACE, drop_rows, join_groups, row_key, semi, stored

PREFIX = 256
LENGTHS = 1 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def refined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of groups of two or more with their decision, the other rows with their normalised text)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    headed = base.select("id", "txt", normalised(F.col("txt")).alias("norm"))
    headed = headed.withColumn("len", F.length("norm")).withColumn("head", F.xxhash64(F.substring("norm", 1, PREFIX)))
    sizes = stored(headed.select("len", "head"), "sizes")
    twice = F.count(F.lit(1)).alias("rows")
    lengths = sizes.filter(F.col("len") <= LENGTHS).groupBy("len").agg(twice).filter("rows > 1").select("len")
    shared = sizes.join(F.broadcast(lengths), "len", "left_semi").unionByName(sizes.filter(F.col("len") > LENGTHS))
    heads = stored(shared.groupBy("len", "head").agg(twice).filter("rows > 1").select("len", "head"), "heads")
    alive = stored(
        semi(headed, heads, ["len", "head"], "left_semi").select(
            "id", F.length("txt").alias("n_orig"), F.sha2("norm", 256).alias("sha"),
            row_key(F.col("id"), F.col("txt")).alias("key"), F.monotonically_increasing_id().alias("tag"),
        ),
        "alive",
    )
    best = F.struct(-F.col("n_orig"), F.col("id").isNull(), F.col("id"), F.col("key"), F.col("tag"))
    groups = stored(
        alive.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")).select(
            "sha", "group_size", F.col("best.id").alias("keep_id"), F.col("best.key").alias("keep_key"), F.col("best.tag").alias("keep_tag")
        ),
        "groups",
    )
    found = join_groups(alive, groups, "sha", "group_size", alive.count()).withColumn("kept", F.col("tag") == F.col("keep_tag"))
    single = semi(headed, heads, ["len", "head"], "left_anti").select("id", "norm")
    return found, single


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null for rows that an earlier step found unique, unless hash_all is set.
    """
    found, single = refined(docs, id_col, text_col)
    sha = F.sha2("norm", 256) if hash_all else F.lit(None).cast("string")
    return found.select("id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")).unionByName(
        single.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha.alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that exact_dedup does not keep.

    Dropped rows are found again by id and text. Where whole rows repeat, one of the repeats
    stays; only such rows take the extra step.
    """
    found, _ = refined(docs, id_col, text_col)
    return drop_rows(docs, stored(found, "found"), id_col, text_col)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: the decision for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, hash_all=True).withColumnRenamed("id", "doc_id")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_orig,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     s AS (SELECT doc_id, n_orig, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_orig DESC, doc_id NULLS LAST)
"""
