"""Shared plumbing: where intermediate tables go, keyed joins that survive hot keys."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
#: Rows of a side that may be broadcast. Rows are of fixed width (keys and numbers), so this bounds bytes.
BROADCAST_ROWS = 400_000
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in local mode, a folder of this process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="egresslake-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    Tables that nothing has released stay until the driver ends, since results are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/egresslake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._egresslake_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may have ended
            _remove(spark, path)


def release(*frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_egresslake_path", None)
        if path:
            _made.remove((df.sparkSession, path))
            _remove(df.sparkSession, path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df, a stored table, has at most so many rows: a count from Parquet's metadata."""
    return df.count() <= rows


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with the one row of their group, safe where a group holds much of all rows.

    Groups with more than HOT_SHARE of all rows are at most 1 / HOT_SHARE, so that part is
    broadcast; the others are shuffled. Both frames should be stored tables. A key is never null.
    """
    least = max(1, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    a = rows.join(F.broadcast(hot), key)
    b = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return a.unionByName(b)


def semi(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """left_semi or left_anti join of wide rows with a stored table of keys: broadcast where it is small."""
    return df.join(F.broadcast(keys) if small_enough(keys) else keys, on, how)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds what Python workers hold at a time: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def row_key(id_col: Column, text: Column) -> Column:
    """Tells rows with another id or another text apart."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))


def drop_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, all columns, without the rows that found (stored; key, keep_key, kept) does not keep.

    Rows are told apart by id and text. Where whole rows repeat, one of the repeats stays; only
    such rows take the extra step.
    """
    gone = stored(found.filter(F.col("key") != F.col("keep_key")).select(F.col("key").alias("_el_key")).distinct(), "gone")
    same = found.filter(F.col("key") == F.col("keep_key")).groupBy(F.col("key").alias("_el_key")).agg(F.count(F.lit(1)).alias("_el_n"))
    again = stored(same.filter("_el_n > 1").select("_el_key"), "again")
    keyed = docs.withColumn("_el_key", row_key(F.col(id_col), F.col(text_col)))
    left = semi(keyed, gone, ["_el_key"], "left_anti")
    if again.limit(1).count():
        left = semi(left, again, ["_el_key"], "left_anti").unionByName(semi(left, again, ["_el_key"], "left_semi").dropDuplicates(["_el_key"]))
    return left.select(docs.columns)


def semi_left(df: DataFrame, keyed: DataFrame, on: str) -> DataFrame:
    """Left join of wide rows with a stored table that has at most one row per key: broadcast where it is small."""
    return df.join(F.broadcast(keyed) if small_enough(keyed) else keyed, on, "left")
