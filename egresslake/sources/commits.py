"""Run checkpoints that are there whole or not at all, and studies that go on where they were stopped.

A run's tables are written to a staged folder, then its manifest, then the folder gets its final name in one rename. Readers see only
final folders with a manifest. Whatever is killed in between leaves a staged folder, which the next attempt replaces. On stores whose
rename is not atomic, the manifest is still the last file of a folder to be written, and its row counts are checked on reading.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
SCHEMA = "run_index int, run_id string, tables array<struct<name:string,rows:long>>, extra map<string,string>"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def run_folder(root: str, run_index: int) -> str:
    return f"{root}/runs/{run_index:05d}"


def is_committed(spark: SparkSession, root: str, run_index: int) -> bool:
    return _exists(spark, f"{run_folder(root, run_index)}/{MANIFEST}")


def commit_run(tables: Mapping[str, DataFrame], root: str, run_index: int, run_id: str, extra: Mapping[str, str] | None = None, after: Callable[[str], None] = lambda step: None) -> bool:
    """Whether the run was written now: a run that is committed already stays as it is.

    `after` is called with the name of each step that is done: a table's name, "manifest", "renamed".
    """
    if not tables:
        raise ValueError("a run has tables")
    spark = next(iter(tables.values())).sparkSession
    final, staged = run_folder(root, run_index), f"{root}/runs/.{run_index:05d}.tmp"
    if is_committed(spark, root, run_index):
        return False
    for path in (final, staged):  # left by an attempt that was stopped
        _delete(spark, path)
    rows = []
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{staged}/{name}.parquet")
        rows.append((name, spark.read.schema(df.schema).parquet(f"{staged}/{name}.parquet").count()))
        after(name)
    line = json.dumps({"run_index": run_index, "run_id": run_id, "tables": [{"name": n, "rows": c} for n, c in rows], "extra": dict(extra or {})}, sort_keys=True)
    fs, p = _fs(spark, f"{staged}/{MANIFEST}")
    out = fs.create(p, True)
    out.write(bytearray((line + "\n").encode()))
    out.close()
    after("manifest")
    fs, p = _fs(spark, staged)
    if not fs.rename(p, _fs(spark, final)[1]):
        raise OSError(f"{staged} could not be renamed to {final}")
    after("renamed")
    return True


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(run_index, run_id, tables, extra) of the runs that are committed; staged folders do not show."""
    fs, p = _fs(spark, f"{root}/runs")
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/[0-9]*/{MANIFEST}")) if fs.exists(p) else None
    if not found:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(f"{root}/runs/[0-9]*/{MANIFEST}")


def pending(planned: DataFrame, root: str, run_index: str = "run_index") -> DataFrame:
    """Planned runs that are not committed."""
    done = committed(planned.sparkSession, root).select(F.col("run_index").alias(run_index))
    return planned.join(done, run_index, "left_anti")


def load_table(spark: SparkSession, root: str, name: str, schema: str | None = None) -> DataFrame:
    """One table of all committed runs, with run_index; an error where a run's rows are not as many as its manifest says."""
    runs = committed(spark, root).select("run_index", F.explode("tables").alias("t")).filter(F.col("t.name") == name).select("run_index", "t.rows").collect()  # a row per run
    if not runs:
        raise ValueError(f"no committed run has a table {name}")
    folders = {f"{run_folder(root, r.run_index)}/{name}.parquet": r for r in runs}
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    df = reader.parquet(*folders).withColumn("run_index", F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([0-9]+)/", 1).cast("int"))
    counts = {r.run_index: r["count"] for r in df.groupBy("run_index").count().collect()}
    wrong = sorted(r.run_index for r in runs if counts.get(r.run_index, 0) != r.rows)
    if wrong:
        raise ValueError(f"runs {wrong}: table {name} has not the rows that its manifest says")
    return df


def run_study(planned: Sequence[tuple[int, str]], make: Callable[[int, str], Mapping[str, DataFrame]], root: str, spark: SparkSession, after: Callable[[str], None] = lambda step: None) -> int:
    """Makes and commits the planned runs (index, id) that are not committed yet; how many that were."""
    todo = pending(spark.createDataFrame(list(planned), "run_index int, run_id string"), root).orderBy("run_index").collect()  # a row per run
    for r in todo:
        commit_run(make(r.run_index, r.run_id), root, r.run_index, r.run_id, after=after)
    return len(todo)
