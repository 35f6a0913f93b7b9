"""Study bundles: sixteen tables and metadata in a directory, Parquet first and CSV else."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.operators.audits import chained_calls
from egresslake.operators.aggregates import summary_levels
from egresslake.schemas import TABLES, empty, schema


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a bundle with its declared types; further columns pass through; a missing table is empty."""
    base = f"{folder}/tables/{name}"
    if exists(spark, f"{base}.parquet"):
        df = spark.read.parquet(f"{base}.parquet")
    elif exists(spark, f"{base}.csv"):
        df = spark.read.option("header", True).csv(f"{base}.csv")
    else:
        return empty(spark, name)
    known = {f.name: f.dataType for f in schema(name)}
    cast = [F.col(c).try_cast(known[c]).alias(c) if c in known else F.col(c) for c in df.columns]
    return empty(spark, name).unionByName(df.select(*cast), allowMissingColumns=True)


@dataclass
class StudyBundle:
    """Metadata and tables of a study."""

    tables: dict[str, DataFrame]
    metadata: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> StudyBundle:
        meta = {}
        if exists(spark, f"{folder}/metadata.json"):
            meta = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/metadata.json", wholetext=True).collect()))
        return cls({t: read_table(spark, folder, t) for t in TABLES}, meta)

    def export(self, folder: str, formats: Iterable[str] = ("parquet", "csv")) -> None:
        """Writes every table; Parquet by variant and run, CSV with a header even when empty."""
        for name, df in self.tables.items():
            df = chained_calls(df) if name == "llm_calls" else df
            if "parquet" in formats:
                df.write.mode("overwrite").parquet(f"{folder}/tables/{name}.parquet")
            if "csv" in formats:
                (df if df.limit(1).count() else df.coalesce(1)).write.mode("overwrite").option("header", True).csv(f"{folder}/tables/{name}.csv")
        spark = next(iter(self.tables.values())).sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/metadata.json")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(json.dumps(self.metadata, sort_keys=True, indent=1).encode()))
        out.close()

    def with_aggregates(self, metrics: list[str]) -> DataFrame:
        """Run rows of the summary and its variant and study rows."""
        runs = self.tables["summary"].filter("record_type = 'run'")
        return runs.unionByName(summary_levels(runs, "variant_name", metrics), allowMissingColumns=True)


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that one lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def resolve_seeds(variant: list[int] | None, study: list[int] | None, repetitions: int) -> list[int]:
    return variant or study or [42 + i for i in range(repetitions)]


def pending_runs(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned runs that no finished checkpoint has."""
    return planned.join(manifest.filter("finished").select("run_id"), "run_id", "left_anti")


def write_checkpoint(tables: dict[str, DataFrame], root: str, run_index: int) -> None:
    """One run's tables; the manifest is written last, so a run without one did not finish."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/runs/{run_index}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(run_index, sorted(tables), True)], "run_index int, tables array<string>, finished boolean").coalesce(1).write.mode("overwrite").json(f"{root}/runs/{run_index}/manifest.json")
