"""Writers for other tools, and the shapes that they want."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def external_frame(df: DataFrame, rate_hz: float = 10.0) -> DataFrame:
    """(id, frame, time_s, x, y, z = 0): frames by rounding to even."""
    return df.select(F.col("agent_id").alias("id"), F.rint(F.col("time_s") * rate_hz).cast("long").alias("frame"), "time_s", "x", "y", F.lit(0.0).alias("z"))


def write_jupedsim(df: DataFrame, path: str, rate_hz: float = 10.0) -> None:
    external_frame(df, rate_hz).select("id", "frame", "x", "y", "z").orderBy("frame", "id").write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_vadere(df: DataFrame, path: str, rate_hz: float = 10.0) -> None:
    e = external_frame(df, rate_hz).orderBy("time_s", "id")
    e.select(F.col("frame").alias("timeStep"), F.col("id").alias("pedestrianId"), F.col("time_s").alias("simTime"), "x", "y").write.mode("overwrite").option("header", True).csv(path)


def write_pedpy(df: DataFrame, path: str, rate_hz: float = 10.0) -> None:
    external_frame(df, rate_hz).select(F.col("id").alias("pedestrian_id"), "frame", "time_s", "x", "y").write.mode("overwrite").option("header", True).csv(path)


def write_sqlite(df: DataFrame, path: str) -> int:
    """Streams rows (id, frame, x, y) into a local SQLite file, a partition at a time; returns their number."""
    names = {"agent_id": "id", "step": "frame", "pos_x": "x", "pos_y": "y"}
    d = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns}).select("id", "frame", "x", "y")
    Path(path).unlink(missing_ok=True)
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE trajectory_data (id INTEGER, frame INTEGER, x REAL, y REAL)")
        con.executemany("INSERT INTO trajectory_data VALUES (?, ?, ?, ?)", (tuple(r) for r in d.toLocalIterator()))
        con.execute("CREATE INDEX by_id_frame ON trajectory_data (id, frame)")
        return con.execute("SELECT count(*) FROM trajectory_data").fetchone()[0]


def finite(c: Column) -> Column:
    """NULL for NaN and infinities, which JSON cannot hold."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def viewer_frames(steps: DataFrame, max_frames: int = 500) -> DataFrame:
    """(step, agents JSON) for at most max_frames steps: every n-th and the last."""
    s = steps.select("step").distinct()
    n = s.count()
    stride = max(1, -(-n // max_frames))
    w = Window.orderBy("step")
    picked = s.withColumn("rn", F.row_number().over(w)).filter(((F.col("rn") - 1) % stride == 0) | (F.col("rn") == n)).select("step")
    agent = F.struct("agent_id", finite(F.col("x")).alias("x"), finite(F.col("y")).alias("y"), finite(F.col("speed")).alias("speed"))
    return steps.join(picked, "step", "left_semi").groupBy("step").agg(F.to_json(F.array_sort(F.collect_list(agent))).alias("agents"))


def exploded_traces(df: DataFrame, trace: str = "trace") -> DataFrame:
    """One row per point of each agent's trace, with its index."""
    return df.select(*[c for c in df.columns if c != trace], F.posexplode(trace).alias("index", "p")).select("*", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).drop("p")


def write_steps(steps: DataFrame, path: str, order: tuple[str, ...] = ("run_id", "step")) -> None:
    """Steps as JSON lines in order; numbers that JSON cannot hold become null."""
    cols = [finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in steps.dtypes]
    steps.select(*cols).orderBy(*[c for c in order if c in steps.columns]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(df_or_spark: DataFrame | SparkSession, document: Mapping, path: str) -> None:
    """A small document (a fit, a verdict) as one JSON file in a folder, keys sorted."""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    spark.createDataFrame([(json.dumps(document, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def export_comparison(rows: DataFrame, folder: str, base: str, variant: str) -> None:
    """Comparison rows (metric, ...) as Parquet and CSV, and which studies they are of."""
    rows.write.mode("overwrite").parquet(f"{folder}/comparison.parquet")
    rows.orderBy("metric").write.mode("overwrite").option("header", True).csv(f"{folder}/comparison.csv")
    write_document(rows, {"baseline": base, "variant": variant, "metrics": rows.count()}, f"{folder}/comparison.json")


def write_flow_report(curves: DataFrame, folder: str, most: float = 0.25) -> dict:
    """figures.flow_curve_error rows as CSV and the verdict: widths, rmse, whether it is at most `most`."""
    curves.write.mode("overwrite").option("header", True).csv(f"{folder}/specific_flow_comparison.csv")
    got = curves.agg(F.count(F.lit(1)).alias("n"), F.max("rmse").alias("rmse")).first()
    verdict = {"widths": int(got["n"]), "rmse_specific_flow_ped_m_s": got["rmse"], "threshold": most, "ok": bool(got["n"]) and got["rmse"] <= most}
    write_document(curves, verdict, f"{folder}/specific_flow_summary.json")
    return verdict
