"""Telemetry views over the harness tables: the same arithmetic in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_S = 3600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    """Seconds since 2024-01-01 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts})") / F.lit(1_000_000.0)


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trajectory samples: agent_id, event_id, time_s, x, y, speed, variant_name, run_id, k, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("agent_id"), "event_id", seconds().alias("time_s"),
        (F.pmod(F.col("event_id") * 37, F.lit(101)).cast("double") / F.lit(10.0)).alias("x"),
        (F.pmod(F.col("event_id") * 53, F.lit(97)).cast("double") / F.lit(10.0)).alias("y"),
        (F.col("value") / F.lit(100.0)).alias("speed"), F.col("event_type").alias("variant_name"),
        F.concat(F.lit("run_"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
    )


TRAJ_SQL = """traj AS (
  SELECT user_id AS agent_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS time_s,
         ((event_id * 37) % 101)::DOUBLE / 10.0::DOUBLE AS x, ((event_id * 53) % 97)::DOUBLE / 10.0::DOUBLE AS y,
         value / 100.0::DOUBLE AS speed, event_type AS variant_name, 'run_' || (user_id % 5)::VARCHAR AS run_id,
         json_extract(props, '$.k')::INT AS k, value
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as run rows: variant_name, seed, run_id, travel (the metric), status."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("variant_name"), (F.col("o_custkey") % 20).alias("seed"), F.col("o_orderkey").alias("run_id"),
        F.col("o_totalprice").alias("travel"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"),
    )


RUNS_SQL = """runs AS (
  SELECT o_orderpriority AS variant_name, o_custkey % 20 AS seed, o_orderkey AS run_id, o_totalprice AS travel,
         o_orderstatus AS status, o_orderdate AS day FROM orders)"""


#: Cells of a building's side, and columns from one building to the next.
SIDE, PITCH = 10, 12


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as cells (x, y, walkable, building, cell_key): a hundred orders are a building of ten by ten cells, open along its border, with walls inside."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    b, lx, ly = F.floor(k / (SIDE * SIDE)).cast("int"), (k % SIDE).cast("int"), F.floor(k % (SIDE * SIDE) / SIDE).cast("int")
    border = lx.isin(0, SIDE - 1) | ly.isin(0, SIDE - 1)
    return o.select((b * PITCH + lx).alias("x"), ly.alias("y"), (border | ((k * 7 + F.col("o_custkey") * 11) % 5 != 0)).alias("walkable"), b.alias("building"), k.alias("cell_key"))


def doors(cells: DataFrame) -> DataFrame:
    """Two cells of each building."""
    lx = F.col("x") % PITCH
    return cells.filter(((lx == SIDE - 1) & (F.col("y") == SIDE - 1)) | ((lx == 0) & (F.col("y") == 4))).select("x", "y")


BUILDINGS_SQL = f"""g AS (SELECT (o_orderkey // {SIDE * SIDE} * {PITCH} + o_orderkey % {SIDE})::INT AS x, (o_orderkey % {SIDE * SIDE} // {SIDE})::INT AS y, (o_orderkey // {SIDE * SIDE})::INT AS building, o_orderkey AS cell_key,
  o_orderkey % {SIDE} IN (0, {SIDE - 1}) OR o_orderkey % {SIDE * SIDE} // {SIDE} IN (0, {SIDE - 1}) OR (o_orderkey * 7 + o_custkey * 11) % 5 <> 0 AS walkable FROM orders)"""
DOORS_SQL = f"doors AS (SELECT x, y FROM g WHERE (x % {PITCH} = {SIDE - 1} AND y = {SIDE - 1}) OR (x % {PITCH} = 0 AND y = 4))"
EDGES_SQL = "e AS (SELECT a.x AS sx, a.y AS sy, b.x AS tx, b.y AS ty FROM g a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy WHERE a.walkable AND b.walkable)"
