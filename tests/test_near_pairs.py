"""Pairs of near rows: none is left out, wherever rows lie and however many share a place."""

from math import sqrt

import duckdb
import pytest
from pyspark.sql import functions as F

from egresslake.operators import spatial
from egresslake.plans import structure_queries


def near(points, radius, least=0.0):
    """By brute force: (i, j) of points (i, x, y)."""
    return {(i, j) for i, x, y in points for j, u, v in points if i < j and least < sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= radius}


@pytest.mark.parametrize("radius", [0.5, 0.1, 0.3])
def test_no_pair_is_lost_at_the_edges_of_buckets(spark, radius):
    """Distances that are the radius only after rounding; places far away and beyond numbers."""
    steps = [-1e-20, 1e-17, *[n * radius for n in range(-4, 40)], *[n / 10 for n in range(-9, 30)]]
    points = [(n, x, 0.0) for n, x in enumerate(steps)] + [(1000, 1e300, 0.0), (1001, float("inf"), 0.0), (1002, float("nan"), 0.0), (1003, 1e300, 0.0)]
    df = spark.createDataFrame(points, "i long, x double, y double")
    want = near(points, radius, 1e-300)
    assert {(r.l_i, r.r_i) for r in spatial.radius_pairs(df, df, radius, least=1e-300).filter("l_i < r_i").collect()} == want
    rows = [(r.a, r.b) for r in spatial.near_pairs(df, radius, [], "i", least=1e-300).collect()]
    assert set(rows) == want and len(rows) == len(want)
    if radius == 0.5:
        assert (0, 1 + steps[1:].index(0.5)) in want  # buckets as wide as the radius would be two apart


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_of_a_crowded_bucket(spark, block):
    """Blocks of one bucket and of its neighbours all meet, once."""
    k = F.col("id")
    df = spark.range(400).select((k % 2).alias("k"), k.alias("i"), F.when(k % 5 == 0, 0.0).otherwise(k % 37 / 8).alias("x"), F.when(k % 5 == 0, 0.0).otherwise(k % 11 / 8).alias("y"))
    points = {g: [(r.i, r.x, r.y) for r in df.filter(k % 2 == g).withColumnRenamed("id", "i").collect()] for g in (0, 1)}
    rows = [(r.k, r.a, r.b) for r in spatial.near_pairs(df, 0.5, ["k"], "i", block=block).collect()]
    want = {(g, i, j) for g in (0, 1) for i, j in near(points[g], 0.5, -1.0)}
    assert set(rows) == want and len(rows) == len(want)

def test_all_pairs_of_events(spark, sf, tmp_path):
    """Events of one place each have their pairs with all near events; the SQL gives the same."""
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_id < 60")
    many = e.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("event_id", F.col("event_id") + F.col("n") * 101 * 97).withColumn("props", F.when(F.col("event_id") % 7 > 0, F.lit('{"k": 1}')))
    many.drop("n").write.parquet(f"{tmp_path}/events.parquet")
    rows = sorted(tuple(r) for r in structure_queries.q_proximity_pairs(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows == sorted(c.execute(structure_queries.SQL["q_proximity_pairs"]).fetchall())
    points = [(i, (i * 37) % 101 / 10, (i * 53) % 97 / 10) for r in e.collect() for i in (r.event_id, r.event_id + 9797, r.event_id + 2 * 9797) if i % 7]
    assert {(a, b) for _, a, b, _ in rows} == near(points, 0.5, 1e-6) and len(rows) > 60
