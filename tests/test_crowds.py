"""Very many rows of one key, place or span of time: pairs of them would be billions."""

from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from egresslake.operators import movement, spatial

N = 60_000


def test_first_in_interval_of_a_crowded_span(spark):
    left = spark.range(N).select(F.lit("r").alias("run"), "id", (F.col("id") % 5000 / 8).alias("t"))
    right = spark.range(N).select(F.lit("r").alias("run"), (N - F.col("id")).alias("id"), (F.col("id") * 7 % 3001 / 4 + 30).alias("t"))
    rows = spatial.interval_first(left, right, "t", "t", 100.0, ["run"], "id", "id").collect()
    first = {}
    for i in range(N):
        t = i * 7 % 3001 / 4 + 30
        first[t] = min(first.get(t, N), N - i)
    times = sorted(first)
    want = {}
    for i in range(N):
        t = i % 5000 / 8
        k = bisect_left(times, t - 100)
        if k < len(times) and times[k] <= t + 100:
            want[i] = (first[times[k]], times[k] - t)
    assert {r.id: (r.match_id, r.gap) for r in rows} == want and len(rows) == len(want)


def test_nearest_in_time_of_one_key(spark):
    events = spark.range(2 * N).select(F.lit("r").alias("run"), F.col("id").alias("agent"), (F.col("id") / 16).alias("t"))
    samples = spark.range(2 * N).select(F.lit("r").alias("run"), (F.col("id") * 3 / 4 + 5).alias("s"))
    rows = spatial.nearest_in_time(events, samples, "t", "s", ["run"], "agent").select("agent", "nearest_s").collect()
    times = [i * 3 / 4 + 5 for i in range(2 * N)]

    def nearest(t):
        k = bisect_left(times, t)
        return min((abs(s - t), s) for s in times[max(0, k - 1) : k + 1])[1]

    assert {r.agent: r.nearest_s for r in rows} == {i: nearest(i / 16) for i in range(2 * N)}


def test_density_of_a_crowded_place(spark):
    s = spark.range(N).select(F.lit(1).alias("k"), "id", F.when(F.col("id") < 3, F.col("id") * 1.0).otherwise(9.0).alias("x"), F.lit(0.0).alias("y"))
    rows = {r.id: r.neighbours for r in spatial.local_density(s, 1.5, ["k"], "id").collect()}
    assert [rows[i] for i in range(4)] == [1, 2, 1, N - 4] and len(rows) == N


def test_force_in_a_crowd_of_few_states(spark):
    a = spark.range(N).select(F.col("id").alias("agent_id"), F.when(F.col("id") == 0, 0.0).otherwise(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), F.lit(1.0).alias("dvx"), F.lit(0.0).alias("dvy"))
    p = movement.Forces(max_speed_multiplier=1e9)
    few = movement.social_force_step(a.filter("agent_id < 2"), None, 0.1, p).filter("agent_id = 0").first()
    many = movement.social_force_step(a, None, 0.1, p).filter("agent_id = 0").first()
    drive = 0.1 / p.relaxation_time_s
    assert many.vx - drive == pytest.approx((few.vx - drive) * (N - 1)) and few.vx != drive


def test_near_pairs_of_crowded_places(spark, sf, tmp_path):
    """Events of one place are members of it; pairs of places stand for all their pairs."""
    from egresslake.plans import structure_queries, views

    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_id < 60")
    e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(*[(F.col("event_id") + F.col("i") * 101 * 97).alias(c) if c == "event_id" else F.lit('{"k": 1}').alias(c) if c == "props" else c for c in e.columns]).write.parquet(f"{tmp_path}/events.parquet")
    t = {r.event_id: (r.x, r.y) for r in views.traj(spark, str(tmp_path)).collect()}
    rows = structure_queries.q_proximity_pairs(spark, str(tmp_path)).collect()
    member = {i: {i} for i in t}
    for r in rows:
        if not r.distance:
            member[r.a].add(r.b)
            del member[r.b]
    found = {(min(i, j), max(i, j)) for r in rows if r.distance for i in member[r.a] for j in member[r.b]}
    want = {(i, j) for i in t for j in t if i < j and 1e-6 < ((t[i][0] - t[j][0]) ** 2 + (t[i][1] - t[j][1]) ** 2) ** 0.5 <= 0.5}
    assert found == want and want and len(rows) == sum(1 for r in rows if r.distance) + len(t) - 60
