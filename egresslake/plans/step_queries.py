"""Step, scenario and figure operators over the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import aggregates as A
from egresslake.operators import figures as G
from egresslake.operators import scenario as C
from egresslake.operators import state as X
from egresslake.operators import trajectory as T
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import RUNS_SQL, TRAJ_SQL, runs, table, traj


def agents(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("agent_id"), (F.pmod(F.col("c_custkey"), F.lit(10)) / 10.0).alias("familiarity"))


def q_initial_beliefs(spark, sf_dir):
    e = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("exit_id"))
    return X.initial_beliefs(agents(spark, sf_dir), e, 42)


def q_hazard_motion(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    h = s.select(F.col("s_suppkey").alias("hazard_id"), (F.col("s_suppkey") % 10).cast("double").alias("x"), (F.col("s_nationkey") % 7).cast("double").alias("y"), F.lit(0.5).alias("vx"), F.lit(-0.25).alias("vy"), F.lit(3.0).alias("radius"), F.lit(-0.2).alias("spread"), F.lit(0.8).alias("severity"), F.lit(0.05).alias("decay"))
    return rounded(X.moved_hazards(h, spark.range(0, 20, 5).select(F.col("id").cast("int").alias("step")), 1.0))


def raster(spark, sf_dir, where):
    return traj(spark, sf_dir).filter(where).groupBy(F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).agg(F.round(F.max("speed") / 20, 6).alias("v"))


def q_ember_field(spark, sf_dir):
    return rounded(X.stamped_field(raster(spark, sf_dir, "k < 50"), raster(spark, sf_dir, "k >= 50"), 0.5), 7)  # halves of six digits have seven


def q_topology_change(spark, sf_dir):
    return X.topology_change(raster(spark, sf_dir, "variant_name = 'click' and k < 20"), raster(spark, sf_dir, "variant_name <> 'click' and k < 5"))


def q_mode_latch(spark, sf_dir):
    t = traj(spark, sf_dir).select("run_id", "agent_id", F.col("event_id").alias("step"), F.floor("x").cast("int").alias("cx"), F.floor("y").cast("int").alias("cy"))
    return X.mode_latch(t, t.filter("cx = cy").select("cx", "cy"))


def q_stage_counts(spark, sf_dir):
    t = traj(spark, sf_dir).select("agent_id", "event_id", (F.col("k") % 2 == 0).alias("receive"), (F.col("k") % 3 == 0).alias("understand"), (F.col("k") % 5 == 0).alias("decide"))
    return X.stage_counts(t, ["agent_id"], "event_id", ["receive", "understand", "decide"]).select("agent_id", "event_id", "receive_count", "understand_count", "decide_count")


def q_best_exit(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("agent_id"), F.col("l_linenumber").alias("exit_id")).agg(F.round(F.avg("l_discount") * 10, 6).alias("prob"), F.round(F.avg("l_tax"), 6).alias("congestion"), F.lit(0.5).alias("freshness"))
    return rounded(X.best_exit(b))


def q_behaviour_state(spark, sf_dir):
    t = traj(spark, sf_dir)
    s = X.next_state(F.when(F.col("k") % 3 == 0, "PANICKED").otherwise("CALM"), F.col("speed") / 3, F.col("k") / 200.0, F.lit(0.5), X.uniform(F.lit(7), "event_id"))
    return t.groupBy(s.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def q_population(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("cohort")).agg(F.count(F.lit(1)).alias("count"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("spawn_id"), (F.col("n_nationkey") % 5).alias("x"), F.floor(F.col("n_nationkey") / 5).alias("y"))
    return C.population(c, s)


def q_sampled(spark, sf_dir):
    d = spark.createDataFrame([(10.0, 0.0, 0.2), (30.0, 0.2, 0.7), (60.0, 0.7, 1.0)], "seconds double, low double, high double")
    return C.sampled(agents(spark, sf_dir), d, 3, "agent_id", "seconds").groupBy("seconds").agg(F.count(F.lit(1)).alias("n"))


def q_bresenham(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = n.select(F.col("n_nationkey").alias("segment_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), (F.col("n_nationkey") * 3 - 30).alias("x1"), (F.col("n_nationkey") * 2 - 17).alias("y1"))
    return C.bresenham(s)


def q_layout_mutation(spark, sf_dir):
    g = spark.range(400).select((F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), F.lit(".").alias("token"))
    return C.mutated(g, raster(spark, sf_dir, "k = 7").select("x", "y", F.lit("X").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def q_keyframes(spark, sf_dir):
    return G.keyframes(traj(spark, sf_dir).select(F.floor(F.col("time_s") / 3600).alias("step")))


def q_occupancy(spark, sf_dir):
    hundredths = traj(spark, sf_dir).withColumn("speed", F.round(F.col("value") * 100).cast("long"))  # whole numbers add up alike in any order
    g = A.cell_grid(hundredths, ["k"]).select(F.col("cx").alias("x"), F.col("cy").alias("y"), "occupancy", F.floor(F.col("mean_speed") * 100).cast("double").alias("speed"))
    return G.occupancy_and_slowdown(g, 1_500_000.0).withColumn("mean_slowdown", F.col("mean_slowdown") / 1e6)


def q_final_exits(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy(F.col("variant_name").alias("run_id"), F.col("status").alias("exit_label"), F.col("seed").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(G.final_exits(r.withColumn("flow_cumulative", F.col("n") + F.col("step") * 100)))


def q_variant_deltas(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("variant_name").agg(F.avg("travel").alias("mean_travel"), F.max("travel").alias("max_travel"))
    return rounded(G.variant_deltas(s, ["mean_travel", "max_travel"], "1-URGENT"), 4)


def q_top_changes(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("variant_name").agg(F.avg("travel").alias("mean_travel"), F.max("travel").alias("max_travel"))
    return rounded(G.top_changes(G.variant_deltas(s, ["mean_travel", "max_travel"], "1-URGENT"), 3).select("variant_name", "metric", "pct_change"), 4)


def q_curve_error(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10).alias("density"), (F.col("l_discount") * 10).alias("speed"))
    return rounded(G.curve_error(li))


def q_specific_flow(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("width_m", 0.8 + (F.col("k") % 5) * 0.2)
    return rounded(G.specific_flow(t.withColumn("width_m", F.round("width_m", 1))), 8)


def q_claim_tier(spark, sf_dir):
    r = runs(spark, sf_dir).select("seed", (F.col("travel") > 0).alias("finished"), (F.col("status") == "P").cast("int").alias("warnings"))
    return G.claim_tier(r, ["finished"], ["warnings"]).withColumn("limitations", F.array_join("limitations", ";"))


def q_delta_ci(spark, sf_dir):
    r = runs(spark, sf_dir).groupBy("variant_name").agg(F.avg("travel").alias("m"), F.coalesce(F.stddev_pop("travel"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
    b = r.filter("variant_name = '1-URGENT'").select(F.col("m").alias("bm"), F.col("s").alias("bs"), F.col("n").alias("bn"))
    j = r.filter("variant_name <> '1-URGENT'").crossJoin(F.broadcast(b))
    return rounded(j.select("variant_name", (F.col("m") - F.col("bm")).alias("delta"), G.delta_ci95(F.col("bs"), F.col("bn"), F.col("s"), F.col("n")).alias("half")), 4)


def q_floor_jumps(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("floor", F.col("k") % 3)
    v = T.zone_visits(t, "floor")
    return v.groupBy("floor").agg(F.count(F.lit(1)).alias("arrivals"))


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_u = "('0x' || substr(md5({0}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
_raster = "SELECT floor(x)::INT AS x, floor(y)::INT AS y, round(max(speed) / 20, 6) AS v FROM traj WHERE {0} GROUP BY 1, 2"
_agents = "agents AS (SELECT c_custkey AS agent_id, (c_custkey % 10) / 10.0::DOUBLE AS familiarity FROM customer)"
_deltas = f"""{RUNS_SQL}, m AS (SELECT variant_name, avg(travel) AS mean_travel, max(travel) AS max_travel FROM runs GROUP BY 1), u AS (UNPIVOT m ON mean_travel, max_travel INTO NAME metric VALUE value),
  d AS (SELECT a.variant_name, metric, a.value, b.value AS base, a.value - b.value AS delta, (a.value - b.value) / nullif(b.value, 0) * 100 AS pct FROM u a JOIN u b USING (metric) WHERE b.variant_name = '1-URGENT' AND a.variant_name <> '1-URGENT')"""
# fmt: off
SQL = {
    "q_initial_beliefs": f"WITH {_agents} SELECT agent_id, r_regionkey AS exit_id FROM agents, region WHERE {_u.format("'42|' || agent_id || '|' || r_regionkey")} < familiarity",
    "q_hazard_motion": """WITH t(step) AS (VALUES (0), (5), (10), (15)) SELECT s_suppkey AS hazard_id, step, round((s_suppkey % 10) + 0.5::DOUBLE * step, 6) AS x, round((s_nationkey % 7) - 0.25::DOUBLE * step, 6) AS y,
      round(greatest(0.0::DOUBLE, 3.0::DOUBLE - 0.2::DOUBLE * step), 6) AS radius, round(least(1.0, greatest(0.0, 0.8::DOUBLE * exp(-0.05::DOUBLE * step))), 6) AS severity FROM supplier, t""",
    "q_ember_field": f"WITH {TRAJ_SQL}, f AS ({_raster.format('k < 50')}), s AS ({_raster.format('k >= 50')}), u AS (SELECT x, y, v * 0.5::DOUBLE AS v FROM f UNION ALL SELECT x, y, v FROM s), g AS (SELECT x, y, least(1.0::DOUBLE, sum(v)) AS v FROM u GROUP BY 1, 2) SELECT x, y, round(v, 7) AS v FROM g WHERE v > 0.01",
    "q_topology_change": f"""WITH {TRAJ_SQL}, b AS (SELECT DISTINCT floor(x)::INT AS x, floor(y)::INT AS y FROM traj WHERE variant_name = 'click' AND k < 20), n AS (SELECT DISTINCT floor(x)::INT AS x, floor(y)::INT AS y FROM traj WHERE variant_name <> 'click' AND k < 5)
      SELECT *, 'closed' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'opened' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM n)""",
    "q_mode_latch": f"WITH {TRAJ_SQL}, t AS (SELECT run_id, agent_id, event_id, floor(x)::INT AS cx, floor(y)::INT AS cy FROM traj) SELECT run_id, agent_id, min(event_id) AS switched_at FROM t WHERE cx = cy GROUP BY 1, 2",
    "q_stage_counts": f"""WITH {TRAJ_SQL} SELECT agent_id, event_id, sum((k % 2 = 0)::INT) OVER w::BIGINT AS receive_count, sum((k % 6 = 0)::INT) OVER w::BIGINT AS understand_count, sum((k % 30 = 0)::INT) OVER w::BIGINT AS decide_count
      FROM traj WINDOW w AS (PARTITION BY agent_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
    "q_best_exit": """WITH b AS (SELECT l_suppkey AS agent_id, l_linenumber AS exit_id, round(avg(l_discount) * 10, 6) AS prob, round(avg(l_tax), 6) AS congestion FROM lineitem GROUP BY 1, 2),
      s AS (SELECT agent_id, exit_id, (prob - congestion) * (1 - 0.3::DOUBLE * 0.5::DOUBLE) AS score FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY score DESC, exit_id DESC) AS n FROM s) SELECT agent_id, exit_id, round(score, 6) AS score FROM r WHERE n = 1""",
    "q_behaviour_state": f"""WITH {TRAJ_SQL}, s AS (SELECT speed / 3 + 0.5::DOUBLE * (k / 200.0::DOUBLE) AS st, k % 3 = 0 AS panic, {_u.format("'7|' || event_id")} AS d FROM traj)
      SELECT CASE WHEN st > 0.8 AND d > 0.5 THEN CASE WHEN d > 0.95 THEN 'FROZEN' ELSE 'PANICKED' END WHEN st > 0.4 THEN 'ANXIOUS' WHEN panic AND st > 0.2 THEN 'PANICKED' ELSE 'CALM' END AS state, count(*) AS n FROM s GROUP BY 1""",
    "q_population": """WITH c AS (SELECT c_mktsegment AS cohort, count(*) AS n FROM customer GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY cohort ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM c),
      a AS (SELECT cohort, b, unnest(range(0, n)) AS i FROM o) SELECT b + i AS agent_id, cohort, i // 4 AS group_id, b + (i // 4) * 4 AS leader_id, ((b + i) % 25 % 5)::INT AS x, (b + i) % 25 // 5 AS y FROM a""",
    "q_sampled": f"WITH {_agents}, u AS (SELECT {_u.format("'3|' || agent_id")} AS u FROM agents) SELECT CASE WHEN u < 0.2 THEN 10.0::DOUBLE WHEN u < 0.7 THEN 30.0::DOUBLE ELSE 60.0::DOUBLE END AS seconds, count(*) AS n FROM u GROUP BY 1",
    "q_bresenham": """WITH s AS (SELECT n_nationkey AS id, n_nationkey * 3 - 30 AS x1, n_nationkey * 2 - 17 AS y1 FROM nation), n AS (SELECT *, greatest(abs(x1), abs(y1)) AS n FROM s), i AS (SELECT *, unnest(range(0, n + 1)) AS i FROM n)
      SELECT id AS segment_id, floor(coalesce(x1 * i / nullif(n, 0)::DOUBLE, 0) + 0.5)::INT AS x, floor(coalesce(y1 * i / nullif(n, 0)::DOUBLE, 0) + 0.5)::INT AS y FROM i""",
    "q_layout_mutation": f"WITH {TRAJ_SQL}, c AS (SELECT DISTINCT floor(x)::INT AS x, floor(y)::INT AS y FROM traj WHERE k = 7) SELECT CASE WHEN c.x IS NULL THEN '.' ELSE 'X' END AS token, count(*) AS n FROM (SELECT (i % 20)::INT AS x, (i // 20)::INT AS y FROM range(400) t(i)) g LEFT JOIN c USING (x, y) GROUP BY 1",
    "q_keyframes": f"WITH {TRAJ_SQL}, s AS (SELECT DISTINCT floor(time_s / 3600)::BIGINT AS step FROM traj), r AS (SELECT step, row_number() OVER (ORDER BY step) AS rn, count(*) OVER () AS n FROM s) SELECT step FROM r WHERE rn IN (1, n // 2 + 1, n)",
    "q_occupancy": f"WITH {TRAJ_SQL}, g AS (SELECT k, floor(x)::INT AS x, floor(y)::INT AS y, count(*) AS o, floor(avg(round(value * 100)::BIGINT) * 100) AS s FROM traj GROUP BY ALL) SELECT x, y, max(o) AS peak_occupancy, avg(greatest(0.0::DOUBLE, 1500000.0::DOUBLE - s)) / 1000000.0::DOUBLE AS mean_slowdown FROM g GROUP BY 1, 2",
    "q_final_exits": f"""WITH {RUNS_SQL}, n AS (SELECT variant_name AS run_id, status AS exit_label, seed AS step, count(*) + seed * 100 AS f FROM runs GROUP BY 1, 2, seed), l AS (SELECT run_id, exit_label, arg_max(f, step)::BIGINT AS flow FROM n GROUP BY 1, 2)
      SELECT run_id, exit_label, flow, round(coalesce(flow / nullif(sum(flow) OVER (PARTITION BY run_id), 0), 0), 6) AS share FROM l""",
    "q_variant_deltas": f"WITH {_deltas} SELECT variant_name, metric, round(value, 4) AS value, round(base, 4) AS base, round(delta, 4) AS delta, round(pct, 4) AS pct_change FROM d",
    "q_top_changes": f"WITH {_deltas} SELECT variant_name, metric, round(pct, 4) AS pct_change FROM d ORDER BY abs(pct) DESC, metric LIMIT 3",
    "q_curve_error": """WITH s AS (SELECT l_quantity / 10 AS density, l_discount * 10 AS speed FROM lineitem), f AS (SELECT speed - CASE WHEN density >= 5.4 THEN 0 ELSE 1.34 * (1 - exp(-1.913 * (1 / density - 1 / 5.4::DOUBLE))) END AS e FROM s WHERE density > 0.01 AND speed > 0.01)
      SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(max(abs(e)), 6) AS max_deviation, sqrt(avg(e * e)) <= 0.2 AS passed FROM f""",
    "q_specific_flow": f"WITH {TRAJ_SQL}, w AS (SELECT round(0.8 + (k % 5) * 0.2, 1)::DOUBLE AS width_m, time_s FROM traj) SELECT width_m, count(*) AS n, round(max(time_s) - min(time_s), 8) AS span, round(count(*) / (max(time_s) - min(time_s)) / width_m, 8) AS specific_flow FROM w GROUP BY 1",
    "q_claim_tier": f"""WITH {RUNS_SQL}, g AS (SELECT count(DISTINCT seed) AS seeds, bool_and(travel > 0) AS finished, sum((status = 'P')::INT)::BIGINT AS warnings FROM runs)
      SELECT seeds, finished, warnings, CASE WHEN finished AND warnings = 0 AND seeds >= 20 THEN 'benchmark_grade' WHEN finished AND warnings = 0 THEN 'diagnostic' ELSE 'smoke' END AS tier,
      concat_ws(';', CASE WHEN NOT finished THEN 'missing:finished' END, CASE WHEN warnings > 0 THEN 'issues:warnings' END, CASE WHEN seeds < 20 THEN 'few_seeds' END) AS limitations FROM g""",
    "q_delta_ci": f"""WITH {RUNS_SQL}, r AS (SELECT variant_name, avg(travel) AS m, stddev_pop(travel) AS s, count(*) AS n FROM runs GROUP BY 1)
      SELECT a.variant_name, round(a.m - b.m, 4) AS delta, round(1.96 * sqrt(b.s * b.s / b.n + a.s * a.s / a.n), 4) AS half FROM r a, r b WHERE b.variant_name = '1-URGENT' AND a.variant_name <> '1-URGENT'""",
    "q_floor_jumps": f"""WITH {TRAJ_SQL}, n AS (SELECT k % 3 AS floor, coalesce(k % 3 <> lag(k % 3) OVER (PARTITION BY agent_id ORDER BY time_s, event_id), true) AS new FROM traj) SELECT floor, count(*) AS arrivals FROM n WHERE new GROUP BY 1""",
}
# fmt: on
