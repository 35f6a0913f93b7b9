"""Movement, belief and choice operators over the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import movement as M
from egresslake.operators import spatial as P
from egresslake.operators.graph import edges
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import BUILDINGS_SQL, EDGES_SQL, TRAJ_SQL, buildings, table, traj


def walkers(spark, sf_dir):
    """customer as agents at whole multiples of a quarter metre."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("agent_id"), ((k * 37 % 160) / 4).alias("x"), ((k * 53 % 160) / 4).alias("y"), (k % 40).cast("int").alias("release_step"), (k % 6 == 0).alias("evacuated"), F.col("c_mktsegment").alias("cohort_name"),
        F.concat(F.lit("M"), (k % 3).cast("string")).alias("mobility_class"), F.when(k % 4 == 0, "Senior").otherwise("adult").alias("age_band"), (2 + k % 3).cast("double").alias("vision_radius"),
        (k % 30).alias("family_id"), F.when(k % 7 != 0, k % 5).alias("target_exit"), (k % 64 / 64).alias("entropy"),
    )


_walkers = """walkers AS (SELECT c_custkey AS agent_id, (c_custkey * 37 % 160) / 4.0::DOUBLE AS x, (c_custkey * 53 % 160) / 4.0::DOUBLE AS y, (c_custkey % 40)::INT AS release_step, c_custkey % 6 = 0 AS evacuated, c_mktsegment AS cohort_name,
  'M' || (c_custkey % 3) AS mobility_class, CASE WHEN c_custkey % 4 = 0 THEN 'Senior' ELSE 'adult' END AS age_band, (2 + c_custkey % 3)::DOUBLE AS vision_radius, c_custkey % 30 AS family_id, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 END AS target_exit, (c_custkey % 64) / 64.0::DOUBLE AS entropy FROM customer)"""


def places(spark, sf_dir):
    """nation as exits or hazards at half metres."""
    n = F.col("n_nationkey")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("GAS", "smoke", "FIRE", "FLOOD", "SHOOTER", "CROWD")]), (n % 6 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(
        n.cast("long").alias("exit_id"), (n * 7 % 40).cast("double").alias("tx"), (n * 11 % 40).cast("double").alias("ty"), (n * 7 % 40).cast("double").alias("hx"), (n * 11 % 40).cast("double").alias("hy"), (n % 5 + 2).cast("double").alias("radius"),
        ((n % 4 + 1) / 4).alias("severity"), kinds.alias("kind"), (n % 3 / 2).alias("depth_m"), F.lit(0.5).alias("threshold_m"), F.concat(F.lit("exit_"), n.cast("string")).alias("exit_label"), F.lit("g").alias("floor_id"),
        (n * 7 % 40).cast("int").alias("x"), (n * 11 % 40).cast("int").alias("y"),
    )


_places = """places AS (SELECT n_nationkey::BIGINT AS exit_id, (n_nationkey * 7 % 40)::DOUBLE AS tx, (n_nationkey * 11 % 40)::DOUBLE AS ty, (n_nationkey % 5 + 2)::DOUBLE AS radius, (n_nationkey % 4 + 1) / 4.0::DOUBLE AS severity,
  (['GAS', 'smoke', 'FIRE', 'FLOOD', 'SHOOTER', 'CROWD'])[n_nationkey % 6 + 1] AS kind, (n_nationkey % 3) / 2.0::DOUBLE AS depth, 'exit_' || n_nationkey AS label FROM nation)"""
_fall = "CASE WHEN {d} <= radius THEN least(1.0, severity * (1 - {d} / radius)) ELSE 0 END"
_dist = "sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))"


def q_agent_states(spark, sf_dir):
    a = walkers(spark, sf_dir)
    return a.agg(F.count_if(M.active(20)).alias("active"), F.count_if(M.pending(20)).alias("pending"), F.count_if(M.released(20)).alias("released"))


def cells(spark):
    return spark.range(1600).select((F.col("id") % 40).cast("int").alias("x"), F.floor(F.col("id") / 40).cast("int").alias("y"), F.lit("g").alias("floor_id"), (F.col("id") % 9 != 0).alias("walkable"))


def q_open_cells(spark, sf_dir):
    """Cells of buildings that stay open where every thirteenth is shut."""
    g = buildings(spark, sf_dir).withColumn("floor_id", F.lit("g"))
    return M.open_cells(g, g.filter("cell_key % 13 = 0")).groupBy("building").agg(F.count(F.lit(1)).alias("n"))


def q_open_edges(spark, sf_dir):
    """Edges of buildings that stay open where some edges and some cells are shut."""
    g = buildings(spark, sf_dir)
    e = edges(g).select("sx", "sy", "tx", "ty")
    return M.open_edges(e, e.filter("(sx * 3 + ty * 5) % 7 = 0"), g.filter("cell_key % 13 = 0"))

def q_persona_match(spark, sf_dir):
    p = spark.createDataFrame([("a", "BUILDING", "m1", ""), ("b", "", "M2", "SENIOR"), ("c", "", "", "Adult")], "persona_id string, cohort_name string, mobility_class string, age_band string")
    return M.persona_match(walkers(spark, sf_dir), p).groupBy("persona_id").agg(F.count(F.lit(1)).alias("n"), F.sum("agent_id").alias("ids"))


def q_impossible_jumps(spark, sf_dir):
    t = traj(spark, sf_dir).select("run_id", "agent_id", F.col("event_id").alias("step"), F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"), (F.col("k") % 2).alias("floor_id"))
    c = t.filter("step % 3 = 0").select(F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("x") + 2).alias("tx"), (F.col("y") - 1).alias("ty")).distinct()
    return M.floor_jumps(t, c, t.filter("step % 5 = 0"), ["agent_id"]).groupBy("to_floor_id").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("steps"))


def q_speed_density_pairs(spark, sf_dir):
    m = traj(spark, sf_dir).groupBy("k").agg(F.count_if(F.col("x") < 5).alias("n_in_region"), (F.count_if(F.col("x") < 2) / 64).alias("density"))
    return M.speed_density_pairs(m).select("k", "n_in_region", "density")


def q_zone_lookup(spark, sf_dir):
    t = traj(spark, sf_dir).select("event_id", F.lit("g").alias("floor_id"), F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"))
    z = spark.range(30).select(F.lit("g").alias("floor_id"), (F.col("id") % 10).cast("int").alias("x"), (F.col("id") % 3 + 2).cast("int").alias("y"), F.concat(F.lit("bn_"), (F.col("id") % 3).cast("string")).alias("zone_id"))
    return M.zone_of(t, z).groupBy("zone_id").agg(F.count(F.lit(1)).alias("n"))


def q_zone_distance(spark, sf_dir):
    z = places(spark, sf_dir).select(F.when(F.col("exit_id") % 5 == 0, "up").otherwise("g").alias("floor_id"), "x", "y", (F.col("exit_id") % 4).alias("zone_id"))
    return M.zone_distance(cells(spark).filter("walkable"), z).groupBy("zone_id").agg(F.sum("distance").alias("total"), F.max("distance").alias("most"))


def q_visible_pairs(spark, sf_dir):
    v = M.visible_pairs(walkers(spark, sf_dir), places(spark, sf_dir), "exit_id")
    return rounded(v.groupBy("exit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("agent_id").alias("ids"), F.max("distance").alias("farthest")))


def q_beacon_news(spark, sf_dir):
    b = places(spark, sf_dir).filter("exit_id % 3 = 0").select(F.col("exit_id").alias("beacon_id"), "tx", "ty", F.array(F.col("exit_id") % 5, F.lit(1).cast("long")).alias("exits"))
    w = walkers(spark, sf_dir)
    held = w.select("agent_id", (F.col("agent_id") % 5).alias("exit_id"), (F.col("agent_id") % 10 / 10).alias("source_credibility"))
    return M.beacon_news(w, b, held, 6.0).groupBy("exit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("agent_id").alias("ids"))


def q_exit_aliases(spark, sf_dir):
    f = walkers(spark, sf_dir).groupBy(F.concat(F.lit("exit_"), (F.col("agent_id") % 30).cast("string")).alias("exit_label")).agg(F.count(F.lit(1)).alias("n"))
    return M.exit_usage(f, places(spark, sf_dir))


def q_cohort_exit_usage(spark, sf_dir):
    a = walkers(spark, sf_dir).withColumn("evacuated_via", F.when(F.col("agent_id") % 11 != 0, F.concat(F.lit("exit_"), (F.col("agent_id") % 4).cast("string"))))
    return M.cohort_exit_usage(a, places(spark, sf_dir))


def q_provenance_checks(spark, sf_dir):
    k = F.col("agent_id")
    r = walkers(spark, sf_dir).select(k.alias("record_id"), "x", "y", F.when(k % 3 == 0, k % 50).alias("claim_exit"), F.when(k % 3 == 0, F.col("x") + k % 4).alias("ex"), F.when(k % 3 == 0, F.col("y")).alias("ey"),
                                      F.when(k % 2 == 0, F.col("x") + k % 5).alias("hx"), F.when(k % 2 == 0, F.col("y")).alias("hy"))
    return M.provenance_checks(r, places(spark, sf_dir), places(spark, sf_dir), 3.0).groupBy("supported").agg(F.count(F.lit(1)).alias("n"), F.sum("record_id").alias("ids"))


def q_family_targets(spark, sf_dir):
    return rounded(M.family_targets(walkers(spark, sf_dir)).groupBy("exit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("agent_id").alias("ids"), F.max("share").alias("most")))


def q_shooter_pressure(spark, sf_dir):
    w = walkers(spark, sf_dir)
    h = places(spark, sf_dir).filter("exit_id < 5")
    pairs = M.visible_pairs(w.withColumn("vision_radius", F.lit(12.0)), h, "exit_id").join(w.select("agent_id", "x", "y"), "agent_id").join(h.select("exit_id", "tx", "ty"), "exit_id")
    pairs = pairs.select(F.concat_ws("|", "agent_id", "exit_id").alias("pair_id"), "agent_id", F.col("exit_id").alias("hostile_id"), "distance", F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    seen = P.line_of_sight(pairs, cells(spark).filter("not walkable"), 12.0)
    s = pairs.join(seen, "pair_id").withColumn("range_m", F.lit(10.0))
    return rounded(M.shooter_pressure(s).groupBy("hostile_id").agg(F.count(F.lit(1)).alias("n"), F.sum("visible").alias("visible"), F.max("distance").alias("farthest")))


def q_dose_loads(spark, sf_dir):
    d = M.dose_loads(walkers(spark, sf_dir), places(spark, sf_dir), ["agent_id"])
    return rounded(d.agg(*[F.sum(c).alias(c) for c in d.columns if c.endswith("_load")], F.sum("flood_depth_m").alias("flood_depth_m")), 5)


def q_belief_accuracy(spark, sf_dir):
    w, p = walkers(spark, sf_dir), places(spark, sf_dir)
    b = w.select("agent_id", F.explode(F.array(F.col("agent_id") % 7, F.col("agent_id") % 3 + 30)).alias("exit_id")).distinct().withColumn("prob", (F.col("agent_id") + F.col("exit_id")) % 64 / 64)
    hb = w.filter("agent_id % 4 <> 0").select("agent_id", F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("agent_id") % 16 / 16).alias("severity_est"))
    a = M.belief_accuracy(b, p.filter("exit_id < 7"), hb, p.filter("exit_id >= 15"), w)
    return rounded(a.groupBy((F.col("agent_id") % 10).alias("g")).agg(F.sum("belief_accuracy").alias("total"), F.count(F.lit(1)).alias("n")), 5)


def q_entropy_summary(spark, sf_dir):
    s = M.entropy_summary(walkers(spark, sf_dir), ["cohort_name"])
    return rounded(s.withColumn("efficiency", M.information_efficiency(F.lit(0.75), F.col("global_entropy"))))


def q_profile_similarity(spark, sf_dir):
    w = walkers(spark, sf_dir)
    mine = F.create_map(F.lit("cohort"), F.col("cohort_name"), F.lit("age"), F.col("age_band"), F.lit("own"), F.lit("x"))
    other = F.create_map(F.lit("cohort"), F.lit("building"), F.lit("age"), F.when(F.col("agent_id") % 2 == 0, "SENIOR").otherwise("child"))
    return w.groupBy(M.profile_similarity(mine, other).alias("similarity")).agg(F.count(F.lit(1)).alias("n"))


def q_perceived_hazard(spark, sf_dir):
    k = F.col("agent_id")
    held = F.array(F.struct((F.col("x") + 1).alias("bx"), F.col("y").alias("by"), F.lit(4.0).alias("radius_est"), (k % 8 / 8).alias("severity_est")), F.struct(F.col("x").alias("bx"), (F.col("y") + k % 3 / 2).alias("by"), F.lit(0.0).alias("radius_est"), F.lit(0.5).alias("severity_est")))
    w = walkers(spark, sf_dir).select((k % 24).alias("g"), M.perceived_hazard(F.col("x"), F.col("y"), held).alias("h"), M.belief_penalty(F.col("x"), F.col("y"), held).alias("p"))
    return rounded(w.groupBy("g").agg(F.max("h").alias("hazard"), F.max("p").alias("penalty")))


def q_edge_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "elevator").otherwise("stairs")
    c = M.connector_weight(kind, F.col("l_linenumber") * 3.0, F.lit(2.0), F.col("l_quantity"), F.lit(0.5))
    e = M.edge_weight(F.lit(1.0), F.col("l_quantity") / 32, F.col("l_linenumber") / 4, F.col("l_linenumber") == 7)
    return li.groupBy("l_returnflag", "l_linenumber").agg(F.sum(c).alias("connector"), F.sum(F.when(F.col("l_linenumber") < 7, e)).alias("edge"), F.bool_and(e == float("inf")).alias("blocked"))


def q_scored_exit(spark, sf_dir):
    w, p = walkers(spark, sf_dir), places(spark, sf_dir)
    agents = w.select("agent_id", "x", "y", F.create_map(F.lit("age"), F.col("age_band")).alias("profile"), F.lit(0.25).alias("homophily_weight"), F.lit(1.0).alias("herding"), F.lit(1.0).alias("exit_affinity"))
    exits = p.filter("exit_id < 5").select("exit_id", "tx", "ty", F.create_map(F.lit("age"), F.when(F.col("exit_id") % 2 == 0, "senior").otherwise("ADULT")).alias("profile"))
    b = w.select("agent_id").crossJoin(F.broadcast(exits.select("exit_id"))).select("agent_id", "exit_id", ((F.col("agent_id") * 3 + F.col("exit_id") * 5) % 16 / 16).alias("prob"), F.lit(0.125).alias("congestion"), F.lit(0.5).alias("freshness"))
    return M.scored_exit(b, agents, exits, M.family_targets(w)).groupBy("exit_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


def q_social_force(spark, sf_dir):
    k = F.col("agent_id")
    a = walkers(spark, sf_dir).select("agent_id", "x", "y", (k % 5 / 4).alias("vx"), (k % 3 / 4).alias("vy"), F.when(k % 2 == 0, 1.25).otherwise(-1.25).alias("dvx"), F.lit(0.25).alias("dvy"))
    walls = places(spark, sf_dir).select(F.col("tx").alias("wx"), F.col("ty").alias("wy"))
    s = M.social_force_step(a, walls, 0.1, counter_flow=True)
    return rounded(s.groupBy((F.col("agent_id") % 10).alias("g")).agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"), F.max(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)).alias("fastest")), 5)


def q_aftershocks(spark, sf_dir):
    s = places(spark, sf_dir).select(F.col("exit_id").alias("shock_id"), (F.col("exit_id") % 4).cast("int").alias("step"), F.col("tx").alias("hx"), F.col("ty").alias("hy"), "radius", F.col("severity").alias("magnitude"))
    before = cells(spark).filter("x = y").select("x", "y", F.lit(0.25).alias("v"))
    after, _ = M.aftershocks(s, spark.createDataFrame([(1,), (2,)], "step int"), before)
    return rounded(after, 6)


def q_hazard_samples(spark, sf_dir):
    h = places(spark, sf_dir).select("hx", "hy", "radius", "severity", (F.col("exit_id") % 2 == 0).alias("height_aware"), F.lit(1.0).alias("z_low"), (1.0 + F.col("exit_id") % 3 / 2).alias("z_high"))
    a = walkers(spark, sf_dir).withColumn("z", F.lit(0.0)).withColumn("breathing_height_m", F.when(F.col("agent_id") % 3 == 0, 1.25))
    return rounded(M.hazard_samples(a, h, ["agent_id"]).groupBy((F.col("agent_id") % 12).alias("g")).agg(F.sum("hazard_load").alias("load")), 5)


def q_connector_density(spark, sf_dir):
    p = places(spark, sf_dir)
    c = p.select("exit_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.lit(3).alias("tx"), (F.col("exit_id") % 40).cast("int").alias("ty"))
    d = walkers(spark, sf_dir).groupBy(F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y")).agg((F.count(F.lit(1)) / 4).alias("density"))
    return M.connector_density(c, d).select("exit_id", "density")


def q_apply_decision(spark, sf_dir):
    k = F.col("agent_id")
    a = walkers(spark, sf_dir).select("agent_id", F.lit("EXPLORE").alias("intent"), "target_exit", F.lit(0.5).alias("trust"))
    d = walkers(spark, sf_dir).filter("agent_id % 2 = 0").select("agent_id", F.when(k % 4 == 0, "accepted").otherwise("rejected").alias("validation_status"), F.when(k % 8 == 0, "EVACUATE").alias("selected_intent"), F.when(k % 12 == 0, F.lit(9).cast("long")).alias("target_exit"), (k % 5 / 4 - 0.5).alias("trust_delta"))
    return M.apply_decision(a, d).groupBy("intent", "target_exit").agg(F.count(F.lit(1)).alias("n"), F.sum("trust").alias("trust"))


def q_hostile_recipients(spark, sf_dir):
    a = walkers(spark, sf_dir).select("agent_id", "x", "y", (F.col("agent_id") % 8 / 8).alias("credibility"), (F.col("agent_id") % 5).cast("double").alias("hazard_distance"))
    h = places(spark, sf_dir).filter("exit_id < 6").select(F.col("exit_id").alias("hostile_id"), "tx", "ty", F.lit(9.0).alias("radius"))
    return M.hostile_recipients(a, h, "credibility", 6, 2).select("hostile_id", "agent_id", "place")


def q_claims_spread(spark, sf_dir):
    w = walkers(spark, sf_dir)
    b = w.select("agent_id", (F.col("agent_id") % 3).alias("exit_id"), F.lit(0.75).alias("prob"), (F.col("agent_id") % 4 / 4).alias("source_credibility"))
    r = w.filter("agent_id % 5 < 2").select((F.col("agent_id") % 5).alias("hostile_id"), "agent_id")
    c = spark.createDataFrame([(0, 1, 0.25, 0.5), (1, 2, 0.125, 0.375)], "hostile_id long, exit_id long, prob double, credibility double")
    return M.claims_spread(b, r, c).groupBy("exit_id", "prob", "source_credibility").agg(F.count(F.lit(1)).alias("n"))


def step_tables(spark, sf_dir):
    w = walkers(spark, sf_dir)
    agents = w.select("agent_id", "x", "y", "release_step", "evacuated", F.lit(None).cast("long").alias("evacuated_via"), F.lit(0).alias("travel_steps"), F.lit(0.0).alias("exposure"), F.lit(1.25).alias("free_speed"))
    routes = cells(spark).select("x", "y", F.when(F.col("x") > 0, F.col("x") - 1).otherwise(F.col("x")).alias("nx"), F.col("y").alias("ny"))
    return agents, routes, cells(spark).filter("x = 0").select(F.col("y").cast("long").alias("exit_id"), "x", "y"), places(spark, sf_dir), cells(spark).filter("not walkable").select("x", "y")


def q_simulation_step(spark, sf_dir):
    a, r, e, h, c = step_tables(spark, sf_dir)
    s = M.simulation_step(a, r, e, h, c, 20)
    return rounded(s.groupBy("evacuated", (F.col("agent_id") % 6).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("travel_steps").alias("steps"), F.sum("exposure").alias("exposure"), F.sum("x").alias("x"), F.count("evacuated_via").alias("via")), 5)


def q_live_snapshot(spark, sf_dir):
    a, *_ = step_tables(spark, sf_dir)
    return rounded(M.live_snapshot(a.withColumn("exposure", F.col("agent_id") % 32 / 32), 20))


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_cells = "cells AS (SELECT (i % 40)::INT AS x, (i // 40)::INT AS y, i % 9 <> 0 AS walkable FROM range(1600) t(i))"
_pl = "(exit_id * 7 % 40)::INT AS px, (exit_id * 11 % 40)::INT AS py"
_w = f"WITH {_walkers}"
_wp = f"WITH {_walkers}, {_places}"
_family = """fam AS (SELECT a.agent_id, b.target_exit AS exit_id, count(*) AS n FROM walkers a JOIN walkers b ON a.family_id = b.family_id AND a.agent_id <> b.agent_id WHERE b.target_exit IS NOT NULL GROUP BY 1, 2),
  fs AS (SELECT agent_id, exit_id, n / (sum(n) OVER (PARTITION BY agent_id))::DOUBLE AS share FROM fam)"""
_cat = "CASE upper(kind) WHEN 'GAS' THEN 'toxic' WHEN 'SMOKE' THEN 'smoke' WHEN 'FIRE' THEN 'heat' WHEN 'FLOOD' THEN 'flood' WHEN 'SHOOTER' THEN 'trauma' ELSE 'crush' END"
_pace = "CASE WHEN n <= 0.01 THEN 1.34 WHEN n >= 5.4 THEN 0 ELSE 1.34 * (1 - exp(-1.913 * (1 / n - 1 / 5.4::DOUBLE))) END"
# fmt: off
SQL = {
    "q_agent_states": f"{_w} SELECT count(*) FILTER (NOT evacuated AND release_step <= 20) AS active, count(*) FILTER (NOT evacuated AND release_step > 20) AS pending, count(*) FILTER (release_step <= 20) AS released FROM walkers",
    "q_open_cells": f"WITH {BUILDINGS_SQL} SELECT building, count(*) AS n FROM g WHERE walkable AND cell_key % 13 <> 0 GROUP BY 1",
    "q_open_edges": f"""WITH {BUILDINGS_SQL}, {EDGES_SQL}, c AS (SELECT x, y FROM g WHERE cell_key % 13 = 0) SELECT sx, sy, tx, ty FROM e WHERE (sx * 3 + ty * 5) % 7 <> 0 AND (sx, sy) NOT IN (SELECT (x, y) FROM c) AND (tx, ty) NOT IN (SELECT (x, y) FROM c)""",
    "q_persona_match": f"""{_w}, p(persona_id, c, m, a) AS (VALUES ('a', 'BUILDING', 'm1', ''), ('b', '', 'm2', 'senior'), ('c', '', '', 'adult'))
      SELECT persona_id, count(*) AS n, sum(agent_id)::BIGINT AS ids FROM walkers JOIN p ON (c = '' OR c = cohort_name) AND (m = '' OR m = lower(mobility_class)) AND (a = '' OR a = lower(age_band)) GROUP BY 1""",
    "q_impossible_jumps": f"""WITH {TRAJ_SQL}, t AS (SELECT agent_id, event_id AS step, floor(x)::INT AS x, floor(y)::INT AS y, k % 2 AS f FROM traj), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(f) OVER w AS pf FROM t WINDOW w AS (PARTITION BY agent_id ORDER BY step)),
      c AS (SELECT DISTINCT x AS a, y AS b, x + 2 AS c, y - 1 AS d FROM t WHERE step % 3 = 0), cc AS (SELECT * FROM c UNION SELECT c, d, a, b FROM c)
      SELECT f AS to_floor_id, count(*) AS n, sum(step)::BIGINT AS steps FROM l WHERE f <> pf AND step % 5 <> 0 AND (px, py, x, y) NOT IN (SELECT (a, b, c, d) FROM cc) GROUP BY 1""",
    "q_speed_density_pairs": f"WITH {TRAJ_SQL}, m AS (SELECT k, count(*) FILTER (x < 5) AS n_in_region, count(*) FILTER (x < 2) / 64.0::DOUBLE AS density FROM traj GROUP BY 1) SELECT * FROM m WHERE n_in_region >= 3 AND density > 0.01",
    "q_zone_lookup": f"WITH {TRAJ_SQL}, z AS (SELECT i % 10 AS x, i % 3 + 2 AS y, 'bn_' || (i % 3) AS zone_id FROM range(30) t(i)) SELECT zone_id, count(*) AS n FROM traj t LEFT JOIN z ON floor(t.x) = z.x AND floor(t.y) = z.y GROUP BY 1",
    "q_zone_distance": f"""WITH {_cells}, {_places}, z AS (SELECT exit_id % 4 AS zone_id, exit_id % 5 = 0 AS up, {_pl} FROM places), d AS (SELECT zone_id, x, y, min(CASE WHEN up THEN 999999 ELSE abs(x - px) + abs(y - py) END) AS d FROM cells, z WHERE walkable GROUP BY 1, 2, 3)
      SELECT zone_id, sum(d)::BIGINT AS total, max(d)::BIGINT AS most FROM d GROUP BY 1""",
    "q_visible_pairs": f"{_wp} SELECT exit_id, count(*) AS n, sum(agent_id)::BIGINT AS ids, round(max({_dist}), 6) AS farthest FROM walkers, places WHERE (x - tx) * (x - tx) + (y - ty) * (y - ty) <= vision_radius * vision_radius GROUP BY 1",
    "q_beacon_news": f"""{_wp}, t AS (SELECT DISTINCT agent_id, unnest([exit_id % 5, 1]) AS exit_id FROM walkers, places WHERE exit_id % 3 = 0 AND (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 36)
      SELECT exit_id, count(*) AS n, sum(agent_id)::BIGINT AS ids FROM t WHERE NOT (exit_id = agent_id % 5 AND agent_id % 10 >= 9) GROUP BY 1""",
    "q_exit_aliases": f"""{_wp}, f AS (SELECT 'exit_' || (agent_id % 30) AS label, count(*) AS n FROM walkers GROUP BY 1) SELECT label AS alias, n FROM f UNION ALL SELECT 'g:' || px || ',' || py AS alias, sum(n)::BIGINT FROM f JOIN (SELECT label, {_pl} FROM places) USING (label) GROUP BY 1""",
    "q_cohort_exit_usage": f"""{_wp}, f AS (SELECT cohort_name, 'exit_' || (agent_id % 4) AS label, count(*) AS n FROM walkers WHERE evacuated AND agent_id % 11 <> 0 GROUP BY 1, 2)
      SELECT cohort_name, label AS alias, n FROM f UNION ALL SELECT cohort_name, 'g:' || px || ',' || py, n FROM f JOIN (SELECT label, {_pl} FROM places) USING (label)""",
    "q_provenance_checks": f"""{_wp}, r AS (SELECT agent_id AS record_id, x, y, CASE WHEN agent_id % 3 = 0 AND agent_id % 4 <= 3 THEN agent_id % 50 < 25 END AS by_exit, agent_id % 2 = 0 AND agent_id % 5 <= 3 AS sees, x + agent_id % 5 AS hx FROM walkers),
      s AS (SELECT record_id, coalesce(by_exit, CASE WHEN sees THEN EXISTS (SELECT 1 FROM places p WHERE (hx - tx) * (hx - tx) + (y - ty) * (y - ty) < 9) END) AS supported FROM r) SELECT supported, count(*) AS n, sum(record_id)::BIGINT AS ids FROM s WHERE supported IS NOT NULL GROUP BY 1""",
    "q_family_targets": f"{_w}, {_family} SELECT exit_id, count(*) AS n, sum(agent_id)::BIGINT AS ids, round(max(share), 6) AS most FROM fs GROUP BY 1",
    "q_shooter_pressure": f"""{_wp}, {_cells}, p AS (SELECT agent_id, exit_id, tx, ty, x, y, {_dist} AS d FROM walkers, places WHERE exit_id < 5 AND (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 144), n AS (SELECT *, greatest(2, ceil(2 * d)::INT) AS n FROM p),
      s AS (SELECT *, unnest(range(1, n)) AS i FROM n), b AS (SELECT DISTINCT agent_id, exit_id FROM s JOIN cells c ON c.x = floor(tx + (s.x - tx) * (i / n::DOUBLE)) AND c.y = floor(ty + (s.y - ty) * (i / n::DOUBLE)) WHERE NOT walkable),
      v AS (SELECT * FROM p WHERE d <= 10 AND (agent_id, exit_id) NOT IN (SELECT (agent_id, exit_id) FROM b)), g AS (SELECT agent_id, arg_min(exit_id, (d, exit_id)) AS h, min(d) AS d, count(*) AS c FROM v GROUP BY 1)
      SELECT h AS hostile_id, count(*) AS n, sum(c)::BIGINT AS visible, round(max(d), 6) AS farthest FROM g GROUP BY 1""",
    "q_dose_loads": f"""{_wp}, i AS (SELECT agent_id, {_cat} AS c, CASE WHEN kind = 'FLOOD' AND {_dist} <= radius THEN depth ELSE 0 END AS dp, {_fall.format(d=_dist)} AS f FROM walkers, places), j AS (SELECT agent_id, c, dp, CASE WHEN c = 'flood' THEN greatest(f, dp / 0.5) ELSE f END AS f FROM i),
      g AS (SELECT agent_id, max(dp) AS dp, {', '.join(f"sum(CASE WHEN c = '{n}' THEN f ELSE 0 END) AS {n}_load" for n in ('toxic', 'smoke', 'heat', 'flood', 'trauma', 'crush'))}, sum(f) AS total_load FROM j GROUP BY 1)
      SELECT {', '.join(f"round(sum({n}_load), 5) AS {n}_load" for n in ('toxic', 'smoke', 'heat', 'flood', 'trauma', 'crush', 'total'))}, round(sum(dp), 5) AS flood_depth_m FROM g""",
    "q_belief_accuracy": f"""{_wp}, b AS (SELECT agent_id, e, (agent_id + e) % 64 / 64.0::DOUBLE AS p FROM (SELECT DISTINCT agent_id, unnest([agent_id % 7, agent_id % 3 + 30]) AS e FROM walkers)), s AS (SELECT agent_id, sum(CASE WHEN e < 7 THEN p ELSE 0 END) AS found, count(*) FILTER (e >= 7 AND p > 0.5) AS wrong FROM b GROUP BY 1),
      h AS (SELECT agent_id, exit_id, CASE WHEN agent_id % 4 <> 0 AND (x - tx) * (x - tx) + (y - ty) * (y - ty) < 9 THEN greatest(0, 1 - abs((agent_id % 16) / 16.0::DOUBLE - severity)) ELSE 0 END AS m FROM walkers, places WHERE exit_id >= 15), k AS (SELECT agent_id, sum(m) AS m, count(*) AS n FROM h GROUP BY 1)
      SELECT agent_id % 10 AS g, round(sum((found + m) / (7 + wrong + n)), 5) AS total, count(*) AS n FROM s JOIN k USING (agent_id) GROUP BY 1""",
    "q_entropy_summary": f"{_w} SELECT cohort_name, round(avg(entropy), 6) AS global_entropy, round(var_pop(entropy), 6) AS entropy_variance, round(greatest(0, 1 - avg(entropy) / 0.75), 6) AS efficiency FROM walkers GROUP BY 1",
    "q_profile_similarity": f"{_w} SELECT ((lower(cohort_name) = 'building')::INT + (CASE WHEN agent_id % 2 = 0 THEN age_band = 'Senior' ELSE false END)::INT) / 2.0::DOUBLE AS similarity, count(*) AS n FROM walkers GROUP BY 1",
    "q_perceived_hazard": f"""{_w} SELECT agent_id % 24 AS g, round(max((agent_id % 8) / 8.0::DOUBLE * 0.75 + CASE WHEN (agent_id % 3) / 2.0 < 1 THEN 0.5 ELSE 0 END), 6) AS hazard, round(max(1.25 * ((agent_id % 8) / 8.0::DOUBLE * 0.75)), 6) AS penalty FROM walkers GROUP BY 1""",
    "q_edge_weights": """SELECT l_returnflag, l_linenumber, sum(greatest(1.0, CASE WHEN l_returnflag = 'R' THEN l_linenumber * 3.0 + 2 ELSE l_quantity / 0.5 END))::DOUBLE AS connector, sum(CASE WHEN l_linenumber < 7 THEN 1 + 0.5 * least(2.0, 2 * (l_quantity / 32)) + l_linenumber / 4.0 END)::DOUBLE AS edge,
      l_linenumber = 7 AS blocked FROM lineitem GROUP BY 1, 2""",
    "q_scored_exit": f"""{_wp}, {_family}, b AS (SELECT agent_id, exit_id, ((agent_id * 3 + exit_id * 5) % 16 / 16.0::DOUBLE - 0.125) * 0.85::DOUBLE + 0.25 * (lower(age_band) = CASE WHEN exit_id % 2 = 0 THEN 'senior' ELSE 'adult' END)::INT + 0.15::DOUBLE * coalesce(share, 0) + 0.05::DOUBLE / (1 + {_dist}) AS s
      FROM walkers CROSS JOIN places LEFT JOIN fs USING (agent_id, exit_id) WHERE exit_id < 5), m AS (SELECT agent_id, arg_max(exit_id, (s, exit_id)) AS exit_id, max(s) AS s FROM b GROUP BY 1) SELECT exit_id, count(*) AS n, round(sum(s), 4) AS score FROM m GROUP BY 1""",
    "q_social_force": f"""{_wp}, a AS (SELECT agent_id, x, y, (agent_id % 5) / 4.0::DOUBLE AS vx, (agent_id % 3) / 4.0::DOUBLE AS vy, CASE WHEN agent_id % 2 = 0 THEN 1.25::DOUBLE ELSE -1.25::DOUBLE END AS wx, 0.25::DOUBLE AS wy FROM walkers),
      n AS (SELECT a.agent_id, a.wx, a.wy, b.vx AS nvx, b.vy AS nvy, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) + 1e-6 AS d FROM a JOIN a b ON a.agent_id <> b.agent_id AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3),
      u AS (SELECT *, dx / d AS ux, dy / d AS uy, wx * nvx + wy * nvy AS dot, sqrt(nvx * nvx + nvy * nvy) AS sp FROM n WHERE d < 3),
      f AS (SELECT agent_id, 2.1::DOUBLE * exp((0.6 - d) / 0.3) * ux + CASE WHEN dot < 0 AND sp > 0.1 THEN 1.5 * abs(dot) * sign(-uy * wx + ux * wy) * -uy ELSE 0 END AS fx, 2.1::DOUBLE * exp((0.6 - d) / 0.3) * uy + CASE WHEN dot < 0 AND sp > 0.1 THEN 1.5 * abs(dot) * sign(-uy * wx + ux * wy) * ux ELSE 0 END AS fy FROM u
        UNION ALL SELECT agent_id, CASE WHEN d < 2 THEN 5 * exp((0.3 - d) / 0.2) ELSE 0 END * (x - tx) / d, CASE WHEN d < 2 THEN 5 * exp((0.3 - d) / 0.2) ELSE 0 END * (y - ty) / d FROM (SELECT agent_id, x, y, tx, ty, {_dist} + 1e-6 AS d FROM a, places)),
      s AS (SELECT agent_id, sum(fx) AS fx, sum(fy) AS fy FROM f GROUP BY 1), v AS (SELECT agent_id, wx, wy, vx + ((wx - vx) / 0.5 + coalesce(fx, 0)) * 0.1 AS vx, vy + ((wy - vy) / 0.5 + coalesce(fy, 0)) * 0.1 AS vy FROM a LEFT JOIN s USING (agent_id)),
      c AS (SELECT agent_id, vx, vy, sqrt(vx * vx + vy * vy) AS sp, greatest(sqrt(wx * wx + wy * wy) * 1.5, 0.5) AS most FROM v), k AS (SELECT agent_id, vx * CASE WHEN sp > most THEN most / sp ELSE 1 END AS vx, vy * CASE WHEN sp > most THEN most / sp ELSE 1 END AS vy FROM c)
      SELECT agent_id % 10 AS g, round(sum(vx * 0.1), 5) AS dx, round(sum(vy * 0.1), 5) AS dy, round(max(sqrt(vx * vx + vy * vy)), 5) AS fastest FROM k GROUP BY 1""",
    "q_aftershocks": f"""WITH {_places}, c AS (SELECT (i % 60 - 10)::INT AS x, (i // 60 - 10)::INT AS y FROM range(3600) t(i)), h AS (SELECT x, y, severity * (1 - d / radius) AS v FROM (SELECT x, y, severity, radius, sqrt((x + 0.5 - tx) * (x + 0.5 - tx) + (y + 0.5 - ty) * (y + 0.5 - ty)) AS d FROM c, places WHERE exit_id % 4 IN (1, 2)) WHERE d <= radius
      UNION ALL SELECT i::INT AS x, i::INT AS y, 0.25 FROM range(40) t(i) WHERE (i * 41) % 9 >= 0) SELECT x, y, round(least(1.0, sum(v)), 6) AS v FROM h GROUP BY 1, 2""",
    "q_hazard_samples": f"""{_wp}, i AS (SELECT agent_id, CASE WHEN exit_id % 2 = 1 OR CASE WHEN agent_id % 3 = 0 THEN 1.25 ELSE 1.5 END BETWEEN 1 AND 1 + (exit_id % 3) / 2.0 THEN {_fall.format(d=_dist)} ELSE 0 END AS f FROM walkers, places) SELECT agent_id % 12 AS g, round(sum(f), 5) AS load FROM i GROUP BY 1""",
    "q_connector_density": f"""{_wp}, d AS (SELECT floor(x)::INT AS x, floor(y)::INT AS y, count(*) / 4.0::DOUBLE AS n FROM walkers GROUP BY 1, 2), p AS (SELECT exit_id, {_pl} FROM places)
      SELECT exit_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0))::DOUBLE AS density FROM p LEFT JOIN d a ON a.x = px AND a.y = py LEFT JOIN d b ON b.x = 3 AND b.y = exit_id % 40""",
    "q_apply_decision": f"""{_w} SELECT CASE WHEN agent_id % 8 = 0 THEN 'EVACUATE' ELSE 'EXPLORE' END AS intent, CASE WHEN agent_id % 12 = 0 THEN 9 ELSE target_exit END AS target_exit, count(*) AS n, sum(CASE WHEN agent_id % 4 = 0 THEN least(1, greatest(0, 0.5 + (agent_id % 5) / 4.0::DOUBLE - 0.5)) ELSE 0.5 END)::DOUBLE AS trust FROM walkers GROUP BY 1, 2""",
    "q_hostile_recipients": f"""{_wp}, r AS (SELECT exit_id AS hostile_id, agent_id, row_number() OVER (PARTITION BY exit_id ORDER BY agent_id % 8 DESC, agent_id)::INT AS place FROM walkers, places WHERE exit_id < 6 AND (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 81) SELECT * FROM r WHERE place <= 4""",
    "q_claims_spread": f"""{_w}, c AS (SELECT agent_id, agent_id % 5 + 1 AS exit_id, CASE WHEN agent_id % 5 = 0 THEN 0.25 ELSE 0.125 END AS p, CASE WHEN agent_id % 5 = 0 THEN 0.5 ELSE 0.375 END AS k FROM walkers WHERE agent_id % 5 < 2), b AS (SELECT agent_id, agent_id % 3 AS exit_id, 0.75 AS p, (agent_id % 4) / 4.0 AS k FROM walkers)
      SELECT coalesce(b.exit_id, c.exit_id) AS exit_id, (CASE WHEN c.k IS NOT NULL AND (b.k IS NULL OR c.k > b.k) THEN c.p ELSE b.p END)::DOUBLE AS prob, (CASE WHEN c.k IS NOT NULL AND (b.k IS NULL OR c.k > b.k) THEN c.k ELSE b.k END)::DOUBLE AS source_credibility, count(*) AS n FROM b FULL JOIN c USING (agent_id, exit_id) GROUP BY 1, 2, 3""",
    "q_simulation_step": f"""{_wp}, {_cells}, a AS (SELECT *, NOT evacuated AND release_step <= 20 AS go, floor(x)::INT AS cx, floor(y)::INT AS cy FROM walkers), cr AS (SELECT cx, cy, count(*)::DOUBLE AS n FROM a WHERE go GROUP BY 1, 2),
      l AS (SELECT agent_id, sum({_fall.format(d=_dist)}) AS f FROM walkers, places GROUP BY 1), m AS (SELECT a.*, coalesce(n, 0) AS n, CASE WHEN cx > 0 THEN cx - 1 ELSE cx END AS nx, f FROM a LEFT JOIN cr USING (cx, cy) JOIN l USING (agent_id)),
      s AS (SELECT m.*, least(1.25, {_pace}) * 0.5 AS reach, sqrt((nx + 0.5 - m.x) * (nx + 0.5 - m.x) + (cy + 0.5 - m.y) * (cy + 0.5 - m.y)) AS far, c.walkable FROM m JOIN cells c ON c.x = nx AND c.y = cy),
      p AS (SELECT *, CASE WHEN go AND walkable THEN coalesce(least(1, reach / nullif(far, 0)), 0) ELSE 0 END AS sh FROM s), q AS (SELECT *, x + sh * (nx + 0.5 - x) AS x2 FROM p), r AS (SELECT *, go AND floor(x2) = 0 AS out FROM q)
      SELECT evacuated OR out AS evacuated, agent_id % 6 AS g, count(*) AS n, sum(go::INT)::BIGINT AS steps, round(sum(CASE WHEN go THEN f * 0.5 ELSE 0 END), 5) AS exposure, round(sum(x2), 5) AS x, count(*) FILTER (out) AS via FROM r GROUP BY 1, 2""",
    "q_live_snapshot": f"""{_w} SELECT 20 AS step, count(*) AS agents, count(*) FILTER (evacuated) AS evacuated, count(*) FILTER (NOT evacuated AND release_step <= 20) AS active, count(*) FILTER (NOT evacuated AND release_step > 20) AS pending,
      round(coalesce(avg(CASE WHEN NOT evacuated AND release_step <= 20 THEN (agent_id % 32) / 32.0::DOUBLE END), 0), 6) AS mean_exposure FROM walkers""",
}
# fmt: on
