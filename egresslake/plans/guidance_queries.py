"""Guidance, budget and claim operators over the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import audits as A
from egresslake.operators import guidance as G
from egresslake.plans.movement_queries import _places, _walkers, places, walkers
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import table


def crowd(spark, sf_dir):
    k = F.col("agent_id")
    return walkers(spark, sf_dir).select(
        "agent_id", "x", "y", "entropy", (k % 6 != 0).alias("active"), (k % 9 == 0).alias("is_responder"), (k % 32 / 32).alias("credibility"), (k % 48 / 64).alias("local_density"), (k % 40 / 64).alias("hazard_load"), (k % 24 / 64).alias("hazard_exposure"),
        (k % 7).alias("queue_length"), (k % 5).alias("occupancy"),
    )


_crowd = """crowd AS (SELECT agent_id, x, y, entropy, agent_id % 6 <> 0 AS active, agent_id % 9 = 0 AS responder, (agent_id % 32) / 32.0::DOUBLE AS cred, (agent_id % 48) / 64.0::DOUBLE AS density, (agent_id % 40) / 64.0::DOUBLE AS load, (agent_id % 24) / 64.0::DOUBLE AS exposure,
  agent_id % 7 + agent_id % 5 AS queue FROM walkers)"""


def layout(spark):
    return spark.createDataFrame([(40, 30)], "width int, height int")


def beacons(spark, sf_dir):
    return places(spark, sf_dir).filter("exit_id < 3").select("tx", "ty")


def q_fixed_targets(spark, sf_dir):
    args = layout(spark), beacons(spark, sf_dir), crowd(spark, sf_dir), places(spark, sf_dir)
    out = None
    for p in ("static_broadcast", "global_broadcast", "wildfire_long_range_broadcast", "responder_relay"):
        t = G.fixed_targets(p, *args).select(F.lit(p).alias("policy"), "tx", "ty", "reason", "score", "radius")
        out = t if out is None else out.unionByName(t)
    return rounded(out.groupBy("policy", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("tx").alias("tx"), F.sum("score").alias("score"), F.max("radius").alias("radius")))


def q_selected_targets(spark, sf_dir):
    out = None
    for s in ("entropy", "density_aware", "exposure", "bottleneck", "static", "global"):
        t = G.selected_targets(s, 4, crowd(spark, sf_dir), layout(spark), beacons(spark, sf_dir), places(spark, sf_dir))
        out = t if out is None else out.unionByName(t)
    return rounded(out)


def exits(spark, sf_dir):
    return places(spark, sf_dir).filter("exit_id < 12").select("exit_id", F.col("exit_label").alias("label"), F.col("tx").alias("ex"), F.col("ty").alias("ey"), (F.col("exit_id") % 4 == 0).alias("congested"))


def q_assembled(spark, sf_dir):
    told = crowd(spark, sf_dir).select(F.col("agent_id").alias("target_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    m = G.assembled(told, exits(spark, sf_dir), places(spark, sf_dir).filter("exit_id < 2").select("kind", "hx", "hy", "severity"))
    return m.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join(F.transform("recommended", lambda v: v.cast("string")), ",")).alias("recommended"), F.max(F.array_join(F.transform("avoid", lambda v: v.cast("string")), ",")).alias("avoid"), F.max(F.size("hazards")).alias("hazards"))


def q_judged(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    text = F.when(n % 4 == 0, F.concat(F.lit("Do not panic, go to a safe area. "), F.substring("text", 1, 20))).when(n % 4 == 1, "").otherwise("Use exit north")
    ids = F.when(n % 3 == 0, F.array(F.lit(1), F.lit(9))).when(n % 3 == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    m = c.select(text.alias("text"), ids.alias("recommended"), F.when(n % 2 == 0, F.array(F.lit(3))).otherwise(F.array().cast("array<int>")).alias("avoid"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("known"), F.array(F.lit(2)).alias("congested"), F.when(n % 5 == 0, F.array(F.lit("FIRE"))).otherwise(F.array().cast("array<string>")).alias("hazards"))
    j = G.judged(m)
    return rounded(j.groupBy(F.array_join("judge_reasons", ";").alias("reasons"), "passed").agg(F.count(F.lit(1)).alias("n"), F.avg("safety").alias("safety"), F.avg("specificity").alias("specificity"), F.avg("alignment").alias("alignment")), 5)


def q_budget_limits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("run_id"), F.col("o_orderkey").alias("step"), F.lit(1.0).alias("calls"), (F.col("o_orderkey") % 7).cast("double").alias("tokens"), (F.col("o_orderkey") % 3 / 4).alias("usd"))
    g = A.guarded(o, ["run_id"], ["step"], {"calls": 1e9, "tokens": 1e9, "usd": 2.0})
    return g.groupBy("run_id").agg(F.count_if("allowed").alias("allowed"), F.max("exceeded").alias("exceeded"), F.sum(F.when(F.col("allowed"), F.col("usd"))).alias("usd"))


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_score = {"entropy_targeted": "entropy", "density_aware": "density", "exposure_aware": "load + 0.25 * exposure", "bottleneck_avoidance": "queue"}
# fmt: off
SQL = {
    "q_fixed_targets": f"""WITH {_walkers}, {_places}, {_crowd}, t AS (SELECT 'static_broadcast' AS policy, 'static_broadcast_source' AS reason, tx, 1.0::DOUBLE AS score, NULL::DOUBLE AS radius FROM places WHERE exit_id < 3
      UNION ALL SELECT 'global_broadcast', 'global_broadcast', 20, (SELECT count(*) FROM crowd WHERE active)::DOUBLE, 80 UNION ALL SELECT 'wildfire_long_range_broadcast', 'wildfire_front', tx, severity, 80 FROM places WHERE kind = 'FIRE'
      UNION ALL SELECT 'responder_relay', 'responder_relay', x, cred, NULL FROM crowd WHERE active AND responder) SELECT policy, reason, count(*) AS n, round(sum(tx), 6) AS tx, round(sum(score), 6) AS score, max(radius) AS radius FROM t GROUP BY 1, 2""",
    "q_selected_targets": f"WITH {_walkers}, {_places}, {_crowd} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT x AS tx, y AS ty, 'llm_{n}_{n}' AS reason, round(({e})::DOUBLE, 6) AS score FROM crowd WHERE active {'' if n == 'entropy_targeted' else f'AND {e} > 0'} ORDER BY {e} DESC, agent_id LIMIT 4)" for n, e in _score.items())
      + " UNION ALL SELECT tx, ty, 'llm_static_beacon_static_broadcast_source', 1.0 FROM places WHERE exit_id < 3 UNION ALL SELECT 20, 15, 'llm_global_broadcast_global_broadcast', (SELECT count(*) FROM crowd WHERE active)",
    "q_assembled": f"""WITH {_walkers}, {_places}, d AS (SELECT agent_id, exit_id, label, row_number() OVER (PARTITION BY agent_id ORDER BY (tx - x) * (tx - x) + (ty - y) * (ty - y), exit_id) AS r FROM walkers, places WHERE exit_id < 12 AND exit_id % 4 <> 0),
      m AS (SELECT agent_id, 'Use exit ' || string_agg(label, ' or ' ORDER BY r) AS text, string_agg(exit_id::VARCHAR, ',' ORDER BY r) AS rec FROM d WHERE r <= 2 GROUP BY 1) SELECT text, count(*) AS n, max(rec) AS recommended, '0,4,8' AS avoid, 2 AS hazards FROM m GROUP BY 1""",
    "q_judged": """WITH c AS (SELECT length(text) AS n FROM conversations), k AS (SELECT n, n % 4 = 0 AS panic, n % 4 = 1 AS empty, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS ids, n % 2 = 0 AND n % 5 = 0 AS good FROM c),
      s AS (SELECT concat_ws(';', CASE WHEN empty THEN 'empty_text' END, CASE WHEN panic THEN 'panic_terms' END, CASE WHEN ids = 0 THEN 'no_recommended_exit' END, CASE WHEN panic THEN 'vague_phrasing' END, CASE WHEN ids = 1 THEN 'unknown_recommended_exit' END, CASE WHEN ids = 2 THEN 'recommended_congested_exit' END) AS reasons,
        1 - CASE WHEN empty THEN 0.7 ELSE 0 END - CASE WHEN panic THEN 0.4 ELSE 0 END::DOUBLE AS sa, 1 - CASE WHEN ids = 0 THEN 0.6 ELSE 0 END - CASE WHEN panic THEN 0.3 ELSE 0 END::DOUBLE AS sp, least(1.0, 1 - CASE ids WHEN 1 THEN 0.5 WHEN 2 THEN 0.4 ELSE 0 END + CASE WHEN good THEN 0.1 ELSE 0 END)::DOUBLE AS al FROM k)
      SELECT reasons, least(sa, sp, al) >= 0.5 AS passed, count(*) AS n, round(avg(sa), 5) AS safety, round(avg(sp), 5) AS specificity, round(avg(al), 5) AS alignment FROM s GROUP BY 1, 2""",
    "q_budget_limits": """WITH RECURSIVE o AS (SELECT o_custkey % 50 AS run_id, (o_orderkey % 3) / 4.0::DOUBLE AS usd, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
      f AS (SELECT run_id, i, CASE WHEN usd <= 2 THEN usd ELSE 0 END AS used, usd <= 2 AS ok FROM o WHERE i = 1 UNION ALL SELECT o.run_id, o.i, f.used + CASE WHEN f.used + o.usd <= 2 THEN o.usd ELSE 0 END, f.used + o.usd <= 2 FROM f JOIN o ON o.run_id = f.run_id AND o.i = f.i + 1)
      SELECT run_id, count(*) FILTER (ok) AS allowed, CASE WHEN bool_and(ok) THEN NULL ELSE 'usd' END AS exceeded, max(used) AS usd FROM f GROUP BY 1""",
}
# fmt: on
