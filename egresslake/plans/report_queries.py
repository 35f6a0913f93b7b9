"""Report tables and merged documents over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.functions.bounds import spread
from egresslake.operators import merging as M
from egresslake.operators import plausibility as P
from egresslake.operators import reports as R
from egresslake.operators import trajectory as T
from egresslake.plans.structure_queries import HAZARDS, q_issue_table
from egresslake.plans.structure_queries import SQL as STRUCTURE_SQL
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import BUILDINGS_SQL, RUNS_SQL, TRAJ_SQL, buildings, runs, table, traj

KEYS = ("run_id", "step", "y", "x", "intent")
MESSAGE = {"x": 5.0, "y": 4.0, "z": 0.0, "radius": 3.5, "credibility": 0.8, "horizon_steps": 45, "kind": "all_clear"}


def q_intent_counts(spark, sf_dir):
    t = traj(spark, sf_dir).select("run_id", F.col("k").alias("step"), F.floor("y").cast("int").alias("y"), F.floor("x").cast("int").alias("x"), F.col("variant_name").alias("intent"), F.lit(1).alias("count"))
    return R.intent_counts(t, keys=KEYS)


def q_calibration_results(spark, sf_dir):
    """Priorities as candidates: prices of their orders against those of all, in percent of some figures."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("candidate")).agg((F.count(F.lit(1)) / 10).alias("crossing_count"), (F.avg("o_totalprice") / 1000).alias("mean_flow_ped_s"), (F.max("o_orderkey") / 100).alias("mean_time_headway_s"))
    long = g.unpivot(["candidate"], ["crossing_count", "mean_flow_ped_s", "mean_time_headway_s"], "metric", "simulated").withColumn("reference", F.lit(250.0))
    return rounded(R.calibration_results(long.withColumn("pct_delta", (F.col("simulated") - 250) / 25), ["candidate"]), 4)


def q_cascades(spark, sf_dir):
    t = traj(spark, sf_dir).filter("agent_id < 60 or event_id < 3").select("run_id", F.col("event_id").alias("step"), (F.floor("time_s") / 100).alias("time_s"), F.col("value").alias("global_entropy"))
    return rounded(R.information_cascades(t))


def q_projection(spark, sf_dir):
    h = spark.createDataFrame([(x, y, 0.0, r, s) for _, _, x, y, r, s in HAZARDS], "hx double, hy double, hz double, radius double, severity double")
    return R.message_projection(traj(spark, sf_dir).select("x", "y", F.lit(None).cast("double").alias("z"), (F.col("speed") / 10).alias("entropy")), h, MESSAGE)


def q_keyframe_points(spark, sf_dir):
    return R.keyframe_points(traj(spark, sf_dir).select("run_id", F.col("k").alias("step"), "agent_id", "x", "y", "speed"), "speed")


def q_first_events(spark, sf_dir):
    return R.first_events(traj(spark, sf_dir).withColumn("step", F.col("k")).select("run_id", "step", "event_id"), most=20)


def q_frontier_rows(spark, sf_dir):
    g = runs(spark, sf_dir).groupBy("variant_name").agg(F.lit("variant_aggregate").alias("record_type"), F.round(F.avg("travel"), 2).alias("information_safety_efficiency"), F.count_distinct("seed").alias("exit_imbalance"))
    return R.frontier_rows(g.unionByName(g.withColumn("record_type", F.lit("run"))))


def q_equity_bars(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("subgroup_tag"), F.col("c_nationkey").alias("variant_name")).agg(F.count(F.lit(1)).alias("n"))
    return R.equity_bars(c, ["BUILDING", "MACHINERY", "nobody"])


def q_prompt_payloads(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    style = F.element_at(F.array(*[F.lit(s) for s in ("minimal", "state_only", "urgency", "safety")]), (k % 4 + 1).cast("int"))
    r = o.select(
        "o_orderkey", F.col("o_orderpriority").alias("policy"), (k % 50).alias("step"), F.col("o_orderstatus").alias("target"), F.lit("x").alias("exits"), F.lit("y").alias("hazards"), F.lit("z").alias("congested_exits"),
        F.when(k % 3 != 0, F.col("o_custkey")).alias("recipients_estimate"), F.col("o_custkey").alias("seed"), style.alias("prompt_style"),
    )
    return R.prompt_payloads(r).select("o_orderkey", "prompt_style", "payload")


def q_hostile_claims(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    m = o.select(
        k.alias("message_id"), F.when(k % 2 == 0, R.THREAT).otherwise("false_protective_action").alias("objective"), (k % 7 == 0).alias("abstain"), F.when(k % 5 == 0, "trust me, go").when(k % 11 == 0, F.lit(None)).otherwise("go east").alias("text"),
        F.when(k % 3 != 0, F.array(F.col("o_orderpriority"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("recommended_exits"), F.when(k % 4 != 0, F.array(F.col("o_orderstatus"))).alias("hazard_positions"),
        F.lit("fx").alias("fallback_exit"), F.lit("fh").alias("fallback_hazard"),
    )
    return R.hostile_claims(m).select("message_id", "claimed_exit", "claimed_hazard", "used_fallback", F.array_join("reasons", ";").alias("reasons"))


def q_parameter_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("value"))
    named = p.join(F.broadcast(base.select("name", F.col("value").alias("i"))), F.col("p_partkey") % 5 == F.col("i"))
    own = named.filter("p_partkey % 2 = 0").select(F.col("p_name").alias("profile"), "name", F.col("p_retailprice").alias("value"), F.col("p_brand").alias("provenance")).groupBy("profile", "name").agg(F.max("value").alias("value"), F.max("provenance").alias("provenance"))
    over = named.filter("p_partkey % 3 = 0").groupBy(F.col("p_name").alias("profile"), "name").agg(F.min("p_retailprice").alias("value"))
    return R.parameter_profile(base, own, over)


def q_congestion_share(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("flow"))
    return rounded(R.congestion_share(o, ["o_custkey"], "flow"))


def q_filled_documents(spark, sf_dir):
    """Customers as scenarios; their orders generate priors, of which some are there, some are not allowed."""
    c, k = spread(table(spark, sf_dir, "customer")), F.col("c_custkey")
    cohort = F.struct(F.lit("regulars").alias("name"), F.col("c_nationkey").alias("count"), F.when(k % 3 == 0, F.lit(1.5)).alias("base_speed"))
    docs = c.select(k.alias("id"), F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.array(cohort).alias("cohorts")).alias("population"))).alias("payload"))
    prior = F.struct(F.lit("regulars").alias("name"), (k % 10 / 4).alias("base_speed"), F.lit(0.5).alias("trust"))
    made = c.filter(k % 2 == 0).select(k.alias("id"), F.to_json(F.struct(F.lit("other").alias("name"), F.struct(F.array(prior).alias("cohorts")).alias("population"), F.lit(1).alias("secret"))).alias("payload"))
    merged, report = M.fill_documents(docs, made, [r"/population/cohorts/=[^/]+/(base_speed|trust)", "/name"])
    applied = report.groupBy("id").agg(F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "existing_value").alias("kept"), F.count_if(F.col("status") == "not_allowed").alias("refused"))
    return merged.join(applied, "id", "left").select(
        "id", F.get_json_object("payload", "$.name").alias("name"), F.get_json_object("payload", "$.population.cohorts[0].base_speed").try_cast("double").alias("base_speed"),
        F.get_json_object("payload", "$.population.cohorts[0].trust").try_cast("double").alias("trust"), F.get_json_object("payload", "$.population.cohorts[0].count").cast("long").alias("count"), F.get_json_object("payload", "$.secret").alias("secret"), "applied", "kept", "refused",
    )


def q_replan_reasons(spark, sf_dir):
    """Events as agents' samples: the first of six reasons to look for a new way."""
    t, e = traj(spark, sf_dir), F.col("event_id")
    d = t.select(
        "agent_id", "time_s", "event_id", (e % 97 == 0).alias("path_blocked"), (e % 7).alias("topology_revision"), (e % 23 - 1).alias("navigation_topology_revision"), (F.col("x") / 10.1).alias("visibility"), (F.col("y") / 20).alias("flood_depth_m"),
        (F.col("speed") / 3).alias("hazard_load"), (e % 5).alias("belief_step"), (e % 6 - 1).alias("navigation_belief_step"),
    )
    return T.replan_reasons(d, order=("time_s", "event_id")).select("agent_id", "event_id", "reason")


def q_generation_report(spark, sf_dir):
    """Orders as generated messages: counts by priority and status."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    m = o.select(
        F.col("o_orderpriority").alias("variant_name"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("generation_provider"), (k % 9).alias("recipients"), F.element_at(F.array(*[F.lit(s) for s in ("hit", "miss", "disabled")]), (k % 3 + 1).cast("int")).alias("cache_status"),
        F.when(k % 4 == 0, "rejected").otherwise("accepted").alias("validation_status"), F.when(k % 10 != 0, F.concat(F.lit("k"), (k % 100).cast("string"))).otherwise("").alias("cache_key"), (k % 5 == 0).alias("used_fallback"), F.when(k % 6 != 0, F.col("o_totalprice") / 1000).alias("generated_confidence"),
        F.concat(F.lit("e"), (k % 7).cast("string"), F.lit("; e"), (k % 11).cast("string"), F.lit(";")).alias("generated_recommended_exits"), F.when(k % 13 == 0, "congested_recommendation:e1;other").alias("validation_reasons"), (k % 8 / 8).alias("entropy_delta"),
    )
    return rounded(R.generation_report(m, ("variant_name", "generation_provider")), 4)


def q_hazard_config_issues(spark, sf_dir):
    """Parts as scenarios whose hazard lists hold entries that are no mappings."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    doc = F.when(k % 4 == 0, '{"hazards": [{"kind": "FIRE"}, 3, "x", {}]}').when(k % 4 == 1, '{"hazards": {"kind": "FIRE"}}').when(k % 4 == 2, '{"hazards": []}').otherwise('{"name": 1}')
    return R.hazard_config_issues(p.select("p_partkey", doc.alias("payload")), "p_partkey", "payload")


def q_floor_tokens(spark, sf_dir):
    """Buildings as floors: size and tokens of each."""
    g = buildings(spark, sf_dir).select(F.col("building").alias("floor_id"), "x", "y", F.when(~F.col("walkable"), "X").when(F.col("cell_key") % 29 == 0, "E").otherwise(".").alias("token"))
    return R.floor_tokens(g, {"exits": "E", "walls": "X"})


def q_issue_totals(spark, sf_dir):
    return R.issue_totals(q_issue_table(spark, sf_dir), ["source"])


def q_series_union(spark, sf_dir):
    """Two variants' runs under one label, with a column that only one has."""
    r = runs(spark, sf_dir)
    a = r.filter("variant_name = '1-URGENT'").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("seed").alias("seeds"))
    b = r.filter("variant_name = '5-LOW'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return R.labelled_union({"test": a, "baseline": b})


def q_hazard_metrics(spark, sf_dir):
    """Parts as hazards and line items as agents' steps of suppliers' runs; every fifth run has its agents only."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    run = (F.col("p_partkey") % 40).alias("run_id")
    h = p.select(run, (F.col("p_partkey") % 3 == 0).alias("imported"), (F.col("p_retailprice") / 100).alias("radius"), (F.col("p_size") / 50).alias("severity"), (F.col("p_size") / 10).alias("max_gas_concentration"), F.when(F.col("p_size") > 5, F.col("p_size")).alias("min_visibility_m"), F.lit(None).cast("double").alias("max_obscuration_percent_m"))
    a = li.select((F.col("l_suppkey") % 50).alias("run_id"), (F.col("l_quantity") / 10).alias("hazard_load"), F.col("l_tax").alias("hazard_exposure"))
    return rounded(P.hazard_metrics(h, a.filter("run_id % 5 <> 0"), a), 5)


def q_transport_metrics(spark, sf_dir):
    """Customers as connectors of nations' runs, their orders as use and steps."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Elevator", "stairs", "corridor", "escalator")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    n = c.select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("connector_id"), kind.alias("type"))
    o = o.join(n.select("run_id", F.col("connector_id").alias("o_custkey")), "o_custkey")
    steps = o.select("run_id", F.col("o_custkey").alias("connector_id"), (F.col("o_orderkey") % 17).alias("queue_length"), (F.col("o_totalprice") / 100_000).alias("capacity_used"))
    return rounded(P.transport_metrics(n, o.select("run_id", F.col("o_custkey").alias("connector_id"), F.lit(1).alias("used")), steps), 5)


def q_hostile_metrics(spark, sf_dir):
    """Suppliers as channels, events as channel events, orders as calls and customers as decisions of runs."""
    s, e, o, c = (table(spark, sf_dir, t) for t in ("supplier", "events", "orders", "customer"))
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "rejected")
    calls = o.select((F.col("o_custkey") % 30).alias("run_id"), status.alias("validation_status"), F.element_at(F.array(F.lit("hit"), F.lit("miss"), F.lit("budget_exceeded"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("cache_status"), F.when(F.col("o_orderkey") % 9 == 0, "budget_guard").alias("provider"), (F.col("o_orderkey") % 5 == 0).alias("used_fallback"))
    decisions = c.select((F.col("c_custkey") % 20).alias("run_id"), F.when(F.col("c_acctbal") > 0, "accepted").otherwise("rejected").alias("validation_status"), F.when(F.col("c_custkey") % 3 == 0, "yes").alias("used_fallback"))
    events = e.select((F.col("user_id") % 35).alias("run_id"), (F.col("event_id") % 7).alias("recipients"), (F.col("value") / 1000).alias("credibility"))
    return rounded(P.hostile_metrics(s.select((F.col("s_suppkey") % 25).alias("run_id")), events, calls, decisions), 5)


QUERIES = {f.__name__: f for n, f in list(globals().items()) if n.startswith("q_") and f is not q_issue_table}

# fmt: off
_hz = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE, {max(0.1, r)}::DOUBLE, {s}::DOUBLE)" for _, _, x, y, r, s in HAZARDS)
_named = "n AS (SELECT part.*, r_name AS name FROM part JOIN region ON p_partkey % 5 = r_regionkey)"
def _rows(runs: str, joins: str, names: tuple[str, ...]) -> str:
    """One row per run and metric of tables joined to runs."""
    return f"SELECT run_id, unnest([{', '.join(repr(n) for n in names)}]) AS metric, round(unnest([{', '.join(f'coalesce({n}, 0)::DOUBLE' for n in names)}]), 5) AS value FROM ({runs}) {joins}"


SQL = {
    "q_hazard_metrics": """WITH h AS (SELECT p_partkey % 40 AS run_id, count(*) AS hazard_count, count(*) FILTER (p_partkey % 3 = 0) AS imported_hazard_count, count(*) FILTER (p_partkey % 3 <> 0) AS stylized_hazard_count, max(p_retailprice / 100) AS max_hazard_radius_m, max(p_size / 50) AS max_hazard_severity,
      max(p_size / 10) FILTER (p_partkey % 3 = 0) AS max_imported_gas_concentration, min(CASE WHEN p_size > 5 THEN p_size ELSE 0 END) FILTER (p_partkey % 3 = 0) AS min_imported_visibility_m, 0 AS max_obscuration_percent_m FROM part GROUP BY 1),
      a AS (SELECT l_suppkey % 50 AS run_id, avg(l_quantity / 10) AS mean_agent_hazard_load, max(l_quantity / 10) AS max_agent_hazard_load, avg(l_tax) AS mean_agent_hazard_exposure, max(l_tax) AS max_agent_hazard_exposure FROM lineitem GROUP BY 1) """
      + _rows("SELECT run_id FROM h UNION SELECT run_id FROM a", "LEFT JOIN h USING (run_id) LEFT JOIN a USING (run_id)", ("hazard_count", "imported_hazard_count", "stylized_hazard_count", "max_hazard_radius_m", "max_hazard_severity", "max_imported_gas_concentration", "min_imported_visibility_m", "max_obscuration_percent_m", "mean_agent_hazard_load", "max_agent_hazard_load", "mean_agent_hazard_exposure", "max_agent_hazard_exposure")),
    "q_transport_metrics": """WITH c AS (SELECT c_nationkey AS run_id, c_custkey AS id, c_custkey % 4 IN (0, 1, 3) AS v, c_custkey % 4 = 0 AS e FROM customer), o AS (SELECT c.*, o_orderkey % 17 AS q, o_totalprice / 100000 AS u FROM orders JOIN c ON id = o_custkey),
      k AS (SELECT run_id, count(*) AS connector_count, count(*) FILTER (v) AS vertical_connector_count, count(*) FILTER (e) AS elevator_count FROM c GROUP BY 1),
      m AS (SELECT run_id, count(*) FILTER (v) AS vertical_connector_usage, count(*) FILTER (e) AS elevator_usage, max(q) AS max_connector_queue_length, max(u) AS max_connector_capacity_used, max(q) FILTER (e) AS max_elevator_queue_length, max(u) FILTER (e) AS max_elevator_capacity_used FROM o GROUP BY 1) """
      + _rows("SELECT run_id FROM k", "LEFT JOIN k USING (run_id) LEFT JOIN m USING (run_id)", ("connector_count", "vertical_connector_count", "elevator_count", "vertical_connector_usage", "elevator_usage", "max_connector_queue_length", "max_connector_capacity_used", "max_elevator_queue_length", "max_elevator_capacity_used")),
    "q_hostile_metrics": """WITH a AS (SELECT s_suppkey % 25 AS run_id, count(*) AS hostile_channel_count FROM supplier GROUP BY 1), b AS (SELECT user_id % 35 AS run_id, count(*) AS hostile_channel_event_count, sum(event_id % 7) AS hostile_channel_recipients, avg(value / 1000) AS mean_hostile_credibility FROM events GROUP BY 1),
      c AS (SELECT o_custkey % 30 AS run_id, count(*) AS llm_call_count, count(*) FILTER (o_orderstatus = 'F') AS llm_accepted_count, count(*) FILTER (o_orderstatus = 'O') AS llm_rejected_count, count(*) FILTER (o_orderkey % 5 = 0) AS llm_fallback_count, count(*) FILTER (o_orderkey % 4 = 0) AS llm_cache_hit_count,
        count(*) FILTER (o_orderkey % 4 = 1) AS llm_cache_miss_count, count(*) FILTER (o_orderkey % 4 = 2 OR o_orderkey % 9 = 0) AS llm_budget_blocked_count FROM orders GROUP BY 1),
      d AS (SELECT c_custkey % 20 AS run_id, count(*) AS agent_llm_decision_count, count(*) FILTER (c_acctbal > 0) AS agent_llm_accepted_count, count(*) FILTER (NOT c_acctbal > 0) AS agent_llm_rejected_count, count(*) FILTER (c_custkey % 3 = 0) AS agent_llm_fallback_count FROM customer GROUP BY 1) """
      + _rows("SELECT run_id FROM a UNION SELECT run_id FROM b UNION SELECT run_id FROM c UNION SELECT run_id FROM d", "LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id) LEFT JOIN c USING (run_id) LEFT JOIN d USING (run_id)", ("hostile_channel_count", "hostile_channel_event_count", "hostile_channel_recipients", "mean_hostile_credibility", "llm_call_count", "llm_accepted_count", "llm_rejected_count", "llm_fallback_count", "llm_cache_hit_count", "llm_cache_miss_count", "llm_budget_blocked_count", "agent_llm_decision_count", "agent_llm_accepted_count", "agent_llm_rejected_count", "agent_llm_fallback_count")),
    "q_replan_reasons": f"""WITH {TRAJ_SQL}, d AS (SELECT agent_id, event_id, time_s, event_id % 7 AS tr, event_id % 23 - 1 AS nr, x / 10.1::DOUBLE AS v, y / 20 AS f, speed / 3 AS h, event_id % 5 AS bs, event_id % 6 - 1 AS ns FROM traj),
      l AS (SELECT *, v - coalesce(lag(v) OVER w, 1.0) AS dv, f - coalesce(lag(f) OVER w, 0.0) AS df, h - coalesce(lag(h) OVER w, 0.0) AS dh FROM d WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id))
      SELECT agent_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'blocked_path' WHEN nr >= 0 AND tr > nr THEN 'topology_changed' WHEN -dv >= 0.35::DOUBLE THEN 'visibility_drop' WHEN df >= 0.2::DOUBLE THEN 'flood_depth_rise' WHEN dh >= 0.3::DOUBLE THEN 'hazard_spike' WHEN ns >= 0 AND bs > ns THEN 'belief_update' END AS reason FROM l""",
    "q_generation_report": """WITH m AS (SELECT *, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS p FROM orders),
      t AS (SELECT o_orderpriority AS v, p, 'e' || (k % 7) AS e FROM m UNION SELECT o_orderpriority, p, 'e' || (k % 11) FROM m), d AS (SELECT v, p, count(DISTINCT e) AS n FROM t GROUP BY 1, 2),
      g AS (SELECT o_orderpriority AS v, p, count(*) AS events, sum(k % 9)::BIGINT AS recipients, count(*) FILTER (k % 3 = 0) AS cache_hits, count(*) FILTER (k % 3 = 1) AS cache_misses, count(*) FILTER (k % 3 = 2) AS cache_disabled, count(*) FILTER (k % 4 <> 0) AS accepted, count(*) FILTER (k % 4 = 0) AS rejected,
        count(DISTINCT CASE WHEN k % 10 <> 0 THEN k % 100 END) AS unique_cache_keys, count(*) FILTER (k % 5 = 0) AS fallback_events, avg(CASE WHEN k % 6 <> 0 THEN o_totalprice / 1000 END) AS c, count(*) FILTER (k % 13 = 0) AS raw_congested_recommendations, avg(k % 8 / 8) AS e FROM m GROUP BY 1, 2)
      SELECT g.v AS variant_name, g.p AS generation_provider, events, recipients, cache_hits, cache_misses, cache_disabled, accepted, rejected, unique_cache_keys, fallback_events, round(coalesce(c, 0), 4) AS mean_generated_confidence, n AS recommendation_diversity, 0 AS avoidance_diversity,
        raw_congested_recommendations, round(e, 4) AS mean_entropy_delta, NULL::DOUBLE AS mean_accuracy_delta FROM g JOIN d ON d.v = g.v AND d.p IS NOT DISTINCT FROM g.p""",
    "q_hazard_config_issues": """SELECT p_partkey, 'error' AS severity, 'invalid_hazard_config' AS code, s AS source FROM part, (VALUES ('hazards[1]'), ('hazards[2]')) v(s) WHERE p_partkey % 4 = 0
      UNION ALL SELECT p_partkey, 'error', 'invalid_hazard_config', 'hazards' FROM part WHERE p_partkey % 4 = 1""",
    "q_floor_tokens": f"""WITH {BUILDINGS_SQL} SELECT building AS floor_id, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS cells, count(*) FILTER (walkable) AS walkable, count(*) FILTER (walkable AND cell_key % 29 = 0) AS exits, count(*) FILTER (NOT walkable) AS walls FROM g GROUP BY 1""",
    "q_issue_totals": f"SELECT source, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT code) AS codes FROM ({STRUCTURE_SQL['q_issue_table']}) GROUP BY 1",
    "q_series_union": f"""WITH {RUNS_SQL} SELECT status, count(*) AS n, count(DISTINCT seed) AS seeds, 'test' AS series FROM runs WHERE variant_name = '1-URGENT' GROUP BY 1 UNION ALL SELECT status, count(*), NULL, 'baseline' FROM runs WHERE variant_name = '5-LOW' GROUP BY 1""",
    "q_intent_counts": f"WITH {TRAJ_SQL} SELECT run_id, k AS step, floor(y)::INT AS y, floor(x)::INT AS x, variant_name AS intent, count(*) AS count FROM traj GROUP BY ALL",
    "q_calibration_results": """WITH g AS (SELECT o_orderpriority AS candidate, count(*) / 10 AS c, avg(o_totalprice) / 1000 AS f, max(o_orderkey) / 100 AS h FROM orders GROUP BY 1), e AS (SELECT *, (f - 250) / 25 AS ef, (h - 250) / 25 AS eh, (c - 250) / 25 AS ec FROM g)
      SELECT candidate, round(ef, 4) AS mean_flow_pct_delta, round(f, 4) AS simulated_mean_flow, 250.0::DOUBLE AS reference_mean_flow, round(eh, 4) AS mean_time_headway_pct_delta, round(h, 4) AS simulated_mean_time_headway, 250.0::DOUBLE AS reference_mean_time_headway,
      round(ec, 4) AS crossing_count_pct_delta, round(c, 4) AS simulated_crossing_count, 250.0::DOUBLE AS reference_crossing_count, round(abs(ef) + 0.5 * abs(eh) + 0.5 * abs(ec), 4) AS calibration_score,
      CASE WHEN abs(ef) <= 15 AND abs(eh) <= 25 AND abs(ec) <= 10 THEN 'calibrated_bottleneck_flow_match' ELSE 'diagnostic_gap' END AS claim_status FROM e""",
    "q_cascades": f"""WITH {TRAJ_SQL}, s AS (SELECT run_id, event_id AS step, floor(time_s) / 100 AS t, avg(value) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM traj WHERE agent_id < 60 OR event_id < 3),
      d AS (SELECT *, t - lag(t) OVER w AS dt, h - lag(h) OVER w AS dh FROM s WINDOW w AS (PARTITION BY run_id ORDER BY step)), r AS (SELECT run_id, CASE WHEN count(*) >= 5 AND bool_or(dt > 0) THEN coalesce(max(CASE WHEN dt > 0 THEN -dh / dt WHEN dt IS NOT NULL THEN 0 END), 0) ELSE 0 END AS rate FROM d GROUP BY 1)
      SELECT run_id, round(rate, 6) AS max_cascade_rate, rate > 0.1 AS detected FROM r""",
    "q_projection": f"""WITH {TRAJ_SQL}, h(hx, hy, r, s) AS (VALUES {_hz}), a AS (SELECT event_id, speed / 10 AS entropy, sqrt((x - 5) * (x - 5) + (y - 4) * (y - 4)) <= 3.5 AS near, max(greatest(0, 1 - sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) / r) * s) AS p FROM traj, h GROUP BY ALL),
      g AS (SELECT count(*) AS n, count(*) FILTER (near) AS m, avg(p) FILTER (near) AS p, avg(entropy) FILTER (near) AS u FROM a), e AS (SELECT *, 0.8::DOUBLE * 0.75 * m / n AS e FROM g)
      SELECT m AS recipients, round(0.08::DOUBLE * 0.8 * 0.75 * (0.5 + u), 6) AS mean_belief_delta, round(0.02::DOUBLE * e * (1 + p), 6) AS harmful_convergence_delta, round(0.08::DOUBLE * e * (0.25 + p), 6) AS exposure_delta FROM e""",
    "q_keyframe_points": f"""WITH {TRAJ_SQL}, s AS (SELECT run_id, k, row_number() OVER (PARTITION BY run_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM (SELECT DISTINCT run_id, k FROM traj))
      SELECT run_id, k AS step, agent_id, x, y, speed AS value FROM traj JOIN s USING (run_id, k) WHERE i = 0 OR i = n // 2 OR i = n - 1""",
    "q_first_events": f"WITH {TRAJ_SQL} SELECT run_id, k AS step, event_id FROM traj QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k, event_id) <= 20",
    "q_frontier_rows": """WITH g AS (SELECT o_orderpriority AS v, round(avg(o_totalprice), 2) AS e, count(DISTINCT o_custkey % 20)::DOUBLE AS i FROM orders GROUP BY 1)
      SELECT v AS variant_name, 'information_safety_efficiency' AS metric, e AS value FROM g UNION ALL SELECT v, 'exit_imbalance', i FROM g""",
    "q_equity_bars": "SELECT c_mktsegment AS subgroup_tag, c_nationkey AS variant_name, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2",
    "q_prompt_payloads": """WITH o AS (SELECT *, (['minimal', 'state_only', 'urgency', 'safety'])[o_orderkey % 4 + 1] AS s, '"exits":"x","hazards":"y","congested_exits":"z"' AS st, CASE WHEN o_orderkey % 3 <> 0 THEN ',"recipients_estimate":' || o_custkey ELSE '' END AS re FROM orders)
      SELECT o_orderkey, s AS prompt_style, '{"prompt_style":"' || s || '",' || CASE s WHEN 'minimal' THEN st WHEN 'state_only' THEN '"target":"' || o_orderstatus || '",' || st || re
        WHEN 'urgency' THEN '"policy":"' || o_orderpriority || '","step":' || (o_orderkey % 50) || ',"target":"' || o_orderstatus || '",' || st || re || ',"control_objective":"urgency"'
        ELSE '"o_orderkey":' || o_orderkey || ',"policy":"' || o_orderpriority || '","step":' || (o_orderkey % 50) || ',"target":"' || o_orderstatus || '",' || st || re || ',"seed":' || o_custkey END || '}' AS payload FROM o""",
    "q_hostile_claims": """WITH m AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS threat, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS e, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS h FROM orders),
      r AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'generator_abstained' WHEN k % 5 = 0 THEN 'attack' WHEN threat AND h IS NULL THEN 'missing_claimed_hazard' WHEN NOT threat AND e IS NULL THEN 'missing_claimed_exit' ELSE '' END AS why FROM m)
      SELECT k AS message_id, CASE WHEN why <> '' THEN 'fx' WHEN NOT threat THEN e END AS claimed_exit, CASE WHEN why <> '' THEN 'fh' WHEN threat THEN h END AS claimed_hazard, why <> '' AS used_fallback, CASE WHEN why = 'attack' THEN 'attack_pattern:coercive_persuasion' ELSE why END AS reasons FROM r""",
    "q_parameter_profiles": f"""WITH {_named}, p AS (SELECT p_name AS profile, name, max(p_retailprice) AS value, max(p_brand) AS provenance FROM n WHERE p_partkey % 2 = 0 GROUP BY 1, 2), o AS (SELECT p_name AS profile, name, min(p_retailprice) AS value FROM n WHERE p_partkey % 3 = 0 GROUP BY 1, 2),
      k AS (SELECT profile FROM p UNION SELECT profile FROM o) SELECT k.profile, r_name AS name, coalesce(o.value, p.value, r_regionkey::DOUBLE) AS value, CASE WHEN o.value IS NULL THEN provenance END AS provenance, CASE WHEN o.value IS NOT NULL THEN 'override' WHEN p.value IS NOT NULL THEN 'profile' ELSE 'base' END AS source
      FROM k CROSS JOIN region LEFT JOIN p ON p.profile = k.profile AND p.name = r_name LEFT JOIN o ON o.profile = k.profile AND o.name = r_name""",
    "q_congestion_share": "WITH f AS (SELECT o_custkey, o_orderstatus, count(*) AS flow FROM orders GROUP BY 1, 2), s AS (SELECT *, flow / sum(flow) OVER (PARTITION BY o_custkey) AS share FROM f) SELECT o_custkey, o_orderstatus, flow, round(share, 6) AS share, share >= 0.5 AS congested FROM s",
    "q_filled_documents": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 1.5 WHEN c_custkey % 2 = 0 THEN c_custkey % 10 / 4 END::DOUBLE AS base_speed, CASE WHEN c_custkey % 2 = 0 THEN 0.5 END::DOUBLE AS trust, c_nationkey AS count, NULL::VARCHAR AS secret,
      CASE WHEN c_custkey % 2 = 0 THEN 1 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END END AS applied, CASE WHEN c_custkey % 2 = 0 THEN 1 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END END AS kept, CASE WHEN c_custkey % 2 = 0 THEN 2 END AS refused FROM customer""",
}
# fmt: on
