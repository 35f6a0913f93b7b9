"""Scenario audits and evidence over the harness tables: regions and nations as scenarios, hazards, connectors and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import aggregates as A
from egresslake.operators import evidence as E
from egresslake.plans.summary_queries import people, telemetry
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import TRAJ_SQL, table, traj

OBJECTIVES = ("funnel", "panic", "delay")


def scenario_rows(spark, sf_dir):
    """One scenario per region."""
    r = F.col("r_regionkey")
    profile = F.when(r % 2 == 0, "generic_legacy").otherwise("station")
    return table(spark, sf_dir, "region").select(
        r.cast("long").alias("scenario_id"), (r * 10).alias("population_total"), (r % 3).alias("responder_count"), profile.alias("sfm_profile"), (r == 1).alias("has_sfm_provenance"),
        (r * 0.75 + 0.25).alias("desired_speed_mps"), (r - 1.0).alias("relaxation_time_s"), (r % 2 == 1).alias("required"),
    )


def by_nation(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("scenario_id"), n.cast("long").alias("n"))


def layout_rows(spark, sf_dir):
    """A 12 x 6 layout per region: walls where 7 x + 11 y + id is 0 mod 4, no exit in region 4."""
    s = scenario_rows(spark, sf_dir).select("scenario_id")
    c = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(71)))).select("scenario_id", (F.col("i") % 12).alias("x"), F.floor(F.col("i") / 12).cast("int").alias("y"))
    wall = (F.col("x") * 7 + F.col("y") * 11 + F.col("scenario_id")) % 4 == 0
    out = (F.col("scenario_id") < 4) & (F.col("x") == 11) & (F.col("y") == F.col("scenario_id"))
    return c.withColumn("token", F.when(out, "E").when(wall, "X").otherwise("."))


def static_issues(spark, sf_dir):
    n = by_nation(spark, sf_dir)
    starts = n.filter("scenario_id <> 2").select("scenario_id", F.when(F.col("n") % 5 == 0, "responder").otherwise("spawn").alias("kind"), (F.col("n") % 14).cast("int").alias("x"), (F.col("n") % 6).cast("int").alias("y"))
    channels = n.select("scenario_id", F.element_at(F.array(*[F.lit(o) for o in (*OBJECTIVES, "other")]), (F.col("n") % 4 + 1).cast("int")).alias("objective"))
    return E.static_audit(scenario_rows(spark, sf_dir), layout_rows(spark, sf_dir), starts, channels, OBJECTIVES)


def q_static_audit(spark, sf_dir):
    return static_issues(spark, sf_dir).filter("code not in ('start_unreachable', 'unreachable_walkable_cells')").groupBy("scenario_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def q_static_reach(spark, sf_dir):
    return static_issues(spark, sf_dir).filter("code in ('start_unreachable', 'unreachable_walkable_cells')").groupBy("scenario_id", "code").agg(F.count(F.lit(1)).alias("n"))


def geometry_issues(spark, sf_dir):
    n = F.col("n")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("stairs", "elevator", "ramp")]), (n % 3 + 1).cast("int"))
    c = by_nation(spark, sf_dir).filter("scenario_id <> 3").select(
        "scenario_id", F.concat(F.lit("c"), (n % 4).cast("string")).alias("connector_id"), kind.alias("kind"), (n % 7 - 1).cast("double").alias("width"), (n % 5).cast("double").alias("speed"), F.when(n % 2 == 0, n % 6).alias("capacity"),
        (n % 4).cast("double").alias("travel_s"), F.lit(0.0).alias("dwell_s"), (n % 3 - 1).cast("double").alias("height_delta"), (n % 6).alias("sx"), F.lit(0).alias("sy"), (n % 8).alias("tx"), F.lit(0).alias("ty"),
    )
    return E.geometry_audit(c, by_nation(spark, sf_dir).select("scenario_id", F.concat(F.lit("f"), (n % 2).cast("string")).alias("floor_id")))


def counted(df):
    return df.groupBy("scenario_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def q_geometry_audit(spark, sf_dir):
    return counted(geometry_issues(spark, sf_dir))


def hazard_rows(spark, sf_dir):
    n = F.col("n")
    return by_nation(spark, sf_dir).select("scenario_id", n.alias("hazard_id"), (n % 2 == 0).alias("imported"), F.when(n % 4 == 0, "field.csv").alias("field_file"), (n % 3 == 0).alias("has_reference"), (n % 7 / 5).alias("severity"))


def q_hazard_audit(spark, sf_dir):
    return counted(E.hazard_audit(hazard_rows(spark, sf_dir)))


def q_calibration_audit(spark, sf_dir):
    c = by_nation(spark, sf_dir).filter("scenario_id < 3").select("scenario_id", F.col("n").cast("string").alias("cohort_name"), (F.col("n") % 8 / 2).alias("base_speed_mps"))
    return counted(E.calibration_audit(scenario_rows(spark, sf_dir), c))


def evidence_rows(spark, sf_dir):
    n = F.col("n")
    kind = F.element_at(F.array(*[F.lit(k) for k in (*E.EVIDENCE_TYPES, "rumour")]), (n % 5 + 1).cast("int"))
    return by_nation(spark, sf_dir).filter("scenario_id > 1").select(
        "scenario_id", n.alias("record"), kind.alias("type"), F.when(n % 3 != 0, "s").alias("source_name"), F.when(n % 4 != 0, "u").otherwise("").alias("validation_use"), F.lit("all").alias("scope"), F.when(n % 2 == 0, "f").alias("file"), (n % 4 == 0).alias("file_exists"),
    )


def q_evidence_audit(spark, sf_dir):
    return counted(E.evidence_audit(scenario_rows(spark, sf_dir), evidence_rows(spark, sf_dir)))


def q_claim_support(spark, sf_dir):
    return E.claim_support(scenario_rows(spark, sf_dir), evidence_rows(spark, sf_dir))


def swept(spark, sf_dir):
    return E.sweep(scenario_rows(spark, sf_dir), {"hazard": E.hazard_audit(hazard_rows(spark, sf_dir)), "evidence": E.evidence_audit(scenario_rows(spark, sf_dir), evidence_rows(spark, sf_dir)), "geometry": geometry_issues(spark, sf_dir)})


def q_corpus_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


def q_benchmark_evidence(spark, sf_dir):
    checks = by_nation(spark, sf_dir).filter("n % 2 = 0 and scenario_id <> 0").select("scenario_id", (F.col("n") % 3).alias("issues"))
    support = E.claim_support(scenario_rows(spark, sf_dir), evidence_rows(spark, sf_dir))
    return E.benchmark_evidence(swept(spark, sf_dir), hazard_rows(spark, sf_dir), support, checks).drop("hazard_issues", "evidence_issues", "geometry_issues", "errors", "warnings", "ok")


def q_completion_fraction(spark, sf_dir):
    return rounded(E.completion_fraction(people(spark, sf_dir), ["run_id"]))


def q_exit_spread(spark, sf_dir):
    f = telemetry(spark, sf_dir)["exits"].select("run_id", "exit_label", F.col("flow_cumulative").alias("n"))
    return rounded(E.exit_spread(f, ["run_id"]))


def plausible(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    steps = t["steps"].withColumn("peak_cell_occupancy", F.col("step"))
    dwell = t["bottlenecks"].select("run_id", (F.col("outflow") / 4).alias("dwell_s"))
    return E.plausibility(t["agent_steps"], steps, t["bottlenecks"], dwell, ["run_id"], 0.5)


def q_plausibility(spark, sf_dir):
    return rounded(plausible(spark, sf_dir), 8)


def q_rule_checks(spark, sf_dir):
    m = plausible(spark, sf_dir).groupBy("metric").agg(F.max("value").alias("value"))
    r = spark.createDataFrame([("max_mean_density", None, 0.0, 0.01), ("stuck_agent_steps", -1.0, None, None), ("max_agent_speed_mps", None, 1e6, None), ("mean_density", None, 0.0, None), ("not_there", None, 0.0, 1.0)], "metric string, eq double, least double, most double")
    return E.check_rules(m, r).select("metric", "code")


def q_safety_frontier(spark, sf_dir):
    r = F.col("scenario_id")
    s = scenario_rows(spark, sf_dir).select(
        r, (r * 40).alias("population"), (r % 3).alias("exits"), F.lit(400).alias("walkable"), (r / 8).alias("mean_familiarity"), F.lit(5.0).alias("observation_radius"), F.lit(8.0).alias("beacon_radius"), F.lit(2.0).alias("gossip_radius"), (r * 2).alias("zones"),
        (r / 4).alias("hazard_pressure"), (r % 2 / 8).alias("hostile_bonus"), F.lit(0.0625).alias("intervention_bonus"),
    )
    return rounded(E.safety_frontier(s))


def q_detectors(spark, sf_dir):
    t = traj(spark, sf_dir)
    herd = A.gini(t.groupBy("run_id", (F.col("event_id") % 4).alias("e")).agg(F.count(F.lit(1)).alias("n")), ["run_id"], "n").select("run_id", F.col("gini").alias("score"), F.col("herding").alias("detected"))
    lane = A.lane_index(A.path_usage(A.cell_grid(t, ["run_id", "k"]), ["run_id"], "k").withColumnsRenamed({"cx": "x", "cy": "y"}), ["run_id"], "path_usage").select("run_id", F.col("lane_index").alias("score"), F.col("lanes").alias("detected"))
    return rounded(E.detectors({"herding": herd, "lanes": lane}))


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_lay = """cells AS (SELECT r_regionkey::BIGINT AS s, (i % 12)::INT AS x, (i // 12)::INT AS y FROM region, range(72) t(i)),
  lay AS (SELECT s, x, y, CASE WHEN s < 4 AND x = 11 AND y = s THEN 'E' WHEN (x * 7 + y * 11 + s) % 4 = 0 THEN 'X' ELSE '.' END AS token FROM cells),
  nat AS (SELECT n_regionkey::BIGINT AS s, n_nationkey::BIGINT AS n FROM nation), st AS (SELECT s, n % 5 = 0 AS resp, (n % 14)::INT AS x, (n % 6)::INT AS y FROM nat WHERE s <> 2)"""
_reach = """RECURSIVE cells AS (SELECT r_regionkey::BIGINT AS s, (i % 12)::INT AS x, (i // 12)::INT AS y FROM region, range(72) t(i)),
  lay AS (SELECT s, x, y, CASE WHEN s < 4 AND x = 11 AND y = s THEN 'E' WHEN (x * 7 + y * 11 + s) % 4 = 0 THEN 'X' ELSE '.' END AS token FROM cells),
  nat AS (SELECT n_regionkey::BIGINT AS s, n_nationkey::BIGINT AS n FROM nation), st AS (SELECT s, n % 5 = 0 AS resp, (n % 14)::INT AS x, (n % 6)::INT AS y FROM nat WHERE s <> 2),
  r AS (SELECT s, x, y FROM lay WHERE token = 'E' UNION SELECT l.s, l.x, l.y FROM r JOIN lay l ON l.s = r.s AND abs(l.x - r.x) + abs(l.y - r.y) = 1 AND l.token <> 'X')"""
_geo = """c AS (SELECT s, 'c' || (n % 4) AS id, (['stairs', 'elevator', 'ramp'])[n % 3 + 1] AS kind, n % 7 - 1 AS width, n % 5 AS speed, CASE WHEN n % 2 = 0 THEN n % 6 END AS cap, n % 4 AS travel, n % 3 - 1 AS h, n % 6 AS sx, n % 8 AS tx FROM nat WHERE s <> 3),
  geo AS (SELECT s, 'error' AS severity, 'connector_nonpositive_width' AS code FROM c WHERE width <= 0 UNION ALL SELECT s, 'error', 'connector_nonpositive_speed' FROM c WHERE speed <= 0 UNION ALL SELECT s, 'error', 'connector_nonpositive_capacity' FROM c WHERE cap <= 0
    UNION ALL SELECT s, 'warning', 'connector_self_loop' FROM c WHERE sx = tx UNION ALL SELECT s, 'warning', 'vertical_connector_without_vertical_delta' FROM c WHERE kind IN ('stairs', 'elevator') AND h = 0 UNION ALL SELECT s, 'warning', 'elevator_without_service_timing' FROM c WHERE kind = 'elevator' AND cap IS NULL AND travel <= 0
    UNION ALL SELECT s, 'error', 'duplicate_connector_id' FROM (SELECT s, id FROM c GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT s, 'warning', 'multifloor_without_connectors' FROM (SELECT s FROM nat WHERE s = 3 GROUP BY 1 HAVING count(DISTINCT n % 2) > 1))"""
_haz = """haz AS (SELECT s, 'error' AS severity, 'imported_hazard_missing_file' AS code FROM nat WHERE n % 2 = 0 AND n % 4 <> 0 UNION ALL SELECT s, 'warning', 'imported_hazard_without_reference_scope' FROM nat WHERE n % 2 = 0 AND n % 3 <> 0 UNION ALL SELECT s, 'warning', 'stylized_hazard' FROM nat WHERE n % 2 = 1
  UNION ALL SELECT s, 'error', 'hazard_severity_out_of_range' FROM nat WHERE n % 7 > 5)"""
_evi = """evi AS (SELECT s, 'error' AS severity, 'unsupported_validation_evidence_type' AS code FROM nat WHERE s > 1 AND n % 5 = 4 UNION ALL SELECT s, 'error', 'validation_evidence_field_missing' FROM nat WHERE s > 1 AND n % 3 = 0 UNION ALL SELECT s, 'error', 'validation_evidence_field_missing' FROM nat WHERE s > 1 AND n % 4 = 0
  UNION ALL SELECT s, 'error', 'validation_evidence_file_missing' FROM nat WHERE s > 1 AND n % 2 = 0 AND n % 4 <> 0 UNION ALL SELECT DISTINCT s, CASE WHEN s = 1 THEN 'error' ELSE 'warning' END, CASE WHEN s = 1 THEN 'external_validation_evidence_required' ELSE 'external_validation_evidence_missing' END FROM nat WHERE s < 2)"""
_nat = "nat AS (SELECT n_regionkey::BIGINT AS s, n_nationkey::BIGINT AS n FROM nation)"
_n = "SELECT s AS scenario_id, severity, code, count(*) AS n FROM {0} GROUP BY 1, 2, 3"
_sup = "sup AS (SELECT r_regionkey::BIGINT AS s, count(n) FILTER (r_regionkey > 1) AS records, count(n) FILTER (r_regionkey > 1 AND n % 5 < 3) AS operational FROM region LEFT JOIN nat ON s = r_regionkey GROUP BY 1)"
# fmt: off
SQL = {
    "q_static_audit": f"""WITH {_lay}, by_s AS (SELECT r_regionkey::BIGINT AS s, (SELECT count(*) FROM lay WHERE s = r_regionkey AND token = 'E') AS e, (SELECT count(*) FROM st WHERE s = r_regionkey AND NOT resp) AS sp, (SELECT count(*) FROM st WHERE s = r_regionkey AND resp) AS en FROM region),
      i AS (SELECT s, 'error' AS severity, 'no_exits' AS code FROM by_s WHERE e = 0 UNION ALL SELECT s, 'warning', 'implicit_population_spawn' FROM by_s WHERE s * 10 > 0 AND sp = 0 UNION ALL SELECT s, 'warning', 'implicit_responder_spawn' FROM by_s WHERE s % 3 > 0 AND en = 0
        UNION ALL SELECT s, 'error', 'start_out_of_bounds' FROM st WHERE x > 11 UNION ALL SELECT st.s, 'error', 'start_on_wall' FROM st JOIN lay USING (s, x, y) WHERE token = 'X' UNION ALL SELECT st.s, 'warning', 'start_on_exit' FROM st JOIN lay USING (s, x, y) WHERE token = 'E'
        UNION ALL SELECT s, 'error', 'unknown_hostile_objective' FROM nat WHERE n % 4 = 3) {_n.format('i')}""",
    "q_static_reach": f"""WITH {_reach}, lost AS (SELECT s, x, y FROM lay WHERE token <> 'X' AND s < 4 EXCEPT SELECT s, x, y FROM r) SELECT scenario_id, code, count(*) AS n FROM (SELECT st.s AS scenario_id, 'start_unreachable' AS code FROM st JOIN lost USING (s, x, y) UNION ALL SELECT DISTINCT s, 'unreachable_walkable_cells' FROM lost) GROUP BY 1, 2""",
    "q_geometry_audit": f"WITH {_nat}, {_geo} {_n.format('geo')}",
    "q_hazard_audit": f"WITH {_nat}, {_haz} {_n.format('haz')}",
    "q_calibration_audit": f"""WITH {_nat}, k AS (SELECT r_regionkey::BIGINT AS s FROM region), i AS (SELECT s, 'warning' AS severity, 'generic_social_force_profile' AS code FROM k WHERE s % 2 = 0 UNION ALL SELECT s, 'warning', 'social_force_provenance_missing' FROM k WHERE s <> 1
      UNION ALL SELECT s, 'error', 'desired_speed_mps' FROM k WHERE s * 0.75 + 0.25 > 3 UNION ALL SELECT s, 'error', 'relaxation_time_s' FROM k WHERE s - 1 <= 0 UNION ALL SELECT s, 'warning', 'implicit_population_calibration' FROM k WHERE s >= 3
      UNION ALL SELECT s, 'error', 'cohort_base_speed_mps' FROM nat WHERE s < 3 AND (n % 8 = 0 OR n % 8 > 6)) {_n.format('i')}""",
    "q_evidence_audit": f"WITH {_nat}, {_evi} {_n.format('evi')}",
    "q_claim_support": f"WITH {_nat}, {_sup} SELECT s AS scenario_id, records, operational, CASE WHEN operational > 0 THEN 'external_evidence_recorded' WHEN records > 0 THEN 'documented_limits' ELSE 'none' END AS claim_support FROM sup",
    "q_corpus_sweep": f"""WITH {_nat}, {_geo}, {_haz}, {_evi}, u AS (SELECT *, 'g' AS a FROM geo UNION ALL SELECT *, 'h' FROM haz UNION ALL SELECT *, 'e' FROM evi)
      SELECT r_regionkey::BIGINT AS scenario_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (a = 'h') AS hazard_issues, count(*) FILTER (a = 'e') AS evidence_issues, count(*) FILTER (a = 'g') AS geometry_issues, count(*) FILTER (severity = 'error') = 0 AS ok FROM region LEFT JOIN u ON s = r_regionkey GROUP BY 1""",
    "q_benchmark_evidence": f"""WITH {_nat}, {_sup}, h AS (SELECT s, count(*) FILTER (n % 2 = 1) AS st, count(*) FILTER (n % 2 = 0) AS im FROM nat GROUP BY 1), a AS (SELECT s, sum(n % 3)::BIGINT AS i FROM nat WHERE n % 2 = 0 AND s <> 0 GROUP BY 1)
      SELECT sup.s AS scenario_id, st AS stylized_hazard_count, im AS imported_hazard_count, records AS external_validation_evidence_count, operational AS operational_validation_evidence_count, coalesce(i, 0) AS runtime_assertion_issue_count, i IS NOT NULL AS runtime_assertions_present, coalesce(i, 0) = 0 AS runtime_assertions_ok
      FROM sup LEFT JOIN h USING (s) LEFT JOIN a USING (s)""",
    "q_completion_fraction": "SELECT 'run_' || (c_nationkey % 5) AS run_id, round(avg((c_acctbal > 0)::INT), 6) AS evacuation_completion_fraction FROM customer WHERE c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 GROUP BY 1",
    "q_exit_spread": f"WITH {TRAJ_SQL}, f AS (SELECT run_id, event_id % 4 AS e, count(*) AS n FROM traj GROUP BY 1, 2) SELECT run_id, round(CASE WHEN count(*) > 1 THEN (max(n) - min(n)) / sum(n)::DOUBLE ELSE 0 END, 6) AS exit_imbalance FROM f GROUP BY 1",
    "q_plausibility": f"""WITH {TRAJ_SQL}, a AS (SELECT run_id, count(*) FILTER (floor(value) / 64 <= 0.5)::DOUBLE AS stuck_agent_steps, avg(floor(value) / 64) AS mean_agent_speed_mps, max(floor(value) / 64) AS max_agent_speed_mps, avg((event_id % 40) / 64.0::DOUBLE) AS mean_local_density, max((event_id % 40) / 64.0::DOUBLE) AS max_local_density FROM traj GROUP BY 1),
      s AS (SELECT run_id, avg(d) AS mean_density, max(d) AS max_mean_density, max(k)::DOUBLE AS peak_cell_occupancy FROM (SELECT run_id, k, count(*) / 8.0::DOUBLE AS d FROM traj GROUP BY 1, 2) GROUP BY 1),
      b AS (SELECT run_id, max(q)::DOUBLE AS max_bottleneck_queue_length, avg(o / 4.0::DOUBLE) AS mean_bottleneck_dwell_s, max(o / 4.0::DOUBLE) AS max_bottleneck_dwell_s FROM (SELECT run_id, k, event_id % 3 AS z, count(*) % 7 AS q, max(event_id) % 11 AS o FROM traj GROUP BY ALL) GROUP BY 1),
      j AS (SELECT * FROM a JOIN s USING (run_id) JOIN b USING (run_id)) SELECT run_id, metric, round(value, 8) AS value FROM (UNPIVOT j ON COLUMNS(* EXCLUDE (run_id)) INTO NAME metric VALUE value)""",
    "q_rule_checks": "SELECT * FROM (VALUES ('max_mean_density', 'above_maximum'), ('stuck_agent_steps', 'not_equal'), ('max_agent_speed_mps', 'below_minimum'), ('not_there', 'metric_missing')) t(metric, code) WHERE (SELECT count(*) FROM events) > 0",
    "q_safety_frontier": """WITH s AS (SELECT r_regionkey::BIGINT AS r, greatest(1, r_regionkey * 40) AS p, greatest(1, r_regionkey % 3) AS e FROM region), c AS (SELECT r, (1 - r / 8.0::DOUBLE) * least(1.0, 15 / 18.0::DOUBLE) AS er, least(1.0, greatest(0.0, 0.6::DOUBLE * least(1.0, r * 2 / (e * 3.0::DOUBLE)) + 0.4::DOUBLE * least(1.0, p / (400 * 0.45::DOUBLE)))) AS qp,
      least(1.0, r / 4.0::DOUBLE) AS xp, least(1.0, least(1.0, p / (e * 40.0::DOUBLE)) + (r % 2) / 8.0::DOUBLE + 0.0625) AS cp FROM s), v AS (SELECT *, least(1.0, er * cp * (0.55::DOUBLE * qp + 0.45::DOUBLE * xp)) AS sc FROM c)
      SELECT r AS scenario_id, round(er, 6) AS entropy_reduction_potential, round(cp, 6) AS convergence_pressure, round(qp, 6) AS queue_pressure, round(xp, 6) AS exposure_pressure, round(sc, 6) AS score,
        CASE WHEN sc >= 0.18 OR (er >= 0.45 AND cp >= 0.45 AND xp >= 0.25) THEN 'HARMFUL' WHEN sc >= 0.07 OR (er >= 0.35 AND (qp >= 0.35 OR xp >= 0.2)) THEN 'BORDERLINE' ELSE 'SAFE' END AS verdict FROM v""",
    "q_detectors": f"""WITH {TRAJ_SQL}, n AS (SELECT run_id, event_id % 4 AS e, count(*) AS n FROM traj GROUP BY 1, 2), g AS (SELECT run_id, n, sum(n) OVER (PARTITION BY run_id ORDER BY n, e ROWS UNBOUNDED PRECEDING) AS r FROM n), h AS (SELECT run_id, (count(*) + 1 - 2 * sum(r) / sum(n)::DOUBLE) / count(*) AS s FROM g GROUP BY 1),
      c AS (SELECT run_id, k, floor(x) AS x, floor(y) AS y, count(*) AS o FROM traj GROUP BY ALL), u AS (SELECT run_id, x, y, sum(o) AS p FROM c GROUP BY 1, 2, 3), l AS (SELECT run_id, stddev_samp(p) / avg(p) AS s FROM u GROUP BY 1)
      SELECT run_id, 'herding' AS detector, round(s, 6) AS score, s > 0.6 AS detected FROM h UNION ALL SELECT run_id, 'lanes', round(s, 6), s > 1.5 FROM l""",
}
# fmt: on
