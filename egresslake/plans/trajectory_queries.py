"""Trajectory operators over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from egresslake.operators import trajectory as T
from egresslake.plans.views import STEP_S, TRAJ_SQL, traj

P1, P2 = (0.0, 5.0), (10.0, 5.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q_traj_speed(spark, sf_dir):
    m = T.with_motion(traj(spark, sf_dir))
    return rounded(m.select("agent_id", "event_id", "dist_m", "dt_s", "speed_mps"))


def q_path_displacement(spark, sf_dir):
    return rounded(T.agent_paths(traj(spark, sf_dir)), 4)


def q_traj_summary(spark, sf_dir):
    t = traj(spark, sf_dir)
    return rounded(T.trajectory_summary(t, ("run_id",)).drop("mean_local_density", "p95_local_density"), 4)


def q_traj_compare(spark, sf_dir):
    t = traj(spark, sf_dir)
    return rounded(T.compare_trajectories(t, t.filter("run_id = 'run_0'")), 4)


def q_first_crossing(spark, sf_dir):
    return rounded(T.headways(T.first_crossings(traj(spark, sf_dir), P1, P2)))


def q_flow_summary(spark, sf_dir):
    return rounded(T.flow_summary(traj(spark, sf_dir), P1, P2, ("run_id",)))


def q_measurement_line(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("step", F.floor(F.col("time_s") / STEP_S))
    return rounded(T.measurement_line(t, "step", STEP_S, P1, P2, 1.0))


def q_zone_dwell(spark, sf_dir):
    v = T.zone_visits(traj(spark, sf_dir), "variant_name")
    return rounded(v.groupBy("variant_name").agg(F.count(F.lit(1)).alias("visits"), F.count("dwell_s").alias("closed"), F.avg("dwell_s").alias("mean_dwell_s"), F.max("samples").alias("longest")), 4)


def q_trail(spark, sf_dir):
    t = T.trails(traj(spark, sf_dir))
    return rounded(t.select("agent_id", "event_id", F.size("trail").alias("n"), F.aggregate("trail", F.lit(0.0), lambda a, p: a + p[0]).alias("sum_x")))


def q_dose(spark, sf_dir):
    m = T.with_motion(traj(spark, sf_dir)).withColumn("dt", F.coalesce("dt_s", F.lit(0.0)) / 3600)
    return rounded(T.dose(m, "speed", "dt").select("agent_id", "event_id", "dose", "peak"), 4)


def q_rolling_entropy(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("hour", F.floor(F.col("time_s") / STEP_S)).groupBy("run_id", "hour").agg(F.avg("speed").alias("h"))
    w = Window.partitionBy("run_id").orderBy("hour")
    t = t.withColumn("smooth", T.rolling_mean(F.col("h"), ["run_id"], ["hour"]))
    drop = -(F.col("smooth") - F.lag("smooth").over(w)) / (F.col("hour") - F.lag("hour").over(w))
    t = t.withColumn("rate", drop)
    return rounded(t.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps"), F.max("rate").alias("max_rate"), (F.max("rate") > 0.1).alias("cascade")))


QUERIES = {f.__name__: f for f in (q_traj_summary, q_traj_speed, q_path_displacement, q_traj_compare, q_first_crossing, q_flow_summary, q_measurement_line, q_zone_dwell, q_trail, q_dose, q_rolling_entropy)}

MOTION_SQL = f"""{TRAJ_SQL},
m AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS dist_m,
             time_s - lag(time_s) OVER w AS dt_s FROM traj WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id)),
v AS (SELECT *, CASE WHEN dt_s > 0 THEN dist_m / dt_s END AS speed_mps FROM m),
p AS (SELECT run_id, agent_id, count(*) AS samples, min(time_s) AS first_s, max(time_s) AS last_s, coalesce(sum(dist_m), 0.0) AS path_m,
             sqrt((arg_min(x, (time_s, event_id)) - arg_max(x, (time_s, event_id))) ** 2 + (arg_min(y, (time_s, event_id)) - arg_max(y, (time_s, event_id))) ** 2) AS displacement_m
      FROM m GROUP BY run_id, agent_id)"""
# The line is y = 5 from x = 0 to 10: signed distance y - 5, place along it x.
CROSS_SQL = f"""{TRAJ_SQL},
c0 AS (SELECT *, y - 5.0 AS side, lag(y - 5.0) OVER w AS ps, (x + lag(x) OVER w) / 2 AS along, lag(time_s) OVER w AS before_s
       FROM traj WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id)),
c AS (SELECT *, coalesce(ps * side < 0 AND along BETWEEN -0.5 AND 10.5, false) AS crossed FROM c0),
f AS (SELECT run_id, agent_id, arg_min(time_s, (time_s, event_id)) AS crossing_time_s, arg_min(before_s, (time_s, event_id)) AS previous_time_s
      FROM c WHERE crossed GROUP BY run_id, agent_id)"""
_SUMMARY = """SELECT {0} count(*) AS agent_count, sum(samples)::BIGINT AS sample_count, max(last_s) - min(first_s) AS duration_s, avg(last_s - first_s) AS mean_agent_duration_s,
  avg(path_m) AS mean_path_length_m, quantile_cont(path_m, 0.95) AS p95_path_length_m, avg(displacement_m) AS mean_displacement_m FROM {1}"""
# fmt: off
SQL = {
    "q_traj_speed": f"WITH {MOTION_SQL} SELECT agent_id, event_id, round(dist_m, 6) AS dist_m, round(dt_s, 6) AS dt_s, round(speed_mps, 6) AS speed_mps FROM v",
    "q_path_displacement": f"WITH {MOTION_SQL} SELECT agent_id, samples, round(first_s, 4) AS first_s, round(last_s, 4) AS last_s, round(path_m, 4) AS path_m, round(displacement_m, 4) AS displacement_m FROM p",
    "q_traj_summary": f"""WITH {MOTION_SQL}, s AS ({_SUMMARY.format('run_id,', 'p GROUP BY run_id')}),
      r AS (SELECT run_id, avg(speed_mps) AS mean_speed_mps, quantile_cont(speed_mps, 0.95) AS p95_speed_mps FROM v GROUP BY run_id)
      SELECT run_id, agent_count, sample_count, round(duration_s, 4) AS duration_s, round(mean_agent_duration_s, 4) AS mean_agent_duration_s, round(mean_path_length_m, 4) AS mean_path_length_m,
      round(p95_path_length_m, 4) AS p95_path_length_m, round(mean_displacement_m, 4) AS mean_displacement_m, round(mean_speed_mps, 4) AS mean_speed_mps, round(p95_speed_mps, 4) AS p95_speed_mps FROM s JOIN r USING (run_id)""",
    "q_traj_compare": f"""WITH {TRAJ_SQL},
      m AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS dist_m, time_s - lag(time_s) OVER w AS dt_s FROM traj WINDOW w AS (PARTITION BY variant_name, agent_id ORDER BY time_s, event_id)),
      p AS (SELECT variant_name, agent_id, count(*) AS samples, min(time_s) AS first_s, max(time_s) AS last_s, coalesce(sum(dist_m), 0.0) AS path_m,
             sqrt((arg_min(x, (time_s, event_id)) - arg_max(x, (time_s, event_id))) ** 2 + (arg_min(y, (time_s, event_id)) - arg_max(y, (time_s, event_id))) ** 2) AS displacement_m FROM m GROUP BY ALL),
      s AS ({_SUMMARY.format('variant_name,', 'p GROUP BY variant_name')}),
      sv AS (SELECT variant_name, avg(dist_m / dt_s) AS mean_speed_mps, quantile_cont(dist_m / dt_s, 0.95) AS p95_speed_mps FROM m WHERE dt_s > 0 GROUP BY 1),
      rm AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS dist_m, time_s - lag(time_s) OVER w AS dt_s FROM traj WHERE run_id = 'run_0' WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id)),
      rp AS (SELECT agent_id, count(*) AS samples, min(time_s) AS first_s, max(time_s) AS last_s, coalesce(sum(dist_m), 0.0) AS path_m,
             sqrt((arg_min(x, (time_s, event_id)) - arg_max(x, (time_s, event_id))) ** 2 + (arg_min(y, (time_s, event_id)) - arg_max(y, (time_s, event_id))) ** 2) AS displacement_m FROM rm GROUP BY ALL),
      rs AS ({_SUMMARY.format('', 'rp')}), rv AS (SELECT avg(dist_m / dt_s) AS mean_speed_mps, quantile_cont(dist_m / dt_s, 0.95) AS p95_speed_mps FROM rm WHERE dt_s > 0),
      a AS (SELECT * FROM (SELECT variant_name, duration_s, mean_agent_duration_s, mean_path_length_m, p95_path_length_m, mean_displacement_m, mean_speed_mps, p95_speed_mps FROM s JOIN sv USING (variant_name))
            UNPIVOT (simulated FOR metric IN (duration_s, mean_agent_duration_s, mean_path_length_m, p95_path_length_m, mean_displacement_m, mean_speed_mps, p95_speed_mps))),
      b AS (SELECT * FROM (SELECT duration_s, mean_agent_duration_s, mean_path_length_m, p95_path_length_m, mean_displacement_m, mean_speed_mps, p95_speed_mps FROM rs, rv)
            UNPIVOT (reference FOR metric IN (duration_s, mean_agent_duration_s, mean_path_length_m, p95_path_length_m, mean_displacement_m, mean_speed_mps, p95_speed_mps)))
      SELECT variant_name, metric, round(simulated, 4) AS simulated, round(reference, 4) AS reference, round(simulated - reference, 4) AS delta,
             round((simulated - reference) / nullif(abs(reference), 0) * 100, 4) AS pct_delta FROM a JOIN b USING (metric)""",
    "q_first_crossing": f"""WITH {CROSS_SQL} SELECT agent_id, round(crossing_time_s, 6) AS crossing_time_s, round(previous_time_s, 6) AS previous_time_s,
      round(crossing_time_s - lag(crossing_time_s) OVER (ORDER BY crossing_time_s, agent_id), 6) AS headway_s FROM f""",
    "q_flow_summary": f"""WITH {CROSS_SQL}, a AS (SELECT run_id, count(DISTINCT agent_id) AS agents, count(*) AS samples FROM traj GROUP BY 1),
      b AS (SELECT run_id, count(*) AS crossings, min(crossing_time_s) AS first_s, max(crossing_time_s) AS last_s FROM f GROUP BY 1)
      SELECT run_id, agents, samples, crossings, round(first_s, 6) AS first_s, round(last_s, 6) AS last_s,
      round(crossings / nullif(last_s - first_s, 0), 6) AS mean_flow_per_s, round((last_s - first_s) / nullif(crossings - 1, 0), 6) AS mean_headway_s FROM a LEFT JOIN b USING (run_id)""",
    "q_measurement_line": f"""WITH {CROSS_SQL} SELECT floor(time_s / 3600.0)::BIGINT AS step, 'line' AS line_name, count(*) FILTER (crossed) AS n_crossing, round(count(*) FILTER (crossed) / 3600.0::DOUBLE, 6) AS flow,
      count(*) FILTER (abs(side) <= 1 AND x BETWEEN -0.5 AND 10.5) AS n_in_region, round(count(*) FILTER (abs(side) <= 1 AND x BETWEEN -0.5 AND 10.5) / 22.0::DOUBLE, 6) AS density,
      round(coalesce(avg(speed) FILTER (abs(side) <= 1 AND x BETWEEN -0.5 AND 10.5), 0.0), 6) AS mean_speed FROM c GROUP BY 1""",
    "q_zone_dwell": f"""WITH {TRAJ_SQL}, n AS (SELECT *, coalesce((variant_name <> lag(variant_name) OVER w)::INT, 1) AS new FROM traj WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id)),
      i AS (SELECT *, sum(new) OVER (PARTITION BY agent_id ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM n),
      v AS (SELECT agent_id, visit, any_value(variant_name) AS variant_name, min(time_s) AS enter_s, count(*) AS samples FROM i GROUP BY 1, 2),
      d AS (SELECT *, lead(enter_s) OVER (PARTITION BY agent_id ORDER BY visit) - enter_s AS dwell_s FROM v)
      SELECT variant_name, count(*) AS visits, count(dwell_s) AS closed, round(avg(dwell_s), 4) AS mean_dwell_s, max(samples) AS longest FROM d GROUP BY 1""",
    "q_trail": f"""WITH {TRAJ_SQL} SELECT agent_id, event_id, (count(*) OVER w)::INT AS n, round(sum(x) OVER w, 6) AS sum_x FROM traj WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id ROWS 7 PRECEDING)""",
    "q_dose": f"""WITH {MOTION_SQL} SELECT agent_id, event_id, round(sum(speed * (coalesce(dt_s, 0.0) / 3600)) OVER w, 4) AS dose, max(speed) OVER w AS peak FROM m WINDOW w AS (PARTITION BY agent_id ORDER BY time_s, event_id ROWS UNBOUNDED PRECEDING)""",
    "q_rolling_entropy": f"""WITH {TRAJ_SQL}, h AS (SELECT run_id, floor(time_s / 3600.0) AS hour, avg(speed) AS h FROM traj GROUP BY 1, 2),
      s AS (SELECT *, avg(h) OVER (PARTITION BY run_id ORDER BY hour ROWS 4 PRECEDING) AS smooth FROM h),
      r AS (SELECT *, -(smooth - lag(smooth) OVER w) / (hour - lag(hour) OVER w) AS rate FROM s WINDOW w AS (PARTITION BY run_id ORDER BY hour))
      SELECT run_id, count(*) AS steps, round(max(rate), 6) AS max_rate, max(rate) > 0.1 AS cascade FROM r GROUP BY 1""",
}
# fmt: on
