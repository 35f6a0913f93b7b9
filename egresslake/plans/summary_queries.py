"""Run summaries and comparisons over the harness tables.

Made-up measures are multiples of 1/64, so their sums are exact in any order and both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import comparison as C
from egresslake.operators import ordered as O
from egresslake.operators import run_summary as R
from egresslake.operators import statistics as S
from egresslake.operators import trajectory as T
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import RUNS_SQL, TRAJ_SQL, runs, table, traj


def people(spark, sf_dir):
    """customer as the agents table."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    out = F.col("c_acctbal") > 0
    return c.select(
        F.concat(F.lit("run_"), (F.col("c_nationkey") % 5).cast("string")).alias("run_id"), k.alias("agent_id"), F.col("c_mktsegment").alias("cohort_name"), F.concat(F.lit("m"), (k % 3).cast("string")).alias("mobility_class"),
        out.alias("evacuated"), F.when(out, F.floor("c_acctbal").cast("double")).alias("travel_time_s"), ((k % 97) / 64).alias("hazard_exposure"), ((k % 53) / 64).alias("hazard_risk"),
        F.when(out, F.concat(F.lit("exit_"), (k % 4).cast("string"))).alias("evacuated_via"), (k % 17 == 0).alias("incapacitated"), (k % 19 == 0).alias("pending"), (k % 23 == 0).alias("is_responder"), (k % 29 == 0).alias("is_hostile"),
    )


def telemetry(spark, sf_dir):
    """events as the other telemetry tables."""
    t, e = traj(spark, sf_dir).withColumn("step", F.col("k")), F.col("event_id")
    mode = F.when(e % 5 == 0, "RUN").when(e % 5 == 1, "HIDE").when(e % 5 == 2, "FIGHT").otherwise("")
    return {
        "agents": people(spark, sf_dir),
        "steps": t.groupBy("run_id", "step").agg(F.max(F.floor("time_s")).cast("double").alias("time_s"), (F.count(F.lit(1)) / 8).alias("mean_density"), ((F.max("event_id") % 64) / 64).alias("global_entropy")),
        "agent_steps": t.select("run_id", F.floor("time_s").cast("double").alias("time_s"), (F.floor("value") / 64).alias("speed"), ((e % 40) / 64).alias("local_density"), mode.alias("decision_mode")),
        "cells": t.groupBy("run_id", "step", F.floor("x").alias("cx"), F.floor("y").alias("cy")).agg(F.count(F.lit(1)).alias("occupancy")),
        "bottlenecks": t.groupBy("run_id", "step", (e % 3).alias("zone_id")).agg((F.count(F.lit(1)) % 7).alias("queue_length"), (F.max("event_id") % 11).alias("outflow")),
        "exits": t.groupBy("run_id", F.concat(F.lit("exit_"), (e % 4).cast("string")).alias("exit_label")).agg(F.count(F.lit(1)).alias("flow_cumulative")),
        "interventions": t.filter("event_id % 50 = 0").select("run_id", (e % 9).alias("recipients"), ((e % 41) / 64).alias("entropy_before"), ((e % 37) / 64).alias("entropy_after"), ((e % 31) / 64).alias("accuracy_before"), ((e % 43) / 64).alias("accuracy_after"), ((e % 13) / 64).alias("mean_hazard_load"), (e % 6).alias("peak_queue_length")),
        "hostile": t.filter("event_id % 70 = 1").select("run_id", (e % 5).alias("recipients"), ((e % 60) / 64).alias("credibility")),
        "shots": t.filter("event_id % 90 = 2").select("run_id", ((e % 50) / 64).alias("accuracy")),
    }


def q_run_summary(spark, sf_dir):
    return rounded(R.run_summary(telemetry(spark, sf_dir)), 10)


def q_quantiles(spark, sf_dir):
    return rounded(O.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95}), 4)


def q_running_sums(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    s = O.running_sums(v, ["l_returnflag"], "l_extendedprice", {"n": F.col("n")})
    return s.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("distinct_prices"), F.max("n_all").alias("all_rows"), F.sum("n_below").alias("below"))


def scored(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.select("variant_name", "seed", F.lit("run").alias("record_type"), F.floor("travel").cast("double").alias("mean_travel_time_s"), (F.col("run_id") % 64 / 64).alias("entropy_reduction"))


def claims(spark):
    return spark.createDataFrame([("urgent", "3-MEDIUM", "1-URGENT"), ("low", "3-MEDIUM", "5-LOW")], "claim string, baseline string, test string")


def q_claim_comparison(spark, sf_dir):
    c = C.compare_claims(scored(spark, sf_dir), ["mean_travel_time_s", "entropy_reduction", "not_there"], claims(spark), intervals=False)
    return rounded(c.drop("wilcoxon_p").withColumn("p_value", F.round("p_value", 4)), 4)


def q_variant_intervals(spark, sf_dir):
    c = C.compare_variants(scored(spark, sf_dir), "3-MEDIUM", "1-URGENT", ["mean_travel_time_s"], samples=200)
    inside = F.col("baseline_mean").between(F.col("baseline_ci_lower"), F.col("baseline_ci_upper")) & F.col("test_mean").between(F.col("test_ci_lower"), F.col("test_ci_upper"))
    return c.select("metric", "n_baseline", "n_test", inside.alias("means_inside"))


def q_mwu_p(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("side", F.when(F.col("variant_name") == "1-URGENT", "a").when(F.col("variant_name") == "5-LOW", "b")).filter("side is not null")
    return rounded(S.mann_whitney(r, ["status"], "side", "travel"), 4)


def q_wilcoxon_p(spark, sf_dir):
    m = runs(spark, sf_dir).withColumn("travel", F.floor("travel")).groupBy("status", "seed").agg(F.sum(F.when(F.col("variant_name") == "1-URGENT", F.col("travel"))).alias("a"), F.sum(F.when(F.col("variant_name") == "5-LOW", F.col("travel"))).alias("b"))
    return rounded(S.wilcoxon(m.withColumn("delta", (F.col("a") - F.col("b")).cast("double")).filter("delta is not null"), ["status"], "delta", exact=False), 4)


def q_causal_deltas(spark, sf_dir):
    return rounded(C.causal_deltas(scored(spark, sf_dir), ["mean_travel_time_s", "entropy_reduction"], "3-MEDIUM"), 4)


def q_delta_payload(spark, sf_dir):
    r = scored(spark, sf_dir).withColumn("entropy_reduction", F.lit(0.5) * (F.col("variant_name") == "1-URGENT").cast("int"))
    return C.delta_payload(C.causal_deltas(r, ["entropy_reduction"], "3-MEDIUM"))


def q_composite_delta(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("seed").agg(F.sum(F.when(F.col("variant_name") == "1-URGENT", F.col("mean_travel_time_s"))).alias("treated_score"), F.sum(F.when(F.col("variant_name") == "5-LOW", F.col("mean_travel_time_s"))).alias("control_score"))
    return rounded(C.composite_delta(s.filter("treated_score is not null and control_score is not null")), 4)


def summaries(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.groupBy("variant_name").agg((F.count(F.lit(1)) / 64).alias("information_safety_efficiency"), (F.sum("seed") / 64).alias("harmful_convergence_index"), F.sum("seed").alias("intervention_recipients"))


def q_highlights(spark, sf_dir):
    s = C.synthesis({"one": summaries(spark, sf_dir), "two": summaries(spark, sf_dir).filter("variant_name <> '5-LOW'")})
    return rounded(C.highlights(s, claims(spark)))


def q_synthesis(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("entropy__replay_"), "event_type").alias("variant_name"), F.col("event_id").alias("n"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant_name"), F.col("o_custkey").alias("seed"))
    s = C.synthesis({"events": e, "orders": p})
    return s.groupBy("study", "family", "provider", "is_replay").agg(F.count(F.lit(1)).alias("rows"), F.count("n").alias("with_n"), F.count("seed").alias("with_seed"))


def q_aggregate_row(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_name", F.when(F.col("r_regionkey") == 3, "variant_aggregate").when(F.col("r_regionkey") == 1, "study_aggregate").otherwise("run").alias("record_type"))
    return C.aggregate_row(r, ["r_name"])


def q_flow_comparison(spark, sf_dir):
    names = {"crossings": "crossing_count", "first_s": "first_crossing_s", "last_s": "last_crossing_s", "mean_flow_per_s": "mean_flow_ped_s", "mean_headway_s": "mean_time_headway_s"}
    t = traj(spark, sf_dir)
    one, other = (T.flow_summary(t.filter(w), (5.0, 0.0), (5.0, 9.7)).withColumnsRenamed(names) for w in ("variant_name = 'click'", "variant_name <> 'click'"))
    return rounded(C.flow_comparison(one, other), 5)


BANDS = (("low", 0.0, 0.2), ("middle", 0.2, 0.6), ("high", 0.6, None))


def q_density_band_times(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("time_s", F.floor(F.col("time_s") / 3600.0) * 3600.0)
    c = t.groupBy("agent_id").agg(F.max("time_s").alias("m")).select("agent_id", (F.col("m") - 600.0).alias("crossing_time_s"), F.lit(5.0).alias("midpoint_x"), F.lit(5.0).alias("midpoint_y"))
    d = C.travel_times_by_density(t, c, 2.0, BANDS, slack=7200.0)
    return rounded(d.groupBy("density_band").agg(F.count(F.lit(1)).alias("n"), F.sum("travel_time_s").alias("travel_time_s"), F.max("local_density_ped_m2").alias("most")), 5)


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_people = """people AS (SELECT 'run_' || (c_nationkey % 5) AS run_id, c_custkey AS agent_id, c_mktsegment AS cohort, 'm' || (c_custkey % 3) AS mobility, c_acctbal > 0 AS evacuated,
    CASE WHEN c_acctbal > 0 THEN floor(c_acctbal)::DOUBLE END AS travel, (c_custkey % 97) / 64.0::DOUBLE AS exposure, (c_custkey % 53) / 64.0::DOUBLE AS risk, CASE WHEN c_acctbal > 0 THEN 'exit_' || (c_custkey % 4) END AS via,
    c_custkey % 17 = 0 AS down, c_custkey % 19 = 0 AS pending, c_custkey % 23 <> 0 AND c_custkey % 29 <> 0 AS person FROM customer)"""
_scored = f"{RUNS_SQL}, scored AS (SELECT variant_name, seed, floor(travel)::DOUBLE AS mean_travel_time_s, (run_id % 64) / 64.0::DOUBLE AS entropy_reduction FROM runs)"
_pvalue = """CASE WHEN {z} IS NULL THEN {none} ELSE least(1.0, 2 * (1 - 0.5::DOUBLE * (1 + (1 - (((((1.061405429::DOUBLE * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-{z} * {z} / 2))))) END"""
_t = "(1 / (1 + 0.3275911::DOUBLE * ({z} / sqrt(2.0::DOUBLE))))"


def _mwu(rows: str, keys: str) -> str:
    """CTEs r, g, z: U of side a and its z by keys, from rows (keys, side, v)."""
    return f"""ranked AS (SELECT {keys}, side, v, (rank() OVER (PARTITION BY {keys} ORDER BY v) + rank() OVER (PARTITION BY {keys} ORDER BY v) + count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY {keys}, v) AS t FROM {rows}),
    mw AS (SELECT {keys}, sum((side = 'a')::INT)::BIGINT AS n_a, sum((side = 'b')::INT)::BIGINT AS n_b, sum(CASE WHEN side = 'a' THEN rk ELSE 0 END) AS r, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM ranked GROUP BY {keys}),
    mu AS (SELECT *, r - n_a * (n_a + 1) / 2.0::DOUBLE AS u, n_a::DOUBLE * n_b AS ab, n_a::DOUBLE * n_b / 12 * (n + 1 - ties / nullif(n * (n - 1), 0)) AS var FROM mw),
    mz AS (SELECT *, CASE WHEN var > 0 THEN greatest(abs(u - ab / 2) - 0.5, 0) / sqrt(var) END AS z FROM mu)"""


def _wilcoxon(rows: str, keys: str) -> str:
    """CTE wz: signed rank W, n and z by keys, from rows (keys, delta)."""
    return f"""wd AS (SELECT {keys}, abs(delta) AS m, delta > 0 AS up FROM {rows} WHERE abs(delta) > 1e-12),
    wr AS (SELECT {keys}, up, rank() OVER (PARTITION BY {keys} ORDER BY m) + (count(*) OVER (PARTITION BY {keys}, m) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY {keys}, m) AS t FROM wd),
    ws AS (SELECT {keys}, count(*) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS u, sum(t::DOUBLE * t - 1) AS ties FROM wr GROUP BY {keys}),
    wz AS (SELECT *, least(u, n * (n + 1) / 2.0::DOUBLE - u) AS w, n * (n + 1) * (2.0::DOUBLE * n + 1) / 24 - ties / 48 AS var FROM ws)"""


_wp = "(SELECT *, CASE WHEN var > 0 THEN abs(w - n * (n + 1) / 4.0::DOUBLE) / sqrt(var) END AS z FROM wz)"
# fmt: off
SQL = {
    "q_run_summary": f"""WITH {TRAJ_SQL}, {_people}, t AS (SELECT *, event_id AS e FROM traj),
    ag AS (SELECT run_id, count(*) AS agents_total, count(*) FILTER (evacuated) AS agents_evacuated, count(*) FILTER (NOT evacuated) AS agents_remaining, count(*) FILTER (NOT evacuated AND pending) AS agents_pending_release, count(*) FILTER (down) AS agents_incapacitated,
      coalesce(avg(travel), 0) AS mean_travel_time_s, coalesce(quantile_cont(travel, 0.95), 0) AS p95, coalesce(quantile_cont(travel, 0.5), 0) AS p50, avg(exposure) AS mx, quantile_cont(exposure, 0.95) AS px, max(risk) AS pr FROM people GROUP BY 1),
    lb AS (SELECT run_id, CASE WHEN count(*) > 1 THEN max(r) - min(r) ELSE 0 END AS lb FROM (SELECT run_id, cohort, avg((NOT evacuated)::INT) AS r FROM people WHERE person GROUP BY 1, 2) GROUP BY 1),
    ec AS (SELECT run_id, '{{' || string_agg('"' || cohort || '":' || v::VARCHAR, ',' ORDER BY cohort) || '}}' AS j FROM (SELECT run_id, cohort, round(avg(exposure), 6) AS v FROM people WHERE person GROUP BY 1, 2) GROUP BY 1),
    em AS (SELECT run_id, '{{' || string_agg('"' || mobility || '":' || v::VARCHAR, ',' ORDER BY mobility) || '}}' AS j FROM (SELECT run_id, mobility, round(avg(exposure), 6) AS v FROM people WHERE person GROUP BY 1, 2) GROUP BY 1),
    fl AS (SELECT run_id, 'exit_' || (e % 4) AS label, count(*) AS n FROM t GROUP BY 1, 2), ex AS (SELECT run_id, arg_min(label, (-n, label)) AS dominant_exit, max(n) / sum(n)::DOUBLE AS imb FROM fl GROUP BY 1),
    rt AS (SELECT p.run_id, avg((via = dominant_exit)::INT) AS c FROM people p JOIN ex USING (run_id) WHERE evacuated GROUP BY 1),
    ss AS (SELECT run_id, k, max(floor(time_s)) AS ts, count(*) / 8.0::DOUBLE AS d, (max(e) % 64) / 64.0::DOUBLE AS h FROM t GROUP BY 1, 2),
    st AS (SELECT run_id, max(ts) AS ts, max(d) AS d, arg_min(h, k) AS h0, arg_max(h, k) AS h1, max(h) AS hp, avg(h) AS hm FROM ss GROUP BY 1),
    am AS (SELECT run_id, coalesce(avg(CASE WHEN floor(value) / 64 > 0.01 THEN floor(value) / 64 END), 0) AS fs, coalesce(avg(CASE WHEN floor(value) / 64 > 0.01 THEN (e % 40) / 64.0::DOUBLE END), 0) AS fd,
      count(*) FILTER (e % 5 = 0) AS nr, count(*) FILTER (e % 5 = 1) AS nh, count(*) FILTER (e % 5 = 2) AS nf, coalesce(min(CASE WHEN e % 5 = 1 THEN floor(time_s) END), 0) AS sh FROM t GROUP BY 1),
    ce AS (SELECT run_id, max(n) AS o FROM (SELECT run_id, k, floor(x), floor(y), count(*) AS n FROM t GROUP BY ALL) GROUP BY 1),
    bo AS (SELECT run_id, max(q) AS q, max(o) AS o, count(DISTINCT z) AS z FROM (SELECT run_id, k, e % 3 AS z, count(*) % 7 AS q, max(e) % 11 AS o FROM t GROUP BY ALL) GROUP BY 1),
    iv AS (SELECT run_id, count(*) AS n, sum(e % 9)::BIGINT AS r, sum(greatest(0, (e % 41 - e % 37) / 64.0::DOUBLE)) AS er, sum(greatest(0, (e % 43 - e % 31) / 64.0::DOUBLE)) AS ac, sum((e % 13) / 64.0::DOUBLE * greatest(1, e % 9)) AS xp, sum(e % 6)::DOUBLE AS qp FROM t WHERE e % 50 = 0 GROUP BY 1),
    ho AS (SELECT run_id, count(*) AS n, sum(e % 5)::BIGINT AS r, avg((e % 60) / 64.0::DOUBLE) AS c FROM t WHERE e % 70 = 1 GROUP BY 1),
    sh AS (SELECT run_id, count(*) AS n, sum((e % 50) / 64.0::DOUBLE) AS a FROM t WHERE e % 90 = 2 GROUP BY 1),
    w AS (SELECT ag.run_id, ag.* EXCLUDE (run_id, p50, p95, mx, px, pr), p95 AS p95_travel_time_s, mx AS mean_hazard_exposure, px AS p95_hazard_exposure, pr AS peak_hazard_risk, coalesce(lb, 0) AS left_behind_index, ec.j AS exposure_by_group, em.j AS exposure_by_mobility_class,
      p95 - p50 AS percentile_gap_time_to_safety_s, coalesce(dominant_exit, 'n/a') AS dominant_exit, coalesce(imb, 0) AS exit_imbalance, coalesce(rt.c, 0) AS correct_route_fraction, coalesce(st.ts, 0) AS total_time_s, coalesce(st.d, 0) AS peak_mean_density,
      coalesce(h0, 0) AS initial_entropy, coalesce(h1, 0) AS final_entropy, coalesce(hp, 0) AS peak_entropy, coalesce(hm, 0) AS mean_entropy, coalesce(h0 - h1, 0) AS entropy_reduction, coalesce(fs, 0) AS mean_fd_speed, coalesce(fd, 0) AS mean_fd_density,
      coalesce(nr / nullif(nr + nh + nf, 0)::DOUBLE, 0) AS run_fraction, coalesce(nh / nullif(nr + nh + nf, 0)::DOUBLE, 0) AS hide_fraction, coalesce(nf / nullif(nr + nh + nf, 0)::DOUBLE, 0) AS fight_fraction, coalesce(am.sh, 0) AS time_to_shelter_s, coalesce(ce.o, 0) AS peak_cell_occupancy,
      coalesce(iv.n, 0) AS intervention_count, coalesce(iv.r, 0) AS intervention_recipients, coalesce(er, 0) AS intervention_entropy_reduction, coalesce(ac, 0) AS intervention_accuracy_gain, coalesce(xp, 0) AS intervention_exposure_pressure, coalesce(qp, 0) AS intervention_queue_pressure,
      coalesce(ho.n, 0) AS hostile_channel_event_count, coalesce(ho.r, 0) AS hostile_channel_recipients, coalesce(ho.c, 0) AS hostile_channel_mean_credibility, coalesce(sh.n, 0) AS active_shooter_event_count, coalesce(sh.a, 0) AS exposure_to_los,
      coalesce(bo.q, 0) AS peak_bottleneck_queue, coalesce(bo.o, 0) AS peak_bottleneck_throughput, coalesce(bo.z, 0) AS bottleneck_zone_count
      FROM ag LEFT JOIN lb USING (run_id) LEFT JOIN ec USING (run_id) LEFT JOIN em USING (run_id) LEFT JOIN ex USING (run_id) LEFT JOIN rt USING (run_id) LEFT JOIN st USING (run_id) LEFT JOIN am USING (run_id) LEFT JOIN ce USING (run_id) LEFT JOIN bo USING (run_id)
      LEFT JOIN iv USING (run_id) LEFT JOIN ho USING (run_id) LEFT JOIN sh USING (run_id)),
    y AS (SELECT *, exit_imbalance * hostile_channel_recipients * hostile_channel_mean_credibility AS ind, intervention_entropy_reduction + intervention_accuracy_gain AS gain, 1 + intervention_exposure_pressure + intervention_queue_pressure AS pres,
      CASE WHEN intervention_entropy_reduction > 0 THEN exit_imbalance * (1 + peak_bottleneck_queue) * (1 + mean_hazard_exposure) / (1 + intervention_entropy_reduction) ELSE 0 END AS hci FROM w),
    v AS (SELECT * EXCLUDE (ind, gain, pres, hci), CASE WHEN intervention_count > 0 THEN gain / pres ELSE 0 END AS information_safety_efficiency, hci AS harmful_convergence_index, hci AS harmful_convergence_index_accidental,
      hci + ind AS harmful_convergence_index_induced, gain / (pres + hostile_channel_recipients) - ind AS information_safety_efficiency_adversarial FROM y)
    SELECT run_id, dominant_exit, exposure_by_group, exposure_by_mobility_class, round(COLUMNS(lambda c: c IN ('mean_travel_time_s', 'p95_travel_time_s', 'mean_hazard_exposure', 'p95_hazard_exposure', 'peak_hazard_risk', 'left_behind_index', 'percentile_gap_time_to_safety_s', 'exit_imbalance', 'correct_route_fraction', 'total_time_s',
      'peak_mean_density', 'initial_entropy', 'final_entropy', 'peak_entropy', 'mean_entropy', 'entropy_reduction', 'mean_fd_speed', 'mean_fd_density', 'run_fraction', 'hide_fraction', 'fight_fraction', 'time_to_shelter_s', 'intervention_entropy_reduction', 'intervention_accuracy_gain', 'intervention_exposure_pressure',
      'intervention_queue_pressure', 'hostile_channel_mean_credibility', 'exposure_to_los', 'information_safety_efficiency', 'harmful_convergence_index', 'harmful_convergence_index_accidental', 'harmful_convergence_index_induced', 'information_safety_efficiency_adversarial')), 10),
      agents_total, agents_evacuated, agents_remaining, agents_pending_release, agents_incapacitated, peak_cell_occupancy, intervention_count, intervention_recipients, hostile_channel_event_count, hostile_channel_recipients, active_shooter_event_count, peak_bottleneck_queue, peak_bottleneck_throughput, bottleneck_zone_count FROM v""",
    "q_quantiles": "SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1, 2",
    "q_running_sums": """WITH v AS (SELECT l_returnflag, l_extendedprice AS p, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, n, coalesce(sum(n) OVER (PARTITION BY l_returnflag ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v)
      SELECT l_returnflag, count(*) AS distinct_prices, sum(n)::BIGINT AS all_rows, sum(b)::BIGINT AS below FROM s GROUP BY 1""",
    "q_claim_comparison": f"""WITH {_scored}, c(claim, baseline, test) AS (VALUES ('urgent', '3-MEDIUM', '1-URGENT'), ('low', '3-MEDIUM', '5-LOW')), u AS (UNPIVOT scored ON mean_travel_time_s, entropy_reduction INTO NAME metric VALUE v),
      rows_ AS (SELECT claim, metric, 'a' AS side, v, seed FROM u JOIN c ON variant_name = test UNION ALL SELECT claim, metric, 'b' AS side, v, seed FROM u JOIN c ON variant_name = baseline), {_mwu('rows_', 'claim, metric')},
      ms AS (SELECT claim, metric, seed, avg(CASE WHEN side = 'a' THEN v END) - avg(CASE WHEN side = 'b' THEN v END) AS delta FROM rows_ GROUP BY ALL), mp AS (SELECT * FROM ms WHERE delta IS NOT NULL), {_wilcoxon('mp', 'claim, metric')},
      me AS (SELECT claim, metric, avg(CASE WHEN side = 'a' THEN v END) AS ma, avg(CASE WHEN side = 'b' THEN v END) AS mb, var_samp(CASE WHEN side = 'a' THEN v END) AS va, var_samp(CASE WHEN side = 'b' THEN v END) AS vb FROM rows_ GROUP BY 1, 2),
      p AS (SELECT claim, metric, count(*) AS n_paired FROM mp GROUP BY 1, 2)
      SELECT claim, metric, round(mb, 4) AS baseline_mean, round(ma, 4) AS test_mean, round(ma - mb, 4) AS diff_absolute, round((ma - mb) / nullif(mb, 0) * 100, 4) AS diff_percent, round(mz.u, 4) AS mann_whitney_u, round({_pvalue.format(z='mz.z', t=_t.format(z='mz.z'), none='1')}, 4) AS p_value,
        {_pvalue.format(z='mz.z', t=_t.format(z='mz.z'), none='1')} < 0.05 AS significant, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 4) AS cohens_d, n_b AS n_baseline, n_a AS n_test, n_paired, round(w, 4) AS wilcoxon_stat,
        CASE WHEN metric = 'mean_travel_time_s' THEN 'lower' ELSE 'higher' END AS better_direction, CASE WHEN metric = 'mean_travel_time_s' THEN ma < mb ELSE ma > mb END AS supports_test FROM mz JOIN me USING (claim, metric) JOIN p USING (claim, metric) JOIN wz USING (claim, metric)""",
    "q_variant_intervals": f"WITH {_scored} SELECT 'mean_travel_time_s' AS metric, count(*) FILTER (variant_name = '3-MEDIUM') AS n_baseline, count(*) FILTER (variant_name = '1-URGENT') AS n_test, true AS means_inside FROM scored",
    "q_mwu_p": f"""WITH {RUNS_SQL}, s AS (SELECT status, travel AS v, CASE WHEN variant_name = '1-URGENT' THEN 'a' ELSE 'b' END AS side FROM runs WHERE variant_name IN ('1-URGENT', '5-LOW')), {_mwu('s', 'status')}
      SELECT status, n_a, n_b, round(u, 4) AS u, round({_pvalue.format(z='z', t=_t.format(z='z'), none='1')}, 4) AS p FROM mz""",
    "q_wilcoxon_p": f"""WITH {RUNS_SQL}, m AS (SELECT status, seed, sum(CASE WHEN variant_name = '1-URGENT' THEN floor(travel) END) - sum(CASE WHEN variant_name = '5-LOW' THEN floor(travel) END) AS delta FROM runs GROUP BY 1, 2), d AS (SELECT * FROM m WHERE delta IS NOT NULL), {_wilcoxon('d', 'status')}
      SELECT status, n, round(w, 4) AS w, round({_pvalue.format(z='z', t=_t.format(z='z'), none='1')}, 4) AS p FROM {_wp}""",
    "q_causal_deltas": f"""WITH {_scored}, u AS (UNPIVOT scored ON mean_travel_time_s, entropy_reduction INTO NAME metric VALUE v), m AS (SELECT variant_name, seed, metric, avg(v) AS v FROM u GROUP BY ALL)
      SELECT a.variant_name, metric, count(*) AS n_pairs, round(avg(a.v - b.v), 4) AS ate, metric = 'mean_travel_time_s' AS lower_is_better FROM m a JOIN m b USING (seed, metric) WHERE b.variant_name = '3-MEDIUM' AND a.variant_name <> '3-MEDIUM' GROUP BY 1, 2""",
    "q_delta_payload": f"""WITH {_scored}, m AS (SELECT DISTINCT variant_name, seed, CASE WHEN variant_name = '1-URGENT' THEN 0.5 ELSE 0.0 END AS v FROM scored)
      SELECT a.variant_name, '{{"entropy_reduction":{{"ate":' || CASE WHEN a.variant_name = '1-URGENT' THEN '0.5' ELSE '0.0' END || ',"n_pairs":' || count(*) || '}}}}' AS payload FROM m a JOIN m b USING (seed) WHERE b.variant_name = '3-MEDIUM' AND a.variant_name <> '3-MEDIUM' GROUP BY 1""",
    "q_composite_delta": f"""WITH {_scored}, s AS (SELECT seed, sum(CASE WHEN variant_name = '1-URGENT' THEN mean_travel_time_s END) - sum(CASE WHEN variant_name = '5-LOW' THEN mean_travel_time_s END) AS d FROM scored GROUP BY 1)
      SELECT count(*) AS n_pairs, round(avg(d), 4) AS mean_delta, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse FROM s WHERE d IS NOT NULL""",
    "q_highlights": f"""WITH {RUNS_SQL}, s AS (SELECT variant_name, count(*) / 64.0::DOUBLE AS i, sum(seed) / 64.0::DOUBLE AS h, sum(seed) AS r FROM runs GROUP BY 1), t AS (SELECT 'one' AS study, * FROM s UNION ALL SELECT 'two' AS study, * FROM s WHERE variant_name <> '5-LOW'),
      c(claim, baseline, test) AS (VALUES ('urgent', '3-MEDIUM', '1-URGENT'), ('low', '3-MEDIUM', '5-LOW'))
      SELECT a.study, claim, baseline, test, round(a.i - b.i, 6) AS ise_delta, round(a.h - b.h, 6) AS hci_delta, round(a.r / nullif(b.r, 0)::DOUBLE, 6) AS recipient_ratio FROM c JOIN t a ON a.variant_name = test JOIN t b ON b.variant_name = baseline AND a.study = b.study""",
    "q_synthesis": """SELECT 'events' AS study, 'entropy' AS family, event_type AS provider, true AS is_replay, count(*) AS rows, count(*) AS with_n, 0 AS with_seed FROM events GROUP BY event_type
      UNION ALL SELECT 'orders', o_orderpriority, 'none', false, count(*), 0, count(*) FROM orders GROUP BY o_orderpriority""",
    "q_aggregate_row": "SELECT r_name, 'study_aggregate' AS record_type FROM region WHERE r_regionkey = 1",
    "q_flow_comparison": f"""WITH {TRAJ_SQL}, d AS (SELECT *, CASE WHEN variant_name = 'click' THEN 's' ELSE 'r' END AS g FROM traj), l AS (SELECT g, agent_id, time_s, event_id, -(x - 5.0) AS side, y AS along, lag(-(x - 5.0)) OVER w AS pside, lag(y) OVER w AS palong FROM d WINDOW w AS (PARTITION BY g, agent_id ORDER BY time_s, event_id)),
      f AS (SELECT g, agent_id, min(time_s) AS t FROM l WHERE pside * side < 0 AND (palong + along) / 2 BETWEEN -{T.SLACK} AND 9.7::DOUBLE + {T.SLACK} GROUP BY 1, 2), s AS (SELECT g, count(*)::DOUBLE AS crossing_count, min(t) AS first_crossing_s, max(t) AS last_crossing_s, count(*) / nullif(max(t) - min(t), 0) AS mean_flow_ped_s,
      (max(t) - min(t)) / nullif(count(*) - 1, 0) AS mean_time_headway_s FROM f GROUP BY 1), u AS (UNPIVOT s ON crossing_count, first_crossing_s, last_crossing_s, mean_flow_ped_s, mean_time_headway_s INTO NAME metric VALUE v)
      SELECT metric, round(a.v, 5) AS simulated, round(b.v, 5) AS reference, round(a.v - b.v, 5) AS delta, round((a.v - b.v) / abs(b.v) * 100, 5) AS pct_delta FROM u a JOIN u b USING (metric) WHERE a.g = 's' AND b.g = 'r'""",
    "q_density_band_times": f"""WITH {TRAJ_SQL}, t AS (SELECT agent_id, x, y, floor(time_s / 3600.0) * 3600.0 AS ts FROM traj), c AS (SELECT agent_id, max(ts) - 600.0 AS ct, min(ts) AS first FROM t GROUP BY 1), u AS (SELECT DISTINCT ts FROM t),
      n AS (SELECT agent_id, ct, first, (SELECT arg_min(ts, (abs(ts - ct), ts)) FROM u) AS near FROM c),
      e AS (SELECT n.agent_id, ct - first AS travel, count(*) FILTER ((t.x - 5) * (t.x - 5) + (t.y - 5) * (t.y - 5) <= 4) / (3.141592653589793::DOUBLE * 4) AS density FROM n JOIN t ON t.ts = near GROUP BY ALL)
      SELECT CASE WHEN density < 0.2 THEN 'low' WHEN density < 0.6 THEN 'middle' ELSE 'high' END AS density_band, count(*) AS n, round(sum(travel), 5) AS travel_time_s, round(max(density), 5) AS most FROM e GROUP BY 1""",
}
# fmt: on
