"""Roll-ups and statistics over orders, lineitem, customer, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.functions import text as X
from egresslake.functions.scalars import benchmark_score, weidmann
from egresslake.operators import aggregates as A
from egresslake.operators import statistics as S
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import RUNS_SQL, TRAJ_SQL, runs, table, traj


def q_summary_rollup(spark, sf_dir):
    return rounded(A.summary_levels(runs(spark, sf_dir), "variant_name", ["travel"]), 4)


def q_timeseries(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rounded(A.time_series(e, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), ["value", "k"]))


def agents(spark, sf_dir):
    """customers as agents: the run is the segment, exposure the spend, bands and priors by arithmetic."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n"))
    k = F.col("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_mktsegment").alias("run_id"), k.alias("agent_id"), (F.col("n") > 10).alias("evacuated"), (F.coalesce("n", F.lit(0)) * 1.5).alias("travel_time_s"),
        (F.coalesce("spend", F.lit(0.0)) / 1e5).alias("hazard_exposure"), (F.pmod(k, F.lit(7)) / 20.0).alias("impairment"),
        F.when(k % 5 == 0, "senior").when(k % 5 < 4, "adult").alias("age_band"), F.when(k % 11 != 0, F.pmod(k, F.lit(10)) / 10.0).alias("familiarity"),
        (k % 13 == 0).alias("is_responder"), F.lit(False).alias("is_hostile"), F.col("c_nationkey").alias("cohort"),
    )


def q_equity_subgroups(spark, sf_dir):
    return rounded(A.equity_subgroups(agents(spark, sf_dir)), 8)


def q_left_behind(spark, sf_dir):
    return rounded(A.left_behind_index(agents(spark, sf_dir), "run_id", "cohort", F.coalesce("evacuated", F.lit(False))))


def q_run_metrics(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("exit", F.col("status"))
    return rounded(A.run_metrics(r, "variant_name"), 4)


def q_compare_unpivot(spark, sf_dir):
    r = runs(spark, sf_dir)
    one = [F.avg("travel").alias("mean_travel"), F.max("travel").alias("max_travel"), F.count(F.lit(1)).cast("double").alias("run_count")]
    return rounded(A.compare_rows(r.filter("variant_name = '1-URGENT'").agg(*one), r.filter("variant_name = '5-LOW'").agg(*one), ["mean_travel", "max_travel", "run_count"]), 4)


def q_matched_ate(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rounded(S.matched_effect(r.filter("variant_name = '1-URGENT'"), r.filter("variant_name = '5-LOW'"), "seed", "travel"), 4)


def two_sides(spark, sf_dir):
    r = runs(spark, sf_dir)
    return r.withColumn("side", F.when(F.col("variant_name") == "1-URGENT", "a").when(F.col("variant_name") == "5-LOW", "b")).filter("side is not null")


def q_cohens_d(spark, sf_dir):
    return rounded(S.cohens_d(two_sides(spark, sf_dir), ["status"], "side", "travel"), 5)


def q_mwu(spark, sf_dir):
    return rounded(S.mann_whitney(two_sides(spark, sf_dir), ["status"], "side", "travel").drop("p"), 4)


def q_ks_bands(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("side", F.when(F.col("l_returnflag") == "R", "a").when(F.col("l_returnflag") == "N", "b")).filter("side is not null")
    return rounded(S.ks_gap(li.withColumn("band", F.floor(F.col("l_quantity") / 10)), ["band"], "side", "l_extendedprice"), 6)


def q_gini(spark, sf_dir):
    n = runs(spark, sf_dir).groupBy("status", "seed").agg(F.count(F.lit(1)).alias("n"))
    return rounded(A.gini(n, ["status"], "n"))


def q_fis(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(A.faster_is_slower(li, ["l_returnflag"], "l_quantity", "l_discount", "l_extendedprice"), 6)


def q_lane(spark, sf_dir):
    g = A.path_usage(A.cell_grid(traj(spark, sf_dir), ["run_id", "k"]), ["run_id"], "k")
    return rounded(A.lane_index(g.withColumnsRenamed({"cx": "x", "cy": "y"}), ["run_id"], "path_usage"))


def q_path_usage(spark, sf_dir):
    return rounded(A.path_usage(A.cell_grid(traj(spark, sf_dir), ["run_id", "k"]), ["run_id"], "k"))


def q_llm_cost(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("tokens_in", X.token_estimate(F.col("text"))).withColumn("tokens_out", F.col("turn"))
    return rounded(A.cost_report(c, ["role"], "tokens_in", "tokens_out", 1.0, 2.0))


def marked(spark, sf_dir):
    """documents as guidance rows: their reasons come from which marker words they hold."""
    low = F.lower(F.coalesce("text", F.lit("")))
    marks = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(r)) for w, r in (("licen", "boilerplate"), ("password", "credential"), ("http", "link"))]))
    return table(spark, sf_dir, "documents").withColumn("validation_reasons", F.array_join(marks, ";"))


def q_reason_explode(spark, sf_dir):
    return A.reason_counts(marked(spark, sf_dir), "validation_reasons", ["lang"])


def q_generation_summary(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    c = c.withColumn("cache_status", F.when(n % 3 == 0, "hit").when(n % 3 == 1, "miss").otherwise("disabled")).withColumn("validation_status", F.when(n % 5 == 0, "rejected").otherwise("accepted"))
    c = c.withColumn("cache_key", F.when(n % 7 == 0, "").otherwise(F.substring("text", 1, 8))).withColumn("used_fallback", F.when(n % 2 == 0, "TRUE").otherwise("0")).withColumn("confidence", (n % 10) / 10.0)
    return rounded(A.generation_summary(c, ["role"]))


def q_cache_usage_sets(spark, sf_dir):
    aggs = [F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 1000).alias("long_records")]
    return A.usage_sets(table(spark, sf_dir, "documents"), ["lang", "source"], aggs)


def q_topk_policy(spark, sf_dir):
    t = traj(spark, sf_dir).withColumn("step", F.floor(F.col("time_s") / 3600.0))
    return rounded(A.top_k(t, ["step"], F.col("speed") + 0.25 * F.col("k"), 3, ["event_id"], positive=True).select("step", "event_id", "score", "place"))


def q_largest_remainder(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    w = c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("weight"))
    return A.largest_remainder(w, ["n_regionkey"], "weight", F.lit(240).cast("long"), ["n_name"])


def q_exit_flow_dense(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("step", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return A.dense_flow(o, o.select("step").distinct(), o.select("o_orderstatus").distinct(), "step", "o_orderstatus")


def q_congested(spark, sf_dir):
    n = runs(spark, sf_dir).groupBy("variant_name", "status").agg(F.count(F.lit(1)).alias("flow"))
    return rounded(A.congested(n, ["variant_name"], "flow", 0.4))


def q_validation_runs(spark, sf_dir):
    r = runs(spark, sf_dir)
    return rounded(A.validation_runs(r, ["variant_name", "status"], F.col("travel") < 200_000, "travel"), 4)


def sweep(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("metric"), F.col("l_discount").alias("param")).agg(F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("std"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def q_elasticity(spark, sf_dir):
    return rounded(S.elasticity(sweep(spark, sf_dir), "metric", "param"), 3)


def q_monotonic(spark, sf_dir):
    return S.monotonic(sweep(spark, sf_dir), "metric", "param")


def q_score_leaderboard(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("score", benchmark_score(F.col("travel") / 1e5, F.col("seed") / 10.0, F.lit(None).cast("double"), F.lit(0.5)))
    return rounded(S.seed_mean_leaderboard(r, "variant_name", "seed", "score"))


def q_perf_gate(spark, sf_dir):
    r = runs(spark, sf_dir)
    base = r.filter("status = 'F' and seed > 2").groupBy("variant_name", "seed").agg(F.avg("travel").alias("s"))
    now = r.filter("status = 'O'").groupBy("variant_name", "seed").agg(F.avg("travel").alias("s"))
    return rounded(S.perf_gate(base, now, ["variant_name", "seed"], "s"), 4)


def q_weidmann(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 10.0).alias("density")).distinct()
    return rounded(d.withColumn("speed", weidmann(F.col("density"))))


def q_hist(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", F.width_bucket("l_extendedprice", F.lit(0.0), F.lit(100_000.0), F.lit(20)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def q_string_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.regexp_extract("p_brand", r"#(\d)(\d)", 1).try_cast("int").alias("maker"), F.regexp_extract("p_brand", r"#(\d)(\d)", 2).try_cast("int").alias("brand"), F.split("p_type", " ")[0].alias("kind"), F.size(F.split("p_type", " ")).alias("words"))


def q_sweep_product(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return r.select("r_name").crossJoin(F.broadcast(n.select("n_name"))).withColumn("variant", F.concat_ws("__", "r_name", "n_name"))


def q_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey").select("c_custkey")
    a = c.join(o, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("with"))
    b = c.join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("without"))
    return a.unionByName(b)


def q_bootstrap(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("variant_name", "seed").agg(F.avg("travel").alias("s"))
    return rounded(S.bootstrap_ci(s, ["variant_name"], "s"), 4)


def q_wilcoxon(spark, sf_dir):
    r = runs(spark, sf_dir)
    a = r.filter("status = 'O'").groupBy("variant_name", "seed").agg(F.avg("travel").alias("a"))
    b = r.filter("status = 'F'").groupBy("variant_name", "seed").agg(F.avg("travel").alias("b"))
    d = a.join(b, ["variant_name", "seed"]).withColumn("delta", F.round(F.col("b") - F.col("a"), 2))
    return rounded(S.wilcoxon(d, ["variant_name"], "delta").drop("p"))


def q_route_choice_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return S.logistic_fit(o.select((F.col("o_custkey") % 7).alias("load"), F.floor(F.col("o_totalprice") / 50_000).alias("price"), (F.col("o_orderstatus") == "F").cast("int").alias("chosen")), ["load", "price"], "chosen")


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

AGENTS_SQL = """o AS (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS n FROM orders GROUP BY 1),
agents AS (SELECT c_mktsegment AS run_id, c_custkey AS agent_id, coalesce(n > 10, false) AS evacuated, coalesce(n, 0) * 1.5 AS travel_time_s, coalesce(spend, 0.0) / 1e5 AS hazard_exposure,
  (c_custkey % 7) / 20.0 AS impairment, CASE WHEN c_custkey % 5 = 0 THEN 'senior' WHEN c_custkey % 5 < 4 THEN 'adult' END AS age_band,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 10) / 10.0 END AS familiarity, c_nationkey AS cohort, c_custkey % 13 = 0 AS is_responder FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""
_masks = [("impairment", "impaired", "impairment >= 0.1"), ("impairment", "not_impaired", "impairment < 0.1"), ("age", "elderly", "age_band = 'senior'"), ("age", "non_elderly", "age_band <> 'senior'"), ("age", "unknown_age", "age_band IS NULL"),
          ("familiarity_prior", "low_familiarity", "familiarity < 0.33"), ("familiarity_prior", "medium_familiarity", "familiarity >= 0.33 AND familiarity < 0.67"), ("familiarity_prior", "high_familiarity", "familiarity >= 0.67"), ("familiarity_prior", "unknown_familiarity", "familiarity IS NULL")]
_union = " UNION ALL ".join(f"SELECT '{a}' AS subgroup_type, '{b}' AS subgroup_tag, * FROM a WHERE {m}" for a, b, m in _masks)
_sides = "s AS (SELECT *, CASE variant_name WHEN '1-URGENT' THEN 'a' WHEN '5-LOW' THEN 'b' END AS side FROM runs WHERE variant_name IN ('1-URGENT', '5-LOW'))"
_grid = "g AS (SELECT run_id, k, floor(x)::INT AS cx, floor(y)::INT AS cy, count(*) AS occupancy, avg(speed) AS mean_speed FROM traj GROUP BY ALL), u AS (SELECT *, sum(occupancy) OVER (PARTITION BY run_id, cx, cy ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT AS path_usage FROM g)"
_sweep = "w AS (SELECT l_returnflag AS metric, l_discount AS param, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1, 2)"
# fmt: off
SQL = {
    "q_summary_rollup": f"""WITH {RUNS_SQL} SELECT variant_name, count(*) AS run_count, round(avg(travel), 4) AS travel, round(coalesce(stddev_pop(travel), 0), 4) AS travel_std,
      CASE WHEN grouping(variant_name) = 1 THEN 'study_aggregate' ELSE 'variant_aggregate' END AS record_type FROM runs GROUP BY GROUPING SETS ((variant_name), ())""",
    "q_timeseries": "SELECT date_trunc('hour', ts) AS hour, round(avg(value), 6) AS value, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS k FROM events GROUP BY 1",
    "q_equity_subgroups": f"""WITH {AGENTS_SQL}, a AS (SELECT * FROM agents WHERE NOT is_responder),
      r AS (SELECT run_id, avg(evacuated::INT::DOUBLE) AS run_rate, coalesce(avg(travel_time_s) FILTER (evacuated), 0) AS run_mean FROM a GROUP BY 1), e AS ({_union}),
      g AS (SELECT run_id, subgroup_type, subgroup_tag, count(*) AS agent_count, count(*) FILTER (evacuated) AS evacuated_count, count(*) FILTER (NOT evacuated) AS remaining_count, avg(evacuated::INT::DOUBLE) AS evacuation_rate,
        coalesce(avg(travel_time_s) FILTER (evacuated), 0) AS mean_travel_time_s, coalesce(quantile_cont(travel_time_s::DOUBLE, 0.95) FILTER (evacuated), 0) AS p95_travel_time_s, avg(hazard_exposure) AS mean_hazard_exposure,
        quantile_cont(hazard_exposure::DOUBLE, 0.95) AS p95_hazard_exposure, avg(impairment) AS mean_impairment, coalesce(avg(familiarity), 0) AS mean_familiarity FROM e GROUP BY 1, 2, 3)
      SELECT run_id, subgroup_type, subgroup_tag, agent_count, evacuated_count, remaining_count, round(evacuation_rate, 8) AS evacuation_rate, round(mean_travel_time_s, 8)::DOUBLE AS mean_travel_time_s, round(p95_travel_time_s, 8)::DOUBLE AS p95_travel_time_s,
        round(mean_hazard_exposure, 8) AS mean_hazard_exposure, round(p95_hazard_exposure, 8) AS p95_hazard_exposure, round(mean_impairment, 8)::DOUBLE AS mean_impairment, round(mean_familiarity, 8)::DOUBLE AS mean_familiarity,
        round(run_rate, 8) AS run_evacuation_rate, round(run_mean, 8)::DOUBLE AS run_mean_travel_time_s, round(evacuation_rate - run_rate, 8) AS evacuation_rate_gap_vs_run,
        round(mean_travel_time_s - run_mean, 8)::DOUBLE AS travel_time_gap_vs_run_s, round(abs(mean_travel_time_s - run_mean), 8)::DOUBLE AS equity_time_gap_s FROM g JOIN r USING (run_id)""",
    "q_left_behind": f"""WITH {AGENTS_SQL}, c AS (SELECT run_id, cohort, avg((NOT evacuated)::INT::DOUBLE) AS rate FROM agents GROUP BY 1, 2)
      SELECT run_id, round(CASE WHEN count(*) > 1 THEN max(rate) - min(rate) ELSE 0 END, 6) AS left_behind_index FROM c GROUP BY 1""",
    "q_run_metrics": f"""WITH {RUNS_SQL}, n AS (SELECT variant_name, status, count(*) AS n FROM runs GROUP BY 1, 2),
      s AS (SELECT variant_name, arg_max(status, (n, status)) AS dominant_exit, max(n) / sum(n) AS ds, (max(n) - min(n)) / sum(n) AS ss FROM n GROUP BY 1),
      b AS (SELECT variant_name, count(*) AS total, avg(travel) AS m, quantile_cont(travel, 0.5) AS p50, quantile_cont(travel, 0.95) AS p95 FROM runs GROUP BY 1)
      SELECT variant_name, total, round(m, 4) AS mean_travel, round(p50, 4) AS p50_travel, round(p95, 4) AS p95_travel, round(p95 - p50, 4) AS travel_gap, dominant_exit, round(ds, 4) AS dominant_share, round(ss, 4) AS share_spread FROM b JOIN s USING (variant_name)""",
    "q_compare_unpivot": f"""WITH {RUNS_SQL}, m AS (SELECT variant_name, avg(travel) AS mean_travel, max(travel) AS max_travel, count(*)::DOUBLE AS run_count FROM runs GROUP BY 1),
      u AS (UNPIVOT m ON mean_travel, max_travel, run_count INTO NAME metric VALUE v), a AS (SELECT metric, v AS baseline FROM u WHERE variant_name = '1-URGENT'), b AS (SELECT metric, v AS variant FROM u WHERE variant_name = '5-LOW')
      SELECT metric, round(baseline, 4) AS baseline, round(variant, 4) AS variant, round(variant - baseline, 4) AS delta, round(CASE WHEN abs(baseline) < 1e-9 THEN 0 ELSE (variant - baseline) / baseline * 100 END, 4) AS pct_change FROM a JOIN b USING (metric)""",
    "q_matched_ate": f"""WITH {RUNS_SQL}, p AS (SELECT seed, avg(travel) FILTER (variant_name = '1-URGENT') AS a, avg(travel) FILTER (variant_name = '5-LOW') AS b FROM runs GROUP BY 1),
      t AS (SELECT count(*) AS n_pairs, avg(b - a) AS ate, sum(b - a) AS s, min(b - a) AS lo, max(b - a) AS hi, avg(b) / avg(a) AS risk FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
      l AS (SELECT *, (s - hi) / (n_pairs - 1) AS loo_min, (s - lo) / (n_pairs - 1) AS loo_max, CASE WHEN risk >= 1 THEN risk ELSE 1 / risk END AS rr FROM t)
      SELECT n_pairs, round(ate, 4) AS ate, round(loo_min, 4) AS loo_min, round(loo_max, 4) AS loo_max, round(greatest(abs(loo_min - ate), abs(loo_max - ate)), 4) AS loo_max_shift, round(rr + sqrt(rr * (rr - 1)), 4) AS e_value FROM l""",
    "q_cohens_d": f"""WITH {RUNS_SQL}, {_sides}, g AS (SELECT status, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, avg(travel) FILTER (side = 'a') AS mean_a, avg(travel) FILTER (side = 'b') AS mean_b,
      coalesce(var_samp(travel) FILTER (side = 'a'), 0) AS va, coalesce(var_samp(travel) FILTER (side = 'b'), 0) AS vb FROM s GROUP BY 1)
      SELECT status, n_a, n_b, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(coalesce((mean_b - mean_a) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 0), 5) AS d FROM g""",
    "q_mwu": f"""WITH {RUNS_SQL}, {_sides}, k AS (SELECT *, rank() OVER (PARTITION BY status ORDER BY travel) + (count(*) OVER (PARTITION BY status, travel) - 1) / 2.0::DOUBLE AS r FROM s)
      SELECT status, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, round(sum(r) FILTER (side = 'a') - count(*) FILTER (side = 'a') * (count(*) FILTER (side = 'a') + 1) / 2.0::DOUBLE, 4) AS u FROM k GROUP BY 1""",
    "q_ks_bands": """WITH s AS (SELECT floor(l_quantity / 10)::BIGINT AS band, l_returnflag = 'R' AS a, l_extendedprice AS v FROM lineitem WHERE l_returnflag IN ('R', 'N')),
      c AS (SELECT band, v, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM s GROUP BY 1, 2),
      g AS (SELECT band, na, nb, abs(sum(na) OVER w / sum(na) OVER (PARTITION BY band) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY band)) AS gap FROM c WINDOW w AS (PARTITION BY band ORDER BY v ROWS UNBOUNDED PRECEDING)),
      t AS (SELECT band, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b, max(gap) AS d FROM g GROUP BY 1),
      x AS (SELECT *, (sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a::DOUBLE * n_b / (n_a + n_b))) * d AS z FROM t)
      SELECT band, n_a, n_b, CASE WHEN n_a > 1 AND n_b > 1 THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (SELECT sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * z * z)) FROM range(1, 101) t(k)))), 6) END AS p,
        CASE WHEN n_a > 1 AND n_b > 1 THEN round(d, 6) END AS d FROM x""",
    "q_gini": f"""WITH {RUNS_SQL}, n AS (SELECT status, seed, count(*) AS n FROM runs GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY status ORDER BY n, seed ROWS UNBOUNDED PRECEDING) AS run FROM n),
      g AS (SELECT status, count(*) AS members, CASE WHEN count(*) > 1 THEN (count(*) + 1 - 2 * (sum(run) / sum(n))) / count(*) ELSE 0 END AS gini FROM c GROUP BY 1) SELECT status, members, round(gini, 6) AS gini, gini > 0.6 AS herding FROM g""",
    "q_fis": """WITH g AS (SELECT l_returnflag, CASE WHEN count(*) >= 10 THEN 0.5 * coalesce(corr(l_quantity, l_discount), 0) - 0.5 * coalesce(corr(l_quantity, l_extendedprice), 0) ELSE 0 END AS score FROM lineitem GROUP BY 1)
      SELECT l_returnflag, round(score, 6) AS score, score > 0.4 AS detected FROM g""",
    "q_lane": f"""WITH {TRAJ_SQL}, {_grid}, p AS (SELECT run_id, cx, cy, max(path_usage) AS peak FROM u GROUP BY 1, 2, 3), l AS (SELECT run_id, count(*) AS cells, coalesce(stddev_samp(peak) / avg(peak), 0) AS lane_index FROM p GROUP BY 1)
      SELECT run_id, cells, round(lane_index, 6) AS lane_index, lane_index > 1.5 AS lanes FROM l""",
    "q_path_usage": f"WITH {TRAJ_SQL}, {_grid} SELECT run_id, k, cx, cy, occupancy, round(mean_speed, 6) AS mean_speed, path_usage FROM u",
    "q_llm_cost": """WITH c AS (SELECT role, greatest(1, (length(text) + 3) // 4) AS i, turn AS o FROM conversations)
      SELECT CASE WHEN grouping(role) = 1 THEN 'ALL' ELSE role END AS role, count(*) AS calls, sum(i)::DOUBLE AS input_tokens, sum(o)::DOUBLE AS output_tokens, round(sum((i * 1.0::DOUBLE + o * 2.0::DOUBLE) / 1e6), 6) AS usd FROM c GROUP BY GROUPING SETS ((role), ())""",
    "q_reason_explode": """WITH r AS (SELECT lang, list_filter([CASE WHEN contains(lower(text), 'licen') THEN 'boilerplate' END, CASE WHEN contains(lower(text), 'password') THEN 'credential' END, CASE WHEN contains(lower(text), 'http') THEN 'link' END], lambda x: x IS NOT NULL) AS l FROM documents),
      e AS (SELECT lang, unnest(CASE WHEN len(l) = 0 THEN ['accepted'] ELSE l END) AS reason FROM r) SELECT lang, reason, count(*) AS n FROM e GROUP BY 1, 2""",
    "q_generation_summary": """WITH c AS (SELECT role, text, length(text) AS n FROM conversations) SELECT role, count(*) AS events, count(*) FILTER (n % 3 = 0) AS hits, count(*) FILTER (n % 3 = 1) AS misses, count(*) FILTER (n % 5 <> 0) AS accepted,
      count(*) FILTER (n % 5 = 0) AS rejected, count(DISTINCT CASE WHEN n % 7 <> 0 THEN nullif(substr(text, 1, 8), '') END) AS cache_keys, count(*) FILTER (n % 2 = 0) AS fallbacks, round(avg((n % 10) / 10.0::DOUBLE), 6) AS mean_confidence FROM c GROUP BY 1""",
    "q_cache_usage_sets": """SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS records, sum(n_chars)::BIGINT AS chars, count(*) FILTER (n_chars > 1000) AS long_records
      FROM documents GROUP BY GROUPING SETS ((lang, source), ())""",
    "q_topk_policy": f"""WITH {TRAJ_SQL}, s AS (SELECT floor(time_s / 3600.0)::BIGINT AS step, event_id, speed + 0.25 * k AS score FROM traj), r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY score DESC, event_id)::INT AS place FROM s WHERE score > 0)
      SELECT step, event_id, round(score, 6) AS score, place FROM r WHERE place <= 3""",
    "q_largest_remainder": """WITH w AS (SELECT n_regionkey, n_name, count(*) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
      e AS (SELECT *, weight * 240::DOUBLE / sum(weight) OVER (PARTITION BY n_regionkey) AS x FROM w), f AS (SELECT *, floor(x)::BIGINT AS f FROM e),
      r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(x - f, 9) DESC, n_name) AS rk, 240 - sum(f) OVER (PARTITION BY n_regionkey) AS left_ FROM f)
      SELECT n_regionkey, n_name, weight, f + (rk <= left_)::BIGINT AS allotted FROM r""",
    "q_exit_flow_dense": """WITH o AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS step, o_orderstatus FROM orders), n AS (SELECT step, o_orderstatus, count(*) AS n FROM o GROUP BY 1, 2),
      d AS (SELECT * FROM (SELECT DISTINCT step FROM o), (SELECT DISTINCT o_orderstatus FROM o)), j AS (SELECT d.step, d.o_orderstatus, coalesce(n, 0) AS flow_step FROM d LEFT JOIN n USING (step, o_orderstatus))
      SELECT step, o_orderstatus, flow_step, sum(flow_step) OVER (PARTITION BY o_orderstatus ORDER BY step ROWS UNBOUNDED PRECEDING)::BIGINT AS flow_cumulative FROM j""",
    "q_congested": f"""WITH {RUNS_SQL}, n AS (SELECT variant_name, status, count(*) AS flow FROM runs GROUP BY 1, 2), s AS (SELECT *, flow / sum(flow) OVER (PARTITION BY variant_name) AS share FROM n) SELECT variant_name, status, flow, round(share, 6) AS share FROM s WHERE share >= 0.4""",
    "q_validation_runs": f"""WITH {RUNS_SQL} SELECT variant_name, status, count(DISTINCT seed) AS seed_count, count(*) FILTER (travel < 200000) AS pass_count, round(min(travel), 4) AS least, round(max(travel), 4) AS most, round(avg(travel), 4) AS mean,
      round(coalesce(1.96 * stddev_samp(travel) / sqrt(count(travel)), 0), 4) AS ci95 FROM runs GROUP BY 1, 2""",
    "q_elasticity": f"""WITH {_sweep}, d AS (SELECT *, mean - lag(mean) OVER x AS dv, param - lag(param) OVER x AS dp FROM w WINDOW x AS (PARTITION BY metric ORDER BY param))
      SELECT metric, round(param, 3) AS param, round(mean, 3) AS mean, round(std, 3) AS std, round(least, 3) AS least, round(most, 3) AS most, round(CASE WHEN abs(dp) <= 1e-12 THEN 0 ELSE dv / dp END, 3) AS elasticity FROM d""",
    "q_monotonic": f"""WITH {_sweep}, d AS (SELECT *, mean - lag(mean) OVER (PARTITION BY metric ORDER BY param) AS dv FROM w) SELECT metric, bool_and(dv >= 0) OR bool_and(dv <= 0) AS monotonic FROM d GROUP BY 1""",
    "q_score_leaderboard": f"""WITH {RUNS_SQL}, b AS (SELECT variant_name, seed, 100.0::DOUBLE * (0.35 / (1 + travel / 1e5) + 0.30 / (1 + seed / 10.0::DOUBLE) + 0.20 + 0.15 / 1.5) AS score FROM runs), s AS (SELECT variant_name, seed, avg(score) AS s FROM b GROUP BY 1, 2)
      SELECT variant_name, count(*) AS seeds, round(avg(s), 6) AS mean_score, round(coalesce(stddev_samp(s), 0), 6) AS score_std, CASE WHEN count(*) >= 20 THEN 'official' ELSE 'smoke' END AS tier FROM s GROUP BY 1""",
    "q_perf_gate": f"""WITH {RUNS_SQL}, b AS (SELECT variant_name, seed, avg(travel) AS base_s FROM runs WHERE status = 'F' AND seed > 2 GROUP BY 1, 2), n AS (SELECT variant_name, seed, avg(travel) AS now_s FROM runs WHERE status = 'O' GROUP BY 1, 2)
      SELECT variant_name, seed, round(now_s, 4) AS now_s, round(base_s, 4) AS base_s, round((now_s - base_s) / base_s * 100, 4) AS pct,
      CASE WHEN base_s IS NULL THEN 'missing_baseline' WHEN (now_s - base_s) / base_s > 0.1 THEN 'regression' ELSE 'ok' END AS status FROM n LEFT JOIN b USING (variant_name, seed)""",
    "q_weidmann": """WITH d AS (SELECT DISTINCT l_quantity / 10.0::DOUBLE AS density FROM lineitem) SELECT round(density, 6) AS density,
      round(CASE WHEN density <= 0.01 THEN 1.34 WHEN density >= 5.4 THEN 0 ELSE 1.34 * (1 - exp(-1.913 * (1 / density - 1 / 5.4::DOUBLE))) END, 6)::DOUBLE AS speed FROM d""",
    "q_hist": "SELECT l_returnflag, CASE WHEN l_extendedprice >= 100000 THEN 21 ELSE (floor(l_extendedprice / 5000.0) + 1)::BIGINT END AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "q_string_parse": r"SELECT p_partkey, try_cast(regexp_extract(p_brand, '#(\d)(\d)', 1) AS INT) AS maker, try_cast(regexp_extract(p_brand, '#(\d)(\d)', 2) AS INT) AS brand, split_part(p_type, ' ', 1) AS kind, len(string_split(p_type, ' '))::INT AS words FROM part",
    "q_sweep_product": "SELECT r_name, n_name, r_name || '__' || n_name AS variant FROM region, nation",
    "q_semi_anti": """SELECT c_mktsegment, count(*) AS n, 'with' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) GROUP BY 1
      UNION ALL SELECT c_mktsegment, count(*) AS n, 'without' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1""",
    "q_wilcoxon": f"""WITH {RUNS_SQL}, a AS (SELECT variant_name, seed, avg(travel) FILTER (status = 'O') AS a, avg(travel) FILTER (status = 'F') AS b FROM runs GROUP BY 1, 2),
      d AS (SELECT variant_name, round(b - a, 2) AS d FROM a WHERE a IS NOT NULL AND b IS NOT NULL), k AS (SELECT variant_name, d, rank() OVER (PARTITION BY variant_name ORDER BY abs(d)) + (count(*) OVER (PARTITION BY variant_name, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE abs(d) > 1e-12),
      g AS (SELECT variant_name, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, sum(r) AS t FROM k GROUP BY 1) SELECT variant_name, n, round(least(up, t - up), 6) AS w FROM g""",
}
# fmt: on
