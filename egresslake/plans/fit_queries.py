"""Zone membership, fits, exact p-values and resampled intervals over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import calibration as C
from egresslake.operators import resampling as B
from egresslake.operators import statistics as S
from egresslake.operators import zones as Z
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import TRAJ_SQL, runs, table, traj

DT = 0.5
P1, P2 = (5.0, 0.0), (5.0, 9.7)
FEATURES, L2 = ("price",), 1e-3


def samples(spark, sf_dir):
    """Trajectory samples with step (the event's number) and zone_id: clicks and views are zones, other events are outside."""
    t = traj(spark, sf_dir).withColumn("step", F.col("event_id")).withColumn("local_density", F.col("k").cast("double"))
    return t.withColumn("zone_id", F.when(F.col("variant_name").isin("click", "view"), F.col("variant_name")))


def q_zone_transitions(spark, sf_dir):
    return rounded(Z.zone_transitions(samples(spark, sf_dir), DT))


def q_bottleneck_rows(spark, sf_dir):
    return rounded(Z.bottleneck_rows(samples(spark, sf_dir), DT))


def q_line_transitions(spark, sf_dir):
    return rounded(Z.line_transitions(samples(spark, sf_dir), P1, P2))


def few(spark, sf_dir):
    """Order prices per customer, urgent and high ones as side a."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", F.col("o_totalprice").alias("v"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "a").otherwise("b").alias("side"))


def q_exact_mwu(spark, sf_dir):
    g = S.mann_whitney(few(spark, sf_dir), ["o_custkey"], "side", "v")
    return rounded(g.filter("n_a between 1 and 8 and n_b between 1 and 8"), 8)


def q_exact_wilcoxon(spark, sf_dir):
    g = S.wilcoxon(few(spark, sf_dir).withColumn("delta", F.col("v") - 150_000), ["o_custkey"], "delta")
    return rounded(g.filter("n <= 24"), 8)


def choices(spark, sf_dir):
    """Orders as choices of their customers: dearer orders are chosen more often."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price"), (F.col("o_totalprice") / 500 > F.pmod(F.col("o_orderkey") * 7919, F.lit(1000))).cast("int").alias("chosen"))


def q_choice_fit(spark, sf_dir):
    split = C.held_out(choices(spark, sf_dir), "user_id")
    model = C.logistic(split.filter("not test"), FEATURES, "chosen", L2)
    out = C.choice_metrics(split, model, "chosen").withColumns({"intercept": F.lit(model.weights[0]), "price": F.lit(model.weights[1]), "mean": F.lit(model.mean[0]), "scale": F.lit(model.scale[0])})
    return rounded(out, 5)


def demand(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("station"), F.month("o_orderdate").alias("hour"), F.lit(1).alias("riders"))


def q_demand_profile(spark, sf_dir):
    return rounded(C.demand_profile(demand(spark, sf_dir), "station", "hour", "riders", 240), 5)


def q_demand_metrics(spark, sf_dir):
    m = rounded(C.demand_metrics(C.demand_profile(demand(spark, sf_dir), "station", "hour", "riders", 240)), 4)
    return m.withColumn("total_residual", F.col("total_residual") + 0.0)  # no negative zero


def q_bootstrap_ci(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("variant_name", "seed").agg(F.avg("travel").alias("s"))
    return rounded(B.intervals(s, ["variant_name"], "s", 200), 4)


def q_paired_ci(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("status", "seed").agg(F.avg(F.when(F.col("variant_name") == "1-URGENT", F.col("travel"))).alias("u"), F.avg(F.when(F.col("variant_name") == "5-LOW", F.col("travel"))).alias("l"))
    return rounded(B.difference_intervals(s, ["status"], "l", "u", 200), 4)


def q_leaderboard_ci(spark, sf_dir):
    board = B.leaderboard(runs(spark, sf_dir), "variant_name", "seed", "travel", "status", 200)
    return rounded(board.withColumn("seeds", F.array_join("seeds", ",")), 4)


def curve_points(spark, sf_dir):
    """Speeds of a curve with free speed 1.2, shape 2.5 and jam density 6, and a disturbance that sums to about nothing."""
    li = table(spark, sf_dir, "lineitem")
    d = 0.3 + F.pmod(F.col("l_orderkey"), F.lit(50)) / 10
    free = 1.2 * (1 - F.exp(-2.5 * (1 / d - 1 / 6.0)))
    return li.select(d.alias("density"), (free + (F.pmod(F.col("l_partkey"), F.lit(21)) - 10) / 1000).alias("speed"))


def q_curve_fit(spark, sf_dir):
    fit = C.curve_fit(curve_points(spark, sf_dir))
    return spark.createDataFrame([(*[round(fit[k], 4) for k in ("v0_fit", "gamma_fit", "rho_max_fit", "r_squared", "rmse")], fit["n_points"])], "v0_fit double, gamma_fit double, rho_max_fit double, r_squared double, rmse double, n_points long")


QUERIES = {f.__name__: f for f in (q_zone_transitions, q_bottleneck_rows, q_line_transitions, q_exact_mwu, q_exact_wilcoxon, q_choice_fit, q_demand_profile, q_demand_metrics, q_bootstrap_ci, q_paired_ci, q_leaderboard_ci, q_curve_fit)}

# fmt: off
_changes = f"""{TRAJ_SQL}, s AS (SELECT *, event_id AS step, k::DOUBLE AS local_density, CASE WHEN variant_name IN ('click', 'view') THEN variant_name END AS zone_id FROM traj),
  l AS (SELECT *, lag(zone_id) OVER w AS before, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY step)),
  c AS (SELECT * FROM l WHERE zone_id IS DISTINCT FROM before),
  e AS (SELECT *, last_value(CASE WHEN zone_id IS NOT NULL THEN step END IGNORE NULLS) OVER (PARTITION BY run_id, agent_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM c),
  t AS (SELECT run_id, agent_id, step, time_s, before AS zone_id, 'exit' AS kind, greatest((step - entry) * {DT}::DOUBLE, {DT}::DOUBLE) AS dwell_s FROM e WHERE before IS NOT NULL
    UNION ALL SELECT run_id, agent_id, step, time_s, zone_id, 'enter', NULL FROM e WHERE zone_id IS NOT NULL)"""
_side = f"(x - {P1[0]}::DOUBLE) * -1.0::DOUBLE"
_draw = "(('0x' || substr(md5('42:' || b::VARCHAR || ':' || j::VARCHAR), 1, 8))::BIGINT % n)"


def _boot(values: str, group: str) -> str:
    """CTEs that end in ci(group, n, mean, ci_low, ci_high) from values(group, v)."""
    return f"""p AS (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY v) - 1 AS j, count(*) OVER (PARTITION BY {group}) AS n FROM {values} WHERE v IS NOT NULL),
      d AS (SELECT {group}, n, b, {_draw} AS j FROM p, (SELECT unnest(range(1, 201)) AS b)),
      m AS (SELECT {', '.join(f'd.{g.strip()}' for g in group.split(','))}, d.n, b, sum(v) / any_value(d.n) AS m FROM d JOIN p ON {' AND '.join(f'd.{g.strip()} IS NOT DISTINCT FROM p.{g.strip()}' for g in group.split(','))} AND d.j = p.j GROUP BY ALL),
      q AS (SELECT {group}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL),
      w AS (SELECT {group}, count(*) AS n, avg(v) AS mean FROM p GROUP BY ALL),
      ci AS (SELECT {', '.join(f'w.{g.strip()}' for g in group.split(','))}, n, mean, CASE WHEN n < 2 THEN mean ELSE lo END AS ci_low, CASE WHEN n < 2 THEN mean ELSE hi END AS ci_high FROM w JOIN q ON {' AND '.join(f'w.{g.strip()} IS NOT DISTINCT FROM q.{g.strip()}' for g in group.split(','))})"""


_runs = "runs AS (SELECT o_orderpriority AS variant_name, o_custkey % 20 AS seed, o_totalprice AS travel, o_orderstatus AS status FROM orders)"
_demand = """d AS (SELECT o_orderpriority AS station, month(o_orderdate) AS hour, count(*)::DOUBLE AS observed FROM orders GROUP BY ALL),
  x AS (SELECT *, sum(observed) OVER (PARTITION BY station) AS a, observed * 240 / sum(observed) OVER (PARTITION BY station) AS exact FROM d),
  f AS (SELECT *, 240 - sum(floor(exact)) OVER (PARTITION BY station) AS spare, row_number() OVER (PARTITION BY station ORDER BY round(exact - floor(exact), 9) DESC, hour) AS r FROM x),
  g AS (SELECT station, hour, observed, exact AS raw_agents, (floor(exact) + CASE WHEN r <= spare THEN 1 ELSE 0 END)::BIGINT AS agents, a FROM f),
  profile AS (SELECT station, hour, observed, raw_agents, agents, agents * a / 240 AS predicted, observed - agents * a / 240 AS residual, row_number() OVER (PARTITION BY station ORDER BY hour) - 1 AS release_step FROM g)"""
_few = "few AS (SELECT o_custkey, o_totalprice AS v, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' ELSE 'b' END AS side FROM orders)"
_curve = """p AS (SELECT 0.3 + l_orderkey % 50 / 10 AS d, 1.2 * (1 - exp(-2.5 * (1 / (0.3 + l_orderkey % 50 / 10) - 1 / 6.0::DOUBLE))) + (l_partkey % 21 - 10) / 1000 AS v FROM lineitem), f AS (SELECT d::DOUBLE AS d, v FROM p WHERE d > 0.01 AND v > 0.01),
  c AS (SELECT d, count(*)::DOUBLE AS n, sum(v) AS s, sum(v * v) AS q FROM f GROUP BY 1),
  it(i, v0, gm, jam) AS (SELECT 0, 1.34::DOUBLE, 1.913::DOUBLE, 5.4::DOUBLE UNION ALL SELECT i + 1, v0 + (ga * (bb * cc - bc * bc) - ab * (gb * cc - bc * gc) + ac * (gb * bc - bb * gc)) / det, gm + (aa * (gb * cc - bc * gc) - ga * (ab * cc - bc * ac) + ac * (ab * gc - gb * ac)) / det,
    jam + (aa * (bb * gc - gb * bc) - ab * (ab * gc - gb * ac) + ga * (ab * bc - bb * ac)) / det FROM (
    SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM (
    SELECT i, v0, gm, jam, sum(n * a * a) AS aa, sum(n * a * b) AS ab, sum(n * a * k) AS ac, sum(n * b * b) AS bb, sum(n * b * k) AS bc, sum(n * k * k) AS cc, sum(a * r) AS ga, sum(b * r) AS gb, sum(k * r) AS gc FROM (
    SELECT i, v0, gm, jam, n, 1 - e AS a, v0 * arm * e AS b, v0 * gm * e / (jam * jam) AS k, s - n * v0 * (1 - e) AS r FROM (SELECT it.*, n, s, 1 / d - 1 / jam AS arm, exp(-gm * (1 / d - 1 / jam)) AS e FROM it, c)) GROUP BY i, v0, gm, jam)) WHERE i < 25),
  w AS (SELECT v0, gm, jam FROM it WHERE i = 25), t AS (SELECT sum(n) AS n, sum(q) AS q, sum(s) AS s FROM c), e AS (SELECT sum(q - 2 * g * s + n * g * g) AS sse FROM (SELECT c.*, v0 * (1 - exp(-gm * (1 / d - 1 / jam))) AS g FROM c, w))"""
SQL = {
    "q_curve_fit": f"WITH RECURSIVE {_curve} SELECT round(v0, 4) AS v0_fit, round(gm, 4) AS gamma_fit, round(jam, 4) AS rho_max_fit, round(1 - sse / (q - s * s / n), 4) AS r_squared, round(sqrt(sse / n), 4) AS rmse, n::BIGINT AS n_points FROM w, t, e",
    "q_bootstrap": f"WITH {_runs}, s AS (SELECT variant_name, avg(travel) AS v FROM runs GROUP BY variant_name, seed), {_boot('s', 'variant_name').replace('range(1, 201)', 'range(1, 1001)')} SELECT variant_name, n, round(mean, 4) AS mean, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ci",
    "q_zone_transitions": f"WITH {_changes} SELECT run_id, agent_id, step, round(time_s, 6) AS time_s, zone_id, kind, round(dwell_s, 6) AS dwell_s FROM t",
    "q_bottleneck_rows": f"""WITH {_changes}, o AS (SELECT run_id, zone_id, step, count(*) AS occupancy, avg(speed) AS mean_speed, avg(local_density) AS mean_density FROM s WHERE zone_id IS NOT NULL GROUP BY ALL),
      g AS (SELECT run_id, zone_id, step, count(*) FILTER (kind = 'enter') AS inflow, count(*) FILTER (kind = 'exit') AS outflow, coalesce(sum(dwell_s), 0) AS ds, count(dwell_s) AS dn FROM t GROUP BY ALL),
      b AS (SELECT run_id, zone_id, step, coalesce(occupancy, 0) AS occupancy, coalesce(mean_speed, 0) AS mean_speed, coalesce(mean_density, 0) AS mean_density, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(ds, 0) AS ds, coalesce(dn, 0) AS dn FROM o FULL JOIN g USING (run_id, zone_id, step))
      SELECT run_id, zone_id, step, occupancy, round(mean_speed, 6) AS mean_speed, round(coalesce(mean_density, 0), 6) AS mean_density, inflow, outflow, round(coalesce(sum(ds) OVER w / nullif(sum(dn) OVER w, 0), 0), 6) AS mean_dwell_s FROM b
      WINDOW w AS (PARTITION BY run_id, zone_id ORDER BY step)""",
    "q_line_transitions": f"""WITH {TRAJ_SQL}, l AS (SELECT run_id, agent_id, event_id AS step, time_s, {_side} AS side, y AS along, lag({_side}) OVER w AS side0, lag(y) OVER w AS along0 FROM traj WINDOW w AS (PARTITION BY run_id, agent_id ORDER BY event_id))
      SELECT run_id, agent_id, step, round(time_s, 6) AS time_s, sign(side)::INT AS direction FROM l WHERE side0 * side < 0 AND (along0 + along) / 2 BETWEEN -0.5 AND {P2[1]}::DOUBLE + 0.5""",
    "q_exact_mwu": f"""WITH RECURSIVE {_few}, k AS (SELECT o_custkey, side, rank() OVER (PARTITION BY o_custkey ORDER BY v) + (count(*) OVER (PARTITION BY o_custkey, v) - 1) / 2.0 AS r FROM few),
      g AS (SELECT o_custkey, count(*) FILTER (side = 'a') AS n_a, count(*) FILTER (side = 'b') AS n_b, sum(r) FILTER (side = 'a') AS ra FROM k GROUP BY 1),
      h AS (SELECT o_custkey, n_a, n_b, ra - n_a * (n_a + 1) / 2.0 AS u FROM g WHERE n_a BETWEEN 1 AND 8 AND n_b BETWEEN 1 AND 8),
      c(i, j, s, c) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL SELECT i + 1, j + take, s + take * (i + 1), sum(c) FROM c, (VALUES (0), (1)) AS t(take) WHERE i < 16 AND j + take <= 8 GROUP BY i, j + take, s + take * (i + 1)),
      z AS (SELECT o_custkey, n_a, n_b, u, sum(c) FILTER (s - j * (j + 1) / 2 <= least(u, n_a * n_b - u)) / sum(c) AS tail FROM h JOIN c ON i = n_a + n_b AND j = n_a GROUP BY ALL)
      SELECT o_custkey, n_a, n_b, round(u::DOUBLE, 8) AS u, round(least(1, 2 * tail), 8) AS p FROM z""",
    "q_exact_wilcoxon": f"""WITH RECURSIVE {_few}, d AS (SELECT o_custkey, v - 150000 AS delta FROM few WHERE abs(v - 150000) > 1e-12), k AS (SELECT o_custkey, delta, count(*) OVER (PARTITION BY o_custkey, abs(delta)) AS t, rank() OVER (PARTITION BY o_custkey ORDER BY abs(delta)) AS r FROM d),
      g AS (SELECT o_custkey, count(*) AS n, coalesce(sum(r + (t - 1) / 2.0::DOUBLE) FILTER (delta > 0), 0) AS up, sum(t * t - 1) AS ties FROM k GROUP BY 1),
      h AS (SELECT o_custkey, n, ties, least(up, n * (n + 1) / 2.0::DOUBLE - up) AS w, n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE AS var FROM g WHERE n <= 24),
      a AS (SELECT *, CASE WHEN var > 0 THEN abs(w - n * (n + 1) / 4.0::DOUBLE) / sqrt(var) END / sqrt(2) AS x FROM h), b AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * x) AS u FROM a),
      c(i, s, c) AS (SELECT 0, 0, 1::DOUBLE UNION ALL SELECT i + 1, s + take * (i + 1), sum(c) FROM c, (VALUES (0), (1)) AS t(take) WHERE i < 24 GROUP BY i, s + take * (i + 1))
      SELECT o_custkey, n, round(w::DOUBLE, 8) AS w, round(CASE WHEN ties = 0 THEN least(1, 2 * sum(c) FILTER (s <= w) / sum(c))
        ELSE coalesce(((((1.061405429::DOUBLE * u - 1.453152027::DOUBLE) * u + 1.421413741::DOUBLE) * u - 0.284496736::DOUBLE) * u + 0.254829592::DOUBLE) * u * exp(-x * x), 1) END, 8) AS p FROM b JOIN c ON i = n GROUP BY o_custkey, n, w, ties, x, u""",
    "q_choice_fit": f"""WITH RECURSIVE a AS (SELECT o_custkey AS user_id, o_totalprice AS x, CASE WHEN o_totalprice / 500 > (o_orderkey * 7919) % 1000 THEN 1.0::DOUBLE ELSE 0.0 END AS y FROM orders),
      s AS (SELECT *, (dense_rank() OVER (ORDER BY user_id) - 1) % 5 = 0 AS test FROM a), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, avg(y) AS rate FROM s WHERE NOT test), r AS (SELECT y, test, (x - mu) / sd AS z, rate FROM s, m),
      it(i, w0, w1) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, w0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), w1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT i, w0, w1, avg(p - y) AS g0, avg((p - y) * z) + {L2}::DOUBLE * w1 AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + {L2}::DOUBLE AS h11
        FROM (SELECT i, w0, w1, y, z, 1 / (1 + exp(-(w0 + w1 * z))) AS p FROM it, r WHERE NOT test) GROUP BY i, w0, w1) WHERE i < 20),
      w AS (SELECT w0, w1 FROM it WHERE i = 20), q AS (SELECT test, y, 1 / (1 + exp(-(w0 + w1 * z))) AS p, rate, w0, w1, mu, sd FROM r, w, (SELECT mu, sd FROM m))
      SELECT count(*) FILTER (NOT test) AS train, count(*) FILTER (test) AS test, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FILTER (NOT test), 5) AS train_log_loss, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))) FILTER (test), 5) AS test_log_loss,
        round(avg(-(y * ln(rate) + (1 - y) * ln(1 - rate))) FILTER (test), 5) AS test_baseline_log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) FILTER (test), 5) AS test_accuracy, round(avg(CASE WHEN (rate >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) FILTER (test), 5) AS test_baseline_accuracy,
        round(avg(y * ln(p) + (1 - y) * ln(1 - p) - y * ln(rate) - (1 - y) * ln(1 - rate)) FILTER (test), 5) AS test_log_loss_improvement, round(any_value(w0), 5) AS intercept, round(any_value(w1), 5) AS price, round(any_value(mu), 5) AS mean, round(any_value(sd), 5) AS scale FROM q""",
    "q_demand_profile": f"WITH {_demand} SELECT station, hour, round(observed, 5) AS observed, round(raw_agents, 5) AS raw_agents, agents, round(predicted, 5) AS predicted, round(residual, 5) AS residual, release_step FROM profile",
    "q_demand_metrics": f"""WITH {_demand} SELECT station, count(*) AS hours, round(sum(observed), 4) AS observed_total, round(sum(agents) / sum(observed), 4) AS agents_per_rider, round(avg(abs(residual)), 4) AS mae, round(sqrt(avg(residual * residual)), 4) AS rmse,
      round(max(abs(residual)), 4) AS max_abs, round(sum(residual), 4) + 0.0 AS total_residual FROM profile GROUP BY station""",
    "q_bootstrap_ci": f"WITH {_runs}, s AS (SELECT variant_name, avg(travel) AS v FROM runs GROUP BY variant_name, seed), {_boot('s', 'variant_name')} SELECT variant_name, n, round(mean, 4) AS mean, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ci",
    "q_paired_ci": f"""WITH {_runs}, s AS (SELECT status, avg(travel) FILTER (variant_name = '1-URGENT') - avg(travel) FILTER (variant_name = '5-LOW') AS v FROM runs GROUP BY status, seed), {_boot('s', 'status')}
      SELECT status, n, round(mean, 4) AS mean, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high FROM ci""",
    "q_leaderboard_ci": f"""WITH {_runs}, both_ AS (SELECT variant_name AS policy, NULL AS scenario, seed, travel FROM runs UNION ALL SELECT variant_name, status, seed, travel FROM runs),
      s AS (SELECT policy, scenario, seed, avg(travel) AS v, count(*) AS runs FROM both_ GROUP BY ALL), {_boot('s', 'policy, scenario')},
      k AS (SELECT policy, scenario, string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS seeds0, list_sort(list(DISTINCT seed)) AS seeds, count(DISTINCT seed) AS seed_count, sum(runs)::BIGINT AS run_count FROM s GROUP BY ALL)
      SELECT ci.policy, ci.scenario, round(mean, 4) AS mean_score, round(ci_low, 4) AS score_ci_low, round(ci_high, 4) AS score_ci_high, array_to_string(seeds, ',') AS seeds, seed_count, run_count, CASE WHEN seed_count >= 20 THEN 'official' ELSE 'smoke' END AS tier
      FROM ci JOIN k ON ci.policy = k.policy AND ci.scenario IS NOT DISTINCT FROM k.scenario""",
}
# fmt: on
