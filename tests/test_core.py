"""Operators against hand-made figures; queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from egresslake.functions import scalars, text
from egresslake.operators import aggregates, audits, graph, spatial, statistics, trajectory
from egresslake.plans.registry import ORACLE_SQL, QUERIES
from egresslake.schemas import TABLES, empty, schema
from egresslake.sources import files, sinks
from egresslake.sources.bundle import StudyBundle
from egresslake.streaming import replay

PATHS = [(1, 0.0, 0.0, 0.0, 0.2), (1, 1.0, 3.0, 4.0, 0.4), (2, 0.0, 1.0, 1.0, 0.3), (2, 1.0, 1.0, 2.0, 0.5)]


@pytest.fixture(scope="module")
def paths(spark):
    return spark.createDataFrame(PATHS, "agent_id long, time_s double, x double, y double, local_density double")


def test_trajectory_summary(paths):
    r = trajectory.trajectory_summary(paths).first()
    assert (r.agent_count, r.sample_count, r.duration_s) == (2, 4, 1.0)
    assert (r.mean_path_length_m, r.mean_speed_mps) == (3.0, 3.0) and math.isclose(r.mean_local_density, 0.35)


def test_trajectory_needs_columns(spark):
    with pytest.raises(ValueError, match="missing columns: time_s, y"):
        trajectory.trajectory_summary(spark.createDataFrame([(1, 2.0)], "agent_id long, x double"))


def test_compare_paths(spark, paths):
    sim = paths.withColumn("variant_name", F.when(F.col("agent_id") == 1, "fast").otherwise("slow"))
    rows = {(r.variant_name, r.metric): r.delta for r in trajectory.compare_trajectories(sim, paths).collect()}
    assert rows[("fast", "mean_path_length_m")] == 2.0 and rows[("slow", "mean_path_length_m")] == -2.0


def test_crossings_and_flow(spark):
    rows = [(a, t, 0.0, y) for a, times in ((1, (0.0, 1.0)), (2, (1.0, 2.0))) for t, y in zip(times, (1.0, -1.0), strict=True)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "agent_id long, time_s double, x double, y double, event_id long")
    r = trajectory.flow_summary(df, (-0.35, 0.0), (0.35, 0.0)).first()
    assert (r.crossings, r.first_s, r.last_s, r.mean_flow_per_s, r.mean_headway_s) == (2, 1.0, 2.0, 2.0, 1.0)


def test_matched_effect(spark):
    a, b = ((10.0, 12.0, 14.0), (8.0, 9.0, 13.0))
    base, test = (spark.createDataFrame([(i + 1, v) for i, v in enumerate(x)], "seed int, m double") for x in (a, b))
    r = statistics.matched_effect(base, test, "seed", "m").first()
    assert r.n_pairs == 3 and r.ate == -2.0 and r.loo_min <= -2 <= r.loo_max and r.e_value > 1


def test_leaderboard_and_levels(spark):
    rows = [("p", 1, 10.0), ("p", 2, 30.0), ("p", 1, 20.0), ("p", 2, 40.0), (None, 3, 99.0)]
    df = spark.createDataFrame(rows, "policy string, seed int, s double")
    r = statistics.seed_mean_leaderboard(df.filter("policy is not null"), "policy", "seed", "s").first()
    assert (r.mean_score, r.seeds, r.tier) == (25.0, 2, "smoke")
    levels = {r.policy: (r.run_count, r.s, r.s_std) for r in aggregates.summary_levels(df, "policy", ["s"]).collect()}
    assert levels["p"][:2] == (4, 25.0) and None in levels
    one = aggregates.summary_levels(df.limit(1), "policy", ["s"]).filter("policy = 'p'").first()
    assert one.s_std == 0.0


def test_equity(spark):
    rows = [("r", True, 10.0, 0.1, 0.2, "senior", 0.2), ("r", True, 6.0, 0.2, 0.0, "adult", 0.8), ("r", False, 0.0, 0.3, 0.0, "adult", 0.5)]
    df = spark.createDataFrame(rows, "run_id string, evacuated boolean, travel_time_s double, hazard_exposure double, impairment double, age_band string, familiarity double")
    got = {r.subgroup_tag: r for r in aggregates.equity_subgroups(df).collect()}
    assert (got["impaired"].agent_count, got["impaired"].mean_travel_time_s) == (1, 10.0) and got["impaired"].evacuation_rate_gap_vs_run > 0
    assert "unknown_age" not in got and got["non_elderly"].agent_count == 2


def test_reasons_and_costs(spark):
    df = spark.createDataFrame([("",), ("invented_exit:(9, 9);vague_guidance",)], "r string")
    assert {(r.reason, r.n) for r in aggregates.reason_counts(df, "r").collect()} == {("accepted", 1), ("invented_exit:(9, 9)", 1), ("vague_guidance", 1)}
    calls = spark.createDataFrame([("a", 100, 20), ("b", 200, 30)], "p string, i long, o long")
    total = aggregates.cost_report(calls, ["p"], "i", "o", 1.0, 2.0).filter("p = 'ALL'").first()
    assert (total.input_tokens, total.output_tokens) == (300, 50) and math.isclose(total.usd, 0.0004)


def test_largest_remainder_adds_up(spark):
    df = spark.createDataFrame([("g", f"h{i}", w) for i, w in enumerate((1, 1, 1, 5, 0))], "g string, h string, w long")
    rows = aggregates.largest_remainder(df, ["g"], "w", F.lit(10).cast("long"), ["h"]).collect()
    assert sum(r.allotted for r in rows) == 10 and max(r.allotted for r in rows) == 6


def test_perf_gate(spark):
    base, now = (spark.createDataFrame(x, "s string, t double") for x in ([("a", 10.0)], [("a", 11.2), ("b", 1.0)]))
    assert {r.s: r.status for r in statistics.perf_gate(base, now, ["s"], "t").collect()} == {"a": "regression", "b": "missing_baseline"}


def test_rank_tests_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", 2.0), (1, "b", 5.0), (1, "b", None)], "g int, side string, v double")
    r = statistics.mann_whitney(df, ["g"], "side", "v").first()
    assert (r.n_a, r.n_b, r.u) == (2, 2, 0.5) and 0 < r.p <= 1
    k = statistics.ks_gap(df, ["g"], "side", "v").first()
    assert k.d == 0.5
    flat = spark.createDataFrame([(1, 3.0, 4.0)] * 12, "g int, q double, o double").withColumn("d", F.col("q"))
    assert aggregates.faster_is_slower(flat, ["g"], "q", "d", "o").first().score == 0.0


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)], "g string, v double")
    r, s = (statistics.bootstrap_ci(df, ["g"], "v").first() for _ in range(2))
    assert r == s and r.ci_low < 9.5 < r.ci_high


def test_text_rules(spark):
    row = spark.createDataFrame([("Trust me: man-in-the-middle", "Stay  Calm", "go east", "0;3-1", "1,5")], "a string, b string, c string, d string, e string").select(
        text.attack_reasons(F.col("a")).alias("a"), text.is_vague(F.col("b")).alias("b"), text.is_vague(F.col("c")).alias("c"), text.levels(F.col("d")).alias("d"), text.decimal_comma(F.col("e")).alias("e"), text.token_estimate(F.lit("")).alias("t")
    ).first()
    assert row.a == ["attack_pattern:aitm_interception", "attack_pattern:coercive_persuasion"] and row.b and not row.c and row.d == [0, 3, 2, 1] and row.e == 1.5 and row.t == 1


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.binary_entropy(F.lit(0.5)).alias("h"), scalars.binary_entropy(F.lit(1.0)).alias("z"), scalars.weidmann(F.lit(0.0)).alias("v"), scalars.weidmann(F.lit(6.0)).alias("j"), scalars.capacity(F.lit("stair"), F.lit(1.25)).alias("c"),
        scalars.agent_entropy(F.array(F.lit(0.5)), F.array().cast("array<struct<severity:double,freshness:double>>"), F.lit(0.0), F.lit(2), F.lit(1)).alias("e"), scalars.kolmogorov_p(F.lit(1.36)).alias("p"), scalars.normal_cdf(F.lit(1.96)).alias("n"),
    ).first()
    assert (row.h, row.z, row.v, row.j, row.c) == (1.0, 0.0, 1.34, 0.0, 2) and math.isclose(row.e, 0.75)
    assert abs(row.p - 0.0494) < 1e-3 and abs(row.n - 0.975) < 1e-4


def test_spatial(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, -0.2, -0.1), (4, 5.0, 5.0)], "i int, x double, y double")
    pairs = {(r.l_i, r.r_i) for r in spatial.radius_pairs(pts, pts, 1.0, least=1e-6).collect()}
    assert pairs == {(1, 2), (2, 1), (1, 3), (3, 1)}
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    inside = spark.range(1).select(spatial.in_polygon(F.lit(1.0), F.lit(1.0), ring).alias("a"), spatial.in_polygon(F.lit(2.0), F.lit(3.0), ring).alias("b")).first()
    assert inside.a and not inside.b
    walls = spark.createDataFrame([(2, 0)], "x int, y int")
    sight = spark.createDataFrame([(1, 0.5, 0.5, 4.5, 0.5), (2, 0.5, 1.5, 4.5, 1.5)], "pair_id int, ax double, ay double, bx double, by double")
    assert {r.pair_id: r.clear for r in spatial.line_of_sight(sight, walls).collect()} == {1: False, 2: True}


def test_layout_and_graph(spark):
    cells = files.layout_text(spark.createDataFrame([("0", "X@..EX")], "floor_id string, text string"))
    assert files.layout_back(cells).first().text == "X@..EX"
    walk = cells.withColumn("walkable", F.col("token") != "X")
    way = graph.shortest(graph.edges(walk), walk.filter("token = 'E'")).orderBy("x").collect()
    assert [(r.x, r.cost, r.nx) for r in way] == [(1, 3.0, 2), (2, 2.0, 3), (3, 1.0, 4), (4, 0.0, None)]
    cut = walk.withColumn("walkable", F.col("walkable") & (F.col("x") != 2))
    assert {r.x for r in graph.reachable(graph.edges(cut), cut.filter("token = 'E'")).collect()} == {3, 4}


def test_chain_and_budget(spark):
    df = spark.createDataFrame([("c", i, f"m{i}", float(c)) for i, c in enumerate((5, 8, 4, 1))], "k string, n int, t string, c double")
    chain = audits.chained(df, ["k"], ["n"], F.sha2("t", 256))
    assert audits.verified_chain(chain, ["k"], ["n"]).first().first_bad is None
    broken = chain.withColumn("row_hash", F.when(F.col("n") == 2, "x").otherwise(F.col("row_hash")))
    r = audits.verified_chain(broken, ["k"], ["n"]).first()
    assert (r.first_bad, r.reason) == (3, "row_hash_mismatch")
    assert [r.allowed for r in audits.budgeted(df, ["k"], ["n"], "c", 10.0).orderBy("n").collect()] == [True, False, True, True]


def test_bundle_round_trip(spark, tmp_path):
    tables = {t: empty(spark, t) for t in TABLES}
    tables["gossip"] = spark.createDataFrame([("s", "c", "v", 1, "r", 10, 1.0, 1, 2, 0.5)], schema("gossip"))
    StudyBundle(tables, {"a": 1}).export(str(tmp_path))
    back = StudyBundle.load(spark, str(tmp_path))
    assert back.metadata == {"a": 1} and back.tables["gossip"].collect() == tables["gossip"].collect() and back.tables["cells"].columns == tables["cells"].columns
    (tmp_path / "tables" / "gossip.parquet").rename(tmp_path / "gone")
    again = StudyBundle.load(spark, str(tmp_path))
    assert again.tables["gossip"].collect() == tables["gossip"].collect() and len(TABLES) == 16


def test_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\n\n1 25 0.5 1\n2 50 1 2 3.5\n")
    assert [(r.agent_id, r.time_s, r.z) for r in files.petrack(spark, str(tmp_path / "p.txt")).orderBy("agent_id").collect()] == [(1, 1.0, 0.0), (2, 2.0, 3.5)]
    (tmp_path / "h.csv").write_text("x,y,Soot_Mass_Fraction,visibility_m\n1,5,0.2,15\n2,5,0.4,60\n")
    assert [(r.ix, r.iy, r.intensity, r.visibility) for r in files.hazard_csv(spark, str(tmp_path / "h.csv")).orderBy("ix").collect()] == [(0, 0, 0.5, 0.5), (1, 0, 1.0, 1.0)]
    (tmp_path / "cache" / "a").mkdir(parents=True)
    (tmp_path / "cache" / "a" / "1.json").write_text('{"key": "k", "model": "m", "validation": {"status": "rejected", "reasons": ["x", "y"]}, "usage": {"prompt_tokens": 7, "output_tokens": 3}}')
    r = files.cache_records(spark, str(tmp_path / "cache")).first()
    assert (r.validation_reasons, r.input_tokens, r.output_tokens) == ("x;y", 7, 3)
    t = spark.createDataFrame([(1, 0.25, 1.0, 2.0), (1, 0.35, 1.0, 2.0)], "agent_id long, time_s double, x double, y double")
    assert [r.frame for r in sinks.external_frame(t).orderBy("time_s").collect()] == [2, 4]
    assert sinks.write_sqlite(t.withColumn("step", F.lit(1)), str(tmp_path / "t.db")) == 2


def test_streaming_matches_batch(spark, tmp_path):
    rows = [(1, "s", i, i % 2 == 0) for i in range(4)]
    df = spark.createDataFrame(rows, "agent_id long, source_id string, step int, supported boolean")
    batch = {r.step: r.credibility for r in replay.credibility(df, forgetting=1.0).collect()}
    assert math.isclose(batch[0], 0.6) and math.isclose(batch[1], 0.5)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = replay.credibility(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), forgetting=1.0).writeStream.format("memory").queryName("cred").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert {r.step: r.credibility for r in spark.table("cred").collect()} == batch
    t = spark.createDataFrame([(1, "z", 0.0, 1.0), (1, "z", 30.0, 3.0), (1, "z", 1000.0, 5.0)], "agent_id long, zone string, time_s double, v double")
    assert replay.zone_sessions(t, "zone").count() == 2 and replay.windowed_means(t, ["v"]).orderBy("start").first().v == 2.0


def test_connector_queue(spark):
    df = spark.createDataFrame([("c", 1, 0.0), ("c", 2, 0.0)], "connector_id string, agent_id long, time_s double")
    assert {r.agent_id: r.start_s for r in replay.connector_queue(df).collect()} == {1: 0.0, 2: 1.0}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)

    def plain(v):
        return float(f"{v:.7g}") if isinstance(v, float) else v

    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
