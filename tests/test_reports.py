"""Report tables by rule."""

import json

import pytest
from pyspark.sql import functions as F

from egresslake.operators import comparison, plausibility, reports


def test_intents_sum_and_keep_missing_keys(spark):
    names = ", ".join(f"{k} {'int' if k in ('seed', 'step', 'x', 'y') else 'double' if k in ('time_s', 'z') else 'string'}" for k in reports.INTENT_KEYS)
    row = ("s", "c", "v", 1, "r", 2, 1.0, None, 0.0, 3, 4, "flee")
    got = reports.intent_counts(spark.createDataFrame([(*row, 2), (*row, 5), (*row[:-1], "wait", 1)], f"{names}, count int")).collect()
    assert [(r.intent, r["count"]) for r in got] == [("flee", 7), ("wait", 1)] and len(got[0]) == 13


def test_default_claims_meet_their_studies(spark):
    claims = reports.default_claims(spark)
    assert claims.count() == 8 and {r.study for r in claims.collect()} == {"prompt_objective", "budget_equivalence"}
    runs = [("run", v, s, 1.0 * s + k, 2.0 - k) for k, v in enumerate(("static_beacon", "llm_openai_safety")) for s in range(6)]
    summary = spark.createDataFrame(runs, "record_type string, variant_name string, seed int, information_safety_efficiency double, harmful_convergence_index double")
    got = comparison.compare_claims(summary, reports.CLAIM_METRICS, claims.filter("study = 'prompt_objective'"), intervals=False).collect()
    assert {(r.claim, r.metric) for r in got} == {("sparse_safety_vs_static", "information_safety_efficiency"), ("sparse_safety_vs_static", "harmful_convergence_index")}
    assert all(r.supports_test and r.n_paired == 6 for r in got)


def test_calibration_status(spark):
    rows = [(c, m, 1.0, 2.0, p) for c, ps in (("a", (-15.0, 25.0, 10.0)), ("b", (16.0, 0.0, 0.0)), ("c", (None, 1.0, 1.0))) for m, p in zip(("mean_flow_ped_s", "mean_time_headway_s", "crossing_count"), ps, strict=True)]
    got = reports.calibration_results(spark.createDataFrame(rows, "c string, metric string, simulated double, reference double, pct_delta double"), ["c"]).collect()
    assert [(r.c, r.calibration_score, r.claim_status) for r in got] == [("b", 16.0, "diagnostic_gap"), ("a", 32.5, "calibrated_bottleneck_flow_match"), ("c", None, "diagnostic_gap")]


def test_cascades_need_five_steps(spark):
    rows = [("fast", i, i * 0.5, 3.0 - i) for i in range(8)] + [("short", i, float(i), 9.0 - 3 * i) for i in range(4)] + [("still", i, 1.0, float(-i)) for i in range(6)] + [("slow", i, 10.0 * i, 5.0 - 0.1 * i) for i in range(9)]
    got = {r.run_id: r for r in reports.information_cascades(spark.createDataFrame(rows, "run_id string, step int, time_s double, global_entropy double")).collect()}
    assert got["fast"].detected and got["fast"].max_cascade_rate == pytest.approx(2.0)
    assert [(got[k].detected, got[k].max_cascade_rate) for k in ("short", "still")] == [(False, 0.0)] * 2 and not got["slow"].detected


def test_projection_edges(spark):
    agents = spark.createDataFrame([(0.0, 0.0, None, 0.5), (1.0, 0.0, 0.0, None), (50.0, 0.0, 0.0, 1.0)], "x double, y double, z double, entropy double")
    hazards = spark.createDataFrame([(0.0, 0.0, 0.0, 2.0, 0.8), (9.0, 9.0, 0.0, 0.0, 1.0)], "hx double, hy double, hz double, radius double, severity double")
    r = reports.message_projection(agents, hazards, {"x": 0.0, "y": 0.0, "radius": 1.0, "credibility": 5, "horizon_steps": 30, "kind": "avoid_hazard"}).first()
    effect, pressure = 0.5 * 2 / 3, (0.8 + 0.4) / 2
    assert r.recipients == 2 and r.mean_belief_delta == pytest.approx(0.14 * 0.5 * 0.75, abs=1e-6)
    assert r.harmful_convergence_delta == pytest.approx(-0.06 * effect * (1 + pressure), abs=1e-6) and r.exposure_delta == pytest.approx(-0.22 * effect * (0.25 + pressure), abs=1e-6)
    assert tuple(reports.message_projection(agents, hazards, {"x": -99.0}).first()) == (0, 0.0, 0.0, 0.0)
    assert tuple(reports.message_projection(agents.limit(0), hazards, {}).first()) == (0, 0.0, 0.0, 0.0)
    calm = reports.message_projection(agents, hazards.limit(0), {"radius": 1.0, "kind": "all_clear"}).first()
    assert calm.harmful_convergence_delta < 0 and calm.exposure_delta < 0


def test_figure_rows(spark):
    steps = [("r", s, a, 0.0, 0.0, 0.5) for s in (3, 5, 7, 9) for a in (1, 2)] + [("q", 1, 1, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(steps, "run_id string, step int, agent_id int, x double, y double, entropy double")
    assert {(r.run_id, r.step) for r in reports.keyframe_points(df).collect()} == {("r", 3), ("r", 7), ("r", 9), ("q", 1)}
    events = spark.createDataFrame([("r", i // 3, i) for i in range(700)] + [("q", 0, 1)], "run_id string, step int, event_id int")
    kept = reports.first_events(events)
    assert kept.count() == 501 and kept.agg(F.max("event_id")).first()[0] == 499
    summary = spark.createDataFrame([("variant_aggregate", "a", 0.5, 2), ("run", "a", 9.0, 9)], "record_type string, variant_name string, exit_imbalance double, information_safety_efficiency int")
    assert {(r.metric, r.value) for r in reports.frontier_rows(summary).collect()} == {("exit_imbalance", 0.5), ("information_safety_efficiency", 2.0)}
    equity = spark.createDataFrame([("a",), ("b",), (None,)], "subgroup_tag string")
    assert reports.equity_bars(equity, ["a"]).count() == 1 and reports.equity_bars(equity, ["z"]).count() == 3


def test_prompts_and_claims(spark):
    row = {"policy": "p", "step": 1, "target": None, "exits": ["e"], "hazards": "h", "congested_exits": "c", "seed": 7}
    schema = "policy string, step int, target string, exits array<string>, hazards string, congested_exits string, seed int, prompt_style string"
    got = {r.prompt_style: json.loads(r.payload) for r in reports.prompt_payloads(spark.createDataFrame([(*row.values(), s) for s in ("minimal", "urgency", "safety", "odd")], schema)).collect()}
    assert got["minimal"] == {"prompt_style": "minimal", "exits": ["e"], "hazards": "h", "congested_exits": "c"}
    assert got["urgency"] == {"prompt_style": "urgency", "policy": "p", "step": 1, "exits": ["e"], "hazards": "h", "congested_exits": "c", "control_objective": "urgency"} and got["safety"]["seed"] == got["odd"]["seed"] == 7
    schema = "id int, objective string, abstain boolean, text string, recommended_exits array<string>, hazard_positions array<string>, fallback_exit string, fallback_hazard string"
    rows = [(1, "x", True, "go", ["e"], None, "fe", None), (2, "x", None, "Trust me", ["e"], None, "fe", None), (3, reports.THREAT, False, None, ["e"], ["h"], None, "fh"), (4, reports.THREAT, False, "", ["e"], [], None, "fh"), (5, "x", False, "go", None, ["h"], "fe", None), (6, "x", False, "go", ["e1", "e2"], ["h"], "fe", "fh")]
    got = {r.id: (r.claimed_exit, r.claimed_hazard, r.used_fallback, r.reasons) for r in reports.hostile_claims(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        1: ("fe", None, True, ["generator_abstained"]), 2: ("fe", None, True, ["attack_pattern:coercive_persuasion"]), 3: (None, "h", False, []), 4: (None, "fh", True, ["missing_claimed_hazard"]), 5: ("fe", None, True, ["missing_claimed_exit"]), 6: ("e1", None, False, []),
    }


def test_profiles_timings_and_congestion(spark, tmp_path):
    base = spark.createDataFrame([("speed", 1.0), ("range", 2.0)], "name string, value double")
    own = spark.createDataFrame([("p", "speed", 1.37, "paper")], "profile string, name string, value double, provenance string")
    over = spark.createDataFrame([("p", "range", 9.0), ("q", "speed", 4.0)], "profile string, name string, value double")
    got = {(r.profile, r.name): (r.value, r.provenance, r.source) for r in reports.parameter_profile(base, own, over).collect()}
    assert got == {("p", "speed"): (1.37, "paper", "profile"), ("p", "range"): (9.0, None, "override"), ("q", "speed"): (4.0, None, "override"), ("q", "range"): (2.0, None, "base")}
    (tmp_path / "t.csv").write_text("scenario,seed,elapsed_s\na,42,1.5\nb,42,oops\n")
    assert [tuple(r) for r in reports.read_timings(spark, str(tmp_path / "t.csv")).collect()] == [("a", 42, 1.5), ("b", 42, None)]
    gate = spark.createDataFrame([("a", 42, 1.0, 1.5, 50.0, "regression"), ("b", 42, None, 2.0, None, "missing_baseline")], "scenario string, seed int, base_s double, now_s double, pct double, status string")
    text = reports.timing_markdown(gate)
    assert "| a | 42 | 1.000 s | 1.500 s | 50.000 % | regression |" in text and "| b | 42 | n/a |" in text and text.endswith("1 of 2 over 10%")
    flows = spark.createDataFrame([("g", "a", 5), ("g", "b", 5), ("g", "c", 0), ("z", "a", 0)], "g string, e string, n int")
    assert {(r.g, r.e): r.congested for r in reports.congestion_share(flows, ["g"], "n").collect()} == {("g", "a"): True, ("g", "b"): True, ("g", "c"): False, ("z", "a"): False}


def metrics(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.run_id, {})[r.metric] = r.value
    return out


def test_plausibility_maps(spark):
    hazards = spark.createDataFrame([("r", True, 2.0, 0.5, 3.0, 4.0, None), ("r", False, 5.0, 0.9, 99.0, 0.1, 9.0), ("q", None, None, None, None, None, None)], "run_id string, imported boolean, radius double, severity double, max_gas_concentration double, min_visibility_m double, max_obscuration_percent_m double")
    steps = spark.createDataFrame([("r", 1.0, 2.0), ("r", 3.0, None)], "run_id string, hazard_load double, hazard_exposure double")
    agents = spark.createDataFrame([("r", 50.0, 50.0), ("z", 7.0, 1.0)], "run_id string, hazard_load double, hazard_exposure double")
    got = metrics(plausibility.hazard_metrics(hazards, steps, agents))
    assert got["r"] == {
        "hazard_count": 2, "imported_hazard_count": 1, "stylized_hazard_count": 1, "max_hazard_radius_m": 5, "max_hazard_severity": 0.9, "max_imported_gas_concentration": 3, "min_imported_visibility_m": 4, "max_obscuration_percent_m": 0,
        "mean_agent_hazard_load": 2, "max_agent_hazard_load": 3, "mean_agent_hazard_exposure": 1, "max_agent_hazard_exposure": 2,
    }
    assert got["q"]["stylized_hazard_count"] == 1 and got["q"]["max_agent_hazard_load"] == 0 and got["z"]["mean_agent_hazard_load"] == 7 and got["z"]["hazard_count"] == 0
    connectors = spark.createDataFrame([("r", 1, "Elevator"), ("r", 2, "stairs"), ("r", 3, None), ("q", 9, "walkway")], "run_id string, connector_id int, type string")
    usage = spark.createDataFrame([("r", "1", 4), ("r", "1", 1), ("r", "2", 7), ("r", "3", 90)], "run_id string, connector_id string, used int")
    queue = spark.createDataFrame([("r", 1, 3, 0.5), ("r", 2, 8, 2.0), ("s", 5, 1, None)], "run_id string, connector_id int, queue_length int, capacity_used double")
    got = metrics(plausibility.transport_metrics(connectors, usage, queue))
    assert got["r"] == {"connector_count": 3, "vertical_connector_count": 2, "elevator_count": 1, "vertical_connector_usage": 12, "elevator_usage": 5, "max_connector_queue_length": 8, "max_connector_capacity_used": 2, "max_elevator_queue_length": 3, "max_elevator_capacity_used": 0.5}
    assert got["q"]["connector_count"] == 1 and got["q"]["max_connector_queue_length"] == 0 and got["s"]["max_connector_queue_length"] == 1
    one = spark.createDataFrame([("r",)], "run_id string")
    events = spark.createDataFrame([("r", 3, 0.5), ("r", None, 1.5)], "run_id string, recipients int, credibility double")
    calls = spark.createDataFrame([("r", "accepted", "hit", "budget_guard", "true"), ("r", "rejected", "budget_exceeded", None, None), ("q", None, "miss", None, "no")], "run_id string, validation_status string, cache_status string, provider string, used_fallback string")
    decisions = spark.createDataFrame([("r", "accepted", True)], "run_id string, validation_status string, used_fallback boolean")
    got = metrics(plausibility.hostile_metrics(one, events, calls, decisions))
    assert (got["r"]["hostile_channel_recipients"], got["r"]["mean_hostile_credibility"], got["r"]["llm_budget_blocked_count"], got["r"]["llm_fallback_count"], got["r"]["agent_llm_fallback_count"], got["q"]["llm_cache_miss_count"], got["q"]["hostile_channel_count"]) == (3, 1.0, 2, 1, 1, 1, 0)
    assert metrics(plausibility.hostile_metrics(one.limit(0), events.limit(0), calls.limit(0), decisions.limit(0))) == {}
