"""Guidance, environment and scenario rules on hand-made rows."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from egresslake.functions import environment as E
from egresslake.operators import guidance as G
from egresslake.operators import scenario as C
from egresslake.operators import state as X
from egresslake.sources import documents as D

MESSAGE = "text string, recommended array<int>, avoid array<int>, known array<int>, congested array<int>, radius double, credibility double, confidence double, abstain boolean"


def test_message_rules(spark):
    rows = [("Use the east exit one now please", [1], [2], [1, 2], [], 3.0, 0.5, 0.9, False), ("stay calm", [9, 2], [2], [1, 2], [2], 99.0, 0.9, 0.1, None), ("", [], [], [1], [], None, None, None, True)]
    df = spark.createDataFrame(rows, MESSAGE).withColumn("reasons", G.message_reasons(10.0, 0.8, 0.3))
    got = [r.reasons for r in df.collect()]
    assert got[0] == [] and got[2] == ["generator_abstained"]
    assert got[1] == ["invented_exit:9", "conflicting_exit:2", "congested_recommendation:2", "unsafe_radius:99.0", "unsafe_credibility:0.9", "vague_guidance", "low_confidence:0.10"]
    j = G.judged(df).collect()
    assert j[0].passed and not j[1].passed and math.isclose(j[2].safety, 0.3)


def test_decision_rules(spark):
    df = spark.createDataFrame([("FLY", 7, 0.9, 0.1, " ", True, False, [1], [7])], "intent string, target int, trust_delta double, confidence double, rationale string, avoid_congested boolean, abstain boolean, known array<int>, congested array<int>")
    assert df.select(G.decision_reasons(["EVACUATE"], 0.2, 0.5).alias("r")).first().r == ["unsupported_intent:FLY", "unknown_target_exit:7", "congested_target_exit:7", "unsafe_trust_delta:0.9", "low_confidence:0.10", "empty_rationale"]


def test_targets_and_schedule(spark):
    df = spark.createDataFrame([("r", 1, i, float(i % 3), 0.0) for i in range(6)], "run_id string, step int, agent_id int, local_density double, entropy double")
    assert [r.agent_id for r in G.targets(df, "density_aware", 3).orderBy("place").collect()] == [2, 5, 1]
    assert [r.id for r in spark.range(12).filter(G.fires(F.col("id"), 2, 9, 3)).collect()] == [2, 5, 8]


def test_replay_and_persona(spark):
    q = spark.createDataFrame([("a",), ("b",)], "cache_key string")
    got = {r.cache_key: (r.text, r.used_fallback) for r in G.replayed(q, spark.createDataFrame([("a", "hi")], "cache_key string, text string"), F.lit("template")).collect()}
    assert got == {"a": ("hi", False), "b": ("template", True)}
    p = spark.range(1).select(G.persona(F.lit("Family-visitor with wheelchair")).alias("p")).first().p
    assert (p.mobility_class, p.group_size, p.base_speed, p.breathing_height_m) == ("wheelchair", 2, 1.2, 1.1)
    assert [r["count"] for r in G.even_split(11, spark.range(3), "id").orderBy("id").collect()] == [4, 4, 3]


def test_environment(spark):
    r = spark.range(1).select(
        *[E.impairment(F.lit(e)).alias(f"i{k}") for k, e in enumerate((0.25, 1.0, 3.0, 9.0))], E.flood_penalty(F.lit(1.0), 0.5, 1.0, 5.0).alias("f"), E.speed_factor(F.lit(0.1), F.lit(0.0), 0.3, 0.2, 1.0).alias("s"),
        E.height_factor(F.lit(3.0), F.lit(2.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("h"), E.jammed_flow(F.lit(1.0), F.lit(4.0), F.lit(3.0), 0.25).alias("j"), E.visibility(F.lit(1.0), F.lit(2.0), F.lit(0.8), F.lit(1.0)).alias("v"),
    ).first()
    assert [round(r[f"i{k}"], 6) for k in range(4)] == [0.05, 0.25, 0.7, 1.0]
    assert (r.f, r.s, r.j) == (7.0, 0.3, 0.25) and math.isclose(r.h, math.exp(-1)) and math.isclose(r.v, 0.6)


def test_layout_audit(spark):
    def audit(text):
        cells = spark.createDataFrame([(x, 0, t) for x, t in enumerate(text)], "x int, y int, token string")
        return {(r.code, r.x) for r in C.audit_layout(cells).collect()}

    assert audit("X@..EX") == set()
    assert audit("X@X.EX") == {("start_unreachable", 1)}
    assert audit("X.X@") == {("no_exit", None), ("start_unreachable", 3), ("unreachable_walkable_cells", 1)}


def test_patch_and_paths():
    doc = {"a": {"b": [1, 2]}}
    assert C.patched(doc, [{"op": "add", "path": "/a/b/-", "value": 3}, {"op": "remove", "path": "/a/b/0"}], C.digest(doc)) == {"a": {"b": [2, 3]}}
    with pytest.raises(ValueError, match="not the one"):
        C.patched(doc, [], "x")
    assert C.set_path(doc, "a.b.1", 9) == {"a": {"b": [1, 9]}} and doc["a"]["b"] == [1, 2]
    assert C.merged_docs(doc, {"a": {"c": 1}}) == {"a": {"b": [1, 2], "c": 1}}


def test_gossip_is_order_free(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 2, 0.9), (2, 1, 0.5)], "sender_id int, receiver_id int, credibility double")
    beliefs = spark.createDataFrame([(1, 7, 1.0, 0), (3, 7, 0.5, 0), (2, 8, 1.0, 3)], "agent_id int, exit_id int, prob double, hops int")
    a, b = (sorted(X.gossip(p, beliefs, 1, 5, 2.0, 0.0).collect()) for p in (pairs, pairs.orderBy(F.desc("sender_id"))))
    assert a == b and [(r.agent_id, r.exit_id, r.prob, r.hops) for r in a] == [(2, 7, 0.9, 1)]


def test_step_loop_checkpoints(spark):
    s = X.run_steps(spark.createDataFrame([(1, 0)], "id int, v int"), lambda df, i: df.withColumn("v", F.col("v") + i), 12)
    assert s.first().v == 66


def test_documents(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("name: n\nscenario_file: f.yaml\n")
    assert D.study(str(tmp_path / "s.yaml"))["repetitions"] == 1
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("r.csv", "userId,taskId,taskCount,choice\nu,a,1,left\nu,b,2,right\nu,c_tr,3,left\n")
        z.writestr("c.csv", "userId,taskId,taskCount,confidence\nu,a,1,\"0,5\"\nu,a,1,\"0,7\"\n")
    got = D.route_choices(D.zipped_csv(spark, str(tmp_path / "z.zip"), "r.csv"), D.zipped_csv(spark, str(tmp_path / "z.zip"), "c.csv")).orderBy("taskCount").collect()
    assert [(r.taskId, r.previous, r.confidence) for r in got] == [("a", 0, 0.7), ("b", -1, None)]
    bad = json.dumps({"schema_version": 1, "suite": "v1", "policy_hash": "zz", "seed_set": [1, 1], "overall": {"mean_score": 2, "score_ci_low": 3, "score_ci_high": 4}, "scenarios": [{"scenario": "a"}]})
    assert D.submission_issues(bad, ["a", "b"]) == ["policy_hash", "seed_set", "interval_order", "missing_scenario:b"]
    assert D.event_reference(spark, '{"observations": [{"id": 1, "value": 2, "attributes": {"k": 3}}]}').first().attributes == {"k": "3"}
    rows = spark.createDataFrame([("m", 1.0, 2.0, 100.0), ("k", 1.0, 0.5, -50.0)], "metric string, baseline double, variant double, pct_change double")
    assert D.policy_brief(rows, "T").splitlines()[-1] == "| k | 1 | 0.5 | -50 % |"
