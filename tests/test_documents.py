"""Resampling, fields, archives, drawings, submissions, commits and references against brute force and by rule."""

import hashlib
import io
import json
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from egresslake.operators import calibration, fields, resampling, submissions
from egresslake.sources import archives, commits, references


def draw(b, j, n, seed=42):
    return int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) % n


def test_intervals_by_brute_force(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, 1.0, 2.0, rng.gauss(5, 2)]) if g != "one" else 3.0) for g, n in (("a", 40), ("b", 3), (None, 9)) for _ in range(n)] + [("one", 3.0), ("none", None), ("nan", float("nan"))]
    got = {r.g: r for r in resampling.intervals(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", 100).collect()}
    for g in ("a", "b", None, "one"):
        x = sorted(v for k, v in rows if k == g and v is not None)
        means = [sum(x[draw(b, j, len(x))] for j in range(len(x))) / len(x) for b in range(1, 101)]
        want = np.percentile(means, [2.5, 97.5]) if len(x) > 1 else [x[0]] * 2
        assert (got[g].n, got[g].mean) == (len(x), pytest.approx(np.mean(x)))
        assert (got[g].ci_low, got[g].ci_high) == pytest.approx(tuple(want))
    assert (got["none"].n, got["none"].mean, got["none"].ci_low) == (0, 0.0, 0.0) == (got["nan"].n, got["nan"].mean, got["nan"].ci_high)
    flat = resampling.intervals(spark.createDataFrame(rows, "g string, v double"), [], "v", 0).first()
    assert flat.ci_low == flat.mean == flat.ci_high


def test_draws_are_even_and_intervals_are_those_of_resampling():
    """Monte-Carlo error: ends of the interval lie within 0.15 standard errors of exact enumeration for five values."""
    counts = np.bincount([draw(b, j, 7) for b in range(1, 1001) for j in range(7)])
    assert abs(counts / 1000 - 1).max() < 0.1
    x = np.array([1.0, 2.0, 4.0, 7.0, 11.0])
    grid = np.array(np.meshgrid(*[x] * 5)).reshape(5, -1).mean(0)
    means = [np.mean([x[draw(b, j, 5)] for j in range(5)]) for b in range(1, 1001)]
    assert np.percentile(means, [2.5, 97.5]) == pytest.approx(np.percentile(grid, [2.5, 97.5]), abs=0.15 * x.std())


def test_large_groups_are_drawn_block_by_block(spark, monkeypatch):
    """Counts of a replicate's draws add up, the deviation of its means is that of a mean of n values, and no draw is a row."""
    n, samples = 5 * resampling.BLOCK // 2, 400
    shares = np.array([resampling._share(n, block, samples, 42) for block in range(3)])
    assert (shares.sum(axis=0) == n).all() and abs(shares.mean(axis=1) / n - [0.4, 0.4, 0.2]).max() < 0.001
    rows = spark.range(n + 30).select(F.when(F.col("id") < n, "large").otherwise("small").alias("g"), F.pmod(F.hash("id"), F.lit(1000)).cast("double").alias("v"))
    got = {r.g: r for r in resampling.replicates(rows, ["g"], "v", samples).groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.avg("mean").alias("m"), F.stddev("mean").alias("s")).collect()}
    want = rows.groupBy("g").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).filter("g = 'large'").first()
    error = want.s / n**0.5
    assert got["large"].k == got["small"].k == samples and abs(got["large"].m - want.m) < 4 * error / samples**0.5 and 0.85 < got["large"].s / error < 1.15
    again = resampling.intervals(rows.repartition(3), ["g"], "v", samples).collect()
    assert sorted(again) == sorted(resampling.intervals(rows, ["g"], "v", samples).collect())
    written = []
    monkeypatch.setattr(resampling, "cut", lambda d: written.append(d.count()) or d.localCheckpoint())
    resampling.intervals(rows, ["g"], "v", samples).collect()
    assert written and max(written) <= n + 30


def test_leaderboard(spark):
    rows = [("p", 1, "a", 10.0), ("p", 1, "b", 20.0), ("p", 2, "a", 30.0), ("p", 2, "b", 40.0)] + [("q", s, "a", float(s)) for s in range(20)] + [("q", 3, None, 3.0)]
    board = {(r.policy, r.scenario): r for r in resampling.leaderboard(spark.createDataFrame(rows, "policy string, seed int, scenario string, score double"), "policy", "seed", "score", "scenario", 200).collect()}
    top = board["p", None]
    assert (top.mean_score, top.seeds, top.seed_count, top.run_count, top.tier) == (25.0, [1, 2], 2, 4, "smoke") and 15 <= top.score_ci_low <= 25 <= top.score_ci_high <= 35
    assert set(board) == {("p", None), ("p", "a"), ("p", "b"), ("q", None), ("q", "a")} and board["p", "b"].mean_score == 30.0
    assert (board["q", None].tier, board["q", None].run_count, board["q", "a"].run_count) == ("official", 21, 20)


def test_paired_difference(spark):
    pairs = [(1.0, 2.0), (2.0, 4.0), (None, 9.0), (3.0, None)]
    got = resampling.difference_intervals(spark.createDataFrame(pairs, "b double, t double"), [], "b", "t", 50).first()
    assert (got.n, got.mean) == (2, 1.5) and 1 <= got.ci_low <= got.ci_high <= 2


RASTER = "ix int, iy int, intensity double, visibility double, visibility_m double, gas_concentration double, obscuration double"


def test_field_of_a_smoke_grid(spark):
    cells = [(x, y, 0.8 if (x, y) == (1, 1) else 0.0, 0.35 if (x, y) == (1, 1) else 1.0, None, 0.2, 5.0) for x in range(3) for y in range(3)]
    raster = spark.createDataFrame(cells, RASTER)
    points = spark.createDataFrame([(0, 1.5, 1.5, 0.0), (1, 0.5, 0.5, 0.0), (2, -0.1, 1.0, 0.0), (3, 3.0, 1.0, 0.0), (4, 2.999, 2.999, 5.0), (5, None, 1.0, 0.0)] + [(9, 1.2, 1.9, 0.0)] * 3000, "id long, x double, y double, z double")
    by = {r.id: r for r in fields.sampled_field(points, raster, fields.Field()).collect()}
    assert (by[0].intensity, by[0].visibility, by[0].visibility_m, by[9].intensity) == (0.8, 0.35, pytest.approx(10.5), 0.8)
    assert (by[1].intensity, by[1].visibility, by[1].gas_concentration, by[1].obscuration) == (0.0, 1.0, 0.2, 5.0)
    for k in (2, 3, 5):
        assert (by[k].intensity, by[k].visibility, by[k].visibility_m, by[k].gas_concentration, by[k].obscuration) == (0.0, 1.0, 30.0, 0.0, 0.0)
    assert fields.sampled_field(points, raster, fields.Field()).count() == 3006
    still = fields.sampled_field(points, raster, fields.Field(active=False, maximum_visibility_m=20.0)).agg(F.max("intensity"), F.min("visibility"), F.max("visibility_m")).first()
    assert tuple(still) == (0.0, 1.0, 20.0)
    high = fields.Field(base_z=1.0, height_aware=True, layer_base_m=0.0, layer_top_m=1.0, vertical_decay_m=2.0)
    r = {r.id: r for r in fields.sampled_field(points, raster.withColumn("visibility_m", F.lit(12.0)), high, z="z").collect()}
    share = math.exp(-3.0 / 2)  # height 4 above a layer that ends at 1
    assert (r[4].gas_concentration, r[4].visibility_m) == (pytest.approx(0.2 * share), pytest.approx(30 - 18 * share))
    assert r[0].intensity == pytest.approx(0.8 * math.exp(-1.0 / 2))
    gas = fields.Field(height_aware=True, gas_density=2.0, vertical_decay_m=4.0)
    assert {r.id: r for r in fields.sampled_field(points, raster, gas, z="z").collect()}[4].gas_concentration == pytest.approx(0.2 * math.exp(-5.0 / 4))


def test_irregular_axes_and_missing_grids(spark):
    raster = spark.createDataFrame([(x, y, float(10 * y + x)) for x in range(3) for y in range(2)], "ix int, iy int, intensity double")
    field = fields.Field(x_edges=(0.0, 1.0, 4.0, 5.0), y_edges=(-1.0, 0.0, 10.0))
    rng = np.random.default_rng(1)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 11, (200, 2)))] + [(900, 1.0, 0.0), (901, 5.0, 0.0), (902, 0.0, -1.0)]
    for r in fields.sampled_field(spark.createDataFrame(points, "id long, x double, y double"), raster, field).collect():
        x, y = np.searchsorted(field.x_edges, r.x, "right") - 1, np.searchsorted(field.y_edges, r.y, "right") - 1
        assert r.intensity == (10.0 * y + x if 0 <= x < 3 and 0 <= y < 2 else 0.0) and r.visibility == 1.0 and r.obscuration == 0.0
    with pytest.raises(ValueError):
        fields.place(F.col("x"), 0.0, 1.0, (2.0, 1.0))


def test_fields_combine_and_cost(spark):
    a = spark.createDataFrame([(1, 0.5, 0.5, 10.0, 0.1, 1.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0)], "id long, intensity double, visibility double, visibility_m double, gas_concentration double, obscuration double")
    r = {r.id: r for r in fields.combined_fields([a, a], ["id"]).collect()}
    assert (r[1].intensity, r[1].visibility, r[1].visibility_m, r[1].obscuration) == (1.0, pytest.approx(0.25), 10.0, 2.0) and r[2].visibility == 0.0
    cost = fields.route_penalty(F.col("i"), F.col("t"), F.col("d"), F.col("c"), 1.25)
    rows = spark.createDataFrame([(0.8, None, 0.0, False), (0.0, 0.5, 0.3, None), (0.0, 0.0, 0.9, False), (0.0, 0.0, 0.0, True)], "i double, t double, d double, c boolean")
    assert [r.p for r in rows.select(cost.alias("p")).collect()] == [pytest.approx(1.0), pytest.approx(1.875), pytest.approx(1.25 * 13), math.inf]


def test_thousand_archives(spark, tmp_path):
    for k in range(1000):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("in/responses.csv", "﻿userId,taskId,extra\n" + f'u{k},"1_L-WS0_R-NL1_x",5\nu{k},L-NM1_R-NM1\n')
            z.writestr("other.txt", "no")
    df = archives.archive_csv(spark, str(tmp_path), ["userId", "taskId", "extra", "absent"])
    assert df.rdd.getNumPartitions() > 1
    rows = df.collect()
    assert len(rows) == 2000 and {r.member for r in rows} == {"in/responses.csv"} and {r.line for r in rows} == {1, 2} and {r.absent for r in rows} == {None}
    assert {r.extra for r in rows if r.line == 2} == {None} and len({r.userId for r in rows}) == 1000
    f = {r.line: r for r in archives.choice_features(df.filter("userId = 'u7'")).collect()}
    assert (f[1].left_width_m, f[1].right_width_m, f[1].left_length_m, f[1].right_length_m, f[1].left_stairs, f[1].right_stairs) == (4.0, 2.0, 10.0, 20.0, 0, 1)
    assert (f[1].right_width_advantage_m, f[1].right_shortness_advantage_m, f[1].right_stairs_advantage, f[2].right_stairs_advantage) == (-2.0, -10.0, 1, 0)
    odd = spark.createDataFrame([("L-WS0_R-XX1",), (None,), ("",)], "taskId string")
    assert archives.choice_features(odd).count() == 0


def test_route_observations_from_an_archive(spark, tmp_path):
    """Choices as typed observations, and a fit on them."""
    rng = random.Random(6)
    lines, conf, want = ["userId,taskId,taskCount,AOI,time"], ["userId,taskId,taskCount,confidence"], {}
    for u in range(40):
        before = None
        for n in range(1, 11):
            task = f"{n}_L-{rng.choice('WNE')}{rng.choice('SML')}{rng.choice('01')}_R-{rng.choice('WNE')}{rng.choice('SML')}{rng.choice('01')}_v"
            right = int(rng.random() < 0.5 + 0.3 * (task.split("_R-")[1][2] > task.split("_R-")[0][-1]) - 0.3 * (task.split("_R-")[1][2] < task.split("_R-")[0][-1]))
            lines.append(f'u{u:02d},{task},{n},corridor_{"right" if right else "left"},"{1000 + n},5"')
            want[f"u{u:02d}", n] = (task, right, 0.0 if before is None else 1.0 if before else -1.0)
            before = right
        conf += [f"u{u:02d},{want[f'u{u:02d}', 3][0]},3,{k}" for k in (1, 4)]
    lines += ["u00,L-WS0_R-NL1_tr,11,corridor_left,5", "u00,L-WS0_R-NL1,x,corridor_left,5", "u00,L-WS0_R-NL1,11,floor,5", "u00,other,20,corridor_left,5", "u00,L-WS0_R-NL1,12,corridor_left,null"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("export/responses.csv", "\n".join(lines))
        z.writestr("export/confidence.csv", "\n".join(conf))
    responses = archives.archive_csv(spark, str(tmp_path), ["userId", "taskId", "taskCount", "AOI", "time"], "responses.csv")
    got = archives.route_observations(responses, archives.archive_csv(spark, str(tmp_path), ["userId", "taskId", "taskCount", "confidence"], "confidence.csv"))
    rows = {(r.user_id, r.task_count): r for r in got.collect()}
    assert {k: (r.task_id, r.choice_right, r.previous_choice_right) for k, r in rows.items()} == want
    assert all(r.trial_progress == r.task_count / 20 and r.decision_time_ms == 8000 - 1000.5 - r.task_count for r in rows.values())
    assert {r.confidence for k, r in rows.items() if k[1] == 3} == {4.0} and {r.confidence for k, r in rows.items() if k[1] != 3} == {None}
    fit = calibration.route_choice_fit(got)
    assert fit["records"]["participants"] == 40 and fit["records"]["holdout_participants"] == 8 and fit["coefficients"]["right_stairs_advantage"] > 0.5 and set(fit["priors"]) == {"familiarity", "herding", "exit_affinity"}


def test_what_is_no_archive_is_named(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="bad.zip"):
        archives.archive_rows(spark, str(tmp_path)).count()
    buffer = io.BytesIO()
    zipfile.ZipFile(buffer, "w").close()
    (tmp_path / "bad.zip").write_bytes(buffer.getvalue())
    assert archives.archive_rows(spark, str(tmp_path)).count() == 0


DXF = """0 SECTION 2 HEADER 9 $X 0 ENDSEC 0 SECTION 2 BLOCKS 0 LINE 10 9 20 9 11 8 21 8 0 ENDSEC 0 SECTION 2 ENTITIES
0 LINE 8 walls 10 0 20 0 11 4 21 3 0 CIRCLE 8 exit 10 5 20 6 40 2 0 CIRCLE 10 1 20 1 0 POINT 10 7 20 8
0 LWPOLYLINE 8 Floor 90 3 70 1 10 0 20 0 10 2 20 0 10 2 20 2 0 TEXT 10 1 20 1 1 hello
0 POLYLINE 8 rail 66 1 70 0 10 0 20 0 0 VERTEX 8 rail 10 1 20 2 0 VERTEX 10 3 20 4 0 VERTEX 10 5 0 SEQEND 0 POINT 8 late 10 9 20 9
0 POLYLINE 0 VERTEX 10 1 20 1 0 SEQEND 0 LINE 10 1 20 1 0 ENDSEC 0 EOF"""


def test_drawings(spark, tmp_path):
    words = DXF.split()
    for k in range(300):
        (tmp_path / f"d{k}.dxf").write_text("\n".join(words) + "\n")
    drawn = archives.drawings(spark, str(tmp_path))
    one = {r.entity: r for r in drawn.filter(F.col("path").endswith("/d3.dxf")).collect()}
    assert [(one[k].kind, one[k].layer) for k in range(len(one))] == [("LINE", "walls"), ("CIRCLE", "exit"), ("POINT", "0"), ("LWPOLYLINE", "Floor"), ("POLYLINE", "rail"), ("POINT", "late")]
    assert (one[0].xs, one[0].ys, one[1].radius, one[3].closed, one[3].xs) == ([0.0, 4.0], [0.0, 3.0], 2.0, True, [0.0, 2.0, 2.0])
    assert (one[4].xs, one[4].ys, one[4].closed, one[4].radius) == ([1.0, 3.0], [2.0, 4.0], False, None)
    assert drawn.count() == 1800
    role = archives.roles(drawn.filter(F.col("path").endswith("/d3.dxf")), {"exit": ["EXIT"], "walkable": ["floor"]})
    assert {r.layer: r.role for r in role.collect()} == {"walls": "obstacle", "exit": "exit", "0": "obstacle", "Floor": "walkable", "rail": "obstacle", "late": "obstacle"}
    box = archives.extents(drawn).first()
    assert (box.min_x, box.min_y, box.max_x, box.max_y) == (0.0, 0.0, 9.0, 9.0)
    (tmp_path / "half.dxf").write_text("0\nSECTION\n2\n")
    with pytest.raises(Exception, match="half.dxf"):
        archives.drawings(spark, str(tmp_path)).count()


def submission(**other):
    suite = submissions.suites()["v1"]
    block = {"mean_score": 50.0, "score_ci_low": 49, "score_ci_high": 51.5, "run_count": 2}
    doc = {
        "schema_version": "s-1", "suite": "v1", "submitter": "someone", "policy_hash": "b89108b3ba529d21", "config_hash": submissions.content_hash(suite.document()), "env_version": {"python": "3", "platform": "linux"},
        "seed_set": [42, 137], "overall": {**block, "tier": "smoke"}, "scenarios": [{"scenario": n, **block, "seeds_used": [137, 42]} for n, _ in suite.scenarios],
    }
    return {k: v for k, v in {**doc, **other}.items() if v is not ...}


def issues_of(spark, docs):
    rows = [(k, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in docs.items()]
    got = submissions.submission_issues(spark.createDataFrame(rows, "submission_id string, payload string"), schema_version="s-1").collect()
    out = {k: set() for k in docs}
    for r in got:
        out[r.submission_id].add((r.path, r.message))
    return out


def test_suites(spark):
    # Fixed value: the published hash of the first suite's configuration.
    assert submissions.content_hash(submissions.suites()["v1"].document()) == "135cfcafb2f1a219"
    t = submissions.suite_table(spark)
    assert {r.suite: r["count"] for r in t.groupBy("suite").count().collect()} == {"v1": 6, "v2": 2, "v3": 2}


def test_submissions(spark):
    good, block = submission(), submission()["overall"]
    first = good["scenarios"][0]
    found = issues_of(spark, {
        "good": good, "more": submission(notes="x", command="y"), "text": "no json", "null": None, "list": "[]", "number": "3", "empty": {}, "hash": submission(policy_hash=...), "short": submission(scenarios=good["scenarios"][:-1]),
        "extra": submission(zzz=1), "suite": submission(suite="v7"), "suitetype": submission(suite=["v1"]), "config": submission(config_hash="0" * 16), "seeds": submission(seed_set=[]), "seedtype": submission(seed_set=[1, True]), "twice": submission(seed_set=[42, 42]),
        "env": submission(env_version={"python": ""}), "order": submission(overall={**block, "score_ci_low": 60}), "tier": submission(overall={**block, "tier": "gold"}), "runs": submission(overall={**block, "run_count": 0}), "nan": submission(overall={**block, "mean_score": "50"}),
        "claims": submission(overall={**block, "claim_tier": "best", "claim_limitations": [1], "validation_evidence": []}), "fine": submission(overall={**block, "claim_tier": "diagnostic", "claim_limitations": ["a"], "validation_evidence": {}}),
        "scenario": submission(scenarios=[*good["scenarios"][:-1], 5]), "double": submission(scenarios=[*good["scenarios"], first]), "used": submission(scenarios=[{**first, "seeds_used": [42]}, *good["scenarios"][1:]]), "version": submission(schema_version="s-2"),
    })
    for k in ("good", "more", "fine"):
        assert found[k] == set()
    for k in ("text", "null", "list", "number"):
        assert found[k] == {("$", "submission must be a JSON object")}
    assert {p for p, m in found["empty"] if m == "required field missing"} == {f"$.{k}" for k in submissions.REQUIRED}
    paths = {k: {p for p, _ in v} for k, v in found.items()}
    assert paths["hash"] == {"$.policy_hash"} and paths["extra"] == {"$.zzz"} and paths["version"] == {"$.schema_version"}
    assert found["short"] == {("$.scenarios", "must match suite scenarios: missing mixed_indoor_outdoor_arena; extra ")}
    assert paths["suite"] == paths["suitetype"] == {"$.suite"} and paths["config"] == {"$.config_hash"}
    assert "$.seed_set" in paths["seeds"] and paths["seedtype"] >= {"$.seed_set"} and "$.seed_set" in paths["twice"]
    assert paths["env"] == {"$.env_version.python", "$.env_version.platform"} and paths["order"] == {"$.overall"} and paths["tier"] == {"$.overall.tier"}
    assert paths["runs"] == {"$.overall.run_count"} and paths["nan"] == {"$.overall.mean_score"} and paths["claims"] == {"$.overall.claim_tier", "$.overall.claim_limitations", "$.overall.validation_evidence"}
    assert paths["scenario"] == {"$.scenarios[5]", "$.scenarios"} and ("$.scenarios", "scenario names must be unique") in found["double"] and paths["used"] == {"$.scenarios[0].seeds_used"}


def test_hash_drift_and_outputs(spark, tmp_path):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {r.path: r.status for r in submissions.hash_drift(a, b).collect()} == {"a": "same", "b": "changed", "c": "missing", "d": "undocumented"}
    runs = spark.createDataFrame([("p", 1, 5.0), ("p", 2, 7.0)], "policy string, seed int, score double")
    board = resampling.leaderboard(runs, "policy", "seed", "score", samples=20)
    suite = submissions.suites()["v2"]
    submissions.write_benchmark(runs, board, str(tmp_path / "out"), suite, "ab" * 8, "2026-01-01T00:00:00Z", "1")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/benchmark_runs.csv")).count() == 2
    assert spark.read.json(str(tmp_path / "out/leaderboard.json")).first().mean_score == 6.0
    manifest = json.loads(spark.read.text(str(tmp_path / "out/reproducibility_manifest.json")).first().value)
    assert manifest["config_hash"] == submissions.content_hash(suite.document()) and manifest["scenarios"] == ["wildfire_wui", "transit_shooter"]
    submissions.write_suite_documents(str(tmp_path / "suites"), spark)
    assert {r.suite for r in spark.read.text(str(tmp_path / "suites")).collect()} == {"v1", "v2", "v3"}


class Killed(Exception):
    pass


def killer(step):
    def after(done):
        if done == step:
            raise Killed(done)

    return after


@pytest.mark.parametrize("step", ["agents", "steps", "manifest", "renamed"])
def test_a_study_goes_on_after_a_kill(spark, tmp_path, step):
    root, planned, made = str(tmp_path), [(k, f"run-{k}") for k in range(3)], []

    def make(index, run_id):
        made.append(index)
        return {"steps": spark.range(5 + index).withColumn("run_id", F.lit(run_id)), "agents": spark.range(index)}

    assert commits.committed(spark, root).count() == 0
    with pytest.raises(Killed):
        commits.run_study(planned, make, root, spark, killer(step))
    kept = int(step == "renamed")  # only a renamed folder counts
    assert commits.committed(spark, root).count() == kept
    assert commits.run_study(planned, make, root, spark) == 3 - kept
    assert made == [0, *range(kept, 3)] and commits.run_study(planned, make, root, spark) == 0
    steps = commits.load_table(spark, root, "steps")
    assert steps.count() == 5 + 6 + 7 and {(r.run_index, r.run_id) for r in steps.select("run_index", "run_id").distinct().collect()} == set(planned)
    assert commits.load_table(spark, root, "agents", "id long").count() == 3
    assert not list((tmp_path / "runs").glob(".*.tmp"))
    assert commits.commit_run(make(0, "again"), root, 0, "again") is False and commits.load_table(spark, root, "steps").count() == 18
    with pytest.raises(ValueError):
        commits.load_table(spark, root, "none")


def test_rows_that_are_not_as_many_as_the_manifest_says(spark, tmp_path):
    commits.commit_run({"t": spark.range(4)}, str(tmp_path), 7, "r")
    spark.range(2).write.mode("append").parquet(f"{commits.run_folder(str(tmp_path), 7)}/t.parquet")
    with pytest.raises(ValueError, match="7"):
        commits.load_table(spark, str(tmp_path), "t")


PROVENANCE = {"source": "drill report", "license": "CC0", "timestamp": "2024-05-01", "station": "S", "scenario_assumptions": ["a", "b"], "known_missing_data": "none"}


def reference(**other):
    doc = {"reference_id": "ref-1", "reference_type": "Drill", "provenance": PROVENANCE, "observations": [{"event_id": "e1", "label": "start", "time_s": "1.5", "location": [1, 2], "agent_count": 3, "attributes": {"speed": 1.25, "ok": True, "n": 4, "note": "x"}}, {"label": "end", "attributes": {"n": 5, "speed": "2"}}]}
    return {**doc, **other}


def test_event_references(spark, tmp_path):
    import yaml

    docs = {
        "good.yaml": reference(), "more.json": reference(reference_id="ref-2", observations=[{"label": "only"}]), "id.yaml": reference(reference_id=""), "kind.yaml": reference(reference_type="film"),
        "prov.yml": reference(provenance={"source": "x"}), "noprov.yaml": reference(provenance=None), "none.yaml": reference(observations=[]), "label.yaml": reference(observations=[{"event_id": "z"}, 5, {"label": "a", "location": [1]}, {"label": "b", "time_s": "soon"}]), "list.yaml": [1],
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc) if name.endswith("json") else yaml.safe_dump(doc))
    (tmp_path / "broken.yaml").write_text("a: [1")
    got = references.event_documents(spark, str(tmp_path))
    issues = {}
    for r in references.document_issues(got).collect():
        issues.setdefault(r.path.rsplit("/", 1)[1], []).append(r.issue)
    assert set(issues) == set(docs) - {"good.yaml", "more.json"} | {"broken.yaml"}
    assert issues["id.yaml"] == ["reference_id: missing"] and issues["kind.yaml"][0].startswith("reference_type") and len(issues["prov.yml"]) == 5 and issues["noprov.yaml"] == ["provenance: must be a mapping"]
    assert issues["none.yaml"] == ["observations: at least one is needed"] and issues["list.yaml"] == ["document: must be a mapping"] and issues["broken.yaml"][0].startswith("document:")
    assert issues["label.yaml"] == ["observations[1].label: missing", "observations[2]: must be a mapping", "observations[3].location: must be two numbers", "observations[4].time_s: no number"]
    rows = references.widened(references.observations(got), "attributes")
    assert [c for c in rows.columns if c.startswith("attribute_")] == ["attribute_n", "attribute_note", "attribute_ok", "attribute_speed"]
    assert {c: t for c, t in rows.dtypes if c.startswith("attribute_")} == {"attribute_n": "bigint", "attribute_note": "string", "attribute_ok": "boolean", "attribute_speed": "double"}
    by = {(r.reference_id, r.event_id): r for r in rows.collect()}
    e = by["ref-1", "e1"]
    assert (e.reference_type, e.label, e.time_s, e.x, e.y, e.agent_count, e.attribute_speed, e.attribute_ok, e.attribute_n) == ("drill", "start", 1.5, 1.0, 2.0, 3, 1.25, True, 4)
    assert by["ref-1", "event_2"].attribute_note is None and by["ref-2", "event_1"].attribute_n is None
    p = {r.reference_id: r for r in references.provenance(got).collect()}
    assert p["ref-1"].scenario_assumptions == "a; b" and p["ref-2"].notes == ""


def test_widened_edges(spark):
    df = spark.createDataFrame([(1, {"a": "1", "b": None}), (2, {}), (3, None), (4, {"a": "99999999999999999999"})], "id long, m map<string,string>")
    out = references.widened(df, "m", "")
    assert dict(out.dtypes) == {"id": "bigint", "a": "double", "b": "string"} or dict(out.dtypes)["a"] == "double"
    assert out.count() == 4
    with pytest.raises(ValueError):
        references.widened(df, "m", most=1)


def test_natural_join(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "k", "y"), (3, "k", "z")], "id long, c string, l string")
    b = spark.createDataFrame([(1, None, 10), (2, "j", 20), (3, "k", 30), (3, "k", 31)], "id int, c string, r int")
    assert sorted(map(tuple, references.natural_join(a, b).collect()), key=repr) == sorted([(1, None, "x", 10), (2, "k", "y", None), (3, "k", "z", 30), (3, "k", "z", 31)], key=repr)
    assert references.natural_join(a, b, "inner").count() == 3 and references.natural_join(a, b, "full").filter("id = 2").count() == 2
    assert references.natural_join(a, b.withColumn("id", F.col("id").cast("string")), "inner").count() == 3
    with pytest.raises(ValueError):
        references.natural_join(a, b.select("r"))
    with pytest.raises(ValueError):
        references.natural_join(a, b, "cross")


def test_station_provenance(spark):
    full = {k: "v" for k in references.STATION} | {"manual_edits": ["a"], "known_missing_indoor_topology": ["b"], "validation_use": "Not for validation", "osm_objects": ["way/1"]}
    rows = [("ok", full), ("plain", {**full, "validation_use": "proof"}), ("lists", {**full, "manual_edits": "a"}), ("sources", {**full, "osm_objects": []}), ("missing", {k: v for k, v in full.items() if k not in ("license", "level")}), ("text", [1])]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [("none", None)], "id string, p string")
    got = {}
    for r in references.station_issues(df, "id", "p").collect():
        got.setdefault(r.id, []).append(r.issue)
    assert "ok" not in got and got["plain"] == ["limits of validation must be stated"] and got["lists"] == ["must be a list: manual_edits"] and got["text"] == ["must be a mapping"] and got["none"] == ["provenance is missing"]
    assert got["sources"] == ["one of gtfs_feeds, osm_objects, source_files is needed"] and got["missing"] == ["missing: level", "missing: license"]
    some = references.station_issues(df.withColumn("report", F.col("id") == "plain"), "id", "p", "report")
    assert {r.id for r in some.collect()} == {"plain", "lists", "sources", "missing", "text"}
