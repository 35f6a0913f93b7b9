"""Readers, writers and small tables by round trips and by rule."""

import hashlib
import json
import math

import pytest

from egresslake.operators import comparison, figures, rasters, reports, trajectory
from egresslake.sources import bundle, documents, files, sinks


def test_trajectory_table_from_each_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 1.5, 2.5), (1, 0.5, 2.0, 2.5)], "agent_id long, time_s double, x double, y double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    df.write.option("header", True).csv(str(tmp_path / "t.csv"))
    df.write.parquet(str(tmp_path / "b/tables/agent_steps.parquet"))
    for name in ("t.parquet", "t.csv", "b"):
        got = files.trajectory_table(spark, str(tmp_path / name))
        assert sorted(tuple(r) for r in got.select("agent_id", "time_s", "x", "y").collect()) == [(1, 0.0, 1.5, 2.5), (1, 0.5, 2.0, 2.5)]
    with pytest.raises(ValueError):
        files.trajectory_table(spark, str(tmp_path / "none"))


def test_flow_curve_and_report(spark, tmp_path):
    (tmp_path / "f.csv").write_text("width_m,specific_flow_ped_m_s\n1.0,1.9\n0.8,1.8\n")
    ref = files.specific_flow(spark, str(tmp_path / "f.csv"))
    assert [r.width_m for r in ref.collect()] == [0.8, 1.0]
    events = spark.createDataFrame([(w, float(t)) for w, n in ((0.8, 4), (1.0, 5)) for t in range(n)], "width_m double, time_s double")
    curves = figures.flow_curve_error(figures.specific_flow(events), ref)
    want = math.sqrt(((4 / 3 / 0.8 - 1.8) ** 2 + (5 / 4 / 1.0 - 1.9) ** 2) / 2)
    verdict = sinks.write_flow_report(curves, str(tmp_path / "out"), 0.5)
    assert verdict["rmse_specific_flow_ped_m_s"] == pytest.approx(want) and verdict["ok"] == (want <= 0.5) and verdict["widths"] == 2
    assert json.loads(spark.read.text(str(tmp_path / "out/specific_flow_summary.json")).first().value)["threshold"] == 0.5
    (tmp_path / "bad.csv").write_text("width_m\n1\n")
    with pytest.raises(ValueError):
        files.specific_flow(spark, str(tmp_path / "bad.csv"))


def test_ridership(spark, tmp_path):
    (tmp_path / "r.csv").write_text("transit_timestamp,station_complex,ridership\n2024-12-31T01:00:00.000,S,5\n2024-12-31T00:00:00.000,S,2\n2024-12-31T00:00:00.000,S,3\n2024-12-31T00:00:00.000,T,9\n")
    assert [r.ridership for r in files.ridership(spark, str(tmp_path / "r.csv"), "S").collect()] == [5.0, 5.0]
    (tmp_path / "r.json").write_text(json.dumps([{"transit_timestamp": "2024-12-31T00:00:00.000", "station_complex": "S", "sum_ridership": "7"}]))
    assert files.ridership(spark, str(tmp_path / "r.json")).first().ridership == 7.0
    (tmp_path / "n.csv").write_text("transit_timestamp,station_complex,ridership\n2024-12-31T01:00:00.000,S,-5\n")
    with pytest.raises(Exception, match="negative"):
        files.ridership(spark, str(tmp_path / "n.csv")).collect()


def test_geojson_of_each_form(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"level": "1;2", "role": "wall"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    for name, doc, n in (("c", {"type": "FeatureCollection", "features": [feature, feature]}, 2), ("f", feature, 1), ("g", feature["geometry"], 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        got = files.geojson_features(spark, str(tmp_path / f"{name}.json")).collect()
        assert len(got) == n and {(r.kind, json.loads(r.coordinates)[1]) for r in got} == {("Point", 2)}
        assert list(got[0].levels) == ([0] if name == "g" else [1, 2])
    (tmp_path / "x.json").write_text(json.dumps({"type": "Sphere", "coordinates": [1]}))
    with pytest.raises(Exception, match="Sphere"):
        files.geojson_features(spark, str(tmp_path / "x.json")).collect()


def test_saved_map_answer(spark, tmp_path):
    node = [{"type": "node", "id": k, "lat": 10.0 + k / 1e4, "lon": 20.0 + (k % 2) / 1e4} for k in range(4)]
    ways = [{"type": "way", "id": 9, "nodes": [0, 1, 2, 0], "tags": {"building": "yes"}}, {"type": "way", "id": 8, "nodes": [0, 3]}, {"type": "way", "id": 7, "nodes": [1]}]
    (tmp_path / "o.json").write_text(json.dumps({"elements": node + ways}))
    got = {r.id: r for r in files.overpass(spark, str(tmp_path / "o.json")).collect()}
    assert set(got) == {8, 9} and got[9].kind == "Polygon" and got[8].kind == "LineString" and got[9].tags == {"building": "yes"} and got[8].points[0] == [0.0, 0.0]


def test_population_cache(spark, tmp_path):
    record = {"cache_key": "k", "request": {"scenario_name": "s", "allowed_targets": ["a", "b"]}, "calibration": {"provider": "p", "confidence": 0.5, "raw_response": {"response": {"usage": {"prompt_tokens": 7, "completion_tokens": 2}}}}, "validation": {"accepted": False, "reasons": ["x", "y"]}, "application": {"skipped": ["z"]}}
    for name, doc in (("one", record), ("two", {k: v for k, v in record.items() if k != "cache_key"}), ("no", {"calibration": {}}), ("other", {"message": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.json").write_text(json.dumps(doc))
    got = {r.cache_key: r for r in files.population_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"k", "two"} and (got["k"].validation_status, got["k"].validation_reasons, got["k"].input_tokens, got["k"].output_tokens, got["k"].skipped_overwrite_attempts, got["k"].allowed_targets) == ("rejected", "x;y", 7, 2, "z", "a;b")


def test_hashes_against_a_document(spark, tmp_path):
    root = tmp_path / "root"
    (root / "in").mkdir(parents=True)
    for name in ("a.txt", "in/b.txt", "c.txt"):
        (root / name).write_text(name)
    good = hashlib.sha256(b"a.txt").hexdigest()
    (tmp_path / "doc.md").write_text(f"# kit\n\n    {good}  a.txt\n{'0' * 64}  in/b.txt\n{'1' * 64}  gone.txt\nnot a line {good}\n")
    got = {r.path: r.status for r in files.hash_audit(spark, str(tmp_path / "doc.md"), str(root)).collect()}
    assert got == {"a.txt": "same", "in/b.txt": "changed", "gone.txt": "missing", "c.txt": "undocumented"}
    assert [r.file for r in files.documented_hashes(spark, str(tmp_path / "doc.md")).collect()][:1] == ["a.txt"]


def test_writers_of_other_tools(spark, tmp_path):
    df = spark.createDataFrame([(2, 0.25, 1.0, 2.0), (1, 0.05, 3.0, 4.0)], "agent_id long, time_s double, x double, y double")
    sinks.write_jupedsim(df, str(tmp_path / "j"))
    got = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "j"))
    assert got.columns == ["id", "frame", "x", "y", "z"] and [(r.id, r.frame, r.z) for r in got.collect()] == [("1", "0", "0.0"), ("2", "2", "0.0")]
    sinks.write_vadere(df, str(tmp_path / "v"))
    got = spark.read.option("header", True).csv(str(tmp_path / "v"))
    assert got.columns == ["timeStep", "pedestrianId", "simTime", "x", "y"] and got.count() == 2
    sinks.write_pedpy(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["pedestrian_id", "frame", "time_s", "x", "y"]
    traced = sinks.exploded_traces(spark.createDataFrame([(1, [[0.0, 1.0], [2.0, 3.0]])], "agent_id int, trace array<array<double>>")).collect()
    assert [(r["index"], r.x, r.y) for r in traced] == [(0, 0.0, 1.0), (1, 2.0, 3.0)]


def test_steps_and_frames_hold_no_odd_numbers(spark, tmp_path):
    steps = spark.createDataFrame([("r", s, a, float("nan") if a else 1.0, float("inf"), None) for s in range(25) for a in (0, 1)], "run_id string, step int, agent_id int, x double, y double, speed double")
    sinks.write_steps(steps, str(tmp_path / "s"))
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert len(rows) == 50 and all(r["y"] is None and r["speed"] is None for r in rows) and {r["x"] for r in rows} == {None, 1.0}
    frames = sinks.viewer_frames(steps, 10).collect()
    assert len(frames) <= 10 and {0, 24} <= {f.step for f in frames} and "NaN" not in frames[0].agents


def test_comparison_export_and_documents(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1.0, 2.0), ("a", 3.0, 4.0)], "metric string, baseline double, variant double")
    sinks.export_comparison(rows, str(tmp_path), "x", "y")
    assert [r.metric for r in spark.read.option("header", True).csv(str(tmp_path / "comparison.csv")).collect()] == ["a", "b"] and spark.read.parquet(str(tmp_path / "comparison.parquet")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "comparison.json")).first().value) == {"baseline": "x", "metrics": 2, "variant": "y"}
    sinks.write_document(spark, {"b": 1, "a": [2]}, str(tmp_path / "d"))
    assert spark.read.text(str(tmp_path / "d")).first().value == '{"a": [2], "b": 1}'


def test_records_are_kept_by_key(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", "p") for i in range(600)], "cache_key string, provider string")
    documents.store_records(df, str(tmp_path / "c"))
    documents.store_records(df.limit(3), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).count() == 603 and len(list((tmp_path / "c").glob("part=*"))) <= 256


def test_unions_seeds_and_picks(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2, 0.5)], "i int, d double")
    assert sorted((r.i, r.s, r.d) for r in bundle.concat([a, b]).collect()) == [(1, "x", None), (2, None, 0.5)]
    assert sorted((r.i, r.series) for r in reports.labelled_union({"p": a, "q": b}).collect()) == [(1, "p"), (2, "q")]
    assert (bundle.resolve_seeds([5], [6], 2), bundle.resolve_seeds(None, [6], 2), bundle.resolve_seeds([], None, 2)) == ([5], [6], [42, 43])
    rows = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    assert comparison.representative_run(rows, "r2").first().n == 2 and comparison.representative_run(rows, None).count() == 2
    assert comparison.available(rows, ["zz", "n", "run_id"]).columns == ["n", "run_id"]


def test_replan_reasons_in_order(spark):
    schema = "agent_id int, time_s double, path_blocked boolean, topology_revision int, navigation_topology_revision int, visibility double, flood_depth_m double, hazard_load double, belief_step int, navigation_belief_step int"
    quiet = (False, 1, 1, 1.0, 0.0, 0.0, 1, 1)
    rows = [(1, 0.0, *quiet), (1, 1.0, True, 2, 1, 0.1, 1.0, 1.0, 2, 1), (1, 2.0, False, 2, 1, 0.1, 1.0, 1.0, 1, 1), (1, 3.0, None, 2, -1, 0.1, 1.25, 1.0, 1, -1), (2, 0.0, False, 1, 1, 0.6, 0.5, 0.5, 1, 1), (2, 1.0, False, 1, 1, 0.6, 0.5, 0.85, 1, 1), (2, 2.0, False, 1, 1, 0.6, 0.5, 0.85, 5, 1), (2, 3.0, False, 1, 1, 0.6, 0.5, 0.85, 5, -1)]
    got = [r.reason for r in trajectory.replan_reasons(spark.createDataFrame(rows, schema)).orderBy("agent_id", "time_s").collect()]
    assert got == [None, "blocked_path", "topology_changed", "flood_depth_rise", "visibility_drop", "hazard_spike", "belief_update", None]
    assert trajectory.replan_reasons(spark.createDataFrame([(1, 0.0)], "agent_id int, time_s double")).first().reason is None


def test_generation_report_of_bare_rows(spark):
    got = reports.generation_report(spark.createDataFrame([("v", None, None, 2)], "variant_name string, generation_provider string, generation_model string, recipients int")).first()
    assert (got.events, got.recipients, got.cache_hits, got.recommendation_diversity, got.raw_congested_recommendations, got.mean_generated_confidence, got.mean_entropy_delta) == (1, 2, 0, 0, 0, 0.0, None)


def test_hazard_lists_and_heights(spark):
    rows = spark.createDataFrame([(1, '{"hazards": [{}, [], null, 4]}'), (2, '{"hazards": null}'), (3, None), (4, "odd"), (5, '{"hazards": "x"}')], "id int, p string")
    assert sorted((r.id, r.source) for r in reports.hazard_config_issues(rows, "id", "p").collect()) == [(1, "hazards[1]"), (1, "hazards[2]"), (1, "hazards[3]"), (5, "hazards")]
    features = spark.createDataFrame([(["0", "2"], {"height": "1.5"}), (["2"], {"height": "9"}), (["mezzanine"], {}), (["-1"], {})], "levels array<string>, properties map<string,string>")
    assert {r.floor_id: r.z for r in rasters.level_heights(features).collect()} == {"-1": -3.0, "0": 1.5, "2": 1.5, "mezzanine": 9.0}
    cells = spark.createDataFrame([("a", x, y, "X" if x == 0 else "E" if (x, y) == (1, 1) else ".") for x in range(3) for y in range(2)], "floor_id string, x int, y int, token string")
    got = reports.floor_tokens(cells, {"exits": "E"}).first()
    assert (got.width, got.height, got.cells, got.walkable, got.exits) == (3, 2, 6, 4, 1)
    totals = reports.issue_totals(spark.createDataFrame([("error", "a"), ("warning", "b"), ("error", "a")], "severity string, code string")).first()
    assert (totals.issues, totals.errors, totals.warnings, totals.codes) == (3, 2, 1, 2)


def test_eleven_metrics_compare(spark):
    df = spark.createDataFrame([("a", 1, t * 1.0, t * 1.0, 0.0, 0.5) for t in range(5)] + [("b", 2, t * 1.0, t * 2.0, 0.0, 1.0) for t in range(5)], "variant_name string, agent_id int, time_s double, x double, y double, local_density double")
    got = {(r.variant_name, r.metric): r for r in trajectory.compare_trajectories(df, df.filter("variant_name = 'a'"), metrics=trajectory.SUMMARY).collect()}
    assert len(got) == 22 and got["b", "mean_speed_mps"].pct_delta == pytest.approx(100.0) and got["b", "p95_local_density"].delta == 0.5 and got["a", "agent_count"].delta == 0
    bare = trajectory.trajectory_summary(df.drop("local_density"), ("variant_name",)).collect()
    assert {r.p95_local_density for r in bare} == {None}
