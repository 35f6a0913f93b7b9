"""Hand-computed cases of comparisons, layouts, steps, chains and sources."""

import json

import pytest
from pyspark.sql import functions as F

from egresslake.operators import audits, comparison, graph, movement, rasters, routing
from egresslake.operators.run_summary import run_summary
from egresslake.operators.spatial import line_of_sight
from egresslake.schemas import TABLES, empty
from egresslake.sources import files
from egresslake.sources.bundle import StudyBundle


def test_variants_ignore_aggregates(spark):
    rows = [("run", "base", 1, 10.0), ("run", "base", 2, 12.0), ("run", "test", 1, 8.0), ("run", "test", 2, 9.0), ("variant_aggregate", "base", None, 999.0), ("study_aggregate", "test", None, -999.0)]
    s = spark.createDataFrame(rows, "record_type string, variant_name string, seed int, mean_travel_time_s double")
    r = comparison.compare_variants(s, "base", "test", ["mean_travel_time_s", "not_there"], samples=100).collect()
    assert len(r) == 1 and (r[0].baseline_mean, r[0].test_mean, r[0].n_baseline, r[0].n_test) == (11.0, 8.5, 2, 2)
    assert r[0].diff_absolute == -2.5 and r[0].cohens_d < 0 and r[0].supports_test and r[0].better_direction == "lower" and r[0].n_paired == 2
    assert r[0].baseline_ci_lower <= 11 <= r[0].baseline_ci_upper


def test_flow_rows(spark):
    def flow(mean):
        return spark.createDataFrame([(2, 1.0, 2.0, mean, 1.0)], "crossing_count int, first_crossing_s double, last_crossing_s double, mean_flow_ped_s double, mean_time_headway_s double")

    rows = {r.metric: r for r in comparison.flow_comparison(flow(1.0), flow(2.0)).collect()}
    assert rows["mean_flow_ped_s"].delta == -1.0 and rows["mean_flow_ped_s"].pct_delta == -50.0 and len(rows) == 5


def test_summary_of_a_run_without_events(spark):
    agents = spark.createDataFrame([("r", 1, "a", "m", True, 10.0, 0.5, 0.1, "west", False, False, False, False), ("r", 2, "a", "m", False, None, 0.25, 0.9, None, True, True, False, False)],
                                   "run_id string, agent_id long, cohort_name string, mobility_class string, evacuated boolean, travel_time_s double, hazard_exposure double, hazard_risk double, evacuated_via string, pending boolean, incapacitated boolean, is_responder boolean, is_hostile boolean")
    none = {
        "exits": "run_id string, exit_label string, flow_cumulative long", "steps": "run_id string, step int, time_s double, mean_density double, global_entropy double", "agent_steps": "run_id string, time_s double, speed double, local_density double, decision_mode string",
        "cells": "run_id string, occupancy long", "bottlenecks": "run_id string, zone_id string, queue_length long, outflow long", "hostile": "run_id string, recipients long, credibility double", "shots": "run_id string, accuracy double",
        "interventions": "run_id string, recipients long, entropy_before double, entropy_after double, accuracy_before double, accuracy_after double, mean_hazard_load double, peak_queue_length long",
    }
    r = run_summary({"agents": agents, **{k: spark.createDataFrame([], v) for k, v in none.items()}}).collect()
    assert len(r) == 1 and len(r[0]) == 51
    assert (r[0].agents_total, r[0].agents_evacuated, r[0].agents_pending_release, r[0].agents_incapacitated) == (2, 1, 1, 1)
    assert r[0].dominant_exit == "n/a" and r[0].harmful_convergence_index == 0 and r[0].mean_travel_time_s == 10.0 and r[0].mean_hazard_exposure == 0.375 and r[0].left_behind_index == 0


def test_sight(spark):
    pairs = spark.createDataFrame([("thin", 0.5, 0.5, 40.5, 0.5), ("free", 0.5, 1.5, 40.5, 1.5), ("end", 0.5, 2.5, 3.5, 2.5), ("far", 0.5, 3.5, 90.0, 3.5)], "pair_id string, ax double, ay double, bx double, by double")
    walls = spark.createDataFrame([(17, 0), (0, 2)], "x int, y int")
    assert {r.pair_id: r.clear for r in line_of_sight(pairs, walls, 50.0).collect()} == {"thin": False, "free": True, "end": True, "far": False}


def test_steps_keep_everybody(spark):
    cells = spark.range(50).select((F.col("id") % 10).cast("int").alias("x"), F.floor(F.col("id") / 10).cast("int").alias("y"), F.lit(True).alias("walkable"))
    exits = spark.createDataFrame([(7, 0, 2)], "exit_id long, x int, y int")
    routes = graph.shortest(graph.edges(cells), exits).select("x", "y", "nx", "ny")
    agents = spark.createDataFrame([(i, 1.5 + i % 8, 0.5 + i % 5, i % 3, False, None, 0, 0.0, 1.25) for i in range(20)], "agent_id long, x double, y double, release_step int, evacuated boolean, evacuated_via long, travel_steps int, exposure double, free_speed double")
    hazards = spark.createDataFrame([(9.0, 2.5, 3.0, 1.0)], "hx double, hy double, radius double, severity double")
    out = movement.simulate(agents, routes, exits, hazards, {0: exits.select("x", "y").filter("false")}, 28, 0.5, every=4).collect()
    assert sorted(r.agent_id for r in out) == list(range(20)) and all(r.evacuated and r.evacuated_via == 7 for r in out)
    assert all(0 <= r.x <= 10 and r.exposure >= 0 and r.travel_steps <= 28 for r in out) and any(r.exposure > 0 for r in out)
    shut = movement.simulate(agents, routes, exits, hazards, {0: exits.select("x", "y")}, 6, 0.5, every=3).collect()
    assert not any(r.evacuated for r in shut) and len(shut) == 20


def test_planner_keeps_and_passes_on(spark):
    g = graph.grid(spark, 7, 5)
    starts = spark.createDataFrame([(1, 0, 0), (2, 6, 0)], "start_id long, x int, y int")
    goals = spark.createDataFrame([(6, 4)], "x int, y int")
    p = routing.Planner("unknown", "hops")
    e = graph.edges(g)
    first = {r.start_id: r.cost for r in p.costs(e, starts, goals).collect()}
    assert p.strategy == "shortest" and first == {r.start_id: r.cost for r in p.costs(e, starts, goals).collect()}
    assert p.counts["asked"] == 2 and p.counts["kept"] == 1
    a = {r.start_id: r.cost for r in routing.astar(e, starts, goals).collect()}
    assert a == first and first[1] >= 10 and first[2] >= 4


FEATURES = {
    "type": "FeatureCollection",
    "features": [
        {"properties": {"role": "walkable", "level": "0", "repeat_on": "1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [6, 0], [6, 4], [0, 4]], [[2, 1], [4, 1], [4, 3], [2, 3]]]}},
        {"properties": {"role": "exit", "level": "0"}, "geometry": {"type": "Point", "coordinates": [0.4, 0.4]}},
        {"properties": {"role": "wall", "level": "1"}, "geometry": {"type": "LineString", "coordinates": [[0.5, 3.5], [5.5, 3.5]]}},
        {"properties": {"role": "connector", "level": "0;1", "connector": "stairs"}, "geometry": {"type": "Point", "coordinates": [5.5, 0.5]}},
    ],
}


def test_features_become_floors_and_connectors(spark, tmp_path):
    (tmp_path / "station.geojson").write_text(json.dumps(FEATURES))
    f = files.geojson_features(spark, str(tmp_path / "station.geojson"))
    cells, joins = rasters.strict_layout(f, cell=1.0, padding=0)
    at = {(r.floor_id, r.x, r.y): r.token for r in cells.collect()}
    floors = sorted({k[0] for k in at})
    assert len(floors) == 2
    low, high = floors
    assert at[low, 0, 0] == "E" and at[low, 2, 1] == "X" and at[low, 1, 1] == "." and at[low, 5, 3] == "."
    assert at[high, 3, 3] == "X" and at[high, 0, 0] == "."
    j = joins.collect()
    assert len(j) == 1 and (j[0].kind, j[0].x, j[0].y) == ("stairs", 5, 0)


def test_transit_pathways_become_a_layout(spark, tmp_path):
    (tmp_path / "levels.txt").write_text("level_id,level_index,level_name\nL0,0,street\nL1,-1,platform\n")
    (tmp_path / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,level_id\na,A,40.0000,-73.0000,L0\nb,B,40.0001,-73.0000,L0\nc,C,40.0001,-73.0000,L1\n")
    (tmp_path / "pathways.txt").write_text("pathway_id,from_stop_id,to_stop_id,pathway_mode,is_bidirectional\np1,a,b,1,1\np2,b,c,5,1\n")
    cells, joins = rasters.pathway_layout(files.gtfs_pathways(spark, str(tmp_path)))
    free = {(r.floor_id, r.x, r.y) for r in cells.filter("token = '.'").collect()}
    assert {f for f, _, _ in free} == {"L0", "L1"} and len([1 for f, _, _ in free if f == "L0"]) == 12
    assert [(r.connector, r.from_floor, r.to_floor) for r in joins.collect()] == [("elevator", "L0", "L1")]


def test_hazard_field_by_suffix(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"gas_concentration": [[0, 2], [4, 1]], "visibility_m": [[30, 15], [0, 60]]}))
    rows = {(r.ix, r.iy): r for r in files.hazard_field(spark, str(tmp_path / "a.json")).collect()}
    assert rows[0, 1].intensity == 1.0 and rows[1, 0].intensity == 0.5 and rows[1, 0].visibility == 0.5 and rows[1, 1].visibility == 1.0
    (tmp_path / "b.json").write_text(json.dumps({"intensity": [[0, 2], [4, 1]], "visibility": [[1.0]]}))
    with pytest.raises(Exception, match="differ in shape"):
        files.hazard_field(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.csv").write_text("x,y,soot_mass_fraction\n0,0,0.5\n2,0,1.0\n")
    rows = {(r.ix, r.iy): r.intensity for r in files.hazard_field(spark, str(tmp_path / "c.csv")).collect()}
    assert rows == {(0, 0): 0.5, (1, 0): 1.0}
    with pytest.raises(ValueError, match="unknown kind"):
        files.hazard_field(spark, "x.txt")


def test_exported_calls_are_chained(spark, tmp_path):
    names = empty(spark, "llm_calls").columns
    rows = [{"run_id": "r", "step": i, "surface": "guidance", "cache_key": f"k{i}", "estimated_usd": i / 4} for i in range(5)]
    calls = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], empty(spark, "llm_calls").schema)
    tables = {t: empty(spark, t) for t in TABLES} | {"llm_calls": calls}
    StudyBundle(tables, {"n": 1}).export(str(tmp_path), ["parquet"])
    back = StudyBundle.load(spark, str(tmp_path)).tables["llm_calls"].withColumnsRenamed({"audit_chain_prev_hash": "prev_hash", "audit_chain_hash": "chain_hash"})
    assert back.count() == 5
    checked = audits.verified_chain(back.withColumn("row_hash", audits.call_hash(back)), ["run_id"], audits.CALL_ORDER).collect()
    assert [(r.rows, r.first_bad) for r in checked] == [(5, None)]
    forged = back.withColumn("estimated_usd", F.when(F.col("step") == 2, 9.0).otherwise(F.col("estimated_usd")))
    checked = audits.verified_chain(forged.withColumn("row_hash", audits.call_hash(forged)), ["run_id"], audits.CALL_ORDER).collect()
    assert [(r.first_bad, r.reason) for r in checked] == [(3, "row_hash_mismatch")]


def test_broadcasts_are_bounded(spark):
    from egresslake.functions.bounds import bounded

    with pytest.raises(ValueError, match="at most 5 rows"):
        bounded(spark.range(6), 5)
