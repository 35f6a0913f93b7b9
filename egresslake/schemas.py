"""The sixteen telemetry tables: explicit Spark schemas, one declaration per table.

Nullable ids stay LONG (no float upcast); time is DOUBLE seconds and joins go by step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RUN_KEY = "study_name string, scenario_name string, variant_name string, seed long, run_id string"
_AT = "step int, time_s double"
_CELL = "floor_id string, z double, x int, y int"

_COLUMNS = {
    "summary": "record_type string, layout_cells long, layout_floors long, layout_exits long, layout_width int, layout_height int, run_count long",
    "steps": f"{_AT}, evacuated_total long, remaining long, pending_release long, mean_speed double, mean_density double, peak_cell_occupancy long, global_entropy double, dynamic_closed_cells long, dynamic_closed_edges long, dynamic_topology_revision long",
    "cells": f"{_AT}, {_CELL}, occupancy long, density double, speed double, path_usage long",
    "intent_path_usage": f"{_AT}, {_CELL}, intent string, count long",
    "agent_steps": f"{_AT}, agent_id long, floor_id string, x double, y double, z double, cell_x int, cell_y int, state string, speed double, local_density double, target_exit_floor string, target_exit_x int, target_exit_y int, "
    "cohort_name string, group_id long, leader_id long, family_id string, role_in_group string, mobility_class string, evacuation_mode string, hazard_exposure double, hazard_load double, visibility double, flood_depth_m double, "
    "environment_speed_factor double, door_flow_speed_factor double, toxic_load double, smoke_fed double, heat_load double, flood_load double, trauma_load double, crush_load double, entropy double, belief_accuracy double, "
    "impairment double, decision_mode string, padm_receive long, padm_understand long, padm_personalize long, padm_decide long",
    "agents": "agent_id long, cohort_name string, personality string, calmness double, release_step int, group_id long, leader_id long, assisted_agent_id long, family_id string, role_in_group string, mobility_class string, "
    "evacuation_mode string, age_band string, separation_anxiety_threshold double, breathing_height_m double, familiarity double, homophily_weight double, impairment double, is_responder boolean, is_hostile boolean, "
    "evacuated boolean, travel_time_s double, hazard_exposure double, hazard_risk double, evacuated_via string, base_speed double",
    "equity_subgroups": "subgroup_type string, subgroup_tag string, subgroup_label string, agent_count long, evacuated_count long, remaining_count long, evacuation_rate double, run_evacuation_rate double, "
    "evacuation_rate_gap_vs_run double, mean_travel_time_s double, p95_travel_time_s double, run_mean_travel_time_s double, travel_time_gap_vs_run_s double, equity_time_gap_s double, mean_hazard_exposure double, "
    "p95_hazard_exposure double, mean_impairment double, mean_familiarity double",
    "bottlenecks": f"{_AT}, zone_id string, occupancy long, inflow long, outflow long, queue_length long, mean_dwell_s double, mean_speed double, mean_density double, capacity_per_s double, demand double, flow_speed_factor double",
    "dwell_samples": "zone_id string, dwell_s double",
    "exits": f"{_AT}, exit_label string, flow_step long, flow_cumulative long",
    "hazards": f"{_AT}, hazard_id string, kind string, x double, y double, z double, radius double, severity double",
    "measurements": f"line_name string, {_AT}, flow double, density double, speed double, n_crossing long, n_in_region long",
    "gossip": f"{_AT}, sender_id long, receiver_id long, distance double",
    "interventions": f"{_AT}, policy string, message_type string, target_x double, target_y double, radius double, recipients long, entropy_before double, entropy_after double, entropy_delta double, accuracy_before double, "
    "accuracy_after double, accuracy_delta double, mean_local_density double, mean_hazard_load double, peak_queue_length long, selected_reason string, target_score double, objective string, generated_text string, "
    "generation_provider string, generation_model string, validation_status string, validation_reasons string, cache_key string, cache_status string, generated_recommended_exits string, generated_avoid_exits string, "
    "generated_confidence double, used_fallback boolean",
    "llm_decisions": f"{_AT}, agent_id long, provider string, model string, cache_key string, cache_status string, validation_status string, validation_reasons string, selected_intent string, target_exit_floor string, "
    "target_exit_x int, target_exit_y int, trust_delta double, avoid_congested boolean, confidence double, rationale string, used_fallback boolean, objective string",
    "llm_calls": f"{_AT}, surface string, policy string, agent_id long, provider string, model string, cache_key string, cache_status string, validation_status string, validation_reasons string, judge_status string, "
    "judge_safety double, judge_specificity double, judge_alignment double, judge_reasons string, judge_provider string, used_fallback boolean, objective string, prompt_style string, target_x double, target_y double, "
    "estimated_input_tokens long, estimated_output_tokens long, estimated_total_tokens long, estimated_usd double, budget_reason string, raw_input_tokens long, raw_output_tokens long, raw_total_tokens long, "
    "audit_chain_prev_hash string, audit_chain_hash string",
}
TABLES = tuple(_COLUMNS)


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(f"{RUN_KEY}, {_COLUMNS[table]}")


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))
