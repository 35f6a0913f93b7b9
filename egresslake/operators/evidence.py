"""Audits of many scenarios at once: issue tables (scenario_id, severity, code, source), their totals, and evidence of benchmark runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import clip, or_zero, ratio
from egresslake.operators.graph import edges, reachable

# Kinds of evidence, those that count as operational, and ranges of plausible speeds.
EVIDENCE_TYPES = ("drill", "incident", "trajectory", "expert_coded")
OPERATIONAL_TYPES = ("drill", "incident", "trajectory")
LEAST_SPEED, MOST_SPEED = 0.2, 3.0
VERTICAL = ("stairs", "elevator", "escalator")
# Verdicts on what information does, and their thresholds.
HARMFUL, BORDERLINE, SAFE = "HARMFUL", "BORDERLINE", "SAFE"

Rule = tuple[str, str, Column]


def rule_issues(df: DataFrame, rules: Sequence[Rule], source: Column) -> DataFrame:
    """One row per row and violated rule (severity, code, condition); NULL conditions hold nothing against a row."""
    bad = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for s, code, c in rules]))
    return df.select("scenario_id", source.alias("source"), F.explode(bad).alias("i")).select("scenario_id", "i.severity", "i.code", "source")


def static_audit(scenarios: DataFrame, cells: DataFrame, starts: DataFrame, channels: DataFrame, objectives: Sequence[str]) -> DataFrame:
    """Static validation: cells, exits, starts, implicit spawns, objectives of hostile channels, unreachable cells.

    scenarios: scenario_id (a number), population_total, responder_count; cells: scenario_id, x, y, token (X wall, E exit);
    starts: scenario_id, kind (spawn or responder), x, y; channels: scenario_id, objective. All scenarios are searched
    in one breadth-first search, side by side along x.
    """
    walk = cells.withColumn("walkable", F.col("token") != "X")
    wide = cells.agg(F.coalesce(F.max("x"), F.lit(0)) + 2).first()[0]  # one number
    shift = walk.withColumn("x", F.col("x") + F.col("scenario_id") * wide)
    found = reachable(edges(shift), shift.filter("token = 'E'")).select((F.col("x") % wide).cast("int").alias("x"), "y", F.floor(F.col("x") / wide).cast("long").alias("scenario_id"), F.lit(True).alias("_reach"))
    c = walk.join(found, ["scenario_id", "x", "y"], "left")
    by = c.groupBy("scenario_id").agg(F.count_if("walkable").alias("walkable"), F.count_if(F.col("token") == "E").alias("exits"), F.count_if(F.col("walkable") & F.col("_reach").isNull()).alias("lost"))
    kinds = starts.groupBy("scenario_id").agg(F.count_if(F.col("kind") == "spawn").alias("spawns"), F.count_if(F.col("kind") == "responder").alias("entries"))
    s = scenarios.join(by, "scenario_id", "left").join(kinds, "scenario_id", "left").na.fill(0, ["walkable", "exits", "lost", "spawns", "entries"])
    whole = rule_issues(s, [
        ("error", "no_walkable_cells", F.col("walkable") == 0), ("error", "no_exits", F.col("exits") == 0),
        ("warning", "implicit_population_spawn", (F.col("population_total") > 0) & (F.col("spawns") == 0)), ("warning", "implicit_responder_spawn", (F.col("responder_count") > 0) & (F.col("entries") == 0)),
        ("warning", "unreachable_walkable_cells", (F.col("exits") > 0) & (F.col("lost") > 0)),
    ], F.lit("layout"))
    t = starts.join(c.select("scenario_id", "x", "y", "token", "_reach"), ["scenario_id", "x", "y"], "left").join(s.select("scenario_id", "exits"), "scenario_id")
    open_ = F.col("token").isNotNull() & (F.col("token") != "X")
    each = rule_issues(t, [
        ("error", "start_out_of_bounds", F.col("token").isNull()), ("error", "start_on_wall", F.col("token") == "X"),
        ("error", "start_unreachable", open_ & (F.col("exits") > 0) & F.col("_reach").isNull()), ("warning", "start_on_exit", open_ & (F.col("token") == "E")),
    ], F.concat_ws(",", F.col("x"), F.col("y")))
    odd = rule_issues(channels, [("error", "unknown_hostile_objective", ~F.col("objective").isin(*objectives))], F.col("objective"))
    return whole.unionByName(each).unionByName(odd)


def geometry_audit(connectors: DataFrame, floors: DataFrame) -> DataFrame:
    """Connector issues: repeated ids, floors without any, sizes and speeds, loops, flat vertical ones, elevators without timing.

    connectors: scenario_id, connector_id, kind, width, speed, capacity, travel_s, dwell_s, height_delta, sx, sy, tx, ty; floors: scenario_id, floor_id.
    """
    each = rule_issues(connectors, [
        ("error", "connector_nonpositive_width", F.col("width") <= 0), ("error", "connector_nonpositive_speed", F.col("speed") <= 0), ("error", "connector_nonpositive_capacity", F.col("capacity") <= 0),
        ("warning", "connector_self_loop", (F.col("sx") == F.col("tx")) & (F.col("sy") == F.col("ty"))), ("warning", "vertical_connector_without_vertical_delta", F.col("kind").isin(*VERTICAL) & (or_zero(F.col("height_delta")) == 0)),
        ("warning", "elevator_without_service_timing", (F.col("kind") == "elevator") & F.col("capacity").isNull() & (or_zero(F.col("travel_s")) <= 0) & (or_zero(F.col("dwell_s")) <= 0)),
    ], F.col("connector_id"))
    twice = rule_issues(connectors.groupBy("scenario_id", "connector_id").agg(F.count(F.lit(1)).alias("n")), [("error", "duplicate_connector_id", F.col("n") > 1)], F.col("connector_id"))
    n = floors.groupBy("scenario_id").agg(F.count_distinct("floor_id").alias("floors")).join(connectors.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return each.unionByName(twice).unionByName(rule_issues(n, [("warning", "multifloor_without_connectors", F.col("floors") > 1)], F.lit("connectors")))


def hazard_audit(hazards: DataFrame) -> DataFrame:
    """Hazard issues: imported fields without a file or a reference, stylised hazards, severities out of range.

    hazards: scenario_id, hazard_id, imported, field_file, has_reference, severity.
    """
    return rule_issues(hazards, [
        ("error", "imported_hazard_missing_file", F.col("imported") & (F.coalesce("field_file", F.lit("")) == "")), ("warning", "imported_hazard_without_reference_scope", F.col("imported") & ~F.coalesce("has_reference", F.lit(False))),
        ("warning", "stylized_hazard", ~F.col("imported")), ("error", "hazard_severity_out_of_range", ~F.col("severity").between(0.0, 1.0)),
    ], F.col("hazard_id").cast("string"))


def calibration_audit(scenarios: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Issues of the force profile and of cohorts.

    scenarios: scenario_id, sfm_profile, has_sfm_provenance, desired_speed_mps, relaxation_time_s, population_total; cohorts: scenario_id, cohort_name, base_speed_mps.
    """
    n = cohorts.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("cohorts"))
    s = scenarios.join(n, "scenario_id", "left")
    whole = rule_issues(s, [
        ("warning", "generic_social_force_profile", F.col("sfm_profile") == "generic_legacy"), ("warning", "social_force_provenance_missing", ~F.coalesce("has_sfm_provenance", F.lit(False))),
        ("error", "desired_speed_mps", ~F.col("desired_speed_mps").between(LEAST_SPEED, MOST_SPEED)), ("error", "relaxation_time_s", F.col("relaxation_time_s") <= 0),
        ("warning", "implicit_population_calibration", (F.col("population_total") > 0) & F.col("cohorts").isNull()),
    ], F.lit("calibration"))
    return whole.unionByName(rule_issues(cohorts, [("error", "cohort_base_speed_mps", ~F.col("base_speed_mps").between(LEAST_SPEED, MOST_SPEED))], F.col("cohort_name")))


def evidence_audit(scenarios: DataFrame, evidence: DataFrame) -> DataFrame:
    """Issues of validation evidence: unknown types, missing fields and files, required or no records.

    scenarios: scenario_id, required; evidence: scenario_id, record, type, source_name, validation_use, scope, file, file_exists.
    """
    def empty(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    each = rule_issues(evidence, [
        ("error", "unsupported_validation_evidence_type", ~F.coalesce("type", F.lit("")).isin(*EVIDENCE_TYPES)),
        *[("error", "validation_evidence_field_missing", empty(c)) for c in ("source_name", "validation_use", "scope")],
        ("error", "validation_evidence_file_missing", ~empty("file") & ~F.coalesce("file_exists", F.lit(False))),
    ], F.col("record").cast("string"))
    none = scenarios.join(evidence.select("scenario_id").distinct(), "scenario_id", "left_anti")
    return each.unionByName(rule_issues(none, [("error", "external_validation_evidence_required", F.col("required")), ("warning", "external_validation_evidence_missing", ~F.col("required"))], F.lit("evidence")))


def claim_support(scenarios: DataFrame, evidence: DataFrame) -> DataFrame:
    """(scenario_id, records, operational, claim_support)."""
    e = evidence.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("type").isin(*OPERATIONAL_TYPES)).alias("operational"))
    s = scenarios.select("scenario_id").join(e, "scenario_id", "left").na.fill(0, ["records", "operational"])
    return s.withColumn("claim_support", F.when(F.col("operational") > 0, "external_evidence_recorded").when(F.col("records") > 0, "documented_limits").otherwise("none"))


def sweep(scenarios: DataFrame, audits: dict[str, DataFrame]) -> DataFrame:
    """The corpus: per scenario errors, warnings, and issues of each audit; scenarios without issues too."""
    every = reduce(DataFrame.unionByName, [df.withColumn("audit", F.lit(name)) for name, df in audits.items()])
    n = every.groupBy("scenario_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), *[F.count_if(F.col("audit") == name).alias(f"{name}_issues") for name in audits],
    )
    out = scenarios.select("scenario_id").join(n, "scenario_id", "left")
    return out.na.fill(0).withColumn("ok", F.col("errors") == 0)


def benchmark_evidence(swept: DataFrame, hazards: DataFrame, support: DataFrame, assertions: DataFrame) -> DataFrame:
    """Flags and counts of a benchmark run's evidence: audits, hazards by kind, evidence records, runtime assertions (scenario_id, issues)."""
    h = hazards.groupBy("scenario_id").agg(F.count_if(~F.col("imported")).alias("stylized_hazard_count"), F.count_if("imported").alias("imported_hazard_count"))
    a = assertions.groupBy("scenario_id").agg(F.sum("issues").alias("runtime_assertion_issue_count"), F.lit(True).alias("runtime_assertions_present"))
    j = swept.join(h, "scenario_id", "left").join(support.select("scenario_id", F.col("records").alias("external_validation_evidence_count"), F.col("operational").alias("operational_validation_evidence_count")), "scenario_id", "left").join(a, "scenario_id", "left")
    j = j.na.fill(0).na.fill(False, ["runtime_assertions_present"])
    return j.withColumn("runtime_assertions_ok", F.col("runtime_assertion_issue_count") == 0)


def completion_fraction(agents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: share of agents, responders and hostiles aside, that got out; 1 where there are none."""
    person = ~F.coalesce(F.col("is_responder"), F.lit(False)) & ~F.coalesce(F.col("is_hostile"), F.lit(False))
    return agents.groupBy(*keys).agg(F.coalesce(ratio(F.count_if(person & F.col("evacuated")), F.when(F.count_if(person) > 0, F.count_if(person))), F.lit(1.0)).alias("evacuation_completion_fraction"))


def exit_spread(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: greatest less least share of exits; 0 for fewer than two exits or no flow."""
    g = flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("n").alias("_hi"), F.min("n").alias("_lo"), F.sum("n").alias("_all"))
    return g.select(*keys, F.when(F.col("_n") > 1, or_zero(ratio(F.col("_hi") - F.col("_lo"), F.col("_all")))).otherwise(0.0).alias("exit_imbalance"))


def plausibility(agent_steps: DataFrame, steps: DataFrame, bottlenecks: DataFrame, dwell: DataFrame, keys: Sequence[str], stuck_mps: float = 0.05) -> DataFrame:
    """Long rows (keys, metric, value) of behavioural plausibility, as assertions check them."""
    a = agent_steps.groupBy(*keys).agg(
        F.count_if(F.col("speed") <= stuck_mps).cast("double").alias("stuck_agent_steps"), or_zero(F.avg("speed")).alias("mean_agent_speed_mps"), or_zero(F.max("speed")).alias("max_agent_speed_mps"),
        or_zero(F.avg("local_density")).alias("mean_local_density"), or_zero(F.max("local_density")).alias("max_local_density"),
    )
    s = steps.groupBy(*keys).agg(or_zero(F.avg("mean_density")).alias("mean_density"), or_zero(F.max("mean_density")).alias("max_mean_density"), or_zero(F.max("peak_cell_occupancy").cast("double")).alias("peak_cell_occupancy"))
    b = bottlenecks.groupBy(*keys).agg(or_zero(F.max("queue_length").cast("double")).alias("max_bottleneck_queue_length"))
    d = dwell.groupBy(*keys).agg(or_zero(F.avg("dwell_s")).alias("mean_bottleneck_dwell_s"), or_zero(F.max("dwell_s")).alias("max_bottleneck_dwell_s"))
    j = reduce(lambda x, y: x.join(y, list(keys), "left"), (a, s, b, d)).na.fill(0.0)
    return j.unpivot(list(keys), [c for c in j.columns if c not in keys], "metric", "value")


def check_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of rules (metric, eq, least, most; NULL parts are not asked) by metrics (metric, value); a missing value violates."""
    v = F.col("value")
    code = (
        F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "metric_missing").when(v != F.col("eq"), "not_equal").when(v < F.col("least"), "below_minimum").when(v > F.col("most"), "above_maximum")
    )
    return rules.join(metrics, "metric", "left").withColumn("code", code).filter("code is not null").select("metric", "value", "code")


def safety_frontier(s: DataFrame) -> DataFrame:
    """Static score and verdict of what information can do in a scenario.

    s: scenario_id, population, exits, walkable, mean_familiarity, observation_radius, beacon_radius, gossip_radius, zones, hazard_pressure, hostile_bonus, intervention_bonus.
    """
    c = F.col
    people, exits, cells = (F.greatest(F.lit(1), c(x)) for x in ("population", "exits", "walkable"))
    reach = F.least(F.lit(1.0), (c("observation_radius") + c("beacon_radius") + c("gossip_radius")) / 18.0)
    s = s.withColumn("entropy_reduction_potential", clip((1 - c("mean_familiarity")) * reach, 0, 1))
    s = s.withColumn("queue_pressure", clip(0.6 * F.least(F.lit(1.0), c("zones") / (exits * 3.0)) + 0.4 * F.least(F.lit(1.0), people / (cells * 0.45)), 0, 1))
    s = s.withColumn("exposure_pressure", clip(c("hazard_pressure"), 0, 1))
    s = s.withColumn("convergence_pressure", clip(F.least(F.lit(1.0), people / (exits * 40.0)) + c("hostile_bonus") + c("intervention_bonus"), 0, 1))
    s = s.withColumn("score", clip(c("entropy_reduction_potential") * c("convergence_pressure") * (0.55 * c("queue_pressure") + 0.45 * c("exposure_pressure")), 0, 1))
    e, v, q, x = (c(n) for n in ("entropy_reduction_potential", "convergence_pressure", "queue_pressure", "exposure_pressure"))
    bad = (c("score") >= 0.18) | ((e >= 0.45) & (v >= 0.45) & (x >= 0.25))
    odd = (c("score") >= 0.07) | ((e >= 0.35) & ((q >= 0.35) | (x >= 0.2)))
    verdict = F.when(bad, HARMFUL).when(odd, BORDERLINE).otherwise(SAFE)
    return s.select("scenario_id", "entropy_reduction_potential", "convergence_pressure", "queue_pressure", "exposure_pressure", "score", verdict.alias("verdict"))


def detectors(found: dict[str, DataFrame], run: str = "run_id") -> DataFrame:
    """All emergence detectors as rows (run, detector, score, detected)."""
    return reduce(DataFrame.unionByName, [df.select(run, F.lit(name).alias("detector"), F.col("score").cast("double").alias("score"), F.col("detected").cast("boolean").alias("detected")) for name, df in found.items()])
