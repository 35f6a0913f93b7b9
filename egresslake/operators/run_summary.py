"""The summary row of a run: its metrics from the telemetry tables, each grouped once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero, ratio
from egresslake.operators.aggregates import exposure_maps, left_behind_index
from egresslake.operators.ordered import quantiles

# Fixed value: standing agents do not count in mean speed and density.
MOVING_MPS = 0.01


def _positive(c: Column) -> Column:
    return F.greatest(F.lit(0.0), or_zero(c))


def agent_metrics(agents: DataFrame, run: str) -> DataFrame:
    """Counts, travel times, exposures, groups left behind and exposure maps of the agents table."""
    a = agents.withColumn("_travel", F.when(F.col("evacuated"), num("travel_time_s")))
    people = ~F.coalesce(F.col("is_responder"), F.lit(False)) & ~F.coalesce(F.col("is_hostile"), F.lit(False))
    g = a.groupBy(run).agg(
        F.count(F.lit(1)).alias("agents_total"), F.count_if("evacuated").alias("agents_evacuated"), F.count_if(~F.col("evacuated")).alias("agents_remaining"),
        F.count_if(~F.col("evacuated") & F.coalesce(F.col("pending"), F.lit(False))).alias("agents_pending_release"), F.count_if("incapacitated").alias("agents_incapacitated"),
        or_zero(F.avg("_travel")).alias("mean_travel_time_s"), or_zero(F.avg(num("hazard_exposure"))).alias("mean_hazard_exposure"), or_zero(F.max(num("hazard_risk"))).alias("peak_hazard_risk"),
    )
    travel = quantiles(a, [run], "_travel", {"p95_travel_time_s": 0.95, "_p50": 0.5})
    exposure = quantiles(a, [run], "hazard_exposure", {"p95_hazard_exposure": 0.95})
    left = left_behind_index(a.filter(people), run, "cohort_name", F.col("evacuated"))
    for part in (travel, exposure, left, exposure_maps(a.filter(people), run, "cohort_name", "hazard_exposure"), exposure_maps(a.filter(people), run, "mobility_class", "hazard_exposure")):
        g = g.join(part, run, "left")
    g = g.withColumn("percentile_gap_time_to_safety_s", F.col("p95_travel_time_s") - F.col("_p50")).drop("_p50")
    return g.withColumnsRenamed({"hazard_exposure_by_cohort_name": "exposure_by_group", "hazard_exposure_by_mobility_class": "exposure_by_mobility_class"})


def exit_metrics(exits: DataFrame, agents: DataFrame, run: str) -> DataFrame:
    """The exit with the most flow (the least label of several), its share, and the share of evacuated agents that took it."""
    last = exits.groupBy(run, "exit_label").agg(F.max("flow_cumulative").alias("n"))
    top = last.groupBy(run).agg(F.min_by("exit_label", F.struct(-F.col("n"), F.col("exit_label"))).alias("dominant_exit"), or_zero(ratio(F.max("n"), F.sum("n"))).alias("exit_imbalance"))
    used = agents.filter("evacuated").join(top.select(run, "dominant_exit"), run)
    right = used.groupBy(run).agg(F.avg((F.col("evacuated_via") == F.col("dominant_exit")).cast("double")).alias("correct_route_fraction"))
    return top.join(right, run, "left")


def step_metrics(steps: DataFrame, agent_steps: DataFrame, cells: DataFrame, run: str) -> DataFrame:
    """Times, densities, entropies, moving agents' means, shares of decision modes, first sheltering."""
    at = F.col("step")
    s = steps.groupBy(run).agg(
        F.max("time_s").alias("total_time_s"), or_zero(F.max(num("mean_density"))).alias("peak_mean_density"), or_zero(F.min_by(num("global_entropy"), at)).alias("initial_entropy"),
        or_zero(F.max_by(num("global_entropy"), at)).alias("final_entropy"), or_zero(F.max(num("global_entropy"))).alias("peak_entropy"), or_zero(F.avg(num("global_entropy"))).alias("mean_entropy"),
    )
    moving, mode = F.col("speed") > MOVING_MPS, F.col("decision_mode")
    modes = F.count_if(mode.isin("RUN", "HIDE", "FIGHT"))
    a = agent_steps.groupBy(run).agg(
        or_zero(F.avg(F.when(moving, F.col("speed")))).alias("mean_fd_speed"), or_zero(F.avg(F.when(moving, F.col("local_density")))).alias("mean_fd_density"),
        *[or_zero(ratio(F.count_if(mode == m), modes)).alias(f"{m.lower()}_fraction") for m in ("RUN", "HIDE", "FIGHT")], or_zero(F.min(F.when(mode == "HIDE", F.col("time_s")))).alias("time_to_shelter_s"),
    )
    c = cells.groupBy(run).agg(F.max("occupancy").alias("peak_cell_occupancy"))
    return s.withColumn("entropy_reduction", F.col("initial_entropy") - F.col("final_entropy")).join(a, run, "left").join(c, run, "left")


def event_metrics(interventions: DataFrame, hostile: DataFrame, shots: DataFrame, bottlenecks: DataFrame, run: str) -> tuple[DataFrame, ...]:
    """Sums over interventions (positive parts of gains), hostile messages, shots, and peaks of bottlenecks."""
    i = interventions.groupBy(run).agg(
        F.count(F.lit(1)).alias("intervention_count"), F.sum("recipients").alias("intervention_recipients"),
        F.sum(_positive(F.col("entropy_before") - F.col("entropy_after"))).alias("intervention_entropy_reduction"), F.sum(_positive(F.col("accuracy_after") - F.col("accuracy_before"))).alias("intervention_accuracy_gain"),
        F.sum(or_zero(num("mean_hazard_load")) * F.greatest(F.lit(1), F.col("recipients"))).alias("intervention_exposure_pressure"), F.sum(or_zero(num("peak_queue_length"))).alias("intervention_queue_pressure"),
    )
    h = hostile.groupBy(run).agg(F.count(F.lit(1)).alias("hostile_channel_event_count"), F.sum("recipients").alias("hostile_channel_recipients"), or_zero(F.avg("credibility")).alias("hostile_channel_mean_credibility"))
    s = shots.groupBy(run).agg(F.count(F.lit(1)).alias("active_shooter_event_count"), F.sum(or_zero(num("accuracy"))).alias("exposure_to_los"))
    b = bottlenecks.groupBy(run).agg(F.max("queue_length").alias("peak_bottleneck_queue"), F.max("outflow").alias("peak_bottleneck_throughput"), F.count_distinct("zone_id").alias("bottleneck_zone_count"))
    return i, h, s, b


def composite_indices(g: DataFrame) -> DataFrame:
    """Safety efficiency of information and harm by convergence; harm is 0 unless interventions lowered entropy."""
    c = F.col
    gain = c("intervention_entropy_reduction") + c("intervention_accuracy_gain")
    pressure = 1.0 + c("intervention_exposure_pressure") + c("intervention_queue_pressure")
    harm = c("exit_imbalance") * (1.0 + c("peak_bottleneck_queue")) * (1.0 + c("mean_hazard_exposure")) / (1.0 + c("intervention_entropy_reduction"))
    induced = c("exit_imbalance") * c("hostile_channel_recipients") * c("hostile_channel_mean_credibility")
    g = g.withColumn("information_safety_efficiency", F.when(c("intervention_count") > 0, gain / pressure).otherwise(0.0))
    g = g.withColumn("harmful_convergence_index", F.when(c("intervention_entropy_reduction") > 0, harm).otherwise(0.0))
    g = g.withColumn("harmful_convergence_index_accidental", c("harmful_convergence_index")).withColumn("harmful_convergence_index_induced", c("harmful_convergence_index") + induced)
    return g.withColumn("information_safety_efficiency_adversarial", gain / (pressure + c("hostile_channel_recipients")) - induced)


def run_summary(tables: Mapping[str, DataFrame], run: str = "run_id") -> DataFrame:
    """One row per run of the agents table with all its metrics; what a run has no rows for counts as 0 (dominant_exit: n/a)."""
    g = agent_metrics(tables["agents"], run).join(exit_metrics(tables["exits"], tables["agents"], run), run, "left")
    g = g.join(step_metrics(tables["steps"], tables["agent_steps"], tables["cells"], run), run, "left")
    for part in event_metrics(tables["interventions"], tables["hostile"], tables["shots"], tables["bottlenecks"], run):
        g = g.join(part, run, "left")
    keep = {run, "dominant_exit", "exposure_by_group", "exposure_by_mobility_class"}
    g = g.select(*[c if c in keep else F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in g.dtypes])
    return composite_indices(g.withColumn("dominant_exit", F.coalesce("dominant_exit", F.lit("n/a"))))
