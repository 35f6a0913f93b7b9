"""The data behind report figures and briefs, as queries over bundle tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero, pct_signed, ratio
from egresslake.functions.scalars import weidmann


def keyframes(steps: DataFrame) -> DataFrame:
    """First, middle and last distinct step."""
    s = steps.select("step").distinct().withColumn("rn", F.row_number().over(Window.orderBy("step"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    return s.filter((F.col("rn") == 1) | (F.col("rn") == F.floor(F.col("n") / 2) + 1) | (F.col("rn") == F.col("n"))).select("step")


def occupancy_and_slowdown(cells: DataFrame, free_speed: float = 1.5) -> DataFrame:
    """Per cell: largest occupancy, mean slowdown below the free speed (1.5 m/s; in the unit of the column)."""
    return cells.groupBy("x", "y").agg(F.max("occupancy").alias("peak_occupancy"), F.avg(F.greatest(F.lit(0.0), free_speed - F.col("speed"))).alias("mean_slowdown"))


def bottleneck_series(bottlenecks: DataFrame) -> DataFrame:
    return bottlenecks.groupBy("variant_name", "time_s").agg(F.avg("queue_length").alias("queue_length"), F.avg("outflow").alias("throughput"))


def bottleneck_peaks(bottlenecks: DataFrame) -> DataFrame:
    return bottlenecks.groupBy("variant_name", "zone_id").agg(F.max("queue_length").alias("peak_queue"), F.avg("mean_dwell_s").alias("mean_dwell_s"))


def final_exits(exits: DataFrame) -> DataFrame:
    """Per run and exit the last cumulative flow, and its share of the run."""
    last = exits.groupBy("run_id", "exit_label").agg(F.max_by("flow_cumulative", "step").alias("flow"))
    return last.withColumn("share", or_zero(ratio(F.col("flow"), F.sum("flow").over(Window.partitionBy("run_id")))))


def variant_deltas(summary: DataFrame, metrics: Sequence[str], baseline: str) -> DataFrame:
    """Every other variant against the baseline, long, with change in percent."""
    v = summary.select("variant_name", *[num(m).alias(m) for m in metrics]).unpivot(["variant_name"], list(metrics), "metric", "value")
    base = v.filter(F.col("variant_name") == baseline).select("metric", F.col("value").alias("base"))
    d = v.filter(F.col("variant_name") != baseline).join(base, "metric")
    return d.withColumn("delta", F.col("value") - F.col("base")).withColumn("pct_change", pct_signed(F.col("base"), F.col("value")))


def top_changes(deltas: DataFrame, k: int = 8) -> DataFrame:
    return deltas.orderBy(F.desc(F.abs("pct_change")), "metric").limit(k)


def fundamental_diagram(cells: DataFrame) -> DataFrame:
    """Samples (density, speed) with the curve's speed; near-empty and standing cells are left out."""
    return cells.filter((F.col("density") > 0.01) & (F.col("speed") > 0.01)).select("density", "speed", weidmann(F.col("density")).alias("curve"))


def curve_error(cells: DataFrame) -> DataFrame:
    """Root mean square and greatest deviation from the curve; passes up to 0.2."""
    e = F.col("speed") - F.col("curve")
    return fundamental_diagram(cells).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_deviation")).withColumn("passed", F.col("rmse") <= 0.2)


def belief_survival(agents: DataFrame, agent_steps: DataFrame) -> DataFrame:
    """Agents with their mean belief accuracy (NULL where none was recorded)."""
    return agents.join(agent_steps.groupBy("run_id", "agent_id").agg(F.avg("belief_accuracy").alias("mean_accuracy")), ["run_id", "agent_id"], "left")


def responder_timing(steps: DataFrame, interventions: DataFrame) -> DataFrame:
    """Entropy by time, with the first responder intervention of the run."""
    first = interventions.filter(F.lower("policy").contains("responder")).groupBy("run_id").agg(F.min("time_s").alias("first_responder_s"))
    return steps.select("run_id", "time_s", "global_entropy").join(first, "run_id", "left")


def intervention_timeline(interventions: DataFrame) -> DataFrame:
    """Reach and positive parts of entropy and accuracy gains by variant and time."""
    def gain(c: Column) -> Column:
        return F.sum(F.greatest(F.lit(0.0), or_zero(c)))

    return interventions.groupBy("variant_name", "time_s").agg(F.sum("recipients").alias("recipients"), gain(-F.col("entropy_delta")).alias("entropy_gain"), gain(F.col("accuracy_delta")).alias("accuracy_gain"))


def specific_flow(events: DataFrame, width: str = "width_m") -> DataFrame:
    """Per width: finish events over their time span and the width; fewer than two, or no span, fails the query."""
    g = events.groupBy(width).agg(F.count(F.lit(1)).alias("n"), (F.max("time_s") - F.min("time_s")).alias("span"))
    bad = F.raise_error(F.lit("too few crossings")).cast("double")
    return g.withColumn("specific_flow", F.when((F.col("n") < 2) | (F.col("span") <= 0), bad).otherwise(F.col("n") / F.col("span") / F.col(width))).orderBy(width)


def flow_curve_error(simulated: DataFrame, reference: DataFrame) -> DataFrame:
    """Rows of both curves at equal widths, with the root mean square error on each."""
    j = reference.join(simulated, "width_m").withColumn("error", F.col("specific_flow") - F.col("specific_flow_ped_m_s"))
    return j.withColumn("rmse", F.sqrt(F.avg(F.col("error") ** 2).over(Window.partitionBy())))


def delta_ci95(std_a: Column, n_a: Column, std_b: Column, n_b: Column) -> Column:
    """Half width of the interval of a difference of means."""
    return 1.96 * F.sqrt(or_zero(ratio(std_a * std_a, n_a)) + or_zero(ratio(std_b * std_b, n_b)))


def recommended(deltas: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """Majority vote over metrics for which less is better: variant or baseline."""
    v = deltas.filter(F.col("metric").isin(*lower_is_better)).groupBy("variant_name").agg(F.count_if(F.col("delta") < 0).alias("better"), F.count(F.lit(1)).alias("votes"))
    return v.withColumn("arm", F.when(F.col("better") * 2 > F.col("votes"), F.col("variant_name")).otherwise("baseline"))


def claim_tier(runs: DataFrame, required: Sequence[str], issues: Sequence[str], benchmark_runs: int = 20) -> DataFrame:
    """All evidence flags hold, no issues are counted, enough seeds: benchmark_grade, diagnostic or smoke, and what limits it."""
    flags = [F.coalesce(F.bool_and(f), F.lit(False)).alias(f) for f in required]
    sums = [F.coalesce(F.sum(i), F.lit(0)).alias(i) for i in issues]
    g = runs.agg(F.count_distinct("seed").alias("seeds"), *flags, *sums)
    sound, clean = F.lit(True), F.lit(True)
    for f in required:
        sound = sound & F.col(f)
    for i in issues:
        clean = clean & (F.col(i) == 0)
    limits = F.array_compact(F.array(*[F.when(~F.col(f), F.lit(f"missing:{f}")) for f in required], *[F.when(F.col(i) > 0, F.lit(f"issues:{i}")) for i in issues], F.when(F.col("seeds") < benchmark_runs, F.lit("few_seeds"))))
    tier = F.when(sound & clean & (F.col("seeds") >= benchmark_runs), "benchmark_grade").when(sound & clean, "diagnostic").otherwise("smoke")
    return g.withColumn("tier", tier).withColumn("limitations", limits)


def calibration_score(flow_pct: Column, headway_pct: Column, crossing_pct: Column) -> Column:
    return F.abs(flow_pct) + 0.5 * F.abs(headway_pct) + 0.5 * F.abs(crossing_pct)


def dispatch_projection(agents: DataFrame, x: float, y: float, radius: float) -> DataFrame:
    """What a message at a place would do: recipients in reach, their mean density and entropy."""
    near = (F.col("x") - x) ** 2 + (F.col("y") - y) ** 2 <= radius * radius
    return agents.filter(near).agg(F.count(F.lit(1)).alias("recipients"), F.round(or_zero(F.avg("local_density")), 6).alias("pressure"), F.round(or_zero(F.avg("entropy")), 6).alias("uncertainty"))
