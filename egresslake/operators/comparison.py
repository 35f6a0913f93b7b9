"""Variants, claims and studies against each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero, pct_abs, pct_signed, ratio
from egresslake.operators.statistics import bootstrap_ci, cohens_d, mann_whitney, wilcoxon

#: Metrics for which less is better.
LOWER_IS_BETTER = ("mean_travel_time_s", "p95_travel_time_s", "mean_hazard_exposure", "peak_mean_density", "peak_bottleneck_queue", "harmful_convergence_index", "agents_incapacitated", "final_entropy", "mean_entropy")
#: What a flow comparison has a row for.
FLOW_METRICS = ("crossing_count", "first_crossing_s", "last_crossing_s", "mean_flow_ped_s", "mean_time_headway_s")
ORDER = ("study_aggregate", "variant_aggregate")


def run_rows(summary: DataFrame) -> DataFrame:
    """Rows of single runs; all rows where record_type is not there."""
    return summary.filter("record_type = 'run'") if "record_type" in summary.columns else summary


def aggregate_row(summary: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row: the study's aggregate, else the first variant's, else the first, by `order`."""
    rank = F.when(F.col("record_type") == ORDER[0], 0).when(F.col("record_type") == ORDER[1], 1).otherwise(2)
    return summary.orderBy(rank, *order).limit(1)


def representative_run(rows: DataFrame, run_id: str | None, key: str = "run_id") -> DataFrame:
    """Rows of the representative run; all rows where none is named."""
    return rows if run_id is None else rows.filter(F.col(key) == run_id)


def available(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of a list that are there, in its order."""
    return df.select(*[c for c in columns if c in df.columns])


def long_sides(summary: DataFrame, metrics: Sequence[str], pairs: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """(claim, metric, side, value, also): run values of the baseline (b) and test (a) variants of each claim (claim, baseline, test)."""
    there = [m for m in metrics if m in summary.columns]
    v = summary.select("variant_name", *also, *[num(m).alias(m) for m in there]).unpivot(["variant_name", *also], there, "metric", "value").filter("value is not null")
    a = v.join(pairs.select("claim", F.col("test").alias("variant_name")), "variant_name").withColumn("side", F.lit("a"))
    b = v.join(pairs.select("claim", F.col("baseline").alias("variant_name")), "variant_name").withColumn("side", F.lit("b"))
    return a.unionByName(b)


def compare_claims(summary: DataFrame, metrics: Sequence[str], pairs: DataFrame, seed: str = "seed", samples: int = 1000, intervals: bool = True) -> DataFrame:
    """Per claim and metric: means with bootstrap intervals, difference, rank tests (paired ones by seed), effect size, direction.

    Only runs count, not aggregates; metrics and claims without values on both sides are left out. `pairs` is a list of
    claims (claim, baseline, test).
    """
    v = long_sides(run_rows(summary), metrics, pairs, [seed])
    keys = ["claim", "metric"]
    d = cohens_d(v, keys, "side", "value").filter("n_a > 0 and n_b > 0").withColumn("d", -F.col("d"))  # test less baseline
    u = mann_whitney(v, keys, "side", "value").select(*keys, F.col("u").alias("mann_whitney_u"), F.col("p").alias("p_value"))
    means = v.groupBy(*keys, seed).agg(F.avg(F.when(F.col("side") == "a", F.col("value"))).alias("a"), F.avg(F.when(F.col("side") == "b", F.col("value"))).alias("b"))
    paired = means.filter("a is not null and b is not null").withColumn("delta", F.col("a") - F.col("b"))
    w = wilcoxon(paired, keys, "delta").select(*keys, F.col("w").alias("wilcoxon_stat"), F.col("p").alias("wilcoxon_p"))
    n = paired.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_paired"))
    out = d.join(u, keys).join(w, keys, "left").join(n, keys, "left")
    delta = F.col("mean_a") - F.col("mean_b")
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    out = out.select(
        *keys, F.col("mean_b").alias("baseline_mean"), F.col("mean_a").alias("test_mean"), delta.alias("diff_absolute"), pct_signed(F.col("mean_b"), F.col("mean_a")).alias("diff_percent"),
        "mann_whitney_u", "p_value", (F.col("p_value") < 0.05).alias("significant"), F.col("d").alias("cohens_d"), F.col("n_b").alias("n_baseline"), F.col("n_a").alias("n_test"),
        F.coalesce("n_paired", F.lit(0)).alias("n_paired"), "wilcoxon_stat", F.coalesce("wilcoxon_p", F.lit(1.0)).alias("wilcoxon_p"),
        F.when(lower, "lower").otherwise("higher").alias("better_direction"), F.when(lower, delta < 0).otherwise(delta > 0).alias("supports_test"),
    )
    if not intervals:
        return out
    ci = bootstrap_ci(v, [*keys, "side"], "value", samples)
    for side, name in (("b", "baseline"), ("a", "test")):
        mine = ci.filter(F.col("side") == side).select(*keys, F.col("ci_low").alias(f"{name}_ci_lower"), F.col("ci_high").alias(f"{name}_ci_upper"))
        out = out.join(mine, keys)
    return out


def compare_variants(summary: DataFrame, baseline: str, test: str, metrics: Sequence[str], samples: int = 1000, intervals: bool = True) -> DataFrame:
    """compare_claims() for one pair of variants."""
    pair = summary.sparkSession.createDataFrame([("", baseline, test)], "claim string, baseline string, test string")
    return compare_claims(summary, metrics, pair, samples=samples, intervals=intervals).drop("claim")


def causal_deltas(summary: DataFrame, metrics: Sequence[str], baseline: str, seed: str = "seed") -> DataFrame:
    """(variant_name, metric, n_pairs, ate, lower_is_better): mean difference of equal seeds, of every other variant against the baseline."""
    there = [m for m in metrics if m in summary.columns]
    v = run_rows(summary).select("variant_name", seed, *[num(m).alias(m) for m in there]).unpivot(["variant_name", seed], there, "metric", "value")
    m = v.groupBy("variant_name", seed, "metric").agg(F.avg("value").alias("value"))
    b = m.filter(F.col("variant_name") == baseline).select(seed, "metric", F.col("value").alias("base"))
    j = m.filter(F.col("variant_name") != baseline).join(b, [seed, "metric"])
    return j.groupBy("variant_name", "metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("value") - F.col("base")).alias("ate")).withColumn("lower_is_better", F.col("metric").isin(*LOWER_IS_BETTER))


def delta_payload(deltas: DataFrame) -> DataFrame:
    """Per variant one JSON object of its metrics' deltas, sorted by metric."""
    entry = F.struct(F.col("metric").alias("key"), F.struct(F.round("ate", 6).alias("ate"), "n_pairs").alias("value"))
    return deltas.groupBy("variant_name").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("payload"))


def composite_delta(pairs: DataFrame) -> DataFrame:
    """Matched composite of benchmark runs: the treated arm's score less that of the untreated arm of equal key, and a vote."""
    d = F.col("treated_score") - F.col("control_score")
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), or_zero(F.avg(d)).alias("mean_delta"), F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"))


def highlights(synthesis: DataFrame, pairs: DataFrame, key: str = "study") -> DataFrame:
    """Per study and claim (claim, baseline, test): changes of safety efficiency and harm, and the ratio of recipients."""
    keep = [key, "variant_name", "information_safety_efficiency", "harmful_convergence_index", "intervention_recipients"]
    s = synthesis.select(*keep)
    a = s.join(pairs, s["variant_name"] == pairs["test"]).drop("variant_name").withColumnsRenamed({c: f"a_{c}" for c in keep[2:]})
    b = s.withColumnsRenamed({"variant_name": "baseline", **{c: f"b_{c}" for c in keep[2:]}})
    j = a.join(b, [key, "baseline"])
    return j.select(
        key, "claim", "baseline", "test", (F.col("a_information_safety_efficiency") - F.col("b_information_safety_efficiency")).alias("ise_delta"),
        (F.col("a_harmful_convergence_index") - F.col("b_harmful_convergence_index")).alias("hci_delta"), ratio(F.col("a_intervention_recipients"), F.col("b_intervention_recipients")).alias("recipient_ratio"),
    )


def synthesis(studies: dict[str, DataFrame]) -> DataFrame:
    """Rows of several studies with their name in front, columns that one lacks as NULL, and the variant's family and provider.

    A variant is family__provider, with an optional replay_ in front of the provider.
    """
    out: DataFrame | None = None
    for name, df in studies.items():
        one = df.select(F.lit(name).alias("study"), "*")
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no studies")
    parts = F.split("variant_name", "__")
    provider = F.coalesce(F.get(parts, F.lit(1)), F.lit("none"))
    out = out.withColumn("family", parts[0]).withColumn("is_replay", F.startswith(provider, F.lit("replay_")))
    return out.withColumn("provider", F.regexp_replace(provider, "^replay_", ""))


def flow_comparison(simulated: DataFrame, reference: DataFrame, metrics: Sequence[str] = FLOW_METRICS) -> DataFrame:
    """One-row flow summaries as rows (metric, simulated, reference, delta, pct_delta); NULL percentage for a reference near 0."""
    a = simulated.select(*[num(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "simulated")
    b = reference.select(*[num(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "reference")
    j = a.join(b, "metric").withColumn("delta", F.col("simulated") - F.col("reference"))
    return j.withColumn("pct_delta", F.when(F.abs("reference") > 1e-12, pct_abs(F.col("reference"), F.col("simulated"))))


def density_band(density: Column, bands: Sequence[tuple[str, float, float | None]]) -> Column:
    """The first band that holds a density, low end included; out_of_range for none."""
    out: Column | None = None
    for name, low, high in bands:
        inside = (density >= low) & (F.lit(True) if high is None else density < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return F.lit("out_of_range") if out is None else out.otherwise("out_of_range")


def travel_times_by_density(samples: DataFrame, crossings: DataFrame, radius: float, bands: Sequence[tuple[str, float, float | None]], slack: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Per crossing agent: time from its first sample to the crossing, and the density around the crossing's place at the nearest sample time.

    crossings: keys (of runs), agent_id, crossing_time_s, midpoint_x, midpoint_y. The nearest time (the earlier of two) is looked for in buckets of
    `slack` seconds, which must be at least the time between samples; samples of that time are then counted by an equi-join on run, time and cells as
    wide as the radius, so that a time with many samples is not one key. Nobody near is a density of 0.
    """
    agent = [*keys, "agent_id"]
    times = samples.select(*keys, "time_s").distinct()
    asked = crossings.select(*agent, "crossing_time_s", F.explode(F.array(*[F.floor(F.col("crossing_time_s") / slack) + d for d in (-1, 0, 1)])).alias("_b"))
    j = asked.join(times.withColumn("_b", F.floor(F.col("time_s") / slack)), [*keys, "_b"])
    near = j.groupBy(*agent).agg(F.min_by("time_s", F.struct(F.abs(F.col("time_s") - F.col("crossing_time_s")), "time_s")).alias("near_s"))
    around = F.explode(F.array(*[F.struct((F.floor(F.col("midpoint_x") / radius) + dx).alias("bx"), (F.floor(F.col("midpoint_y") / radius) + dy).alias("by")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    at = crossings.join(near, agent)
    asked = at.withColumn("_c", around).withColumns({"_bx": F.col("_c.bx"), "_by": F.col("_c.by")}).drop("_c")
    seen = samples.select(*keys, F.col("time_s").alias("near_s"), "x", "y", F.floor(F.col("x") / radius).alias("_bx"), F.floor(F.col("y") / radius).alias("_by"))
    d2 = (F.col("x") - F.col("midpoint_x")) ** 2 + (F.col("y") - F.col("midpoint_y")) ** 2
    found = asked.join(seen, [*keys, "near_s", "_bx", "_by"]).filter(d2 <= radius * radius).groupBy(*agent).agg(F.count(F.lit(1)).alias("_n"))
    inside = at.join(found, agent, "left").select(*agent, (F.coalesce("_n", F.lit(0)) / F.lit(3.141592653589793 * radius * radius)).alias("local_density_ped_m2"))
    first = samples.groupBy(*agent).agg(F.min("time_s").alias("entry_time_s"))
    out = crossings.select(*agent, "crossing_time_s").join(first, agent).join(inside, agent)
    return out.withColumn("travel_time_s", F.col("crossing_time_s") - F.col("entry_time_s")).withColumn("density_band", density_band(F.col("local_density_ped_m2"), bands))
