"""Roll-ups over run tables: levels, subgroups, comparisons, costs, cross-tabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.functions.nullsafe import num, or_zero, pct_guarded, pearson, quantile, ratio, std_pop, truthy
from egresslake.functions.text import cost_usd, reasons
from egresslake.operators.ordered import quantiles, running_sums

# Fixed values of the subgroup masks.
IMPAIRED_FROM, LOW_FAMILIARITY, HIGH_FAMILIARITY = 0.1, 0.33, 0.67
HERDING_GINI, SLOWER_SCORE, LANE_CV = 0.6, 0.4, 1.5


def summary_levels(runs: DataFrame, key: str, metrics: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Rows per key and one for all: run_count, mean and population deviation of each metric. NULL keys are left out."""
    aggs = [a for m in metrics for a in (F.avg(num(m)).alias(m), std_pop(m).alias(f"{m}_std"))]
    r = runs.filter(F.col(key).isNotNull()).rollup(key).agg(F.grouping(key).alias("_all"), F.count(F.lit(1)).alias("run_count"), *aggs, *extra)
    kind = F.when(F.col("_all") == 1, "study_aggregate").otherwise("variant_aggregate")
    return r.withColumn("record_type", kind).drop("_all")


def time_series(rows: DataFrame, key: Column, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric by time key."""
    return rows.groupBy(key).agg(*[F.avg(num(m)).alias(m) for m in metrics])


def subgroup_masks(impairment: Column, age_band: Column, familiarity: Column, elderly: Sequence[str] = ("elderly", "older_adult", "senior")) -> Column:
    """All subgroups that a row falls in, as an array of (type, tag); masks overlap."""
    age = F.coalesce(age_band, F.lit(""))
    old = age.isin(*elderly)
    masks = [
        ("impairment", "impaired", impairment >= IMPAIRED_FROM), ("impairment", "not_impaired", ~F.coalesce(impairment >= IMPAIRED_FROM, F.lit(False))),
        ("age", "elderly", old), ("age", "non_elderly", (age != "") & ~old), ("age", "unknown_age", age == ""),
        ("familiarity_prior", "low_familiarity", familiarity < LOW_FAMILIARITY),
        ("familiarity_prior", "medium_familiarity", (familiarity >= LOW_FAMILIARITY) & (familiarity < HIGH_FAMILIARITY)),
        ("familiarity_prior", "high_familiarity", familiarity >= HIGH_FAMILIARITY), ("familiarity_prior", "unknown_familiarity", familiarity.isNull()),
    ]
    return F.array_compact(F.array(*[F.when(m, F.struct(F.lit(a).alias("type"), F.lit(b).alias("tag"))) for a, b, m in masks]))


def equity_subgroups(agents: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per run and overlapping subgroup: counts, rates, travel and exposure, and gaps against the run; empty subgroups are left out.

    Columns: evacuated, travel_time_s, hazard_exposure, impairment, age_band, familiarity; responders and
    hostiles (is_responder, is_hostile) are not counted.
    """
    a = agents
    for flag in ("is_responder", "is_hostile"):
        if flag in a.columns:
            a = a.filter(~truthy(F.col(flag)))
    a = a.withColumn("evacuated", truthy(F.col("evacuated")))
    done = F.when(F.col("evacuated"), num("travel_time_s"))
    whole = a.groupBy(*run).agg(F.avg(F.col("evacuated").cast("double")).alias("run_evacuation_rate"), or_zero(F.avg(done)).alias("run_mean_travel_time_s"))
    e = a.withColumn("g", F.explode(subgroup_masks(num("impairment"), F.col("age_band"), num("familiarity"))))
    g = e.groupBy(*run, F.col("g.type").alias("subgroup_type"), F.col("g.tag").alias("subgroup_tag")).agg(
        F.count(F.lit(1)).alias("agent_count"), F.count_if("evacuated").alias("evacuated_count"), F.count_if(~F.col("evacuated")).alias("remaining_count"),
        F.avg(F.col("evacuated").cast("double")).alias("evacuation_rate"), or_zero(F.avg(done)).alias("mean_travel_time_s"), or_zero(F.percentile(done, 0.95)).alias("p95_travel_time_s"),
        or_zero(F.avg(num("hazard_exposure"))).alias("mean_hazard_exposure"), or_zero(quantile("hazard_exposure", 0.95)).alias("p95_hazard_exposure"),
        F.avg(num("impairment")).alias("mean_impairment"), or_zero(F.avg(num("familiarity"))).alias("mean_familiarity"),
    )
    g = g.join(whole, list(run)) if run else g.crossJoin(F.broadcast(whole))  # one row
    gap = F.col("mean_travel_time_s") - F.col("run_mean_travel_time_s")
    return g.withColumn("evacuation_rate_gap_vs_run", F.col("evacuation_rate") - F.col("run_evacuation_rate")).withColumn("travel_time_gap_vs_run_s", gap).withColumn("equity_time_gap_s", F.abs(gap))


def run_metrics(runs: DataFrame, key: str) -> DataFrame:
    """Per key: counts, mean, p50, p95 and gap of travel, exit shares (dominant exit, largest share, share spread)."""
    base = runs.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.avg("travel").alias("mean_travel")).join(quantiles(runs, [key], "travel", {"p50_travel": 0.5, "p95_travel": 0.95}), key, "left")
    per = runs.groupBy(key, "exit").agg(F.count(F.lit(1)).alias("n"))
    shares = per.groupBy(key).agg(
        F.max_by("exit", F.struct("n", "exit")).alias("dominant_exit"), (F.max("n") / F.sum("n")).alias("dominant_share"), ((F.max("n") - F.min("n")) / F.sum("n")).alias("share_spread")
    )
    return base.withColumn("travel_gap", F.col("p95_travel") - F.col("p50_travel")).join(shares, key)


def left_behind_index(agents: DataFrame, run: str, cohort: str, evacuated: Column) -> DataFrame:
    """Per run: spread of the cohorts' share of agents that did not get out; 0 for one cohort."""
    c = agents.groupBy(run, cohort).agg(F.avg((~evacuated).cast("double")).alias("rate"))
    return c.groupBy(run).agg(F.when(F.count(F.lit(1)) > 1, F.max("rate") - F.min("rate")).otherwise(0.0).alias("left_behind_index"))


def exposure_maps(agents: DataFrame, run: str, by: str, value: str) -> DataFrame:
    """Per run a JSON map from group to mean, sorted by group."""
    m = agents.groupBy(run, by).agg(F.round(F.avg(num(value)), 6).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("key"), F.col("v").alias("value"))))
    return m.groupBy(run).agg(F.to_json(F.map_from_entries(entries)).alias(f"{value}_by_{by}"))


def compare_rows(baseline: DataFrame, variant: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two one-row frames as rows (metric, baseline, variant, delta, pct_change)."""
    a = baseline.select(*[num(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "baseline")
    b = variant.select(*[num(m).alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "variant")
    return a.join(b, "metric").withColumn("delta", F.col("variant") - F.col("baseline")).withColumn("pct_change", pct_guarded(F.col("baseline"), F.col("variant")))


def gini(counts: DataFrame, group: Sequence[str], n: str) -> DataFrame:
    """Gini of counts per group, (m + 1 - 2 sum of running totals / total) / m; 0 for one member; herding flag."""
    c = running_sums(counts.groupBy(*group, n).agg(F.count(F.lit(1)).alias("_m")), group, n, {"t": F.col(n) * F.col("_m")})
    run = F.col("t_below") * F.col("_m") + F.col(n) * F.col("_m") * (F.col("_m") + 1) / 2  # running totals over equal members
    m = F.sum("_m")
    g = F.when(m > 1, or_zero((m + 1 - 2 * ratio(F.sum(run), F.sum(F.col(n) * F.col("_m")))) / m)).otherwise(0.0)
    return c.groupBy(*group).agg(m.alias("members"), g.alias("gini")).withColumn("herding", F.col("gini") > HERDING_GINI)


def faster_is_slower(rows: DataFrame, group: Sequence[str], queue: str, dwell: str, outflow: str) -> DataFrame:
    """Half the queue-dwell correlation less half the queue-outflow one; 0 under ten rows."""
    score = 0.5 * pearson(F.col(queue), F.col(dwell)) - 0.5 * pearson(F.col(queue), F.col(outflow))
    return rows.groupBy(*group).agg(F.when(F.count(F.lit(1)) >= 10, score).otherwise(0.0).alias("score")).withColumn("detected", F.col("score") > SLOWER_SCORE)


def lane_index(cells: DataFrame, group: Sequence[str], usage: str) -> DataFrame:
    """Sample deviation over mean of the cells' largest usage."""
    peak = cells.groupBy(*group, "x", "y").agg(F.max(usage).alias("peak"))
    return peak.groupBy(*group).agg(F.count(F.lit(1)).alias("cells"), or_zero(ratio(F.stddev_samp("peak"), F.avg("peak"))).alias("lane_index")).withColumn("lanes", F.col("lane_index") > LANE_CV)


def cost_report(calls: DataFrame, keys: Sequence[str], tokens_in: str, tokens_out: str, usd_in: float, usd_out: float) -> DataFrame:
    """Totals by keys (NULL kept) and in all, where keys read ALL."""
    i, o = or_zero(num(tokens_in)), or_zero(num(tokens_out))
    aggs = (F.count(F.lit(1)).alias("calls"), F.sum(i).alias("input_tokens"), F.sum(o).alias("output_tokens"), F.sum(cost_usd(i, o, usd_in, usd_out)).alias("usd"))
    rows = calls.groupBy(*keys).agg(*aggs)
    return rows.unionByName(calls.agg(*aggs).select(*[F.lit("ALL").alias(k) for k in keys], "calls", "input_tokens", "output_tokens", "usd"))


def usage_sets(records: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Grouping sets: the full key set (NULL kept) and ALL."""
    r = records.rollup(*keys).agg(F.grouping_id(*keys).alias("_g"), *aggs)
    full = 2 ** len(keys) - 1
    r = r.filter(F.col("_g").isin(0, full))
    return r.select(*[F.when(F.col("_g") == full, "ALL").otherwise(F.col(k)).alias(k) for k in keys], *[c for c in r.columns if c not in (*keys, "_g")])


def reason_counts(rows: DataFrame, joined: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows by validation reason; a row without reasons counts as accepted."""
    return rows.withColumn("reason", F.explode(reasons(F.col(joined)))).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))


def generation_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Generated messages: statuses, distinct cache keys, fallbacks, mean confidence, distinct words."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("cache_status") == "hit").alias("hits"), F.count_if(F.col("cache_status") == "miss").alias("misses"),
        F.count_if(F.col("validation_status") == "accepted").alias("accepted"), F.count_if(F.col("validation_status") == "rejected").alias("rejected"),
        F.count_distinct(F.nullif("cache_key", F.lit(""))).alias("cache_keys"), F.count_if(truthy(F.col("used_fallback"))).alias("fallbacks"), F.avg(num("confidence")).alias("mean_confidence"),
    )


def largest_remainder(rows: DataFrame, group: Sequence[str], weight: str, total: Column, order: Sequence[str]) -> DataFrame:
    """Adds allotted: whole parts of total in proportion to weight that add up to it; largest fractions first, then order."""
    w = Window.partitionBy(*group)
    exact = ratio(F.col(weight) * total, F.sum(weight).over(w))
    d = rows.withColumn("_exact", F.coalesce(exact, F.lit(0.0))).withColumn("_floor", F.floor("_exact").cast("long"))
    d = d.withColumn("_left", total - F.sum("_floor").over(w))
    d = d.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *order)))
    return d.withColumn("allotted", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_exact", "_floor", "_left", "_rank")


def top_k(rows: DataFrame, group: Sequence[str], score: Column, k: int | Column, order: Sequence[str], positive: bool = False) -> DataFrame:
    """The k rows of each group with the highest score, ties by order; optionally only scores over 0."""
    d = rows.withColumn("score", score)
    d = d.filter("score > 0") if positive else d
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), *order))).filter(F.col("place") <= k)


def dense_flow(events: DataFrame, steps: DataFrame, exits: DataFrame, step: str, exit_: str) -> DataFrame:
    """Every exit at every step: flow_step and flow_cumulative."""
    n = events.groupBy(step, exit_).agg(F.count(F.lit(1)).alias("flow_step"))
    d = steps.crossJoin(bounded(exits)).join(n, [step, exit_], "left").withColumn("flow_step", F.coalesce("flow_step", F.lit(0)))
    return d.withColumn("flow_cumulative", F.sum("flow_step").over(Window.partitionBy(exit_).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def congested(flows: DataFrame, group: Sequence[str], flow: str, share: float = 0.5) -> DataFrame:
    """Members with at least so much of their group's flow."""
    return flows.withColumn("share", ratio(F.col(flow), F.sum(flow).over(Window.partitionBy(*group)))).filter(F.col("share") >= share)


def cell_grid(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and cell: occupancy, mean speed; cells without any are left out."""
    d = samples.withColumn("cx", F.floor("x").cast("int")).withColumn("cy", F.floor("y").cast("int"))
    return d.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("occupancy"), F.avg("speed").alias("mean_speed"))


def path_usage(grid: DataFrame, run: Sequence[str], step: str) -> DataFrame:
    """Adds path_usage: occupancy added up over the steps so far, per cell."""
    return grid.withColumn("path_usage", F.sum("occupancy").over(Window.partitionBy(*run, "cx", "cy").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))


def validation_runs(runs: DataFrame, keys: Sequence[str], passed: Column, value: str) -> DataFrame:
    """Distinct seeds, passes, range, mean and 95 % half width (1.96 s / sqrt n; 0 for one run) per case."""
    half = or_zero(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)))
    return runs.groupBy(*keys).agg(
        F.count_distinct("seed").alias("seed_count"), F.count_if(passed).alias("pass_count"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), half.alias("ci95")
    )
