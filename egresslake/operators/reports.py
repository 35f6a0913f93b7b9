"""Tables behind reports: intents per cell, fixed claims, calibration status, cascades, projections, keyframes, frontier and equity rows, prompts and hostile claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import clip, num, or_zero, ratio, truthy
from egresslake.functions.text import attack_reasons
from egresslake.operators.figures import calibration_score
from egresslake.operators.trajectory import rolling_mean

INTENT_KEYS = ("study_name", "scenario_name", "variant_name", "seed", "run_id", "step", "time_s", "floor_id", "z", "x", "y", "intent")
# The claims that are compared by default (claim, study, baseline, test), their metrics, and those of which less is better.
CLAIMS = (
    ("sparse_safety_vs_static", "prompt_objective", "static_beacon", "llm_openai_safety"),
    ("sparse_safety_vs_entropy", "prompt_objective", "entropy_targeted", "llm_openai_safety"),
    ("sparse_safety_vs_bottleneck", "prompt_objective", "bottleneck_avoidance", "llm_openai_safety"),
    ("hazard_prompt_vs_safety_prompt", "prompt_objective", "llm_openai_safety", "llm_openai_hazard_avoidance"),
    ("anti_convergence_prompt_vs_safety_prompt", "prompt_objective", "llm_openai_safety", "llm_openai_anti_convergence"),
    ("urgency_prompt_vs_safety_prompt", "prompt_objective", "llm_openai_safety", "llm_openai_urgency"),
    ("static_budget_vs_sparse_llm", "budget_equivalence", "llm_openai_sparse", "llm_openai_static_equivalent"),
    ("entropy_budget_vs_sparse_llm", "budget_equivalence", "llm_openai_sparse", "llm_openai_entropy_equivalent"),
)
CLAIM_METRICS = ("information_safety_efficiency", "harmful_convergence_index", "agents_evacuated", "intervention_recipients")
# Greatest errors in percent of flow, headway and crossings for a match; entropy rate of a cascade and steps that it needs.
MATCH = (15.0, 25.0, 10.0)
CASCADE_RATE, CASCADE_STEPS = 0.1, 5
# Effects of a message on belief, convergence and exposure, by its kind and (last) where hazards are known.
EFFECTS = {"avoid_hazard": (0.14, -0.06, -0.22), "shelter_hold": (0.05, 0.05, 0.10), "all_clear": (0.08, -0.02, -0.03), "route_guidance": (0.18, -0.10, -0.12)}
EFFECTS_NEAR_HAZARDS = {"all_clear": (0.08, 0.02, 0.08)}
FRONTIER = ("information_safety_efficiency", "harmful_convergence_index", "exit_imbalance")
# Fields that a prompt keeps, by style; other styles keep all.
STATE_FIELDS = ("exits", "hazards", "congested_exits")
LOAD_FIELDS = ("recipients_estimate", "mean_local_density", "mean_hazard_load")
PROMPT_FIELDS = {
    "minimal": STATE_FIELDS,
    "state_only": ("target", *STATE_FIELDS, *LOAD_FIELDS),
    **{s: ("policy", "step", "target", "selected_reason", "objective", *STATE_FIELDS, *LOAD_FIELDS) for s in ("anti_convergence", "hazard_avoidance", "urgency", "responder_coordination")},
}
CONTROLLED = ("anti_convergence", "hazard_avoidance", "urgency", "responder_coordination")
THREAT = "threat_amplification"


def intent_counts(rows: DataFrame, count: str = "count", keys: Sequence[str] = INTENT_KEYS) -> DataFrame:
    """Counts per cell, step and intent, in the order of run, step, floor, y, x, intent. NULL keys are a group of their own."""
    order = [k for k in ("run_id", "step", "floor_id", "y", "x", "intent") if k in keys]
    return rows.groupBy(*keys).agg(F.sum(count).alias("count")).orderBy(*order)


def default_claims(spark: SparkSession) -> DataFrame:
    """(claim, study, baseline, test) of the fixed claims, for comparison.compare_claims study by study."""
    return spark.createDataFrame(list(CLAIMS), "claim string, study string, baseline string, test string")


def calibration_results(comparison: DataFrame, candidate: Sequence[str]) -> DataFrame:
    """Per candidate: score, claim_status and the three errors, from long rows (candidate, metric, simulated, reference, pct_delta); best score first."""
    names = {"mean_flow_ped_s": "mean_flow", "mean_time_headway_s": "mean_time_headway", "crossing_count": "crossing_count"}
    picks = [F.max(F.when(F.col("metric") == m, F.col("pct_delta"))).alias(f"{n}_pct_delta") for m, n in names.items()]
    picks += [F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{s}_{n}") for m, n in names.items() for s in ("simulated", "reference")]
    g = comparison.groupBy(*candidate).agg(*picks)
    flow, headway, crossing = (F.col(f"{n}_pct_delta") for n in names.values())
    match = (F.abs(flow) <= MATCH[0]) & (F.abs(headway) <= MATCH[1]) & (F.abs(crossing) <= MATCH[2])
    g = g.withColumn("calibration_score", calibration_score(flow, headway, crossing))
    return g.withColumn("claim_status", F.when(match, "calibrated_bottleneck_flow_match").otherwise("diagnostic_gap")).orderBy(F.asc_nulls_last("calibration_score"), *candidate)


def information_cascades(steps: DataFrame, run: Sequence[str] = ("run_id",), entropy: str = "global_entropy") -> DataFrame:
    """Per run: detected, max_cascade_rate (greatest fall of smoothed entropy a second). Runs of under CASCADE_STEPS steps have none."""
    w = Window.partitionBy(*run).orderBy("step")
    d = steps.withColumn("_h", rolling_mean(num(entropy), run, ["step"], 5)).withColumn("_dt", F.col("time_s") - F.lag("time_s").over(w))
    d = d.withColumn("_rate", F.when(F.col("_dt") > 0, -(F.col("_h") - F.lag("_h").over(w)) / F.col("_dt")).when(F.col("_dt").isNotNull(), 0.0))
    g = d.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"), F.max("_rate").alias("_most"), F.coalesce(F.bool_or(F.col("_dt") > 0), F.lit(False)).alias("_moves"))
    rate = F.when((F.col("_n") >= CASCADE_STEPS) & F.col("_moves"), or_zero(F.col("_most"))).otherwise(0.0)
    return g.withColumn("max_cascade_rate", rate).withColumn("detected", F.col("max_cascade_rate") > CASCADE_RATE).drop("_n", "_most", "_moves")


def message_projection(agents: DataFrame, hazards: DataFrame, message: Mapping) -> DataFrame:
    """One row: what a message (x, y, z, radius, credibility, horizon_steps, kind) would do: recipients, belief, convergence and exposure deltas.

    hazards (hx, hy, hz, radius, severity) are the scenario's own; the strongest counts for each recipient. No recipients: all 0.
    """
    radius, credibility = max(0.1, float(message.get("radius", 1.0))), min(1.0, max(0.0, float(message.get("credibility", 1.0))))
    horizon = min(1.0, max(1, int(message.get("horizon_steps", 60))) / 60.0)
    kind = str(message.get("kind") or "route_guidance")
    near = {**EFFECTS, **EFFECTS_NEAR_HAZARDS}
    some = hazards.agg(F.collect_list(F.struct("hx", "hy", "hz", F.greatest(F.lit(0.1), F.col("radius")).alias("r"), "severity")).alias("_h"))  # a scenario's own
    at = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "y", "z")]
    target = [float(message.get(c, 0.0)) for c in ("x", "y", "z")]

    def apart(a: Sequence[Column], b: Sequence) -> Column:
        return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a, b, strict=True)), F.lit(0.0)))

    d = agents.crossJoin(F.broadcast(some)).withColumn("_in", apart(at, target) <= radius)
    pressure = F.aggregate("_h", F.lit(0.0), lambda m, h: F.greatest(m, F.greatest(F.lit(0.0), 1 - apart(at, (h["hx"], h["hy"], h["hz"])) / h["r"]) * h["severity"]))
    inside = F.col("_in")
    g = d.withColumn("_p", pressure).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("recipients"), or_zero(F.avg(F.when(inside, F.col("_p")))).alias("p"), or_zero(F.avg(F.when(inside, F.coalesce(num("entropy"), F.lit(0.0))))).alias("u"),
        F.coalesce(F.max(F.size("_h")), F.lit(0)).alias("hazards"),
    )
    belief, hci, exposure = (F.when(F.col("hazards") > 0, near.get(kind, EFFECTS["route_guidance"])[k]).otherwise(EFFECTS.get(kind, EFFECTS["route_guidance"])[k]) for k in range(3))
    effect = credibility * horizon * or_zero(ratio(F.col("recipients"), F.col("n")))
    some = F.col("recipients") > 0

    def out(c: Column, name: str) -> Column:
        return F.when(some, F.round(c, 6)).otherwise(0.0).alias(name)

    return g.select(
        "recipients", out(belief * credibility * horizon * (0.5 + F.col("u")), "mean_belief_delta"), out(hci * effect * (1 + F.col("p")), "harmful_convergence_delta"), out(exposure * effect * (0.25 + F.col("p")), "exposure_delta")
    )


def keyframe_points(agent_steps: DataFrame, value: str = "entropy", run: str = "run_id") -> DataFrame:
    """(run, step, agent_id, x, y, value) of each run's first, middle and last distinct step."""
    w = Window.partitionBy(run)
    s = agent_steps.select(run, "step").distinct().withColumn("_i", F.row_number().over(w.orderBy("step")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))  # a row per step
    s = s.filter((F.col("_i") == 0) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1)).select(run, "step")
    return agent_steps.join(s, [run, "step"], "left_semi").select(run, "step", "agent_id", "x", "y", F.col(value).alias("value"))


def first_events(events: DataFrame, run: str = "run_id", order: Sequence[str] = ("step", "event_id"), most: int = 500) -> DataFrame:
    """The first events of each run, at most so many: a figure's sample."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def frontier_rows(summary: DataFrame) -> DataFrame:
    """(variant_name, metric, value) of the variants' aggregates, for the frontier metrics that are there."""
    there = [m for m in FRONTIER if m in summary.columns]
    return summary.filter("record_type = 'variant_aggregate'").select("variant_name", *[F.col(m).cast("double").alias(m) for m in there]).unpivot(["variant_name"], there, "metric", "value")


def equity_bars(equity: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows of the subgroups that a report shows; all rows where none of those is there."""
    shown = F.col("subgroup_tag").isin(*tags)
    some = equity.agg(F.coalesce(F.bool_or(shown), F.lit(False)).alias("_some"))  # one row
    return equity.crossJoin(F.broadcast(some)).filter(shown | ~F.col("_some")).drop("_some")


def generation_report(rows: DataFrame, keys: Sequence[str] = ("variant_name", "generation_provider", "generation_model")) -> DataFrame:
    """Per keys (NULL a group of its own): events, recipients, cache and validation counts, distinct cache keys, fallbacks, mean confidence, how many different
    exits were recommended and avoided, how often a congested exit was, and mean deltas of entropy and accuracy. Columns that are not there count 0.
    """
    have = set(rows.columns)

    def col(c: str, kind: str = "string") -> Column:
        return F.col(c) if c in have else F.lit(None).cast(kind)

    def tokens(c: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")

    def status(c: str, v: str) -> Column:
        return F.count_if(col(c) == v)

    fallback = F.coalesce(truthy(col("used_fallback")), F.lit(False))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"), F.coalesce(F.sum(num(col("recipients"))), F.lit(0.0)).cast("long").alias("recipients"), status("cache_status", "hit").alias("cache_hits"), status("cache_status", "miss").alias("cache_misses"),
        status("cache_status", "disabled").alias("cache_disabled"), status("validation_status", "accepted").alias("accepted"), status("validation_status", "rejected").alias("rejected"), F.count_distinct(F.nullif(col("cache_key"), F.lit(""))).alias("unique_cache_keys"),
        F.count_if(fallback).alias("fallback_events"), or_zero(F.avg(num(col("generated_confidence")))).alias("mean_generated_confidence"),
        F.size(F.array_distinct(F.flatten(F.collect_set(tokens("generated_recommended_exits"))))).cast("long").alias("recommendation_diversity"), F.size(F.array_distinct(F.flatten(F.collect_set(tokens("generated_avoid_exits"))))).cast("long").alias("avoidance_diversity"),
        F.sum(F.size(F.filter(tokens("validation_reasons"), lambda t: F.startswith(t, F.lit("congested_recommendation"))))).alias("raw_congested_recommendations"),
        F.avg(num(col("entropy_delta"))).alias("mean_entropy_delta"), F.avg(num(col("accuracy_delta"))).alias("mean_accuracy_delta"),
    )
    return out.orderBy(*keys[:2])


def labelled_union(frames: Mapping[str, DataFrame], label: str = "series") -> DataFrame:
    """All rows of named frames with their name; columns that one lacks are NULL."""
    if not frames:
        raise ValueError("no frames")
    out: DataFrame | None = None
    for name, df in frames.items():
        df = df.withColumn(label, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def hazard_config_issues(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    """(id, severity, code, source) of hazard lists in scenario documents (JSON): entries that are no mappings, and lists that are none."""
    v = F.try_parse_json(payload)
    d = rows.select(F.col(id_col), F.try_variant_get(v, "$.hazards", "variant").alias("h"))
    kind = F.coalesce(F.schema_of_variant("h"), F.lit("VOID"))
    items = F.coalesce(F.try_variant_get("h", "$", "array<variant>"), F.array().cast("array<variant>"))
    bad = F.filter(F.transform(items, lambda x, i: F.when(F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)), F.lit(None).cast("string")).otherwise(F.concat(F.lit("hazards["), i.cast("string"), F.lit("]")))), lambda x: x.isNotNull())
    found = F.when(kind == "VOID", F.array().cast("array<string>")).when(~kind.startswith("ARRAY"), F.array(F.lit("hazards"))).otherwise(bad)
    return d.select(id_col, F.lit("error").alias("severity"), F.lit("invalid_hazard_config").alias("code"), F.explode(found).alias("source"))


def floor_tokens(cells: DataFrame, tokens: Mapping[str, str], free: Sequence[str] = ("X",)) -> DataFrame:
    """Per floor: width, height, cells, walkable (not one of `free`'s walls), and a count for each named token."""
    return cells.groupBy("floor_id").agg(
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count(F.lit(1)).alias("cells"), F.count_if(~F.col("token").isin(*free)).alias("walkable"),
        *[F.count_if(F.col("token") == t).alias(n) for n, t in tokens.items()],
    )


def issue_totals(issues: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Findings by keys: all, errors and warnings, and how many kinds."""
    return issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_distinct("code").alias("codes"))


def prompt_payloads(requests: DataFrame, style: str = "prompt_style") -> DataFrame:
    """requests with payload: the JSON of the fields that the prompt's style keeps, fields in order; NULL fields are left out.

    Controlled styles name themselves as control_objective; unknown styles keep all columns.
    """
    every = [c for c in requests.columns if c != style]

    def packed(names: Sequence[str], control: bool) -> Column:
        cols = [F.col(style).alias("prompt_style"), *[F.col(c) for c in names if c in every]]
        return F.to_json(F.struct(*cols, *([F.col(style).alias("control_objective")] if control else [])))

    out = packed(every, False)
    for s, names in PROMPT_FIELDS.items():
        out = F.when(F.col(style) == s, packed(names, s in CONTROLLED)).otherwise(out)
    return requests.withColumn("payload", out)


def hostile_claims(messages: DataFrame) -> DataFrame:
    """messages with claimed_exit, claimed_hazard, reasons and used_fallback.

    A message that abstains, has an attack pattern, or lacks what its objective claims (a hazard for threat amplification, else an exit)
    falls back to fallback_exit and fallback_hazard; the reasons say why. Else the first recommended exit, or hazard position, is claimed.
    """
    threat = F.col("objective") == THREAT
    exit_, hazard = F.get("recommended_exits", F.lit(0)), F.get("hazard_positions", F.lit(0))
    attack = attack_reasons(F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.coalesce("abstain", F.lit(False)), F.array(F.lit("generator_abstained"))).when(F.size(attack) > 0, attack)
        .when(threat & hazard.isNull(), F.array(F.lit("missing_claimed_hazard"))).when(~threat & exit_.isNull(), F.array(F.lit("missing_claimed_exit"))).otherwise(none)
    )
    d = messages.withColumn("reasons", reasons).withColumn("used_fallback", F.size("reasons") > 0)
    back = F.col("used_fallback")
    return d.withColumns({"claimed_exit": F.when(back, F.col("fallback_exit")).when(~threat, exit_), "claimed_hazard": F.when(back, F.col("fallback_hazard")).when(threat, hazard)})


def parameter_profile(base: DataFrame, profile: DataFrame, overrides: DataFrame) -> DataFrame:
    """(profile, name, value, provenance, source): each profile's parameters: an override's value, else its own, else the base profile's.

    base (name, value), profile (profile, name, value, provenance), overrides (profile, name, value). Overrides have no provenance.
    """
    names = profile.select("profile").unionByName(overrides.select("profile")).distinct().crossJoin(F.broadcast(base.select("name", F.col("value").alias("_b"))))  # a handful of parameters
    j = names.join(profile.select("profile", "name", F.col("value").alias("_p"), "provenance"), ["profile", "name"], "left").join(overrides.select("profile", "name", F.col("value").alias("_o")), ["profile", "name"], "left")
    source = F.when(F.col("_o").isNotNull(), "override").when(F.col("_p").isNotNull(), "profile").otherwise("base")
    return j.select("profile", "name", F.coalesce("_o", "_p", "_b").alias("value"), F.when(F.col("_o").isNull(), F.col("provenance")).alias("provenance"), source.alias("source"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, seed, elapsed_s) of a timing table as CSV."""
    df = spark.read.option("header", True).csv(path)
    return df.select("scenario", F.col("seed").try_cast("int").alias("seed"), num("elapsed_s").alias("elapsed_s"))


def timing_markdown(rows: DataFrame, most: float = 0.1) -> str:
    """Markdown of perf_gate rows (scenario, seed, base_s, now_s, pct, status): a line each, and the verdict."""
    got = rows.orderBy("scenario", "seed").collect()  # one row per scenario and seed

    def cell(v: float | None, unit: str) -> str:
        return "n/a" if v is None else f"{v:.3f}{unit}"

    lines = ["| scenario | seed | base | now | change | status |", "| --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r.scenario} | {r.seed} | {cell(r.base_s, ' s')} | {cell(r.now_s, ' s')} | {cell(r.pct, ' %')} | {r.status} |" for r in got]
    slow = sum(r.status == "regression" for r in got)
    return "\n".join([*lines, "", f"{slow} of {len(got)} over {most:.0%}" if slow else f"none of {len(got)} over {most:.0%}"])


def congestion_share(flows: DataFrame, group: Sequence[str], flow: str) -> DataFrame:
    """flows with share, and congested: half of the group's flow or more. Groups without flow have neither."""
    share = ratio(F.col(flow), F.when(F.sum(flow).over(Window.partitionBy(*group)) > 0, F.sum(flow).over(Window.partitionBy(*group))))
    return flows.withColumn("share", clip(share, 0.0, 1.0)).withColumn("congested", F.coalesce(F.col("share") >= 0.5, F.lit(False)))
