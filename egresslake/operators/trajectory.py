"""Trajectories: motion per sample, summaries, line crossings, flow, measurement lines, dwell.

Windows are partitioned by agent (and group), so a task holds one agent's samples at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, pct_abs, ratio
from egresslake.functions.scalars import signed_distance
from egresslake.operators.graph import cut
from egresslake.operators.ordered import quantiles

REQUIRED = ("agent_id", "time_s", "x", "y")
SUMMARY = ("agent_count", "sample_count", "duration_s", "mean_agent_duration_s", "mean_path_length_m", "p95_path_length_m", "mean_displacement_m", "mean_speed_mps", "p95_speed_mps", "mean_local_density", "p95_local_density")
#: Half width that a crossing's midpoint may lie beyond the ends of a line.
SLACK = 0.5


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def per_agent(keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")):
    return Window.partitionBy(*keys).orderBy(*order)


def with_motion(df: DataFrame, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """Adds dist_m, dt_s and speed_mps since the agent's sample before; NULL for the first, speed NULL for no time."""
    w = per_agent(keys, order)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    df = df.withColumn("dist_m", F.sqrt(dx * dx + dy * dy)).withColumn("dt_s", F.col("time_s") - F.lag("time_s").over(w))
    return df.withColumn("speed_mps", ratio(F.col("dist_m"), F.when(F.col("dt_s") > 0, F.col("dt_s"))))


def agent_paths(df: DataFrame, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """Per agent: samples, first and last time, path length, displacement."""
    return _paths(with_motion(df, keys, order), keys, order)


def _paths(m: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    at = F.struct(*order)
    return m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"),
        F.coalesce(F.sum("dist_m"), F.lit(0.0)).alias("path_m"),
        F.min_by(F.struct("x", "y"), at).alias("a"), F.max_by(F.struct("x", "y"), at).alias("b"),
    ).withColumn("displacement_m", F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)).drop("a", "b")


def trajectory_summary(df: DataFrame, group: Sequence[str] = (), speed: str | None = None) -> DataFrame:
    """One row per group: agents, samples, durations, path, displacement, speed and density figures.

    speed names a column to use instead of the derived speed; local_density is used where it is there.
    """
    require_columns(df)
    order = ("time_s", "event_id") if "event_id" in df.columns else ("time_s",)
    keys = (*group, "agent_id")
    v = num(speed) if speed else F.col("speed_mps")
    density = num("local_density") if "local_density" in df.columns else F.lit(None).cast("double")
    m = cut(with_motion(df, keys, order).select(*keys, *order, "x", "y", "dist_m", v.alias("_speed"), density.alias("_density")))  # the motion of a sample, made once
    paths = _paths(m, keys, order)
    figures = paths.groupBy(*group).agg(
        F.count(F.lit(1)).alias("agent_count"), F.sum("samples").alias("sample_count"),
        (F.max("last_s") - F.min("first_s")).alias("duration_s"), F.avg(F.col("last_s") - F.col("first_s")).alias("mean_agent_duration_s"),
        F.avg("path_m").alias("mean_path_length_m"), F.avg("displacement_m").alias("mean_displacement_m"),
    )
    rates = m.groupBy(*group).agg(F.avg("_speed").alias("mean_speed_mps"), F.avg("_density").alias("mean_local_density"))
    long = paths.select(*group, F.lit("path").alias("_kind"), F.col("path_m").alias("_v")).unionByName(m.select(*group, F.lit("speed").alias("_kind"), F.col("_speed").alias("_v")))
    long = long.unionByName(m.select(*group, F.lit("density").alias("_kind"), F.col("_density").alias("_v"))) if "local_density" in df.columns else long
    q = quantiles(long, [*group, "_kind"], "_v", {"_q": 0.95})
    q = q.groupBy(*group).agg(*[F.max(F.when(F.col("_kind") == k, F.col("_q"))).alias(n) for k, n in (("path", "p95_path_length_m"), ("speed", "p95_speed_mps"), ("density", "p95_local_density"))])
    out = null_safe_join(figures, rates, group) if group else figures.crossJoin(rates)
    out = null_safe_join(out, q, group, "left") if group else out.crossJoin(q)
    return out.select(*group, *SUMMARY)


def null_safe_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys once."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return a.join(b, cond, how).drop(*[f"_r_{c}" for c in on])


#: The metrics that a comparison has by default; SUMMARY are all eleven.
METRICS = ("duration_s", "mean_agent_duration_s", "mean_path_length_m", "p95_path_length_m", "mean_displacement_m", "mean_speed_mps", "p95_speed_mps")


def compare_trajectories(simulated: DataFrame, reference: DataFrame, group: Sequence[str] = ("variant_name",), metrics: Sequence[str] = METRICS, speed: str | None = None) -> DataFrame:
    """Long rows per group and metric: simulated, reference, delta, pct_delta (NULL for a reference of 0)."""
    doubles = [F.col(c).cast("double").alias(c) for c in metrics]
    sim = trajectory_summary(simulated, group, speed).select(*group, *doubles).unpivot(list(group), list(metrics), "metric", "simulated")
    ref = trajectory_summary(reference, (), speed).select(*doubles).unpivot([], list(metrics), "metric", "reference")
    return sim.join(ref, "metric").withColumn("delta", F.col("simulated") - F.col("reference")).withColumn("pct_delta", pct_abs(F.col("reference"), F.col("simulated")))


def crossings(df: DataFrame, p1: tuple[float, float], p2: tuple[float, float], keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """Samples at which an agent has changed sides of the line near its segment."""
    side, along, length = signed_distance(F.col("x"), F.col("y"), p1, p2)
    w = per_agent(keys, order)
    d = df.withColumn("side", side).withColumn("along", along)
    d = d.withColumn("crossed", (F.lag("side").over(w) * F.col("side") < 0) & ((F.lag("along").over(w) + F.col("along")) / 2).between(-SLACK, length + SLACK))
    return d.withColumn("before_s", F.lag("time_s").over(w)).filter("crossed").drop("side", "along", "crossed")


def first_crossings(df: DataFrame, p1: tuple[float, float], p2: tuple[float, float], keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """(keys, crossing_time_s, previous_time_s): each agent's first crossing."""
    c = crossings(df, p1, p2, keys, order)
    return c.groupBy(*keys).agg(F.min(F.struct(*order, "before_s")).alias("f")).select(*keys, F.col("f.time_s").alias("crossing_time_s"), F.col("f.before_s").alias("previous_time_s"))


def headways(first: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Adds headway_s: time since the crossing before, within the group."""
    w = Window.partitionBy(*group).orderBy("crossing_time_s", "agent_id")
    return first.withColumn("headway_s", F.col("crossing_time_s") - F.lag("crossing_time_s").over(w))


def flow_summary(df: DataFrame, p1: tuple[float, float], p2: tuple[float, float], group: Sequence[str] = ()) -> DataFrame:
    """Per group: agents, samples, crossings, first and last crossing, flow n / (last - first), mean headway (that span / (n - 1))."""
    keys = (*group, "agent_id")
    size = df.groupBy(*group).agg(F.count_distinct("agent_id").alias("agents"), F.count(F.lit(1)).alias("samples"))
    c = first_crossings(df, p1, p2, keys).groupBy(*group).agg(F.count(F.lit(1)).alias("crossings"), F.min("crossing_time_s").alias("first_s"), F.max("crossing_time_s").alias("last_s"))
    span = F.when(F.col("last_s") > F.col("first_s"), F.col("last_s") - F.col("first_s"))
    c = c.withColumn("mean_flow_per_s", ratio(F.col("crossings"), span)).withColumn("mean_headway_s", ratio(F.col("last_s") - F.col("first_s"), F.when(F.col("crossings") > 1, F.col("crossings") - 1)))
    return null_safe_join(size, c, group, "left") if group else size.crossJoin(c)


def measurement_line(df: DataFrame, step: str, dt: float, p1: tuple[float, float], p2: tuple[float, float], depth: float, name: str = "line") -> DataFrame:
    """Per step: n_crossing, flow, n_in_region, density and mean speed in the rectangle around a line."""
    side, along, length = signed_distance(F.col("x"), F.col("y"), p1, p2)
    w = per_agent()
    d = df.withColumn("side", side).withColumn("along", along)
    crossed = (F.lag("side").over(w) * F.col("side") < 0) & ((F.lag("along").over(w) + F.col("along")) / 2).between(-SLACK, length + SLACK)
    inside = (F.abs("side") <= depth) & F.col("along").between(-SLACK, length + SLACK)
    d = d.withColumn("crossed", F.coalesce(crossed, F.lit(False))).withColumn("inside", inside)
    area = (length + 2 * SLACK) * 2 * depth
    return d.groupBy(step).agg(
        F.lit(name).alias("line_name"), F.count_if("crossed").alias("n_crossing"), (F.count_if("crossed") / dt).alias("flow"),
        F.count_if("inside").alias("n_in_region"), (F.count_if("inside") / area).alias("density"), F.coalesce(F.avg(F.when(F.col("inside"), F.col("speed"))), F.lit(0.0)).alias("mean_speed"),
    )


def zone_visits(df: DataFrame, zone: str, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """Gaps and islands: one row per unbroken stay of an agent in a zone, with enter_s, exit_s (the next stay's start) and dwell_s."""
    w = per_agent(keys, order)
    d = df.withColumn("new", F.coalesce((F.col(zone) != F.lag(zone).over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("visit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = d.groupBy(*keys, "visit").agg(F.first(zone).alias(zone), F.min("time_s").alias("enter_s"), F.count(F.lit(1)).alias("samples"))
    v = v.withColumn("exit_s", F.lead("enter_s").over(Window.partitionBy(*keys).orderBy("visit")))
    return v.withColumn("dwell_s", F.col("exit_s") - F.col("enter_s"))


def rolling_mean(value: Column, keys: Sequence[str], order: Sequence[str], rows: int = 5) -> Column:
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0))


def trails(df: DataFrame, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id"), rows: int = 8) -> DataFrame:
    """Adds trail: the last positions up to the sample."""
    return df.withColumn("trail", F.collect_list(F.array("x", "y")).over(per_agent(keys, order).rowsBetween(1 - rows, 0)))


def dose(df: DataFrame, load: str, dt: str, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s", "event_id")) -> DataFrame:
    """Adds dose (running sum of load x dt) and peak (running maximum of load)."""
    w = per_agent(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("dose", F.sum(F.col(load) * F.col(dt)).over(w)).withColumn("peak", F.max(load).over(w))


#: Changes since the sample before that make an agent look for a new way.
VISIBILITY_DROP, FLOOD_RISE, HAZARD_RISE = 0.35, 0.2, 0.3


def replan_reasons(df: DataFrame, keys: Sequence[str] = ("agent_id",), order: Sequence[str] = ("time_s",)) -> DataFrame:
    """Adds reason, the first that holds: blocked_path, topology_changed, visibility_drop, flood_depth_rise, hazard_spike, belief_update; NULL for none.

    Changes are since the agent's sample before (clear sight, no flood, no load before the first). Columns that are not there hold for nobody:
    path_blocked; navigation_topology_revision (negative: none yet) and topology_revision; navigation_belief_step (negative: none yet) and belief_step;
    visibility; flood_depth_m; hazard_load.
    """
    w = per_agent(keys, order)
    have = set(df.columns)

    def change(c: str, first: float) -> Column:
        return F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(first)) if c in have else F.lit(None).cast("double")

    def newer(now: str, seen: str) -> Column:
        return (F.col(seen) >= 0) & (F.col(now) > F.col(seen)) if {now, seen} <= have else F.lit(False)

    blocked = F.coalesce(F.col("path_blocked"), F.lit(False)) if "path_blocked" in have else F.lit(False)
    return df.withColumn(
        "reason",
        F.when(blocked, "blocked_path").when(newer("topology_revision", "navigation_topology_revision"), "topology_changed").when(-change("visibility", 1.0) >= VISIBILITY_DROP, "visibility_drop")
        .when(change("flood_depth_m", 0.0) >= FLOOD_RISE, "flood_depth_rise").when(change("hazard_load", 0.0) >= HAZARD_RISE, "hazard_spike").when(newer("belief_step", "navigation_belief_step"), "belief_update"),
    )
