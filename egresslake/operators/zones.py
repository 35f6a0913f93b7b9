"""Zone membership and line crossings as facts: who entered, who left, how long they stayed.

A sample is one row per agent and step: keys, step, time_s and the zone that the agent is in (NULL: none, as for inactive
agents). The same facts come from a stream: streaming/ordered_state.py.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import or_zero, ratio
from egresslake.functions.scalars import signed_distance
from egresslake.operators.trajectory import SLACK

KEYS = ("run_id", "agent_id")


def zone_transitions(samples: DataFrame, dt: float, keys: Sequence[str] = KEYS, zone: str = "zone_id", order: Sequence[str] = ("step",)) -> DataFrame:
    """(keys, step, time_s, zone_id, kind, dwell_s): an exit where an agent leaves a zone, an enter where one comes in.

    A change from zone to zone is both, in one step. dwell_s of an exit is (step - step of entry) x dt, at least dt; NULL for an enter.
    An agent still inside at its last sample has no exit.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(zone).over(w)
    first = F.row_number().over(w) == 1
    changed = F.when(first, F.col(zone).isNotNull()).otherwise(~before.eqNullSafe(F.col(zone)))
    d = samples.select(*keys, *dict.fromkeys(["step", "time_s", *order]), F.col(zone).alias("zone_id"), before.alias("_before"), changed.alias("_changed"))
    entry = F.last(F.when(F.col("_changed") & F.col("zone_id").isNotNull(), F.col("step")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_entry", entry).filter("_changed")
    left = F.struct(F.col("_before").alias("zone_id"), F.lit("exit").alias("kind"), F.greatest((F.col("step") - F.col("_entry")) * F.lit(float(dt)), F.lit(float(dt))).alias("dwell_s"))
    came = F.struct(F.col("zone_id"), F.lit("enter").alias("kind"), F.lit(None).cast("double").alias("dwell_s"))
    d = d.select(*keys, "step", "time_s", F.explode(F.array(left, came)).alias("t"))
    return d.filter("t.zone_id is not null").select(*keys, "step", "time_s", "t.zone_id", "t.kind", "t.dwell_s")


def zone_flows(transitions: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, zone_id, step, inflow, outflow, dwell_sum, dwells, mean_dwell_s) for steps in which something changed.

    mean_dwell_s is over all stays that have ended up to the step, 0.0 before the first.
    """
    g = transitions.groupBy(run, "zone_id", "step").agg(
        F.count_if(F.col("kind") == "enter").alias("inflow"), F.count_if(F.col("kind") == "exit").alias("outflow"), or_zero(F.sum("dwell_s")).alias("dwell_sum"), F.count("dwell_s").alias("dwells")
    )
    w = Window.partitionBy(run, "zone_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)  # a row per step that had a change
    return g.withColumn("mean_dwell_s", or_zero(ratio(F.sum("dwell_sum").over(w), F.sum("dwells").over(w))))


def zone_occupancy(samples: DataFrame, run: str = "run_id", zone: str = "zone_id", speed: str = "speed", density: str = "local_density") -> DataFrame:
    """(run, zone_id, step, occupancy, mean_speed, mean_density) for steps in which somebody is inside."""
    inside = samples.filter(F.col(zone).isNotNull())
    return inside.groupBy(run, F.col(zone).alias("zone_id"), "step").agg(F.count(F.lit(1)).alias("occupancy"), or_zero(F.avg(speed)).alias("mean_speed"), or_zero(F.avg(density)).alias("mean_density"))


def bottleneck_rows(samples: DataFrame, dt: float, keys: Sequence[str] = KEYS, zone: str = "zone_id", speed: str = "speed", density: str = "local_density") -> DataFrame:
    """Per run, zone and step that has a change or an occupant: occupancy, speeds, inflow, outflow and the mean stay so far."""
    run = keys[0]
    flows = zone_flows(zone_transitions(samples, dt, keys, zone), run).drop("dwell_sum", "dwells")
    both = zone_occupancy(samples, run, zone, speed, density).join(flows, [run, "zone_id", "step"], "full")
    w = Window.partitionBy(run, "zone_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("mean_dwell_s", or_zero(F.last("mean_dwell_s", ignorenulls=True).over(w)))
    return both.fillna(0, ["occupancy", "inflow", "outflow"]).fillna(0.0, ["mean_speed", "mean_density"])


def line_transitions(samples: DataFrame, p1: tuple[float, float], p2: tuple[float, float], keys: Sequence[str] = KEYS, order: Sequence[str] = ("step",)) -> DataFrame:
    """(keys, step, time_s, direction) of each crossing of a line: 1 from the right of p1 -> p2 to its left, -1 back.

    The sample before lies strictly on the other side, and the midpoint of both is within the line's ends and SLACK.
    """
    side, along, length = signed_distance(F.col("x"), F.col("y"), p1, p2)
    w = Window.partitionBy(*keys).orderBy(*order)
    d = samples.select(*keys, *dict.fromkeys(["step", "time_s", *order]), side.alias("_side"), along.alias("_along"))
    d = d.withColumn("_side0", F.lag("_side").over(w)).withColumn("_along0", F.lag("_along").over(w))
    d = d.filter((F.col("_side0") * F.col("_side") < 0) & ((F.col("_along0") + F.col("_along")) / 2).between(-SLACK, length + SLACK))
    return d.select(*keys, "step", "time_s", F.signum("_side").cast("int").alias("direction"))
