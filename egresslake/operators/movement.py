"""Agents in a layout: who is active, what is closed, how they see, judge, choose and move; one step as a composition of these.

State tables (a row per agent, cell or hazard) go in and come out; draws are hashes, so a step gives the same result on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.functions.nullsafe import clip, or_zero, ratio
from egresslake.functions.scalars import falloff, weidmann
from egresslake.operators.graph import cut
from egresslake.operators.spatial import within_reach

#: Fixed value: the distance of zones on different floors.
OTHER_FLOOR = 999_999
#: Dose categories, and the hazard kinds of each; other kinds count as crush.
DOSE_KINDS = {"toxic": ("GAS", "CBRN", "CHEMICAL"), "smoke": ("SMOKE",), "heat": ("FIRE", "WILDFIRE"), "flood": ("FLOOD",), "trauma": ("SHOOTER", "EARTHQUAKE", "EXPLOSION")}
#: Fixed value: two hazards are one within so many metres.
SAME_HAZARD_M = 3.0


# Predicates.


def released(step: Column | int) -> Column:
    """Agents that have been let in by a step."""
    return F.col("release_step") <= step


def active(step: Column | int) -> Column:
    return ~F.coalesce(F.col("evacuated"), F.lit(False)) & released(step)


def pending(step: Column | int) -> Column:
    return ~F.coalesce(F.col("evacuated"), F.lit(False)) & ~released(step)


def open_cells(cells: DataFrame, closed: DataFrame, keys: Sequence[str] = ("floor_id", "x", "y")) -> DataFrame:
    """Walkable cells that no dynamic closure shuts."""
    return cells.filter("walkable").join(closed.select(*keys), list(keys), "left_anti")


def open_edges(edges: DataFrame, closed_edges: DataFrame, closed_cells: DataFrame) -> DataFrame:
    """Edges (sx, sy, tx, ty) that are not shut, nor one of their ends."""
    e = edges.join(closed_edges.select("sx", "sy", "tx", "ty"), ["sx", "sy", "tx", "ty"], "left_anti")
    e = e.join(closed_cells.select(F.col("x").alias("sx"), F.col("y").alias("sy")), ["sx", "sy"], "left_anti")
    return e.join(closed_cells.select(F.col("x").alias("tx"), F.col("y").alias("ty")), ["tx", "ty"], "left_anti")


def persona_match(agents: DataFrame, personas: DataFrame) -> DataFrame:
    """(agent_id, persona_id): cohort equal, mobility class and age band equal in any case; an empty part of a persona matches all."""
    p = personas.select("persona_id", *[F.col(c).alias(f"_{c}") for c in ("cohort_name", "mobility_class", "age_band")])

    def part(c: str, fold: bool) -> Column:
        a, b = F.col(c), F.col(f"_{c}")
        return F.coalesce(b, F.lit("")).eqNullSafe("") | (F.lower(a) == F.lower(b) if fold else a == b)

    on = part("cohort_name", False) & part("mobility_class", True) & part("age_band", True)
    return agents.join(bounded(p), on).select("agent_id", "persona_id")


def floor_jumps(moves: DataFrame, connectors: DataFrame, queued: DataFrame, keys: Sequence[str] = ("run_id", "agent_id"), order: str = "step") -> DataFrame:
    """Samples (x, y, floor_id) whose floor is not the one before, without a connector on that edge, of agents that are in no connector's queue.

    connectors: (sx, sy, tx, ty), either way; queued: (keys, order).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    j = moves.select(*keys, order, *[c for v in ("floor_id", "x", "y") for c in (F.lag(v).over(w).alias(f"from_{v}"), F.col(v).alias(f"to_{v}"))]).filter("from_floor_id <> to_floor_id")
    c = connectors.select("sx", "sy", "tx", "ty").unionByName(connectors.select(F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))).distinct()
    on = (j.from_x == c.sx) & (j.from_y == c.sy) & (j.to_x == c.tx) & (j.to_y == c.ty)
    return j.join(c, on, "left_anti").join(queued.select(*keys, order), [*keys, order], "left_anti")


def speed_density_pairs(measurements: DataFrame, least: int = 3) -> DataFrame:
    """Measurements with enough agents in the region and a density that is not near 0."""
    return measurements.filter((F.col("n_in_region") >= least) & (F.col("density") > 0.01))


# Lookups and joins.


def zone_of(samples: DataFrame, zones: DataFrame, keys: Sequence[str] = ("floor_id", "x", "y")) -> DataFrame:
    """samples with the zone_id of their cell, NULL outside zones."""
    return samples.join(zones.select(*keys, "zone_id"), list(keys), "left")


def zone_distance(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """(floor_id, x, y, zone_id, distance): least Manhattan distance from each cell to each zone; OTHER_FLOOR across floors.

    zones is a layout's own table; cells are compared with an array of each zone's cells, without a shuffle.
    """
    z = bounded(zones).groupBy("zone_id").agg(F.collect_list(F.struct("floor_id", "x", "y")).alias("_cells"))
    d = F.array_min(F.transform("_cells", lambda c: F.when(c["floor_id"] == F.col("floor_id"), F.abs(c["x"] - F.col("x")) + F.abs(c["y"] - F.col("y"))).otherwise(OTHER_FLOOR)))
    return cells.select("floor_id", "x", "y").crossJoin(bounded(z)).select("floor_id", "x", "y", "zone_id", d.cast("long").alias("distance"))


def visible_pairs(agents: DataFrame, things: DataFrame, thing_id: str) -> DataFrame:
    """(agent_id, thing_id, distance): things (thing_id, tx, ty) within each agent's own vision radius."""
    d2 = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2
    j = within_reach(agents.select("agent_id", "x", "y", "vision_radius"), things.select(thing_id, "tx", "ty"), F.col("vision_radius"))
    return j.select("agent_id", thing_id, F.sqrt(d2).alias("distance"))


def beacon_news(agents: DataFrame, beacons: DataFrame, beliefs: DataFrame, radius: float) -> DataFrame:
    """(agent_id, exit_id): exits that beacons in reach tell of, unless the agent holds a belief of credibility 0.9 or more.

    beacons: beacon_id, tx, ty, exits (array).
    """
    near = within_reach(agents, beacons, F.lit(radius))
    told = near.select("agent_id", F.explode("exits").alias("exit_id")).distinct()
    return told.join(beliefs.filter("source_credibility >= 0.9").select("agent_id", "exit_id"), ["agent_id", "exit_id"], "left_anti")


def exit_usage(flows: DataFrame, exits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, alias, n): counts by label and by floor:x,y of the label's cell."""
    f = flows.join(exits.select("exit_label", "floor_id", "x", "y"), "exit_label", "left")
    place = F.when(F.col("x").isNotNull(), F.concat("floor_id", F.lit(":"), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string")))
    alias = F.explode(F.array_compact(F.array("exit_label", place))).alias("alias")
    return f.select(*keys, alias, "n").groupBy(*keys, "alias").agg(F.sum("n").alias("n"))


def cohort_exit_usage(agents: DataFrame, exits: DataFrame) -> DataFrame:
    """(cohort_name, alias, n) of evacuated agents."""
    n = agents.filter("evacuated and evacuated_via is not null").groupBy(F.coalesce("cohort_name", F.lit("unknown")).alias("cohort_name"), F.col("evacuated_via").alias("exit_label")).agg(F.count(F.lit(1)).alias("n"))
    return exit_usage(n, exits, ["cohort_name"])


def provenance_checks(records: DataFrame, exits: DataFrame, hazards: DataFrame, vision: float) -> DataFrame:
    """(record_id, supported): claims that an agent can see for itself, against the truth; exits first, then hazards.

    records: record_id, x, y, claim_exit, ex, ey (NULL without), hx, hy (NULL without); hazards: tx, ty.
    """
    def near(a: str, b: str) -> Column:
        return F.coalesce((F.col("x") - F.col(a)) ** 2 + (F.col("y") - F.col(b)) ** 2 <= vision * vision, F.lit(False))

    true_exits = exits.select(F.col("exit_id").alias("claim_exit"), F.lit(True).alias("_exit")).distinct()
    points = bounded(hazards).agg(F.collect_list(F.struct("tx", "ty")).alias("_h"))
    r = records.join(true_exits, "claim_exit", "left").crossJoin(F.broadcast(points))
    close = F.exists("_h", lambda h: (F.col("hx") - h["tx"]) ** 2 + (F.col("hy") - h["ty"]) ** 2 < SAME_HAZARD_M**2)
    by_exit = F.when(near("ex", "ey"), F.coalesce(F.col("_exit"), F.lit(False)))
    return r.select("record_id", F.coalesce(by_exit, F.when(near("hx", "hy"), F.coalesce(close, F.lit(False)))).alias("supported")).filter("supported is not null")


def family_targets(agents: DataFrame) -> DataFrame:
    """(agent_id, exit_id, share): of the targets of an agent's family without itself, the share of each exit."""
    n = agents.filter("family_id is not null and target_exit is not null")
    by = n.groupBy("family_id", F.col("target_exit").alias("exit_id")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("family_id").agg(F.count(F.lit(1)).alias("total"))
    j = agents.filter("family_id is not null").select("agent_id", "family_id", "target_exit").join(by, "family_id").join(total, "family_id")
    own = (F.col("target_exit") == F.col("exit_id")).cast("int")
    others, all_ = F.col("n") - or_zero(own), F.col("total") - F.col("target_exit").isNotNull().cast("int")
    return j.filter(others > 0).select("agent_id", "exit_id", (others / F.greatest(all_, F.lit(1))).alias("share"))


def shooter_pressure(sights: DataFrame) -> DataFrame:
    """(agent_id, hostile_id, distance, visible): the nearest of the hostiles that see an agent, and how many do.

    sights: agent_id, hostile_id, distance, range_m, clear.
    """
    s = sights.filter(F.col("clear") & (F.col("distance") <= F.col("range_m")))
    g = s.groupBy("agent_id").agg(F.min(F.struct("distance", "hostile_id")).alias("n"), F.count(F.lit(1)).alias("visible"))
    return g.select("agent_id", F.col("n.hostile_id").alias("hostile_id"), F.col("n.distance").alias("distance"), "visible")


def dose_category(kind: Column) -> Column:
    out: Column | None = None
    for name, kinds in DOSE_KINDS.items():
        hit = F.upper(kind).isin(*kinds)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("crush")


def dose_loads(samples: DataFrame, hazards: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Per sample: load of each dose category, their total, and the greatest flood depth.

    hazards: kind, hx, hy, radius, severity, depth_m, threshold_m; a flood's intensity is at least its depth over its threshold.
    """
    fields = ("kind", "hx", "hy", "radius", "severity", "depth_m", "threshold_m")
    h = bounded(hazards).withColumn("category", dose_category(F.col("kind"))).agg(F.array_sort(F.collect_list(F.struct(*fields, "category"))).alias("_h"))

    def one(z: Column) -> Column:
        d = F.sqrt((F.col("x") - z["hx"]) ** 2 + (F.col("y") - z["hy"]) ** 2)
        wet = F.upper(z["kind"]) == "FLOOD"
        depth = F.when(wet & (d <= z["radius"]), or_zero(z["depth_m"])).otherwise(0.0)
        i = falloff(d, z["radius"], z["severity"])
        return F.struct(F.when(wet, F.greatest(i, depth / F.greatest(z["threshold_m"], F.lit(1e-6)))).otherwise(i).alias("i"), z["category"].alias("c"), depth.alias("depth"))

    at = samples.crossJoin(F.broadcast(h)).select(*ident, F.transform("_h", one).alias("_at"))

    def total(value) -> Column:
        return F.aggregate("_at", F.lit(0.0), lambda s, z: s + value(z))

    names = [*DOSE_KINDS, "crush"]
    return at.select(*ident, *[total(lambda z, n=n: F.when(z["c"] == n, z["i"]).otherwise(0.0)).alias(f"{n}_load") for n in names], total(lambda z: z["i"]).alias("total_load"), or_zero(F.array_max(F.transform("_at", lambda z: z["depth"]))).alias("flood_depth_m"))


# Beliefs.


def belief_accuracy(beliefs: DataFrame, exits: DataFrame, hazard_beliefs: DataFrame, hazards: DataFrame, agents: DataFrame) -> DataFrame:
    """(agent_id, belief_accuracy): belief in true exits, less false exits held likely, and the best severity match of each true hazard.

    beliefs: agent_id, exit_id, prob; exits: exit_id; hazard_beliefs: agent_id, bx, by, severity_est; hazards: hx, hy, severity. 1 where there is no truth.
    """
    truth = exits.select("exit_id").distinct()
    e = beliefs.join(truth.withColumn("_true", F.lit(True)), "exit_id", "left").groupBy("agent_id").agg(
        or_zero(F.sum(F.when(F.col("_true"), F.col("prob")))).alias("found"), F.count_if(F.col("_true").isNull() & (F.col("prob") > 0.5)).alias("false_exits"))
    points = bounded(hazards).agg(F.array_sort(F.collect_list(F.struct("hx", "hy", "severity"))).alias("_h"))
    held = hazard_beliefs.groupBy("agent_id").agg(F.collect_list(F.struct("bx", "by", "severity_est")).alias("_b"))

    def best(h: Column) -> Column:
        near = F.filter("_b", lambda b: (b["bx"] - h["hx"]) ** 2 + (b["by"] - h["hy"]) ** 2 < SAME_HAZARD_M**2)
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(near, lambda b: 1.0 - F.abs(b["severity_est"] - h["severity"]))), F.lit(0.0)))

    count = truth.agg(F.count(F.lit(1)).alias("_exits"))
    a = agents.select("agent_id").join(e, "agent_id", "left").join(held, "agent_id", "left").crossJoin(F.broadcast(points)).crossJoin(F.broadcast(count))
    seen = F.aggregate("_h", F.lit(0.0), lambda s, h: s + best(h))
    total = F.col("_exits") + F.coalesce("false_exits", F.lit(0)) + F.size("_h")
    none = (F.col("_exits") == 0) & (F.size("_h") == 0)
    return a.select("agent_id", F.when(none, 1.0).otherwise(F.coalesce(ratio(or_zero(F.col("found")) + F.when(F.col("_b").isNull(), 0.0).otherwise(seen), total), F.lit(1.0))).alias("belief_accuracy"))


def entropy_summary(agent_entropies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: mean and population variance of agents' entropy; the variance of one agent is 0."""
    return agent_entropies.groupBy(*keys).agg(or_zero(F.avg("entropy")).alias("global_entropy"), F.when(F.count("entropy") > 1, F.var_pop("entropy")).otherwise(0.0).alias("entropy_variance"))


def information_efficiency(first: Column, last: Column) -> Column:
    """1 less last over first entropy, at least 0; 1 for a start without entropy."""
    return F.when(first < 1e-9, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - ratio(last, first)))


def profile_similarity(left: Column, right: Column) -> Column:
    """Of the keys that two maps share, the part with equal values in any case; 0 without shared keys."""
    keys = F.array_intersect(F.map_keys(left), F.map_keys(right))
    same = F.filter(keys, lambda k: F.lower(F.element_at(left, k).cast("string")) == F.lower(F.element_at(right, k).cast("string")))
    return F.coalesce(ratio(F.size(same), F.when(F.size(keys) > 0, F.size(keys))), F.lit(0.0))


def perceived_hazard(x: Column, y: Column, beliefs: Column) -> Column:
    """Summed falloff of believed hazards array<struct<bx, by, radius_est, severity_est>>; one without a radius reaches a metre."""
    def one(b: Column) -> Column:
        d = F.sqrt((x - b["bx"]) ** 2 + (y - b["by"]) ** 2)
        r = b["radius_est"]
        return F.when((r > 0) & (d <= r), b["severity_est"] * (1 - d / r)).when((r <= 0) & (d < 1.0), b["severity_est"]).otherwise(0.0)

    return F.aggregate(beliefs, F.lit(0.0), lambda s, b: s + one(b))


def density_penalty(density: Column) -> Column:
    return F.least(F.lit(2.0), 2.0 * density)


def connector_weight(kind: Column, travel_s: Column, dwell_s: Column, distance: Column, speed: Column) -> Column:
    """Seconds of a connector: an elevator's travel and dwell, else distance over its speed; at least 1."""
    ride = (kind == "elevator") & (travel_s > 0)
    return F.greatest(F.lit(1.0), F.when(ride, travel_s + dwell_s).otherwise(distance / F.greatest(speed, F.lit(1e-6))))


def edge_weight(base: Column, density: Column, hazard: Column, blocked: Column) -> Column:
    """Cost of entering a cell: infinite where blocked."""
    return F.when(blocked, F.lit(math.inf)).otherwise(base + 0.5 * density_penalty(or_zero(density)) + or_zero(hazard))


def belief_penalty(x: Column, y: Column, beliefs: Column) -> Column:
    """What believed hazards add to an edge into (x, y)."""
    inside = F.filter(beliefs, lambda b: b["radius_est"] > 0)
    return 1.25 * perceived_hazard(x, y, inside)


def scored_exit(beliefs: DataFrame, agents: DataFrame, exits: DataFrame, family: DataFrame) -> DataFrame:
    """(agent_id, exit_id, score): the best exit by belief, likeness of profiles, the family's targets and distance.

    agents: agent_id, x, y, profile (map), homophily_weight, herding, exit_affinity; exits: exit_id, tx, ty, profile.
    """
    b = beliefs.join(agents.withColumnRenamed("profile", "_mine"), "agent_id").join(exits.withColumnRenamed("profile", "_theirs"), "exit_id").join(family, ["agent_id", "exit_id"], "left")
    base = (F.col("prob") - F.col("congestion")) * (1 - 0.3 * F.col("freshness"))
    d = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    s = base + F.col("homophily_weight") * profile_similarity(F.col("_mine"), F.col("_theirs")) + 0.15 * F.col("herding") * or_zero(F.col("share")) + 0.05 * F.col("exit_affinity") / (1 + d)
    return b.groupBy("agent_id").agg(F.max(F.struct(s.alias("score"), "exit_id")).alias("b")).select("agent_id", "b.exit_id", "b.score")


# Forces.


@dataclass(frozen=True)
class Forces:
    """The parameters of the force model."""

    relaxation_time_s: float = 0.5
    agent_repulsion_strength: float = 2.1
    agent_repulsion_range_m: float = 0.3
    wall_repulsion_strength: float = 5.0
    wall_repulsion_range_m: float = 0.2
    counter_flow_friction: float = 1.5
    body_diameter_m: float = 0.6
    wall_distance_m: float = 0.3
    agent_interaction_radius_m: float = 3.0
    wall_interaction_radius_m: float = 2.0
    max_speed_multiplier: float = 1.5
    visual_range_m: float = 0.0
    visual_field_degrees: float = 360.0
    rear_repulsion_weight: float = 1.0
    counter_flow_avoidance_strength: float = 0.0
    counter_flow_avoidance_range_m: float = 2.0


def neighbour_force(p: Forces = Forces(), counter_flow: bool = False) -> tuple[Column, Column]:
    """(fx, fy) that a neighbour (nx, ny, nvx, nvy) puts on an agent (x, y, with desired velocity dvx, dvy)."""
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    dist = F.sqrt(dx * dx + dy * dy) + 1e-6
    ux, uy = dx / dist, dy / dist
    want = F.sqrt(F.col("dvx") ** 2 + F.col("dvy") ** 2)
    ahead = ratio(-(F.col("dvx") * ux + F.col("dvy") * uy), F.when(want > 1e-6, want))
    sees = F.when(ahead < math.cos(math.radians(p.visual_field_degrees / 2)), p.rear_repulsion_weight).otherwise(1.0)
    push = sees * p.agent_repulsion_strength * F.exp((p.body_diameter_m - dist) / p.agent_repulsion_range_m)
    fx, fy = push * ux, push * uy
    if counter_flow:
        dot = F.col("dvx") * F.col("nvx") + F.col("dvy") * F.col("nvy")
        speed = F.sqrt(F.col("nvx") ** 2 + F.col("nvy") ** 2)
        against = (dot < 0) & (speed > 0.1)
        rub = sees * p.counter_flow_friction * F.abs(dot) * F.signum(-uy * F.col("dvx") + ux * F.col("dvy"))
        fx, fy = fx + F.when(against, rub * -uy).otherwise(0.0), fy + F.when(against, rub * ux).otherwise(0.0)
        if p.counter_flow_avoidance_strength > 0 and p.counter_flow_avoidance_range_m > 1e-6:
            lx, ly = ratio(-F.col("dvy"), want), ratio(F.col("dvx"), want)
            aside = dx * lx + dy * ly
            step = sees * p.counter_flow_avoidance_strength * F.least(F.lit(1.0), ratio(-dot, want * speed)) * F.exp((p.counter_flow_avoidance_range_m - dist) / p.counter_flow_avoidance_range_m)
            step = step * F.when(F.abs(aside) > 1e-6, F.signum(aside)).otherwise(1.0)
            fx, fy = fx + or_zero(F.when(against & (want > 1e-6), step * lx)), fy + or_zero(F.when(against & (want > 1e-6), step * ly))
    near = (dist < p.agent_interaction_radius_m) & (F.lit(p.visual_range_m <= 0) | (dist <= p.visual_range_m))
    return F.when(near, fx).otherwise(0.0), F.when(near, fy).otherwise(0.0)


def wall_force(p: Forces = Forces()) -> tuple[Column, Column]:
    """(fx, fy) that a wall point (wx, wy) puts on an agent."""
    dx, dy = F.col("x") - F.col("wx"), F.col("y") - F.col("wy")
    dist = F.sqrt(dx * dx + dy * dy) + 1e-6
    push = F.when(dist < p.wall_interaction_radius_m, p.wall_repulsion_strength * F.exp((p.wall_distance_m - dist) / p.wall_repulsion_range_m)).otherwise(0.0)
    return push * dx / dist, push * dy / dist


def _in_reach(agents: DataFrame, others: DataFrame, ox: str, oy: str, reach: float) -> DataFrame:
    """agents with each other within reach: an equi-join on square buckets as wide as the reach."""
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = agents.withColumn("_d", around).withColumn("_bx", F.floor(F.col("x") / reach) + F.col("_d.i")).withColumn("_by", F.floor(F.col("y") / reach) + F.col("_d.j")).drop("_d")
    b = others.withColumn("_bx", F.floor(F.col(ox) / reach)).withColumn("_by", F.floor(F.col(oy) / reach))
    return a.join(b, ["_bx", "_by"]).drop("_bx", "_by")


def social_force_step(agents: DataFrame, walls: DataFrame | None = None, dt: float = 0.1, p: Forces = Forces(), counter_flow: bool = False) -> DataFrame:
    """(agent_id, dx, dy, vx, vy): displacement and velocity after a step under drive, neighbours and walls, speed clamped.

    agents: agent_id (which tells them apart), x, y, vx, vy, dvx, dvy (desired velocity); walls: wx, wy. Agents of one state are under one
    force, and neighbours of one place and velocity put it on them as often as there are of them: only states meet.
    """
    state = ["x", "y", "vx", "vy", "dvx", "dvy"]
    states = agents.select(*state).distinct()
    n = agents.groupBy(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("vx").alias("nvx"), F.col("vy").alias("nvy")).agg(F.count(F.lit(1)).alias("_n"))
    fx, fy = neighbour_force(p, counter_flow)
    own = F.lit(True)
    for c in ("x", "y", "vx", "vy"):
        own = own & F.col(c).eqNullSafe(F.col(f"n{c}"))
    others = F.col("_n") - own.cast("int")
    j = _in_reach(states, n, "nx", "ny", p.agent_interaction_radius_m).filter(others > 0).select(*state, (fx * others).alias("fx"), (fy * others).alias("fy"))
    if walls is not None:
        wx, wy = wall_force(p)
        j = j.unionByName(_in_reach(states, walls.select("wx", "wy"), "wx", "wy", p.wall_interaction_radius_m).select(*state, wx.alias("fx"), wy.alias("fy")))
    f = j.groupBy(*[F.col(c).alias(f"_s{c}") for c in state]).agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    a = agents.join(f, same, "left").drop(*[f"_s{c}" for c in state])

    def new(v: str, want: str, force: str) -> Column:
        return F.col(v) + ((F.col(want) - F.col(v)) / p.relaxation_time_s + or_zero(F.col(force))) * dt

    a = a.withColumn("_vx", new("vx", "dvx", "fx")).withColumn("_vy", new("vy", "dvy", "fy"))
    speed, most = F.sqrt(F.col("_vx") ** 2 + F.col("_vy") ** 2), F.greatest(F.sqrt(F.col("dvx") ** 2 + F.col("dvy") ** 2) * p.max_speed_multiplier, F.lit(0.5))
    scale = F.when(speed > most, most / speed).otherwise(1.0)
    a = a.withColumn("vx", F.col("_vx") * scale).withColumn("vy", F.col("_vy") * scale)
    return a.select("agent_id", (F.col("vx") * dt).alias("dx"), (F.col("vy") * dt).alias("dy"), "vx", "vy")


# Hazards in time.


def aftershocks(schedule: DataFrame, steps: DataFrame, damage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(damage by cell after the shocks of these steps, at most 1; events).

    schedule: shock_id, step, hx, hy, radius, magnitude; damage: x, y, v. A shock damages cells in its radius by magnitude times 1 - d / r.
    """
    s = schedule.join(steps.select("step"), "step", "left_semi")
    r = F.ceil("radius").cast("int")
    spread = s.withColumn("_dx", F.explode(F.sequence(-r, r))).withColumn("_dy", F.explode(F.sequence(-r, r)))
    spread = spread.withColumn("x", (F.floor("hx") + F.col("_dx")).cast("int")).withColumn("y", (F.floor("hy") + F.col("_dy")).cast("int"))
    d = F.sqrt((F.col("x") + 0.5 - F.col("hx")) ** 2 + (F.col("y") + 0.5 - F.col("hy")) ** 2)
    hit = spread.filter(d <= F.col("radius")).select("x", "y", (F.col("magnitude") * (1 - d / F.col("radius"))).alias("v"))
    total = damage.select("x", "y", "v").unionByName(hit).groupBy("x", "y").agg(F.least(F.lit(1.0), F.sum("v")).alias("v"))
    return total, s.select("step", "shock_id", F.lit("aftershock").alias("event"), "magnitude")


def hazard_samples(agents: DataFrame, hazards: DataFrame, ident: Sequence[str], breathing: float = 1.5) -> DataFrame:
    """Per agent: intensity at breathing height for hazards that know height (their layer from z_low to z_high), else at the floor.

    hazards: hx, hy, radius, severity, height_aware, z_low, z_high.
    """
    h = bounded(hazards).agg(F.array_sort(F.collect_list(F.struct("hx", "hy", "radius", "severity", "height_aware", "z_low", "z_high"))).alias("_h"))
    z = F.col("z") + F.coalesce("breathing_height_m", F.lit(breathing))

    def one(q: Column) -> Column:
        i = falloff(F.sqrt((F.col("x") - q["hx"]) ** 2 + (F.col("y") - q["hy"]) ** 2), q["radius"], q["severity"])
        return F.when(~q["height_aware"] | z.between(q["z_low"], q["z_high"]), i).otherwise(0.0)

    return agents.crossJoin(F.broadcast(h)).select(*ident, F.aggregate("_h", F.lit(0.0), lambda s, q: s + one(q)).alias("hazard_load"))


def connector_density(connectors: DataFrame, density: DataFrame) -> DataFrame:
    """connectors (sx, sy, tx, ty) with the greater of their ends' densities (x, y, density), 0 where a cell has none."""
    a = density.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("density").alias("_a"))
    b = density.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("density").alias("_b"))
    return connectors.join(a, ["sx", "sy"], "left").join(b, ["tx", "ty"], "left").withColumn("density", F.greatest(or_zero(F.col("_a")), or_zero(F.col("_b")))).drop("_a", "_b")


# Decisions and messages.


def apply_decision(agents: DataFrame, decisions: DataFrame) -> DataFrame:
    """agents after accepted decisions (agent_id, selected_intent, target_exit, trust_delta): intent and target replaced, trust moved within 0 and 1."""
    d = decisions.filter("validation_status = 'accepted'").select("agent_id", F.col("selected_intent").alias("_i"), F.col("target_exit").alias("_t"), F.col("trust_delta").alias("_d"))
    j = agents.join(d, "agent_id", "left")
    return j.withColumn("intent", F.coalesce("_i", "intent")).withColumn("target_exit", F.coalesce("_t", "target_exit")).withColumn("trust", clip(F.col("trust") + or_zero(F.col("_d")), 0.0, 1.0)).drop("_i", "_t", "_d")


def hostile_recipients(agents: DataFrame, hostiles: DataFrame, strategy: str, budget: int, spent: int = 0) -> DataFrame:
    """(hostile_id, agent_id, place): whom a hostile channel reaches, most credulous or nearest to the hazard first, within what is left of its budget.

    agents: agent_id, x, y, credibility, hazard_distance; hostiles: hostile_id, tx, ty, radius.
    """
    near = agents.join(bounded(hostiles), (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 <= F.col("radius") ** 2)
    order = {"credibility": [F.desc("credibility")], "hazard": [F.asc("hazard_distance")], "insertion": []}[strategy]
    place = F.row_number().over(Window.partitionBy("hostile_id").orderBy(*order, "agent_id"))
    return near.select("hostile_id", "agent_id", place.alias("place")).filter(F.col("place") <= max(0, budget - spent))


def claims_spread(beliefs: DataFrame, recipients: DataFrame, claims: DataFrame) -> DataFrame:
    """Beliefs after hostile claims (hostile_id, exit_id, prob, credibility) have reached their recipients; a more credible belief stays."""
    c = recipients.select("hostile_id", "agent_id").join(bounded(claims), "hostile_id")
    c = c.groupBy("agent_id", "exit_id").agg(F.max(F.struct("credibility", "prob")).alias("c")).select("agent_id", "exit_id", F.col("c.prob").alias("_p"), F.col("c.credibility").alias("_c"))
    j = beliefs.join(c, ["agent_id", "exit_id"], "full")
    wins = F.col("_c").isNotNull() & (F.col("source_credibility").isNull() | (F.col("_c") > F.col("source_credibility")))
    return j.select("agent_id", "exit_id", F.when(wins, F.col("_p")).otherwise(F.col("prob")).alias("prob"), F.when(wins, F.col("_c")).otherwise(F.col("source_credibility")).alias("source_credibility"))


# A step.


def simulation_step(agents: DataFrame, routes: DataFrame, exits: DataFrame, hazards: DataFrame, closed: DataFrame, step: int, dt: float = 0.5) -> DataFrame:
    """agents one step on: hazard load, exposure, speed by density, a move along the route, evacuation at exits.

    agents: agent_id, x, y, release_step, evacuated, evacuated_via, travel_steps, exposure, free_speed (and others, kept).
    routes: x, y, nx, ny, the next cell of each cell; exits: exit_id, x, y; closed: x, y. Agents whose next cell is closed wait.
    Nobody is made or lost; an agent leaves once.
    """
    here = [F.floor("x").cast("int").alias("_cx"), F.floor("y").cast("int").alias("_cy")]
    a = agents.select("*", *here).withColumn("_go", active(step))
    a = a.withColumn("_n", F.count_if("_go").over(Window.partitionBy("_cx", "_cy")))  # a join with counts would double the plan with every step
    r = routes.select(F.col("x").alias("_cx"), F.col("y").alias("_cy"), "nx", "ny").join(closed.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.lit(True).alias("_shut")), ["nx", "ny"], "left")
    a = a.join(r, ["_cx", "_cy"], "left")
    h = bounded(hazards).agg(F.array_sort(F.collect_list(F.struct("hx", "hy", "radius", "severity"))).alias("_h"))
    a = a.crossJoin(F.broadcast(h))
    load = F.aggregate("_h", F.lit(0.0), lambda s, q: s + falloff(F.sqrt((F.col("x") - q["hx"]) ** 2 + (F.col("y") - q["hy"]) ** 2), q["radius"], q["severity"]))
    a = a.withColumn("exposure", F.col("exposure") + F.when(F.col("_go"), load * dt).otherwise(0.0))
    pace = F.least(F.col("free_speed"), weidmann(F.coalesce("_n", F.lit(0)).cast("double")))
    reach = pace * dt
    dx, dy = F.col("nx") + 0.5 - F.col("x"), F.col("ny") + 0.5 - F.col("y")
    far = F.sqrt(dx * dx + dy * dy)
    share = F.when(F.col("_go") & F.col("nx").isNotNull() & F.col("_shut").isNull(), F.least(F.lit(1.0), ratio(reach, F.when(far > 0, far)))).otherwise(0.0)
    a = a.withColumn("_x", F.col("x") + or_zero(share * dx)).withColumn("_y", F.col("y") + or_zero(share * dy))
    e = exits.select("exit_id", F.col("x").alias("_ex"), F.col("y").alias("_ey"))
    a = a.withColumn("_ex", F.floor("_x").cast("int")).withColumn("_ey", F.floor("_y").cast("int")).join(e, ["_ex", "_ey"], "left")
    out = F.col("_go") & F.col("exit_id").isNotNull()
    a = a.withColumn("travel_steps", F.col("travel_steps") + F.col("_go").cast("int")).withColumn("evacuated_via", F.when(out, F.col("exit_id")).otherwise(F.col("evacuated_via"))).withColumn("evacuated", F.col("evacuated") | out)
    return a.withColumn("x", F.col("_x")).withColumn("y", F.col("_y")).select(*agents.columns)


def simulate(agents: DataFrame, routes: DataFrame, exits: DataFrame, hazards: DataFrame, closures: Mapping[int, DataFrame], steps: int, dt: float = 0.5, every: int = 4) -> DataFrame:
    """agents after so many steps. closures names the closed cells from a step on; lineage is cut with checkpoint() every few steps."""
    closed = exits.select("x", "y").filter("false")
    for i in range(steps):
        closed = closures.get(i, closed)
        agents = simulation_step(agents, routes, exits, hazards, closed, i, dt)
        if i % every == every - 1:
            agents = cut(agents)
    return agents


def live_snapshot(agents: DataFrame, step: int) -> DataFrame:
    """One row: a step's counts and the active agents' mean exposure, as a viewer polls them."""
    on = active(step)
    return agents.agg(
        F.lit(step).alias("step"), F.count(F.lit(1)).alias("agents"), F.count_if("evacuated").alias("evacuated"), F.count_if(on).alias("active"), F.count_if(pending(step)).alias("pending"),
        or_zero(F.avg(F.when(on, F.col("exposure")))).alias("mean_exposure"),
    )
