"""One step of the simulation as set operations: each function maps tables of a step to those of the next.

Draws come from hashes of seed, step and ids, so they are the same in any order and on any number of machines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.functions.nullsafe import clip, ratio
from egresslake.operators.graph import cut

MERGE_M = 3.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts, by MD5."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def moved_hazards(hazards: DataFrame, steps: DataFrame, dt: float) -> DataFrame:
    """Hazards (x, y, vx, vy, radius, spread, severity, decay) at each step, in closed form."""
    t = F.col("step") * dt
    return hazards.crossJoin(bounded(steps)).select(
        "hazard_id", "step", (F.col("x") + F.col("vx") * t).alias("x"), (F.col("y") + F.col("vy") * t).alias("y"),
        F.greatest(F.lit(0.0), F.col("radius") + F.col("spread") * t).alias("radius"), clip(F.col("severity") * F.exp(-F.col("decay") * t), 0.0, 1.0).alias("severity"),
    )


def stamped_field(field: DataFrame, stamps: DataFrame, keep: float, least: float = 0.01, how: str = "sum") -> DataFrame:
    """A raster (x, y, v): old values times keep, new stamps added (or their maximum), at most 1; small values are pruned."""
    u = field.select("x", "y", (F.col("v") * keep).alias("v")).unionByName(stamps.select("x", "y", "v"))
    total = F.sum("v") if how == "sum" else F.max("v")
    return u.groupBy("x", "y").agg(F.least(F.lit(1.0), total).alias("v")).filter(F.col("v") > least)


def topology_change(before: DataFrame, now: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """(keys, change): cells closed since, and cells opened again."""
    new = now.select(*keys).distinct().exceptAll(before.select(*keys).distinct()).withColumn("change", F.lit("closed"))
    return new.unionByName(before.select(*keys).distinct().exceptAll(now.select(*keys).distinct()).withColumn("change", F.lit("opened")))


def should_close(damage: Column, flood: Column, intensity: Column, threshold: Column) -> Column:
    """Whether a cell closes: terrain damage, flood depth or hazard intensity; thresholds over 1 are off."""
    return (F.coalesce(damage, F.lit(0.0)) >= 0.85) | (F.coalesce(flood, F.lit(0.0)) >= 1.2) | ((threshold <= 1) & F.coalesce(intensity >= threshold, F.lit(False)))


def decayed_beliefs(beliefs: DataFrame, decay: float, dt: float, steps: Column) -> DataFrame:
    """Beliefs (prob, freshness) after so many steps without news."""
    return beliefs.withColumn("freshness", F.least(F.lit(1.0), F.col("freshness") + decay * dt * steps)).withColumn("prob", F.col("prob") * F.pow(F.lit(1 - 0.1 * decay * dt), steps))


def initial_beliefs(agents: DataFrame, exits: DataFrame, seed: int, mode: str = "asymmetric") -> DataFrame:
    """(agent_id, exit_id) that agents know at the start: all (perfect), none, or each with probability familiarity."""
    all_ = agents.select("agent_id", "familiarity").crossJoin(bounded(exits.select("exit_id")))
    if mode == "asymmetric":
        all_ = all_.filter(uniform(F.lit(seed), "agent_id", "exit_id") < F.coalesce("familiarity", F.lit(0.0)))
    return all_.filter("false").select("agent_id", "exit_id") if mode == "none" else all_.select("agent_id", "exit_id")


def observed(beliefs: DataFrame, seen: DataFrame, keys: Sequence[str] = ("agent_id", "exit_id")) -> DataFrame:
    """Upsert: what an agent sees replaces its belief (prob 1, freshness 0)."""
    old = beliefs.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return old.unionByName(seen.select(*keys).distinct().withColumn("prob", F.lit(1.0)).withColumn("freshness", F.lit(0.0)))


def gossip(pairs: DataFrame, beliefs: DataFrame, seed: int, step: int, chance: float, distortion: float, max_hops: int = 3) -> DataFrame:
    """Beliefs that receivers take over from neighbours (sender_id, receiver_id, credibility): damped, distorted, one hop older.

    Of several offers on one exit the most credible wins, then the least sender.
    """
    offer = pairs.join(beliefs.withColumnRenamed("agent_id", "sender_id"), "sender_id").filter(F.col("hops") < max_hops)
    draw = uniform(F.lit(seed), F.lit(step), "sender_id", "receiver_id", "exit_id")
    offer = offer.filter(draw < chance * F.col("credibility"))
    noise = (uniform(F.lit(seed + 1), F.lit(step), "sender_id", "receiver_id", "exit_id") - 0.5) * 2 * distortion
    offer = offer.withColumn("prob", clip(F.col("prob") * F.col("credibility") + noise, 0.0, 1.0)).withColumn("hops", F.col("hops") + 1)
    best = Window.partitionBy("receiver_id", "exit_id").orderBy(F.desc("credibility"), "sender_id")
    return offer.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col("receiver_id").alias("agent_id"), "exit_id", "prob", "hops")


def merged_hazards(reports: DataFrame, beliefs: DataFrame, radius: float = MERGE_M) -> DataFrame:
    """For each report the nearest belief of its agent within the radius, or NULL: (report_id, belief_id)."""
    d2 = (F.col("rx") - F.col("bx")) ** 2 + (F.col("ry") - F.col("by")) ** 2
    j = reports.join(beliefs, "agent_id", "left").withColumn("d2", d2).withColumn("near", F.col("d2") < radius * radius)
    return j.groupBy("report_id").agg(F.min(F.when(F.col("near"), F.struct("d2", "belief_id")))["belief_id"].alias("belief_id"))


def next_state(state: Column, load: Column, crowd: Column, calmness: Column, draw: Column) -> Column:
    """Behaviour by load, crowding and a draw; panic wears off only in the clear."""
    stress = load + 0.5 * crowd
    return (
        F.when((stress > 0.8) & (draw > calmness), F.when(draw > 0.95, "FROZEN").otherwise("PANICKED"))
        .when(stress > 0.4, "ANXIOUS").when((state == "PANICKED") & (stress > 0.2), "PANICKED").when((state == "FROZEN") & (draw < 0.5), "FROZEN").otherwise("CALM")
    )


def intention(hostile_near: Column, helps: Column, follows: Column, knows_exit: Column) -> Column:
    """What an agent sets out to do, first match."""
    return F.when(hostile_near, "HIDE").when(helps, "HELP").when(follows, "FOLLOW").when(knows_exit, "EVACUATE").otherwise("EXPLORE")


def mode_latch(samples: DataFrame, roads: DataFrame, keys: Sequence[str] = ("run_id", "agent_id")) -> DataFrame:
    """(keys, switched_at): the first step at which an agent stands on a road cell; the mode never goes back."""
    return samples.join(roads.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").groupBy(*keys).agg(F.min("step").alias("switched_at"))


def stage_counts(stages: DataFrame, keys: Sequence[str], step: str, flags: Sequence[str]) -> DataFrame:
    """Running counts of reached stages; a stage counts only where all stages before it were reached."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    gate, out = F.lit(True), stages
    for f in flags:
        gate = gate & F.col(f)
        out = out.withColumn(f"{f}_count", F.sum(gate.cast("long")).over(w))
    return out


def applied_message(beliefs: DataFrame, recipients: DataFrame, message: DataFrame) -> DataFrame:
    """Beliefs after a message (exit_id, prob, congestion) has reached recipients (agent_id)."""
    news = recipients.select("agent_id").crossJoin(bounded(message))
    j = beliefs.join(news.withColumnsRenamed({"prob": "_p", "congestion": "_c"}), ["agent_id", "exit_id"], "full")
    return j.select("agent_id", "exit_id", F.coalesce("_p", "prob").alias("prob"), F.coalesce("_c", "congestion").alias("congestion"))


def best_exit(beliefs: DataFrame) -> DataFrame:
    """Each agent's exit with the greatest (prob - congestion)(1 - 0.3 freshness), the later exit on ties."""
    s = (F.col("prob") - F.col("congestion")) * (1 - 0.3 * F.col("freshness"))
    return beliefs.groupBy("agent_id").agg(F.max(F.struct(s.alias("score"), "exit_id")).alias("b")).select("agent_id", "b.exit_id", "b.score")


def pushed(pairs: DataFrame, strength: float, reach: float) -> DataFrame:
    """Summed exponential repulsion (fx, fy) on l_* from its neighbours r_* (columns of a radius join)."""
    f = strength * F.exp(-F.col("distance") / reach)
    return pairs.groupBy("l_id").agg(F.sum(f * ratio(F.col("l_x") - F.col("r_x"), F.col("distance"))).alias("fx"), F.sum(f * ratio(F.col("l_y") - F.col("r_y"), F.col("distance"))).alias("fy"))


def run_steps(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], n: int, every: int = 5) -> DataFrame:
    """The step loop: state after n steps. All runs advance in one job per few steps; lineage is cut with checkpoint()."""
    for i in range(n):
        state = step(state, i)
        if i % every == every - 1:
            state = cut(state)
    return state


def reward(evacuated: Column, exposure: Column, remaining: Column, convergence: Column, keys: Sequence[str], order: str) -> Column:
    """Defender's reward of a step: newly evacuated, less risen exposure, what remains and harmful convergence."""
    w = Window.partitionBy(*keys).orderBy(order)
    gone, dose = evacuated - F.coalesce(F.lag(evacuated).over(w), F.lit(0)), exposure - F.coalesce(F.lag(exposure).over(w), F.lit(0.0))
    return gone - F.greatest(F.lit(0.0), dose) - 0.01 * remaining - convergence
