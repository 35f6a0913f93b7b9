"""What hazards do at a place and to a body: height, visibility, flood, doors, impairment, speed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import clip, ratio

# Load of each kind at which a person is fully impaired.
FULL_LOADS = (("toxic_load", 4.0), ("smoke_fed", 10.0), ("heat_load", 3.0), ("flood_load", 4.0), ("trauma_load", 2.0), ("crush_load", 5.0))
#: Exposure from which a stage of impairment starts, its level there, and its slope.
STAGES = ((0.0, 0.0, 0.2), (0.5, 0.1, 0.3), (2.0, 0.55, 0.15))
INCAPACITATED_FROM = 5.0


def height_factor(height: Column, base: Column, top: Column, density: Column, decay: Column) -> Column:
    """Share of a hazard that reaches a height: 1 in its layer, fading outside; gas sinks or rises by density."""
    decay = F.greatest(decay, F.lit(1e-6))
    low, high = F.least(base, top), F.greatest(base, top)
    off = F.greatest(low - height, height - high, F.lit(0.0))
    sinking = F.exp(-F.greatest(F.lit(0.0), height) * (density - 1) / decay)
    rising = F.exp(-F.greatest(F.lit(0.0), -height) * (ratio(F.lit(1.0), density) - 1) / decay)
    gas = F.when(density > 1, sinking).when(density < 1, rising).otherwise(1.0)
    return F.when(base.isNotNull() & top.isNotNull(), F.exp(-off / decay)).otherwise(gas)


def visibility(distance: Column, radius: Column, reduction: Column, factor: Column) -> Column:
    """1 in the clear; less towards the middle of a hazard that cuts sight."""
    point = F.when(distance <= 0.75, 1 - reduction * factor).otherwise(1.0)
    area = F.when(distance <= radius, 1 - reduction * (1 - ratio(distance, radius)) * factor).otherwise(1.0)
    return F.when(reduction <= 0, 1.0).when(radius <= 1e-6, point).otherwise(area)


def flood_penalty(depth: Column, wading: float, impassable: float, extra: float) -> Column:
    """Route cost of wading; more where nobody gets through."""
    return F.when(depth <= 0, 0.0).otherwise(depth / max(wading, 1e-6) + F.when(depth >= impassable, extra).otherwise(0.0))


def speed_factor(sight: Column, depth: Column, least_sight: float, least_flood: float, impassable: float) -> Column:
    """The lesser of the factors for sight and flood, in [0, 1]."""
    by_sight = F.when(sight >= 1, 1.0).otherwise(F.greatest(F.lit(least_sight), sight))
    by_flood = F.when(depth <= 0, 1.0).otherwise(F.greatest(F.lit(least_flood), 1 - F.least(F.lit(1.0), depth / max(impassable, 1e-6))))
    return clip(F.least(by_sight, by_flood), 0.0, 1.0)


def door_capacity(cell_size: float, loss: float, specific_flow: float) -> float:
    return specific_flow * max(0.1, max(cell_size, 1e-6) - loss)


def door_speed(demand: Column, capacity: float, least: float) -> Column:
    return F.when(demand <= 1, 1.0).otherwise(F.greatest(F.lit(least), capacity / demand))


def impairment(exposure: Column) -> Column:
    """Level of impairment by summed exposure, in stages; 1 from the last on."""
    out = F.lit(1.0)
    ends = [*[s for s, _, _ in STAGES[1:]], INCAPACITATED_FROM]
    for (start, level, slope), end in reversed(list(zip(STAGES, ends, strict=True))):
        out = F.when(exposure < end, level + (exposure - start) * slope).otherwise(out)
    return out


def dose_impairment() -> Column:
    """Greatest share of a full load, over columns of FULL_LOADS, at most 1."""
    return F.least(F.lit(1.0), F.greatest(*[F.col(c) / full for c, full in FULL_LOADS]))


def body_factors(level: Column) -> tuple[Column, Column, Column]:
    """Speed, sight and judgement left at a level of impairment."""
    return F.greatest(F.lit(0.0), 1 - 0.8 * level), F.greatest(F.lit(0.1), 1 - 0.6 * level), F.greatest(F.lit(0.0), 1 - 0.5 * level)


def jammed_flow(rate: Column, density: Column, threshold: Column, multiplier: float) -> Column:
    """A connector's flow, cut from the jam density on; no threshold, no jam."""
    return F.when((threshold > 0) & (density >= threshold), rate * max(0.0, min(1.0, multiplier))).otherwise(rate)


def transfer_seconds(kind: Column, dwell: Column, travel: Column, distance: Column, multiplier: Column) -> Column:
    """Time on a connector: fixed travel (lifts and timed ones) or distance at walking speed, and dwell."""
    moving = F.when((travel > 0) | (kind == "elevator"), travel).otherwise(distance / (1.34 * F.greatest(multiplier, F.lit(1e-6))))
    return F.greatest(F.lit(0.01), dwell + moving)
