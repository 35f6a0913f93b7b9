"""Scalar formulas of crowd dynamics, hazards, beliefs and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import clip, or_zero, ratio

# Free speed (m/s), jam density (1/m2), shape (1/m2) of the speed-density curve.
FREE_SPEED, JAM_DENSITY, SHAPE = 1.34, 5.4, 1.913
METRES_PER_LAT_GTFS, METRES_PER_LAT_OSM, METRES_PER_LON = 110_540.0, 110_574.0, 111_320.0


def weidmann(density: Column, v0: float = FREE_SPEED, jam: float = JAM_DENSITY, gamma: float = SHAPE) -> Column:
    """Speed at a density: v0 up to 0.01, 0 from jam density on."""
    curve = v0 * (1 - F.exp(-gamma * (ratio(F.lit(1.0), density) - 1 / jam)))
    return F.when(density <= 0.01, v0).when(density >= jam, 0.0).otherwise(curve)


def binary_entropy(p: Column) -> Column:
    """Bits of a yes-no belief; 0 at and beyond the ends."""
    inside = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return F.when((p > 0) & (p < 1), inside).otherwise(0.0)


def agent_entropy(exit_probs: Column, hazards: Column, danger: Column, exits: Column, total_hazards: Column) -> Column:
    """Normalised entropy of beliefs: exit_probs array<double>, hazards array<struct<severity, freshness>>."""

    def total(xs: Column, f) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    known = total(exit_probs, binary_entropy) + (exits - F.size(exit_probs))
    seen = total(hazards, lambda h: binary_entropy(0.5 + 0.5 * (1.0 - h["freshness"]) * (2.0 * h["severity"] - 1.0)))
    unseen = F.greatest(F.lit(0), total_hazards - F.size(hazards))
    hazard_bits = F.when(total_hazards > 0, seen + unseen).otherwise(0.0)
    return F.least(F.lit(1.0), ratio(known + hazard_bits + binary_entropy(danger), exits + total_hazards + 1))


def benchmark_score(travel: Column, exposure: Column, equity: Column, convergence: Column) -> Column:
    """Composite score: each part 1 / (1 + metric), weighted, times 100; a missing metric is 0."""
    parts = ((0.35, travel), (0.30, exposure), (0.20, equity), (0.15, convergence))
    out = F.lit(0.0)
    for weight, metric in parts:
        out = out + weight / (1.0 + or_zero(metric))
    return 100.0 * out


def e_value(risk_ratio: Column) -> Column:
    """Least confounding that would explain a ratio away; 1 when the ratio is not positive."""
    r = F.when(risk_ratio >= 1, risk_ratio).otherwise(ratio(F.lit(1.0), risk_ratio))
    return F.when(risk_ratio > 0, r + F.sqrt(r * (r - 1))).otherwise(1.0)


def falloff(distance: Column, radius: Column, severity: Column) -> Column:
    """Hazard intensity at a distance: linear to 0 at the radius; a point hazard reaches 0.75 m."""
    near = F.when(radius <= 1e-6, F.when(distance <= 0.75, severity).otherwise(0.0))
    return F.least(F.lit(1.0), near.otherwise(F.when(distance <= radius, severity * (1.0 - distance / radius)).otherwise(0.0)))


def credibility(alpha: Column, beta: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """Mean of a Beta belief in a source, clipped."""
    return clip(ratio(alpha, alpha + beta), low, high)


def forgotten(value: Column, prior: float, factor: float) -> Column:
    return prior + (value - prior) * factor


def flow_rate(kind: Column, width: Column) -> Column:
    """Default persons per second of a connector."""
    return F.when(kind == "elevator", 1.0).when(kind == "escalator", 1.25 * width).when(kind == "ramp", 0.9 * width).otherwise(1.0 * width)


def capacity(kind: Column, width: Column) -> Column:
    """Default number of persons inside a connector; halves round to even."""
    return F.when(kind == "elevator", 1).otherwise(F.greatest(F.lit(1), F.bround(width * 2.0).cast("int")))


def kolmogorov_p(x: Column) -> Column:
    """Tail of the Kolmogorov distribution by its alternating series."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + 2.0 * F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return clip(series, 0.0, 1.0)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution (Abramowitz and Stegun 7.1.26; absolute error under 1.5e-7)."""
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.signum(z) * erf)


def signed_distance(x: Column, y: Column, p1: tuple[float, float], p2: tuple[float, float]) -> tuple[Column, Column, float]:
    """(signed distance to the line, place along it from p1, its length)."""
    dx, dy = p2[0] - p1[0], p2[1] - p1[1]
    n = math.hypot(dx, dy)
    if n <= 1e-9:
        raise ValueError("the line's ends must differ")
    ux, uy = dx / n, dy / n
    return (x - p1[0]) * -uy + (y - p1[1]) * ux, (x - p1[0]) * ux + (y - p1[1]) * uy, n


def door_factor(occupancy: Column, capacity_: Column) -> Column:
    """Speed factor where more persons than the capacity share a door."""
    return F.when(occupancy > capacity_, ratio(capacity_, occupancy)).otherwise(1.0)


def cell_of(x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor(x).cast("int"), F.floor(y).cast("int")


def world_of(x: Column, y: Column) -> tuple[Column, Column]:
    """Centre of a cell."""
    return x + 0.5, y + 0.5
