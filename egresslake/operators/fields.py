"""Imported hazard fields at points: intensity, visibility, metres of sight, gas, obscuration, and what they cost a route.

A raster is a table (ix, iy, intensity, visibility, visibility_m, gas_concentration, obscuration), as sources/files.py reads it. Points
find their cell by arithmetic, or on irregular axes by the place among sorted edges, and join it. Cells that hold many points are few, so
their rows go to every task; the others are joined by a shuffle. Points outside the raster are clear.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.environment import flood_penalty, height_factor
from egresslake.functions.nullsafe import clip

#: A cell is hot from this share of all points on, so at most 1 / HOT cells are.
HOT = 1 / 1000
GRIDS = ("intensity", "visibility", "visibility_m", "gas_concentration", "obscuration")


@dataclass(frozen=True)
class Field:
    """Where a raster lies and how it fades with height. Edges (ascending) replace origin and cell_size on irregular axes."""

    origin: tuple[float, float] = (0.0, 0.0)
    cell_size: float = 1.0
    base_z: float = 0.0
    height_aware: bool = False
    layer_base_m: float | None = None
    layer_top_m: float | None = None
    vertical_decay_m: float = 1.0
    gas_density: float = 1.0
    maximum_visibility_m: float = 30.0
    active: bool = True
    x_edges: tuple[float, ...] | None = None
    y_edges: tuple[float, ...] | None = None


def place(v: Column, origin: float, size: float, edges: Sequence[float] | None) -> Column:
    """Index of the cell that a coordinate lies in; NULL beyond irregular edges. The last edge is the end of the last cell."""
    if edges is None:
        return F.floor((v - origin) / size).cast("int")
    if list(edges) != sorted(set(edges)) or len(edges) < 2:
        raise ValueError("edges must ascend")
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v)) - 1
    return F.when((at >= 0) & (v < float(edges[-1])), at)


def fading(z: Column, field: Field) -> Column:
    """Share of the field that reaches a height; 1 for fields that do not know heights."""
    if not field.height_aware:
        return F.lit(1.0)
    base, top = (F.lit(v).cast("double") for v in (field.layer_base_m, field.layer_top_m))
    return height_factor(z - field.base_z, base, top, F.lit(max(field.gas_density, 1e-6)), F.lit(field.vertical_decay_m))


def cell_join(points: DataFrame, cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of points with at most one row per cell; a cell may hold any share of the points."""
    n = points.count()
    size = points.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(1.0, n * HOT)).select(*on)
    hot = F.broadcast(size.withColumn("_hot", F.lit(True)))  # at most 1 / HOT rows
    marked = points.join(hot, list(on), "left")
    near = cells.join(F.broadcast(size), list(on), "left_semi")
    a = marked.filter("_hot").join(F.broadcast(near), list(on), "left")
    b = marked.filter("_hot is null").join(cells, list(on), "left")
    return a.unionByName(b).drop("_hot")


def sampled_field(points: DataFrame, raster: DataFrame, field: Field, x: str = "x", y: str = "y", z: str | None = None) -> DataFrame:
    """points with the five values of the field at each.

    Outside, and in a field that is not active: intensity, gas and obscuration 0, visibility 1, sight at its maximum. A value that
    the raster lacks (NULL) is clear too; sight in metres then follows from visibility.
    """
    top = max(field.maximum_visibility_m, 1e-6)
    share = fading(F.col(z).cast("double") if z else F.lit(field.base_z), field)
    if field.active:
        p = points.withColumn("_ix", place(F.col(x), field.origin[0], field.cell_size, field.x_edges)).withColumn("_iy", place(F.col(y), field.origin[1], field.cell_size, field.y_edges))
        have = [g for g in GRIDS if g in raster.columns]
        cells = raster.select(F.col("ix").cast("int").alias("_ix"), F.col("iy").cast("int").alias("_iy"), *[F.col(g).cast("double").alias(f"_{g}") for g in have])
        p = cell_join(p, cells, ["_ix", "_iy"])
        p = p.withColumns({f"_{g}": F.lit(None).cast("double") for g in GRIDS if g not in have})
    else:
        p = points.withColumns({f"_{g}": F.lit(None).cast("double") for g in GRIDS} | {"_ix": F.lit(0), "_iy": F.lit(0)})
    clear = clip(1 - (1 - clip(F.col("_visibility"), 0.0, 1.0)) * share, 0.0, 1.0)
    clear = F.when(F.col("_visibility").isNull(), 1.0).otherwise(clear)
    sight = clip(top - (top - clip(F.col("_visibility_m"), 0.0, top)) * share, 0.0, top)
    out = {
        "intensity": F.coalesce(F.col("_intensity") * share, F.lit(0.0)), "visibility": clear, "visibility_m": F.when(F.col("_visibility_m").isNull(), clear * top).otherwise(sight),
        "gas_concentration": F.coalesce(F.col("_gas_concentration") * share, F.lit(0.0)), "obscuration": F.coalesce(F.col("_obscuration") * share, F.lit(0.0)),
    }
    return p.withColumns(out).drop("_ix", "_iy", *[f"_{g}" for g in GRIDS])


def combined_fields(samples: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Several fields at the same points: intensities, gas and obscuration add, visibilities multiply, sight is the least."""
    if not samples:
        raise ValueError("no fields")
    every = samples[0].select(*keys, *GRIDS)
    for s in samples[1:]:
        every = every.unionByName(s.select(*keys, *GRIDS))
    product = F.exp(F.sum(F.when(F.col("visibility") > 0, F.ln("visibility"))))
    seen = F.when(F.bool_or(F.col("visibility") <= 0), 0.0).otherwise(F.coalesce(product, F.lit(1.0)))
    return every.groupBy(*keys).agg(
        F.sum("intensity").alias("intensity"), clip(seen, 0.0, 1.0).alias("visibility"), F.min("visibility_m").alias("visibility_m"), F.sum("gas_concentration").alias("gas_concentration"), F.sum("obscuration").alias("obscuration")
    )


def route_penalty(intensity: Column, damage: Column, depth: Column, closed: Column, weight: float, wading: float = 0.3, impassable: float = 0.9, extra: float = 10.0) -> Column:
    """What hazards add to a cell's cost: weight x (intensity + terrain damage + wading); infinite for a closed cell. NULL counts as 0."""
    zero = F.lit(0.0)
    depth = F.coalesce(depth, zero)
    cost = F.lit(float(weight)) * (F.coalesce(intensity, zero) + F.coalesce(damage, zero) + flood_penalty(depth, wading, impassable, extra))
    return F.when(F.coalesce(closed, F.lit(False)), F.lit(float("inf"))).otherwise(cost)
