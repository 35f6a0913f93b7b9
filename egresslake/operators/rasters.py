"""Geometry to cells: features become primitives, primitives become tokens of a grid, and transit pathways become layouts with connectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.operators.spatial import in_polygon

# Roles of features and their tokens; what is walkable decides what the rest of a grid is filled with.
ROLE_TOKENS = {"wall": "X", "obstacle": "X", "exit": "E", "spawn": "@", "responder": "R", "walkable": ".", "corridor": ".", "platform": ".", "room": "."}
WALKABLE = ("walkable", "corridor", "platform", "room")
IGNORED = ("connector", "label", "annotation")


def primitives(features: DataFrame) -> DataFrame:
    """(feature_id, part, role, kind, points, holes): one row per polygon, line or point of features (feature_id, kind, coordinates as JSON, role)."""
    pt = "array<double>"
    shapes = {"Polygon": f"array<array<{pt}>>", "MultiPolygon": f"array<array<array<{pt}>>>", "LineString": f"array<{pt}>", "MultiLineString": f"array<array<{pt}>>", "Point": pt, "MultiPoint": f"array<{pt}>"}

    def xy(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))

    out: DataFrame | None = None
    for kind, schema in shapes.items():
        f = features.filter(F.col("kind") == kind).withColumn("_c", F.from_json("coordinates", schema))
        many = F.col("_c") if kind.startswith("Multi") else F.array("_c")
        f = f.select("feature_id", "role", F.posexplode(many).alias("part", "_p"))
        single = kind.removeprefix("Multi")
        if single == "Polygon":
            points, holes = xy(F.col("_p")[0]), F.transform(F.slice("_p", 2, F.greatest(F.lit(1), F.size("_p"))), xy)
        elif single == "LineString":
            points, holes = xy(F.col("_p")), F.lit(None)
        else:
            points, holes = xy(F.array("_p")), F.lit(None)
        one = f.select("feature_id", "part", "role", F.lit(single).alias("kind"), points.alias("points"), F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>")).alias("holes"))
        out = one if out is None else out.unionByName(one)
    return out


def bounds(shapes: DataFrame) -> DataFrame:
    """One row: min_x, min_y, max_x, max_y of all points."""
    p = shapes.select(F.explode("points").alias("p"))
    return p.agg(F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y"))


def grid_of(shapes: DataFrame, cell: float = 1.0, padding: int = 1, borders: bool = False) -> DataFrame:
    """(x, y, wx, wy, token): cells over the bounds of shapes and `padding` more, their centres in metres, and what fills them before shapes are painted."""
    b = bounds(shapes).crossJoin(shapes.agg(F.bool_or(F.col("role").isin(*WALKABLE)).alias("_walk")))
    size = [F.greatest(F.lit(1), F.ceil((F.col(f"max_{a}") - F.col(f"min_{a}")) / cell).cast("int") + 2 * padding + 1).alias(f"_n{a}") for a in "xy"]
    b = b.select("*", *size).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("_nx") - 1) | (F.col("y") == F.col("_ny") - 1)
    fill = F.when(F.lit(borders) & edge, "X").when(F.coalesce("_walk", F.lit(False)), "X").otherwise(".")
    return b.select("x", "y", (F.col("min_x") + (F.col("x") + 0.5 - padding) * cell).alias("wx"), (F.col("min_y") + (F.col("y") + 0.5 - padding) * cell).alias("wy"), fill.alias("token"))


def _near_line(x: Column, y: Column, points: Column, reach: float) -> Column:
    """Whether (x, y) is within reach of a line through points."""
    def one(i: Column) -> Column:
        a, b = points[i], points[i + 1]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return (x - a["x"] - t * dx) ** 2 + (y - a["y"] - t * dy) ** 2 <= reach * reach

    return F.exists(F.when(F.size(points) > 1, F.sequence(F.lit(0), F.size(points) - 2)).otherwise(F.array().cast("array<int>")), one)


def rasterize(shapes: DataFrame, cell: float = 1.0, padding: int = 1, borders: bool = False) -> DataFrame:
    """(x, y, token) of a layout: later features paint over earlier ones; a polygon's holes stay free.

    A polygon takes cells whose centre it holds, a line or point those within half a cell. Shapes are a drawing's own, so they
    go to every task; cells may be many.
    """
    tokens = F.create_map(*[F.lit(v) for kv in ROLE_TOKENS.items() for v in kv])
    drawn = shapes.filter(~F.coalesce(F.col("role"), F.lit("wall")).isin(*IGNORED)).withColumn("_token", F.coalesce(tokens[F.col("role")], F.lit("X")))
    x, y, half = F.col("wx"), F.col("wy"), cell / 2
    solid = (F.col("kind") == "Polygon") & in_polygon(x, y, F.col("points")) & ~F.exists("holes", lambda h: in_polygon(x, y, h))
    spot = (F.col("kind") == "Point") & (F.abs(F.col("points")[0]["x"] - x) <= half) & (F.abs(F.col("points")[0]["y"] - y) <= half)
    hit = solid | spot | ((F.col("kind") == "LineString") & _near_line(x, y, F.col("points"), half))
    g = grid_of(shapes, cell, padding, borders)
    j = g.join(bounded(drawn.select("feature_id", "part", "kind", "points", "holes", "_token")), hit, "left")
    return j.groupBy("x", "y").agg(F.coalesce(F.max_by("_token", F.struct("feature_id", "part")), F.first("token")).alias("token"))


def strict_layout(features: DataFrame, cell: float = 1.0, padding: int = 1) -> tuple[DataFrame, DataFrame]:
    """(cells by floor, connectors) of features with levels (array) and properties (map).

    A feature is drawn on each of its levels and on those that its property repeat_on lists. A connector joins its two levels at its first point and
    must have exactly two. Heights of floors: level_heights().
    """
    again = F.split(F.coalesce(F.col("properties")["repeat_on"], F.lit("")), r"\s*[,;]\s*")
    floors = F.array_distinct(F.filter(F.concat(F.transform("levels", lambda v: v.cast("string")), again), lambda v: v != ""))
    f = features.withColumn("role", F.coalesce(F.col("properties")["role"], F.lit("wall")))
    shapes = primitives(f).join(f.select("feature_id", floors.alias("_floors")), "feature_id").withColumn("floor_id", F.explode("_floors"))
    b = bounds(shapes)
    cells: DataFrame | None = None
    for floor in sorted(r.floor_id for r in shapes.select("floor_id").distinct().limit(200).collect()):  # a building's floors
        one = shapes.filter(F.col("floor_id") == floor)
        frame = b.select(F.lit(-1).cast(dict(one.dtypes)["feature_id"]).alias("feature_id"), F.lit(0).alias("part"), F.lit("label").alias("role"), F.lit("LineString").alias("kind"),
                         F.array(F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y")), F.struct(F.col("max_x").alias("x"), F.col("max_y").alias("y"))).alias("points"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))
        drawn = rasterize(one.select("feature_id", "part", "role", "kind", "points", "holes").unionByName(frame), cell, padding).withColumn("floor_id", F.lit(floor))
        cells = drawn if cells is None else cells.unionByName(drawn)
    two = F.when(F.size("levels") == 2, F.col("levels")).otherwise(F.raise_error(F.concat(F.lit("connector without two levels: feature "), F.col("feature_id").cast("string"))).cast("array<string>"))
    joins = f.filter("role = 'connector'").withColumn("_l", two).join(primitives(f.filter("role = 'connector'")).filter("part = 0").select("feature_id", F.col("points")[0].alias("_p")), "feature_id")
    at = joins.crossJoin(F.broadcast(b))
    cx, cy = (F.floor((F.col(f"_p.{a}") - F.col(f"min_{a}")) / cell).cast("int") + padding for a in "xy")
    kind = F.coalesce(F.col("properties")["connector"], F.lit("stairs"))
    return cells, at.select("feature_id", kind.alias("kind"), F.col("_l")[0].alias("from_floor"), F.col("_l")[1].alias("to_floor"), cx.alias("x"), cy.alias("y"))


def level_heights(features: DataFrame, step: float = 3.0) -> DataFrame:
    """(floor_id, z): the least height property of a level's features, else the level's number times `step`, else its rank times `step`."""
    f = features.select(F.explode("levels").alias("floor_id"), F.col("properties")["height"].try_cast("double").alias("h"))
    g = f.groupBy(F.col("floor_id").cast("string").alias("floor_id")).agg(F.min("h").alias("h"))
    rank = F.row_number().over(Window.orderBy("floor_id")) - 1  # a building's floors
    return g.withColumn("_r", rank).select("floor_id", F.coalesce("h", F.col("floor_id").try_cast("double") * step, F.col("_r") * step).alias("z"))


def pathway_layout(pathways: DataFrame, cell: float = 1.0, padding: int = 2) -> tuple[DataFrame, DataFrame]:
    """(cells floor_id, x, y, token; connectors) of pathways as gtfs_pathways() reads them.

    Ways within a level become lines of free cells in walls; ways between levels become connectors from cell to cell.
    """
    ends = pathways.select(F.col("from_px").alias("px"), F.col("from_py").alias("py")).unionByName(pathways.select(F.col("to_px").alias("px"), F.col("to_py").alias("py")))
    low = ends.agg(F.min("px").alias("_x0"), F.min("py").alias("_y0"), F.max("px").alias("_x1"), F.max("py").alias("_y1"))

    def at(v: str, o: str) -> Column:
        return F.floor((F.col(v) - F.col(o)) / cell).cast("int") + padding

    p = pathways.crossJoin(F.broadcast(low)).select("pathway_id", "connector", "from_level_id", "to_level_id", at("from_px", "_x0").alias("x0"), at("from_py", "_y0").alias("y0"), at("to_px", "_x0").alias("x1"), at("to_py", "_y0").alias("y1"))
    same = F.col("from_level_id") == F.col("to_level_id")
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    line = p.filter(same).withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))

    def between(a: str, b: str) -> Column:
        return F.floor(F.col(a) + F.coalesce(F.try_divide((F.col(b) - F.col(a)) * F.col("_i"), F.col("_n")), F.lit(0.0)) + 0.5).cast("int")

    free = line.select(F.col("from_level_id").alias("floor_id"), between("x0", "x1").alias("x"), between("y0", "y1").alias("y"))
    stops = p.select(F.col("from_level_id").alias("floor_id"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionByName(p.select(F.col("to_level_id").alias("floor_id"), F.col("x1").alias("x"), F.col("y1").alias("y")))
    free = free.unionByName(stops).distinct().withColumn("_free", F.lit(True))
    size = low.select(F.floor((F.col("_x1") - F.col("_x0")) / cell).cast("int").alias("_w"), F.floor((F.col("_y1") - F.col("_y0")) / cell).cast("int").alias("_h"))
    g = stops.select("floor_id").distinct().crossJoin(F.broadcast(size)).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_w") + 2 * padding))).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_h") + 2 * padding)))
    cells = g.select("floor_id", "x", "y").join(free, ["floor_id", "x", "y"], "left").select("floor_id", "x", "y", F.when(F.col("_free"), ".").otherwise("X").alias("token"))
    return cells, p.filter(~same).select("pathway_id", "connector", F.col("from_level_id").alias("from_floor"), "x0", "y0", F.col("to_level_id").alias("to_floor"), "x1", "y1")


def painted_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Cells with boxes (box_id, x0, y0, x1, y1, token; bounds included) painted over, the last of several on top."""
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    j = cells.withColumnRenamed("token", "_t").join(bounded(boxes), inside, "left")
    return j.groupBy("x", "y").agg(F.coalesce(F.max_by("token", "box_id"), F.first("_t")).alias("token"))


def border_walls(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells with the outermost rows and columns (of each key) as walls."""
    w = cells.groupBy(*keys).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    j = cells.join(w, list(keys)) if keys else cells.crossJoin(F.broadcast(w))
    edge = (F.col("x") == F.col("_x0")) | (F.col("x") == F.col("_x1")) | (F.col("y") == F.col("_y0")) | (F.col("y") == F.col("_y1"))
    return j.withColumn("token", F.when(edge, "X").otherwise(F.col("token"))).drop("_x0", "_x1", "_y0", "_y1")
