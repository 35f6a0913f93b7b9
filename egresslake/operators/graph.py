"""Grids as graphs: reachability, shortest paths, corridor zones.

Searches go by tiles (tiles.py); components by star steps. Lineage is cut every round with checkpoint().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.operators.checkpoints import cut
from egresslake.operators.tiles import code_x, code_y, relaxed


def numbered(rows: DataFrame, order: Sequence[str], name: str = "place") -> DataFrame:
    """rows with their place from 0 in this order over the whole table, which must tell all rows apart.

    Rows are dealt by ranges and numbered inside each; ranges begin where the ones before end, by a table of one row per range.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(*order))
    return dealt.withColumn("_in", inside).join(F.broadcast(starts), "_pid").withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_pid", "_in", "_start")


def grid(spark: SparkSession, width: int = 20, height: int = 20) -> DataFrame:
    """A test layout (x, y, walkable): walls where (7 x + 11 y) mod 5 is 0 and the cell is not on the border."""
    g = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == width - 1) | (F.col("y") == height - 1)
    return g.withColumn("walkable", border | ((F.col("x") * 7 + F.col("y") * 11) % 5 != 0))


def edges(cells: DataFrame, connectors: DataFrame | None = None) -> DataFrame:
    """Directed edges (sx, sy, tx, ty, weight) between walkable neighbours, and connectors both ways."""
    w = cells.filter("walkable").select("x", "y")
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    s = w.select(F.col("x").alias("sx"), F.col("y").alias("sy"), step.alias("d")).select("sx", "sy", (F.col("sx") + F.col("d.dx")).alias("tx"), (F.col("sy") + F.col("d.dy")).alias("ty"))
    e = s.join(w.select(F.col("x").alias("tx"), F.col("y").alias("ty")), ["tx", "ty"], "left_semi").select("sx", "sy", "tx", "ty", F.lit(1.0).alias("weight"))
    if connectors is not None:
        back = connectors.select(F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"), "weight")
        e = e.unionByName(connectors.select(e.columns)).unionByName(back)
    return e


def reachable(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, y, hops) for all cells that edges lead to from the sources (x, y): breadth-first, any number of sources."""
    return hop_tree(edge, sources).select("x", "y", "hops")


def hop_tree(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """reachable() with px, py: the cell before each (the least of several); NULL for sources."""
    found = relaxed(edge.select("sx", "sy", "tx", "ty"), sources.select(F.lit(0).alias("start_id"), "x", "y"))
    return found.select("x", "y", F.col("cost").cast("int").alias("hops"), code_x(F.col("before")).alias("px"), code_y(F.col("before")).alias("py"))


def shortest(edge: DataFrame, goals: DataFrame) -> DataFrame:
    """(x, y, cost, nx, ny): least cost to any goal and the next cell on the way (least of equal ones), by relaxation from the goals back."""
    back = edge.select(F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"), "weight")
    found = relaxed(back, goals.select(F.lit(0).alias("start_id"), "x", "y"))
    nxt = F.when(F.col("cost") != 0, F.col("before"))
    return found.select("x", "y", "cost", code_x(nxt).alias("nx"), code_y(nxt).alias("ny"))


def corridor_cells(cells: DataFrame, exits: DataFrame) -> DataFrame:
    """(x, y, orientation): walkable cells, not exits, with one or two walkable neighbours in line and at most four of eight open."""
    w = cells.filter("walkable").select("x", "y")
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    n = w.withColumn("d", around).select("x", "y", "d.dx", "d.dy", (F.col("x") + F.col("d.dx")).alias("tx"), (F.col("y") + F.col("d.dy")).alias("ty"))
    n = n.join(w.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(True).alias("open")), ["tx", "ty"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    straight = F.col("open") & (F.col("dx") * F.col("dy") == 0)
    g = n.groupBy("x", "y").agg(F.count_if("open").alias("openness"), F.count_if(straight & (F.col("dy") == 0)).alias("h"), F.count_if(straight & (F.col("dx") == 0)).alias("v"))
    kind = F.when((F.col("h") > 0) & (F.col("v") == 0), "horizontal").when((F.col("v") > 0) & (F.col("h") == 0), "vertical")
    g = g.filter("openness <= 4").withColumn("orientation", kind).filter("orientation is not null").select("x", "y", "orientation")
    return g.join(exits.select("x", "y"), ["x", "y"], "left_anti")


def components(edge: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (u, v) of long ids: the component is its least node.

    Large-star and small-star steps in turn: neighbours, and then nodes, point to the least node that they know, so a chain of n nodes takes
    about log n rounds. Each step is a grouped minimum and a join.
    """
    e = cut(edge.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
        n, nodes = new.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and not new.select("v").join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = new


def cell_id(x: str = "x", y: str = "y") -> Column:
    """A long for a cell, in the order of (x, y)."""
    return F.shiftleft(F.col(x).cast("long"), 32) + F.col(y).cast("long") + F.lit(1 << 31)


def corridor_zones(cells: DataFrame, exits: DataFrame) -> DataFrame:
    """(x, y, orientation, zone_id): connected corridor cells of one orientation; zones numbered by their least cell."""
    c = cut(corridor_cells(cells, exits).withColumn("id", cell_id()))
    pairs = [
        c.select("orientation", F.col("id").alias("u"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")).join(c.select("orientation", "x", "y", F.col("id").alias("v")), ["orientation", "x", "y"]).select("u", "v")
        for dx, dy in ((1, 0), (0, 1))
    ]
    found = components(pairs[0].unionByName(pairs[1])).withColumnRenamed("node", "id")
    c = cut(c.join(found, "id", "left").withColumn("label", F.coalesce("component", "id")))
    z = numbered(c.select("label").distinct(), ["label"]).select("label", F.concat(F.lit("bn_"), (F.col("place") + 1).cast("string")).alias("zone_id"))
    return c.join(z, "label").select("x", "y", "orientation", "zone_id")
