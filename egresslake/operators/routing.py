"""Routes on a grid graph: trees with parents, paths, searches guided by a lower bound, and a planner with a fallback, a store and counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.operators.checkpoints import cut
from egresslake.operators.graph import hop_tree, reachable, shortest
from egresslake.operators.tiles import relaxed, walked


def reach_tree(edge: DataFrame, sources: DataFrame) -> DataFrame:
    """(x, y, hops, px, py): cells that the sources reach, and of each the cell before it (the least of several); NULL for sources.

    edge leads from a source outwards; on a grid that is the same as inwards.
    """
    return hop_tree(edge, sources)


def followed(next_cell: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, place, x, y): the cells from each start on, by next_cell (x, y, nx, ny; NULL at the end), the start first.

    All starts go on tile by tile. Cycles are an error of the caller's table.
    """
    return walked(next_cell, starts)


def unreachable(cells: DataFrame, seen: DataFrame) -> DataFrame:
    return cells.filter("walkable").select("x", "y").join(seen, ["x", "y"], "left_anti")


def astar(edge: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(start_id, gx, gy, cost) of each start that reaches a goal: least cost, then least goal.

    All starts are searched together, tile by tile; a cell is dropped as soon as its cost and the lower bound of what is left (Manhattan
    distance to a goal of its tile or out of the tile) are over the best cost that its start has found. Edges must cost 1 or more.
    """
    end = relaxed(edge, starts, goals).join(goals.select("x", "y").distinct(), ["x", "y"])
    end = end.groupBy("start_id").agg(F.min(F.struct("cost", F.col("x").alias("gx"), F.col("y").alias("gy"))).alias("b"))
    return end.select("start_id", "b.gx", "b.gy", "b.cost")


def _by_shortest(edge: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    back = edge.select("sx", "sy", "tx", "ty", "weight")
    s = shortest(back, goals)
    return starts.join(s, ["x", "y"]).select("start_id", "cost")


def _by_hops(edge: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    back = edge.select(F.col("tx").alias("sx"), F.col("ty").alias("sy"), F.col("sx").alias("tx"), F.col("sy").alias("ty"))
    return starts.join(reachable(back, goals), ["x", "y"]).select("start_id", F.col("hops").cast("double").alias("cost"))


STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {"shortest": _by_shortest, "astar": lambda e, s, g: astar(e, s, g).select("start_id", "cost"), "hops": _by_hops}


def cells_signature(cells: DataFrame) -> tuple:
    """Equal for equal sets of cells (x, y), in any order: their number, and sum and XOR of 64-bit hashes."""
    h = F.xxhash64(F.col("x").cast("long"), F.col("y").cast("long"))
    return tuple(cells.select("x", "y").distinct().agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


class Planner:
    """Costs of routes by a named strategy; starts that it finds no way for are asked of `fallback`.

    Answers for equal strategy, goals and hazards (their signatures) are kept as tables; counts tells what was asked, kept and passed on.
    """

    def __init__(self, strategy: str = "shortest", fallback: str = "shortest") -> None:
        self.strategy, self.fallback = (s if s in STRATEGIES else "shortest" for s in (strategy, fallback))
        self.counts: Counter = Counter()
        self._kept: dict[tuple, DataFrame] = {}

    def costs(self, edge: DataFrame, starts: DataFrame, goals: DataFrame, signature: str = "") -> DataFrame:
        """(start_id, cost, strategy)."""
        key = (self.strategy, signature, edge.semanticHash(), *cells_signature(goals), starts.semanticHash())
        self.counts["asked"] += 1
        if key in self._kept:
            self.counts["kept"] += 1
            return self._kept[key]
        found = cut(STRATEGIES[self.strategy](edge, starts, goals).withColumn("strategy", F.lit(self.strategy)))
        lost = cut(starts.join(found, "start_id", "left_anti"))
        if self.fallback != self.strategy and lost.limit(1).count():
            self.counts["passed_on"] += 1
            found = found.unionByName(STRATEGIES[self.fallback](edge, lost, goals).withColumn("strategy", F.lit(self.fallback)))
        self._kept[key] = found
        return found


def nearest_target(agents: DataFrame, targets: DataFrame) -> DataFrame:
    """(agent_id, target_id, distance): the nearest visible target, else the nearest of all. targets: a scenario's own (target_id, tx, ty); agents: agent_id, x, y, vision_radius.

    All targets go to each row as one array, and the least is taken there: no rows are made and none are shuffled. Without targets there are no rows.
    """
    one = bounded(targets.select("target_id", "tx", "ty")).agg(F.collect_list(F.struct("tx", "ty", "target_id")).alias("_t"))
    d = agents.select("agent_id", "x", "y", "vision_radius").crossJoin(F.broadcast(one))

    def gap(t: Column) -> Column:
        d = F.sqrt((F.col("x") - t["tx"]) ** 2 + (F.col("y") - t["ty"]) ** 2)
        return F.struct((d > F.col("vision_radius")).alias("far"), d.alias("distance"), t["target_id"].alias("target_id"))

    return d.withColumn("b", F.array_min(F.transform("_t", gap))).filter("b is not null").select("agent_id", "b.target_id", "b.distance")


def nearest_floor(points: DataFrame, floors: DataFrame) -> DataFrame:
    """points (point_id, z) with the floor (floor_id, floor_z, place) of the nearest height, the first listed of several."""
    one = bounded(floors).agg(F.collect_list(F.struct("floor_z", "place", "floor_id")).alias("_f"))
    near = F.array_min(F.transform("_f", lambda f: F.struct(F.abs(f["floor_z"] - F.col("z")).alias("d"), f["place"].alias("place"), f["floor_id"].alias("floor_id"))))
    return points.crossJoin(F.broadcast(one)).select("point_id", near["floor_id"].alias("floor_id"))


def service_order(queue: DataFrame, keys: tuple[str, ...] = ("connector_id",), discipline: str = "fifo") -> DataFrame:
    """queue (keys, agent_id, seq, priority) with place: first come first, or highest priority first and then first come."""
    order = [F.asc("seq")] if discipline == "fifo" else [F.desc("priority"), F.asc("seq")]
    return queue.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "agent_id")))


def deduped(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The first row of each key, by order."""
    first = F.min_by(F.struct(*rows.columns), F.col(order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(first.alias("r")).select("r.*")
