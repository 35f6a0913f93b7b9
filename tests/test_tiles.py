"""Searches by tiles: ways over tile borders against a plain search, many goals, and what a run shuffles."""

import heapq

import pytest
from pyspark.sql import functions as F

from egresslake.operators import graph, routing
from egresslake.operators.tiles import SIDE


def long_grid(spark):
    """A layout over several tiles, also left of 0, whose ways cross tile borders there and back."""
    w, h = 2 * SIDE + 20, 23
    g = spark.range(w * h).select((F.col("id") % w - 30).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    return g.withColumn("walkable", (F.pmod(F.col("x") * 7 + F.col("y") * 11 + F.col("x") * F.col("y"), F.lit(5)) != 0) & ~((F.pmod("x", F.lit(10)) == 3) & (F.col("y") < 20)) & ~((F.pmod("x", F.lit(10)) == 8) & (F.col("y") > 2)))


def weighted(cells):
    return graph.edges(cells).withColumn("weight", (1 + F.pmod(F.col("sx") * 3 + F.col("sy") * 5 + F.col("tx") * 7, F.lit(3))).cast("double"))


def plain(edges, starts):
    """Least costs by Dijkstra's search."""
    out = {}
    for s, t, w in edges:
        out.setdefault(s, []).append((t, w))
    best, heap = {}, [(0.0, s) for s in starts]
    while heap:
        c, s = heapq.heappop(heap)
        if s in best:
            continue
        best[s] = c
        for t, w in out.get(s, ()):
            heapq.heappush(heap, (c + w, t))
    return best


@pytest.fixture(scope="module")
def layout(spark):
    cells = long_grid(spark)
    e = weighted(cells).collect()
    return cells, [((r.sx, r.sy), (r.tx, r.ty), r.weight) for r in e]


def test_shortest_over_tiles(spark, layout):
    cells, e = layout
    goals = [(2, 20), (80, 2), (500, 500)]
    want = plain([(t, s, w) for s, t, w in e], goals)
    rows = graph.shortest(weighted(cells), spark.createDataFrame(goals, "x int, y int")).collect()
    assert {(r.x, r.y): r.cost for r in rows} == want and len(rows) == len(want)
    for r in rows:
        best = min(((want[t] + w, *t) for s, t, w in e if s == (r.x, r.y) and t in want), default=None) if r.cost else None
        assert (r.nx, r.ny) == (best[1:] if best else (None, None))


def test_reach_and_tree_over_tiles(spark, layout):
    cells, e = layout
    want = plain([(s, t, 1.0) for s, t, _ in e], [(2, 20)])
    rows = routing.reach_tree(graph.edges(cells), spark.createDataFrame([(2, 20)], "x int, y int")).collect()
    assert {(r.x, r.y): r.hops for r in rows} == want and max(want.values()) > 2 * SIDE
    for r in rows:
        assert (r.px, r.py) == min((s for s, t, _ in e if t == (r.x, r.y) and want[s] == r.hops - 1), default=(None, None))
    assert {(r.x, r.y): r.hops for r in graph.reachable(graph.edges(cells), spark.createDataFrame([(2, 20)], "x int, y int")).collect()} == want


def test_followed_over_tiles(spark, layout):
    cells, _ = layout
    tree = routing.reach_tree(graph.edges(cells), spark.createDataFrame([(2, 20)], "x int, y int")).localCheckpoint()
    at = {(r.x, r.y): r for r in tree.collect()}
    ends = sorted(at, key=lambda c: -at[c].hops)[:3]
    starts = [(i, *c) for i, c in enumerate(ends)] + [(7, 999, 999), (8, 2, 20)]
    rows = routing.followed(tree.select("x", "y", F.col("px").alias("nx"), F.col("py").alias("ny")), spark.createDataFrame(starts, "start_id long, x int, y int")).collect()
    for i, c in enumerate(ends):
        way = [(r.x, r.y) for r in sorted((r for r in rows if r.start_id == i), key=lambda r: r.place)]
        want = [c]
        while at[want[-1]].px is not None:
            want.append((at[want[-1]].px, at[want[-1]].py))
        assert way == want
    assert not [r for r in rows if r.start_id == 7] and [(r.place, r.x, r.y) for r in rows if r.start_id == 8] == [(0, 2, 20)]


def test_astar_over_tiles_takes_the_least_of_equal_goals(spark, layout):
    cells, e = layout
    goals = [(x, y) for x in (-29, 5, 15, 50, 80) for y in (2, 20)]
    starts = [(1, -20, 11), (2, 40, 11), (3, 47, 16), (4, 77, 11), (5, 2, 20)]
    rows = routing.astar(weighted(cells), spark.createDataFrame(starts, "start_id long, x int, y int"), spark.createDataFrame(goals, "x int, y int")).collect()
    want = {}
    for i, x, y in starts:
        d = plain(e, [(x, y)])
        hit = min(((d[g], g) for g in goals if g in d), default=None)
        if hit:
            want[i] = hit
    assert {r.start_id: (r.cost, (r.gx, r.gy)) for r in rows} == want


def many(spark, n=20_001):
    """Pairs of cells, of which one is a start and the other a goal: more goals than may be compared with every row."""
    x = (F.col("id") * 3).cast("int")
    e = spark.range(n).select(x.alias("sx"), F.lit(0).alias("sy"), (x + 1).alias("tx"), F.lit(0).alias("ty"), F.lit(2.0).alias("weight"))
    return e, spark.range(n).select(F.col("id").alias("start_id"), x.alias("x"), F.lit(0).alias("y")), spark.range(n).select((x + 1).alias("x"), F.lit(0).alias("y"))


def test_astar_with_many_goals(spark):
    e, starts, goals = many(spark)
    row = routing.astar(e, starts, goals).agg(F.count(F.lit(1)), F.min("cost"), F.max("cost"), F.count_if(F.col("gx") == F.col("start_id") * 3 + 1)).first()
    assert tuple(row) == (20_001, 2.0, 2.0, 20_001)


def test_planner_with_many_goals(spark):
    e, starts, goals = many(spark)
    p = routing.Planner("shortest")
    assert p.costs(e, starts, goals).count() == 20_001
    assert p.costs(e, starts, goals.orderBy(F.desc("x"))).count() == 20_001 and p.counts["kept"] == 1
    assert p.costs(e, starts, goals.filter("x > 1")).count() == 20_000 and p.counts["kept"] == 1
