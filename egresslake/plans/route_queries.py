"""Routes, targets and rasters on buildings of orders and the harness tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from egresslake.operators import graph as G
from egresslake.operators import rasters as R
from egresslake.operators import routing as N
from egresslake.plans.trajectory_queries import rounded
from egresslake.plans.views import BUILDINGS_SQL, DOORS_SQL, EDGES_SQL, PITCH, buildings, doors, table


def start_rows(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("start_id"), (n * 7 % 20).cast("int").alias("x"), (n * 3 % 20).cast("int").alias("y"))


def entrances(spark, sf_dir):
    """A start in each building."""
    return buildings(spark, sf_dir).filter((F.col("x") % PITCH == 4) & (F.col("y") == 0)).select(F.col("building").cast("long").alias("start_id"), "x", "y")


def weighted(cells):
    """Edges that cost 1, 2 or 3, not the same both ways."""
    return G.edges(cells).withColumn("weight", (1 + (F.col("sx") * 3 + F.col("sy") * 5 + F.col("tx") * 7 + F.col("ty") * 11) % 3).cast("double"))


def q_reach_tree(spark, sf_dir):
    g = buildings(spark, sf_dir)
    return N.reach_tree(G.edges(g), doors(g))


def q_route_cells(spark, sf_dir):
    g = buildings(spark, sf_dir)
    t = N.reach_tree(G.edges(g), doors(g)).select("x", "y", F.col("px").alias("nx"), F.col("py").alias("ny"))
    p = N.followed(t, entrances(spark, sf_dir))
    return p.groupBy("start_id").agg(F.count(F.lit(1)).alias("cells"), F.max("place").alias("last"))


def q_unreachable(spark, sf_dir):
    g = buildings(spark, sf_dir)
    g = g.withColumn("walkable", F.col("walkable") & ~((F.col("x") % PITCH == 7) | (F.col("y") == 6)))
    return N.unreachable(g, G.reachable(G.edges(g), doors(g)))


def q_astar(spark, sf_dir):
    g = buildings(spark, sf_dir)
    return N.astar(weighted(g), entrances(spark, sf_dir), doors(g))


def q_route_strategies(spark, sf_dir):
    g, out = buildings(spark, sf_dir), None
    for s in ("hops", "shortest", "astar"):
        c = N.Planner(s).costs(weighted(g), entrances(spark, sf_dir), doors(g))
        out = c if out is None else out.unionByName(c)
    return out


def q_nearest_target(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("agent_id"), (F.col("s_suppkey") * 37 % 40).cast("double").alias("x"), (F.col("s_suppkey") * 11 % 40).cast("double").alias("y"), F.lit(3.0).alias("vision_radius"))
    t = start_rows(spark, sf_dir).select(F.col("start_id").alias("target_id"), (F.col("x") * 2.0).alias("tx"), (F.col("y") * 2.0).alias("ty"))
    return rounded(N.nearest_target(s, t))


def q_nearest_floor(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") % 23 / 2).alias("z"))
    f = table(spark, sf_dir, "region").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("floor_id"), (F.col("r_regionkey") * 3.0).alias("floor_z"), F.col("r_regionkey").alias("place"))
    return N.nearest_floor(p, f)


def q_service_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("connector_id"), F.col("o_orderkey").alias("agent_id"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return N.service_order(o, discipline="priority").filter("place <= 3").select("connector_id", "agent_id", "place")


def q_deduped(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey")
    return N.deduped(o, ("o_custkey", "o_orderpriority"), "o_orderkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def q_mixed_sort(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.asc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(500).select("o_orderkey")


def q_border_walls(spark, sf_dir):
    c = start_rows(spark, sf_dir).select("x", "y", F.lit(".").alias("token")).distinct()
    return R.border_walls(c)


def q_painted_boxes(spark, sf_dir):
    n = F.col("start_id")
    b = start_rows(spark, sf_dir).select(n.alias("box_id"), "x", "y", (F.col("x") + n % 3).alias("x1"), (F.col("y") + n % 4).alias("y1"), F.when(n % 2 == 0, "X").otherwise("E").alias("token")).withColumnsRenamed({"x": "x0", "y": "y0"})
    return R.painted_boxes(buildings(spark, sf_dir).select("x", "y", F.lit(".").alias("token")), b).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def q_feature_raster(spark, sf_dir):
    n, j = F.col("start_id"), F.concat
    at = F.struct((F.col("x") + 0.25).alias("a"), (F.col("y") + 0.25).alias("b"))
    box = F.to_json(F.array(F.array(F.array("p.a", "p.b"), F.array(F.col("p.a") + 2, F.col("p.b")), F.array(F.col("p.a") + 2, F.col("p.b") + 3), F.array("p.a", F.col("p.b") + 3))))
    f = start_rows(spark, sf_dir).withColumn("p", at).select(
        n.alias("feature_id"), F.when(n % 2 == 0, "Polygon").otherwise("Point").alias("kind"), F.when(n % 2 == 0, box).otherwise(j(F.lit("["), F.col("p.a").cast("string"), F.lit(","), F.col("p.b").cast("string"), F.lit("]"))).alias("coordinates"),
        F.when(n % 3 == 0, "wall").when(n % 3 == 1, "exit").otherwise("spawn").alias("role"),
    )
    return R.rasterize(R.primitives(f))


_names = [n for n in dir() if n.startswith("q_")]
QUERIES = {n: globals()[n] for n in _names}

_starts = "st AS (SELECT n_nationkey::BIGINT AS id, (n_nationkey * 7 % 20)::INT AS x, (n_nationkey * 3 % 20)::INT AS y FROM nation)"
_hops = f"{BUILDINGS_SQL}, {DOORS_SQL}, {EDGES_SQL}, b(x, y, h) AS (SELECT x, y, 0 FROM doors UNION SELECT tx, ty, h + 1 FROM b JOIN e ON sx = b.x AND sy = b.y WHERE h < 45), d AS (SELECT x, y, min(h) AS hops FROM b GROUP BY 1, 2)"
_ways = f"{BUILDINGS_SQL}, {DOORS_SQL}, {EDGES_SQL}, c(id, x, y, c) AS (SELECT building, x, y, 0 FROM st UNION SELECT id, tx, ty, c + (1 + (sx * 3 + sy * 5 + tx * 7 + ty * 11) % 3)::INT FROM c JOIN e ON sx = c.x AND sy = c.y WHERE c < 45)"
_starts10 = f"st AS (SELECT building, x, y FROM g WHERE x % {PITCH} = 4 AND y = 0)"
_ways = _ways.replace(", c(id", f", {_starts10}, c(id")
# fmt: off
SQL = {
    "q_reach_tree": f"WITH RECURSIVE {_hops}, p AS (SELECT c.x, c.y, min((a.x, a.y)) AS p FROM d c JOIN e ON tx = c.x AND ty = c.y JOIN d a ON a.x = sx AND a.y = sy AND a.hops = c.hops - 1 GROUP BY 1, 2) SELECT d.x, d.y, hops, p[1] AS px, p[2] AS py FROM d LEFT JOIN p USING (x, y)",
    "q_route_cells": f"WITH RECURSIVE {_hops}, {_starts10} SELECT building::BIGINT AS start_id, hops + 1 AS cells, hops AS last FROM st JOIN d USING (x, y)",
    "q_unreachable": f"""WITH RECURSIVE {BUILDINGS_SQL.replace('g AS', 'g0 AS', 1)}, g AS (SELECT x, y, building, walkable AND x % {PITCH} <> 7 AND y <> 6 AS walkable FROM g0), {DOORS_SQL}, {EDGES_SQL},
      b AS (SELECT x, y FROM doors UNION SELECT tx, ty FROM b JOIN e ON sx = b.x AND sy = b.y) SELECT x, y FROM g WHERE walkable EXCEPT SELECT x, y FROM b""",
    "q_astar": f"WITH RECURSIVE {_ways} SELECT id::BIGINT AS start_id, arg_min(x, (c, x, y)) AS gx, arg_min(y, (c, x, y)) AS gy, min(c)::DOUBLE AS cost FROM c JOIN doors USING (x, y) GROUP BY id",
    "q_route_strategies": f"""WITH RECURSIVE {_ways}, w AS (SELECT id, min(c) AS c FROM c JOIN doors USING (x, y) GROUP BY id), b(x, y, h) AS (SELECT x, y, 0 FROM doors UNION SELECT tx, ty, h + 1 FROM b JOIN e ON sx = b.x AND sy = b.y WHERE h < 45), d AS (SELECT x, y, min(h) AS h FROM b GROUP BY 1, 2)
      SELECT building::BIGINT AS start_id, h::DOUBLE AS cost, 'hops' AS strategy FROM st JOIN d USING (x, y) UNION ALL SELECT id::BIGINT, c::DOUBLE, s FROM w, (VALUES ('shortest'), ('astar')) v(s)""",
    "q_nearest_target": f"""WITH {_starts}, a AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 40)::DOUBLE AS x, (s_suppkey * 11 % 40)::DOUBLE AS y FROM supplier), d AS (SELECT a.id, st.id AS t, sqrt((a.x - st.x * 2) * (a.x - st.x * 2) + (a.y - st.y * 2) * (a.y - st.y * 2)) AS d FROM a, st)
      SELECT id AS agent_id, arg_min(t, (d > 3, d, t)) AS target_id, round(min(d), 6) AS distance FROM d GROUP BY 1""",
    "q_nearest_floor": "SELECT s_suppkey AS point_id, 'f' || (SELECT arg_min(r_regionkey, (abs(r_regionkey * 3.0 - (s_suppkey % 23) / 2.0), r_regionkey)) FROM region) AS floor_id FROM supplier",
    "q_service_order": "WITH o AS (SELECT o_custkey % 7 AS connector_id, o_orderkey AS agent_id, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderpriority[1]::INT DESC, o_orderkey)::INT AS place FROM orders) SELECT * FROM o WHERE place <= 3",
    "q_deduped": "SELECT o_orderpriority, count(*) AS n, sum(k)::BIGINT AS keys FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1",
    "q_mixed_sort": "SELECT o_orderkey FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 500",
    "q_border_walls": f"WITH {_starts}, c AS (SELECT DISTINCT x, y FROM st) SELECT x, y, CASE WHEN x IN ((SELECT min(x) FROM c), (SELECT max(x) FROM c)) OR y IN ((SELECT min(y) FROM c), (SELECT max(y) FROM c)) THEN 'X' ELSE '.' END AS token FROM c",
    "q_painted_boxes": f"""WITH {BUILDINGS_SQL}, {_starts}, p AS (SELECT g.x, g.y, arg_max(CASE WHEN id % 2 = 0 THEN 'X' ELSE 'E' END, id) AS t FROM g LEFT JOIN st ON g.x BETWEEN st.x AND st.x + id % 3 AND g.y BETWEEN st.y AND st.y + id % 4 GROUP BY 1, 2) SELECT coalesce(t, '.') AS token, count(*) AS n FROM p GROUP BY 1""",
    "q_feature_raster": f"""WITH {_starts}, b AS (SELECT min(x) + 0.25 AS x0, min(y) + 0.25 AS y0, max(x + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END) + 0.25 AS x1, max(y + CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END) + 0.25 AS y1 FROM st),
      s AS (SELECT *, ceil(x1 - x0)::INT + 3 AS w, ceil(y1 - y0)::INT + 3 AS h FROM b), c AS (SELECT i::INT AS x, j::INT AS y, x0 + i - 0.5 AS wx, y0 + j - 0.5 AS wy FROM s, range(60) t(i), range(60) u(j) WHERE i < w AND j < h),
      k AS (SELECT c.x, c.y, arg_max(CASE id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'E' ELSE '@' END, id) AS token FROM c LEFT JOIN st ON (id % 2 = 0 AND wx >= st.x + 0.25 AND wx < st.x + 2.25 AND wy >= st.y + 0.25 AND wy < st.y + 3.25) OR (id % 2 = 1 AND abs(wx - st.x - 0.25) <= 0.5 AND abs(wy - st.y - 0.25) <= 0.5) GROUP BY 1, 2)
      SELECT x, y, coalesce(token, '.') AS token FROM k""",
}
# fmt: on
