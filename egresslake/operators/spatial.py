"""Joins by distance, time and shape.

Radius joins are equi-joins on grid buckets as wide as the radius, so only neighbouring cells meet;
nearest-in-time joins and interval joins
go by one sorted sequence, dealt by ranges. Small sides that are broadcast
(hazards, shapes, exits) are tables of a scenario, some dozens of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import SMALL_ROWS, bounded
from egresslake.functions.nullsafe import or_zero
from egresslake.functions.scalars import falloff
from egresslake.operators.checkpoints import cut


#: Buckets are wider than the radius by this share, so that no pair is lost where quotients or distances are rounded (coordinates up to 10^12 radii).
MARGIN = 2.0**-10


def _bucketed(df: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """df with the bucket (_bx, _by) of each row; rows at most the radius apart are in one bucket or in neighbouring ones."""
    wide = radius * (1 + MARGIN)
    return df.withColumn("_bx", F.floor(F.col(x) / wide)).withColumn("_by", F.floor(F.col(y) / wide))


def _beyond(df: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """df once for each step (_n), moved by it to another bucket."""
    n = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in steps]))
    return df.withColumn("_n", n).withColumn("_bx", F.try_add("_bx", "_n.dx")).withColumn("_by", F.try_add("_by", "_n.dy"))


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, keys: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """Pairs (columns l_*, r_*, distance) of rows with equal keys and least < distance <= radius."""
    def bucket(df: DataFrame, p: str) -> DataFrame:
        return _bucketed(df.withColumnsRenamed({c: f"{p}{c}" for c in df.columns if c not in keys}), radius, f"{p}x", f"{p}y")

    a = _beyond(bucket(left, "l_"), [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]).drop("_n")
    d = F.sqrt((F.col("l_x") - F.col("r_x")) ** 2 + (F.col("l_y") - F.col("r_y")) ** 2)
    j = a.join(bucket(right, "r_"), [*keys, "_bx", "_by"]).withColumn("distance", d).drop("_bx", "_by")
    return j.filter((F.col("distance") <= radius) & (F.col("distance") > least if least else F.lit(True)))


def near_pairs(rows: DataFrame, radius: float, keys: Sequence[str], ident: str, least: float = 0.0, block: int = 1000) -> DataFrame:
    """Every two rows (keys, a, b, distance) with equal keys, a < b by ident and least < distance <= radius.

    Rows of a bucket are dealt by ident to blocks of about `block`, so a bucket may hold any share of the rows. Each two blocks of one or of
    neighbouring buckets meet once, in a row that holds both, and their pairs are made there; only blocks are shuffled, no pairs.
    """
    at = [*keys, "_bx", "_by"]
    r = _bucketed(rows.select(*keys, F.col(ident).alias("i"), "x", "y").dropna(), radius)
    many = r.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_m")).filter("_m > 1")
    many = F.broadcast(many)  # at most 1 / block of all rows
    m = F.coalesce("_m", F.lit(1))
    dealt = r.join(many, at, "left").withColumn("_j", F.pmod(F.xxhash64("i"), m).cast("int"))
    blocks = cut(dealt.groupBy(*at, "_j").agg(F.collect_list(F.struct("i", "x", "y")).alias("_r")))
    # a step and its opposite give the same buckets, so half of the steps are enough
    a = _beyond(blocks.withColumnsRenamed({"_j": "_i", "_r": "_l"}), [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)])
    a = a.withColumn("_own", (F.col("_n.dx") == 0) & (F.col("_n.dy") == 0)).drop("_n").join(many, at, "left")
    a = a.withColumn("_j", F.explode(F.sequence(F.when(F.col("_own"), F.col("_i")).otherwise(0), m - 1))).withColumn("_own", F.col("_own") & (F.col("_i") == F.col("_j")))
    both = a.join(blocks.hint("merge"), [*at, "_j"]).select(*keys, "_own", "_l", "_r")
    p = both.select(*keys, "_own", "_r", F.inline("_l").alias("l_i", "l_x", "l_y")).select(*keys, "_own", "l_i", "l_x", "l_y", F.inline("_r").alias("r_i", "r_x", "r_y"))
    dx, dy = F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y")
    p = p.filter((F.col("l_i") < F.col("r_i")) | (~F.col("_own") & (F.col("l_i") > F.col("r_i")))).withColumn("distance", F.sqrt(dx * dx + dy * dy))
    p = p.filter((F.col("distance") <= radius) & (F.col("distance") > least if least else F.lit(True)))
    return p.select(*keys, F.least("l_i", "r_i").alias("a"), F.greatest("l_i", "r_i").alias("b"), "distance")


def within_reach(left: DataFrame, things: DataFrame, reach: Column, most: int = SMALL_ROWS) -> DataFrame:
    """Rows of left (x, y) with each thing (tx, ty) at most `reach` away; reach is a column of left.

    Few things go to every task. More are met in an equi-join on buckets as wide as the greatest reach, so that only rows of neighbouring buckets meet.
    """
    near = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 <= F.col("_reach") ** 2
    a = left.withColumn("_reach", reach.cast("double"))
    if things.limit(most + 1).count() <= most:
        return a.join(F.broadcast(things), near).drop("_reach")
    width = a.agg(F.max("_reach")).first()[0]
    if not width or width <= 0:
        width = 1.0
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    b = things.withColumn("_n", F.explode(around)).withColumn("_bx", F.floor(F.col("tx") / width) + F.col("_n.dx")).withColumn("_by", F.floor(F.col("ty") / width) + F.col("_n.dy")).drop("_n")
    a = a.withColumn("_bx", F.floor(F.col("x") / width)).withColumn("_by", F.floor(F.col("y") / width))
    return a.join(b, ["_bx", "_by"]).filter(near).drop("_reach", "_bx", "_by")


def local_density(samples: DataFrame, radius: float, keys: Sequence[str], ident: str) -> DataFrame:
    """(keys, ident, neighbours, density): other rows within the radius, and their number per area; ident tells rows apart.

    Rows of one place are counted first, so only places meet.
    """
    at = [*keys, "x", "y"]
    places = samples.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    n = radius_pairs(places.drop("n"), places, radius, keys).groupBy(*keys, F.col("l_x").alias("x"), F.col("l_y").alias("y")).agg(F.sum("r_n").alias("_n"))
    d = samples.select(*at, ident).join(n, at, "left").withColumn("neighbours", F.coalesce(F.col("_n") - 1, F.lit(0))).select(*keys, ident, "neighbours")
    return d.withColumn("density", F.col("neighbours") / (3.141592653589793 * radius * radius))


def _beside(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, **names: bool) -> DataFrame:
    """rows with, for each name, the nearest `value` that is not NULL at or after each row (True) or at or before it (False), by order among equal keys.

    Rows are dealt by ranges of (keys, order), so no key is in one task; what lies past the ends of a range comes from a table that has a row
    for each range whose key goes on in other ranges.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id()))
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = dealt.groupBy(*keys, "_pid").agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    out = dealt
    for name, after in names.items():
        turn = F.desc if after else F.asc
        w = Window.partitionBy(*keys, "_pid").orderBy(*[turn(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
        others = Window.partitionBy(*keys).orderBy(turn("_pid")).rowsBetween(Window.unboundedPreceding, -1)
        past = ends.withColumn("_past", F.last("_first" if after else "_last", True).over(others)).filter("_past is not null")
        past = past.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_past")
        same = F.col("_pid") == F.col("_p")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = out.withColumn(name, F.last(value, True).over(w)).join(F.broadcast(past), same, "left").withColumn(name, F.coalesce(name, "_past")).drop("_past", "_p", *[f"_k{i}" for i in range(len(keys))])
    return out.drop("_pid")


def nearest_in_time(events: DataFrame, samples: DataFrame, event_time: str, sample_time: str, keys: Sequence[str], ident: str) -> DataFrame:
    """events with nearest_s: the sample time nearest to the event's among equal keys; the earlier of two as near.

    Both sides go into one sorted sequence per key; the nearest is the last sample at or before, or the first at or after.
    """
    s = samples.select(*keys, F.col(sample_time).alias("_t")).distinct().withColumn("_s", F.col("_t"))
    e = events.withColumn("_t", F.col(event_time)).withColumn("_s", F.lit(None).cast("double"))
    u = e.unionByName(s, allowMissingColumns=True).withColumn("_is", F.col("_s").isNull().cast("int"))
    u = _beside(u, keys, ["_t", "_is", ident], "_s", _a=False, _b=True)
    near = F.when(F.col("_b").isNull() | (F.col("_t") - F.col("_a") <= F.col("_b") - F.col("_t")), F.col("_a")).otherwise(F.col("_b"))
    near = F.when(F.col("_a").isNull(), F.col("_b")).otherwise(near)
    return u.filter(F.col(ident).isNotNull() & (F.col("_is") == 1)).withColumn("nearest_s", near).drop("_t", "_s", "_is", "_a", "_b")


def interval_first(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: float, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """For each left row the first right row (by time, then id) of equal keys within the tolerance: (left_id, right_id, gap).

    No pairs are made: both sides go into one sorted sequence, left rows at the begin of their span, and each takes the next right row.
    """
    a = left.select(*keys, left_id, F.col(left_time).alias("_lt")).dropna(subset=[*keys, "_lt"]).distinct()
    a = a.select("*", (F.col("_lt") - tolerance).alias("_t"), F.lit(0).alias("_is"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_is"), F.struct(F.col(right_time).alias("_rt"), F.col(right_id).alias("_rid")).alias("_r")).filter("_t is not null").dropna(subset=list(keys))
    u = a.unionByName(b, allowMissingColumns=True).withColumn("_i", F.coalesce("_r._rid", left_id))
    f = _beside(u, keys, ["_t", "_is", "_i"], "_r", f=True).filter((F.col("_is") == 0) & (F.col("f._rt") <= F.col("_lt") + tolerance))
    return f.select(*keys, left_id, F.col("f._rid").alias("match_id"), (F.col("f._rt") - F.col("_lt")).alias("gap"))


def hazard_load(samples: DataFrame, hazards: DataFrame, ident: Sequence[str], categories: Sequence[str] = ("toxic", "heat")) -> DataFrame:
    """Per sample: summed intensity, strongest hazard, product of visibilities, and load by category; no shuffle.

    hazards: hazard_id, category, hx, hy, radius, severity; a scenario's own small table.
    """
    one = bounded(hazards).agg(F.array_sort(F.collect_list(F.struct("hazard_id", "category", "hx", "hy", "radius", "severity"))).alias("_h"))
    at = F.transform("_h", lambda h: F.struct(falloff(F.sqrt((F.col("x") - h["hx"]) ** 2 + (F.col("y") - h["hy"]) ** 2), h["radius"], h["severity"]).alias("i"), h["hazard_id"].alias("id"), h["category"].alias("category")))
    j = samples.crossJoin(F.broadcast(one)).select(*ident, at.alias("_at"))

    def total(value) -> Column:
        return F.aggregate("_at", F.lit(0.0), lambda s, h: s + value(h))

    product = F.exp(total(lambda h: F.ln(F.greatest(1.0 - h["i"], F.lit(1e-12)))))
    return j.select(
        *ident, total(lambda h: h["i"]).alias("load"), F.array_max("_at")["id"].alias("strongest"), product.alias("visibility"),
        *[total(lambda h, c=c: F.when(h["category"] == c, h["i"]).otherwise(0.0)).alias(f"{c}_load") for c in categories],
    )


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over an array of points (x, y); the ring need not repeat its first point."""
    n = F.size(ring)

    def toggles(i: Column) -> Column:
        a, b = ring[i], ring[F.pmod(i + 1, n)]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + toggles(i)) % 2 == 1


def rasterized(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Cells (x, y) with the token of the last shape (by shape_id) that holds their centre; inclusive bounds.

    shapes: shape_id, kind (rect or circle), x0, y0, x1, y1 (a circle's centre and radius in x0, y0, x1), token.
    """
    cx, cy = F.col("x") + 0.5, F.col("y") + 0.5
    rect = (F.col("kind") == "rect") & cx.between(F.col("x0"), F.col("x1")) & cy.between(F.col("y0"), F.col("y1"))
    circle = (F.col("kind") == "circle") & ((cx - F.col("x0")) ** 2 + (cy - F.col("y0")) ** 2 <= F.col("x1") ** 2)
    j = cells.join(bounded(shapes), rect | circle, "left")
    return j.groupBy("x", "y").agg(F.coalesce(F.max_by("token", "shape_id"), F.lit(".")).alias("token"))


def line_of_sight(pairs: DataFrame, walls: DataFrame, reach: float | None = None) -> DataFrame:
    """pairs (pair_id, ax, ay, bx, by; optionally a_floor, b_floor) with clear.

    Clear: within reach, on one floor, and no point between the ends, one every half metre, is in a wall cell (x, y; with
    floors, floor_id). The ends themselves are not tested. Pairs out of reach never meet the walls.
    """
    floors = "a_floor" in pairs.columns
    d = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    near = F.lit(True) if reach is None else d <= reach
    p = pairs.withColumn("_n", F.greatest(F.lit(2), F.ceil(2 * d).cast("int"))).withColumn("_may", near & (F.col("a_floor") == F.col("b_floor") if floors else F.lit(True)))
    p = p.withColumn("_i", F.explode(F.when(F.col("_may"), F.sequence(F.lit(1), F.col("_n") - 1)).otherwise(F.array(F.lit(0))))).withColumn("_f", F.col("_i") / F.col("_n"))
    p = p.withColumn("x", F.floor(F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("_f")).cast("int")).withColumn("y", F.floor(F.col("ay") + (F.col("by") - F.col("ay")) * F.col("_f")).cast("int"))
    on = ["x", "y", *(["floor_id"] if floors else [])]
    p = p.withColumn("floor_id", F.col("a_floor")) if floors else p
    p = p.join(walls.select(*on, F.lit(True).alias("wall")).distinct(), on, "left")
    return p.groupBy("pair_id").agg((F.bool_and("_may") & ~F.coalesce(F.bool_or("wall"), F.lit(False))).alias("clear"))
