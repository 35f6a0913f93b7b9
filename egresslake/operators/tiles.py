"""Searches on a grid graph by tiles: a round settles whole tiles, and only what crosses their borders goes on to the next round.

A cell's tile is its square of SIDE by SIDE cells; an edge lies in the tile of the cell that it leaves. The edges of a tile are one row of
arrays, made once. A round joins the messages to cells with the tiles (and with what is known of their cells), relaxes each tile until
nothing in it changes, and sends costs over its outward edges. So edges are shuffled once or twice in all, not once for each step, and there
are as many rounds as tiles on a way. SIDE is a matter of speed: results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.functions.bounds import SMALL_ROWS
from egresslake.operators.checkpoints import cut

SIDE = 48
AREA = SIDE * SIDE
#: Rounds after which the known cells are written anew.
EVERY = 10
#: Tiles that a task holds at a time.
BATCH = 128
#: Costs that differ by no more are the same for a guided search.
EPS = 1e-12
_LOW = 1 << 31
#: The code of no cell; after the codes of all cells.
NONE = (1 << 63) - 1


def code(x: Column, y: Column) -> Column:
    """A long for a cell, in the order of (x, y)."""
    return F.shiftleft(x.cast("long"), 32) + y.cast("long") + F.lit(_LOW)


def code_x(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def code_y(c: Column) -> Column:
    return (c.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(_LOW)).cast("int")


def tile(x: str, y: str) -> Column:
    return code(F.floor(F.col(x) / SIDE), F.floor(F.col(y) / SIDE))


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def _packed(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """One row per key, with an array of each field; the arrays have the same order."""
    g = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(name) for c, name in fields.items()])


def _flat(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """The row of each element of these list columns, and their elements; a null list is empty."""
    n = pc.fill_null(pc.list_value_length(batch.column(names[0])), 0).to_numpy(zero_copy_only=False)
    return [np.repeat(np.arange(batch.num_rows), n), *[batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in names]]


def _lists(rows: np.ndarray, n: int, *columns: tuple[np.ndarray, pa.DataType]) -> list[pa.Array]:
    """List columns of n rows from elements sorted by row."""
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(c, type=kind)) for c, kind in columns]


def _corner(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    t = batch.column("tile").to_numpy(zero_copy_only=False)
    return (t >> 32) * SIDE, ((t & 0xFFFFFFFF) - _LOW) * SIDE


def _left_over(rows: int, goals: np.ndarray) -> np.ndarray:
    """Per node a lower bound of the steps to a goal: the least of those to a goal in its tile and those out of the tile."""
    i = np.arange(SIDE)
    out = np.minimum(i + 1, SIDE - i)
    d = np.minimum(out[:, None], out[None, :]).astype(np.float64)
    d = np.tile(d, (rows, 1, 1))
    d.reshape(-1)[goals] = 0
    for axis, k in ((1, i[:, None]), (2, i[None, :])):
        ahead = np.minimum.accumulate(d - k, axis=axis) + k
        back = np.flip(np.minimum.accumulate(np.flip(d + k, axis), axis=axis), axis) - k
        d = np.minimum(ahead, back)
    return d.reshape(-1)


def _settle(batches: Iterator[pa.RecordBatch], weighted: bool, again: bool, guided: bool) -> Iterator[pa.RecordBatch]:
    """Relaxes tiles: each row is one start in one tile, with its edges, messages and known cells."""
    for b in batches:
        x0, y0 = _corner(b)
        n = b.num_rows

        def node(row: np.ndarray, x: np.ndarray, y: np.ndarray, x0: np.ndarray = x0, y0: np.ndarray = y0) -> np.ndarray:
            return row * AREA + (x - x0[row]) * SIDE + (y - y0[row])

        row, sx, sy, tx, ty = _flat(b, "sx", "sy", "tx", "ty")
        w = _flat(b, "w")[1] if weighted else np.ones(len(row))
        s = node(row, sx, sy)
        order = np.argsort(s, kind="stable")
        row, s, w = row[order], s[order], w[order]
        tx, ty = tx[order].astype(np.int64), ty[order].astype(np.int64)
        inside = (tx >= x0[row]) & (tx < x0[row] + SIDE) & (ty >= y0[row]) & (ty < y0[row] + SIDE)
        t = np.where(inside, node(row, tx, ty), -1)
        first = np.searchsorted(s, np.arange(n * AREA + 1))
        cost, known, before = np.full(n * AREA, np.inf), np.zeros(n * AREA, bool), np.full(n * AREA, NONE)
        if again:
            r, kx, ky, kc, kp = _flat(b, "kx", "ky", "kc", "kp")
            at = node(r, kx, ky)
            cost[at], known[at], before[at] = kc, True, kp
        goal, best, bound = np.zeros(0, bool), np.full(n, np.inf), np.zeros(0)
        if guided:
            g = node(*_flat(b, "gx", "gy"))
            goal = np.zeros(n * AREA, bool)
            goal[g] = True
            bound = _left_over(n, g)
            best = pc.fill_null(b.column("found"), np.inf).to_numpy(zero_copy_only=False).copy()
        r, fx, fy, fc, fp = _flat(b, "fx", "fy", "fc", "fp")
        at = node(r, fx, fy)
        same = known[at] & (fc == cost[at])
        before[at[same]] = np.minimum(before[at[same]], fp[same])
        better = ~known[at] | (fc < cost[at])
        front = at[better]
        cost[front], known[front], before[front] = fc[better], True, fp[better]
        changed = np.zeros(n * AREA, bool)
        while len(front):
            changed[front] = True
            if guided:
                hit = front[goal[front]]
                np.minimum.at(best, hit // AREA, cost[hit])
            many = first[front + 1] - first[front]
            e = np.repeat(first[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
            e = e[inside[e]]
            to, new = t[e], cost[s[e]] + w[e]
            keep = ~known[to] | (new < cost[to])
            if guided:
                keep &= np.isfinite(new) & (new + bound[to] <= best[row[e]] + EPS)
            to, new = to[keep], new[keep]
            np.minimum.at(cost, to, new)
            known[to] = True
            front = np.unique(to)
            before[front] = NONE
        sent = cost[s] + w
        mine = (s - row * AREA) // SIDE + x0[row], s % SIDE + y0[row]
        from_ = (mine[0] << 32) + mine[1] + _LOW
        way = np.flatnonzero(inside & known[s])
        way = way[sent[way] == cost[t[way]]]
        np.minimum.at(before, t[way], from_[way])
        out = ~inside & changed[s]
        if guided:
            out &= np.isfinite(sent) & (sent <= best[row] + EPS)
        cells = np.flatnonzero(known)
        of = cells // AREA
        yield pa.RecordBatch.from_arrays(
            [b.column("start_id"), b.column("tile"),
             *_lists(of, n, (x0[of] + cells % AREA // SIDE, pa.int32()), (y0[of] + cells % SIDE, pa.int32()), (cost[cells], pa.float64()), (before[cells], pa.int64())),
             *_lists(row[out], n, (tx[out], pa.int32()), (ty[out], pa.int32()), (sent[out], pa.float64()), (from_[out], pa.int64())),
             pa.array(best, mask=np.isinf(best))],
            names=["start_id", "tile", "kx", "ky", "kc", "kp", "ox", "oy", "oc", "op", "found"],
        )


def relaxed(edge: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """(start_id, x, y, cost, before): least cost of each cell from each start, and the code of the least cell before it on such a way (or NULL).

    edge: sx, sy, tx, ty and, unless each costs 1, weight; starts: start_id, x, y. With goals (x, y) the search is guided: cells are left out
    whose cost and lower bound of what is left are over the best cost that the start has found to a goal. Edges must then cost 1 or more and
    lead to neighbours.
    """
    spark = edge.sparkSession
    weighted = "weight" in edge.columns
    fields = {"sx": "sx", "sy": "sy", "tx": "tx", "ty": "ty", **({"w": "w"} if weighted else {})}
    e = edge.select(tile("sx", "sy").alias("tile"), *[F.col(c).cast("int").alias(c) for c in ("sx", "sy", "tx", "ty")], *([F.col("weight").cast("double").alias("w")] if weighted else []))
    tiles = cut(_packed(e.filter("w is not null") if weighted else e, ["tile"], fields))
    ends = None if goals is None else cut(_packed(goals.select(tile("x", "y").alias("tile"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct(), ["tile"], {"x": "gx", "y": "gy"}))
    kind = starts.schema["start_id"].dataType.simpleString()
    kept = "kx array<int>, ky array<int>, kc array<double>, kp array<bigint>"
    schema = f"start_id {kind}, tile bigint, {kept}, ox array<int>, oy array<int>, oc array<double>, op array<bigint>, found double"
    front = starts.filter("x is not null and y is not null").select("start_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.lit(0.0).alias("cost"), F.lit(NONE).alias("p")).distinct()
    state, found, rounds = None, None, 0
    _small_batches(spark)
    while True:
        asked = cut(_packed(front.withColumn("tile", tile("x", "y")), ["start_id", "tile"], {"x": "fx", "y": "fy", "cost": "fc", "p": "fp"}))
        n = asked.count()
        if not n and state is not None:
            break
        small = n <= SMALL_ROWS
        keys = asked.select("start_id", "tile")
        keys = F.broadcast(keys) if small else keys
        j = asked.join(tiles.join(F.broadcast(asked.select("tile")), "tile", "left_semi") if small else tiles, "tile", "left")
        if ends is not None:
            j = j.join(ends, "tile", "left")
            j = j.withColumn("found", F.lit(None).cast("double")) if found is None else j.join(found, "start_id", "left")
        if state is not None:
            j = j.join(state.join(keys, ["start_id", "tile"], "left_semi"), ["start_id", "tile"], "left")
        again, guided = state is not None, ends is not None
        new = cut(j.mapInArrow(lambda b, again=again, guided=guided: _settle(b, weighted, again, guided), schema))
        cells = new.select("start_id", "tile", "kx", "ky", "kc", "kp")
        state = cells if state is None else state.join(keys, ["start_id", "tile"], "left_anti").unionByName(cells)
        rounds += 1
        state = cut(state) if rounds % EVERY == 0 else state
        if guided:
            hits = new.select("start_id", "found").filter("found is not null")
            found = cut((hits if found is None else hits.unionByName(found)).groupBy("start_id").agg(F.min("found").alias("found")))
        sent = new.select("start_id", F.inline(F.arrays_zip("ox", "oy", "oc", "op"))).toDF("start_id", "x", "y", "cost", "p")
        front = sent.groupBy("start_id", "x", "y").agg(F.min(F.struct("cost", "p")).alias("m")).select("start_id", "x", "y", "m.cost", "m.p")
    out = state.select("start_id", F.inline(F.arrays_zip("kx", "ky", "kc", "kp"))).toDF("start_id", "x", "y", "cost", "p")
    return out.select("start_id", "x", "y", "cost", F.when(F.col("p") != NONE, F.col("p")).alias("before"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes one walker a row on through its tile; `out` marks where it goes on in another tile."""
    for b in batches:
        x0, y0 = _corner(b)
        n = b.num_rows
        row, x, y, nx, ny = _flat(b, "tx", "ty", "nx", "ny")
        at = row * AREA + (x - x0[row]) * SIDE + (y - y0[row])
        end = np.isnan(nx) if nx.dtype.kind == "f" else np.zeros(len(nx), bool)
        to = np.full((n * AREA, 2), 0, np.int64)
        goes = np.zeros(n * AREA, bool)
        there = np.zeros(n * AREA, bool)
        to[at[~end]] = np.stack([nx[~end], ny[~end]], axis=1).astype(np.int64)
        goes[at[~end]], there[at] = True, True
        wx, wy, place = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y", "place"))
        walker = np.arange(n)
        ok = (place > 0) | there[walker * AREA + (wx - x0) * SIDE + (wy - y0)]
        walker, wx, wy, place = walker[ok], wx[ok], wy[ok], place[ok]
        steps, parts = 0, []
        while len(walker):
            if steps > AREA:
                raise ValueError("the table of next cells has a cycle")
            parts.append((walker, place, wx, wy, np.zeros(len(walker), bool)))
            here = walker * AREA + (wx - x0[walker]) * SIDE + (wy - y0[walker])
            on = goes[here]
            walker, place, (wx, wy) = walker[on], place[on] + 1, to[here[on]].T
            inside = (wx // SIDE * SIDE == x0[walker]) & (wy // SIDE * SIDE == y0[walker])
            parts.append((walker[~inside], place[~inside], wx[~inside], wy[~inside], np.ones((~inside).sum(), bool)))
            walker, place, wx, wy = walker[inside], place[inside], wx[inside], wy[inside]
            steps += 1
        if parts:
            walker, place, wx, wy, out = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("start_id").take(pa.array(walker)), pa.array(place, pa.int32()), pa.array(wx, pa.int32()), pa.array(wy, pa.int32()), pa.array(out)], names=["start_id", "place", "x", "y", "out"])


def walked(next_cell: DataFrame, starts: DataFrame) -> DataFrame:
    """(start_id, place, x, y): the cells from each start on, by next_cell (x, y, nx, ny; NULL at the end), the start first.

    Starts that next_cell does not have are left out.
    """
    cells = next_cell.select(tile("x", "y").alias("tile"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "nx", "ny")])
    tiles = cut(_packed(cells, ["tile"], {"x": "tx", "y": "ty", "nx": "nx", "ny": "ny"}))
    kind = starts.schema["start_id"].dataType.simpleString()
    front = starts.filter("x is not null and y is not null").select("start_id", F.lit(0).alias("place"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    out, rounds = None, 0
    _small_batches(starts.sparkSession)
    while True:
        front = cut(front.withColumn("tile", tile("x", "y")))
        n = front.count()
        if not n and out is not None:
            return out
        some = tiles.join(F.broadcast(front.select("tile")), "tile", "left_semi") if n <= SMALL_ROWS else tiles
        new = cut(front.join(some, "tile", "left").mapInArrow(_walk, f"start_id {kind}, place int, x int, y int, out boolean"))
        gone = new.filter("not out").drop("out")
        out = gone if out is None else out.unionByName(gone)
        rounds += 1
        out = cut(out) if rounds % EVERY == 0 else out
        front = new.filter("out").drop("out")
