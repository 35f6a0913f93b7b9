"""Groups of linked rows: bucket scans in bounded blocks, and connected components.

Nothing here emits all pairs of a group: a task sees at most two blocks of a bucket, and returns
a spanning forest of the links that it finds there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.llm.common import join_groups, release, semi_left, stored
from egresslake.llm.shingles import mixed


def blocked(rows: DataFrame, key: str, node: str, block: int, order: Sequence[str] = ()) -> DataFrame:
    """Rows of buckets with two rows or more, dealt to runs of at most two blocks of about `block` rows.

    A bucket with n rows has ceil(n / block) blocks; each row goes to the runs of its block with every
    block, so each pair of rows meets in exactly one run: in (p, p) for the same block, in (p, q) with p < q
    otherwise. Only counts of buckets over one block are joined to rows, broadcast while they are few.
    Rows move once; runs of one row are dropped where they arrive. Adds p, q, b; a run is sorted by `order`.
    """
    large = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block), "large-buckets")
    r = semi_left(rows, large, key).withColumn("nb", F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))).drop("n")
    r = r.withColumn("b", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))
    r = r.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    r = r.withColumn("p", F.least("b", "x")).withColumn("q", F.greatest("b", "x")).drop("x", "nb")
    run = Window.partitionBy(key, "p", "q")
    return r.repartition(key, "p", "q").withColumn("many", F.count(F.lit(1)).over(run)).filter("many > 1").drop("many").sortWithinPartitions(key, "p", "q", *order)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole runs of equal keys from sorted batches, as arrays by column; only a batch's last run is carried over."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not len(batch):
            continue
        cols = {c: batch[c].to_numpy() for c in batch.columns}
        if held:
            cols = {c: np.concatenate([held[c], v]) for c, v in cols.items()}
        new = np.zeros(len(cols[keys[0]]) - 1, dtype=bool)
        for c in keys:
            new |= cols[c][1:] != cols[c][:-1]
        bounds = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield {c: v[a:b] for c, v in cols.items()}
        held = {c: v[bounds[-1] :].copy() for c, v in cols.items()}
    if held:
        yield held


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph with this adjacency matrix."""
    n = len(near)
    if n == 2:
        return [(0, 1)] if near[0, 1] else []
    unseen, out = np.ones(n, dtype=bool), []
    for root in range(n):
        if unseen[root]:
            unseen[root], stack = False, [root]
            while stack:
                x = stack.pop()
                new = np.flatnonzero(near[x] & unseen)
                unseen[new] = False
                out += [(x, y) for y in new.tolist()]
                stack += new.tolist()
    return out


def pair_mask(p: int, q: int, b: np.ndarray) -> np.ndarray | None:
    """For a run (p, q) with p < q: which pairs are across the blocks. None: all pairs count."""
    return None if p == q else b[:, None] != b[None, :]


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over blocks of hashes."""
    n = len(grams)
    if n == 2:
        both = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return np.array([[len(grams[0]), both], [both, len(grams[1])]], dtype=np.float32)
    owner = np.repeat(np.arange(n), [len(g) for g in grams])
    _, place, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, n), dtype=np.float32)
    width = 4096
    for lo in range(0, int(often.sum()), width):
        i, j = np.searchsorted(place, (lo, lo + width))
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[i:j], place[i:j] - lo] = 1
        out += m @ m.T
    return out


def linked(rows: DataFrame, key: str, node: str, payload: list[str], near: Callable[[dict[str, np.ndarray]], np.ndarray], block: int = 512) -> DataFrame:
    """Candidate edges (u, v) between nodes that share a bucket and that near() holds close.

    near gets the payload of a run and returns its boolean adjacency matrix. Buckets with equal
    node sets are common (one per band), so edges repeat; distinct() removes them.
    """
    dealt = blocked(rows.select(key, node, *payload), key, node, block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        us, vs = [], []
        for run in runs(batches, [key, "p", "q"]):
            ids = run[node]
            if len(ids) < 2:
                continue
            adj = near(run)
            mask = pair_mask(run["p"][0], run["q"][0], run["b"])
            if mask is not None:
                adj &= mask
            for i, j in forest(adj):
                us.append(ids[i])
                vs.append(ids[j])
            if len(us) > 50_000:
                yield pd.DataFrame({"u": us, "v": vs})
                us, vs = [], []
        if us:
            yield pd.DataFrame({"u": us, "v": vs})

    pairs = dealt.mapInPandas(scan, "u long, v long").filter("u <> v")
    return stored(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "candidates")


def chunks(batches: Iterator[pd.DataFrame], keys: Sequence[str], least: int = 20_000) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted batches as chunks (columns, bounds of runs of equal keys) of whole runs and, but for the last, at least so many rows."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0

    def joined() -> tuple[dict[str, np.ndarray], np.ndarray]:
        cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        new = np.zeros(len(cols[keys[0]]) - 1, dtype=bool)
        for c in keys:
            new |= cols[c][1:] != cols[c][:-1]
        return cols, np.concatenate([[0], np.flatnonzero(new) + 1, [len(new) + 1]])

    for batch in batches:
        if len(batch):
            held.append({c: batch[c].to_numpy() for c in batch.columns})
            rows += len(batch)
        if rows >= least:
            cols, bounds = joined()
            if len(bounds) > 2:
                last = bounds[-2]
                yield {c: v[:last] for c, v in cols.items()}, bounds[:-1]
                cols = {c: v[last:].copy() for c, v in cols.items()}
            held, rows = [cols], len(cols[keys[0]])
            least = max(least, 2 * rows)  # a run longer than a chunk is joined a few times only
    if held:
        yield joined()


def meetings(rows: DataFrame, key: str, node: str, payload: list[str], close: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray], block: int = 256) -> DataFrame:
    """(run, node, side): the nodes of each bounded run of a bucket of which some pair is close.

    For checks that need more than a run's payload. close() tells it for arrays of payloads that broadcast. Only nodes with a
    close pair are given. Where side is not the same for all of a run, only pairs across the sides are to be compared: the others meet
    in another run. Buckets with equal sets of close nodes are common and become one run, named by a hash of the set.
    """
    dealt = blocked(rows.select(key, node, *payload), key, node, block)

    def names(ids: np.ndarray, side: np.ndarray) -> np.ndarray:
        return mixed(mixed(ids.view(np.uint64)) + side.astype(np.uint64))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, bounds in chunks(batches, [key, "p", "q"]):
            ids, side = cols[node], (cols["b"] != cols["p"]).astype(np.int32)
            size = np.diff(bounds)
            i = bounds[:-1][size == 2]  # most runs are pairs
            across = cols["p"][i] != cols["q"][i]
            yes = close({c: cols[c][i] for c in payload}, {c: cols[c][i + 1] for c in payload}) & (~across | (side[i] != side[i + 1])) & (ids[i] != ids[i + 1])
            i = i[yes]
            run = mixed(names(ids[i], side[i]) + names(ids[i + 1], side[i + 1])).view(np.int64)
            found = [pd.DataFrame({"run": np.tile(run, 2), "node": np.concatenate([ids[i], ids[i + 1]]), "side": np.concatenate([side[i], side[i + 1]])})]
            for k in np.flatnonzero(size > 2).tolist():
                at = slice(bounds[k], bounds[k + 1])
                adj = close({c: cols[c][at][:, None] for c in payload}, {c: cols[c][at][None, :] for c in payload}) & (ids[at][:, None] != ids[at][None, :])
                mask = pair_mask(cols["p"][bounds[k]], cols["q"][bounds[k]], cols["b"][at])
                if mask is not None:
                    adj &= mask
                some = np.flatnonzero(adj.any(axis=1)) + bounds[k]
                if len(some):
                    name = mixed(names(ids[some], side[some]).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]
                    found.append(pd.DataFrame({"run": name, "node": ids[some], "side": side[some]}))
            yield pd.concat(found)

    return stored(dealt.mapInPandas(scan, "run long, node long, side int").distinct(), "meetings")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge upwards and no centre has one itself."""
    n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and not edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def _least(edges: DataFrame, value: Column) -> DataFrame:
    return edges.groupBy("u").agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("deg"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v), u > v; the component is its least node.

    Alternates large-star and small-star steps until every component is a star. Each step is a
    grouped minimum, combined before the shuffle, and a join of edges with it in which hubs are
    broadcast. Edges shrink to one per node; they never leave the cluster.
    """
    e = edges
    while not _is_star_forest(e):
        total = e.count()
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, F.least("u", "v"))
        large = join_groups(both, least, "u", "deg", 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "stars")
        least = _least(large, F.col("v"))
        small = join_groups(large, least, "u", "deg", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        release(large, *([e] if e is not edges else []))
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
