r"""Operator 13: near duplicates of embeddings by an exact metric range join.

Cosine c of two vectors is the distance sqrt(2 - 2c) of their directions, a metric. Vectors of a group (equal label,
equal length) that have more than `cell` distinct vectors are partitioned by pivots:

1. Equal vectors of a group are one class, with a count; only classes are joined, so copies are never paired.
2. Pivots are classes with the least keys, at most PIVOTS in number for each length of vector. Each class belongs to the cell of its
   nearest pivot.
3. A class at distance d of its pivot p is also sent to the cells of later pivots q that the triangle inequality cannot rule out: a
   vector nearer to q than to p that is within r of it exists only if d(x, q) <= d(x, p) + 2r. Directions are points of a
   Euclidean space, where the same argument on the plane between p and q gives the tighter (d(x, q)^2 - d(x, p)^2) / 2 d(p, q) <= r; that
   is the rule used. It never loses a pair. As only the cell of the later pivot gets the other's vectors, a pair meets in one cell.
4. Cells join independently, in blocks of at most 2 x BLOCK classes: a cell of any size is spread over tasks. A task computes the products of tiles of
   TILE rows and returns link counts and a spanning forest of the links it finds, never pairs.
5. Groups of linked classes are connected components.

Where vectors have no structure (random directions), the rule prunes little, and the work is that of comparing all within a
label, in blocks; exact joins in many dimensions cannot do better. Embeddings that cluster send few vectors to other cells.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite component, and vectors whose label is null, link with nothing; so do
vectors of different lengths; vectors too large or small to square are scaled first; rows that repeat whole, and rows of one id, are vectors of
their own, linked by their values (a component is named by its least id; null ids lose against others, and an id that all of a component lack
stays null; kept is then false); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import join_groups, release, semi_left, small_batches, stored
from egresslake.llm.graph import blocked, components, runs

THRESHOLD = 0.93
#: Groups up to this many classes are one cell; cells of larger ones are meant to have so many.
CELL = 4096
#: Pivots for each length of vector, and lengths that get pivots.
PIVOTS, LENGTHS = 512, 4
BLOCK, TILE = 2048, 1024
#: Slack for rounding in the pruning rule, so that it only errs towards sending too much.
SLACK = 1e-9


def direction(vector) -> np.ndarray | None:
    """The unit vector in double precision; None where there is none."""
    if vector is None or not len(vector):
        return None
    x = np.array([math.nan if v is None else v for v in vector], dtype=np.float64) if not isinstance(vector, np.ndarray) or vector.dtype == object else vector.astype(np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    if not 1e-100 < top < 1e100:
        x = x / top
    return x / math.sqrt(float(x @ x))


def directed(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, grp (label and length), key (of label and direction), unit (doubles); the last three NULL where nothing links."""
    small_batches(rows.sparkSession, 5000)
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for label, v in zip(pdf["label"], pdf["v"], strict=True):
                unit = None if label is None else direction(v)
                grp = None if unit is None else f"{len(unit)}:{label}"
                out.append((grp, None, None) if unit is None else (grp, hashlib.md5(f"{grp}|".encode() + unit.tobytes()).hexdigest(), unit.tobytes()))
            yield pd.DataFrame(out, columns=["grp", "key", "unit"]).assign(vec_id=pdf["vec_id"].astype("Int64").to_numpy())[["vec_id", "grp", "key", "unit"]]

    return picked.mapInPandas(make, "vec_id long, grp string, key string, unit binary")


def pivot_table(classes: DataFrame, large: DataFrame, cell: int = CELL) -> dict[int, np.ndarray]:
    """Unit vectors that partition large groups, by length: at most PIVOTS each, for at most LENGTHS lengths."""
    most = {int(r["dim"]): int(r["most"]) for r in large.groupBy(F.split_part("grp", F.lit(":"), F.lit(1)).cast("int").alias("dim")).agg(F.max("n").alias("most")).orderBy(F.desc("most"), "dim").limit(LENGTHS).collect()}
    out = {}
    for dim, n in most.items():
        wanted = min(PIVOTS, math.ceil(n / cell))
        # of one size, whatever the group: the least keys are a sample that does not depend on how rows are dealt
        rows = semi_left(classes, large.select("grp", F.lit(1).alias("big")), "grp").filter(F.col("big").isNotNull() & F.col("grp").startswith(f"{dim}:"))
        got = rows.orderBy("key").limit(wanted).select("unit").collect()
        out[dim] = np.stack([np.frombuffer(r["unit"], dtype=np.float64) for r in got])
    return out


def assigned(units: np.ndarray, pivots: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, own): each row once in its nearest pivot's cell, and in those of later pivots that the rule leaves."""
    d2 = np.maximum(0.0, 2.0 - 2.0 * (units @ pivots.T))
    home = d2.argmin(axis=1)
    base = d2[np.arange(len(units)), home]
    sent = (d2 - base[:, None]) <= 2.0 * (radius + SLACK) * apart[home] + SLACK
    sent &= np.arange(len(pivots))[None, :] > home[:, None]
    row, cell = np.nonzero(sent)
    return np.concatenate([np.arange(len(units)), row]), np.concatenate([home, cell]), np.concatenate([np.ones(len(units), dtype=bool), np.zeros(len(row), dtype=bool)])


def celled(classes: DataFrame, large: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    """classes with cell and own, in every cell that needs them."""
    rows = semi_left(classes, large.select("grp", F.lit(True).alias("big")), "grp")
    if not pivots:
        return rows.select("grp", "cid", "copies", "unit", F.lit(0).alias("cell"), F.lit(True).alias("own"))
    apart = {d: np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T))) for d, p in pivots.items()}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dim = pdf["unit"].str.len().to_numpy() // 8
            split = pdf["big"].fillna(False).to_numpy(dtype=bool) & np.isin(dim, list(pivots))
            small = pdf[~split]
            if len(small):
                yield small[["grp", "cid", "copies", "unit"]].assign(cell=0, own=True)
            for d in np.unique(dim[split]).tolist():
                of = pdf[split & (dim == d)]
                for k in range(0, len(of), 512):
                    some = of.iloc[k : k + 512]
                    row, cell, own = assigned(np.frombuffer(b"".join(some["unit"]), dtype=np.float64).reshape(-1, d), pivots[d], apart[d], radius)
                    yield some.iloc[row][["grp", "cid", "copies", "unit"]].assign(cell=cell, own=own)

    return rows.select("grp", "cid", "copies", "unit", "big").mapInPandas(deal, "grp string, cid long, copies long, unit binary, cell int, own boolean")


def links_of(run: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(vectors linked to each class of a run, edges of a spanning forest), over the pairs that the run is for."""
    size = len(run["cid"])
    units = np.frombuffer(b"".join(run["unit"]), dtype=np.float64).reshape(size, -1)
    own, weight, side = run["own"].astype(bool), run["copies"].astype(np.float64), run["b"]
    across = run["p"][0] != run["q"][0]
    found, root, edges = np.zeros(size), np.arange(size), []
    for at in range(0, size, TILE):
        rows = slice(at, min(size, at + TILE))
        near = units[rows] @ units.T >= threshold
        near &= own[rows, None] | own[None, :]
        if across:
            near &= side[rows, None] != side[None, :]
        near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
        found[rows] = near @ weight
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mates = np.flatnonzero(near[i])
            other = mates[root[mates] != root[at + i]]
            while len(other):  # a round for each group that this row joins
                x = int(other[0])
                edges.append((at + i, x))
                root[root == root[x]] = root[at + i]
                other = other[root[other] != root[at + i]]
    return found, edges


def joined(cells: DataFrame, threshold: float) -> DataFrame:
    """(u, v, n), stored: v NULL and n the number of vectors linked to class u in a run, or an edge u > v with n NULL."""
    dealt = blocked(cells.withColumn("bucket", F.xxhash64("grp", "cell")), "bucket", "cid", BLOCK, ["cid"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["bucket", "p", "q"]):
            for grp in pd.unique(run["grp"]):  # two cells may share a bucket's number
                for cell in np.unique(run["cell"][run["grp"] == grp]).tolist():
                    of = (run["grp"] == grp) & (run["cell"] == cell)
                    if of.sum() < 2:
                        continue
                    part = {c: x[of] for c, x in run.items()}
                    found, edges = links_of(part, threshold)
                    ids, some = part["cid"], np.flatnonzero(found)
                    if len(some):
                        yield pd.DataFrame({"u": ids[some], "v": pd.array([None] * len(some), dtype="Int64"), "n": pd.array(found[some].astype(np.int64), dtype="Int64")})
                    if edges:
                        a, b = ids[[i for i, _ in edges]], ids[[j for _, j in edges]]
                        yield pd.DataFrame({"u": np.maximum(a, b), "v": pd.array(np.minimum(a, b), dtype="Int64"), "n": pd.array([None] * len(a), dtype="Int64")})

    return stored(dealt.mapInPandas(scan, "u long, v long, n long"), "links")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL) -> DataFrame:
    """vec_id, n_links (vectors linked directly), component_id (least vec_id that links reach), kept. One row per row.

    threshold is a cosine, over 0 and at most 1. Groups of more than `cell` distinct vectors are partitioned.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine over 0")
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    made = stored(directed(rows, id_col, vector_col, label_col), "directions")
    classes = made.filter("key is not null").groupBy("grp", "key").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    large = stored(classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell), "large-groups")
    found = joined(celled(classes, large, pivot_table(classes, large, cell), radius), threshold)
    edges = stored(found.filter("v is not null").select("u", "v").distinct(), "edges")
    member = components(edges) if edges.limit(1).count() else edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    counts = found.filter("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    named = classes.select("cid", "key", "copies", "least").join(counts, "cid", "left").join(member.withColumnRenamed("node", "cid"), "cid", "left")
    named = stored(named.select("key", "copies", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    named = stored(join_groups(named, stored(least, "components"), "component", "size", named.count()).select("key", "copies", "n_links", "component_id"), "members")
    linked = join_groups(made.filter("key is not null").select("vec_id", "key"), named, "key", "copies", made.count())
    alone = made.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    release(found)
    return linked.select("vec_id", "n_links", "component_id").unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: links and component of every vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93::DOUBLE),
reach AS (SELECT u, v FROM linked UNION SELECT reach.u, linked.v FROM reach JOIN linked ON linked.u = reach.v),
least AS (SELECT u, min(v) AS m FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM linked GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN least ON least.u = vec_id LEFT JOIN counted ON counted.u = vec_id"""
