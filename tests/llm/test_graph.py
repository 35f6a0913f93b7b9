"""Components and bucket scans against union-find."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from egresslake.llm import common, graph


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = {(int(max(a, b)), int(min(a, b))) for a, b in rng.integers(-50, 400, size=(260, 2)) if a != b}
    edges |= {(1000 + i + 1, 1000 + i) for i in range(60)}  # a path
    edges |= {(3000 + i, 2000) for i in range(300)}  # a hub
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == union_find(edges)
    assert graph.components(df.filter("false")).collect() == []


def test_linked_finds_all_pairs_of_a_bucket_larger_than_a_block(spark):
    rows = [(b, i, i // 3) for b in range(3) for i in range(90)] + [(50 + i, 900 + i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "band long, id long, g long")

    def near(run):
        adj = run["g"][:, None] == run["g"][None, :]
        np.fill_diagonal(adj, False)
        return adj

    edges = [(r.u, r.v) for r in graph.linked(df, "band", "id", ["g"], near, block=16).collect()]
    found = union_find(edges)
    assert len(found) == 90 and all(found[i] == i // 3 * 3 for i in range(90))


def test_runs_span_batches():
    df = pd.DataFrame({"k": [1, 1, 2, 3, 3, 3, 4], "v": range(7)})
    for size in (1, 2, 3, 7):
        got = [(r["k"][0], r["v"].tolist()) for r in graph.runs((df.iloc[i : i + size] for i in range(0, 7, size)), ["k"])]
        assert got == [(1, [0, 1]), (2, [2]), (3, [3, 4, 5]), (4, [6])]


def test_join_groups_splits_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = common.join_groups(rows, groups, "k", "n", 5000)
    assert got.count() == 5000 and got.filter("k = 7").select("n").distinct().first().n == 4000


def test_shared_folder_comes_from_the_session(spark):
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert conf is None or common.shared_dir(spark) == conf.rstrip("/")
    t = common.stored(spark.range(3).toDF("a"), "x")
    assert t.count() == 3
    common.release(t)
