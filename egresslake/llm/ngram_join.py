r"""Operator 5: near-duplicate join on word 5-grams by a MinHash LSH forest.

1. Texts become sets of hashed word shingles; texts with equal sets are one class, and only classes
   go on (copies are never paired). A class's signature is hashed and stored once: TREES sequences of DEPTH
   min-hashes, and 128 one-bit min-hashes.
2. A tree is the prefix trie of its sequences in sorted order. Rows are dealt by the shortest prefix that can be needed (the longest
   that finds pairs at the threshold with probability `target`) and sorted by sequence; in a subtree, the pairs whose
   one-bit min-hashes agree often enough are candidates, and an edge of a spanning forest carries the length
   of the prefix that its ends share. Edges of at least d levels so span the nodes of depth d, for each d.
3. Candidate groups are the components of the edges of at least `depth` levels. Inside a group all pairs of classes get
   their exact Jaccard similarity, in bounded blocks of rows; a task returns link counts and a spanning forest of true links, never pairs.
4. From the exact links, recall is estimated by bands of similarity: a link of similarity s was
   found with probability p(s) = (1 - (1 - s^depth)^TREES) times the chance that one-bit min-hashes agree often enough, so 1/p(s) sums to the true number
   (Horvitz-Thompson). While a band's estimate is under `target`, the matched prefix is shortened by one level: edges
   of that length, already stored, join in, and the groups that grow are verified again.

Defined results: a null text counts as empty; empty texts are one class; a text of fewer than five
words has one shingle, itself; rows that repeat are copies; null ids are allowed and lose against
others when a group is named; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import drop_rows, join_groups, release, row_key, semi, small_batches, small_enough, stored
from egresslake.llm.graph import blocked, components, forest, overlaps, pair_mask, runs
from egresslake.llm.shingles import set_key, shingle_hashes

THRESHOLD = 0.8
TREES = 16
#: Levels of a tree, and the length of prefixes that the search begins with.
DEPTH, BEGIN = 8, 5
TARGET = 0.999
#: Similarities above the threshold are estimated in bands of this width.
BAND = 0.05
SKETCH_BITS = 128
#: Of SKETCH_BITS one-bit min-hashes, (1 + s) / 2 agree for similarity s; candidates may fall so many standard deviations below that.
SKETCH_SIGMAS = 5.0
BLOCK = 256

_odd = np.random.default_rng(20_240_613).integers(0, 1 << 31, size=(2, max(TREES * DEPTH, SKETCH_BITS)), dtype=np.int64)
_MULS, _ADDS = (_odd[0] * 2 + 1).astype(np.uint32), _odd[1].astype(np.uint32)


def recall_at(s: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    return 1.0 - (1.0 - np.asarray(s, dtype=float) ** depth) ** trees


def least_agreement(threshold: float) -> int:
    p = (1 + threshold) / 2
    return int(SKETCH_BITS * p - SKETCH_SIGMAS * (SKETCH_BITS * p * (1 - p)) ** 0.5)


def found_at(s: np.ndarray, depth: int, threshold: float) -> np.ndarray:
    """The probability that a pair of similarity s becomes a candidate: in the trees, and by its one-bit min-hashes."""
    n, least = SKETCH_BITS, least_agreement(threshold)
    p = (1 + np.asarray(s, dtype=float)) / 2
    missed = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))
    return recall_at(s, depth) * (1 - missed)


def least_depth(threshold: float, target: float) -> int:
    """The longest prefix that finds pairs at the threshold often enough; one level where none does."""
    return max([d for d in range(1, DEPTH + 1) if recall_at(threshold, d) >= target], default=1)


def signature(hashes: np.ndarray) -> tuple[bytes, int, int]:
    """(TREES sequences of DEPTH 16-bit min-hashes, two longs of one-bit min-hashes)."""
    n = max(TREES * DEPTH, SKETCH_BITS)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    mins = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(mins, (x[i : i + 1024, None] * _MULS[None, :n] + _ADDS[None, :n]).min(axis=0), out=mins)
    mixed_up = mins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    s0, s1 = np.packbits((mixed_up[:SKETCH_BITS] >> np.uint64(63)).astype(bool)).view(np.int64).tolist()
    return (mixed_up[: TREES * DEPTH] >> np.uint64(40)).astype(">u2").tobytes(), s0, s1


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row), cid (class), n (shingles), s0, s1, trees."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["txt"]:
                h = shingle_hashes(text)
                rows.append((set_key(h), len(h), *signature(h)))
            cid, n, trees, s0, s1 = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "cid": cid, "n": n, "s0": s0, "s1": s1, "trees": trees})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", "txt").mapInPandas(sign, f"doc_id {kind}, key string, cid long, n long, s0 long, s1 long, trees binary")


def tries(classes: DataFrame, threshold: float, shortest: int) -> DataFrame:
    """Candidate edges (u, v, depth): for each d of at least `shortest`, those of d levels or more span the trie nodes of depth d."""
    least = least_agreement(threshold)
    width = 2 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.filter("n > 0").select("cid", "s0", "s1", F.col("n").alias("grams"), "trees", tree)
    rows = rows.select("cid", "s0", "s1", "grams", F.expr(f"substring(trees, tree * {width} + 1, {width})").alias("path"), "tree")
    rows = rows.withColumn("node", F.xxhash64("tree", F.expr(f"substring(path, 1, {2 * shortest})"))).drop("tree")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int, int]] = []
        for run in runs(batches, ["node", "p", "q"]):
            ids, a, b, n = run["cid"], run["s0"], run["s1"], run["grams"].astype(float)
            far = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) + np.bitwise_count((b[:, None] ^ b[None, :]).view(np.uint64))
            adj = (far <= SKETCH_BITS - least) & (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])) & (ids[:, None] != ids[None, :])
            mask = pair_mask(run["p"][0], run["q"][0], run["b"])
            if mask is not None:
                adj &= mask
            if not adj.any():
                continue
            paths = np.frombuffer(b"".join(run["path"]), dtype=">u2").reshape(len(ids), DEPTH)
            shared = np.zeros(adj.shape, dtype=np.int8)
            same = np.ones(adj.shape, dtype=bool)
            for level in paths.T:
                same &= level[:, None] == level[None, :]
                shared += same
            root = np.arange(len(ids))
            for d in range(DEPTH, shortest - 1, -1):  # from the leaves up
                for i, j in forest(adj & (shared >= d)):
                    if root[i] != root[j]:
                        root[root == root[i]] = root[j]
                        found.append((ids[i], ids[j], d))
            if len(found) > 50_000:
                yield pd.DataFrame(found, columns=["u", "v", "depth"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["u", "v", "depth"])

    pairs = blocked(rows, "node", "cid", BLOCK, ["path"]).mapInPandas(scan, "u long, v long, depth int")
    return stored(pairs.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.max("depth").alias("depth")), "candidates")


def verified(docs: DataFrame, classes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Exact links inside candidate groups, by component.

    Rows (cid, links, documents) of each class with a link, rows (cid, other) of a spanning forest, and rows (band, links): a run's pairs by similarity.
    """
    members = stored(
        classes.select("cid", "copies", F.col("keep.doc_id").alias("rep"), F.col("keep.key").alias("rep_key")).join(
            groups.select(F.col("node").alias("cid"), "component"), "cid"
        ),
        "members",
    )
    m = members.select("cid", "copies", "component", F.col("rep_key").alias("key"))
    texts = docs.select("key", "txt").join(F.broadcast(m) if small_enough(m) else m, "key")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "cid": pdf["cid"], "copies": pdf["copies"], "component": pdf["component"],
                "grams": [(shingle_hashes(t) >> np.uint64(16)).astype("<u8").tobytes() for t in pdf["txt"]],
            })

    rows = stored(texts.mapInPandas(load, "cid long, copies long, component long, grams binary"), "grams")
    dealt = blocked(rows, "component", "cid", BLOCK)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs(batches, ["component", "p", "q"]):
            cid, first = np.unique(run["cid"], return_index=True)  # a row of documents may repeat
            if len(cid) < 2:
                continue
            grams = [np.frombuffer(g, dtype="<u8") for g in run["grams"][first]]
            n = np.array([len(g) for g in grams], dtype=float)
            common = overlaps(grams).astype(float)
            like = common / np.maximum(1.0, n[:, None] + n[None, :] - common)
            adj = like >= threshold
            np.fill_diagonal(adj, False)
            mask = pair_mask(run["p"][0], run["q"][0], run["b"][first])
            if mask is not None:
                adj &= mask
            links = adj.sum(axis=1)
            if not links.any():
                continue
            copies, group, none = run["copies"][first], run["component"][0], pd.array([None], dtype="Int64")
            has = links > 0
            yield pd.DataFrame({"component": group, "cid": cid[has], "other": none.repeat(int(has.sum())), "links": links[has], "documents": (adj @ copies)[has], "band": -1})
            tree = np.array(forest(adj), dtype=np.int64).reshape(-1, 2)
            yield pd.DataFrame({"component": group, "cid": cid[tree[:, 0]], "other": pd.array(cid[tree[:, 1]], dtype="Int64"), "links": 0, "documents": 0, "band": -1})
            band, times = np.unique((like[np.triu(adj, 1)] * 100 + 1e-9).astype(np.int64), return_counts=True)
            yield pd.DataFrame({"component": group, "cid": cid[0], "other": none.repeat(len(band)), "links": times, "documents": 0, "band": band})

    out = stored(dealt.mapInPandas(verify, "component long, cid long, other long, links long, documents long, band int"), "links")
    release(rows, members)
    return out


def estimated_recall(links: DataFrame, depth: int, threshold: float) -> float:
    """The least share of true links found over bands of similarity; a link's band is its per cent."""
    rows = links.filter("band >= 0").groupBy("band").agg(F.sum("links").alias("n")).collect()  # at most a hundred rows
    found, true = Counter(), Counter()
    for r in rows:
        wide = int((r.band / 100 - threshold + 1e-9) / BAND)
        found[wide] += r.n
        true[wide] += r.n / float(found_at(max(threshold, r.band / 100), depth, threshold))
    return min((found[b] / true[b] for b in found), default=1.0)


def linked_classes(docs: DataFrame, classes: DataFrame, threshold: float, target: float, begin: int) -> DataFrame:
    """links of verified() for the prefix length at which every band's recall reaches the target."""
    shortest = least_depth(threshold, target)
    edges = tries(classes, threshold, shortest)
    depth = max(shortest, begin)
    groups = stored(components(edges.filter(F.col("depth") >= depth)), "candidate-groups")
    links = verified(docs, classes, groups, threshold)
    while depth > shortest and estimated_recall(links, depth, threshold) < target:
        depth -= 1
        wider = stored(components(edges.filter(F.col("depth") >= depth)), "candidate-groups")
        before = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        # A group named by the same class with as many classes is the same: groups only grow.
        grown = stored(wider.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(before, ["component", "n"], "left_anti").select("component"), "grown-groups")
        more = verified(docs, classes, semi(wider, grown, ["component"], "left_semi"), threshold)
        gone = stored(groups.join(wider.select("node", F.col("component").alias("now")), "node").join(grown.withColumnRenamed("component", "now"), "now", "left_semi").select("component").distinct(), "replaced-groups")
        kept = stored(semi(links, gone, ["component"], "left_anti").unionByName(more), "links")
        release(groups, links, more, grown, gone)
        groups, links = wider, kept
    release(edges, groups)
    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET, begin: int = BEGIN
) -> DataFrame:
    """One row per row of docs.

    doc_id, key, class_id (least id of its group of linked documents), n_links (other texts with a
    Jaccard similarity of at least threshold), n_similar (other documents with such a text, copies
    included), kept (whether it stays when one row of a group stays), keep_key.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    rows = stored(signed(d), "signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key"))
    classes = stored(
        rows.groupBy("cid").agg(F.count(F.lit(1)).alias("copies"), best.alias("keep"), *[F.first(c).alias(c) for c in ("n", "s0", "s1", "trees")]),
        "classes",
    )
    links = linked_classes(d, classes, threshold, target, begin)
    counts = links.filter("other is null and band < 0").groupBy("cid").agg(F.sum("links").alias("n_links"), F.sum("documents").alias("near"))
    pairs = links.filter("other is not null").select(F.greatest("cid", "other").alias("u"), F.least("cid", "other").alias("v")).distinct()
    true_groups = components(stored(pairs, "true-links"))
    named = stored(
        classes.select("cid", "copies", "keep")
        .join(counts, "cid", "left")
        .join(true_groups.withColumnRenamed("node", "cid"), "cid", "left")
        .select("cid", "copies", "keep", F.coalesce("component", "cid").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("near", F.lit(0)).alias("near")),
        "named",
    )
    keepers = stored(named.groupBy("group").agg(F.min("keep").alias("best"), F.count(F.lit(1)).alias("n")), "keepers")
    named = stored(
        join_groups(named, keepers, "group", "n", named.count()).select(
            "cid", "copies", F.col("best.doc_id").alias("class_id"), F.col("best.key").alias("keep_key"), "n_links", (F.col("near") + F.col("copies") - 1).alias("n_similar")
        ),
        "named",
    )
    out = join_groups(rows.select("doc_id", "key", "cid"), named, "cid", "copies", rows.count())
    return out.select("doc_id", "key", "class_id", "n_links", "n_similar", (F.col("key") == F.col("keep_key")).alias("kept"), "keep_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: that with the least id."""
    found = stored(near_duplicates(docs, id_col, text_col, threshold), "near")
    return drop_rows(docs, found, id_col, text_col)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Query: class and link counts of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "n_links", "n_similar", "kept")
