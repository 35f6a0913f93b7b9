"""Bootstrap intervals by seeded draws: no group is ever in one task, no draw is shuffled, and reruns give the same numbers.

A group's values are numbered from 0 in ascending order. In groups of up to FEW values, draw j of replicate b is the value whose number is a
hash of (seed, b, j) modulo the group's size. Larger groups are dealt to blocks of BLOCK values. How many of a replicate's n draws fall into a
block is told by halving: a binomial draw, seeded by seed, n and the range of blocks, says how many fall into the lower half of a range, so each
block finds its own count by itself, and all counts of a replicate add up to n. A block makes its draws and gives one sum per replicate. Both are
exact resamples with replacement; groups of equal size have the same draws.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero
from egresslake.operators.graph import cut, numbered

SEED, SAMPLES, LEVEL = 42, 1000, 0.95
#: Sizes of groups that are drawn by hashes, and of the blocks of larger ones.
FEW, BLOCK = 1024, 1 << 14
#: Blocks that a task holds at a time.
BATCH = 128
#: Seeds from which a leaderboard entry is official.
OFFICIAL_SEEDS = 20


@lru_cache(maxsize=4)
def _hashes(samples: int, size: int, seed: int) -> np.ndarray:
    """The first 32 bits of MD5 of seed:replicate:draw, for replicates from 1 and draws from 0."""
    raw = b"".join(hashlib.md5(f"{seed}:{b}:{j}".encode()).digest()[:4] for b in range(1, samples + 1) for j in range(size))
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(samples, size)


def _share(n: int, block: int, samples: int, seed: int) -> np.ndarray:
    """How many of each replicate's n draws fall into a block."""
    low, high, many = 0, -(-n // BLOCK), np.full(samples, n)
    while high - low > 1:
        mid = (low + high) // 2
        below = np.random.default_rng([seed % (1 << 32), n, low, high]).binomial(many, (mid - low) * BLOCK / (min(high * BLOCK, n) - low * BLOCK))
        low, high, many = (low, mid, below) if block < mid else (mid, high, many - below)
    return many


def _sums(values: np.ndarray, n: int, block: int, samples: int, seed: int) -> np.ndarray:
    """Per replicate the sum of the values that it draws from a block."""
    if n <= FEW:
        return values[_hashes(samples, 1 << (n - 1).bit_length(), seed)[:, :n] % n].sum(axis=1)
    rng = np.random.default_rng([seed % (1 << 32), n, block])
    return np.array([values[rng.integers(0, len(values), k)].sum() for k in _share(n, block, samples, seed)])


def placed(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, v, n, first, place): values that are numbers, places from `first` on in each group of n."""
    d = rows.select(*group, num(value).alias("v")).filter("v is not null").withColumn("_row", F.monotonically_increasing_id())
    d = numbered(cut(d), [*group, "v", "_row"]).drop("_row")
    size = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    on = F.lit(True)
    size = size.withColumnsRenamed({g: f"_g_{g}" for g in group})
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return d.join(size, on).drop(*[f"_g_{g}" for g in group]) if group else d.crossJoin(F.broadcast(size))


def replicates(rows: DataFrame, group: Sequence[str], value: str, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """(group, replicate, mean): the mean of each resample."""
    blocks = placed(rows, group, value).groupBy(*group, "n", F.floor((F.col("place") - F.col("first")) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("v")).alias("v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name in group)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, v = b.column("v").offsets.to_numpy(), b.column("v").values.to_numpy(zero_copy_only=False)
            many = zip(b.column("n").to_pylist(), b.column("block").to_pylist(), ends[:-1], ends[1:], strict=True)
            sums = pa.array([_sums(v[i:j], n, block, samples, seed) for n, block, i, j in many], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(g) for g in group], b.column("n"), sums], names=[*group, "n", "sums"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    drawn = blocks.mapInArrow(summed, f"{kinds + ', ' if group else ''}n long, sums array<double>")
    drawn = drawn.select(*group, "n", F.posexplode("sums").alias("replicate", "s"))
    return drawn.groupBy(*group, "n", (F.col("replicate") + 1).alias("replicate")).agg((F.sum("s") / F.first("n")).alias("mean")).drop("n")


def intervals(rows: DataFrame, group: Sequence[str], value: str, samples: int = SAMPLES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """Per group: n, mean, ci_low, ci_high: percentiles of the resamples' means, interpolated; the mean itself for one value or no samples.

    Groups without numbers are there with n 0 and mean 0.0.
    """
    whole = rows.groupBy(*group).agg(F.count(num(value)).alias("n"), or_zero(F.avg(num(value))).alias("mean"))
    if samples <= 0:
        return whole.withColumns({"ci_low": F.col("mean"), "ci_high": F.col("mean")})
    tail = (1 - level) / 2
    r = replicates(rows, group, value, samples, seed)
    ends = r.groupBy(*group).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci"))  # `samples` rows a group
    ends = ends.withColumnsRenamed({g: f"_g_{g}" for g in group})
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = whole.join(ends, on, "left")
    ci = [F.when(F.col("n") < 2, F.col("mean")).otherwise(F.coalesce(F.col("_ci")[i], F.col("mean"))) for i in (0, 1)]
    return out.select(*group, "n", "mean", ci[0].alias("ci_low"), ci[1].alias("ci_high"))


def difference_intervals(pairs: DataFrame, group: Sequence[str], base: str, test: str, samples: int = SAMPLES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """Per group of matched pairs: n, mean difference test - base, and its interval. Pairs that lack a side are left out."""
    return intervals(pairs.withColumn("_d", num(test) - num(base)).filter("_d is not null"), group, "_d", samples, level, seed)


def leaderboard(runs: DataFrame, policy: str, seed_col: str, score: str, scenario: str | None = None, samples: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Per policy, and per scenario where one is given: mean score over seeds, interval, seeds, seed_count, run_count, tier.

    A seed's score is the mean of its runs. Entries over all scenarios have scenario NULL.
    """
    d = runs.select(F.col(policy).alias("policy"), F.col(seed_col).alias("seed"), num(score).alias("score"), (F.col(scenario) if scenario else F.lit(None)).cast("string").alias("scenario"))
    whole = d.withColumn("scenario", F.lit(None).cast("string"))
    both = whole.unionByName(d.filter("scenario is not null")) if scenario else whole
    seeds = both.groupBy("policy", "scenario", "seed").agg(F.avg("score").alias("s"), F.count(F.lit(1)).alias("runs"))
    ci = intervals(seeds, ["policy", "scenario"], "s", samples, seed=seed).withColumnsRenamed({"mean": "mean_score", "ci_low": "score_ci_low", "ci_high": "score_ci_high"}).drop("n")
    counted = seeds.groupBy("policy", "scenario").agg(F.array_sort(F.collect_set("seed")).alias("seeds"), F.count_distinct("seed").alias("seed_count"), F.sum("runs").alias("run_count"))
    counted = counted.withColumnsRenamed({"policy": "_p", "scenario": "_s"})
    out = ci.join(counted, F.col("policy").eqNullSafe(F.col("_p")) & F.col("scenario").eqNullSafe(F.col("_s"))).drop("_p", "_s")
    return out.withColumn("tier", F.when(F.col("seed_count") >= OFFICIAL_SEEDS, "official").otherwise("smoke"))
