"""Two-sample statistics: matched pairs, effect sizes, rank tests, distribution gaps, bootstrap, leaderboards.

Rank and distribution statistics work on counts of distinct values, not on rows. p-values of few untied values are exact: the
distribution of the statistic is an array of counts per pair of sizes, made once for each pair of sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import or_zero, ratio
from egresslake.functions.scalars import e_value, kolmogorov_p, normal_cdf
from egresslake.operators.calibration import logistic
from egresslake.operators.ordered import running_sums
from egresslake.operators.resampling import intervals

#: U has its exact distribution where a side has at most so many values, none tied, and both sizes multiply to at most EXACT_CELLS.
EXACT_SIDE, EXACT_CELLS = 8, 2048
#: W has its exact distribution up to so many differences, none tied.
EXACT_PAIRS = 50


def u_counts(m: Column, n: Column) -> Column:
    """How many orders of m and n values have U = 0, 1, ... m x n: coefficients of the product over i = 1 to m of (1 - q^(n + i)) / (1 - q^i)."""
    one = F.transform(F.sequence(F.lit(0), (m * n).cast("int")), lambda k: F.when(k == 0, 1.0).otherwise(0.0))

    def factor(c: Column, i: Column) -> Column:
        raised = F.transform(c, lambda v, k: v - F.coalesce(F.get(c, (k - n - i).cast("int")), F.lit(0.0)))
        held = F.transform(F.array(raised), lambda r: F.transform(r, lambda v, k: F.aggregate(F.sequence(F.lit(0), F.floor(k / i).cast("int")), F.lit(0.0), lambda s, t: s + F.get(r, (k - t * i).cast("int")))))
        return held[0]

    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), one, factor)


def w_counts(n: Column) -> Column:
    """How many of the 2^n sign patterns of ranks 1 to n have a positive rank sum of 0, 1, ... n (n + 1) / 2."""
    one = F.transform(F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int")), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    return F.aggregate(F.sequence(F.lit(1), n.cast("int")), one, lambda c, r: F.transform(c, lambda v, k: v + F.coalesce(F.get(c, (k - r).cast("int")), F.lit(0.0))))


def _tail(counts: Column, upto: Column) -> Column:
    """The share of the counts at 0 to `upto`."""
    part = F.aggregate(F.slice(counts, F.lit(1), F.floor(upto).cast("int") + 1), F.lit(0.0), lambda s, v: s + v)
    return part / F.aggregate(counts, F.lit(0.0), lambda s, v: s + v)


def matched_effect(base: DataFrame, test: DataFrame, key: str, metric: str) -> DataFrame:
    """One row: pairs of equal key (means per key first), mean difference, leave-one-out range and shift, E-value."""
    a = base.groupBy(key).agg(F.avg(metric).alias("a"))
    b = test.groupBy(key).agg(F.avg(metric).alias("b"))
    p = a.join(b, key).withColumn("d", F.col("b") - F.col("a"))
    t = p.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("d").alias("ate"), F.sum("d").alias("s"), F.min("d").alias("lo"), F.max("d").alias("hi"), ratio(F.avg("b"), F.avg("a")).alias("risk"))
    out = F.when(F.col("n_pairs") > 1, (F.col("s") - F.col("hi")) / (F.col("n_pairs") - 1)), F.when(F.col("n_pairs") > 1, (F.col("s") - F.col("lo")) / (F.col("n_pairs") - 1))
    t = t.withColumn("loo_min", out[0]).withColumn("loo_max", out[1])
    shift = F.greatest(F.abs(F.col("loo_min") - F.col("ate")), F.abs(F.col("loo_max") - F.col("ate")))
    return t.withColumn("loo_max_shift", shift).withColumn("e_value", e_value(F.col("risk"))).drop("s", "lo", "hi", "risk")


def cohens_d(rows: DataFrame, group: Sequence[str], side: str, metric: str) -> DataFrame:
    """Per group: standardised difference of side b less side a, with pooled sample variance; 0 where that is 0 or NULL."""
    a, b = (F.when(F.col(side) == s, F.col(metric)) for s in ("a", "b"))
    g = rows.groupBy(*group).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), or_zero(F.var_samp(a)).alias("va"), or_zero(F.var_samp(b)).alias("vb")
    )
    pooled = F.sqrt(ratio((F.col("n_a") - 1) * F.col("va") + (F.col("n_b") - 1) * F.col("vb"), F.when(F.col("n_a") + F.col("n_b") > 2, F.col("n_a") + F.col("n_b") - 2)))
    return g.withColumn("d", or_zero(ratio(F.col("mean_b") - F.col("mean_a"), pooled))).drop("va", "vb")


def _values(rows: DataFrame, group: Sequence[str], side: str, metric: str) -> DataFrame:
    """Distinct values per group with how many rows of each side have them."""
    d = rows.filter(F.col(metric).isNotNull())
    return d.groupBy(*group, metric).agg(F.count_if(F.col(side) == "a").alias("na"), F.count_if(F.col(side) == "b").alias("nb"))


def mann_whitney(rows: DataFrame, group: Sequence[str], side: str, metric: str, exact: bool = True) -> DataFrame:
    """Per group: U of side a from average ranks, and its two-sided p: exact for few untied values, else normal, tie and continuity corrected.

    exact=False always takes the normal p.
    """
    v = running_sums(_values(rows, group, side, metric).withColumn("t", F.col("na") + F.col("nb")), group, metric, {"t": F.col("t")})
    v = v.withColumn("rank", F.col("t_below") + (F.col("t") + 1) / 2)
    g = v.groupBy(*group).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.sum(F.col("rank") * F.col("na")).alias("r"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    ab = F.col("n_a").cast("double") * F.col("n_b")
    g = g.withColumn("u", F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    var = ab / 12 * (n + 1 - ratio(F.col("ties"), F.when(n > 1, n * (n - 1))))
    z = ratio(F.greatest(F.abs(F.col("u") - ab / 2) - 0.5, F.lit(0.0)), F.sqrt(F.when(var > 0, var)))
    g = g.withColumn("p", F.coalesce(F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))), F.lit(1.0)))
    if not exact:
        return g.drop("r", "ties")
    few, many = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    g = g.withColumn("_few", F.when((F.col("ties") == 0) & (few > 0) & (few <= EXACT_SIDE) & (few * many <= EXACT_CELLS), few)).withColumn("_many", F.when(F.col("_few").isNotNull(), many))
    sizes = g.select("_few", "_many").filter("_few is not null").distinct()
    sizes = F.broadcast(sizes.select("_few", "_many", u_counts(F.col("_few"), F.col("_many")).alias("_c")))  # at most EXACT_CELLS pairs of sizes a side of 1 to EXACT_SIDE
    counted = F.least(F.lit(1.0), 2 * _tail(F.col("_c"), F.least("u", ab - F.col("u"))))
    return g.join(sizes, ["_few", "_many"], "left").withColumn("p", F.when(F.col("_few").isNotNull(), counted).otherwise(F.col("p"))).select(*group, "n_a", "n_b", "u", "p")


def wilcoxon(pairs: DataFrame, group: Sequence[str], delta: str, exact: bool = True) -> DataFrame:
    """Per group: signed-rank W (the smaller sum) of non-zero deltas and its two-sided p: exact for few untied ones, else normal, tie corrected.

    exact=False always takes the normal p.
    """
    d = pairs.withColumn("m", F.abs(delta)).filter("m > 1e-12").groupBy(*group, "m").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(delta) > 0).alias("plus"))
    d = running_sums(d, group, "m", {"t": F.col("t")}).withColumn("rank", F.col("t_below") + (F.col("t") + 1) / 2)
    g = d.groupBy(*group).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("up"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    g = g.withColumn("w", F.least(F.col("up"), n * (n + 1) / 2 - F.col("up")))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = ratio(F.abs(F.col("w") - n * (n + 1) / 4), F.sqrt(F.when(var > 0, var)))
    g = g.withColumn("p", F.coalesce(2 * (1 - normal_cdf(z)), F.lit(1.0)))
    if not exact:
        return g.drop("up", "ties")
    g = g.withColumn("_n", F.when((F.col("ties") == 0) & (n <= EXACT_PAIRS), F.col("n")))
    sizes = F.broadcast(g.select("_n").filter("_n is not null").distinct().select("_n", w_counts(F.col("_n")).alias("_c")))  # at most EXACT_PAIRS rows
    counted = F.least(F.lit(1.0), 2 * _tail(F.col("_c"), F.col("w")))
    return g.join(sizes, "_n", "left").withColumn("p", F.when(F.col("_n").isNotNull(), counted).otherwise(F.col("p"))).select(*group, "n", "w", "p")


def ks_gap(rows: DataFrame, group: Sequence[str], side: str, metric: str) -> DataFrame:
    """Per group: two-sample Kolmogorov-Smirnov gap and asymptotic p; NULL where a side has under two rows."""
    v = running_sums(_values(rows, group, side, metric), group, metric, {"a": F.col("na"), "b": F.col("nb")})
    gap = F.abs(ratio(F.col("a_below") + F.col("na"), F.col("a_all")) - ratio(F.col("b_below") + F.col("nb"), F.col("b_all")))
    g = v.withColumn("gap", gap).groupBy(*group).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.max("gap").alias("gap"))
    root = F.sqrt(ratio(F.col("n_a").cast("double") * F.col("n_b"), F.col("n_a") + F.col("n_b")))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    p = kolmogorov_p((root + 0.12 + 0.11 / root) * F.col("gap"))
    return g.withColumn("p", F.when(enough, p)).withColumn("d", F.when(enough, F.col("gap"))).drop("gap")


def bootstrap_ci(rows: DataFrame, group: Sequence[str], value: str, samples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Per group: n, mean and percentile interval of its bootstrap means, by hashed draws."""
    return intervals(rows, group, value, samples, level, seed)


def logistic_fit(rows: DataFrame, features: Sequence[str], label: str, l2: float = 1e-3) -> DataFrame:
    """(feature, coefficient) of a logistic model on standardised features, fitted by sums over all rows."""
    model = logistic(rows, features, label, l2)
    return rows.sparkSession.createDataFrame(list(zip(["intercept", *features], model.weights, strict=True)), "feature string, coefficient double")


def seed_mean_leaderboard(rows: DataFrame, policy: str, seed: str, score: str, official_from: int = 20) -> DataFrame:
    """Per policy: mean of its seeds' mean scores, sample deviation, seeds, tier."""
    s = rows.groupBy(policy, seed).agg(F.avg(score).alias("s"))
    g = s.groupBy(policy).agg(F.count(F.lit(1)).alias("seeds"), F.avg("s").alias("mean_score"), or_zero(F.stddev_samp("s")).alias("score_std"))
    return g.withColumn("tier", F.when(F.col("seeds") >= official_from, "official").otherwise("smoke"))


def elasticity(rows: DataFrame, metric: str, param: str) -> DataFrame:
    """Per metric: change per change of the parameter between neighbouring values, and whether it is monotone."""
    w = Window.partitionBy(metric).orderBy(param)
    d = rows.withColumn("dv", F.col("mean") - F.lag("mean").over(w)).withColumn("dp", F.col(param) - F.lag(param).over(w))
    d = d.withColumn("elasticity", F.when(F.abs("dp") <= 1e-12, 0.0).otherwise(ratio(F.col("dv"), F.col("dp"))))
    return d.drop("dv", "dp")


def monotonic(rows: DataFrame, metric: str, param: str) -> DataFrame:
    """(metric, monotonic): whether the mean never falls or never rises; NULL for fewer than two values."""
    d = rows.withColumn("dv", F.col("mean") - F.lag("mean").over(Window.partitionBy(metric).orderBy(param)))
    return d.groupBy(metric).agg((F.bool_and(F.col("dv") >= 0) | F.bool_and(F.col("dv") <= 0)).alias("monotonic"))


def perf_gate(base: DataFrame, now: DataFrame, keys: Sequence[str], seconds: str, most: float = 0.1) -> DataFrame:
    """Status of each timing against its baseline: missing_baseline, regression (over `most` slower) or ok."""
    j = now.select(*keys, F.col(seconds).alias("now_s")).join(base.select(*keys, F.col(seconds).alias("base_s")), list(keys), "left")
    j = j.withColumn("pct", ratio(F.col("now_s") - F.col("base_s"), F.col("base_s")) * 100)
    return j.withColumn("status", F.when(F.col("base_s").isNull(), "missing_baseline").when(F.col("pct") > most * 100, "regression").otherwise("ok"))
