"""Running sums and exact quantiles in groups of any size.

A window over a whole group sorts it in one task. Here values are first counted by distinct value, and those are dealt to
BUCKETS ranges of about equally many distinct values, whose bounds are approximate quantiles of the group: outliers do not
matter. Sums run inside a range, and the ranges' own totals, at most BUCKETS rows a group, give each range what lies below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Relative error of a bound is one in so many.
ACCURACY = 1000


def _keyed(rows: DataFrame, keys: Sequence[str], other: DataFrame) -> DataFrame:
    """Inner join on keys, NULL equal to NULL; without keys, with the one row of other."""
    if not keys:
        return rows.crossJoin(F.broadcast(other))
    other = other.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(other, on).drop(*[f"_k_{k}" for k in keys])


def running_sums(rows: DataFrame, keys: Sequence[str], x: str, amounts: Mapping[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """rows with, for each amount, NAME_below (its sum over the group's rows of smaller x) and NAME_all (over the group).

    rows must have at most one row per keys and x; x is a number.
    """
    v = rows.withColumns({f"_a_{n}": c for n, c in amounts.items()}).withColumn("_x", F.col(x).cast("double"))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    ends = v.groupBy(*keys).agg(F.array_distinct(F.percentile_approx("_x", shares, ACCURACY)).alias("_bounds"))
    v = _keyed(v, keys, ends).withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("_x")))).drop("_bounds")
    group, along = [*keys, "_bucket"], Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = v.groupBy(*group).agg(*[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts])
    for n in amounts:
        totals = totals.withColumn(f"_o_{n}", F.coalesce(F.sum(f"_t_{n}").over(along), F.lit(0))).withColumn(f"{n}_all", F.sum(f"_t_{n}").over(Window.partitionBy(*keys)))
    totals = totals.drop(*[f"_t_{n}" for n in amounts])
    inside = Window.partitionBy(*group).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_a_{n}").over(inside), F.lit(0)) for n in amounts})
    v = _keyed(v, group, totals).withColumns({f"{n}_below": F.col(f"_o_{n}") + F.col(f"_i_{n}") for n in amounts})
    return v.drop("_x", "_bucket", *[f"{p}_{n}" for n in amounts for p in ("_a", "_o", "_i")])


def quantiles(rows: DataFrame, keys: Sequence[str], x: str, wanted: Mapping[str, float]) -> DataFrame:
    """(keys, a column per name): exact quantiles with linear interpolation between neighbours; groups without values are left out."""
    v = rows.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*keys, F.col(x).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    v = running_sums(v, keys, "_v", {"n": F.col("_n")})
    out = []
    for name, q in wanted.items():
        rank = (F.col("n_all") - 1) * F.lit(float(q))

        def at(r: Column) -> Column:
            return F.max(F.when((F.col("n_below") <= r) & (r < F.col("n_below") + F.col("_n")), F.col("_v")))

        low, high, part = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        out.append((low + (high - low) * part).alias(name))
    return v.groupBy(*keys).agg(*out)
