"""Null and NaN rules, once for all operators.

NaN becomes NULL on the way in; divisions never raise; an empty group is 0.0 in run metrics and
NULL in trajectory and validation results, so each caller picks `or_zero` or not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column | str) -> Column:
    """A column as double, NULL where it is no number or NaN."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def truthy(c: Column) -> Column:
    """Booleans from what files hold: 1, true and yes in any case; NULL is false."""
    return F.coalesce(F.lower(c.cast("string")).isin("1", "true", "yes"), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def avg(c: Column | str) -> Column:
    return F.avg(num(c))


def std_pop(c: Column | str) -> Column:
    """Population deviation, 0 for one row."""
    return or_zero(F.stddev_pop(num(c)))


def quantile(c: Column | str, q: float) -> Column:
    """Exact quantile with linear interpolation."""
    return F.percentile(num(c), q)


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; 0 where a column is constant or empty."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    cov = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    var = (n * F.sum(x * x) - F.sum(x) ** 2) * (n * F.sum(y * y) - F.sum(y) ** 2)
    return or_zero(F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))))


def pct_guarded(base: Column, test: Column) -> Column:
    """Study comparison: signed base, 0.0 for a base under 1e-9."""
    return F.when(F.abs(base) < 1e-9, 0.0).otherwise(ratio(test - base, base) * 100)


def pct_abs(ref: Column, test: Column) -> Column:
    """Trajectory comparison: relative to |ref|, NULL for a reference of 0."""
    return ratio(test - ref, F.abs(ref)) * 100


def pct_signed(base: Column, test: Column) -> Column:
    """Variant comparison: signed base, NULL at exactly 0."""
    return ratio(test - base, base) * 100


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))
