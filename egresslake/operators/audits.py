"""Audits: issue tables from rules, hash chains, sequential budgets, submissions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "genesis"


def issues(df: DataFrame, rules: Sequence[tuple[str, str, Column]], ident: Column, source: str) -> DataFrame:
    """(source, code, severity, item, ...) a row per violated rule (code, severity, condition), in one pass over df."""
    bad = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules]))
    d = df.select(F.lit(source).alias("source"), ident.cast("string").alias("item"), F.explode(bad).alias("i"))
    return d.select("source", "item", "i.code", "i.severity")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, code: str, source: str) -> DataFrame:
    """Issues for child keys without a parent."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.select(child_key).distinct().join(p, child_key, "left_anti").select(F.lit(source).alias("source"), F.col(child_key).cast("string").alias("item"), F.lit(code).alias("code"), F.lit("error").alias("severity"))


def duplicates(df: DataFrame, key: str, code: str, source: str) -> DataFrame:
    """Issues for keys that occur more than once."""
    d = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return d.select(F.lit(source).alias("source"), F.col(key).cast("string").alias("item"), F.lit(code).alias("code"), F.lit("error").alias("severity"))


def metric_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Assertions: rules (metric, least, most) against metrics (metric, value); a missing value is an issue too."""
    j = rules.join(metrics, "metric", "left")
    code = F.when(F.col("value").isNull() | F.isnan("value"), "missing_metric").when(F.col("value") < F.col("least"), "below_minimum").when(F.col("value") > F.col("most"), "above_maximum")
    return j.withColumn("code", code).filter("code is not null")


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], more: str, start: Callable[[], object], step: Callable[[object, dict], tuple[object, tuple]]) -> DataFrame:
    """df with the columns `more` that a fold over each key's rows in order gives.

    Rows are dealt by key, sorted and passed through batch by batch; only the fold's state is held, so a key may have any number of rows.
    """
    names = [c.split()[0] for c in more.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                now = tuple(row[k] for k in keys)
                if now != key:
                    key, state = now, start()
                state, values = step(state, row)
                out.append(values)
            yield pdf.assign(**dict(zip(names, zip(*out, strict=True), strict=True)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {more}")


def chained(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_hash: Column) -> DataFrame:
    """(keys, order, row_hash, prev_hash, chain_hash): each row's SHA-256 over the hash before it and its own content, per key."""

    def link(before: str, row: dict) -> tuple[str, tuple]:
        h = hashlib.sha256((before + row["row_hash"]).encode()).hexdigest()
        return h, (before, h)

    return folded(df.select(*keys, *order, row_hash.alias("row_hash")), keys, order, "prev_hash string, chain_hash string", lambda: GENESIS, link)


def verified_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key: rows, first bad place (NULL when sound) and reason. Each row is checked from stored values, in parallel."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS)))
    bad = F.when(F.col("prev_hash") != F.col("_before"), "previous_hash_mismatch").when(F.col("chain_hash") != F.sha2(F.concat("prev_hash", "row_hash"), 256), "row_hash_mismatch")
    d = d.withColumn("_bad", bad)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("_bad").isNotNull(), F.col("_n"))).alias("first_bad"), F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("_n"))).alias("reason"))


def budgeted(df: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str, limit: float) -> DataFrame:
    """(keys, order, cost, allowed): calls in order, each allowed if it still fits what allowed calls have left of the budget."""

    def take(used: float, row: dict) -> tuple[float, tuple]:
        fits = used + row[cost] <= limit
        return (used + row[cost] if fits else used), (fits,)

    return folded(df.select(*keys, *order, F.col(cost).cast("double").alias(cost)), keys, order, "allowed boolean", lambda: 0.0, take)


def guarded(df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: dict[str, float]) -> DataFrame:
    """(keys, order, the columns of limits, allowed, exceeded): calls in order under several budgets; exceeded names the first that a refused call is over."""
    costs = list(limits)

    def take(used: tuple, row: dict) -> tuple[tuple, tuple]:
        over = next((c for c, u in zip(costs, used, strict=True) if u + row[c] > limits[c]), None)
        return (used if over else tuple(u + row[c] for c, u in zip(costs, used, strict=True))), (over is None, over)

    rows = df.select(*keys, *order, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in costs])
    return folded(rows, keys, order, "allowed boolean, exceeded string", lambda: (0.0,) * len(costs), take)


#: Order of the call log within a run.
CALL_ORDER = ("step", "surface", "cache_key")


def call_hash(calls: DataFrame) -> Column:
    """SHA-256 of a call's content: all its columns but the chain's, by name, as JSON."""
    own = sorted(c for c in calls.columns if c not in ("prev_hash", "chain_hash", "row_hash", "audit_chain_prev_hash", "audit_chain_hash"))
    return F.sha2(F.to_json(F.struct(*own)), 256)


def chained_calls(calls: DataFrame) -> DataFrame:
    """The call log with audit_chain_prev_hash and audit_chain_hash, chained per run."""
    keys = ["run_id", *CALL_ORDER]
    links = chained(calls, ["run_id"], CALL_ORDER, call_hash(calls)).select(*keys, "row_hash", F.col("prev_hash").alias("audit_chain_prev_hash"), F.col("chain_hash").alias("audit_chain_hash"))
    bare = calls.drop("audit_chain_prev_hash", "audit_chain_hash").withColumn("row_hash", call_hash(calls))
    return bare.join(links, [*keys, "row_hash"]).drop("row_hash").select(*calls.columns)
