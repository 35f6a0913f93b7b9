"""Scenarios as data: populations, layouts, mutations, audits, patches and sampling."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.functions.bounds import bounded
from egresslake.functions.nullsafe import num
from egresslake.operators.graph import edges, reachable
from egresslake.operators.state import uniform

ISSUE = "severity string, code string, x int, y int"


def population(cohorts: DataFrame, spawn: DataFrame, group_size: int = 4) -> DataFrame:
    """Agents of cohorts (cohort, count): ids by cohort, groups of group_size whose first member leads, spawn cells in turn.

    spawn: spawn_id from 0, x, y.
    """
    w = Window.orderBy("cohort")
    offset = cohorts.withColumn("before", F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    a = offset.filter("count > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("agent_id", F.col("before") + F.col("i"))
    a = a.withColumn("group_id", F.floor(F.col("i") / group_size)).withColumn("leader_id", F.col("before") + F.col("group_id") * group_size)
    n = spawn.agg(F.count(F.lit(1)).alias("cells"))
    a = a.crossJoin(F.broadcast(n)).withColumn("spawn_id", F.col("agent_id") % F.col("cells"))
    return a.join(spawn, "spawn_id").select("agent_id", "cohort", "group_id", "leader_id", "x", "y")


def sampled(rows: DataFrame, distribution: DataFrame, seed: int, ident: str, value: str) -> DataFrame:
    """Adds value drawn from a distribution (value, low, high): the one whose cumulative range holds the row's hash draw."""
    return rows.withColumn("_u", uniform(F.lit(seed), ident)).join(bounded(distribution.select(value, "low", "high")), (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).drop("_u", "low", "high")


def mutated(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with the tokens of changes (x, y, token) painted over."""
    return cells.join(changes.select("x", "y", F.col("token").alias("_t")), ["x", "y"], "left").withColumn("token", F.coalesce("_t", "token")).drop("_t")


def bresenham(segments: DataFrame) -> DataFrame:
    """(segment_id, x, y): grid cells on lines from (x0, y0) to (x1, y1), one per step of the longer axis, halves rounded up."""
    n = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    s = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))

    def at(a: str, b: str) -> Column:
        return F.floor(F.col(a) + F.coalesce(F.try_divide((F.col(b) - F.col(a)) * F.col("i"), F.col("n")), F.lit(0.0)) + 0.5).cast("int")

    return s.select("segment_id", at("x0", "x1").alias("x"), at("y0", "y1").alias("y"))


def audit_layout(cells: DataFrame) -> DataFrame:
    """Issues of a layout (x, y, token; X wall, E exit, @ start): no exit, no start, unreachable starts and cells."""
    walk = cells.withColumn("walkable", F.col("token") != "X")
    reach = reachable(edges(walk), walk.filter("token = 'E'")).select("x", "y")
    lost = walk.filter("walkable").join(reach, ["x", "y"], "left_anti")
    none = F.lit(None).cast("int")
    counts = cells.agg(F.count_if(F.col("token") == "E").alias("e"), F.count_if(F.col("token") == "@").alias("s"))
    missing = counts.select(F.explode(F.array_compact(F.array(F.when(F.col("e") == 0, F.lit("no_exit")), F.when(F.col("s") == 0, F.lit("no_start"))))).alias("code"))
    out = missing.select(F.lit("error").alias("severity"), "code", none.alias("x"), none.alias("y"))
    out = out.unionByName(lost.filter("token = '@'").select(F.lit("error").alias("severity"), F.lit("start_unreachable").alias("code"), "x", "y"))
    return out.unionByName(lost.filter("token <> '@'").select(F.lit("warning").alias("severity"), F.lit("unreachable_walkable_cells").alias("code"), "x", "y"))


def audit_connectors(connectors: DataFrame, cells: DataFrame) -> DataFrame:
    """Issues of connectors (connector_id, kind, sx, sy, tx, ty): repeated ids, unknown kinds, ends off the walkable cells."""
    open_ = cells.filter("token <> 'X'").select("x", "y", F.lit(True).alias("ok"))
    ends = connectors.select("connector_id", F.explode(F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("tx").alias("x"), F.col("ty").alias("y")))).alias("p"))
    off = ends.select("connector_id", "p.x", "p.y").join(open_, ["x", "y"], "left_anti").select("connector_id", F.lit("endpoint_not_walkable").alias("code"))
    twice = connectors.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("connector_id", F.lit("duplicate_connector").alias("code"))
    odd = connectors.filter(~F.col("kind").isin("elevator", "escalator", "ramp", "stair")).select("connector_id", F.lit("unknown_kind").alias("code"))
    return off.unionByName(twice).unionByName(odd)


def audit_hazards(hazards: DataFrame) -> DataFrame:
    """Issues of hazards (hazard_id, kind, radius, severity): ranges and missing kinds."""
    rules = (("missing_kind", F.coalesce(F.trim("kind"), F.lit("")) == ""), ("negative_radius", num("radius") < 0), ("severity_out_of_range", ~num("severity").between(0, 1)), ("severity_missing", num("severity").isNull()))
    return hazards.select("hazard_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules]))).alias("code"))


def set_path(doc: dict, path: str, value: object) -> dict:
    """A copy of doc with the value at a dotted path; numbers index lists."""
    out = copy.deepcopy(doc)
    *parents, last = path.split(".")
    at: object = out
    for p in parents:
        at = at[int(p)] if isinstance(at, list) else at.setdefault(p, {})
    if isinstance(at, list):
        at[int(last)] = value
    else:
        at[last] = value
    return out


def merged_docs(base: dict, over: dict) -> dict:
    """Deep merge; lists and scalars of over replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged_docs(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def digest(doc: object) -> str:
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def patched(doc: dict, ops: Sequence[dict], origin: str | None = None) -> dict:
    """JSON Patch (add, replace, remove) on a copy; origin is the digest that the document must have."""
    if origin is not None and digest(doc) != origin:
        raise ValueError("the document is not the one that the patch is for")
    out = copy.deepcopy(doc)
    for op in ops:
        *parents, last = [p.replace("~1", "/").replace("~0", "~") for p in op["path"].split("/")[1:]]
        at: object = out
        for p in parents:
            at = at[int(p)] if isinstance(at, list) else at[p]
        if isinstance(at, list):
            i = len(at) if last == "-" else int(last)
            if op["op"] == "add":
                at.insert(i, op["value"])
            elif op["op"] == "replace":
                at[i] = op["value"]
            else:
                del at[i]
        elif op["op"] == "remove":
            del at[last]
        elif op["op"] == "replace" and last not in at:
            raise ValueError(f"nothing to replace at {op['path']}")
        else:
            at[last] = op["value"]
    return out


def sweep_variants(spark: SparkSession, parameters: dict[str, Sequence[object]]) -> DataFrame:
    """Every combination of parameter values as a row, with its variant name."""
    out = None
    for name, values in parameters.items():
        t = spark.createDataFrame([(str(v),) for v in values], f"`{name}` string")
        out = t if out is None else out.crossJoin(bounded(t))
    return out.withColumn("variant_name", F.concat_ws("__", *[F.concat(F.lit(f"{n}="), F.col(f"`{n}`")) for n in parameters]))


def lenient_json(text: Column, schema: str) -> Column:
    """A struct from generated text: code fences go, the outermost braces count, what does not parse is NULL."""
    body = F.regexp_extract(F.regexp_replace(text, r"```[a-zA-Z]*", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(body, schema)
