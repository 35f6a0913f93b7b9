"""Plausibility metrics of runs as long rows (keys, metric, value), as rules check them: hazards, vertical transport, hostile channels and calls.

Each map is one aggregate per table, joined by run; a run without rows in a table has 0.0 there. evidence.plausibility has the behavioural map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero, truthy

# Kinds of connectors that lead up or down.
VERTICAL, ELEVATOR = ("stairs", "ramp", "elevator", "escalator"), "elevator"


def _long(runs: DataFrame, keys: Sequence[str], parts: Sequence[DataFrame]) -> DataFrame:
    """parts joined to runs by keys, NULL equal to NULL; missing values 0.0."""
    out = runs.select(*keys).distinct()
    for part in parts:
        p = part.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        out = out.join(p, on, "left").drop(*[f"_k_{k}" for k in keys])
    names = [c for c in out.columns if c not in keys]
    return out.select(*keys, *[or_zero(F.col(c).cast("double")).alias(c) for c in names]).unpivot(list(keys), names, "metric", "value")


def _number(c: Column) -> Column:
    return F.coalesce(num(c), F.lit(0.0))


def hazard_metrics(hazards: DataFrame, agent_steps: DataFrame, agents: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """hazards: keys, imported, radius, severity, max_gas_concentration, min_visibility_m, max_obscuration_percent_m; agent_steps: hazard_load, hazard_exposure.

    Runs without agent steps take the last loads and exposures of agents (same columns).
    """
    imported = truthy(F.col("imported"))

    def of(c: str) -> Column:
        return F.when(imported, _number(F.col(c)))

    h = hazards.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hazard_count"), F.count_if(imported).alias("imported_hazard_count"), F.count_if(~imported).alias("stylized_hazard_count"), F.max(_number(F.col("radius"))).alias("max_hazard_radius_m"), F.max(_number(F.col("severity"))).alias("max_hazard_severity"),
        F.max(of("max_gas_concentration")).alias("max_imported_gas_concentration"), F.min(of("min_visibility_m")).alias("min_imported_visibility_m"), F.max(of("max_obscuration_percent_m")).alias("max_obscuration_percent_m"),
    )
    loads = [f.select(*keys, _number(F.col("hazard_load")).alias("l"), _number(F.col("hazard_exposure")).alias("e"), F.lit(k).alias("_s")) for k, f in enumerate((agent_steps, agents))]
    both = loads[0].unionByName(loads[1])

    def stat(f, c: str) -> Column:
        return F.coalesce(f(F.when(F.col("_s") == 0, F.col(c))), f(F.col(c)))

    a = both.groupBy(*keys).agg(
        stat(F.avg, "l").alias("mean_agent_hazard_load"), stat(F.max, "l").alias("max_agent_hazard_load"), stat(F.avg, "e").alias("mean_agent_hazard_exposure"), stat(F.max, "e").alias("max_agent_hazard_exposure")
    )
    return _long(hazards.select(*keys).unionByName(agent_steps.select(*keys)).unionByName(agents.select(*keys)), keys, [h, a])


def transport_metrics(connectors: DataFrame, usage: DataFrame, connector_steps: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """connectors: keys, connector_id, type; usage: keys, connector_id, used (in all); connector_steps: keys, connector_id, queue_length, capacity_used."""
    kind = F.lower(F.coalesce(F.col("type"), F.lit("")))
    c = connectors.select(*keys, F.col("connector_id").cast("string").alias("connector_id"), kind.isin(*VERTICAL).alias("_v"), (kind == ELEVATOR).alias("_e"))
    used = usage.groupBy(*keys, F.col("connector_id").cast("string").alias("connector_id")).agg(F.sum("used").alias("used"))
    j = c.join(used, [*keys, "connector_id"], "left")
    counted = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connector_count"), F.count_if("_v").alias("vertical_connector_count"), F.count_if("_e").alias("elevator_count"), F.sum(F.when(F.col("_v"), F.col("used"))).alias("vertical_connector_usage"), F.sum(F.when(F.col("_e"), F.col("used"))).alias("elevator_usage")
    )
    s = connector_steps.withColumn("connector_id", F.col("connector_id").cast("string")).join(c.filter("_e").select(*keys, "connector_id", "_e").distinct(), [*keys, "connector_id"], "left")
    peaks = s.groupBy(*keys).agg(
        *[F.greatest(F.lit(0.0), F.max(F.when(only, _number(F.col(v))))).alias(n) for n, v, only in (
            ("max_connector_queue_length", "queue_length", F.lit(True)), ("max_connector_capacity_used", "capacity_used", F.lit(True)), ("max_elevator_queue_length", "queue_length", F.col("_e")), ("max_elevator_capacity_used", "capacity_used", F.col("_e")),
        )]
    )
    return _long(connectors.select(*keys).unionByName(connector_steps.select(*keys)), keys, [counted, peaks])


def hostile_metrics(channels: DataFrame, events: DataFrame, calls: DataFrame, decisions: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """channels: keys; events: recipients, credibility; calls: validation_status, cache_status, provider, used_fallback; decisions: validation_status, used_fallback."""

    def count_if(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    a = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("hostile_channel_count"))
    b = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("hostile_channel_event_count"), F.sum(_number(F.col("recipients"))).alias("hostile_channel_recipients"), F.avg(_number(F.col("credibility"))).alias("mean_hostile_credibility"))
    c = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("llm_call_count"), count_if(F.col("validation_status") == "accepted").alias("llm_accepted_count"), count_if(F.col("validation_status") == "rejected").alias("llm_rejected_count"), F.count_if(truthy(F.col("used_fallback"))).alias("llm_fallback_count"),
        count_if(F.col("cache_status") == "hit").alias("llm_cache_hit_count"), count_if(F.col("cache_status") == "miss").alias("llm_cache_miss_count"), count_if((F.col("cache_status") == "budget_exceeded") | (F.col("provider") == "budget_guard")).alias("llm_budget_blocked_count"),
    )
    d = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("agent_llm_decision_count"), count_if(F.col("validation_status") == "accepted").alias("agent_llm_accepted_count"), count_if(F.col("validation_status") == "rejected").alias("agent_llm_rejected_count"), F.count_if(truthy(F.col("used_fallback"))).alias("agent_llm_fallback_count")
    )
    runs = channels.select(*keys)
    for f in (events, calls, decisions):
        runs = runs.unionByName(f.select(*keys))
    return _long(runs, keys, [a, b, c, d])
