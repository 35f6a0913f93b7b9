"""Replay of step facts as streams: event-time windows, sessions, interval joins, and keyed state.

Rows carry event_ts (a timestamp made from time_s). Rows later than the watermark are dropped, which the
batch operators never do. Keyed state is held by applyInPandasWithState, one key's rows at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def timed(df: DataFrame, seconds: str = "time_s") -> DataFrame:
    """Adds event_ts, and a watermark on it for streams."""
    d = df.withColumn("event_ts", F.timestamp_seconds(seconds))
    return d.withWatermark("event_ts", WATERMARK) if d.isStreaming else d


def windowed_means(df: DataFrame, metrics: list[str], width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Means by tumbling or sliding window."""
    w = F.window("event_ts", width, slide) if slide else F.window("event_ts", width)
    return timed(df).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(m) for m in metrics]).select("w.start", "w.end", "rows", *metrics)


def zone_sessions(df: DataFrame, zone: str, gap: str = "5 minutes") -> DataFrame:
    """Visits of agents to zones as session windows."""
    s = timed(df).groupBy("agent_id", zone, F.session_window("event_ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("samples"))
    return s.select("agent_id", zone, F.col("s.start").alias("enter_ts"), F.col("s.end").alias("exit_ts"), "samples")


def interval_pairs(left: DataFrame, right: DataFrame, key: str, tolerance: str = "30 seconds") -> DataFrame:
    """Stream-stream join of equal keys within a time tolerance."""
    a, b = timed(left).alias("a"), timed(right).alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & F.expr(f"b.event_ts BETWEEN a.event_ts - INTERVAL {tolerance} AND a.event_ts + INTERVAL {tolerance}")
    return a.join(b, near)


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    d = timed(df)
    return d.dropDuplicatesWithinWatermark(keys) if d.isStreaming else d.dropDuplicates(keys)


def credibility(df: DataFrame, prior: tuple[float, float] = (2.0, 2.0), forgetting: float = 0.95) -> DataFrame:
    """Belief in sources per (agent_id, source_id): after each claim (step, supported), the Beta mean with forgetting.

    Runs on batches and streams; state per key is (alpha, beta).
    """

    def update(pdf: pd.DataFrame, alpha: float, beta: float) -> tuple[list[float], float, float]:
        out = []
        for ok in pdf.sort_values("step")["supported"]:
            alpha = prior[0] + (alpha - prior[0]) * forgetting + (1.0 if ok else 0.0)
            beta = prior[1] + (beta - prior[1]) * forgetting + (0.0 if ok else 1.0)
            out.append(alpha / (alpha + beta))
        return out, alpha, beta

    schema = "agent_id long, source_id string, step int, credibility double"
    if not df.isStreaming:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("step")
            return pdf[["agent_id", "source_id", "step"]].assign(credibility=update(pdf, *prior)[0])

        return df.groupBy("agent_id", "source_id").applyInPandas(whole, schema)

    def keyed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, beta = state.get if state.exists else prior
        pdf = pd.concat(list(batches)).sort_values("step")
        out, alpha, beta = update(pdf, alpha, beta)
        state.update((alpha, beta))
        yield pd.DataFrame({"agent_id": key[0], "source_id": key[1], "step": pdf["step"].to_numpy(), "credibility": out})

    return df.groupBy("agent_id", "source_id").applyInPandasWithState(keyed, schema, "alpha double, beta double", "append", GroupStateTimeout.NoTimeout)


def connector_queue(df: DataFrame, flow: float = 1.0, capacity: int = 1, travel_s: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Service of arrivals (connector_id, agent_id, time_s) per connector: start_s and finish_s of each agent, first come first served.

    Each step of dt adds flow x dt credit, up to the capacity; a start costs one credit and needs a free place.
    """

    def serve(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = pdf.sort_values(["time_s", "agent_id"]).to_dict("records")
        active: list[float] = []
        out, credit, t = [], 0.0, float(waiting[0]["time_s"])
        while len(out) < len(waiting):
            credit = min(capacity, credit + flow * dt)
            active = [x for x in active if x > t]
            while len(out) < len(waiting) and waiting[len(out)]["time_s"] <= t and len(active) < capacity and credit >= 1.0:
                row = waiting[len(out)]
                credit -= 1.0
                active.append(t + travel_s)
                out.append((row["connector_id"], row["agent_id"], row["time_s"], t, t + travel_s))
            t += dt
        return pd.DataFrame(out, columns=["connector_id", "agent_id", "time_s", "start_s", "finish_s"])

    return df.select("connector_id", "agent_id", "time_s").groupBy("connector_id").applyInPandas(serve, "connector_id string, agent_id long, time_s double, start_s double, finish_s double")
