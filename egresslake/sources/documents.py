"""Study documents and small reports: typed configuration, event references, zipped surveys, briefs."""

from __future__ import annotations

import csv
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from egresslake.functions.text import decimal_comma
from egresslake.sources.files import required, scenario


def study(path: str) -> dict:
    """A study document with its required fields checked and defaults set."""
    doc = scenario(path).get("study", scenario(path))
    missing = [k for k in ("name", "scenario_file") if not doc.get(k)]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return {"repetitions": 1, "variants": [], "sweep": [], **doc}


def zipped_csv(spark: SparkSession, path: str, member: str) -> DataFrame:
    """A CSV inside a zip archive, all columns strings."""
    with zipfile.ZipFile(path) as z, z.open(member) as f:
        rows = list(csv.reader(io.TextIOWrapper(f, "utf-8-sig")))
    return spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


def route_choices(responses: DataFrame, confidence: DataFrame) -> DataFrame:
    """Typed choices in order, without training tasks, with the user's choice before (-1 left, 1 right, 0 none) and confidence (the last wins)."""
    required(responses, ["userId", "taskId", "taskCount", "choice"])
    t = F.col("taskId")
    training = t.endswith("_tr") | t.contains("_tr_")
    keys = ["userId", "taskId", "taskCount"]
    last = Window.partitionBy(*keys).orderBy(F.desc("row"))
    c = confidence.withColumn("row", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*keys, decimal_comma(F.col("confidence")).alias("confidence"))
    r = responses.filter(~training).withColumn("taskCount", F.col("taskCount").try_cast("int").cast("string")).join(c, keys, "left")
    before = F.lag("choice").over(Window.partitionBy("userId").orderBy(F.col("taskCount").cast("int"), "taskId"))
    return r.withColumn("previous", F.when(before == "left", -1).when(before == "right", 1).otherwise(0))


def event_reference(spark: SparkSession, text: str) -> DataFrame:
    """Observations of an event reference (YAML or JSON): id, time_s, value and attributes as a map; required fields checked."""
    import yaml

    rows = []
    for i, o in enumerate(yaml.safe_load(text)["observations"]):
        if "id" not in o or "value" not in o:
            raise ValueError(f"observation {i} lacks id or value")
        rows.append((str(o["id"]), float(o.get("time_s", 0.0)), float(o["value"]), {k: str(v) for k, v in o.get("attributes", {}).items()}))
    return spark.createDataFrame(rows, "id string, time_s double, value double, attributes map<string,string>")


def policy_brief(rows: DataFrame, title: str, limit: int = 20) -> str:
    """Markdown of the largest changes (metric, baseline, variant, pct_change)."""
    top = rows.orderBy(F.desc(F.abs("pct_change")), "metric").limit(limit).collect()

    def short(v: float | None) -> str:
        return "n/a" if v is None else f"{v:.3f}".rstrip("0").rstrip(".")

    lines = [f"# {title}", "", "| Metric | Baseline | Variant | Change |", "| --- | --- | --- | --- |"]
    return "\n".join([*lines, *[f"| {r.metric} | {short(r.baseline)} | {short(r.variant)} | {'+' if (r.pct_change or 0) >= 0 else ''}{short(r.pct_change)} % |" for r in top]])


def store_records(df: DataFrame, root: str) -> None:
    """Generation records as JSON lines, in at most 256 folders by the first digits of the key's hash, so that a reader prunes to the part that has a key."""
    part = F.substring(F.sha2(F.coalesce(F.col("cache_key"), F.lit("")), 256), 1, 2)
    df.withColumn("part", part).repartition("part").write.mode("append").partitionBy("part").json(root)


def submission_issues(payload: str, scenarios: list[str]) -> list[str]:
    """What is wrong with a benchmark submission (JSON): fields, hash form, seeds, interval order, scenario set."""
    p, out = json.loads(payload), []
    fields = {"schema_version", "suite", "policy_hash", "seed_set", "overall", "scenarios"}
    out += [f"missing:{k}" for k in sorted(fields - set(p))] + [f"unknown:{k}" for k in sorted(set(p) - fields)]
    if len(str(p.get("policy_hash", ""))) != 16 or set(str(p.get("policy_hash"))) - set("0123456789abcdef"):
        out.append("policy_hash")
    seeds = p.get("seed_set", [])
    out += ["seed_set"] if len(seeds) != len(set(seeds)) or not seeds else []
    o = p.get("overall", {})
    out += ["interval_order"] if not o.get("score_ci_low", 0) <= o.get("mean_score", 0) <= o.get("score_ci_high", 0) else []
    names = {s.get("scenario") for s in p.get("scenarios", [])}
    return out + [f"missing_scenario:{s}" for s in sorted(set(scenarios) - names)] + [f"extra_scenario:{s}" for s in sorted(names - set(scenarios))]
