"""Benchmark suites, and the check of many submissions at once: one row of findings per rule that a submission breaks.

Payloads are JSON in a column, read as VARIANT, so a payload of any form is checked and none fails the job. All rules of a payload are columns
of its own row. Only the payloads are shuffled, so that all cores have some: checking one takes far longer than reading it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.functions.bounds import spread

# Metrics, knobs, seeds and scenarios of the suites; tiers; fields of a submission.
METRICS = ("mean_travel_time_s", "p95_hazard_exposure", "equity_time_gap_s", "harmful_convergence_index_induced", "benchmark_score")
KNOBS = ("interventions", "information", "behavior", "hostile_channels")
SEEDS = (42, 137)
SCENARIOS = {
    "v1": (
        ("transit_cbrn", "scenarios/benchmark/transit_cbrn.yaml"),
        ("transit_shooter", "scenarios/transit_shooter.yaml"),
        ("transit_mixed", "scenarios/benchmark/transit_mixed.yaml"),
        ("large_station_multifloor", "scenarios/benchmark/v1/large_station_multifloor.yaml"),
        ("open_air_event_funnel", "scenarios/benchmark/v1/open_air_event_funnel.yaml"),
        ("mixed_indoor_outdoor_arena", "scenarios/benchmark/v1/mixed_indoor_outdoor_arena.yaml"),
    ),
    "v2": (("wildfire_wui", "scenarios/benchmark/wildfire_wui.yaml"), ("transit_shooter", "scenarios/transit_shooter.yaml")),
    "v3": (("flood_urban", "scenarios/benchmark/flood_urban.yaml"), ("quake_aftershock", "scenarios/benchmark/quake_aftershock.yaml")),
}
CLAIM_TIERS, TIERS = ("benchmark_grade", "diagnostic", "smoke"), ("smoke", "official")
REQUIRED = ("config_hash", "env_version", "overall", "policy_hash", "scenarios", "schema_version", "seed_set", "submitter", "suite")
ALLOWED = (*REQUIRED, "artifacts", "command", "created_at_utc", "notes")
HASH = "^[0-9a-f]{16,64}$"
SCORES = ("mean_score", "score_ci_low", "score_ci_high")
#: What a submission says of the software that made it.
ENVIRONMENT = ("python", "platform")
ISSUE = "array<struct<path:string,message:string>>"


@dataclass(frozen=True)
class Suite:
    """A benchmark suite. Its name in files, and its hash, follow from its fields."""

    suite: str
    metrics: tuple[str, ...] = METRICS
    seeds: tuple[int, ...] = SEEDS
    scoring_rule: str = "composite_v1"
    allowed_knobs: tuple[str, ...] = KNOBS
    scenarios: tuple[tuple[str, str], ...] = ()

    def document(self) -> dict:
        d = asdict(self)
        return {**d, "metrics": list(self.metrics), "seeds": list(self.seeds), "allowed_knobs": list(self.allowed_knobs), "scenarios": [{"name": n, "scenario_file": f} for n, f in self.scenarios]}


def content_hash(document: object) -> str:
    """The first 16 digits of the SHA-256 of a document as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(document, sort_keys=True, default=str).encode()).hexdigest()[:16]


def suites() -> dict[str, Suite]:
    return {k: Suite(k, scenarios=v) for k, v in SCENARIOS.items()}


def suite_table(spark: SparkSession, registry: Mapping[str, Suite] | None = None) -> DataFrame:
    """(suite, config_hash, seeds, scenario, scenario_file) of the registry."""
    rows = [(s.suite, content_hash(s.document()), list(s.seeds), n, f) for s in (registry or suites()).values() for n, f in s.scenarios]
    return spark.createDataFrame(rows, "suite string, config_hash string, seeds array<long>, scenario string, scenario_file string")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is(v: Column, *kinds: str) -> Column:
    """Whether a variant is of one of these kinds; a missing one is of none."""
    out = F.lit(False)
    for k in kinds:
        out = out | _kind(v).startswith(k)
    return v.isNotNull() & out


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _finding(bad: Column, path: Column | str, message: Column | str) -> Column:
    p, m = (F.lit(x) if isinstance(x, str) else x for x in (path, message))
    return F.when(F.coalesce(bad, F.lit(True)), F.array(F.struct(p.alias("path"), m.alias("message")))).otherwise(F.array().cast(ISSUE))


def _at(path: Column | str, field: str) -> Column:
    return F.concat(F.lit(path) if isinstance(path, str) else path, F.lit(f".{field}"))


def _numbers(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<long>")


def _seeds(v: Column, path: Column | str) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    items = F.try_variant_get(v, "$", "array<variant>")
    full = _is(v, "ARRAY") & (F.size(items) > 0)
    whole = full & F.forall(items, lambda s: _is(s, "BIGINT"))
    n = _numbers(v)
    return F.concat(
        _finding(~full, path, "must be a non-empty integer array"), _finding(full & ~whole, path, "all seeds must be integers"), _finding(whole & (F.size(F.array_distinct(n)) < F.size(n)), path, "seeds must be unique")
    )


def _block(v: Column, path: Column | str) -> list[Column]:
    """Findings of a score block: numbers, their order, runs, claims."""
    path = F.lit(path) if isinstance(path, str) else path
    mean, low, high = (F.try_variant_get(v, f"$.{c}", "double") for c in SCORES)
    ok = _is(v, "OBJECT")
    finite = [_is(_get(v, f"$.{c}"), "BIGINT", "DECIMAL", "DOUBLE", "FLOAT") for c in SCORES]
    runs, tier, limits, evidence = (_get(v, f"$.{c}") for c in ("run_count", "claim_tier", "claim_limitations", "validation_evidence"))
    out = [_finding(~ok, path, "must be an object")]
    out += [_finding(ok & ~f, _at(path, c), "must be a finite number") for c, f in zip(SCORES, finite, strict=True)]
    out.append(_finding(ok & finite[0] & finite[1] & finite[2] & ~((low <= mean) & (mean <= high)), path, "score CI must satisfy low <= mean <= high"))
    out.append(_finding(ok & ~(_is(runs, "BIGINT") & F.coalesce(F.try_variant_get(runs, "$", "long") >= 1, F.lit(False))), _at(path, "run_count"), "must be a positive integer"))
    given = tier.isNotNull() & (_kind(tier) != "VOID")
    out.append(_finding(ok & given & ~F.coalesce(F.try_variant_get(tier, "$", "string").isin(*CLAIM_TIERS), F.lit(False)), _at(path, "claim_tier"), f"must be one of {', '.join(CLAIM_TIERS)}"))
    items = F.coalesce(F.try_variant_get(limits, "$", "array<variant>"), F.array().cast("array<variant>"))
    given = limits.isNotNull() & (_kind(limits) != "VOID")
    out.append(_finding(ok & given & ~(_is(limits, "ARRAY") & F.forall(items, lambda s: _is(s, "STRING"))), _at(path, "claim_limitations"), "must be an array of strings"))
    given = evidence.isNotNull() & (_kind(evidence) != "VOID")
    out.append(_finding(ok & given & ~_is(evidence, "OBJECT"), _at(path, "validation_evidence"), "must be an object"))
    return out


def submission_issues(rows: DataFrame, id_col: str = "submission_id", payload: str = "payload", schema_version: str | None = None, environment: Sequence[str] = ENVIRONMENT, registry: Mapping[str, Suite] | None = None) -> DataFrame:
    """(id, path, message) of what is wrong with each submission; a payload that is NULL, no JSON or no object has one finding at $."""
    known = registry or suites()
    d = spread(rows.select(F.col(id_col), F.col(payload))).select(F.col(id_col), F.try_parse_json(payload).alias("v"), F.json_object_keys(payload).alias("keys"))
    v, none = F.col("v"), F.array().cast(ISSUE)
    found = [F.flatten(F.transform(F.array(*[F.lit(k) for k in REQUIRED]), lambda k: F.when(F.array_contains("keys", k), none).otherwise(F.array(F.struct(F.concat(F.lit("$."), k).alias("path"), F.lit("required field missing").alias("message"))))))]
    extra = F.array_sort(F.array_except("keys", F.array(*[F.lit(k) for k in ALLOWED])))
    found.append(F.transform(extra, lambda k: F.struct(F.concat(F.lit("$."), k).alias("path"), F.lit("unknown field").alias("message"))))
    if schema_version is not None:
        found.append(_finding(~F.coalesce(_text(v, "$.schema_version") == schema_version, F.lit(False)), "$.schema_version", f"must be {schema_version}"))
    found.append(_finding(~(_is(_get(v, "$.submitter"), "STRING") & (_text(v, "$.submitter") != "")), "$.submitter", "must be a non-empty string"))
    suite = F.when(_is(_get(v, "$.suite"), "STRING"), _text(v, "$.suite"))
    found.append(_finding(~F.coalesce(suite.isin(*known), F.lit(False)), "$.suite", f"must be one of {', '.join(sorted(known))}"))
    for c in ("policy_hash", "config_hash"):
        found.append(_finding(~(_is(_get(v, f"$.{c}"), "STRING") & F.coalesce(_text(v, f"$.{c}").rlike(HASH), F.lit(False))), f"$.{c}", "must be 16 to 64 hexadecimal digits"))
    hashes = F.create_map(*[F.lit(x) for k, s in known.items() for x in (k, content_hash(s.document()))])
    found.append(_finding(suite.isin(*known) & ~F.coalesce(_text(v, "$.config_hash") == hashes[suite], F.lit(False)) if known else F.lit(False), "$.config_hash", "does not match benchmark suite config hash"))
    found[-1] = F.when(F.coalesce(suite.isin(*known), F.lit(False)), found[-1]).otherwise(none)
    seeds = _get(v, "$.seed_set")
    found.append(_seeds(seeds, "$.seed_set"))
    env = _get(v, "$.env_version")
    found.append(_finding(~_is(env, "OBJECT"), "$.env_version", "must be an object"))
    found += [F.when(_is(env, "OBJECT"), _finding(~(_is(_get(env, f"$.{c}"), "STRING") & (_text(env, f"$.{c}") != "")), f"$.env_version.{c}", "must be a non-empty string")).otherwise(none) for c in environment]
    overall = _get(v, "$.overall")
    found += _block(overall, "$.overall")
    found.append(_finding(_is(overall, "OBJECT") & ~F.coalesce(_text(overall, "$.tier").isin(*TIERS), F.lit(False)), "$.overall.tier", "must be smoke or official"))
    items = F.coalesce(F.try_variant_get(v, "$.scenarios", "array<variant>"), F.array().cast("array<variant>"))
    full = _is(_get(v, "$.scenarios"), "ARRAY") & (F.size(items) > 0)
    found.append(_finding(~full, "$.scenarios", "must be a non-empty array"))
    root = F.array_sort(_numbers(seeds))

    def scenario(s: Column, i: Column) -> Column:
        path = F.concat(F.lit("$.scenarios["), i.cast("string"), F.lit("]"))
        ok, used = _is(s, "OBJECT"), _get(s, "$.seeds_used")
        name = _finding(~(_is(_get(s, "$.scenario"), "STRING") & (_text(s, "$.scenario") != "")), _at(path, "scenario"), "must be a non-empty string")
        same = _finding(F.coalesce(F.size(root) > 0, F.lit(False)) & ~F.coalesce(F.array_sort(_numbers(used)).eqNullSafe(root), F.lit(False)), _at(path, "seeds_used"), "must match root seed_set")
        return F.when(ok, F.concat(name, *_block(s, path), _seeds(used, _at(path, "seeds_used")), same)).otherwise(_finding(F.lit(True), path, "must be an object"))

    found.append(F.flatten(F.transform(items, scenario)))
    names = F.filter(F.transform(items, lambda s: F.when(_is(_get(s, "$.scenario"), "STRING"), _text(s, "$.scenario"))), lambda n: n.isNotNull() & (n != ""))
    found.append(_finding(full & (F.size(F.array_distinct(names)) < F.size(names)), "$.scenarios", "scenario names must be unique"))
    wanted = F.lit(None).cast("array<string>")
    for k, s in known.items():
        wanted = F.when(suite == k, F.array_sort(F.array(*[F.lit(n) for n, _ in s.scenarios]))).otherwise(wanted)
    missing, more = F.array_sort(F.array_except(wanted, names)), F.array_sort(F.array_except(names, wanted))
    detail = F.concat(F.lit("must match suite scenarios: missing "), F.array_join(missing, ", "), F.lit("; extra "), F.array_join(more, ", "))
    found.append(_finding(full & wanted.isNotNull() & ((F.size(missing) > 0) | (F.size(more) > 0)), "$.scenarios", detail))
    issues = F.when(_is(v, "OBJECT"), F.concat(*found)).otherwise(_finding(F.lit(True), "$", "submission must be a JSON object"))
    return d.select(id_col, F.explode(issues).alias("i")).select(id_col, "i.path", "i.message")


def hash_drift(documented: DataFrame, actual: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, documented, actual, status) of all files on either side: same, changed, missing (no file) or undocumented."""
    a = documented.select(F.col(path).alias("path"), F.col(digest).alias("documented")).distinct()
    b = actual.select(F.col(path).alias("path"), F.col(digest).alias("actual")).distinct()
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("documented").isNull(), "undocumented").when(F.col("actual") == F.col("documented"), "same").otherwise("changed")
    return a.join(b, "path", "full").withColumn("status", status)


def write_suite_documents(root: str, spark: SparkSession, registry: Mapping[str, Suite] | None = None) -> None:
    """One JSON document per suite, in a folder per suite."""
    rows = [(k, json.dumps(s.document(), sort_keys=True)) for k, s in (registry or suites()).items()]
    spark.createDataFrame(rows, "suite string, value string").write.mode("overwrite").partitionBy("suite").text(root)


def write_benchmark(runs: DataFrame, board: DataFrame, root: str, suite: Suite, policy_hash: str, created_at: str, version: str) -> None:
    """runs as CSV with header, board (a leaderboard) as JSON lines, and the manifest that says what made them, written last."""
    runs.write.mode("overwrite").option("header", True).csv(f"{root}/benchmark_runs.csv")
    board.write.mode("overwrite").json(f"{root}/leaderboard.json")
    manifest = {"suite": suite.suite, "created_at_utc": created_at, "config_hash": content_hash(suite.document()), "policy_hash": policy_hash, "seed_set": list(suite.seeds), "version": version, "scenarios": [n for n, _ in suite.scenarios]}
    runs.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/reproducibility_manifest.json")
