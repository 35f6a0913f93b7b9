"""Command line: summaries, comparisons, calibrations, audits, submissions and exports."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.operators import calibration, rasters, reports, resampling, submissions
from egresslake.operators.aggregates import compare_rows
from egresslake.operators.audits import CALL_ORDER, call_hash, verified_chain
from egresslake.operators.comparison import causal_deltas
from egresslake.operators.trajectory import compare_trajectories, flow_summary, trajectory_summary
from egresslake.plans.registry import QUERIES
from egresslake.sources import archives, commits, files, references, sinks
from egresslake.sources.bundle import StudyBundle

Command = Callable[[SparkSession, argparse.Namespace], "int | None"]
COMMANDS: dict[str, tuple[list[str], Command]] = {}


def command(name: str, *args: str) -> Callable[[Command], Command]:
    """Registers a command with its positional arguments."""

    def keep(f: Command) -> Command:
        COMMANDS[name] = (list(args), f)
        return f

    return keep


def session() -> SparkSession:
    return SparkSession.builder.appName("egresslake").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def shown(df: DataFrame, rows: int = 200) -> None:
    df.show(rows, truncate=False)


def found(issues: DataFrame) -> int:
    """Shows findings; 1 where there are any."""
    shown(issues)
    return int(issues.limit(1).count())


@command("summarize", "path")
def _(spark, a):
    shown(trajectory_summary(files.trajectory_table(spark, a.path)))


@command("compare-trajectory", "simulated", "reference")
def _(spark, a):
    simulated = files.trajectory_table(spark, a.simulated)
    shown(compare_trajectories(simulated, files.trajectory_table(spark, a.reference), [c for c in ("variant_name",) if c in simulated.columns]))


@command("flow", "path")
def _(spark, a):
    shown(flow_summary(files.petrack(spark, a.path), (0.35, 0.0), (-0.35, 0.0)))


@command("compare", "baseline", "variant", "metrics")
def _(spark, a):
    one = [StudyBundle.load(spark, x).tables["summary"].filter("record_type = 'study_aggregate'") for x in (a.baseline, a.variant)]
    shown(compare_rows(*one, a.metrics.split(",")))


@command("compare-export", "baseline", "variant", "metrics", "out")
def _(spark, a):
    one = [StudyBundle.load(spark, x).tables["summary"].filter("record_type = 'study_aggregate'") for x in (a.baseline, a.variant)]
    sinks.export_comparison(compare_rows(*one, a.metrics.split(",")), a.out, a.baseline, a.variant)


@command("causal-compare", "bundle", "baseline", "metrics")
def _(spark, a):
    shown(causal_deltas(StudyBundle.load(spark, a.bundle).tables["summary"], a.metrics.split(","), a.baseline))


@command("aggregate", "bundle", "metrics")
def _(spark, a):
    shown(StudyBundle.load(spark, a.bundle).with_aggregates(a.metrics.split(",")))


@command("verify-chain", "bundle")
def _(spark, a):
    calls = StudyBundle.load(spark, a.bundle).tables["llm_calls"].withColumnsRenamed({"audit_chain_prev_hash": "prev_hash", "audit_chain_hash": "chain_hash"})
    return found(verified_chain(calls.withColumn("row_hash", call_hash(calls)), ["run_id"], CALL_ORDER).filter("first_bad is not null"))


@command("export", "path", "format", "out")
def _(spark, a):
    writers = {"jupedsim": sinks.write_jupedsim, "vadere": sinks.write_vadere, "pedpy": sinks.write_pedpy, "sqlite": sinks.write_sqlite}
    df = files.trajectory_table(spark, a.path)
    writers[a.format](sinks.external_frame(df) if a.format == "sqlite" else df, a.out)


@command("cache", "root")
def _(spark, a):
    shown(files.cache_records(spark, a.root).groupBy("provider", "model", "validation_status").count())


@command("population-cache", "root")
def _(spark, a):
    shown(files.population_records(spark, a.root).groupBy("provider", "model", "validation_status").count())


@command("calibrate-route-choice", "archives", "out")
def _(spark, a):
    responses = archives.archive_csv(spark, a.archives, ["userId", "taskId", "taskCount", "AOI", "time"], "responses.csv")
    confidence = archives.archive_csv(spark, a.archives, ["userId", "taskId", "taskCount", "confidence"], "confidence.csv")
    rows = archives.route_observations(responses, confidence)
    rows.write.mode("overwrite").option("header", True).csv(f"{a.out}/observations.csv")
    sinks.write_document(spark, calibration.route_choice_fit(rows), f"{a.out}/fit.json")


@command("calibrate-population", "feed", "population", "out")
def _(spark, a):
    profile = calibration.demand_profile(files.ridership(spark, a.feed), "station_complex", "transit_timestamp", "ridership", int(a.population))
    profile.write.mode("overwrite").parquet(f"{a.out}/profile.parquet")
    calibration.demand_metrics(profile).write.mode("overwrite").json(f"{a.out}/metrics.json")


@command("fit-curve", "table", "density", "speed")
def _(spark, a):
    check = calibration.curve_check(spark.read.parquet(a.table), a.density, a.speed)
    print(json.dumps(check, sort_keys=True))
    return int(not check["passed"])


@command("leaderboard", "runs", "policy", "seed", "score", "scenario")
def _(spark, a):
    shown(resampling.leaderboard(spark.read.parquet(a.runs), a.policy, a.seed, a.score, a.scenario))


@command("benchmark-suites", "out")
def _(spark, a):
    submissions.write_suite_documents(a.out, spark)


@command("validate-submission", "path")
def _(spark, a):
    rows = spark.read.text(a.path, wholetext=True).select(F.col("_metadata.file_path").alias("submission_id"), F.col("value").alias("payload"))
    return found(submissions.submission_issues(rows))


@command("hash-audit", "document", "root")
def _(spark, a):
    return found(files.hash_audit(spark, a.document, a.root).filter("status in ('changed', 'missing')"))


@command("references", "path")
def _(spark, a):
    docs = references.event_documents(spark, a.path)
    shown(references.provenance(docs))
    return found(references.document_issues(docs))


@command("station-provenance", "path")
def _(spark, a):
    rows = spark.read.text(a.path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return found(references.station_issues(rows, "path", "payload"))


@command("hazard-config", "path")
def _(spark, a):
    rows = spark.read.text(a.path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return found(reports.hazard_config_issues(rows, "path", "payload"))


@command("convert-gtfs", "feed", "out")
def _(spark, a):
    cells, connectors = rasters.pathway_layout(files.gtfs_pathways(spark, a.feed))
    cells.write.mode("overwrite").parquet(f"{a.out}/cells.parquet")
    connectors.write.mode("overwrite").parquet(f"{a.out}/connectors.parquet")


@command("convert-drawings", "path", "out")
def _(spark, a):
    archives.drawings(spark, a.path).write.mode("overwrite").parquet(a.out)


@command("committed-runs", "root")
def _(spark, a):
    shown(commits.committed(spark, a.root).orderBy("run_index"))


@command("query", "name", "sf_dir")
def _(spark, a):
    shown(QUERIES[a.name](spark, a.sf_dir), 50)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="egresslake")
    s = p.add_subparsers(dest="command", required=True)
    for name, (args, _) in COMMANDS.items():
        c = s.add_parser(name)
        for a in args:
            c.add_argument(a)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return COMMANDS[a.command][1](session(), a) or 0


if __name__ == "__main__":
    sys.exit(main())
