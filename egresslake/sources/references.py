"""Event references and station provenance from many documents: rows, columns that the data name, and findings.

Documents (YAML or JSON) are read as whole texts and parsed where they were read. What a document lacks becomes a finding; documents without
findings give their rows. Attributes, whose names only the data know, become typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of references and the fields that documents must have.
KINDS = ("drill", "expert_coded", "incident", "vr")
PROVENANCE = ("known_missing_data", "license", "scenario_assumptions", "source", "station", "timestamp")
STATION = ("access_date", "attribution", "coordinate_transform", "known_missing_indoor_topology", "level", "license", "manual_edits", "source_url", "station", "validation_use")
STATION_SOURCES, LIMITS = ("gtfs_feeds", "osm_objects", "source_files"), ("diagnostic", "not", "only", "proxy")
#: Attribute names that may become columns.
MOST_COLUMNS = 500
PROVENANCE_TEXTS = ("source", "source_url", "license", "timestamp", "access_date", "station", "level", "coordinate_transform", "scenario_assumptions", "known_missing_data", "notes")
OBSERVATION = "event_id string, label string, time_s double, timestamp string, x double, y double, agent_count long, confidence double, notes string, attributes map<string,string>"


def _schema() -> str:
    fields = ",".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in OBSERVATION.split(", "))
    return f"path string, reference_id string, reference_type string, description string, provenance map<string,string>, observations array<struct<{fields}>>, issues array<string>"


def plain(value: object) -> str | None:
    """A value as text: strings as they are, others as JSON; nothing stays nothing."""
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, default=str)


def listed(value: object) -> str:
    return "; ".join(str(v) for v in value) if isinstance(value, list | tuple) else str(value)


def _number(value: object, kind: type, issues: list[str], where: str) -> object:
    try:
        return None if value is None else kind(value)
    except (TypeError, ValueError):
        issues.append(f"{where}: no number")
        return None


def read_reference(doc: object) -> tuple:
    """(reference_id, reference_type, description, provenance, observations, issues) of a parsed document."""
    issues: list[str] = []
    if not isinstance(doc, Mapping):
        return None, None, None, {}, [], ["document: must be a mapping"]
    ref, kind = str(doc.get("reference_id") or "").strip(), str(doc.get("reference_type") or "").strip().lower()
    issues += ["reference_id: missing"] if not ref else []
    issues += [f"reference_type: must be one of {', '.join(KINDS)}"] if kind not in KINDS else []
    given = doc.get("provenance")
    if not isinstance(given, Mapping):
        given = {}
        issues.append("provenance: must be a mapping")
    else:
        issues += [f"provenance.{k}: missing" for k in PROVENANCE if k not in given]
    provenance = {k: listed(given.get(k, "")) for k in PROVENANCE_TEXTS}
    found = doc.get("observations")
    issues += ["observations: at least one is needed"] if not isinstance(found, list) or not found else []
    rows = []
    for i, o in enumerate(found if isinstance(found, list) else [], 1):
        where = f"observations[{i}]"
        if not isinstance(o, Mapping):
            issues.append(f"{where}: must be a mapping")
            continue
        label, at, more = str(o.get("label") or "").strip(), o.get("location"), o.get("attributes") or {}
        issues += [f"{where}.label: missing"] if not label else []
        if not isinstance(more, Mapping):
            issues.append(f"{where}.attributes: must be a mapping")
            more = {}
        x = y = None
        if at is not None:
            if isinstance(at, list | tuple) and len(at) == 2:
                x, y = (_number(v, float, issues, f"{where}.location") for v in at)
            else:
                issues.append(f"{where}.location: must be two numbers")
        count = _number(o.get("agent_count"), int, issues, f"{where}.agent_count")
        rows.append((
            str(o.get("event_id", f"event_{i}")).strip(), label, _number(o.get("time_s"), float, issues, f"{where}.time_s"), str(o.get("timestamp", "")), x, y, count,
            _number(o.get("confidence"), float, issues, f"{where}.confidence"), str(o.get("notes", "")), {str(k): plain(v) for k, v in more.items()},
        ))
    return ref or None, kind or None, str(doc.get("description", "")), provenance, rows, issues


def event_documents(spark: SparkSession, path: str, glob: str = "*.{yaml,yml,json}") -> DataFrame:
    """One row per document below a path: reference, provenance, observations, and issues (empty where it may be used)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for name, text in zip(pdf["path"], pdf["value"], strict=True):
                try:
                    out.append((name, *read_reference(yaml.safe_load(text))))
                except yaml.YAMLError as e:
                    out.append((name, None, None, None, {}, [], [f"document: {type(e).__name__}"]))
            names = ["path", "reference_id", "reference_type", "description", "provenance", "observations", "issues"]
            frame = pd.DataFrame(out, columns=names)
            keys = [c.split(" ", 1)[0] for c in OBSERVATION.split(", ")]
            frame["observations"] = [[dict(zip(keys, o, strict=True)) for o in rows] for rows in frame["observations"]]
            yield frame

    texts = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return texts.select("value", F.col("_metadata.file_path").alias("path")).mapInPandas(parse, _schema())


def document_issues(docs: DataFrame) -> DataFrame:
    """(path, issue) of documents that may not be used."""
    return docs.select("path", F.explode("issues").alias("issue"))


def observations(docs: DataFrame) -> DataFrame:
    """Observations of the documents without issues, attributes as a map."""
    return docs.filter(F.size("issues") == 0).select("reference_id", "reference_type", F.explode("observations").alias("o")).select("reference_id", "reference_type", "o.*")


def provenance(docs: DataFrame) -> DataFrame:
    """A row of provenance per document without issues, lists joined by "; "."""
    return docs.filter(F.size("issues") == 0).select("reference_id", "reference_type", *[F.coalesce(F.col("provenance")[k], F.lit("")).alias(k) for k in PROVENANCE_TEXTS])


def widened(df: DataFrame, column: str, prefix: str = "attribute_", most: int = MOST_COLUMNS) -> DataFrame:
    """df with the keys of a map column as columns, named by prefix and key, in order; the map goes.

    A key whose values are all whole numbers becomes long, all numbers double, all true or false boolean, else string. One aggregate finds
    keys and kinds; more keys than `most` are an error.
    """
    pairs = df.select(F.explode(column).alias("k", "v"))
    whole, number, yes = F.col("v").rlike(r"^[+-]?[0-9]{1,18}$"), F.col("v").try_cast("double").isNotNull(), F.lower("v").isin("true", "false")
    seen = F.col("v").isNotNull()

    def every(c: Column) -> Column:
        return F.bool_and(F.when(seen, F.coalesce(c, F.lit(False))))

    kinds = pairs.groupBy("k").agg(every(whole).alias("w"), every(number).alias("n"), every(yes).alias("b")).orderBy("k").limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError(f"over {most} keys in {column}")

    def typed(r) -> Column:
        v = F.col(column)[r.k]
        kind = "long" if r.w else "double" if r.n else "boolean" if r.b else "string"
        return v.try_cast(kind).alias(f"{prefix}{r.k}")

    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *[typed(r) for r in kinds])


def natural_join(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """A join on all columns that both have, NULL equal to NULL; those columns come once, then the others of left and right.

    Common columns of different types are compared as strings where one is a string, else as Spark widens them. No common column is an error.
    """
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common columns")
    if how not in ("left", "inner", "full", "right"):
        raise ValueError(f"unknown join: {how}")
    l, r = left, right.withColumnsRenamed({c: f"_r_{c}" for c in common})
    kinds_l, kinds_r = dict(left.dtypes), dict(right.dtypes)
    on = F.lit(True)
    for c in common:
        a, b = l[c], r[f"_r_{c}"]
        if kinds_l[c] != kinds_r[c] and "string" in (kinds_l[c], kinds_r[c]):
            a, b = a.cast("string"), b.cast("string")
        on = on & a.eqNullSafe(b)
    j = l.join(r, on, how)
    shared = [(F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")) if how in ("full", "right") else F.col(f"`{c}`")).alias(c) for c in common]
    return j.select(*shared, *[F.col(f"`{c}`") for c in left.columns if c not in common], *[F.col(f"`{c}`") for c in right.columns if c not in common])


def station_issues(rows: DataFrame, id_col: str, payload: str, report: str | None = None) -> DataFrame:
    """(id, issue) of station provenance given as JSON: fields that are missing or empty, sources, lists, stated limits.

    Cases for reports (a boolean column, or all) must state their limits and must have provenance at all; for others NULL is fine.
    """
    v = F.try_parse_json(payload)
    d = rows.select(F.col(id_col), F.col(payload).isNotNull().alias("_given"), v.alias("v"), (F.coalesce(F.col(report), F.lit(False)) if report else F.lit(True)).alias("_report"))

    def field(k: str) -> Column:
        return F.try_variant_get(F.col("v"), f"$.{k}", "string")

    def empty(k: str) -> Column:
        return field(k).isNull() | field(k).isin("", "[]", "{}", "null")

    def listed_(k: str) -> Column:
        return F.coalesce(F.size(F.try_variant_get(F.col("v"), f"$.{k}", "array<variant>")) > 0, F.lit(False))

    def note(bad: Column, text: str) -> Column:
        return F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    some = F.lit(False)
    for k in STATION_SOURCES:
        some = some | ~empty(k)
    limits = F.lower(F.coalesce(field("validation_use"), F.lit(""))).rlike("|".join(LIMITS))
    found = [note(empty(k), f"missing: {k}") for k in STATION] + [note(~some, f"one of {', '.join(STATION_SOURCES)} is needed")]
    found += [note(~empty(k) & ~listed_(k), f"must be a list: {k}") for k in ("known_missing_indoor_topology", "manual_edits")] + [note(F.col("_report") & ~limits, "limits of validation must be stated")]
    issues = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.concat(*found)).when(F.col("_given"), F.array(F.lit("must be a mapping"))).otherwise(note(F.col("_report"), "provenance is missing"))
    return d.select(id_col, F.explode(issues).alias("issue"))
