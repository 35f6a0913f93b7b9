"""Documents taken apart, filled without overwriting, and put together again."""

import json

import pytest

from egresslake.operators import merging, submissions


def parse(rows):
    return {r.id: json.loads(r.payload) for r in rows.collect()}


DOCS = {
    "a": {"name": "s", "population": {"total": 1, "cohorts": [{"name": "regulars", "count": 1, "base_speed": 1.11}, {"name": "vis/it~ors", "tags": []}, 7, None]}, "empty": {}, "deep": [[1, [2.5, "x\"y"]], {}], "": "no key", "ü\n": True},
    "b": {"population": "closed"},
    "c": {},
    "d": [1, 2],
    "e": "text",
}


def frame(spark, docs):
    return spark.createDataFrame([(k, v if isinstance(v, str | None) and k.startswith("raw") else json.dumps(v)) for k, v in docs.items()], "id string, payload string")


def test_documents_come_back(spark):
    docs = frame(spark, DOCS | {"raw": "no json"}).repartition(3)
    for by_name in ("name", None):
        back = parse(merging.documents(merging.leaves(docs, "id", "payload", by_name)))
        assert back == DOCS
    paths = {r.path: r.value for r in merging.leaves(docs, "id", "payload").filter("id = 'a'").collect()}
    assert paths["/population/cohorts/=regulars/base_speed"] == "1.11" and paths["/population/cohorts/=vis~1it~0ors/tags"] == "[]" and paths["/population/cohorts/2"] == "7" and paths["/empty"] == "{}"


def test_filling_never_overwrites(spark):
    generated = {
        "a": {"population": {"total": 5, "cohorts": [{"name": "regulars", "base_speed": 9, "base_rationality": 0.8}, {"name": "new", "count": 3}]}, "empty": {"x": 1}, "deep": 3, "metadata": {"note": "n"}, "secret": 1},
        "b": {"population": {"total": 3}}, "c": {"metadata": {"note": [1, 2]}}, "zz": {"metadata": {"note": 1}},
    }
    allowed = [r"/population/total", r"/population/cohorts/=[^/]+/.*", r"/metadata/.*", r"/empty/x", r"/deep"]
    merged, report = merging.fill_documents(frame(spark, DOCS), frame(spark, generated), allowed)
    got = parse(merged)
    want = json.loads(json.dumps(DOCS))
    want["a"]["population"]["cohorts"][0]["base_rationality"] = 0.8
    want["a"]["population"]["cohorts"].append({"name": "new", "count": 3})
    want["a"] |= {"empty": {"x": 1}, "metadata": {"note": "n"}}
    want["c"] = {"metadata": {"note": [1, 2]}}
    assert got == want
    status = {(r.id, r.path): r.status for r in report.collect()}
    assert status["a", "/population/total"] == "existing_value" and status["a", "/population/cohorts/=regulars/base_speed"] == "existing_value" and status["a", "/deep"] == "existing_value"
    assert status["a", "/population/cohorts/=regulars/base_rationality"] == "applied" and status["a", "/secret"] == "not_allowed" and status["b", "/population/total"] == "existing_parent" and status["zz", "/metadata/note"] == "unknown_document"
    again, report = merging.fill_documents(merged, frame(spark, generated), allowed)
    assert parse(again) == want and {r.status for r in report.collect()} == {"existing_value", "not_allowed", "existing_parent", "unknown_document"}


def test_nothing_generated_and_no_documents(spark):
    none = spark.createDataFrame([], "id string, payload string")
    merged, report = merging.fill_documents(frame(spark, DOCS), none, [".*"])
    assert parse(merged) == DOCS and report.collect() == []
    merged, report = merging.fill_documents(none, frame(spark, {"a": {"x": 1}}), [".*"])
    assert merged.collect() == [] and [r.status for r in report.collect()] == ["unknown_document"]


def test_too_deep(spark, monkeypatch):
    monkeypatch.setattr(merging, "DEPTH", 2)
    with pytest.raises(ValueError):
        merging.leaves(frame(spark, {"a": {"b": {"c": {"d": 1}}}}), "id", "payload")


def test_work_is_spread_and_levels_are_built_once(spark):
    """Rows of one small file go to all cores, and a document's levels are not put together again for each level above."""
    docs = spark.createDataFrame([(1, '{"a": {"b": {"c": {"d": {"e": [1, {"f": 2}]}}}}}')], "id long, payload string").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert submissions.submission_issues(docs, "id").rdd.getNumPartitions() >= 4 * cores
    parts = merging.leaves(docs, "id", "payload")
    assert parts.rdd.getNumPartitions() >= 4 * cores
    whole = merging.documents(parts.localCheckpoint())
    assert json.loads(whole.first().payload) == json.loads(docs.first().payload)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 9
