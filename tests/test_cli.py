"""Commands on small files: what they write, and 1 where something is found."""

import hashlib
import json
import zipfile

import pytest

from egresslake import cli
from egresslake.operators import submissions
from egresslake.sources import commits


@pytest.fixture()
def path(spark, tmp_path):
    df = spark.createDataFrame([(a, t * 1.0, t * 1.0, a * 1.0) for a in (1, 2) for t in range(4)], "agent_id long, time_s double, x double, y double")
    df.write.parquet(str(tmp_path / "t.parquet"))
    return tmp_path


def test_trajectories(path, capsys):
    t = str(path / "t.parquet")
    assert cli.main(["summarize", t]) == 0 and cli.main(["compare-trajectory", t, t]) == 0
    assert "mean_speed_mps" in capsys.readouterr().out
    for kind in ("jupedsim", "vadere", "pedpy", "sqlite"):
        assert cli.main(["export", t, kind, str(path / kind)]) == 0 and (path / kind).exists()


def test_calibrations(spark, path, capsys):
    (path / "r.csv").write_text("transit_timestamp,station_complex,ridership\n" + "".join(f"2024-12-31T{h:02d}:00:00.000,S,{10 * h + 1}\n" for h in range(24)))
    assert cli.main(["calibrate-population", str(path / "r.csv"), "50", str(path / "pop")]) == 0
    assert spark.read.parquet(str(path / "pop/profile.parquet")).groupBy().sum("agents").first()[0] == 50 and spark.read.json(str(path / "pop/metrics.json")).first().hours == 24
    with zipfile.ZipFile(path / "a.zip", "w") as z:
        z.writestr("responses.csv", "userId,taskId,taskCount,AOI,time\n" + "".join(f"u{u},L-WS0_R-N{'SML'[n % 3]}{(u + n) % 2},{n},corridor_{('left', 'right')[(u * n) % 3 > 0]},{100 * n}\n" for u in range(12) for n in range(1, 8)))
        z.writestr("confidence.csv", "userId,taskId,taskCount,confidence\nu1,L-WS0_R-NM0,1,3\n")
    assert cli.main(["calibrate-route-choice", str(path), str(path / "fit")]) == 0
    assert json.loads(spark.read.text(str(path / "fit/fit.json")).first().value)["records"]["total"] == 84
    spark.createDataFrame([(0.5 + i / 10, 1.0) for i in range(20)], "d double, v double").write.parquet(str(path / "curve"))
    assert cli.main(["fit-curve", str(path / "curve"), "d", "v"]) == 1 and '"passed": false' in capsys.readouterr().out


def test_findings_set_the_exit_code(spark, path):
    (path / "sub").mkdir()
    (path / "sub/a.json").write_text("{}")
    assert cli.main(["validate-submission", str(path / "sub")]) == 1
    suite = submissions.suites()["v2"]
    block = {"mean_score": 1.5, "score_ci_low": 1, "score_ci_high": 2, "run_count": 1}
    doc = {"schema_version": "s", "suite": "v2", "submitter": "x", "policy_hash": "0" * 16, "config_hash": submissions.content_hash(suite.document()), "env_version": {"python": "3", "platform": "p"}, "seed_set": [1], "overall": {**block, "tier": "smoke"}, "scenarios": [{"scenario": n, **block, "seeds_used": [1]} for n, _ in suite.scenarios]}
    (path / "sub/a.json").write_text(json.dumps(doc))
    assert cli.main(["validate-submission", str(path / "sub")]) == 0
    (path / "files").mkdir()
    (path / "files/x").write_text("x")
    (path / "doc.md").write_text(hashlib.sha256(b"x").hexdigest() + "  x\n")
    assert cli.main(["hash-audit", str(path / "doc.md"), str(path / "files")]) == 0
    (path / "files/x").write_text("y")
    assert cli.main(["hash-audit", str(path / "doc.md"), str(path / "files")]) == 1
    (path / "h.json").write_text('{"hazards": [1]}')
    assert cli.main(["hazard-config", str(path / "h.json")]) == 1 and cli.main(["station-provenance", str(path / "h.json")]) == 1
    (path / "refs").mkdir()
    (path / "refs/r.yaml").write_text("reference_id: r\n")
    assert cli.main(["references", str(path / "refs")]) == 1


def test_tables_and_suites(spark, path, capsys, sf):
    spark.createDataFrame([("p", s, "a", float(s)) for s in range(4)], "policy string, seed int, scenario string, score double").write.parquet(str(path / "runs"))
    assert cli.main(["leaderboard", str(path / "runs"), "policy", "seed", "score", "scenario"]) == 0 and "smoke" in capsys.readouterr().out
    assert cli.main(["benchmark-suites", str(path / "suites")]) == 0 and len(list((path / "suites").glob("suite=*"))) == 3
    commits.commit_run({"t": spark.range(2)}, str(path / "study"), 0, "run-0")
    assert cli.main(["committed-runs", str(path / "study")]) == 0 and "run-0" in capsys.readouterr().out
    assert cli.main(["query", "q_congestion_share", sf]) == 0
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
