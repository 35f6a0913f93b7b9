"""Zone membership and line crossings: stream equals batch, out of order, late, and after a restart."""

import random

import pytest
from pyspark.sql import functions as F

from egresslake.operators import zones
from egresslake.streaming import ordered_state

SCHEMA = "run_id string, agent_id long, step long, time_s double, x double, y double, zone_id string, event_ts timestamp"
P1, P2 = (5.0, 0.0), (5.0, 10.0)


def rows_of(seed, agents=7, steps=40):
    rng = random.Random(seed)
    out = []
    for a in range(agents):
        x, zone = rng.uniform(0, 10), None
        for s in range(steps):
            x = min(10.0, max(0.0, x + rng.uniform(-2, 2)))
            zone = rng.choice([zone, zone, "bn_0", "bn_1", None])
            out.append((f"r{a % 2}", a, s, s * 0.5, x, rng.uniform(-2, 12), zone))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("event_ts", F.timestamp_seconds(F.col("time_s") + 1_700_000_000))


def brute_transitions(rows, dt):
    out, held = [], {}
    for run, agent, step, t, _, _, zone in sorted(rows, key=lambda r: (r[1], r[2])):
        before, entry = held.get(agent, (None, None))
        if before != zone:
            if before is not None:
                out.append((run, agent, step, t, before, "exit", max((step - entry) * dt, dt)))
            if zone is not None:
                out.append((run, agent, step, t, zone, "enter", None))
            held[agent] = (zone, step if zone is not None else None)
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_batch_by_brute_force(spark):
    rows = rows_of(1)
    got = zones.zone_transitions(frame(spark, rows), 0.5)
    want = brute_transitions(rows, 0.5)
    assert key(got.collect()) == key(want)
    flows = {(r.run_id, r.zone_id, r.step): r for r in zones.zone_flows(got).collect()}
    for run in ("r0", "r1"):
        for zone in ("bn_0", "bn_1"):
            stays = []
            for step in range(40):
                now = [r for r in want if (r[0], r[4], r[2]) == (run, zone, step)]
                stays += [r[6] for r in now if r[5] == "exit"]
                if now:
                    f = flows[run, zone, step]
                    assert (f.inflow, f.outflow) == (sum(r[5] == "enter" for r in now), sum(r[5] == "exit" for r in now))
                    assert f.mean_dwell_s == pytest.approx(sum(stays) / len(stays) if stays else 0.0)
    assert min(r[6] for r in want if r[6] is not None) >= 0.5
    bottleneck = zones.bottleneck_rows(frame(spark, rows).withColumns({"speed": F.lit(1.0), "local_density": F.lit(2.0)}), 0.5).collect()
    assert sum(r.occupancy for r in bottleneck) == sum(r[6] is not None for r in rows) and sum(r.inflow for r in bottleneck) == sum(r[5] == "enter" for r in want)


def test_empty_and_single_samples(spark):
    assert zones.zone_transitions(frame(spark, []), 1.0).collect() == []
    got = zones.zone_transitions(frame(spark, [("r", 1, 3, 1.5, 0.0, 0.0, "bn_0"), ("r", 2, 3, 1.5, 0.0, 0.0, None)]), 1.0).collect()
    assert key(got) == [("r", 1, 3, 1.5, "bn_0", "enter", None)]


def put(spark, rows, folder):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("kind", ["zones", "lines"])
def test_stream_equals_batch_after_a_restart(spark, tmp_path, kind):
    """Three starts over one checkpoint: shuffled rows, then the rest with late rows, then one that moves the watermark past all."""
    rows = rows_of(2)
    rng = random.Random(9)
    early, late_part = [r for r in rows if r[2] < 22], [r for r in rows if r[2] >= 22]
    rng.shuffle(early)
    rng.shuffle(late_part)
    too_late = [("r0", 0, 1, 0.5, 9.0, 5.0, "bn_1"), ("r1", 1, 2, 1.0, 1.0, 5.0, None)]  # older than the watermark of the first start
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        made = ordered_state.zone_stream(stream, 0.5, delay="1 second") if kind == "zones" else ordered_state.line_stream(stream, P1, P2, delay="1 second")
        return ordered_state.finished(made, out, kind)

    put(spark, early, folder)
    first = run().count()
    put(spark, late_part + too_late, folder)
    second = run().count()
    put(spark, [("r9", 99, 1000, 5000.0, 0.0, 0.0, None)], folder)
    got = run().collect()
    batch = frame(spark, rows)
    want = zones.zone_transitions(batch, 0.5) if kind == "zones" else zones.line_transitions(batch, P1, P2)
    want = want.collect()
    assert 0 < first < second < len(got) == len(want)
    assert key(got) == key(want)
    assert run().count() == len(want)  # a start with nothing new adds nothing


def test_state_store_setting_comes_back(spark):
    before = spark.conf.get(ordered_state.PROVIDER, None)
    with ordered_state.state_store(spark):
        assert "RocksDB" in spark.conf.get(ordered_state.PROVIDER)
    assert spark.conf.get(ordered_state.PROVIDER, None) == before


def test_folds():
    fold = ordered_state.membership(0.5)
    held, out = fold(None, (0, 4, 2.0, "a"))
    assert (held, out) == (("a", 4), [(4, 2.0, "a", "enter", None)])
    held, out = fold(held, (1, 4, 2.0, "b"))
    assert (held, out) == (("b", 4), [(4, 2.0, "a", "exit", 0.5), (4, 2.0, "b", "enter", None)])
    cross = ordered_state.crossing((0.0, 0.0), (0.0, 4.0))
    held, out = cross(None, (0, 0, 0.0, 1.0, 1.0))
    assert out == []
    held, out = cross(held, (1, 1, 0.5, -1.0, 1.0))
    assert out == [(1, 0.5, 1)]
    assert cross(held, (2, 2, 1.0, 1.0, 30.0))[1] == []


def test_a_stream_that_is_killed_in_a_batch_goes_on(spark, tmp_path):
    """The fold fails in the middle of the first batch that has ready rows; the next start does that batch again."""
    rows, flag = rows_of(5), tmp_path / "killed"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, rows, folder)
    put(spark, [("r9", 99, 1000, 5000.0, 0.0, 0.0, None)], folder)
    path, whole = str(flag), ordered_state.membership(0.5)

    def fold(held, row):
        import os

        if row[1] == 30 and not os.path.exists(path):
            open(path, "w").close()
            raise RuntimeError("killed")
        return whole(held, row)

    def start():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        made = ordered_state.in_order(stream, ["run_id", "agent_id"], ["time_s", "zone_id"], "zone string, entry long", "step long, time_s double, zone_id string, kind string, dwell_s double", fold, "1 second")
        return ordered_state.finished(made, out, "zones")

    with pytest.raises(Exception, match="killed"):
        start()
    assert flag.exists()
    assert key(start().collect()) == key(zones.zone_transitions(frame(spark, rows), 0.5).collect())
