"""Fits and exact p-values against numpy and enumeration."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from egresslake.operators import calibration, graph, ordered, statistics

# Hourly riders of one station on one day, as published.
RIDERS = "2828 1198 565 399 315 1838 3820 4584 5223 4984 4908 5484 5137 5737 5454 5997 5145 4784 4269 3833 4366 3884 3599 1780"


def choices(n=900, users=53, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * [2, 6, 0.8, 1, 0.3] + [0, 1, 0, 0, 0.5]
    p = 1 / (1 + np.exp(-(0.3 + x @ [0.5, 0.1, 1.5, 0.2, -0.4])))
    y = (rng.random(n) < p).astype(int)
    user = [f"u{k:03d}" for k in rng.integers(0, users, n)]
    return user, x, y


def frame(spark, user, x, y):
    rows = [(u, *map(float, r), int(c), float(k % 6) if k % 4 else None, 1000.0 + 7 * k % 5000) for k, (u, r, c) in enumerate(zip(user, x, y, strict=True))]
    names = ", ".join(f"{f} double" for f in calibration.ROUTE_FEATURES)
    return spark.createDataFrame(rows, f"user_id string, {names}, choice_right int, confidence double, decision_time_ms double").repartition(7)


def by_descent(z, y, l2):
    """The minimum by plain Newton in numpy."""
    w, mask = np.zeros(z.shape[1]), np.r_[0, np.ones(z.shape[1] - 1)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.diag(mask), z.T @ (p - y) / len(y) + l2 * mask * w)
    return w


def test_route_choice_fit(spark):
    user, x, y = choices()
    fit = calibration.route_choice_fit(frame(spark, user, x, y))
    held = set(sorted(set(user))[::5])
    test = np.array([u in held for u in user])
    mean, sd = x[~test].mean(0), x[~test].std(0)
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = by_descent(z[~test], y[~test], 1e-3)
    assert list(fit["coefficients"].values()) == pytest.approx(w.tolist(), abs=1e-8)
    p = 1 / (1 + np.exp(-z[test] @ w))
    rate = y[~test].mean()
    assert fit["metrics"]["test_log_loss"] == pytest.approx(-np.mean(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)), abs=1e-9)
    assert fit["metrics"]["test_baseline_log_loss"] == pytest.approx(-np.mean(y[test] * np.log(rate) + (1 - y[test]) * np.log(1 - rate)), abs=1e-9)
    assert fit["metrics"]["test_accuracy"] == pytest.approx(np.mean((p >= 0.5) == y[test])) and fit["metrics"]["test_log_loss_improvement"] > 0.1
    assert fit["records"] == {"total": 900, "train": int((~test).sum()), "test": int(test.sum()), "participants": len(set(user)), "holdout_participants": len(held)}
    confidence = np.mean([k % 6 for k in range(900) if k % 4]) / 5
    speed = 1 - np.median([1000 + 7 * k % 5000 for k in range(900)]) / 8000
    assert fit["priors"] == pytest.approx({"familiarity": min(1, 0.65 * confidence + 0.35 * speed), "herding": 1 / (1 + math.exp(-w[4])), "exit_affinity": 1 / (1 + math.exp(-np.linalg.norm(w[1:4]) / math.sqrt(3)))})
    assert json.loads(calibration.fit_document(fit)) == json.loads(json.dumps(fit))


def test_fit_edges(spark):
    user, x, y = choices(120, 1)
    with pytest.raises(ValueError):
        calibration.route_choice_fit(frame(spark, user, x, y))
    with pytest.raises(ValueError):
        calibration.held_out(frame(spark, user, x, y), "user_id", 1)
    apart = spark.createDataFrame([(float(i), 5.0, int(i > 10)) for i in range(20)] + [(None, 1.0, 1)], "a double, b double, y int")
    model = calibration.logistic(apart, ["a", "b"], "y")  # separable, and b does not vary
    assert model.weights[1] > 1 and model.weights[2] == pytest.approx(0, abs=1e-6) and model.scale[1] == 1.0


def test_demand_profile(spark):
    riders = [float(v) for v in RIDERS.split()]
    rows = [("s", i, v) for i, v in enumerate(riders)] + [("t", 3, 10.0), ("t", 1, 30.0), ("none", 0, 0.0), ("none", 1, None)]
    got = calibration.demand_profile(spark.createDataFrame(rows, "station string, hour int, riders double"), "station", "hour", "riders", 240, 2)
    by = {(r.station, r.hour): r for r in got.collect()}
    raw = np.array(riders) * 240 / sum(riders)
    counts = np.floor(raw).astype(int)
    counts[np.argsort(-(raw - counts), kind="stable")[: 240 - counts.sum()]] += 1
    assert [by["s", i].agents for i in range(len(riders))] == counts.tolist() and sum(counts) == 240
    assert [by["s", i].release_step for i in range(3)] == [0, 2, 4] and (by["t", 1].agents, by["t", 3].agents) == (180, 60)
    assert not any(k[0] == "none" for k in by)
    left = np.array(riders) - counts * sum(riders) / 240
    m = {r.station: r for r in calibration.demand_metrics(got).collect()}["s"]
    assert (m.mae, m.rmse, m.max_abs) == pytest.approx((np.abs(left).mean(), np.sqrt((left**2).mean()), np.abs(left).max()))
    assert (m.hours, m.observed_total, m.mae, m.rmse, by["s", 15].agents) == (24, 90131.0, pytest.approx(99.86006944444449), pytest.approx(112.59463320471644), 16)
    assert m.total_residual == pytest.approx(0, abs=1e-6) and m.agents_per_rider == pytest.approx(240 / sum(riders))
    with pytest.raises(ValueError):
        calibration.demand_profile(got, "station", "hour", "observed", 0)


def curve(d, v0, gamma, jam):
    return np.where(d < jam, v0 * (1 - np.exp(-gamma * (1 / d - 1 / jam))), 0.0)


@pytest.mark.parametrize("truth", [(1.34, 1.913, 5.4), (1.0, 3.0, 7.0), (2.2, 0.8, 4.0)])
def test_curve_is_recovered(spark, truth):
    d = np.linspace(0.1, truth[2] - 0.3, 120)
    v = curve(d, *truth)
    fit = calibration.curve_fit(spark.createDataFrame(list(zip(d.tolist(), v.tolist(), strict=True)), "density double, speed double"))
    assert (fit["v0_fit"], fit["gamma_fit"], fit["rho_max_fit"]) == pytest.approx(truth, rel=1e-3)
    assert fit["r_squared"] == pytest.approx(1, abs=1e-6) and fit["rmse"] < 1e-4 and fit["n_points"] == int((v > 0.01).sum())


def test_curve_bounds_noise_and_few_points(spark):
    rng = np.random.default_rng(1)
    d = rng.uniform(0.2, 5, 400)
    v = curve(d, 5.0, 1.5, 5.2) + rng.normal(size=400) * 0.05  # free speed beyond the upper bound
    rows = [(float(a), float(b)) for a, b in zip(d, v, strict=True)]
    extra = [(None, 1.0), (1.0, None), (float("nan"), 1.0), (float("inf"), 1.0), (0.001, 1.0), (1.0, 0.0)]
    fit = calibration.curve_fit(spark.createDataFrame(rows + extra, "density double, speed double"))
    assert fit["v0_fit"] == 3.0 and 0.1 <= fit["gamma_fit"] <= 10 and 2 <= fit["rho_max_fit"] <= 10 and fit["n_points"] == int((v > 0.01).sum())
    mask = v > 0.01
    best = min(float(((v[mask] - curve(d[mask], 3.0, g, j)) ** 2).sum()) for g in np.linspace(0.1, 10, 100) for j in np.linspace(2, 10, 81))
    assert fit["rmse"] <= math.sqrt(best / mask.sum()) + 1e-9
    few = calibration.curve_fit(spark.createDataFrame([(1.0, 1.0)], "density double, speed double"))
    assert (few["v0_fit"], few["n_points"], few["r_squared"]) == (1.34, 1, 0.0) and few["rmse"] == pytest.approx(abs(1 - float(curve(np.array([1.0]), 1.34, 1.913, 5.4)[0])))
    none = calibration.curve_check(spark.createDataFrame([], "density double, speed double"))
    assert none["n_points"] == 0 and none["fit"]["rmse"] == 0.0
    good = calibration.curve_check(spark.createDataFrame([(float(a), float(curve(np.array([a]), 1.34, 1.913, 5.4)[0])) for a in np.linspace(0.2, 5, 30)], "density double, speed double"))
    assert good["passed"] and good["rmse"] == pytest.approx(0, abs=1e-9)


def test_u_by_enumeration(spark):
    rows, want = [], {}
    rng = np.random.default_rng(8)
    for m, n in [(1, 1), (1, 4), (2, 3), (3, 3), (4, 5), (5, 2), (6, 6), (8, 8)]:
        x = rng.permutation(m + n).astype(float)
        g = f"{m}-{n}"
        rows += [(g, "a" if i < m else "b", float(v)) for i, v in enumerate(x)]
        u = sum(a > b for a in x[:m] for b in x[m:])
        low = min(u, m * n - u)
        ways = [sum(c) - m * (m - 1) / 2 for c in itertools.combinations(range(m + n), m)]
        want[g] = (u, min(1.0, 2 * sum(w <= low for w in ways) / len(ways)))
    tied = [("tied", s, float(v)) for s, v in (("a", 1), ("a", 2), ("b", 2), ("b", 3))]
    large = [("large", "ab"[i % 2], float(i * 37 % 101)) for i in range(60)]
    got = {r.g: (r.u, r.p) for r in statistics.mann_whitney(spark.createDataFrame(rows + tied + large, "g string, s string, v double"), ["g"], "s", "v").collect()}
    for g, (u, p) in want.items():
        assert got[g] == pytest.approx((u, p), abs=1e-12), g
    z = max(0.0, abs(got["tied"][0] - 2) - 0.5) / math.sqrt(4 / 12 * (5 - 6 / 12))
    assert got["tied"][1] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-5)  # ties fall back to the normal p
    assert 0 < got["large"][1] <= 1


def test_w_by_enumeration(spark):
    rows, want = [], {}
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 5, 8, 12):
        d = (rng.permutation(n) + 1.0) * rng.choice([-1, 1], n)
        rows += [(f"n{n}", float(v)) for v in d]
        up = d[d > 0].sum()
        w = min(up, n * (n + 1) / 2 - up)
        sums = [sum(c) for k in range(n + 1) for c in itertools.combinations(range(1, n + 1), k)]
        want[f"n{n}"] = (w, min(1.0, 2 * sum(s <= w for s in sums) / len(sums)))
    rows += [("zero", 0.0), ("tied", 1.0), ("tied", -1.0), ("tied", 2.0)] + [("n50", (-1.0) ** (i // 3) * (i + 1)) for i in range(50)] + [("n51", (-1.0) ** (i // 3) * (i + 1)) for i in range(51)]
    df = spark.createDataFrame(rows, "g string, d double")
    got, normal = ({r.g: (r.w, r.p) for r in statistics.wilcoxon(df, ["g"], "d", exact=e).collect()} for e in (True, False))
    for g, v in want.items():
        assert got[g] == pytest.approx(v, abs=1e-12), g
    assert got["n50"][1] != normal["n50"][1] and got["n50"][1] == pytest.approx(normal["n50"][1], abs=0.01)
    assert got["n51"] == normal["n51"] and got["tied"] == normal["tied"] and "zero" not in got


def test_numbers_and_ranges(spark):
    rows = [(g, v) for g, n in (("hot", 3000), ("a", 3), (None, 5)) for v in range(n)]
    df = spark.createDataFrame([(g, float(v)) for g, v in rows] + [("hot", 1e12), ("hot", float("inf")), ("hot", -1e300)], "g string, v double").repartition(6)
    got = [(r.g, r.v) for r in graph.numbered(df, ["g", "v"]).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and len(got) == 3011
    assert sorted(r.place for r in graph.numbered(df, ["g", "v"]).collect()) == list(range(3011))
    sums = {(r.g, r.v): (r.n_below, r.n_all) for r in ordered.running_sums(df, ["g"], "v", {"n": F.lit(1)}).collect()}
    for g in ("hot", "a", None):
        values = sorted(v for k, v in sums if k == g)
        assert [sums[g, v] for v in values] == [(i, len(values)) for i in range(len(values))]


def test_outliers_do_not_fill_one_range(spark):
    df = spark.range(5000).select(F.col("id").cast("double").alias("v")).unionByName(spark.createDataFrame([(1e15,)], "v double"))
    plan = ordered.running_sums(df, [], "v", {"n": F.lit(1)}, buckets=10)
    assert plan.count() == 5001
    bounds = df.agg(F.percentile_approx("v", F.array(*[F.lit(i / 10) for i in range(1, 10)]), ordered.ACCURACY)).first()[0]
    sizes = np.bincount(np.searchsorted(bounds, [*range(5000), 1e15]))
    assert sizes.max() < 700
