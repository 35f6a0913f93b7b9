"""Fits from observations: route choice with held-out participants, demand profiles, the speed-density curve.

A fit is a few rounds over a stored table. A round is one aggregate: sums of gradients and products, combined before the shuffle; the
driver sees those sums only, never rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.functions.nullsafe import num, or_zero, ratio
from egresslake.functions.scalars import weidmann
from egresslake.operators.aggregates import largest_remainder
from egresslake.operators.graph import cut, numbered

ROUNDS = 50
#: Probabilities in log losses, and logits, are kept within these bounds.
EDGE, LOGIT = 1e-9, 50.0
#: Route-choice features in the order of their coefficients.
ROUTE_FEATURES = ("right_width_advantage_m", "right_shortness_advantage_m", "right_stairs_advantage", "previous_choice_right", "trial_progress")
#: Time for a decision, the scale of confidence answers, weights of confidence and speed in familiarity.
COUNTDOWN_MS, CONFIDENCE_SCALE, CONFIDENCE_WEIGHT, SPEED_WEIGHT = 8000.0, 5.0, 0.65, 0.35
#: Bounds of free speed, shape and jam density in a fit, and densities and speeds that take part.
CURVE_LOW, CURVE_HIGH, CURVE_START, CURVE_LEAST, CURVE_POINTS = (0.5, 0.1, 2.0), (3.0, 10.0, 10.0), (1.34, 1.913, 5.4), 0.01, 5


def held_out(rows: DataFrame, user: str, stride: int = 5) -> DataFrame:
    """rows with test: whether the row's user is the first, or each stride-th after, of all users in order. Rows without a user are left out."""
    if stride < 2:
        raise ValueError("the stride must be at least 2")
    users = numbered(rows.select(user).distinct().filter(F.col(user).isNotNull()), [user], "_place")
    return rows.join(users.select(user, (F.col("_place") % stride == 0).alias("test")), user)


def logit(w: Sequence[float], x: Sequence[Column]) -> Column:
    z = F.lit(float(w[0]))
    for c, v in zip(w[1:], x, strict=True):
        z = z + F.lit(float(c)) * v
    return F.least(F.greatest(z, F.lit(-LOGIT)), F.lit(LOGIT))


@dataclass(frozen=True)
class Logistic:
    """A logistic model on standardised features: weights are (intercept, one per feature)."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    rounds: int

    def standard(self) -> list[Column]:
        return [(F.col(f) - m) / s for f, m, s in zip(self.features, self.mean, self.scale, strict=True)]

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-logit(self.weights, self.standard())))


def logistic(rows: DataFrame, features: Sequence[str], label: str, l2: float = 1e-3, tolerance: float = 1e-10) -> Logistic:
    """L2 logistic regression (the intercept is free) by Newton rounds with step halving; label is 0 or 1.

    Each round is one aggregate of the gradient, the Hessian and the loss: (k + 1)(k + 4) / 2 + 1 sums for k features. Rows with a NULL
    feature or label are left out. Features that do not vary have weight 0.
    """
    d = rows.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"))
    d = cut(d.dropna())
    k = len(features)
    first = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(k)]).first()
    if not first["n"]:
        raise ValueError("no rows to fit")
    mean = [first[f"m{i}"] for i in range(k)]
    scale = [first[f"s{i}"] if first[f"s{i}"] >= EDGE else 1.0 for i in range(k)]
    x = [F.lit(1.0), *[(F.col(f"x{i}") - mean[i]) / scale[i] for i in range(k)]]
    penalty = np.array([0.0, *[l2] * k])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = 1 / (1 + F.exp(-logit(w, x[1:])))
        s = d.select(*[c.alias(f"c{i}") for i, c in enumerate(x)], "y", p.alias("p"))
        safe = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
        parts = [F.avg(-(F.col("y") * F.log(safe) + (1 - F.col("y")) * F.log(1 - safe)))]
        parts += [F.avg((F.col("p") - F.col("y")) * F.col(f"c{i}")) for i in range(k + 1)]
        parts += [F.avg(F.col("p") * (1 - F.col("p")) * F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k + 1) for j in range(i, k + 1)]
        got = [float(v) for v in s.agg(*[c.alias(f"_{n}") for n, c in enumerate(parts)]).first()]
        grad = np.array(got[1 : k + 2]) + penalty * w
        hess = np.zeros((k + 1, k + 1))
        hess[np.triu_indices(k + 1)] = got[k + 2 :]
        hess = hess + np.triu(hess, 1).T + np.diag(penalty)
        return got[0] + float((penalty * w * w).sum()) / 2, grad, hess

    w = np.zeros(k + 1)
    loss, grad, hess = sums(w)
    for done in range(1, ROUNDS + 1):
        step = np.linalg.lstsq(hess + 1e-12 * np.eye(k + 1), grad, rcond=None)[0]
        share = 1.0
        while True:
            nxt = w - share * step
            found = sums(nxt)
            if found[0] <= loss + 1e-15 or share < 1e-4:
                break
            share /= 2
        moved, (loss, grad, hess), w = float(np.linalg.norm(nxt - w)), found, nxt
        if moved < tolerance:
            break
    return Logistic(tuple(features), tuple(float(v) for v in w), tuple(mean), tuple(scale), done)


def choice_metrics(rows: DataFrame, model: Logistic, label: str) -> DataFrame:
    """One row: log loss of the train and test rows, baseline of the train rows' share, accuracies, counts. rows have test."""
    y, p = F.col(label).cast("double"), F.col("_p")
    d = rows.withColumn("_p", model.probability())
    rate = d.agg(F.avg(F.when(~F.col("test"), y)).alias("_rate"))
    d = d.crossJoin(F.broadcast(rate)).withColumn("_rate", F.least(F.greatest(F.col("_rate"), F.lit(EDGE)), F.lit(1 - EDGE)))  # one row

    def loss(q: Column) -> Column:
        q = F.least(F.greatest(q, F.lit(EDGE)), F.lit(1 - EDGE))
        return -(y * F.log(q) + (1 - y) * F.log(1 - q))

    def right(q: Column) -> Column:
        return ((q >= 0.5).cast("double") == y).cast("double")

    def over(test: bool, c: Column) -> Column:
        return F.avg(F.when(F.col("test") == test, c))

    out = d.agg(
        F.count_if(~F.col("test")).alias("train"), F.count_if("test").alias("test"), over(False, loss(p)).alias("train_log_loss"), over(True, loss(p)).alias("test_log_loss"),
        over(True, loss(F.col("_rate"))).alias("test_baseline_log_loss"), over(True, right(p)).alias("test_accuracy"), over(True, right(F.col("_rate"))).alias("test_baseline_accuracy"),
    )
    return out.withColumn("test_log_loss_improvement", F.col("test_baseline_log_loss") - F.col("test_log_loss"))


def choice_priors(rows: DataFrame, model: Logistic, confidence: str = "confidence", decision_ms: str = "decision_time_ms") -> DataFrame:
    """One row of familiarity, herding and exit_affinity.

    Familiarity weighs mean confidence (half, where nobody gave one) with the speed of the median decision; herding is the pull of
    the choice before; exit affinity the strength of the first three weights, those of geometry.
    """
    values = rows.agg(F.coalesce(F.avg(num(confidence)) / CONFIDENCE_SCALE, F.lit(0.5)).alias("c"), (1 - F.percentile(num(decision_ms), 0.5) / COUNTDOWN_MS).alias("s"))
    w = model.weights

    def sigmoid(v: float) -> Column:
        return 1 / (1 + F.exp(F.lit(-float(v))))

    geometry = float(np.linalg.norm(w[1:4]) / np.sqrt(3.0))
    familiar = F.least(F.lit(1.0), F.greatest(F.lit(0.0), CONFIDENCE_WEIGHT * F.col("c") + SPEED_WEIGHT * F.col("s")))
    return values.select(familiar.alias("familiarity"), sigmoid(w[4]).alias("herding"), sigmoid(geometry).alias("exit_affinity"))


def route_choice_fit(rows: DataFrame, user: str = "user_id", label: str = "choice_right", features: Sequence[str] = ROUTE_FEATURES, stride: int = 5, l2: float = 1e-3) -> dict:
    """The fit as a document: records, coefficients, standardization, metrics, priors (where the five features are used), method."""
    split = cut(held_out(rows, user, stride))
    if split.agg(F.count_distinct("test")).first()[0] < 2:
        raise ValueError("a fit needs participants in both parts")
    model = logistic(split.filter("not test"), features, label, l2)
    metrics = choice_metrics(split, model, label).first().asDict()
    people = split.agg(F.count_distinct(user).alias("a"), F.count_distinct(F.when(F.col("test"), F.col(user))).alias("h")).first()
    train, test = metrics.pop("train"), metrics.pop("test")
    out = {
        "records": {"total": train + test, "train": train, "test": test, "participants": people["a"], "holdout_participants": people["h"]},
        "feature_names": list(features),
        "coefficients": dict(zip(["intercept", *features], model.weights, strict=True)),
        "standardization": {"mean": dict(zip(features, model.mean, strict=True)), "scale": dict(zip(features, model.scale, strict=True))},
        "metrics": metrics,
        "method": {"model": "l2 logistic regression, participants held out", "holdout_stride": stride, "l2": l2, "rounds": model.rounds},
    }
    if len(features) >= 4 and {"confidence", "decision_time_ms"} <= set(rows.columns):
        out["priors"] = choice_priors(split, model).first().asDict()
    return out


def fit_document(fit: Mapping) -> str:
    """A fit as JSON, keys sorted."""
    return json.dumps(fit, indent=2, sort_keys=True) + "\n"


def demand_profile(rows: DataFrame, station: str, hour: str, riders: str, population: int, interval: int = 1) -> DataFrame:
    """Riders per hour of each station scaled to so many agents, with what rounding leaves.

    (station, hour, observed, raw_agents, agents, predicted, residual, release_step): agents are whole and sum to the population for each
    station; predicted is agents in riders; release steps count the station's hours. Stations without riders are left out.
    """
    if population <= 0 or interval <= 0:
        raise ValueError("population and interval must be positive")
    d = rows.groupBy(F.col(station).alias("station"), F.col(hour).alias("hour")).agg(F.sum(num(riders)).alias("observed")).filter("observed is not null")
    total = d.groupBy("station").agg(F.sum("observed").alias("_all")).filter("_all > 0")
    d = d.join(total, "station").withColumn("raw_agents", F.col("observed") * (F.lit(float(population)) / F.col("_all")))
    d = largest_remainder(d, ["station"], "observed", F.lit(population), ["hour"]).withColumnRenamed("allotted", "agents")
    d = d.withColumn("predicted", F.col("agents") / (F.lit(float(population)) / F.col("_all"))).withColumn("residual", F.col("observed") - F.col("predicted"))
    place = F.row_number().over(Window.partitionBy("station").orderBy("hour")) - 1  # hours of one station
    return d.withColumn("release_step", place * interval).drop("_all")


def demand_metrics(profile: DataFrame) -> DataFrame:
    """Per station: hours, riders, agents per rider, and mean absolute, root mean square, largest and summed residual."""
    return profile.groupBy("station").agg(
        F.count(F.lit(1)).alias("hours"), F.sum("observed").alias("observed_total"), ratio(F.sum("agents"), F.sum("observed")).alias("agents_per_rider"),
        F.avg(F.abs("residual")).alias("mae"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"), F.max(F.abs("residual")).alias("max_abs"), F.sum("residual").alias("total_residual"),
    )


def curve_fit(rows: DataFrame, density: str = "density", speed: str = "speed", start: Sequence[float] = CURVE_START, rounds: int = 200) -> dict:
    """Bounded least squares of the speed-density curve: v0_fit, gamma_fit, rho_max_fit, r_squared, rmse, n_points.

    Points are reduced to distinct densities with counts and sums of speeds, which loses nothing. One aggregate gives the error of a
    grid of parameters; from its best, damped Gauss-Newton rounds, an aggregate each, go on within the bounds. Under CURVE_POINTS points the start is returned.
    """
    d, v = num(density), num(speed)
    finite = (d > CURVE_LEAST) & (v > CURVE_LEAST) & (d < float("inf")) & (v < float("inf"))
    cells = cut(rows.select(d.alias("d"), v.alias("v")).filter(finite).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")))
    total = cells.agg(or_zero(F.sum("n")).alias("n"), or_zero(F.sum("s")).alias("s"), or_zero(F.sum("q")).alias("q"), F.min("d"), F.max("d")).first()
    n = int(total["n"])

    def error(v0: Column | float, gamma: Column | float, jam: Column | float) -> Column:
        free = 1 - F.exp(-gamma * (1 / F.col("d") - 1 / jam))
        f = F.when(F.col("d") >= jam, 0.0).otherwise(v0 * free)
        return F.sum(F.col("q") - 2 * f * F.col("s") + F.col("n") * f * f)

    if n < CURVE_POINTS:
        at = np.array(start)
        best = float(cells.agg(or_zero(error(*[F.lit(float(x)) for x in at]))).first()[0])
        return {"v0_fit": at[0], "gamma_fit": at[1], "rho_max_fit": at[2], "r_squared": 0.0, "rmse": float(np.sqrt(max(best, 0) / n)) if n else 0.0, "n_points": n}
    low, high = np.array(CURVE_LOW), np.array(CURVE_HIGH)
    axes = [np.linspace(a, b, 7) for a, b in zip(low, high, strict=True)]
    grid = [tuple(float(x) for x in p) for p in np.array(np.meshgrid(*axes)).T.reshape(-1, 3)] + [tuple(float(x) for x in start)]
    points = F.broadcast(rows.sparkSession.createDataFrame(grid, "v0 double, gamma double, jam double"))  # 344 rows, whatever the data
    best = cells.crossJoin(points).groupBy("v0", "gamma", "jam").agg(error(F.col("v0"), F.col("gamma"), F.col("jam")).alias("e")).orderBy("e", "v0", "gamma", "jam").first()
    at, sse, damp = np.array([best["v0"], best["gamma"], best["jam"]]), float(best["e"]), 1e-3

    def slopes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v0, gamma, jam = (F.lit(float(x)) for x in p)
        arm = 1 / F.col("d") - 1 / jam
        decay = F.exp(-gamma * arm)
        under = F.col("d") < jam
        j = [F.when(under, c).otherwise(0.0) for c in (1 - decay, v0 * arm * decay, v0 * gamma * decay / (jam * jam))]
        f = F.when(under, v0 * (1 - decay)).otherwise(0.0)
        parts = [F.sum(a * (F.col("s") - F.col("n") * f)) for a in j] + [F.sum(F.col("n") * j[a] * j[b]) for a in range(3) for b in range(a, 3)]
        got = np.array([float(x) for x in cells.agg(*[c.alias(f"_{i}") for i, c in enumerate(parts)]).first()])
        h = np.zeros((3, 3))
        h[np.triu_indices(3)] = got[3:]
        return got[:3], h + np.triu(h, 1).T

    grad, hess = slopes(at)
    for _ in range(rounds):
        free = ~(((at <= low) & (grad < 0)) | ((at >= high) & (grad > 0)))  # parameters that are not pressed against a bound
        step = np.zeros(3)
        h = hess[np.ix_(free, free)]
        if free.any():
            step[free] = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), grad[free], rcond=None)[0]
        nxt = np.clip(at + step, low, high)
        found = float(cells.agg(error(*[F.lit(float(x)) for x in nxt])).first()[0])
        moved = float(np.abs(nxt - at).max())
        if found <= sse:
            at, sse, damp = nxt, found, max(damp / 5, 1e-12)
            if moved < 1e-9:
                break
            grad, hess = slopes(at)
        else:
            damp *= 4
            if damp > 1e12 or moved < 1e-12:
                break
    spread = float(total["q"]) - float(total["s"]) ** 2 / n
    return {"v0_fit": float(at[0]), "gamma_fit": float(at[1]), "rho_max_fit": float(at[2]), "r_squared": 1 - max(sse, 0.0) / spread if spread > 1e-10 else 0.0, "rmse": float(np.sqrt(max(sse, 0.0) / n)), "n_points": n}


def curve_check(rows: DataFrame, density: str = "density", speed: str = "speed", most: float = 0.20) -> dict:
    """The fit, and how far the points are from the canonical curve: rmse, greatest deviation, passed (rmse is under `most`)."""
    fit = curve_fit(rows, density, speed)
    d, v = num(density), num(speed)
    gap = F.abs(v - weidmann(d))
    got = rows.filter((d > CURVE_LEAST) & (v > CURVE_LEAST)).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(gap).alias("worst"), F.count(gap).alias("n")).first()
    rmse = float(got["rmse"] or 0.0)
    return {"passed": rmse < most, "rmse": rmse, "max_deviation": float(got["worst"] or 0.0), "n_points": int(got["n"]), "fit": fit}
