r"""Operator 9: toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are which hashed character n-grams (lengths NGRAMS, of the lower-cased UTF-8
bytes) it holds. Each is scaled by its naive Bayes log-count ratio between toxic and other labelled
texts; a logistic regression is trained on the scaled features and folded with the ratios into one
weight per hashed n-gram. Scoring is a sum of weights and a sigmoid.

Training rows: labelled texts outside the held-out fold (crc32 of the id as text, mod 5, is not 0),
at most SAMPLE of each class, those with the least hash of the id. The bound is a parameter; the
training labels' base rate sets the threshold, on every fourth row, which the weights never see. The
driver holds SAMPLE x 2 rows of distinct feature numbers and a table of 2^BITS weights, whatever
the corpus size. Every document is scored whole.

Defined results: a null or empty text has no features and gets the score of the intercept; a
document with several labels is toxic if one of them says so; null labels are left out; without
labels of both classes every score is the base rate, but under 0.5: nothing is held toxic;
of several texts under one id the least trains; equal scores are never
on two sides of the threshold; rows that repeat are scored alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import fold, release, small_batches, stored

BITS = 18
NGRAMS = (3, 4, 5)
SAMPLE = 1500
STEPS = 60
#: N-grams with a smaller absolute log-count ratio are left out.
LEAST_RATIO = 0.4
L2 = 2.0
_U = np.uint32


def features(text: str | None) -> np.ndarray:
    """Distinct hashed n-grams of a text."""
    raw = f" {' '.join(text.lower().split())} " if text else ""
    b = np.frombuffer(raw.encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(_U)
    found = []
    for n in NGRAMS:
        if len(b) < n:
            continue
        h = b[: len(b) - n + 1] * _U(0x01000193)
        for i in range(1, n):
            h = (h ^ b[i : len(b) - n + 1 + i]) * _U(0x01000193)
        h ^= h >> _U(15)
        found.append((h * _U(0x9E3779B1) + _U(n)) >> _U(32 - BITS))
    if not found:
        return np.empty(0, dtype=np.int64)
    h = np.concatenate(found).astype(np.int64)
    last = np.empty(1 << BITS, dtype=np.int32) if len(h) > 1 << 14 else None
    if last is None:
        return np.unique(h)
    last[h] = np.arange(len(h), dtype=np.int32)
    return h[last[h] == np.arange(len(h), dtype=np.int32)]


def threshold(z: np.ndarray, toxic: np.ndarray, base_rate: float) -> float:
    """The cut of held-back scores with the best accuracy at the base rate; the middle of the best range.

    A cut lies between two different scores or beyond an end, never inside a tie: equal scores get one verdict.
    Where all scores are equal, that is the more frequent class (not toxic where both are as frequent).
    """
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order]
    share = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6)
    weight = np.where(toxic == 1, base_rate / share, (1 - base_rate) / (1 - share))
    right = np.concatenate([[0.0], np.cumsum(np.where(toxic == 1, -weight, weight))])
    right[1:-1][z[1:] == z[:-1]] = -np.inf
    best = np.flatnonzero(right >= right.max() - 1e-9)
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(cuts[best[len(best) // 2]])


def fit(rows: list[np.ndarray], toxic: np.ndarray, base_rate: float) -> tuple[np.ndarray, float]:
    """(weight per hashed n-gram, intercept). Every fourth row only sets the threshold."""
    back = np.arange(len(rows)) % 4 == 3
    if toxic[~back].min() == toxic[~back].max() or toxic[back].min(initial=1) == toxic[back].max(initial=0):
        back = np.zeros(len(rows), dtype=bool)
    learn = np.flatnonzero(~back)
    w, bias = logistic([rows[i] for i in learn], toxic[learn])
    check = np.flatnonzero(back) if back.any() else learn
    z = np.array([float(w[rows[i]].sum()) + bias for i in check])
    base_rate = min(max(base_rate, 1e-6), 1 - 1e-6)
    return w.astype(np.float32), bias - threshold(z, toxic[check], base_rate)


def logistic(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    size = 1 << BITS
    pos, neg = np.ones(size), np.ones(size)
    for row, y in zip(rows, toxic.tolist(), strict=True):  # a row's features are distinct
        (pos if y else neg)[row] += 1.0
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    ratio[(pos + neg < 5) | (np.abs(ratio) < LEAST_RATIO)] = 0.0  # seen in under three texts, or tells little
    rows = [row[ratio[row] != 0] for row in rows]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    scale = ratio / np.sqrt(max(1.0, float(np.mean(np.bincount(owner, ratio[flat] ** 2, len(rows))))))
    x = scale[flat].astype(np.float32)
    w, bias, y = np.zeros(size), 0.0, toxic.astype(float)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, x * w[flat], len(rows)) + bias
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = (np.bincount(flat, x * g[owner], size) + L2 * w) / len(rows)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g.mean(), 0.99 * vb + 0.01 * g.mean() ** 2
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.2 * (m / a) / (np.sqrt(v / c) + 1e-6)
        bias -= 0.2 * (mb / a) / (np.sqrt(vb / c) + 1e-6)
    return w * scale, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    small_batches(docs.sparkSession)
    lab = labels.select(F.col("doc_id").alias("_el_id"), F.col("toxic").alias("_el_toxic")).filter("_el_toxic is not null and _el_id is not null")
    lab = lab.filter(fold(F.col("_el_id")) != 0).groupBy("_el_id").agg(F.max("_el_toxic").alias("_el_toxic"))
    order = (F.xxhash64("_el_id"), "_el_id")
    ids = lab.filter("_el_toxic = 1").orderBy(*order).limit(sample).unionByName(lab.filter("_el_toxic <> 1").orderBy(*order).limit(sample))
    rate = lab.agg(F.avg((F.col("_el_toxic") == 1).cast("double"))).first()[0]
    texts = docs.select(F.col(id_col).alias("_el_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "_el_id")
    texts = texts.groupBy("_el_id").agg(F.min("text").alias("text"), F.max("_el_toxic").alias("_el_toxic"))  # an id may stand for many rows

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"f": [features(t).astype("<i4").tobytes() for t in pdf["text"]], "toxic": (pdf["_el_toxic"] == 1).astype("int32")})

    rows = stored(texts.mapInPandas(extract, "f binary, toxic int"), "features")
    got = sorted(((r["toxic"], bytes(r["f"])) for r in rows.coalesce(8).toLocalIterator()))  # a part at a time through the driver's JVM
    release(rows)
    toxic = np.array([y for y, _ in got], dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        p = min(max(rate if rate is not None else 0.499, 1e-6), 0.499)
        return np.zeros(1 << BITS, dtype=np.float32), float(np.log(p / (1 - p)))
    return fit([np.frombuffer(f, dtype="<i4") for _, f in got], toxic, rate)


def scored(text: Column, model: tuple[np.ndarray, float]) -> Column:
    """Column of scores in [0, 1]."""
    weights, bias = model

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        z = np.array([float(weights[features(t)].sum(dtype=np.float64)) + bias for t in texts], dtype=float)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return score(text)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose text scores at least so much."""
    model = train(docs, labels, id_col, text_col)
    return docs.withColumn("_el_score", scored(F.col(text_col), model)).filter(F.col("_el_score") < least).select(docs.columns)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: the score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), scored(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
