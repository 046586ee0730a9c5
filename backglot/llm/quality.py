"""Quality by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, hinge loss.

The n-grams are words, word shapes, and pairs of either (``linear.ngram_features``). Over a bounded sample of labelled
rows each gets the logarithm of the ratio of its smoothed shares in good and in bad rows. A linear model over the
scaled indicators is fitted by dual coordinate descent, and a sigmoid turns its margin into a score.

Defined results for odd inputs: null and empty texts have no features and get the intercept's score; without a usable
label of either class every score is the share of good labels (0 without labels); repeated rows get repeated results;
an empty table gives an empty result; lang, source and other columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backglot.llm import linear
from backglot.llm.linear import BITS, Rows, sigmoid
from backglot.llm.toxicity import held_out_of
from backglot.sources.tables import scan

SAMPLE_ROWS = 8_000  # labelled rows that the model is fitted on
THRESHOLD = 0.7


def log_count_ratios(rows: Rows, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Per feature, log of its smoothed share among good rows over that among bad rows."""
    good, bad = rows.counts(y) + smooth, rows.counts(1 - y) + smooth
    return np.log(good / (y.sum() + 2 * smooth)) - np.log(bad / ((1 - y).sum() + 2 * smooth))


def _norm(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares + 1)


def dual_descent(rows: Rows, scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of the linear model with hinge loss, one dual variable per row at a time."""
    weight, bias = np.zeros(1 << BITS), 0.0
    sign = np.where(y > 0.5, 1.0, -1.0)
    share = np.where(sign > 0, (sign < 0).mean(), (sign > 0).mean()) * 2  # both classes weigh alike
    limit, dual = cost * share, np.zeros(rows.n)
    found = [rows.found[a:b] for a, b in zip(rows.at, rows.at[1:])]
    values = []
    for x in found:
        v = scale[x]
        values.append(v / _norm(np.dot(v, v)))
    square = np.array([np.dot(v, v) + 1 for v in values])
    draw = np.random.RandomState(11)
    for _ in range(rounds):
        for i in draw.permutation(rows.n):
            gradient = sign[i] * (np.dot(weight[found[i]], values[i]) + bias) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), limit[i])
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[found[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weight, bias


def fit_sigmoid(margin: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and offset that turn margins into shares of good rows."""
    good = y.sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):  # Newton steps with a little damping
        p = sigmoid(slope * margin + offset)
        error, curve = p - target, np.maximum(p * (1 - p), 1e-9)
        a, b, c = (curve * margin**2).sum() + 1e-3, (curve * margin).sum(), curve.sum() + 1e-3
        g, h = (error * margin).sum(), error.sum()
        det = a * c - b * b
        slope -= 0.5 * (c * g - b * h) / det
        offset -= 0.5 * (a * h - b * g) / det
    return float(np.clip(slope, 0.1, 50)), float(offset)


def fit(rows: Rows, y: np.ndarray) -> dict:
    empty = {"keep": np.zeros(1 << BITS, bool), "scale": np.zeros(1), "weight": np.zeros(1), "bias": 0.0, "slope": 1.0}
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.0, 1e-12, 1 - 1e-12)
        return empty | {"offset": float(np.log(share / (1 - share)))}
    ratio = log_count_ratios(rows, y)
    every = rows.counts(np.ones(rows.n))
    expected = every * y.mean()
    gap = np.abs(rows.counts(y) - expected) / np.sqrt(np.maximum(expected * (1 - y.mean()), 0.5))
    keep = (every >= 5) & (gap >= 3)
    chosen = rows.only(keep)
    scale = np.where(keep, ratio, 0)
    weight, bias = dual_descent(chosen, scale, y)
    model = {"keep": keep, "scale": scale.astype(np.float32), "weight": weight.astype(np.float32), "bias": bias}
    slope, offset = fit_sigmoid(_margin(chosen.n, chosen.owner, chosen.found, model), y)
    return model | {"slope": slope, "offset": offset}


def _margin(n: int, owner: np.ndarray, found: np.ndarray, model: dict) -> np.ndarray:
    if not len(found):
        return np.full(n, float(model["bias"]))
    values = model["scale"][found].astype(float)
    norm = _norm(np.bincount(owner, values**2, n))
    return np.bincount(owner, model["weight"][found] * values, n) / norm + model["bias"]


def _score(n: int, owner: np.ndarray, found: np.ndarray, model: dict) -> np.ndarray:
    return sigmoid(model["slope"] * _margin(n, owner, found, model) + model["offset"])


def quality_model(docs: DataFrame, labels: DataFrame, usable, rows: int = SAMPLE_ROWS) -> dict:
    """Fitted on at most ``rows`` labelled documents that satisfy ``usable``."""
    return fit(*linear.labelled_sample(docs, labels, "quality", usable, rows, linear.ngram_features))


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1; higher: likelier good)."""
    return linear.apply_scores(docs, linear.ngram_features, _score, model)


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = scan(spark, folder, "documents"), scan(spark, folder, "labels")
    held_out = held_out_of(2, 4)
    scored = score_quality(docs.select("doc_id", "text"), quality_model(docs, labels, ~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
